"""Scoring channels: lexical, dense, metadata. Each gives sparse (q, item_id, score) rows.

Items that a channel does not find have no row: a table of all questions by all items would grow with the
square of the data. What an absent row means is decided in fusion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

K1, B = 1.5, 0.75
EPSILON = 0.25
DIGITS = 6
#: Question vectors that are sent to the tasks at once.
VECTOR_BLOCK = 4096
#: Items of fewer bytes are dealt out before they are read word by word: few tasks would read such small files.
SPREAD_BYTES = 1 << 30
#: Pairs of a question and an item whose scores one task adds up at most, about 100 bytes each.
TASK_PAIRS = 1 << 20
#: Products of question and item vectors that a task has at once.
PRODUCTS = 1 << 20
#: Question terms that are sent to the tasks at most, about 64 bytes each; beyond that Spark chooses the join.
SENT_TERMS = 1 << 20
#: Stands for a question's own item, after all others.
OWN = np.iinfo(np.int64).max


def dealt(items: DataFrame, item: str = "item_id", text: str = "text", parts: int | None = None, group: str | None = None, always: bool = False) -> tuple[DataFrame, bool]:
    """(item_id, text), and whether they are dealt out by item, or by `group`: `always`, or where Catalyst estimates them at less than SPREAD_BYTES."""
    rows = items.select(*([group] if group else []), F.col(item).alias("item_id"), F.col(text).alias("text"))
    small = always or int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES
    return rows.repartition(*([parts] if parts else []), group or "item_id") if small else rows, small


def postings(
    items: DataFrame, item: str = "item_id", text: str = "text", only: DataFrame | None = None, placed: bool = False, parts: int | None = None, group: str | None = None
) -> DataFrame:
    """(item_id, term, tf, length): an inverted index by row, of the terms of `only` (term) if that is given.

    Other terms go before anything is shuffled. Rows are dealt out by item, or by the column `group` that is kept, if they are not
    `placed` so, and what is summed up for each item afterwards needs no further shuffle.
    """
    own = [group] if group else []
    terms = items.select(*own, F.col(item).alias("item_id"), tx.tokens(F.col(text)).alias("ts"))
    # an outer explode, for which Spark does not make the tokens once more to see whether there are any
    rows = terms.select(*own, "item_id", F.size("ts").alias("length"), F.explode_outer("ts").alias("term")).where("term is not null")
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
        rows = rows if placed else rows.repartition(*([parts] if parts else []), group or "item_id")
    return rows.groupBy(*own, "item_id", "length", "term").agg(F.count("*").alias("tf"))


def corpus_size(items: DataFrame, text: str = "text") -> DataFrame:
    """One row: the number of items and their mean length."""
    return items.agg(F.count("*").alias("n"), F.avg(tx.token_count(F.col(text))).alias("mean_length"))


def question_terms(questions: DataFrame, q: str = "q", text: str = "question") -> DataFrame:
    """(q, term, qtf)."""
    terms = questions.select(F.col(q).alias("q"), F.explode(tx.tokens(F.col(text))).alias("term"))
    return terms.groupBy("q", "term").agg(F.count("*").alias("qtf"))


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(items: DataFrame, questions: DataFrame, variant: str = "plus1", item: str = "item_id", text: str = "text", group: str | None = None) -> DataFrame:
    """BM25 scores. `plus1`: distinct question terms, idf never negative. `okapi`: repeated terms count again, and
    terms in more than half of the items get a quarter of the mean idf.

    Only the postings of question terms are joined; statistics are those of the items given, so filter first
    for statistics of a subset. Scores are added up in as many tasks as TASK_PAIRS asks for, so that what a task holds does not
    grow with the corpus. All items of a `group` are in one task, and the column is in the result.
    """
    asked = question_terms(questions)
    sent = F.broadcast if asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS else lambda rows: rows
    own = [group] if group else []
    pairs = items.count() * questions.count()
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    # okapi has all terms of all items summed up, not those of the questions only: dealt items, in tasks of bounded size, are fewer bytes than their words
    items, placed = dealt(items, item, text, parts, group, variant == "okapi")
    size = corpus_size(items)
    index = postings(items, only=sent(asked.select("term").distinct()), placed=placed, parts=parts, group=group)
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    if variant == "okapi":
        raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        every = postings(items).groupBy("term").agg(F.count("*").alias("df"))  # the mean is over all terms
        mean = every.crossJoin(F.broadcast(size)).agg(F.avg(raw).alias("mean_idf"))
        terms = df.crossJoin(F.broadcast(size)).withColumn("raw", raw).crossJoin(F.broadcast(mean))  # one row of statistics each
        terms = terms.withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")))
        weight = F.col("idf") * F.col("qtf")
    else:
        terms = df.crossJoin(F.broadcast(size))
        terms = terms.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weight = F.col("idf")
    asked = asked.join(terms.select("term", "idf", "mean_length"), "term")
    hits = index.join(sent(asked), "term")
    part = weight * _saturated(F.col("tf"), F.col("length"), F.col("mean_length"))
    return hits.groupBy("q", *own, "item_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def _best(scores: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller item; items are those of each row, or of all rows. NaN is above all numbers."""
    width = scores.shape[1]
    k = min(k, width)
    edge = np.partition(scores, width - k, axis=1)[:, width - k]
    row, at = np.nonzero(~(scores < edge[:, None]))
    items = items[row, at] if items.ndim == 2 else items[at]
    scores = scores[row, at]
    if len(row) > len(edge) * k:  # ties at the edge
        order = np.lexsort((items, -scores, ~np.isnan(scores), row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(edge)))[row] < k]
        items, scores = items[order], scores[order]
    return scores.reshape(-1, k), items.reshape(-1, k)


def _nearest(shared, k: int, digits: int, others: bool = False):
    """The k best of a task's items for each question of a block, so that few rows leave the task; PRODUCTS at a time.

    Where so many questions times k are more than PRODUCTS, the k best of each batch leave the task instead. With `others`,
    items with the question's id come after all others, and those among the k best are dropped at the end.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        ids = np.asarray(ids, np.int64)
        holds = len(ids) * k <= PRODUCTS
        best = [np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)]

        def rows(at, scores, items):
            own = np.repeat(ids[at : at + len(scores)], scores.shape[1])
            scores, items = scores.ravel(), items.ravel()
            if others:
                left = ~((items == OWN) & np.isneginf(scores))
                own, scores, items = own[left], scores[left], items[left]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(items, pa.int64()), pa.array(scores)], ["q", "item_id", "score"])

        for batch in batches:
            lists = batch.column(1)
            if not batch.num_rows:
                continue
            items = np.asarray(lists.flatten(), np.float64).reshape(batch.num_rows, -1)
            names = batch.column(0).to_numpy(zero_copy_only=False)
            before = best[0].shape[1]
            step = max(1, PRODUCTS // (batch.num_rows + before))
            now = []
            for at in range(0, len(ids), step):
                scores = matrix[at : at + step] @ items.T
                np.round(scores, digits, out=scores)
                scores += 0.0
                each = names
                if others and (same := ids[at : at + step, None] == names).any():
                    scores[same] = -np.inf
                    each = np.where(same, OWN, names)
                near = _best(scores, each, k)
                if not holds:
                    yield rows(at, *near)
                elif before:
                    near = _best(*(np.concatenate((old[at : at + step], new), axis=1) for old, new in zip(best, near, strict=True)), k)
                now.append(near)
            if holds:
                best = [np.concatenate(x) for x in zip(*now, strict=True)]
        if best[0].size:
            yield rows(0, *best)

    return scan


def dense(items: DataFrame, questions: DataFrame, k: int, item: str = "item_id", vector: str = "vector", block: int = VECTOR_BLOCK, others: bool = False) -> DataFrame:
    """(q, item_id, score): the k items with the largest dot product, ties to the smaller item_id, and some more, from (q, vector) and (item_id, vector).

    With `others`, only items whose id is not the question's, however many rows have that one.
    Question vectors are broadcast in blocks of bounded size; each pass reads the items once and keeps k of
    each task, so the table of all pairs is never made. Ranking leaves k for each question.
    """
    spark = items.sparkSession
    rows = items.where(F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item_id"), F.col(vector).alias("vector"))
    rows = rows.where("item_id is not null") if others else rows
    parts, held = [], []

    def one_pass(block_rows):
        ids = [r["q"] for r in block_rows]
        matrix = np.array([r["vector"] for r in block_rows], np.float64)
        found = rows.mapInArrow(_nearest(spark.sparkContext.broadcast((ids, matrix)), k, DIGITS, others), "q long, item_id long, score double")
        parts.append(found)

    for row in questions.where("vector is not null").select("q", "vector").toLocalIterator():
        held.append(row)
        if len(held) == block:
            one_pass(held)
            held = []
    if held or not parts:
        one_pass(held or []) if held else parts.append(spark.createDataFrame([], "q long, item_id long, score double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metadata_score(date: Column, location: Column, start: Column, end: Column, locations: Column) -> Column:
    """The mean of the constraints that a question has: 1 if met, 0 if not, 0.5 if the item lacks the field; 0 without any."""
    dated, placed = start.isNotNull(), F.size(F.coalesce(locations, F.array().cast("array<string>"))) > 0
    by_date = F.when(date.isNull(), 0.5).when(date.between(start, end), 1.0).otherwise(0.0)
    low = F.lower(tx.blank(location))
    by_place = F.when(low == "", 0.5).when(F.exists(locations, lambda x: F.contains(low, x)), 1.0).otherwise(0.0)
    total = F.when(dated, by_date).otherwise(0.0) + F.when(placed, by_place).otherwise(0.0)
    return F.coalesce(F.try_divide(total, dated.cast("int") + placed.cast("int")), F.lit(0.0))


def passes_date(date: Column, start: Column, end: Column) -> Column:
    """Whether a hard filter keeps an item: only a known date outside of the range is against it."""
    return start.isNull() | date.isNull() | date.between(start, end)


def metadata(items: DataFrame, questions: DataFrame, hard: bool = False) -> DataFrame:
    """(q, item_id, score, pass) from items (item_id, date, location) and questions (q, start, end, locations).

    Questions without a constraint have no rows. For the others the score of an item depends on its date and
    location alone, so distinct pairs of those meet the questions, and items join the pairs that score. Pairs
    are as many as there are days and places, not items.
    """
    asked = questions.where((F.col("start").isNotNull()) | (F.size("locations") > 0))
    places = items.select("date", F.lower(tx.blank("location")).alias("place")).distinct()
    score = metadata_score(F.col("date"), F.col("place"), F.col("start"), F.col("end"), F.col("locations"))
    keep = passes_date(F.col("date"), F.col("start"), F.col("end"))
    rated = asked.join(places).select("q", "date", "place", F.round(score, DIGITS).alias("score"), keep.alias("pass"))
    rated = rated.where("score > 0 and pass" if hard else "score > 0")
    own = items.select("item_id", "date", F.lower(tx.blank("location")).alias("place")).alias("i")
    same = F.col("i.date").eqNullSafe(F.col("r.date")) & (F.col("i.place") == F.col("r.place"))
    return own.join(rated.alias("r"), same).select("r.q", "i.item_id", "r.score", "r.pass")


def ranked(scores: DataFrame, order: str = "item_id", k: int | None = None) -> DataFrame:
    """(q, item_id, score, rank): ranks are row numbers by falling score, ties by corpus order."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), order)))
    return out if k is None else out.where(F.col("rank") <= k)
