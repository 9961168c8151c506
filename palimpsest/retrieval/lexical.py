"""A BM25 index in a folder: bucketed postings in blocks, block-max pruning, batches that are added and merged.

A posting is a row (term, block, item_id, tf, length). Postings are a table that is bucketed by item and sorted by term, so a
question's terms find few pages of each file, all postings of an item are in one task, and scores are added up without
a shuffle; no task holds all of a frequent term. Items fall into blocks of about `RANGE` by the leading bits of a
hash of their id. Beside the postings stand one row for each term and block, with its largest impact, and one for each term,
with its document frequency and largest impact. The empty term holds all items: it gives the segment's size and
mean length without a second reading of the texts.

A search (`top`) is exact. While the question terms have few postings in all (`PRUNE_FROM`), all of them are scored, in one
job without a shuffle of postings. Beyond that frequent terms are mostly passed over:
  1. each question's rarest terms that have k postings between them give k items, whose whole scores are looked up;
     the k-th is a score that the answer must reach;
  2. terms that could not lift an item to that score, even all together, bring no candidates (stop words mostly);
     of the other terms only those blocks do whose largest impact, with all other terms at their largest, reaches it;
  3. candidates whose bound still reaches it are scored by looking up all their terms, and ranked.
Pruning pays while little is left. Where more blocks pass than can be sent to the tasks, the bound is put to each posting in the scan,
which is tighter; where more candidates are left than can be sent, all question terms of the items are scored in one scan.
Postings are never shuffled for a few questions.
Upper bounds are those of the segment's mean length; where the index has a longer mean by now, they grow in proportion.

Batches: `add` writes a new segment and publishes a manifest that names all segments; the manifest is one file, so readers
see a batch wholly or not at all, and a batch that was published before is not added again. Document frequencies, sizes
and lengths are summed over segments, and so scores are those of an index built at once. `compact` merges segments by
shuffling their postings, not the texts. There must be one writer at a time.

Defined results
    null text      has no terms; the item counts in the corpus size
    repeated ids   within a batch are one item for each length; give ids once
    no terms       questions without a known term have no rows
    negative idf   (variant `okapi`, small corpora) bounds take such terms as 0, and they are always looked up
    empty batch    is a segment without files
    no items       no rows
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..operators.channels import DIGITS, EPSILON, _saturated, question_terms, ranked
from .held import HELD_ROWS, fresh_folder, held

RANGE = 256
#: Postings of question terms, counted for each question, from which on a search prunes.
PRUNE_FROM = 1 << 36
#: Items of a bucket at most: what a task adds up is so many scores for each question.
BUCKET_ITEMS = 1 << 13
SLACK = 2 * 10**-DIGITS
#: Terms that are written into a filter of the postings at most; it lets a scan skip pages.
NAMED_TERMS = 32


def counted_ranks(every: DataFrame, some: DataFrame, few: bool) -> DataFrame:
    """(q, item_id, rank) of `some` rows (q, item_id, score) among `every` row of their question, ties in order of the ids.

    Nothing is sorted: each row is compared with the few that are asked for, and counts are added up in the tasks.
    """
    wanted = some.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i")))).alias("wanted"))
    every = every.join(F.broadcast(wanted) if few else wanted, "q").where(-F.col("score") <= F.element_at("wanted", -1)["s"])
    hit = F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))
    behind = F.size(F.filter("wanted", lambda w: w < hit)) + 1  # the first of the wanted that the hit is not behind
    counts = every.select("q", behind.alias("at")).groupBy("q", "at").agg(F.count("*").alias("c"))
    listed = wanted.select("q", F.posexplode("wanted").alias("p", "w")).select("q", (F.col("p") + 1).alias("at"), F.col("w.i").alias("item_id"))
    both = listed.join(counts, ["q", "at"], "full")
    # a hit at place j is at or before each wanted one from j on; a wanted one is itself among them
    rank = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("q").orderBy("at"))
    return both.withColumn("rank", rank).where("item_id is not null").select("q", "item_id", "rank")


@dataclass(frozen=True)
class Segment:
    name: str
    batches: tuple[str, ...]
    n: int
    total: int
    bits: int
    buckets: int

    @property
    def mean(self) -> float:
        return self.total / self.n if self.n else 0.0


def _range(item: Column | str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(item), 64 - bits) if bits else F.lit(0).cast("long")


def _bits(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / RANGE)))


class LexicalIndex:
    """An index below `path`. Open one that is there, or `build` it from items (item_id, text)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._tables = spark, path.rstrip("/"), {}
        self.version, self.segments = self._published()

    # -- storing ----------------------------------------------------------------

    @classmethod
    def build(cls, items: DataFrame, path: str | None = None, batch: str = "0") -> LexicalIndex:
        spark = items.sparkSession
        index = cls(spark, path or fresh_folder(spark, "lexical"))
        index.add(items, batch)
        return index

    def _published(self) -> tuple[int, list[Segment]]:
        try:
            rows = self.spark.read.schema("version long, segments string").option("recursiveFileLookup", "true").json(f"{self.path}/manifests")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []  # nothing was published yet
        last = rows.orderBy(F.desc("version")).first()
        if last is None:
            return 0, []
        return last["version"], [Segment(**(s | {"batches": tuple(s["batches"])})) for s in json.loads(last["segments"])]

    def _publish(self, segments: list[Segment]) -> None:
        """One row in one file: it is there or it is not."""
        text = json.dumps([asdict(s) for s in segments])
        version = self.version + 1
        self.spark.createDataFrame([(version, text)], "version long, segments string").coalesce(1).write.json(f"{self.path}/manifests/{version:08d}")
        self.version, self.segments = version, segments

    def add(self, items: DataFrame, batch: str) -> bool:
        """Adds a batch as a segment. False if that batch is in the index already."""
        if any(batch in s.batches for s in self.segments):
            return False
        n = items.count()
        if not n:
            self._publish([*self.segments, Segment(f"{self.version + 1:08d}", (batch,), 0, 0, 0, 1)])
            return True
        bits = _bits(n)
        buckets = self._buckets(n)
        words = items.select("item_id", "text").repartition(buckets, "item_id").select("item_id", tokens("text").alias("ts"))
        each = words.select("item_id", F.size("ts").alias("length"), F.explode(F.concat(F.array(F.lit("")), "ts")).alias("term"))
        rows = each.groupBy("item_id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        self._publish([*self.segments, self._segment(rows, bits, buckets, (batch,))])
        return True

    def _buckets(self, n: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ITEMS))

    def _segment(self, rows: DataFrame, bits: int, buckets: int, batches: tuple[str, ...]) -> Segment:
        """Writes (item_id, length, term, tf), dealt by item, as a segment."""
        name = f"{self.version + 1:08d}"
        place = f"{self.path}/segments/{name}"
        table = f"palimpsest_{uuid.uuid4().hex}"
        postings = rows.select("term", _range("item_id", bits).alias("block"), "item_id", "tf", "length")
        postings.write.bucketBy(buckets, "item_id").sortBy("term", "block").option("path", f"{place}/postings").saveAsTable(table)
        self._tables[name] = written = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the name only: the files are outside of the warehouse
        size = written.where("term = ''").agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
        segment = Segment(name, batches, size["n"], size["total"] or 0, bits, buckets)
        peak = F.max(_saturated(F.col("tf"), F.col("length"), F.lit(segment.mean or 1.0)))
        blocks = written.where("term <> ''").groupBy("term", "block").agg(F.count("*").alias("n"), peak.alias("peak"))
        blocks.write.mode("overwrite").parquet(f"{place}/blocks")
        terms = self.spark.read.parquet(f"{place}/blocks").groupBy("term").agg(F.sum("n").alias("df"), F.max("peak").alias("peak"))
        terms.write.mode("overwrite").parquet(f"{place}/terms")
        return segment

    def compact(self) -> None:
        """Merges all segments into one; scores stay as they are."""
        rows, buckets = None, self._buckets(self.n)
        for s in self.live:
            p = self._postings(s, None).select("item_id", "length", "term", "tf")
            rows = p if rows is None else rows.unionByName(p)
        if rows is not None and len(self.segments) > 1:
            self._publish([self._segment(rows.repartition(buckets, "item_id"), _bits(self.n), buckets, sum((s.batches for s in self.segments), ()))])

    # -- statistics -------------------------------------------------------------

    @property
    def live(self) -> list[Segment]:
        return [s for s in self.segments if s.n]

    def _none(self, questions: DataFrame, *columns: str) -> DataFrame:
        kinds = {"score": F.lit(0.0), "rank": F.lit(0)}
        return questions.select("q", F.lit(0).cast("long").alias("item_id"), *[kinds[c].alias(c) for c in columns]).limit(0)

    @property
    def n(self) -> int:
        return sum(s.n for s in self.segments)

    @property
    def mean(self) -> float:
        return sum(s.total for s in self.segments) / self.n if self.n else 1.0

    def _part(self, s: Segment, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{s.name}/{name}")

    def _longer(self, s: Segment) -> float:
        """How much an impact can have grown since the segment was written."""
        return max(1.0, self.mean / s.mean) if s.mean else 1.0

    def terms(self) -> DataFrame:
        """(term, df, peak) of all segments."""
        rows = None
        for s in self.live:
            t = self._part(s, "terms").withColumn("peak", F.col("peak") * self._longer(s))
            rows = t if rows is None else rows.unionByName(t)
        return rows if len(self.live) == 1 else rows.groupBy("term").agg(F.sum("df").alias("df"), F.max("peak").alias("peak"))

    def weighted(self, questions: DataFrame, variant: str = "plus1") -> DataFrame:
        """(q, term, df, w, most): the weight of each known question term, and what it can add to a score at most."""
        asked = question_terms(questions).join(self.terms(), "term")
        n, df = F.lit(self.n), F.col("df")
        if variant == "okapi":
            raw = F.log(n - df + 0.5) - F.log(df + 0.5)
            mean_idf = self.terms().agg(F.avg(raw)).first()[0]
            w = F.when(raw < 0, F.lit(EPSILON * (mean_idf or 0.0))).otherwise(raw) * F.col("qtf")
        else:
            w = F.log(1 + (n - df + 0.5) / (df + 0.5))
        asked = asked.withColumn("w", w)
        return asked.select("q", "term", "df", "w", F.greatest(F.lit(0.0), F.col("w") * F.col("peak")).alias("most"))

    # -- reading postings ---------------------------------------------------------

    def _postings(self, s: Segment, only: Column | None) -> DataFrame:
        """The bucketed table of a segment; a reader of another session names it for itself once."""
        if s.name not in self._tables:
            table, place = f"palimpsest_{uuid.uuid4().hex}", f"{self.path}/segments/{s.name}/postings"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(place).schema.fields)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (item_id) SORTED BY (term, block) INTO {s.buckets} BUCKETS LOCATION '{place}'")
            self._tables[s.name] = self.spark.table(table)
            self.spark.sql(f"DROP TABLE {table}")
        rows = self._tables[s.name]
        return rows if only is None else rows.where(only)

    def _filter(self, asked: DataFrame, few: bool) -> Column | None:
        """A filter of the terms within files, where they are few."""
        terms = asked.select("term").distinct().limit(NAMED_TERMS + 1).collect() if few else []
        return F.col("term").isin([r["term"] for r in terms]) if 0 < len(terms) <= NAMED_TERMS else None

    def _impact(self) -> Column:
        return F.col("w") * _saturated(F.col("tf"), F.col("length"), F.lit(self.mean))

    def _hits(self, asked: DataFrame, few: bool, only: Column | None, chosen: dict[str, DataFrame] | None = None) -> DataFrame:
        """(q, item_id, w, most, tf, length) of the postings of asked terms, of `chosen` blocks (q, term, block, ...) if given."""
        out = None
        for s in self.live:
            want = asked if chosen is None else chosen[s.name]
            key = ["term"] if chosen is None else ["term", "block"]
            hit = self._postings(s, only).join(F.broadcast(want) if few else want, key).select("q", "item_id", "w", "most", "tf", "length", *[c for c in ("all", "least") if c in want.columns])
            out = hit if out is None else out.unionByName(hit)
        return out

    def all_scores(self, questions: DataFrame, variant: str = "plus1") -> DataFrame:
        """(q, item_id, score) of every item that has a question term. Reads the index, never the texts."""
        if not self.live:
            return self._none(questions, "score")
        asked, few = held(self.weighted(questions, variant))
        return self._all(asked, few)

    def _all(self, asked: DataFrame, few: bool) -> DataFrame:
        return self._summed(self._hits(asked, few, self._filter(asked, few)))

    def scores(self, pairs: DataFrame, questions: DataFrame, variant: str = "plus1") -> DataFrame:
        """(q, item_id, score) of those pairs (q, item_id) that have a term in common, by looking up their blocks."""
        if not self.live:
            return self._none(questions, "score")
        asked, few = held(self.weighted(questions, variant))
        return self._exact(*held(pairs.select("q", "item_id")), asked, self._filter(asked, few))

    def _exact(self, pairs: DataFrame, few: bool, asked: DataFrame, only: Column | None) -> DataFrame:
        """Whole scores of pairs, by looking up their (term, item). Pairs that are sent meet the postings of the questions in one scan;
        more of them meet the scores of all items, which are fewer rows than the postings."""
        if self._sent(asked):
            rows = self._hits(asked, True, only)
            if few:
                return self._summed(rows.join(F.broadcast(pairs), ["q", "item_id"], "left_semi"))
            return self._summed(rows).join(pairs, ["q", "item_id"], "left_semi")
        out = None
        want = pairs.join(F.broadcast(asked) if few else asked, "q").select("q", "item_id", "term", "w")
        for s in self.live:
            found = self._postings(s, only).join(want, ["term", "item_id"]).select("q", "item_id", "w", "tf", "length")
            out = found if out is None else out.unionByName(found)
        return self._summed(out)

    def _summed(self, hits: DataFrame) -> DataFrame:
        return hits.groupBy("q", "item_id").agg(F.round(F.sum(self._impact()), DIGITS).alias("score"))

    def _sent(self, asked: DataFrame) -> bool:
        """Whether rows that were computed once are few enough to be sent."""
        return asked.limit(HELD_ROWS + 1).count() <= HELD_ROWS

    def _plain(self, asked: DataFrame, few: bool) -> bool:
        """Whether the postings of the questions are few enough to score all of them."""
        return few and (asked.agg(F.sum("df")).first()[0] or 0) < PRUNE_FROM

    def few_scores(self, questions: DataFrame, variant: str = "plus1") -> DataFrame | None:
        """`all_scores`, written once, if the questions have few postings; None if they have many."""
        if not self.live:
            return self.all_scores(questions, variant)
        asked, few = held(self.weighted(questions, variant))
        if not self._plain(asked, few):
            return None
        path = fresh_folder(self.spark, "scores")
        self._all(asked, few).write.parquet(path)
        return self.spark.read.parquet(path)

    # -- searching ----------------------------------------------------------------

    def top(self, questions: DataFrame, k: int, variant: str = "plus1", prune: bool | None = None) -> DataFrame:
        """(q, item_id, score, rank): the k best items of each question (q, question), ties in order of their ids.

        Whether to prune is decided by the number of postings, unless `prune` says so; the result is the same.
        """
        if not self.live:
            return self._none(questions, "score", "rank")
        asked, few = held(self.weighted(questions, variant))
        if not (prune if prune is not None else not self._plain(asked, few)):
            return ranked(self._all(asked, few), k=k)
        only = self._filter(asked, few)
        by_q = Window.partitionBy("q")
        # 1: items of the rarest terms, and the score that they show to be reached
        before = F.coalesce(F.sum("df").over(by_q.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = asked.withColumn("before", before).where(F.col("before") < k).drop("before")
        first = self._hits(seeds, few, only).groupBy("q", "item_id").agg(F.sum(self._impact()).alias("score"))
        first = self._exact(*held(ranked(first, k=k).select("q", "item_id")), asked, only)
        reached = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
        reached, small = held(reached)
        # 2: terms that can lift an item to it, and their blocks
        upto = F.sum("most").over(by_q.orderBy("most", "term"))
        bounds = asked.join(F.broadcast(reached) if small else reached, "q", "left").withColumn("least", F.coalesce("reached", F.lit(float("-inf"))) - SLACK)
        bounds = bounds.withColumns({"upto": upto, "all": F.sum("most").over(by_q)}).where((F.col("upto") >= F.col("least")) | (F.col("w") < 0))
        bounds, few_bounds = held(bounds.select("q", "term", "w", "most", "all", "least"))
        chosen, few_blocks = {}, few_bounds
        for s in self.live:
            near = self._part(s, "blocks").join(F.broadcast(bounds) if few_bounds else bounds, "term")
            near = near.where(F.col("all") - F.col("most") + F.greatest(F.lit(0.0), F.col("w") * F.col("peak") * self._longer(s)) >= F.col("least"))
            chosen[s.name], ok = held(near.select("q", "term", "block", "w", "most"))
            few_blocks &= ok
        if few_bounds and not few_blocks:  # the bound of each posting: one that an item of the answer has reaches it
            near = self._hits(bounds, True, only).where(F.col("all") - F.col("most") + F.greatest(F.lit(0.0), self._impact()) >= F.col("least"))
        else:
            near = self._hits(asked, few_blocks, only, chosen)
        partial = near.groupBy("q", "item_id").agg(F.sum(self._impact()).alias("part"), F.sum("most").alias("seen"))
        limits = bounds.select("q", "all", "least").distinct()
        partial = partial.join(F.broadcast(limits) if few_bounds else limits, "q").where(F.col("part") + F.col("all") - F.col("seen") >= F.col("least"))
        # 3: whole scores
        partial, few_items = held(partial.select("q", "item_id"))
        return ranked(self._exact(partial, few_items, asked, only) if few_items or not few else self._all(asked, few), k=k)

    def blocks_read(self, questions: DataFrame, k: int, variant: str = "plus1") -> tuple[int, int]:
        """How many blocks bring candidates in `top`, and how many the question terms have."""
        asked, _ = held(self.weighted(questions, variant))
        best = self.top(questions, k, variant).groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
        by_q = Window.partitionBy("q")
        bounds = asked.join(best, "q", "left").withColumn("least", F.coalesce("reached", F.lit(float("-inf"))) - SLACK)
        bounds = bounds.withColumns({"upto": F.sum("most").over(by_q.orderBy("most", "term")), "all": F.sum("most").over(by_q)})
        read = every = 0
        for s in self.live:
            near = self._part(s, "blocks").join(bounds, "term")
            hot = (F.col("upto") >= F.col("least")) & (F.col("all") - F.col("most") + F.col("w") * F.col("peak") * self._longer(s) >= F.col("least"))
            row = near.agg(F.count_if(hot).alias("read"), F.count("*").alias("every")).first()
            read, every = read + row["read"], every + row["every"]
        return read, every

    def ranks(self, pairs: DataFrame, questions: DataFrame, variant: str = "plus1") -> DataFrame:
        """(q, item_id, rank) of those pairs that have a term in common: how many items of the question score higher, and one.

        Ranks are counted, not sorted: each hit is compared with the few scores that are asked for, and the counts
        are added up in the tasks, so that no task holds all hits of a question.
        """
        if not self.live:
            return self._none(questions, "rank")
        asked, few = held(self.weighted(questions, variant).join(pairs.select("q").distinct(), "q", "left_semi"))
        scored, small = held(self._exact(*held(pairs.select("q", "item_id")), asked, self._filter(asked, few)))
        return counted_ranks(self._all(asked, few), scored, small)
