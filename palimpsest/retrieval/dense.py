"""A vector index in a folder: vectors in cells round centres, searched exactly by a bound on what a cell can hold.

Centres come from a bounded sample (`SAMPLE` rows by a hash of their ids); every vector is put in the cell of its nearest
centre, and a cell's radius is the largest distance of its members. The product of a question's vector v with a member is
at most v . centre + |v| * radius. A search first reads the cells of the largest v . centre that have k members
between them; the k-th product found is one that the answer must reach, and only cells whose bound reaches it are
read afterwards. Cells are folders, so those that are passed over are not read at all; `read` counts both kinds.
Question vectors are sent in blocks of `VECTOR_BLOCK`, one block at a time, and a task keeps k rows for each question.

Without encoder models at hand, `hashed` makes vectors of texts: each distinct token adds its damped count at a place and
with a sign that its hash says, and the vector is brought to length 1.

Defined results
    null vectors   are not indexed, and questions without a vector have no rows
    scores         are rounded to 6 digits; only positive ones are hits; ties go in order of the ids
    equal vectors  are members of one cell; a hot cell is spread over files
    no items       no rows
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..operators.channels import DIGITS, VECTOR_BLOCK, ranked
from .held import fresh_folder, held

SAMPLE = 4096
MOST_CELLS = 1024
FILE_ROWS = 1 << 20
SLACK = 2 * 10**-DIGITS
DIMENSIONS = 256


def hashed(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """The hashing encoder: text → array<double> of length 1, or null for a text without tokens."""

    def encode(parts):
        for codes in parts:
            out = []
            for row in codes:
                row = np.asarray(row if row is not None else [], np.int64)
                ids, counts = np.unique(row, return_counts=True)
                v = np.zeros(dimensions)
                np.add.at(v, (ids & 0x7FFFFFFF) % dimensions, np.where(ids < 0, -1.0, 1.0) * (1 + np.log(counts)))
                size = np.linalg.norm(v)
                out.append((v / size).tolist() if size else None)
            yield pa.array(out, pa.list_(pa.float64()))

    encode.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<double>")(F.transform(tokens(text), lambda t: F.xxhash64(t)))


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def _centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres of the sample, beginning with evenly spaced rows of it."""
    centres = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(rounds):
        near = ((sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(0)
    return centres


def _placed(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(1))
            cell = ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)
            away = np.linalg.norm(rows - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["item_id", "vector", "cell", "away"])

    return scan


class _Best:
    """The k best (score, id) of each question within a task, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if q in self.of:
            scores, ids = np.concatenate((self.of[q][0], scores)), np.concatenate((self.of[q][1], ids))
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = np.flatnonzero(scores >= edge)
            best = near[np.lexsort((ids[near], -scores[near]))[: self.k]]
            scores, ids = scores[best], ids[best]
        self.of[q] = scores, ids


def _searched(shared, k: int, kind: pa.DataType):
    """(at, item_id, score): the k best of the task for each question, which reads the cells that are its own only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, readers = shared.value
        best = _Best(k)
        for batch in batches:
            cells = np.asarray(batch.column(2))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = _matrix(batch.column(1)) if batch.num_rows else None
            for cell in np.unique(cells):
                here = np.flatnonzero(cells == cell)
                asking = readers[int(cell)]
                products = np.round(matrix[asking] @ rows[here].T, DIGITS) + 0.0
                for q, row in zip(asking, products, strict=True):
                    hit = np.flatnonzero(row > 0)
                    if len(hit):
                        best.offer(int(q), row[hit], ids[here[hit]])
        for q, (scores, ids) in best.of.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int64)), pa.array(ids, kind), pa.array(scores)], ["at", "item_id", "score"])

    return scan


def _counted(shared):
    """(at, place, n): how many rows of the task a question's list of wanted (score, id) rows has from each place on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, wanted = shared.value
        counts = [np.zeros(len(w[0]) + 1, np.int64) for w in wanted]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            products = np.round(matrix @ _matrix(batch.column(1)).T, DIGITS) + 0.0
            for at, (row, (scores, names)) in enumerate(zip(products, wanted, strict=True)):
                near = np.flatnonzero(row >= scores[-1])  # scores fall
                first = np.searchsorted(-scores, -row[near], side="left")  # the first wanted one that does not score higher
                for place, item in zip(first, near, strict=True):
                    while place < len(scores) and scores[place] == row[item] and names[place] < ids[item]:
                        place += 1
                    counts[at][place] += 1
        at, place, n = [], [], []
        for q, c in enumerate(counts):
            some = np.flatnonzero(c[:-1])
            at += [q] * len(some)
            place += some.tolist()
            n += c[some].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64())], ["at", "place", "n"])

    return scan


class VectorIndex:
    """Vectors below `path`, in cells. `read` says how many cells the searches so far read, of how many they could have."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/vectors")
        meta = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows
        self.cells = [r["cell"] for r in meta]
        self.sizes = np.array([r["n"] for r in meta])
        self.centres = np.array([r["centre"] for r in meta], np.float64)
        self.radii = np.array([r["radius"] for r in meta], np.float64)
        self.read = [0, 0]

    @classmethod
    def build(cls, items: DataFrame, path: str | None = None, cells: int | None = None) -> VectorIndex:
        """From (item_id, vector)."""
        spark = items.sparkSession
        path = path or fresh_folder(spark, "vectors")
        rows = items.where("vector is not null").select("item_id", F.col("vector").cast("array<double>").alias("vector"))
        n = rows.count()
        sample = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).collect()], np.float64)
        cells = min(MOST_CELLS, max(1, cells or int(n**0.5)), max(1, len(sample)))
        centres = _centres(sample, cells) if n else np.zeros((1, 1))
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
        placed = rows.mapInArrow(_placed(spark.sparkContext.broadcast(centres)), schema)
        files = max(1, n // FILE_ROWS)
        placed.withColumn("_f", F.pmod(F.xxhash64("item_id"), F.lit(files))).repartition("cell", "_f").drop("_f").write.partitionBy("cell").parquet(f"{path}/vectors")
        known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        sizes = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        sizes.join(F.broadcast(known), "cell").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def _blocks(self, questions: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
        names, held_ = [], []
        for r in questions.where("vector is not null").select("q", F.col("vector").cast("array<double>").alias("vector")).toLocalIterator():
            names.append(r["q"])
            held_.append(r["vector"])
            if len(names) == VECTOR_BLOCK:
                yield names, np.array(held_, np.float64)
                names, held_ = [], []
        if names:
            yield names, np.array(held_, np.float64)

    def _pass(self, matrix: np.ndarray, visits: np.ndarray, k: int) -> DataFrame:
        """(at, item_id, score) of the visited cells (questions by cells)."""
        used = np.flatnonzero(visits.any(0))
        readers = {self.cells[c]: np.flatnonzero(visits[:, c]) for c in used}
        self.read[0] += len(used)
        kind = self.rows.schema["item_id"]
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.dataType.simpleString()]
        some = self.rows.where(F.col("cell").isin(list(readers))).select("item_id", "vector", "cell")
        shared = self.spark.sparkContext.broadcast((matrix, readers))
        found = some.mapInArrow(_searched(shared, k, arrow), T.StructType([T.StructField("at", T.LongType()), kind, T.StructField("score", T.DoubleType())]))
        found, _ = held(found.withColumn("_r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "item_id"))).where(F.col("_r") <= k).drop("_r"))
        shared.destroy()
        return found

    def top(self, questions: DataFrame, k: int) -> DataFrame:
        """(q, item_id, score, rank): the k best positive products of each question (q, vector)."""
        q_field = questions.schema["q"]
        out = None
        for names, matrix in self._blocks(questions):
            if not self.cells:
                break
            self.read[1] += len(self.cells)
            to_centre = matrix @ self.centres.T
            most = to_centre + np.linalg.norm(matrix, axis=1)[:, None] * self.radii
            order = np.argsort(-to_centre, axis=1)
            before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
            first = np.zeros_like(to_centre, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            found = self._pass(matrix, first, k)
            reached = {r["at"]: r["s"] for r in found.groupBy("at").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()}  # a row a question of the block
            least = np.array([reached.get(at, 0.0) for at in range(len(names))])
            rest = ~first & (most >= least[:, None] - SLACK)
            if rest.any():
                found = found.unionByName(self._pass(matrix, rest, k))
            named = self.spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("at", T.LongType()), q_field]))
            found = found.join(F.broadcast(named), "at").select("q", "item_id", "score")  # at most VECTOR_BLOCK rows
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.spark.createDataFrame([], T.StructType([q_field, self.rows.schema["item_id"], T.StructField("score", T.DoubleType())]))
        return ranked(out, k=k)

    def scores(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return pair_scores(self.rows, pairs, questions)

    def ranks(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return pair_ranks(self.rows, pairs, questions)


def pair_scores(rows: DataFrame, pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, item_id, score) of those pairs whose product is positive, from rows (item_id, vector) and questions (q, vector)."""
    pairs, few = held(pairs.select("q", "item_id"))
    mine = pairs.join(questions.select("q", F.col("vector").cast("array<double>").alias("asked")), "q").where("asked is not null")
    found = rows.select("item_id", "vector").where("vector is not null").join(F.broadcast(mine) if few else mine, "item_id")
    product = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return found.select("q", "item_id", F.round(product, DIGITS).alias("score")).where("score > 0")


def pair_ranks(rows: DataFrame, pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, item_id, rank) of those pairs whose product is positive, by counting what scores higher: nothing is sorted."""
    spark = rows.sparkSession
    wanted = pair_scores(rows, pairs, questions).groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i")))).alias("w"))
    both, _ = held(wanted.join(questions.select("q", "vector"), "q"))
    vectors = rows.where("vector is not null").select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("place", T.LongType()), questions.schema["q"], rows.schema["item_id"]])

    def one(block: list) -> DataFrame:
        lists = [(-np.array([x["s"] for x in r["w"]]), [x["i"] for x in r["w"]]) for r in block]
        shared = spark.sparkContext.broadcast((np.array([r["vector"] for r in block], np.float64), lists))
        counts = vectors.mapInArrow(_counted(shared), "at long, place long, n long").groupBy("at", "place").agg(F.sum("n").alias("n"))
        named = spark.createDataFrame([(at, p, block[at]["q"], i) for at, (_, ids) in enumerate(lists) for p, i in enumerate(ids)], schema)
        rank = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("at").orderBy("place"))
        found, _ = held(named.join(counts, ["at", "place"], "left").withColumn("rank", rank).select("q", "item_id", "rank"))
        shared.destroy()
        return found

    out, block = None, []
    for r in both.toLocalIterator():
        block.append(r)
        if len(block) == VECTOR_BLOCK:
            out = one(block) if out is None else out.unionByName(one(block))
            block = []
    if block:
        out = one(block) if out is None else out.unionByName(one(block))
    return out if out is not None else pairs.select("q", "item_id", F.lit(0).cast("long").alias("rank")).limit(0)
