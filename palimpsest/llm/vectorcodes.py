"""Vector code compression: product quantisation in exact integers, with a ball tree over the entries of each part.

Components become floor(1024 * x). A vector is cut into equal parts; each part position has a codebook of at most
256 entries, which starts as the parts of the smallest ids and is improved in rounds: every part goes to its
nearest entry, then each entry becomes the floored mean of its parts. Rows are read from the input in every round
and never written; a task sums its parts by entry, so that a round brings `parts * entries` rows to the driver,
whatever the number of vectors, and sends as many back.

Nearest entries are found by metric branch and bound. The entries of a part are a binary ball tree: a node has an
integer centre and a radius that is rounded up; leaves hold at most `LEAF` entries. A batch of parts first descends
to the leaf of the nearer centres, which gives each a distance to beat, then visits every ball that can hold an entry
as near as that: the bound is non-strict and distances to centres are rounded down, both by `SLACK` of their size, so that
an equally near entry of a lower index is never passed over. Entries in visited leaves are compared by their exact squared distances.

Arithmetic is exact: squared distances are computed in doubles while they stay below 2^53, else in 64-bit integers.

Defined results
    null vector      is dropped, as are vectors with null or non-finite components
    other lengths    than that of the kept row with the smallest id, and lengths that don't part equally, are dropped
    few rows         fewer than 256 rows give as many entries
    ties             of distances go to the lower entry; equal entries may be left unused and then stay
    repeated ids     are rows of their own, in order of their vectors; a null id comes last
    null label       rows without a label are one group
    huge components  whose squared distances don't fit 64 bits are an error, as overflow is in Spark's ANSI mode
    empty table      no rows
    extra columns    are not read
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table, trimmed

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LEAF = 16
#: Roots of exact squares are wrong by less than this share of their size.
SLACK = 1e-12
#: Bytes of label sums that are sent to the tasks at most; beyond that Spark shuffles.
SENT_BYTES = 32 << 20


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances, exactly: in doubles where no sum reaches 2^53, else in 64-bit integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * points.shape[1] * most * most
    if bound >= 1 << 63:
        raise OverflowError(f"squared distances between components of up to {most} do not fit 64 bits")
    kind = np.float64 if bound < 1 << 53 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)


@dataclass
class Ball:
    node: int
    left: Ball | None = None
    right: Ball | None = None
    entries: np.ndarray | None = None  # indices in a leaf, ascending


class BallTree:
    """The entries of one part, for exact nearest neighbours with ties to the lower index."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        centres, radii = [], []
        self.root = self._ball(np.arange(len(entries)), centres, radii)
        self.centres, self.radii = np.array(centres), np.array(radii)

    def _ball(self, members: np.ndarray, centres: list, radii: list) -> Ball:
        rows = self.entries[members]
        ball = Ball(len(centres))
        centre = rows.sum(0) // len(rows)
        centres.append(centre)
        radii.append(float(np.sqrt(squared(rows, centre[None]).astype(np.float64).max())) * (1 + SLACK))
        widest = int(np.argmax(rows.max(0) - rows.min(0)))
        if len(members) <= self.leaf:
            ball.entries = members
        else:
            order = members[np.argsort(rows[:, widest], kind="stable")]
            half = len(order) // 2
            ball.left, ball.right = (self._ball(np.sort(side), centres, radii) for side in (order[:half], order[half:]))
        return ball

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each point, its squared distance, and how many entries were compared in all."""
        n = len(points)
        best, found = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        home = np.full(n, -1)
        apart = np.sqrt(squared(points, self.centres).astype(np.float64))  # to the centre of each ball
        least = apart * (1 - SLACK) - self.radii - SLACK * (apart + self.radii)  # no entry of the ball is nearer
        compared = 0

        def leaf(ball: Ball, rows: np.ndarray) -> None:
            nonlocal compared
            compared += len(rows) * len(ball.entries)
            away = squared(points[rows], self.entries[ball.entries])
            first = away.argmin(1)
            away, entry = away[np.arange(len(rows)), first].astype(np.int64), ball.entries[first]
            better = (away < best[rows]) | ((away == best[rows]) & (entry < found[rows]))
            best[rows[better]], found[rows[better]] = away[better], entry[better]

        def descend(ball: Ball, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if ball.entries is not None:
                home[rows] = ball.node
                return leaf(ball, rows)
            right = apart[rows, ball.right.node] < apart[rows, ball.left.node]
            descend(ball.left, rows[~right])
            descend(ball.right, rows[right])

        def visit(ball: Ball, rows: np.ndarray) -> None:
            rows = rows[least[rows, ball.node] <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)]
            if ball.entries is not None:
                rows = rows[home[rows] != ball.node]  # the others have been there
                if len(rows):
                    leaf(ball, rows)
            elif len(rows):
                visit(ball.left, rows)
                visit(ball.right, rows)

        descend(self.root, np.arange(n))
        visit(self.root, np.arange(n))
        return found, best, compared


def _integers(lists: pa.Array, length: int | None) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """Places of the kept vectors of a batch and their integer components: one array if all have `length`."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    flat = lists.flatten()
    value = np.asarray(pc.fill_null(flat, np.nan), np.float64)
    if length is not None and (sizes == length).all():
        rows = value.reshape(len(sizes), length)
        fine = np.isfinite(rows).all(1)
        return np.flatnonzero(fine), _floored(rows[fine])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    rows = [value[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    kept = [k for k, row in enumerate(rows) if len(row) and np.isfinite(row).all() and length in (None, len(row))]
    ints = [_floored(rows[k]) for k in kept]
    return np.array(kept, np.int64), ints if length is None else np.array(ints, np.int64).reshape(len(ints), length)


def _floored(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values * SCALE)
    if (np.abs(scaled) >= 1 << 62).any():
        raise OverflowError("a component does not fit 64 bits")
    return scaled.astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector) of the kept rows in integers."""
    for batch in batches:
        at, ints = _integers(batch.column(1), None)
        vectors = pa.array([x.tolist() for x in ints], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), vectors], ["vec_id", "vector"])


def _summed(shared, length: int):
    """(part, entry, n, sums) of a task: how many parts are nearest to each entry, and their sums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        width = length // len(trees)
        n = np.zeros((len(trees), len(trees[0].entries)), np.int64)
        sums = np.zeros((*n.shape, width), np.int64)
        for batch in batches:
            _, rows = _integers(batch.column(0), length)
            for p, tree in enumerate(trees):
                part = rows[:, p * width : (p + 1) * width]
                entry, _, _ = tree.nearest(part)
                n[p] += np.bincount(entry, minlength=n.shape[1])
                np.add.at(sums[p], entry, part)
        part, entry = np.nonzero(n)
        lists = pa.array(list(sums[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), lists], ["part", "entry", "n", "sums"])

    return scan


def _coded(shared, length: int):
    """(vec_id, label, code, error) of the kept rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        width = length // len(trees)
        for batch in batches:
            at, rows = _integers(batch.column(1), length)
            near = [tree.nearest(rows[:, p * width : (p + 1) * width]) for p, tree in enumerate(trees)]
            codes = np.stack([found for found, _, _ in near], 1).astype(np.uint8)
            error = sum(away for _, away, _ in near)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return scan


def _doubles(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


def first_entries(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding") -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the `entries` smallest kept ids. No rows give no codebooks."""
    doubles = _doubles(rows, id_col, vector_col)
    whole = doubles.where(F.size("vector") % parts == 0).mapInArrow(_whole, T.StructType([doubles.schema["vec_id"], T.StructField("vector", T.ArrayType(T.LongType()))]))
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    first = whole.orderBy(*order).limit(entries).collect()
    if first and len({len(r["vector"]) for r in first}) > 1:
        first = whole.where(F.size("vector") == len(first[0]["vector"])).orderBy(*order).limit(entries).collect()
    if not first:
        return []
    return np.split(np.array([r["vector"] for r in first], np.int64), parts, axis=1)


def improved(rows: DataFrame, books: list[np.ndarray], *, id_col: str = "vec_id", vector_col: str = "embedding") -> list[np.ndarray]:
    """The codebooks after one round over all rows: each used entry becomes the floored mean of its parts."""
    width = books[0].shape[1]
    shared = rows.sparkSession.sparkContext.broadcast([BallTree(b) for b in books])
    sums = _doubles(rows, id_col, vector_col).select("vector").mapInArrow(trimmed(_summed(shared, width * len(books))), "part int, entry int, n long, sums array<long>")
    totals = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums"))
    out = [b.copy() for b in books]
    for r in totals.toLocalIterator():  # as many rows as the codebooks have entries
        out[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    shared.destroy()
    return out


def trained(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **columns) -> list[np.ndarray]:
    """One codebook for each part position: (entries, components) in integers."""
    books = first_entries(rows, parts=parts, entries=entries, **columns)
    for _ in range(rounds if books else 0):
        books = improved(rows, books, **columns)
    return books


def encoded(rows: DataFrame, books: list[np.ndarray], *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of the kept rows: the nearest entries, two hex digits each, and the summed squared distances."""
    rows = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast([BallTree(b) for b in books])
    return rows.mapInArrow(trimmed(_coded(shared, sum(b.shape[1] for b in books))), schema)


def decoded(codes: DataFrame, books: list[np.ndarray], *, code_col: str = "code") -> DataFrame:
    """`codes` with `approximation`: the components that the entries of a code stand for."""
    if not books:
        return codes.withColumn("approximation", F.lit(None).cast("array<double>"))
    parts = []
    for p, book in enumerate(books):
        rows = F.lit([[float(x) / SCALE for x in entry] for entry in book.tolist()])
        parts.append(F.get(rows, F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")))
    return codes.withColumn("approximation", F.concat(*parts))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def label_errors(coded: DataFrame, *, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """`coded` with `label_error`: the error summed over equal labels, nulls together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    size = sums.agg(F.sum(F.lit(64) + F.coalesce(F.octet_length(F.col("label").cast("string")), F.lit(0)))).first()[0] or 0
    sums = (F.broadcast(sums) if size <= sent_bytes else sums).alias("s")
    return coded.alias("c").join(sums, F.col("c.label").eqNullSafe(F.col("s.label"))).select("c.*", "s.label_error")


def compressed(rows: DataFrame, **options) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the kept rows, by codebooks trained on all of them."""
    scratch = Scratch(rows.sparkSession, "vectors")
    columns = {k: options[k] for k in ("id_col", "vector_col") if k in options}
    books = trained(rows, **{k: v for k, v in options.items() if k != "label_col"})
    coded = scratch.write(encoded(rows, books, **columns, **({"label_col": options["label_col"]} if "label_col" in options else {})), "codes")
    return label_errors(coded).withColumn("codebooks_sha256", F.lit(digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """All distances of every round, by SQL."""
    near = """a{r} AS MATERIALIZED (
    SELECT vec_id, part, d, e FROM (
        SELECT p.vec_id, p.part, c.e, (list_dot_product(p.s, p.s) - 2 * list_dot_product(p.s, c.s) + list_dot_product(c.s, c.s))::BIGINT AS d FROM p JOIN c{r} c USING (part)
    ) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1
)"""
    better = """m{r} AS (
    SELECT part, e, list(floor(total / n) ORDER BY pos) AS s FROM (
        SELECT part, e, pos, sum(x) AS total, count(*) AS n FROM (SELECT a.part, a.e, unnest(p.s) AS x, unnest(range(len(p.s))) AS pos FROM a{r} a JOIN p USING (vec_id, part)) GROUP BY part, e, pos
    ) GROUP BY part, e
), c{next} AS MATERIALIZED (
    SELECT c.part, c.e, coalesce(m.s, c.s) AS s FROM c{r} c LEFT JOIN m{r} m USING (part, e)
)"""
    steps = []
    for r in range(ROUNDS):
        steps += [near.format(r=r), better.format(r=r, next=r + 1)]
    steps.append(near.format(r=ROUNDS))
    last = f"a{ROUNDS}"
    return f"""
WITH k AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT vec_id, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS s FROM (SELECT vec_id, v, unnest(range({PARTS})) AS part FROM k)
), c0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, s FROM p QUALIFY e < {ENTRIES}
), {', '.join(steps)}, one AS (
    SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY vec_id
), hash AS (
    SELECT sha256(string_agg(array_to_string(list_transform(s, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT o.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.codebooks_sha256
FROM one o JOIN k USING (vec_id) CROSS JOIN hash h
"""


OP12_SQL = _sql()
