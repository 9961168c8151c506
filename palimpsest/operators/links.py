"""Exact links between token sets, and what hangs together by links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..retrieval.held import fresh_folder, held

#: What a product of floats may lose before it is compared with a whole number.
SLACK = 1e-9
#: The logarithms of the fewest and of the most parities of a set: at most 4 kB.
LEAST_BITS, MOST_BITS = 6, 15
#: Sets that one cell holds and the bytes of their parities, pairs that a task compares at once, and in all at most, as far as MOST_TASKS allow.
CELL = 1 << 15
CELL_BYTES = 16 << 20
MET_AT_ONCE = 1 << 17
TASK_MEETINGS = 1 << 27
MOST_TASKS = 4096


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, whatever is lost later."""
    path = fresh_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def jaccard_of(shared: Column, left: Column, right: Column) -> Column:
    return shared / (left + right - shared)


def codes_of(tokens: Column) -> Column:
    """64-bit hashes that stand for tokens."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _bits(size: int, least: float) -> int:
    """Parities of a set of this class of sizes: two to a token of the largest one, as far as they are bounded."""
    most = size if least >= 1 else math.exp(min(32.0, (size + 1) * _step(least)))
    return 1 << min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(2 * most))))


def _step(least: float) -> float:
    """The logarithm of the width of a class: similar sets are of one class or of two neighbouring ones."""
    return -1.01 * math.log(least)


def _sketches(keep: list[str], least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, n, size, sketch = [], [], [], []
            lists = batch.column("codes")
            flat, ends = lists.values.to_numpy(), lists.offsets.to_pylist()
            for at, to in zip(ends, ends[1:], strict=False):
                own = np.unique(flat[at:to])
                digest.append(sha256(own.tobytes()).digest())
                n.append(len(own))
                size.append(-1 if not len(own) else len(own) if least >= 1 else int(math.log(len(own)) / _step(least)))
                bits = _bits(size[-1], least) if len(own) else 0
                odd = np.bincount(own & (bits - 1), minlength=bits).astype(np.uint8) & 1 if bits else np.zeros(0, np.uint8)
                sketch.append(np.packbits(odd, bitorder="little").tobytes())
            made = [pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(size, pa.int32()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "digest", "n", "size", "sketch"])

    return scan


def sketched(rows: DataFrame, least: float) -> DataFrame:
    """The rows with `digest`, `n`, `size` and `sketch` of the set of their `codes`: its SHA-256, number, class of sizes, and parities.

    A parity tells whether the codes with some value of their lowest bits are odd in number. Two sets differ in as many codes
    as in parities, or more. Empty sets have class -1 and no parities.
    """
    kept = [f for f in rows.schema.fields if f.name != "codes"]
    added = T.StructType.fromDDL("digest binary, n int, size int, sketch binary")
    return rows.mapInArrow(_sketches([f.name for f in kept], least), T.StructType(kept + added.fields))


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which no key changes."""
    changed = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        column = batch.column(k)
        changed |= pc.not_equal(column.slice(1), column.slice(0, max(0, batch.num_rows - 1))).to_numpy(zero_copy_only=False).astype(bool)
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    for at, to in zip(edges, edges[1:], strict=False):
        if to > at:
            yield batch.slice(at, to - at)


def _parts_of(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes and parities by row."""
    words = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint64)
    return run.column("id").to_numpy(), run.column("n").to_numpy().astype(np.float64), words.reshape(run.num_rows, -1)


def _folded(words: np.ndarray, to: int) -> np.ndarray:
    while words.shape[1] > to:
        words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
    return words


def _meeting(by: str, least: float):
    """(a, b) of rows sorted by cell and `role`: the sets that a cell holds come first, then those that meet them, as a stream."""
    apart = (1 - least) / (1 + least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for run in _runs(batch, [by, "cell", "part", "role"]):
                here = tuple(run.column(c)[0].as_py() for c in (by, "cell", "part"))
                if here != cell:
                    cell, held = here, []
                role = run.column("role")[0].as_py()
                if role == 0:
                    held.append(_parts_of(run))
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [tuple(map(np.concatenate, zip(*held, strict=True)))]
                ids, sizes, words = held[0]
                own, n, mine = _parts_of(run)
                width = min(words.shape[1], mine.shape[1])
                there, mine = np.ascontiguousarray(_folded(words, width).T), _folded(mine, width)
                step = max(1, MET_AT_ONCE // len(ids))
                for at in range(0, len(own), step):
                    some = mine[at : at + step]
                    differ = np.zeros((len(some), len(ids)), np.uint16)
                    for k in range(width):
                        differ += np.bitwise_count(some[:, k, None] ^ there[k])
                    less, more = np.minimum(n[at : at + step, None], sizes), np.maximum(n[at : at + step, None], sizes)
                    near = (differ <= apart * (less + more) + SLACK) & (less >= more * least - SLACK)
                    if role == 1:
                        near &= own[at : at + step, None] < ids
                    row, place = np.nonzero(near)
                    if len(row):
                        a, b = own[at + row], ids[place]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return scan


def near_sketches(sets: DataFrame, least: float, by: str) -> DataFrame:
    """(a, b), a < b: the pairs of sets under one value of `by` whose sizes and parities allow the similarity; sets: (by, id, n, size, sketch).

    Sets of a class of sizes are dealt over cells of about CELL sets, or fewer large ones. Each set goes once to the cell that holds it, and to all
    cells of its class and of the next one, where it meets what is held. So no pair leaves a task before it has passed, what
    is shuffled are sketches, and a task holds one cell, however many rows an owner has.
    """
    sets = sets.where("n > 0").select(by, "id", "n", "size", "sketch")
    count = sets.groupBy(by, F.col("size").alias("cell")).agg(F.count("*").alias("c"), F.max(F.length("sketch")).alias("width"))
    cells = F.ceil(F.col("c") / F.least(F.lit(CELL), CELL_BYTES / F.col("width")))
    count, few = held(count.where(F.col(by).isNotNull()).select(by, "cell", "c", cells.alias("cells")))
    below = count.select(by, (F.col("cell") + 1).alias("cell"), F.col("c").alias("l"))
    meetings = count.join(below, [by, "cell"], "left").agg(F.sum(F.col("c") * (F.col("c") + F.coalesce("l", F.lit(0))))).first()[0] or 0
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-meetings // TASK_MEETINGS)))
    sizes = (F.broadcast if few else lambda rows: rows)(count.select(by, "cell", "cells"))
    own = ["id", "n", "sketch"]
    holding = sets.select(by, F.col("size").alias("cell"), *own).join(sizes, [by, "cell"])
    holding = holding.select(by, "cell", F.pmod(F.xxhash64("id"), "cells").cast("int").alias("part"), F.lit(0).alias("role"), *own)
    going = sets.select(by, "size", F.explode(F.array("size", F.col("size") + 1)).alias("cell"), *own).join(sizes, [by, "cell"])
    role = F.when(F.col("cell") == F.col("size"), 1).otherwise(2).alias("role")
    going = going.select(by, "cell", F.explode(F.sequence(F.lit(0), F.col("cells").cast("int") - 1)).alias("part"), role, *own)
    rows = holding.unionByName(going).repartition(parts, by, "cell", "part").sortWithinPartitions(by, "cell", "part", "role")
    return rows.mapInArrow(_meeting(by, least), "a long, b long")


def similar_pairs(met: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs of `met` whose whole sets are so alike; whole: (id, codes), codes distinct, one row for each id."""
    both = met.join(whole.toDF("a", "ta"), "a").join(whole.toDF("b", "tb"), "b")
    value = jaccard_of(F.size(F.array_intersect("ta", "tb")), F.size("ta"), F.size("tb"))
    return both.select("a", "b", value.alias("similarity")).where(F.col("similarity") >= least - SLACK)


def similar_sets(sets: DataFrame, least: float, by: str) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of sets under one value of `by` whose Jaccard similarity is `least`, above 0, or more.

    sets: (by, id, tokens). Two sets that similar are of like sizes, and as they differ in few tokens they differ in few
    parities (`near_sketches`). All pairs of like sizes are compared by parities, which is quadratic in the sets of one value of
    `by`, at some nanoseconds for a pair; what passes is verified on whole sets. 64 bits stand for a token. Empty sets have no links.
    """
    coded = sets.select(by, "id", F.array_distinct(codes_of(F.col("tokens"))).alias("codes"))
    met = stored(near_sketches(stored(sketched(coded, least), "sketches"), least, by), "met")
    ends = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
    return similar_pairs(met, coded.select("id", "codes").join(ends, "id", "left_semi"), least)


def _least_neighbour(edges: DataFrame, node: str, other: str) -> DataFrame:
    """The edges, with the least of each node's neighbours and itself; a hub is aggregated in parts before it is joined."""
    least = edges.groupBy(node).agg(F.least(F.min(other), F.first(node)).alias("m"))
    return edges.join(least, node)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches; links: (a, b). Ids without a link are not shown.

    Large-star and small-star rounds over written tables, until a round changes nothing.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _least_neighbour(large, "u", "v")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
        seen = sign
    raise RuntimeError(f"links did not settle in {rounds} rounds")
