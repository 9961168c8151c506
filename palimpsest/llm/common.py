"""Shared helpers: tables that cut lineage, connected components, ASCII folding, batch handling."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The upper-case ASCII letters and their lower-case forms.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 8 << 20
#: Links that one task may take at most, about 200 bytes each.
FEW_LINKS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that a task's memory does not follow the length of texts. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", f"{64 << 20}b"):  # the default
        spark.conf.set(key, str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share; it is unset and the master is {master!r}")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_remove_quietly, spark, root)
    return root.rstrip("/")


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the Hadoop file system that owns it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one operator call. They outlive lost executors, unlike cached blocks.

    A table is dropped once a later one replaces it; what the returned DataFrame still reads stays until the
    application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(_remove_quietly, spark, self.root)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = self.path(name)
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "scratch_path", None):
            remove(self.spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps, which have no order, are hashed by their sorted entries, other types that hold one as JSON."""

    def hashable(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            return F.to_json(F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(e["key"].alias("k"), e["value"].alias("v"))))))
        return F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else c

    return F.xxhash64(*[hashable(f) for f in df.schema.fields]) if df.columns else F.lit(0).cast("long")


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def batches_of(batches: Iterator[pa.RecordBatch], rows: int, size: int, column: str) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that each holds at most `rows` rows and about `size` bytes of `column`."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64))))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1
            to = min(n, at + rows, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def trimmed(scan):
    """`scan`, after which the worker gives back the memory that it no longer uses: the next task may be another operator's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return run


def _few_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the links of one task, by union and find."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([find(x) for x in top], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(u, v) links → (node, component): component is the smallest node that can be reached.

    Large-star / small-star rounds: every round is two equi-joins against per-node minima, which are
    partially aggregated, so a hub node is one row on the side it would skew. Links never leave the
    executors and each round is a written table. Self links are allowed; no links give no rows. At most
    FEW_LINKS links between integers go to one task instead, which gives the same in one step.
    """
    spark = scratch.spark
    now = scratch.write(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    mark = _fingerprint(now)
    if mark[0] <= FEW_LINKS and {t for _, t in now.dtypes} == {"bigint"}:
        return now.repartition(1).mapInArrow(_few_components, "node long, component long")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.where("u = v")).distinct()
        large = scratch.write(large, "large")
        low = large.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = scratch.write(small.distinct(), "small")
        scratch.drop(now)
        scratch.drop(large)
        then, now = mark, after
        mark = _fingerprint(now)
        if mark == then:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and an order-free hash of a set of links."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND((1 << 32) - 1))).first()
    return tuple(row)
