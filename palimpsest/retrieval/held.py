"""Where indexes and intermediate results live."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that are brought to the driver and sent out again at most; more are written to the shared folder.
HELD_ROWS = 1 << 17


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share; it is unset and the master is {master!r}")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_removed, spark, root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder, which goes when the interpreter ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def held(df: DataFrame, rows: int = HELD_ROWS) -> tuple[DataFrame, bool]:
    """The rows of `df`, computed once, and whether they are few enough to be sent to all tasks."""
    spark = df.sparkSession
    some = df.limit(rows + 1).toArrow()
    if some.num_rows <= rows:
        return spark.createDataFrame(some.combine_chunks() if some.num_rows else some, df.schema) if some.num_rows else spark.createDataFrame([], df.schema), True
    path = fresh_folder(spark, "held")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), False
