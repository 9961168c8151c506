"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of `BLOCK` characters. Equal blocks get equal integer names and different blocks
different ones: inside a hash bucket the distinct blocks are sorted and numbered. Then adjacent pairs of
names are named in the same way, over and over, until one name is left for each text. A name stands for
exactly one content at its level, so texts are equal if and only if level and name are equal. Hashes only say
in which bucket a block is numbered; the SHA-256 of a text is put out and never compared.

Blocks are written once, with a number for their row, and go to the numbering in one shuffle by bucket. A block
of more than `HOT_ROWS` copies is hot: its distinct contents are combined in each task and named, and where its
hash has one content only, as all but never fails, the name goes back by the hash without moving a copy. The
`HOT` most frequent ones are hot at most, 8 bytes each; any other has less than one in HOT of all rows.

Defined results
    null text        counts as the empty text, which is one empty block
    equal            identical after lower-casing A-Z only
    ties             of equal texts the row with the largest doc_id stays; null ids are smaller than all
    repeated rows    of rows that share text and the largest doc_id all are marked as kept and counted
    long texts       are cut in one pass and take more levels, each half as long as the one before
    empty table      no rows
    extra columns    are ignored, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fold_ascii, table

BLOCK = 4096
#: Rows aimed at in a bucket that is sorted and numbered, copies from which on a block is hot, and hot blocks at most.
BUCKET_ROWS = 1000
HOT_ROWS = 100
HOT = 1 << 20


def _hashed(*keys: str) -> Column:
    return F.xxhash64(*keys)


def _named(parts: DataFrame, keys: list[str], scratch: Scratch, label: str) -> DataFrame:
    """`parts`, a written table, with a column `name` instead of `keys`: equal keys, and no others, get the same name."""
    rest = [c for c in parts.columns if c not in keys]
    hashed = parts.withColumn("h", _hashed(*keys))
    counts = scratch.write(hashed.groupBy("h").agg(F.count("*").alias("n")), f"{label}-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod("h", F.lit(max(1, total // BUCKET_ROWS)))
    name = F.shiftleft("bucket", 32) + F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    hot = scratch.write(counts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "h").limit(HOT).select("h"), f"{label}-hot")

    cold = hashed.join(F.broadcast(hot), "h", "left_anti").withColumn("bucket", bucket).select(*rest, name.alias("name"))
    if hot.isEmpty():
        return scratch.write(cold, label)
    often = hashed.join(F.broadcast(hot), "h", "left_semi")
    names = often.select("h", *keys).distinct().withColumn("bucket", bucket).select("h", *keys, (-name).alias("name"))
    names = scratch.write(names.withColumn("contents", F.count("*").over(Window.partitionBy("h"))), f"{label}-names")
    one = names.where("contents = 1").select("h", "name")
    out = cold.unionByName(often.select("h", *rest).join(F.broadcast(one), "h").select(*rest, "name"))  # as many rows as `hot` at most
    more = names.where("contents > 1").select("h", *keys, "name")
    if not more.isEmpty():
        same = F.col("l.h") == F.col("r.h")
        for k in keys:
            same &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        out = out.unionByName(often.alias("l").join(more.alias("r"), same).select(*[F.col(f"l.{c}") for c in rest], "r.name"))
    return scratch.write(out, label)


def _blocks(text: Column, block: int) -> Column:
    """The blocks of a text in turn, cut in one pass; an empty text has one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def identities(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, id, sha, level, name) for each row of `docs`: equal texts, and no others, have equal level and name."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), fold_ascii(F.col(f"`{text_col}`")).alias("t"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.unhex(F.sha2("t", 256)).alias("sha"), _blocks(F.col("t"), block).alias("blocks"))
    parts = scratch.write(rows.select("row", "id", "sha", F.size("blocks").alias("many"), F.posexplode("blocks").alias("at", "block")), "parts")
    now = _named(parts, ["block"], scratch, "blocks")
    scratch.drop(parts)
    level, done = 0, None
    while True:
        ready = now.where("many = 1").select("row", "id", "sha", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        rest = now.where("many > 1")
        if rest.isEmpty():
            return done
        even = F.col("at") % 2 == 0
        pairs = rest.groupBy("row", F.shiftright("at", 1).alias("half")).agg(
            F.first("id").alias("id"), F.first("sha").alias("sha"), F.first("many").alias("many"), F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")
        )
        pairs = pairs.select("row", "id", "sha", F.shiftright(F.col("many") + 1, 1).alias("many"), F.col("half").alias("at"), "a", "b")
        level += 1
        now = _named(scratch.write(pairs, f"pairs{level}"), ["a", "b"], scratch, f"level{level}")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row. See the module's docstring."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.write(identities(docs, scratch, id_col=id_col, text_col=text_col, block=block), "named")
    size = rows.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    size = scratch.write(size, "sizes")  # a plain table, so that Spark can split a large group in the join
    out = rows.join(size, ["level", "name"])
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Every document with the row that stays of its group.
OP8_SQL = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
