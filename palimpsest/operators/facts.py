"""A fact store: statements add, update and delete versioned facts, found by their nearest neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .links import codes_of, components, near_sketches, similar_pairs, sketched, stored

DECIDED = "_o string, owner string, seq long, _x string, removes boolean, action string, fact long, version int"
#: Keys that are sent to the tasks at most, about 100 bytes each; beyond that Spark chooses the join.
SENT = 1 << 18


def _read_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements of one group after the other, each in the order of seq; the state is what lives in the group.

    A live fact is known by the token set of its present text, and no two live facts of a group have the same one.
    """
    group, live, versions = None, {}, {}
    for batch in batches:
        found = {name: [] for name in ("action", "fact", "version")}
        columns = (batch.column(n).to_pylist() for n in ("root", "seq", "id", "removes", "near"))
        for root, seq, mine, removes, near in zip(*columns, strict=True):
            if root != group:
                group, live, versions = root, {}, {}
            at = mine
            if mine not in live:
                hits = [(-n["similarity"], live[n["id"]], n["id"]) for n in near or () if n["id"] in live]
                at = min(hits)[2] if hits else None
            fact = live.get(at)
            if removes:
                action = "none" if fact is None else "delete"
                if fact is not None:
                    del live[at]
            elif fact is None:
                action, fact = "add", seq
                live[mine], versions[fact] = fact, 0
            elif at == mine:
                action = "none"
            else:
                action = "update"
                del live[at]
                live[mine] = fact
            if action != "none":
                versions[fact] += 1
            found["action"].append(action)
            found["fact"].append(fact)
            found["version"].append(versions.get(fact))
        kept = [batch.column(n) for n in ("_o", "owner", "seq", "_x", "removes")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(found["action"], pa.string()), pa.array(found["fact"], pa.int64()), pa.array(found["version"], pa.int32())],
            ["_o", "owner", "seq", "_x", "removes", *found],
        )


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(SENT + 1).count() <= SENT else keys


def fact_history(statements: DataFrame, least: float = 0.6, text: bool = True) -> DataFrame:
    """(owner, seq, text, removes, action, fact, version): what each statement did; without `text` that column is left out.

    statements: (owner, seq, text, removes), read in the order of seq for each owner. The nearest live fact of a statement
    is the owner's with the largest Jaccard similarity of words, `least` or more, the older fact among equals. A statement
      that removes  deletes its nearest fact; without one nothing happens (`none`, fact null);
      otherwise     adds a fact, whose number is its seq, where none is near; updates the nearest one to its own text; and
                    does nothing (`none`) where a live fact has the same words already.
    version counts what happened to the fact, its deletion included. A statement that comes more than once (one owner and
    seq) counts once, that with the smallest text, so a batch may be run again. Null texts have no words, null owners are
    one owner, null `removes` is false, rows without a seq are left out, other columns are dropped.

    Statements can only meet along links between texts of one owner, so each component of links is read by itself and an
    owner with a third of all rows is spread. Equal token sets are one text: copies make no pairs. A task holds the
    live facts of one component, never its statements. Texts stay where they are: what is written of a statement are digests
    and a sketch of its words, and only texts that sketches bring together are read again.
    """
    said = statements.where("seq is not null").select(F.col("owner").cast("string"), F.col("seq").cast("long"), "text", F.coalesce("removes", F.lit(False)).alias("removes"))
    said = said.withColumn("_o", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")))
    named = lambda c: F.sha2(F.coalesce(F.concat(F.lit("="), c), F.lit("")), 256)
    codes = codes_of(F.coalesce(tx.tokens(F.coalesce("text", F.lit(""))), F.array().cast("array<string>")))
    coded = said.select("_o", "owner", "seq", "removes", named("text").alias("_x"), codes.alias("codes"))
    rows = stored(sketched(coded, least), "statements")
    several = rows.groupBy("_o", "seq").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).where("lo < hi").select("_o", "seq")
    if not several.isEmpty():
        first = F.min(F.struct(F.col("text").isNotNull().alias("k"), "text")).alias("s")
        first = said.join(_sent(several), ["_o", "seq"], "left_semi").groupBy("_o", "seq").agg(first).select("_o", "seq", named("s.text").alias("_c"))
        rows = stored(rows.join(first, ["_o", "seq"], "left").where("_c is null or _c = _x").drop("_c"), "statements")
    sets = rows.groupBy("_o", "digest").agg(F.min("_x").alias("_x"), *[F.first(c).alias(c) for c in ("n", "size", "sketch")])
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()), "texts")
    met = stored(near_sketches(sets, least, "_o"), "met")
    ends = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
    wanted = stored(sets.select("_o", "_x", "id").join(ends, "id", "left_semi"), "wanted")
    whole = said.select("_o", "text", named("text").alias("_x")).join(_sent(wanted), ["_o", "_x"])
    whole = stored(whole.select("id", F.array_distinct(codes).alias("codes")).dropDuplicates(["id"]), "whole")
    near = stored(similar_pairs(met, whole, least), "near")
    roots = components(near)
    ways = near.select(F.col("a").alias("id"), F.struct(F.col("b").alias("id"), "similarity").alias("n"))
    ways = ways.unionByName(near.select(F.col("b").alias("id"), F.struct(F.col("a").alias("id"), "similarity").alias("n")))
    ways = ways.groupBy("id").agg(F.collect_list("n").alias("near"))
    placed = sets.select("_o", "digest", "id").join(roots, "id", "left").join(ways, "id", "left").withColumn("root", F.coalesce("root", "id"))
    once = rows.groupBy("_o", "owner", "seq", "_x", "digest").agg(F.min("removes").alias("removes"))
    once = once.join(placed, ["_o", "digest"]).select("root", "seq", "id", "removes", "near", "_o", "owner", "_x")
    done = once.repartition("root").sortWithinPartitions("root", "seq").mapInArrow(_read_in_order, DECIDED)
    if not text:
        return done.drop("_o", "_x")
    texts = said.select("_o", "seq", named("text").alias("_x"), "text").dropDuplicates(["_o", "seq", "_x"])
    return done.join(texts, ["_o", "seq", "_x"]).select("owner", "seq", "text", "removes", "action", "fact", "version")


def current_facts(history: DataFrame) -> DataFrame:
    """(owner, fact, version, text, seq): the facts that live after all statements, with the statement they are from; no text where the history has none."""
    last = Window.partitionBy("owner", "fact").orderBy(F.desc("version"))
    rows = history.where("action <> 'none'").withColumn("_r", F.row_number().over(last))
    return rows.where("_r = 1 and action <> 'delete'").select("owner", "fact", "version", *(c for c in ("text",) if c in rows.columns), "seq")
