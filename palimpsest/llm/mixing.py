"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source with `size` words and target `t` takes t / size copies of each of its documents: the whole part
always, the fraction by rounding. Rounding is pivotal: two documents with fractional probabilities meet, and
words of expected mass move from one to the other, in a direction drawn so that no expectation changes,
until the probability of one of them is 0 or 1. So each document keeps its expectation, and the expected
words of the two together stay the same. Documents meet others of the same source and nearly the same size.
A group of about `FAN` documents leaves one document undecided; the undecided ones of `FAN` groups form the
groups of the next level, and so on: a tree whose height is the logarithm of the input. When a source has
one left in each size class, the classes meet from large to small; at last the one left in the source,
mostly a small one, is rounded alone. That is the only step that moves the source's words off its target.

Random numbers are hashes of the seed, the level and the ids that meet, so reruns agree whatever the
partitioning. A group's rows are an array of bounded expected size, spread by a hash of the id, however
many documents a source has.

Defined results
    null text      has size 0; it is taken like others and adds no words
    null source    is a source of its own, the last in order
    repeated rows  each row is a document of its own
    no words       if all sizes of a source are 0, its target is 0 and no copy is taken
    empty table    no rows
    long texts     are counted by one pass of a pattern; a document is taken or left as a whole
    ties           documents of one source and size meet in the order of their ids, then of their number
    extra columns  are kept by `mix`, whatever their names and types
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_hash, table

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
FAN = 32
SEED = 20_240_501
#: Size classes to a doubling of the size.
FINE = 8
EPS = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for each source of (source, size).

    Sources in order of code points, null last, weigh `weights` in turn and share `total` of all sizes. A
    target stops at `most` times its source's size, and the excess is shared again by weight. The sources
    that stop are those with the least size for their weight, so one pass in that order settles all of them.
    This is a window over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    per = per.select(
        "source",
        "source_size",
        "w",
        (F.lit(total) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("w").over(after).alias("w_left"),
    )
    stops = F.col("left") * F.col("w") > F.lit(most) * F.col("source_size") * F.col("w_left")
    per = per.withColumn("stops", stops).withColumn("rate", F.min(F.when(~F.col("stops"), F.struct(-F.col("w_left"), F.col("left") / F.col("w_left")))).over(everything)["col2"])
    target = F.when(F.col("stops"), F.lit(most) * F.col("source_size")).otherwise(F.col("rate") * F.col("w"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def _whole(unit: Column) -> Column:
    return (unit["p"] <= EPS) | (unit["p"] >= 1 - EPS)


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Pivotal rounding along an array of (size, id, p, at, whole): (done: array of decided units, rest: the undecided or null).

    The unit in hand meets the next one, and the one that stays undecided is in hand then.
    """
    kind = "struct<size:bigint,id:bigint,p:double,at:bigint,whole:bigint>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("rest"))

    def with_p(unit: Column, p: Column) -> Column:
        return F.struct(unit["size"].alias("size"), unit["id"].alias("id"), p.cast("double").alias("p"), unit["at"].alias("at"), unit["whole"].alias("whole"))

    def meet(acc: Column, unit: Column) -> Column:
        a, p, q = acc["rest"], acc["rest"]["p"], unit["p"]
        wa, wb = F.greatest(a["size"], F.lit(1)), F.greatest(unit["size"], F.lit(1))
        up, down = F.least((1 - p) * wa, q * wb), F.least(p * wa, (1 - q) * wb)  # words that can move to a, or from it
        moved = F.when(_uniform(F.lit(seed), F.lit(level), a["at"], unit["at"]) * (up + down) < down, up).otherwise(-down)
        new_a, new_b = with_p(a, p + moved / wa), with_p(unit, q - moved / wb)
        pair = F.filter(F.array(new_a, new_b), _whole)
        left = F.filter(F.array(new_a, new_b), lambda x: ~_whole(x))
        settled = F.transform(pair, lambda x: with_p(x, F.round(x["p"])))
        met = F.struct(F.concat(acc["done"], settled).alias("done"), F.get(left, F.lit(0)).alias("rest"))
        alone = F.struct(acc["done"].alias("done"), unit.alias("rest"))
        return F.when(a.isNull(), alone).otherwise(met)

    return F.aggregate(units, start, meet)


def copies(units: DataFrame, scratch: Scratch, *, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """(source, id, size, at, copies) for each row of (source, id, size, rate): its expected copies, rounded.

    `at` tells apart rows that share an id.
    """
    part = Window.partitionBy("source", "id", "size").orderBy("rate")
    units = units.withColumn("at", F.xxhash64(F.lit(seed), "source", "id", "size", F.row_number().over(part)))
    whole = F.floor(F.col("rate") + EPS)
    cls = F.floor(F.log2(F.col("size") + 1.0) * FINE).cast("int")
    units = units.select("source", "id", "size", "at", whole.cast("long").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"), cls.alias("cls"))
    units = scratch.write(units, "units")
    columns = ["source", "id", "size", "at", "whole", "p"]
    done = units.where(F.col("p") <= EPS).select(*columns[:-1], F.lit(0.0).alias("p"))
    open_ = units.where(F.col("p") > EPS)
    counts = open_.groupBy("source", "cls").agg(F.count("*").alias("n"))
    rows = open_.alias("o").join(counts.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source")) & (F.col("o.cls") == F.col("c.cls")))
    groups = F.ceil(F.col("n") / fan)
    now = rows.select(*[f"o.{c}" for c in columns], "o.cls", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("o.at")), groups).alias("g"), groups.alias("groups"))
    level = 0
    while True:
        unit = F.struct("size", "id", "p", "at", "whole")
        folded = now.groupBy("source", "cls", "g", "groups").agg(F.sort_array(F.collect_list(unit), asc=False).alias("u"))
        folded = folded.select("source", "cls", "g", "groups", _fold(F.col("u"), level, seed).alias("f"))
        folded = scratch.write(folded, f"level{level}")
        done = done.unionByName(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.size", "d.at", "d.whole", "d.p"))
        rest = folded.where("f.rest is not null").select("source", *[f"f.rest.{c}" for c in columns[1:]], "cls", "g", "groups")
        most = rest.agg(F.max("groups"), F.max("cls"), F.min("cls")).first()
        level += 1
        if most[0] is None:
            break
        if most[0] > 1:  # groups of groups within a size class
            fewer = F.ceil(F.col("groups") / fan)
            now = rest.select(*columns, "cls", F.floor(F.col("g") / fan).alias("g"), fewer.alias("groups"))
        elif most[1] > most[2] or most[1] > 0:  # then all size classes of a source, neighbours first
            now = rest.select(*columns, F.lit(0).alias("cls"), F.lit(0).cast("long").alias("g"), F.lit(1).cast("long").alias("groups"))
        else:
            last = F.when(_uniform(F.lit(seed), F.lit("last"), F.col("at")) < F.col("p"), 1.0).otherwise(0.0)
            done = done.unionByName(rest.select(*columns[:-1], last.alias("p")))
            break
    return done.select("source", "id", "size", "at", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: float = TOTAL, most: float = MOST, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of `docs`."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = scratch.write(sizes, "sizes")
    goals = scratch.write(targets(sizes, weights=weights, total=total, most=most), "targets")
    rate = F.when(F.col("g.source_size") > 0, F.least(F.col("g.target") / F.col("g.source_size"), F.lit(most))).otherwise(F.lit(0.0))
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    units = sizes.alias("s").join(goals.alias("g"), same).select("s.source", "s.id", "s.size", rate.alias("rate"))
    taken = copies(units, scratch, fan=fan, seed=seed)
    out = taken.alias("s").join(goals.alias("g"), same)
    return out.select("s.id", "s.source", "s.size", "g.source_size", "g.target", "s.copies")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, each as often as the mixture takes it, with the columns of `docs`."""
    found = mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    nth = F.row_number().over(Window.partitionBy("id", "source", "size").orderBy("copies")).alias("_nth")
    found = found.select("id", "source", "size", "copies", nth).alias("m")
    keys = [F.col(id_col).cast("long").alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *keys, row_hash(docs).alias("_hash"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("_hash"))).alias("d")
    same = F.col("d._id").eqNullSafe(F.col("m.id")) & F.col("d._source").eqNullSafe(F.col("m.source")) & (F.col("d._size") == F.col("m.size")) & (F.col("d._nth") == F.col("m._nth"))
    rows = rows.join(found, same).where("copies > 0").select("d._row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return rows.select("_row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    found = mixture(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
