"""Strings that occur in texts, found by their rarest piece, and the item that fits an entry best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import stored

#: Letters of a piece by which strings and texts meet; a shorter string is its own piece.
PIECE = 4
#: The score of an item whose id is mentioned; tokens of at least so many letters count, and so many make a match.
MENTIONED, LONG, ENOUGH = 100, 4, 2


def pieces(text: Column, length: int) -> Column:
    """The distinct runs of `length` letters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def _cut(rows: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    return rows.withColumn("piece", F.explode(F.flatten(F.array(*[pieces(F.col(text), n) for n in lengths]))))


def rarest_pieces(patterns: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pattern, piece, df) of patterns all of whose pieces are in some text, (id, piece) of the texts that pieces of patterns are in)."""
    size = F.least(F.length("pattern"), F.lit(PIECE))
    lengths = sorted(r[0] for r in patterns.select(size).distinct().collect() if r[0])
    if not lengths:
        spark = patterns.sparkSession
        return spark.createDataFrame([], "pattern string, piece string, df long"), spark.createDataFrame([], texts.select("id").withColumn("piece", F.lit("")).schema)
    mine = _cut(patterns.select("pattern", size.alias("n")), "pattern", lengths).where(F.length("piece") == F.col("n"))
    mine = stored(mine.select("pattern", "piece"), "pieces")
    held = _cut(texts.select("id", "text"), "text", lengths).select("id", "piece")
    held = stored(held.join(mine.select("piece").distinct(), "piece", "left_semi"), "held")
    df = held.groupBy("piece").agg(F.count("*").alias("df"))
    best = mine.join(df, "piece", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "piece")).alias("b"))
    return best.where("b.df > 0").select("pattern", "b.piece", "b.df"), held.select("id", "piece")


def occurring(patterns: DataFrame, texts: DataFrame, keyed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(pattern, id): each pattern (distinct, not empty) in each text that holds it as it is; texts: (id, text), id unique.

    A pattern is looked for in the texts that have the rarest of its pieces, so frequent pieces, whatever number of
    texts they are in, are a key only of patterns that have no other.
    """
    keys, held = keyed or rarest_pieces(patterns, texts)
    met = held.join(keys.join(patterns.select("pattern"), "pattern", "left_semi").select("pattern", "piece"), "piece").select("pattern", "id")
    return met.join(texts.select("id", "text"), "id").where(F.contains("text", "pattern")).select("pattern", "id")


def best_match(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(entry, item_id, score): the item that each memory entry is about, for entries that have one.

    entries: (entry, statement, tokens), entry unique; items: (item_id, ord, text), ord the corpus order. All is compared in
    lower case. An item whose id is in the statement or is one of the tokens wins with 100, the first one in order; else the item
    whose text holds most tokens of four letters or more as they are, two at least, the first among equals. Null
    statements, texts and ids are empty, null tokens and empty ids say nothing, repeated tokens count once.

    Two tokens have to be found, so an item that counts has one besides the entry's most frequent token: items are
    looked for by the others, and the most frequent is only looked up in what they find. Entries of the same tokens are one.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    items = items.select("item_id", "ord", low("text").alias("text"), low("item_id").alias("name"))
    words = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("tokens", F.array().cast("array<string>")), F.lower), lambda t: t.isNotNull() & (t != ""))))
    entries = stored(entries.select("entry", low("statement").alias("text"), words.alias("tokens")), "entries")
    names = items.where("name <> ''").groupBy(F.col("name").alias("pattern")).agg(F.min(F.struct("ord", "item_id")).alias("first"))

    told = occurring(names.select("pattern"), entries.select(F.col("entry").alias("id"), "text")).select("pattern", F.col("id").alias("entry"))
    told = told.unionByName(entries.select("entry", F.explode("tokens").alias("pattern")))
    told = stored(told.join(names, "pattern").groupBy("entry").agg(F.min("first").alias("f")).select("entry", "f.item_id"), "mentioned")

    left = entries.join(told, "entry", "left_anti").select("entry", F.filter("tokens", lambda t: F.length(t) >= LONG).alias("tokens"))
    left = left.where(F.size("tokens") >= ENOUGH)
    kinds = stored(left.groupBy("tokens").agg(F.count("*").alias("n")).select("tokens", F.monotonically_increasing_id().alias("kind")), "kinds")
    each = kinds.select("kind", F.explode("tokens").alias("pattern"))
    texts = items.select(F.col("ord").alias("id"), "text")
    keyed = rarest_pieces(each.select("pattern").distinct(), texts)
    keyed = stored(keyed[0], "keys"), keyed[1]
    live = each.join(keyed[0].select("pattern", "df"), "pattern")
    common = live.groupBy("kind").agg(F.max(F.struct("df", "pattern")).alias("c"), F.count("*").alias("n")).where(F.col("n") >= ENOUGH).select("kind", F.col("c.pattern").alias("common"))
    others = stored(live.join(common, "kind").where("pattern <> common").select("kind", "pattern"), "others")
    hits = occurring(others.select("pattern").distinct(), texts, keyed).join(others, "pattern")
    pairs = hits.groupBy("kind", "id").agg(F.count("*").alias("found")).join(common, "kind").join(texts, "id")
    scored = pairs.select("kind", "id", (F.col("found") + F.contains("text", "common").cast("long")).alias("score")).where(F.col("score") >= ENOUGH)
    best = scored.groupBy("kind").agg(F.max(F.struct("score", (-F.col("id")).alias("back"))).alias("b")).select("kind", "b.score", (-F.col("b.back")).alias("ord"))
    fits = best.join(kinds, "kind").join(items.select("ord", "item_id"), "ord").select("tokens", "item_id", "score")
    return told.withColumn("score", F.lit(MENTIONED).cast("long")).unionByName(left.join(fits, "tokens").select("entry", "item_id", "score"))
