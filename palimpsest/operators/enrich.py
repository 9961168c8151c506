"""Enrichment from cached replies, memory variants, and look-ups of shown items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Other names of memory variants, and the columns that each shows.
VARIANT_NAMES = {"structured": "sgm", "text": "descriptive", "original": "raw"}
VARIANTS = {
    "sgm": ("id", "type", "timestamp", "city", "location_name", "short_caption", "caption", "tags", "entities", "ocr_text"),
    "descriptive": ("id", "type", "timestamp", "caption"),
    "raw": ("id", "type", "path"),
}


def memory_variant(rows: DataFrame, mode: str) -> DataFrame:
    """The columns of a variant that a table has."""
    name = VARIANT_NAMES.get(mode, mode)
    if name not in VARIANTS:
        raise ValueError(f"no such variant: {mode}")
    return rows.select(*[c for c in VARIANTS[name] if c in rows.columns])


def without_answers(qa: DataFrame) -> DataFrame:
    """What an agent may see of a question."""
    return qa.select("id", "question")


def pool_evidence(qa: DataFrame, strict: bool = False) -> DataFrame:
    """Questions whose pool, if there is one, takes the place of their evidence; strict: a question without one ends the job."""
    pool = F.when(F.size("niah_evidence_ids") > 0, F.col("niah_evidence_ids"))
    missing = F.raise_error(F.concat(F.lit("no pool for question "), F.col("id"))).cast("array<string>")
    return qa.withColumn("evidence_ids", F.coalesce(pool, missing if strict else F.col("evidence_ids")))


def enriched(rows: DataFrame, caches: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Records with a field from each cache (stem, value), by the stem of their path; what no cache has is null."""
    rows = rows.withColumn("_stem", tx.stem(path))
    for field, cache in caches.items():
        rows = rows.join(cache.select(F.col("stem").alias("_stem"), F.col("value").alias(field)), "_stem", "left")
    return rows.drop("_stem")


def cleaned_fields(rows: DataFrame) -> DataFrame:
    """City, tags, entities and safety from the text of replies."""
    return rows.withColumns(
        {
            "city": F.regexp_replace(F.trim(tx.blank("city")), r"^[\"']+|[\"']+$", ""),
            "tags": tx.parse_tags("tags"),
            "entities": tx.parse_entities("entities"),
            "safety_content": F.coalesce(tx.filled(F.lower(F.trim(tx.blank("safety_content")))), F.lit("safe")),
        }
    )


def categorised(text: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """The categories of which a text has a word."""
    low = F.lower(tx.blank(text))
    named = F.array(*[F.when(low.rlike(r"\b(" + "|".join(ws) + r")\b"), name) for name, ws in words.items()])
    return F.filter(named, lambda x: x.isNotNull())


def replied(rows: DataFrame, replies: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their stored reply, and rows that still wait for one."""
    return rows.join(replies, key), rows.join(replies, key, "left_anti")


def shown(ids: DataFrame, items: DataFrame) -> DataFrame:
    """(q, n, item_id, text): items in the order in which they are asked for; ids: (q, ids)."""
    return ids.select("q", F.posexplode("ids").alias("n", "item_id")).join(items, "item_id", "left").select("q", "n", "item_id", "text")


def linked_notes(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """Notes of one generation with the context and tags of their last update; updates: (ord, context, tags, pos)."""
    last = updates.withColumn("_r", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("pos")))).where("_r = 1")
    last = last.select("ord", F.col("context").alias("_c"), F.col("tags").alias("_t"))
    rows = notes.join(last, "ord", "left")
    return rows.withColumns({"context": F.coalesce("_c", "context"), "tags": F.coalesce("_t", "tags")}).drop("_c", "_t")


def hottest_pages(pages: DataFrame, k: int) -> DataFrame:
    """The k pages of each question with the largest score, older ones first among equals."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "page")
    return pages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
