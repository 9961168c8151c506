"""Items, events and evidence as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, filled, trimmed

#: The lines of a media item and of an email, their labels and columns, in order.
MEDIA_LINES = {
    "ID": "item_id", "Type": "modality", "Timestamp": "timestamp", "Location": "location_name", "Short Caption": "short_caption", "Caption": "caption",
    "OCR": "ocr_text", "Tags": "tags",
}
EMAIL_LINES = {"ID": "item_id", "Type": "modality", "Timestamp": "timestamp", "Summary": "short_summary", "Detail": "detail"}
MINIMAL = ("ID", "Type", "Timestamp", "Location", "Short Caption", "Summary")
#: Other names of the sets of evidence fields.
FIELD_SETS = {"all": None, "none": (), "id_only": ("ID",)}


def _value(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    if dict(df.dtypes)[name].startswith("array<string"):
        return filled(F.array_join(name, ", "))
    return filled(F.col(name).cast("string"))


def labelled(df: DataFrame, lines: Mapping[str, str], fields: tuple[str, ...] | None = None) -> Column:
    """`Label: value` lines of the fields that are wanted and not empty."""
    unknown = set(fields or ()) - set(lines)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    parts = [F.concat(F.lit(f"{label}: "), _value(df, name)) for label, name in lines.items() if fields is None or label in fields]
    return F.concat_ws("\n", *parts) if parts else F.lit("")


def media_text(df: DataFrame, fields: tuple[str, ...] | None = None) -> Column:
    return labelled(df, MEDIA_LINES, fields)


def email_text(df: DataFrame, fields: tuple[str, ...] | None = None) -> Column:
    return labelled(df, EMAIL_LINES, fields)


def search_text(text: Column, timestamp: Column, location: Column, subject: Column) -> Column:
    """The text that the sparse channel indexes."""
    return F.concat_ws(" ", blank(text), filled(timestamp), filled(location), filled(subject))


def search_record(df: DataFrame, rich: bool = False) -> DataFrame:
    """(id, type, ts, city, text[, detail]): the compact record of an item, for the search tool."""
    text = F.concat_ws(" ", filled("short_caption"), filled("caption"), filled(F.array_join("tags", " ")), filled(F.array_join(F.transform("entities", lambda e: e["entity"]), " ")), filled("location_name"), filled(F.left("ocr_text", F.lit(600))))
    out = df.select(F.col("item_id").alias("id"), F.col("modality").alias("type"), F.left(blank("timestamp"), F.lit(16)).alias("ts"), blank("city").alias("city"), text.alias("text"), *_detail(rich))
    return out.where(blank(F.col("id").cast("string")) != "")


def _detail(rich: bool) -> list[Column]:
    if not rich:
        return []
    detail = F.struct(
        F.left(blank("short_caption"), F.lit(160)).alias("short_caption"), F.left(blank("caption"), F.lit(400)).alias("caption"), F.left(blank("ocr_text"), F.lit(600)).alias("ocr_text"),
        F.slice("tags", 1, 10).alias("tags"), F.slice("entities", 1, 10).alias("entities"),
    )
    return [detail.alias("detail")]


def evidence_blocks(ranked: DataFrame, texts: DataFrame, most: int, length: int | None = None) -> DataFrame:
    """(q, evidence): the first `most` items of each question as numbered blocks."""
    rows = ranked.where(F.col("rank") <= most).join(texts, "item_id")
    body = trimmed("text", length) if length else F.col("text")
    block = F.concat(F.lit("Evidence "), F.col("rank").cast("string"), F.lit(":\n"), body)
    return rows.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("evidence"))


def snippet_answer(ranked: DataFrame, texts: DataFrame, most: int = 10, length: int = 200) -> DataFrame:
    """(q, answer): the first items' starts, joined by bars."""
    rows = ranked.where(F.col("rank") <= most).join(texts, "item_id")
    part = F.struct("rank", F.left("text", F.lit(length)).alias("b"))
    return rows.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["b"]), " | ").alias("answer"))


def note_text(content: Column, context: Column, keywords: Column, tags: Column) -> Column:
    return F.concat(F.lit("content: "), blank(content), F.lit(" context: "), blank(context), F.lit(" keywords: "), F.array_join(keywords, ", "), F.lit(" tags: "), F.array_join(tags, ", "))


def passage_text(df: DataFrame, level: int) -> Column:
    """A passage with more of the record at each of four levels."""
    parts = [_value(df, "short_caption")]
    for least, names in ((1, ("timestamp", "location_name")), (2, ("caption",)), (3, ("ocr_text", "tags"))):
        if level >= least:
            parts += [_value(df, n) for n in names]
    return F.concat_ws("\n", *parts)


def dialogue_line(role: Column, text: Column) -> Column:
    who = F.when(blank(role) == "", F.lit("Unknown")).otherwise(F.initcap(role))
    return F.concat(who, F.lit(": "), blank(text))


def dialogue(rows: DataFrame, keys: list[str], turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """(keys, dialogue): the turns of each conversation, one a line."""
    part = F.struct(F.col(turn).alias("t"), dialogue_line(F.col(role), F.col(text)).alias("b"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["b"]), "\n").alias("dialogue"))


def event_line(df: DataFrame) -> Column:
    """One line for an event."""
    return F.format_string("%-6s %-5s %s..%s %s (%d items)", F.col("event_id"), F.col("kind"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("city"), F.col("item_count").cast("int"))


def seed_line(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def chunk_text(items: DataFrame, size: int = 800, overlap: int = 100, text: str = "text") -> DataFrame:
    """The rows of items with one row for each chunk (chunk, chunk_text) of `size` characters, which overlap."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0))
    return items.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk")).withColumn("chunk_text", F.substring(F.col(text), (F.col("chunk") * step + 1).cast("int"), F.lit(size)))


def best_chunk(chunk_scores: DataFrame) -> DataFrame:
    """(q, item_id, score): an item counts by its best chunk."""
    return chunk_scores.groupBy("q", "item_id").agg(F.max("score").alias("score"))


def supporting(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(q, paragraphs): the evidence texts of each question in the order of its ids."""
    rows = questions.select("q", F.posexplode("evidence_ids").alias("n", "item_id")).join(texts, "item_id", "left")
    part = F.struct("n", "item_id", blank("text").alias("text"))
    return rows.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.struct(x["item_id"].alias("item_id"), x["text"].alias("text"))).alias("paragraphs"))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "n") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
