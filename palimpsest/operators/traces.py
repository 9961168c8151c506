"""Answers and usage from the traces of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import canonical_usage, usages

#: For each trace format, the kind of event that carries the final answer and the path of its text.
ANSWER_EVENTS = {
    "stream": ("$.type", "result", "$.result"),
    "items": ("$.item.type", "agent_message", "$.item.text"),
    "messages": ("$.role", "assistant", "$.content"),
    "parts": ("$.type", "text", "$.part.text"),
}


def final_answers(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, answer): the text of the last event that carries one, by format. events: (keys, format, pos, json)."""
    found: Column | None = None
    for name, (where, kind, path) in ANSWER_EVENTS.items():
        hit = (F.col("format") == name) & (F.get_json_object("json", where) == kind)
        text = F.get_json_object("json", path)
        found = F.when(hit, text) if found is None else found.when(hit, text)
    rows = events.withColumn("_a", found).where(F.trim("_a") != "")
    return rows.groupBy(*keys).agg(F.max_by(F.trim("_a"), "pos").alias("answer"))


def structured_answer(text: Column) -> Column:
    """(answer, evidence_ids) if an answer is an object with these fields, else the text and no ids."""
    parsed = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "answer string, evidence_ids array<string>")
    return F.struct(F.coalesce(parsed["answer"], text).alias("answer"), F.coalesce(parsed["evidence_ids"], F.array().cast("array<string>")).alias("evidence_ids"))


def usage_records(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, group_id, usage fields): every usage object of a trace, at any depth."""
    ids = F.coalesce(F.get_json_object("json", "$.message.id"), F.get_json_object("json", "$.response.id"), F.get_json_object("json", "$.id"))
    rows = events.select(*keys, "pos", ids.alias("group_id"), F.posexplode(usages("json")).alias("nth", "usage"))
    return rows.select(*keys, (F.col("pos") * 1000 + F.col("nth")).alias("pos"), "group_id", canonical_usage(F.col("usage")).alias("u")).select(*keys, "pos", "group_id", "u.*")


def tool_calls(events: DataFrame, keys: list[str], command: str = "command") -> DataFrame:
    """(keys, searches, shows, scans): how often a command searches, shows an item, or reads files directly."""
    c = F.lower(F.col(command))
    return events.groupBy(*keys).agg(
        F.count_if(c.rlike(r"\bsearch(\.py)?\b")).alias("searches"), F.count_if(c.rlike(r"\bshow\b")).alias("shows"), F.count_if(c.rlike(r"^\s*(cat|grep|rg|head|tail|sed|jq)\b")).alias("scans")
    )
