"""Queries of memories that are kept: facts, and the items that entries are about."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, mentions
from ..operators.evolution import evolve_notes
from ..streaming.memory import city_events, tier_moves
from . import base
from .base import query


#: Ids that are sent to the tasks at most, about 24 bytes each.
SENT_IDS = 1 << 20


def _statements(spark, sf_dir):
    """Documents as statements of their source; a toxic one takes back what it says."""
    toxic = base.table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("removes")).where("removes")
    toxic = F.broadcast(toxic) if toxic.limit(SENT_IDS + 1).count() <= SENT_IDS else toxic  # texts stay where they are
    rows = base.table(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    return rows.select(F.col("source").alias("owner"), F.col("doc_id").alias("seq"), "text", "removes")


@query()
def fact_history(spark, sf_dir):
    """What each statement did to the facts of its source."""
    return facts.fact_history(_statements(spark, sf_dir), text=False)


@query()
def fact_store(spark, sf_dir):
    """The facts that live after all statements."""
    return facts.current_facts(facts.fact_history(_statements(spark, sf_dir), text=False))


LONG_WORDS = "[a-z]{4,}"


@query(
    f"""
WITH e AS (
    SELECT item_id AS entry, lower(text) || CASE WHEN item_id % 4 = 0 THEN ' as in doc_' || (item_id * 7) ELSE '' END AS statement,
        list_distinct(regexp_extract_all(lower(text), '{LONG_WORDS}')) AS tokens FROM benchmark
), x AS (
    SELECT entry, 'doc_' || doc_id AS item_id, doc_id AS ord,
        CASE WHEN contains(statement, 'doc_' || doc_id) THEN 100 ELSE len(list_filter(tokens, lambda t: contains(lower(text), t))) END AS score FROM e, documents
)
SELECT entry, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY (score = 100) DESC, score DESC, ord) AS r FROM x) WHERE r = 1 AND score >= 2"""
)
def entry_items(spark, sf_dir):
    """The document that each passage is about: one that it names, else the one that holds most of its long words."""
    note = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit(" as in doc_"), F.col("item_id") * 7)).otherwise("")
    entries = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), F.concat("text", note).alias("statement"), F.regexp_extract_all(F.lower("text"), F.lit(LONG_WORDS), F.lit(0)).alias("tokens"))
    items = base.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("item_id"), F.col("doc_id").alias("ord"), "text")
    return mentions.best_match(entries, items)


def _plain(rows, *stamps):
    """Times without a zone, as the table has them."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


@query()
def memory_tiers(spark, sf_dir):
    """What moves between the tiers of each user's memory; topics are event types."""
    return _plain(tier_moves(base.table(spark, sf_dir, "events"), owner="user_id", item="event_id", topic="event_type"), "ts")


@query(
    """
WITH e AS (SELECT user_id AS owner, epoch_us(ts) // 1000 AS ms, event_id, min(event_type) AS city FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
l AS (SELECT *, lag(city) OVER w AS before, lag(ms // 86400000) OVER w AS day FROM e WINDOW w AS (PARTITION BY owner ORDER BY ms, event_id)),
r AS (SELECT *, sum(CASE WHEN before = city AND ms // 86400000 - day <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY ms, event_id) AS run FROM l)
SELECT owner, make_timestamp(min(ms) * 1000) AS "start", make_timestamp(max(ms) * 1000) AS "end", city, count(*) AS n FROM r GROUP BY owner, run, city"""
)
def city_runs(spark, sf_dir):
    """Events of each user that a change of place or a gap ends."""
    return _plain(city_events(base.table(spark, sf_dir, "events"), owner="user_id", item="event_id", city="event_type"), "start", "end")


def _turn_replies(prompts):
    """A rule in place of a model: half of all notes evolve, and what they say depends on the whole prompt."""
    h = F.crc32("prompt")
    kept = prompts.where(h % 2 == 0)
    none = F.lit(None).cast("array<array<string>>")
    return kept.select(
        "ord",
        F.array(F.col("ord") - 1).alias("links"),
        F.array(F.concat(F.lit("tag"), h % 7)).alias("own_tags"),
        F.array(F.concat(F.lit("context"), h % 11), F.lit(None).cast("string"), F.concat(F.lit("context"), h % 13)).alias("contexts"),
        none.alias("tags"),
    )


@query()
def note_evolution(spark, sf_dir):
    """Turns as notes whose neighbours are the three turns before; replies follow a rule, since there is no model."""
    turns = base.table(spark, sf_dir, "conversations")
    number = lambda back: F.col("conv_id") * 1_000_000 + F.col("turn") - back
    notes = turns.select(number(0).alias("ord"), F.col("text").alias("content"), F.col("role").alias("context"), F.array("role").alias("tags"))
    near = turns.select(number(0).alias("ord"), "turn", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).where("pos < turn")
    near = near.select("ord", F.col("pos").cast("int").alias("pos"), (F.col("ord") - 1 - F.col("pos")).alias("neighbour"))
    return evolve_notes(notes, near, _turn_replies)[0]
