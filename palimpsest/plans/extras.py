"""Further queries: routes carried out, evidence, entities, frames, event search, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx
from ..operators import analytics, channels, events, fusion, query as ask, render
from . import base
from .base import RANK, TOKENS, query, values
from .retrieval import CHANNELS, W, WHOLE, _sparse, fused
from .timeline import DAYS, _items


@query(
    f"""WITH {WHOLE}, f AS (
    SELECT coalesce(s.q, d.q) AS q, coalesce(s.item_id, d.item_id) AS item_id, round({W['s']}::DOUBLE / (60 + coalesce(s.rank, n + 1)) + {W['d']}::DOUBLE / (60 + coalesce(d.rank, n + 1)), 8) AS score
    FROM s FULL JOIN d ON s.q = d.q AND s.item_id = d.item_id CROSS JOIN nn
), u AS (
    SELECT q, item_id, score, 'BM25_ONLY' AS strategy FROM bm WHERE q % 3 = 0 UNION ALL SELECT q, item_id, score, 'DENSE_ONLY' FROM d WHERE q % 3 = 1 UNION ALL SELECT q, item_id, score, 'FULL_HYBRID' FROM f WHERE q % 3 = 2
) SELECT q, item_id, score, strategy, rank FROM (SELECT *, {RANK} AS rank FROM u) WHERE rank <= 10"""
)
def route_execute(spark, sf_dir):
    """Three strategies, dealt to questions by their number."""
    names = F.element_at(F.array(F.lit("BM25_ONLY"), F.lit("DENSE_ONLY"), F.lit("FULL_HYBRID")), (F.col("q") % 3 + 1).cast("int"))
    asked = base.asked(spark, sf_dir).withColumn("strategy", names)
    return ask.execute_routes(asked, {"BM25_ONLY": _sparse(spark, sf_dir, 10), "DENSE_ONLY": base.nearest(spark, sf_dir, 10), "FULL_HYBRID": fused(spark, sf_dir)})


@query(
    "WITH g AS (SELECT b.item_id AS q, d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'email' || d.doc_id ELSE d.doc_id || '.jpg' END AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) "
    "SELECT q, CASE WHEN bool_or(id LIKE 'email%') AND bool_or(id NOT LIKE 'email%') THEN 'mixed' WHEN bool_or(id LIKE 'email%') THEN 'email' ELSE 'media' END AS kind, count(*) AS n FROM g GROUP BY q"
)
def evidence_modality(spark, sf_dir):
    name = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("email"), F.col("item_id"))).otherwise(F.concat(F.col("item_id"), F.lit(".jpg")))
    ids = base.gold(spark, sf_dir).groupBy("q").agg(F.collect_list(name).alias("ids"), F.count("*").alias("n"))
    return ids.select("q", tx.evidence_mix("ids").alias("kind"), "n")


@query(
    "WITH g AS (SELECT b.item_id AS q, d.doc_id, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT q, count(*)::INT AS n, sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS text_sha256 FROM g GROUP BY q"
)
def supporting_paragraphs(spark, sf_dir):
    ids = base.gold(spark, sf_dir).groupBy("q").agg(F.array_sort(F.collect_list("item_id")).alias("evidence_ids"))
    out = render.supporting(ids, base.items(spark, sf_dir).select("item_id", "text"))
    return out.select("q", F.size("paragraphs").alias("n"), F.sha2(F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n"), 256).alias("text_sha256"))


@query("SELECT event_id, unnest(range(0, 3))::INT AS frame, round((unnest(range(0, 3)) + 1) * value / 4, 6) AS at FROM events")
def frame_times(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events").select("event_id", "value")
    return events.frame_times(rows, 3, "value").select("event_id", "frame", F.round("at", 6).alias("at"))


@query(
    f"WITH {DAYS}, x AS (SELECT user_id * 100000 + event AS item_id, concat_ws(' ', event_id, kind, city, s::VARCHAR, cities) AS text FROM ro), "
    f"tok AS (SELECT item_id, unnest({TOKENS.format('text')}) AS t FROM x), post AS (SELECT item_id, t, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT item_id, len({TOKENS.format('text')}) AS dl FROM x), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), "
    "df AS (SELECT t, count(*) AS df FROM post GROUP BY t), q AS (SELECT 1 AS q, unnest(['trip', 'purchase']) AS t), "
    "b AS (SELECT q, item_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / a)))), 6) AS score FROM q JOIN post USING (t) JOIN df USING (t) JOIN dl USING (item_id), st GROUP BY q, item_id) "
    f"SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM b) WHERE rank <= 10"
)
def event_search(spark, sf_dir):
    """Search over events that are rendered as texts."""
    rows = events.events(_items(spark, sf_dir), "user_id")
    text = F.concat_ws(" ", "event_id", "kind", "city", F.col("start").cast("string"), F.array_join("cities", ","))
    texts = rows.select((F.col("user_id") * 100_000 + F.col("event")).alias("item_id"), text.alias("text"))
    return channels.ranked(channels.bm25(texts, spark.createDataFrame([(1, "trip purchase")], "q int, question string")), k=10)


@query(f"WITH {DAYS} SELECT user_id, event, row_number() OVER (PARTITION BY user_id, event ORDER BY ts, item_id) AS n, item_id FROM it JOIN ev USING (user_id, day)")
def event_members(spark, sf_dir):
    rows = events.members(_items(spark, sf_dir), "user_id")
    return render.numbered(rows, ["user_id", "event"], ["ts", "item_id"]).select("user_id", "event", "n", "item_id")


@query(f"WITH {DAYS} SELECT user_id, event, printf('%-6s %-5s %s..%s %s (%d items)', event_id, kind, s::VARCHAR, e::VARCHAR, city, item_count) AS line FROM ro")
def event_lines(spark, sf_dir):
    rows = events.events(_items(spark, sf_dir), "user_id")
    return rows.select("user_id", "event", render.event_line(rows).alias("line"))


@query(
    "WITH e AS (SELECT user_id, lower(event_type) AS entity, json_extract_string(props, '$.k') AS type, min(event_id) AS first_id FROM events GROUP BY ALL) SELECT user_id, entity, type, first_id FROM e"
)
def entity_dedupe(spark, sf_dir):
    """Entities once for each owner, by lower-case name and type, at their first item."""
    rows = base.table(spark, sf_dir, "events").select("user_id", F.lower("event_type").alias("entity"), F.get_json_object("props", "$.k").alias("type"), "event_id")
    return rows.groupBy("user_id", "entity", "type").agg(F.min("event_id").alias("first_id"))


@query(
    "SELECT count(*) AS n, count(*) FILTER (WHERE ts IS NULL OR event_id % 7 = 0) AS no_timestamp, count(*) FILTER (WHERE value < 1) AS no_value, count(*) FILTER (WHERE (event_id % 7 = 0) AND value < 1) AS neither FROM events"
)
def missing_metadata(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    no_ts, no_value = F.col("ts").isNull(), F.col("value") < 1
    return rows.agg(F.count("*").alias("n"), F.count_if(no_ts).alias("no_timestamp"), F.count_if(no_value).alias("no_value"), F.count_if(no_ts & no_value).alias("neither"))


@query("SELECT count(*) AS n, round(avg((d.doc_id IS NOT NULL)::INT), 6) AS direct, round(avg((d.doc_id IS NULL AND l.doc_id % 2 = 0)::INT), 6) AS fuzzy FROM documents l LEFT JOIN labels d USING (doc_id)")
def mapping_coverage(spark, sf_dir):
    known = base.table(spark, sf_dir, "labels").select("doc_id", F.lit("direct").alias("k"))
    rows = base.table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left")
    how = F.coalesce("k", F.when(F.col("doc_id") % 2 == 0, "fuzzy"), F.lit("none"))
    return analytics.coverage(rows.select(how.alias("how")), ("direct", "fuzzy"))


STAMPS = [(1, "2023-04-01 12:00:00"), (2, "2023-04-01 12:00"), (3, "2023-04-01T12:00:00"), (4, "2023/04/01"), (5, "taken 2023-4-1 or so"), (6, "in 2023/05"), (7, "2023-02-31"), (8, ""), (9, None)]


@query(f"SELECT id, (['2023-04-01', '2023-04-01', '2023-04-01', '2023-04-01', '2023-04-01', '2023-05-01', NULL, NULL, NULL])[id] AS day FROM {values(STAMPS, 'id, stamp')}")
def record_dates(spark, sf_dir):
    return spark.createDataFrame(STAMPS, "id int, stamp string").select("id", dates.record_date("stamp").cast("string").alias("day"))


@query(
    f"WITH {CHANNELS}, a AS (SELECT * FROM s WHERE rank <= 10), b AS (SELECT * FROM d WHERE rank <= 10) SELECT a.q, count(*) AS n, count(b.item_id) AS shared, round(count(b.item_id) / count(*)::DOUBLE, 6) AS overlap FROM a LEFT JOIN b ON a.q = b.q AND a.item_id = b.item_id GROUP BY a.q"
)
def channel_overlap(spark, sf_dir):
    a = _sparse(spark, sf_dir, 10).select("q", "item_id")
    b = base.nearest(spark, sf_dir, 10).select("q", "item_id", F.lit(1).alias("hit"))
    rows = a.join(b, ["q", "item_id"], "left").groupBy("q").agg(F.count("*").alias("n"), F.count("hit").alias("shared"))
    return rows.withColumn("overlap", F.round(F.col("shared") / F.col("n"), 6))


@query(
    "WITH s AS (SELECT user_id AS batch, event_id AS seed, ts::DATE AS s, event_type AS tag FROM events) SELECT batch, (seed % 3)::VARCHAR AS grp, min(s) AS \"start\", max(s) AS \"end\", count(*) AS days, (2 * count(*))::BIGINT AS item_count FROM s GROUP BY ALL"
)
def merge_seed_events(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("seed"), F.to_date("ts").alias("start"), F.array("event_type").alias("tags"))
    seeds = rows.withColumns({"end": F.col("start"), "days": F.lit(1), "item_count": F.lit(2)})
    groups = rows.select("batch", (F.col("seed") % 3).cast("string").alias("grp"), "seed")
    return events.merged_seeds(seeds, groups).drop("tags")


@query(
    f"WITH {CHANNELS}, f AS (SELECT s.q, s.item_id, s.rank FROM s WHERE rank <= 3), n AS (SELECT doc_id, 'content: ' || left(text, 30) || ' context: ' || source || ' keywords: ' || lang || ' tags: ' || lang || ', ' || source AS note FROM documents) SELECT q, item_id, rank, note FROM f JOIN n ON doc_id = item_id"
)
def note_documents(spark, sf_dir):
    notes = base.items(spark, sf_dir).select("item_id", render.note_text(F.left("text", F.lit(30)), F.col("source"), F.array("location"), F.array("location", "source")).alias("note"))
    return _sparse(spark, sf_dir, 3).select("q", "item_id", "rank").join(notes, "item_id")


@query()
def routed_vision_weights(spark, sf_dir):
    """Weights of each question when vision takes its share from the dense channel."""
    rows = base.asked(spark, sf_dir)
    w = fusion.adaptive_vision(fusion.STANDARD_WEIGHTS, 0.25, ask.is_visual(F.col("question")))
    return rows.select("q", *[F.round(w[k], 6).alias(k) for k in "msdv"])


# -- passage graph --------------------------------------------------------------

NAMED = "[a-z]{6,}"
WALK = 3


def _walk_sql() -> str:
    """Rounds of the walk from entities to passages and back; what sits on entities without passages returns to the seeds."""
    steps = []
    for r in range(1, WALK + 1):
        last = f"x{r - 1}"
        steps.append(
            f"l{r} AS (SELECT q, sum(v) AS lost FROM {last} WHERE kind = 'e' AND n NOT IN (SELECT e FROM de) GROUP BY q), "
            f"x{r} AS MATERIALIZED (SELECT q, kind, n, sum(v) AS v FROM ("
            f"SELECT x.q, 'p' AS kind, g.p AS n, 0.5e0 * x.v / de.d AS v FROM {last} x JOIN g ON x.kind = 'e' AND g.e = x.n JOIN de ON de.e = x.n "
            f"UNION ALL SELECT x.q, 'e', g.e, 0.5e0 * x.v / dp.d FROM {last} x JOIN g ON x.kind = 'p' AND g.p = x.n JOIN dp ON dp.p = x.n "
            f"UNION ALL SELECT s.q, 'e', s.n, s.v * (0.5e0 + 0.5e0 * coalesce(l.lost, 0)) FROM x0 s LEFT JOIN l{r} l USING (q)) GROUP BY q, kind, n)"
        )
    return (
        f"WITH g AS MATERIALIZED (SELECT conv_id || ':' || turn AS p, unnest(list_distinct(regexp_extract_all(lower(text), '{NAMED}'))) AS e FROM conversations), "
        "de AS (SELECT e, count(*) AS d FROM g GROUP BY e), dp AS (SELECT p, count(*) AS d FROM g GROUP BY p), "
        f"w AS (SELECT item_id AS q, unnest(list_distinct(regexp_extract_all(lower(text), '{NAMED}'))) AS n FROM benchmark), "
        "x0 AS MATERIALIZED (SELECT q, 'e' AS kind, n, 1e0 / count(*) OVER (PARTITION BY q) AS v FROM w), "
        + ", ".join(steps)
        + f" SELECT q, item_id, score, rank FROM (SELECT q, n AS item_id, round(v, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(v, 6) DESC, n) AS rank FROM x{WALK} WHERE kind = 'p') WHERE rank <= 10"
    )


@query(_walk_sql())
def passage_walk(spark, sf_dir):
    """The turns that a walk from a question's long words reaches, through the words that turns share."""
    from ..retrieval import graph

    names = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(NAMED), F.lit(0)))
    turns = base.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("item_id"), names("text").alias("entities"))
    seeds = base.asked(spark, sf_dir).select("q", F.explode(names("question")).alias("entity"), F.lit(1.0).alias("w"))
    return graph.walked_passages(turns, seeds, WALK, 10, digits=6)
