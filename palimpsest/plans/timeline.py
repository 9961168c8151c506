"""Dated items: events of each user as media, the event type as city."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics, events
from . import base
from .base import query


def _items(spark, sf_dir):
    return base.table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("item_id"), F.col("event_id").alias("item_ord"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("city"), "value", "props"
    )


DAYS = """
it AS (SELECT user_id, event_id AS item_id, ts, ts::DATE AS day, event_type AS city, value, props FROM events),
cc AS (SELECT user_id, day, city, count(*) AS n, min((ts, item_id)) AS f FROM it GROUP BY ALL),
dc AS (SELECT user_id, day, city FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, f) AS r FROM cc) WHERE r = 1),
dn AS (SELECT user_id, day, count(*) AS n FROM it GROUP BY ALL),
br AS (SELECT user_id, day, city, n, CASE WHEN lag(day) OVER w IS NULL OR day - lag(day) OVER w > 2 OR city <> lag(city) OVER w THEN 1 ELSE 0 END AS b FROM dc JOIN dn USING (user_id, day) WINDOW w AS (PARTITION BY user_id ORDER BY day)),
ev AS (SELECT user_id, day, city, n, sum(b) OVER (PARTITION BY user_id ORDER BY day)::INT AS event FROM br),
hc AS (SELECT user_id, city AS home FROM (SELECT user_id, city, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min((ts, item_id))) AS r FROM it GROUP BY user_id, city) WHERE r = 1),
ec AS (SELECT user_id, event, city FROM (SELECT user_id, event, city, row_number() OVER (PARTITION BY user_id, event ORDER BY count(*) DESC, min(day)) AS r FROM ev GROUP BY user_id, event, city) WHERE r = 1),
ro AS (
    SELECT user_id, event, printf('E%04d', event) AS event_id, CASE WHEN ec.city <> home THEN 'trip' ELSE 'event' END AS kind, min(day) AS s, max(day) AS e, count(*) AS days, ec.city AS city,
        array_to_string(list_sort(list_distinct(list(ev.city))), ',') AS cities, sum(n)::BIGINT AS item_count
    FROM ev JOIN ec USING (user_id, event) JOIN hc USING (user_id) GROUP BY user_id, event, ec.city, home
)"""


@query(f"WITH {DAYS} SELECT user_id, day, city, n, event FROM ev")
def event_islands(spark, sf_dir):
    return events.event_days(_items(spark, sf_dir), "user_id")


@query(f'WITH {DAYS} SELECT user_id, event, event_id, kind, s AS "start", e AS "end", days, city, cities, item_count FROM ro')
def event_rollup(spark, sf_dir):
    return events.events(_items(spark, sf_dir), "user_id").withColumn("cities", F.array_join("cities", ","))


@query(f"WITH {DAYS} SELECT user_id, home AS city FROM hc")
def home_city(spark, sf_dir):
    return events.home_city(_items(spark, sf_dir), "user_id")


@query(f"WITH {DAYS} SELECT kind, count(*) AS n, sum(item_count)::BIGINT AS items FROM ro GROUP BY kind")
def trip_kind(spark, sf_dir):
    return events.events(_items(spark, sf_dir), "user_id").groupBy("kind").agg(F.count("*").alias("n"), F.sum("item_count").alias("items"))


@query(f"WITH {DAYS} SELECT o.o_orderkey, ro.user_id, ro.event FROM orders o JOIN ro ON ro.user_id = o.o_custkey AND o.o_orderdate::DATE + INTERVAL 9000 DAY BETWEEN s AND e")
def range_join_events(spark, sf_dir):
    """Orders as emails of the user with their customer's number, their dates moved into the time of the events."""
    mails = base.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.date_add(F.to_date("o_orderdate"), 9000).alias("day"))
    ranges = events.events(_items(spark, sf_dir), "user_id").select("user_id", "event", "start", "end")
    return events.in_range(mails, ranges, "day", owner="user_id").select("o_orderkey", "user_id", "event")


@query(
    f"WITH {DAYS}, m AS (SELECT user_id, event, item_id, row_number() OVER (PARTITION BY user_id, event ORDER BY ts, item_id) AS r, count(*) OVER (PARTITION BY user_id, event) AS n FROM it JOIN ev USING (user_id, day)), "
    "t AS (SELECT *, greatest(1, n // 5) AS step FROM (SELECT user_id, event, item_id, r, m.n FROM m)) SELECT user_id, event, ((r - 1) // step + 1)::INT AS n, item_id FROM t WHERE (r - 1) % step = 0 AND (r - 1) // step + 1 <= 5"
)
def sample_captions(spark, sf_dir):
    return events.sampled(events.members(_items(spark, sf_dir), "user_id"), ["user_id", "event"], "item_id", ["ts", "item_id"])


@query(
    f"WITH {DAYS}, k AS (SELECT user_id, event, json_extract_string(props, '$.k') AS t, count(*) AS n, min((ts, item_id)) AS f FROM it JOIN (SELECT user_id, day, event FROM ev) USING (user_id, day) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event ORDER BY n DESC, f, t) AS r FROM k) SELECT user_id, event, string_agg(t, ',' ORDER BY r) AS tags FROM r WHERE r <= 8 GROUP BY ALL"
)
def top_tags(spark, sf_dir):
    rows = events.members(_items(spark, sf_dir), "user_id").withColumn("_k", F.struct("ts", "item_id"))
    return events.top_values(rows, ["user_id", "event"], F.get_json_object("props", "$.k"), "_k", 8, "tags").withColumn("tags", F.array_join("tags", ","))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 40 AS chunk FROM events")
def chunk_assign(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events")
    return events.chunks(rows, ["user_id"], ["ts", "event_id"], 40).select("user_id", "event_id", "chunk")


@query(
    "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) "
    "SELECT conv_id, turn, w AS \"window\" FROM (SELECT conv_id, turn, unnest(range(greatest(0, floor((r - 4) / 2.0)::BIGINT + 1), r // 2 + 1)) AS w FROM r)"
)
def window_overlap(spark, sf_dir):
    return events.overlapping_windows(base.table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 4, 2)


@query(
    "WITH g AS (SELECT conv_id, turn, role = 'assistant' AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) "
    "SELECT conv_id, turn, sum(CASE WHEN r = 1 OR NOT c THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS event FROM g"
)
def carry_over_merge(spark, sf_dir):
    rows = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("continues"))
    return events.carry_over(rows, "conv_id", ["turn"]).select("conv_id", "turn", "event")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END NULLS LAST, event_id) AS place FROM events")
def chronological_sort(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    return events.chronological(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id", "place")


@query(
    "WITH w AS (SELECT user_id, event_id, least(ceil(value)::BIGINT, 8) AS want, coalesce(sum(least(ceil(value)::BIGINT, 8)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM events) "
    "SELECT user_id, event_id, greatest(0, least(want, 64 - used))::BIGINT AS granted FROM w"
)
def frame_budget(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events").select("user_id", "event_id", F.ceil("value").cast("long").alias("frames"))
    return events.frame_budget(rows, ["user_id"], ["event_id"], 8, 64).select("user_id", "event_id", F.col("granted").cast("long").alias("granted"))


RANGES = [(1, 1, 4, "a"), (1, 3, 6, "b"), (1, 9, 10, "c"), (1, 4, 5, "d"), (2, -3, 20, "all"), (3, 5, 5, "x")]


@query()
def range_repair(spark, sf_dir):
    return events.repair_ranges(spark.createDataFrame(RANGES, "batch int, start int, end int, title string"), 1, 12)


GROUPS = [(1, 1, 1, "s1"), (1, 1, 2, "zz"), (1, 2, 1, "s1"), (1, 2, 2, "s2"), (2, 1, 1, "s4")]
SEEDS = [(1, "s1"), (1, "s2"), (1, "s3"), (2, "s4"), (2, "s5")]


@query(
    f"WITH g AS (SELECT * FROM {base.values(GROUPS, 'batch, grp, pos, seed')}), s AS (SELECT * FROM {base.values(SEEDS, 'batch, seed')}), "
    "f AS (SELECT batch, seed, min(grp)::VARCHAR AS grp FROM g JOIN s USING (batch, seed) GROUP BY ALL) SELECT batch, coalesce(grp, 'solo:' || seed) AS grp, seed FROM s LEFT JOIN f USING (batch, seed)"
)
def grouping_repair(spark, sf_dir):
    return events.repair_groups(spark.createDataFrame(GROUPS, "batch int, grp int, pos int, seed string"), spark.createDataFrame(SEEDS, "batch int, seed string"))


@query("SELECT coalesce(strftime(CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END, '%Y-%m-%d'), 'unknown') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_groups(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"))
    return analytics.by_day(rows, "ts")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s"
)
def session_gap(spark, sf_dir):
    """Sessions by inactivity, an extension; a gap of just twelve hours still belongs to the session."""
    rows = base.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 12 HOURS"), F.lit(True)).cast("int")
    marked = rows.select("user_id", "ts", "event_id", new.alias("b")).withColumn("s", F.sum("b").over(w))
    return marked.groupBy("user_id", "s").agg(F.min("ts").alias("started"), F.count("*").alias("n")).drop("s")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props(spark, sf_dir):
    return base.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
