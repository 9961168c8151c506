"""Run analytics: line items as usage of agents, orders as questions, events as ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, traces
from . import base
from .base import query, values


@query(
    "SELECT l_returnflag AS agent, count(*) AS n, sum(l_quantity) AS tokens, round(avg(l_quantity), 1) AS mean_tokens, sum(CASE WHEN l_linenumber > 3 THEN NULL ELSE l_quantity END) AS cached FROM lineitem GROUP BY l_returnflag"
)
def usage_rollup(spark, sf_dir):
    rows = base.table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("agent")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("tokens"), F.round(F.avg("l_quantity"), 1).alias("mean_tokens"), F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_quantity"))).alias("cached")
    )


RUNS = "SELECT l_orderkey AS run, l_linenumber * 1000 + l_quantity::BIGINT AS pos, l_quantity::BIGINT AS total FROM lineitem"


@query(
    f"WITH r AS ({RUNS}), s AS (SELECT *, coalesce(lag(total) OVER (PARTITION BY run ORDER BY pos) > total, false) AS fall FROM r), "
    "k AS (SELECT run, count(*) >= 2 AND NOT bool_or(fall) AND sum(total) > 1.2e0 * max(total) AS running, max(total) AS top, sum(DISTINCT total) AS each FROM s GROUP BY run) SELECT run, (CASE WHEN running THEN top ELSE each END)::BIGINT AS total FROM k"
)
def usage_cumulative_detect(spark, sf_dir):
    rows = base.table(spark, sf_dir, "lineitem")
    total = F.col("l_quantity").cast("long")
    records = rows.select(
        F.col("l_orderkey").alias("run"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).cast("long").alias("pos"), F.lit(None).cast("string").alias("group_id"), total.alias("total"),
        *[F.lit(None).cast("long").alias(c) for c in ("input", "output", "cache_read", "cache_creation", "uncached")], F.lit(None).cast("double").alias("cost"),
    )
    return analytics.usage_totals(records, ["run"]).select("run", "total")


PRICES = [("R", 3.0, 0.3, 15.0), ("A", 1.0, 0.1, 5.0), ("N", 2.0, 0.2, 8.0)]


@query(
    f"WITH p AS (SELECT f, i::DOUBLE AS i, c::DOUBLE AS c, o::DOUBLE AS o FROM {values(PRICES, 'f, i, c, o')}) SELECT l_orderkey AS q, round(sum((l_quantity * i + l_extendedprice * c + l_tax * o) / 1e6), 10) AS cost FROM lineitem JOIN p ON f = l_returnflag GROUP BY l_orderkey"
)
def cost_per_question(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "l_returnflag string, input double, cache_read double, output double")
    rows = base.table(spark, sf_dir, "lineitem").join(F.broadcast(prices), "l_returnflag")  # a given list of prices
    cost = analytics.token_cost(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"), {k: F.col(k) for k in ("input", "cache_read", "output")})
    return rows.groupBy(F.col("l_orderkey").alias("q")).agg(F.round(F.sum(cost), 10).alias("cost"))


@query(
    "SELECT l_suppkey AS q, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, max(l_quantity) AS largest, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_suppkey"
)
def replicate_stats(spark, sf_dir):
    return analytics.replicate_stats(base.table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "q"), ["q"], "l_quantity")


@query("WITH s AS (SELECT l_suppkey, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY l_suppkey) SELECT round(median(sd), 6) AS median_sd, count(*) AS n FROM s")
def median_variance(spark, sf_dir):
    rows = base.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.stddev_samp("l_quantity").alias("sd"))
    return rows.agg(F.round(F.median("sd"), 6).alias("median_sd"), F.count("*").alias("n"))


@query(
    "SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(DISTINCT user_id) AS owners, round(sum(value), 4) AS total, round(avg((value > 10)::INT), 6) AS rate FROM events"
)
def ingest_stats(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events")
    return rows.agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_distinct("user_id").alias("owners"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("rate"),
    )


@query(
    "WITH a AS (SELECT o_custkey AS key, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS key, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) "
    "SELECT coalesce(a.key, b.key) AS key, a.v AS \"left\", b.v AS \"right\", round(b.v - a.v, 6) AS delta FROM a FULL JOIN b ON a.key = b.key"
)
def full_outer_compare(spark, sf_dir):
    """Two runs: customers' orders with even, and with odd keys."""
    rows = base.table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey"))
    part = lambda r: rows.where(F.col("o_orderkey") % 2 == r).groupBy("key").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return analytics.compare_runs(part(0), part(1), "key", "v")


MODEL_PRICES = [("Customer#0", 1.0), ("Customer#00", 2.0), ("Customer#000000", 3.0), ("Customer#0000001", 4.0), ("x", 9.0)]


@query(
    f"WITH p AS (SELECT prefix, rate::DOUBLE AS rate FROM {values(MODEL_PRICES, 'prefix, rate')}), m AS (SELECT c_custkey, c_name AS model, prefix, rate, row_number() OVER (PARTITION BY c_name ORDER BY length(prefix) DESC) AS r FROM customer JOIN p ON starts_with(c_name, prefix)) SELECT c_custkey, prefix, rate FROM m WHERE r = 1"
)
def prefix_pricing(spark, sf_dir):
    prices = spark.createDataFrame(MODEL_PRICES, "prefix string, rate double")
    models = base.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("model"))
    return analytics.price_of(models, prices).select("c_custkey", "prefix", "rate")


@query(
    "WITH s AS (SELECT l_linenumber AS config, l_returnflag AS split, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY ALL), w AS (SELECT config, max(v) FILTER (WHERE split = 'A') AS A, max(v) FILTER (WHERE split = 'N') AS N, max(v) FILTER (WHERE split = 'R') AS R FROM s GROUP BY config), "
    "m AS (SELECT *, round((coalesce(A, 0) + coalesce(N, 0) + coalesce(R, 0)) / nullif((A IS NOT NULL)::INT + (N IS NOT NULL)::INT + (R IS NOT NULL)::INT, 0)::DOUBLE, 6) AS mean FROM w) SELECT config, A, N, R, mean, round(mean - (SELECT mean FROM m WHERE config = 1), 6) AS delta FROM m"
)
def pivot_by_split(spark, sf_dir):
    scores = base.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("config"), F.col("l_returnflag").alias("split")).agg(F.round(F.avg("l_discount"), 6).alias("v"))
    return analytics.pivot_splits(scores, ("A", "N", "R"), "v", 1)


@query(
    "SELECT n_name AS nation, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"
)
def agent_totals(spark, sf_dir):
    orders, customers, nations = (base.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, customers["c_nationkey"] == nations["n_nationkey"])
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 0 THEN 'surfaced' ELSE 'missed' END AS bucket, count(*) AS n FROM labels GROUP BY 1")
def access_buckets(spark, sf_dir):
    rows = base.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("right"), (F.col("toxic") == 0).alias("shown"))
    return rows.groupBy(analytics.access_buckets(rows, "", "shown", "right").alias("bucket")).agg(F.count("*").alias("n"))


SWEEPS = ["sweep_hard_rrf_m0.1_s0.3_d0.6_soft", "sweep_full_weighted_sum_m0_s1_d0_hard", "other"]


@query()
def sweep_names(spark, sf_dir):
    from ..sources.records import sweep_parameters

    return spark.createDataFrame([(s,) for s in SWEEPS], "name string").withColumn("p", sweep_parameters(F.col("name"))).select("name", "p.split", "p.fusion", "p.m", "p.s", "p.d", "p.filter")


TRACES = [
    ("r1", "stream", 1, '{"type": "assistant", "message": {"id": "a", "usage": {"input_tokens": 10, "output_tokens": 2}}}'),
    ("r1", "stream", 2, '{"type": "assistant", "message": {"id": "a", "usage": {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 90}}}'),
    ("r1", "stream", 3, '{"type": "result", "result": "Porto", "usage": {"input_tokens": true, "output_tokens": 1}}'),
    ("r2", "items", 1, '{"item": {"type": "agent_message", "text": "first"}}'),
    ("r2", "items", 2, '{"item": {"type": "agent_message", "text": "{\\"answer\\": \\"Lisbon\\", \\"evidence_ids\\": [\\"email1\\"]}"}, "usage": {"prompt_tokens": 7, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 4}}}'),
    ("r3", "messages", 1, "not json"),
]


def _traces(spark):
    return spark.createDataFrame(TRACES, "run string, format string, pos long, json string")


@query()
def trace_answers(spark, sf_dir):
    found = traces.final_answers(_traces(spark), ["run"]).withColumn("s", traces.structured_answer(F.col("answer")))
    return found.select("run", "s.answer", F.array_join("s.evidence_ids", ",").alias("evidence_ids"))


@query()
def trace_usage(spark, sf_dir):
    return analytics.usage_totals(traces.usage_records(_traces(spark), ["run"]), ["run"])


CALLS = [("r1", "python search.py dinner"), ("r1", "show E0001"), ("r1", "grep -r x ."), ("r2", "ls")]


@query(
    f"SELECT run, count(*) FILTER (WHERE regexp_matches(lower(command), '\\bsearch(\\.py)?\\b')) AS searches, count(*) FILTER (WHERE regexp_matches(lower(command), '\\bshow\\b')) AS shows, "
    f"count(*) FILTER (WHERE regexp_matches(lower(command), '^\\s*(cat|grep|rg|head|tail|sed|jq)\\b')) AS scans FROM {values(CALLS, 'run, command')} GROUP BY run"
)
def tool_calls(spark, sf_dir):
    return traces.tool_calls(spark.createDataFrame(CALLS, "run string, command string"), ["run"])


USAGES = [(1, '{"input_tokens": 5, "output_tokens": 2}'), (2, '{"promptTokens": 3, "total": 9}'), (3, '{"input": -1}'), (4, None), (5, '{"cached_tokens": 4, "cost": 0.5}')]


@query()
def usage_canonical(spark, sf_dir):
    from ..functions.jsonx import canonical_usage

    return spark.createDataFrame(USAGES, "id int, usage string").withColumn("u", canonical_usage(F.col("usage"))).select("id", "u.*")


