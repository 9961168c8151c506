"""Analytics over runs: sweeps, usage, cost, replicates, comparisons, ingestion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a usage record.
USAGE_FIELDS = ("input", "output", "total", "cache_read", "cache_creation", "uncached", "cost")


def sweep(wide: DataFrame, configs: DataFrame, k: int, n_items: DataFrame, top: int) -> DataFrame:
    """(config, q, item_id, score, rank): fused lists of every weight configuration in one job.

    wide: (q, item_id, m, s, d) ranks, null where a channel lacks the item. configs: (config, w_m, w_s, w_d), a
    table of a bounded number of settings, so each candidate meets each of them.
    """
    rows = wide.crossJoin(F.broadcast(n_items.select(F.col("n").alias("_n")))).crossJoin(F.broadcast(configs))
    score = F.lit(0.0)
    for c in "msd":
        score = score + F.col(f"w_{c}") / (k + F.coalesce(F.col(c), F.col("_n") + 1))
    out = rows.select("config", "q", "item_id", F.round(score, 8).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("config", "q").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= top)


def best_config(scores: DataFrame, value: str, config: str = "config") -> DataFrame:
    """The configuration with the largest value; the smallest name of equals."""
    return scores.agg(F.min_by(config, F.struct(-F.col(value), F.col(config))).alias(config), F.max(value).alias(value))


def pivot_splits(scores: DataFrame, splits: Sequence[str], value: str, baseline: str, config: str = "config", split: str = "split") -> DataFrame:
    """(config, value of each split, mean, delta): configurations by split, and what they gain over a baseline."""
    wide = scores.groupBy(config).pivot(split, list(splits)).agg(F.first(value))
    both = F.filter(F.array(*splits), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.size(both).cast("double"))
    wide = wide.withColumn("mean", F.round(mean, 6))
    base = wide.where(F.col(config) == baseline).select(F.col("mean").alias("_b"))
    return wide.join(F.broadcast(base), how="left").select("*", F.round(F.col("mean") - F.col("_b"), 6).alias("delta")).drop("_b")


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right, delta) of two runs, with what only one of them has."""
    return a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full").withColumn("delta", F.round(F.col("right") - F.col("left"), 6))


def impact(pairs: DataFrame, kind: str | None = None, edge: float = 1e-9) -> DataFrame:
    """Improved, degraded and unchanged counts with mean gain and loss, from (before, after), for all or by kind."""
    d = F.col("after") - F.col("before")
    rows = pairs.withColumn("_d", d)
    up, down = F.col("_d") > edge, F.col("_d") < -edge
    aggs = [
        F.count("*").alias("n"), F.count_if(up).alias("improved"), F.count_if(down).alias("degraded"), F.count_if(~up & ~down).alias("unchanged"),
        F.round(F.coalesce(F.avg(F.when(up, F.col("_d"))), F.lit(0.0)), 6).alias("mean_gain"), F.round(F.coalesce(F.avg(F.when(down, F.col("_d"))), F.lit(0.0)), 6).alias("mean_loss"),
    ]
    return rows.groupBy(*([kind] if kind else [])).agg(*aggs)


def error_buckets(pairs: DataFrame, a: str, b: str, edge: float = 0.0) -> Column:
    """both, only a, only b, or neither, by whether each score is above the edge."""
    x, y = F.col(a) > edge, F.col(b) > edge
    return F.when(x & y, "both").when(x, f"{a}_only").when(y, f"{b}_only").otherwise("neither")


def histogram(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n, percent)."""
    n = rows.groupBy(kind).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def usage_totals(records: DataFrame, keys: Sequence[str], group: str = "group_id", order: str = "pos") -> DataFrame:
    """(keys, usage fields, records): usage of each run from its records.

    Of records with one group id that with the largest total counts, the last of equals. Of the others, if
    their totals never fall and their sum is over 1.2 times the largest, they are running totals and the
    largest counts alone; else each different record counts once. Sums are null if no record has the field.
    """
    keys = list(keys)
    named = records.where(F.col(group).isNotNull())
    best = named.groupBy(*keys, group).agg(F.max_by(F.struct(*USAGE_FIELDS), F.struct(F.coalesce("total", F.lit(-1)), order)).alias("u"))
    loose = records.where(F.col(group).isNull())
    w = Window.partitionBy(*keys).orderBy(order)
    steps = loose.where("total is not null").withColumn("_fall", F.coalesce(F.lag("total").over(w) > F.col("total"), F.lit(False)))
    shape = steps.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.col("_fall").cast("int")).alias("_falls"), F.sum("total").alias("_sum"), F.max("total").alias("_max"))
    running = (F.col("_n") >= 2) & (F.col("_falls") == 0) & (F.col("_sum") > 1.2 * F.col("_max"))
    shape = shape.select(*keys, running.alias("_running"))
    loose = loose.join(shape, keys, "left").withColumn("_running", F.coalesce("_running", F.lit(False)))
    last = loose.where("_running and total is not null").groupBy(*keys).agg(F.max_by(F.struct(*USAGE_FIELDS), F.struct("total", order)).alias("u"))
    single = loose.where("not _running").groupBy(*keys, "input", "output", "total", "cost").agg(F.min_by(F.struct(*USAGE_FIELDS), order).alias("u"))
    rows = best.select(*keys, "u.*").unionByName(last.select(*keys, "u.*")).unionByName(single.select(*keys, "u.*"))
    return rows.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in USAGE_FIELDS], F.count("*").alias("records"))


def price_of(models: DataFrame, prices: DataFrame, model: str = "model", prefix: str = "prefix") -> DataFrame:
    """Models with the price of their longest prefix. The price list is small and given, so it is what goes to the tasks; every prefix of a model is looked up."""
    cut = models.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.length(model)), lambda k: F.left(F.col(model), k))).alias(prefix)).join(F.broadcast(prices), prefix)
    w = Window.partitionBy(model).orderBy(F.desc(F.length(prefix)))
    return cut.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def token_cost(uncached: Column, cached: Column, output: Column, rates: Mapping[str, Column]) -> Column:
    """Dollars for tokens, by rates for a million."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (zero(uncached) * rates["input"] + zero(cached) * rates["cache_read"] + zero(output) * rates["output"]) / 1e6


def replicate_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, largest and sample deviation over replicates."""
    c = F.col(value)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"), F.max(c).alias("largest"), F.round(F.stddev_samp(c), 6).alias("sd"))


def access_buckets(rows: DataFrame, answer: str, evidence: str, correct: str) -> Column:
    """correct, surfaced (the evidence was shown but the answer is wrong) or missed."""
    return F.when(F.col(correct), "correct").when(F.col(evidence), "surfaced").otherwise("missed")


def by_day(rows: DataFrame, ts: str) -> DataFrame:
    """(day, n), rows without a date under unknown."""
    return rows.groupBy(F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown")).alias("day")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, kinds: Sequence[str], how: str = "how") -> DataFrame:
    """The share of rows that were mapped in each way."""
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg((F.col(how) == k).cast("double")), 6).alias(k) for k in kinds])
