"""Fusion of ranked channels, reranking, expansion and the like. All input is (q, item_id, score[, rank])."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channels import DIGITS, ranked

RRF_K = 60
#: Weights of metadata, sparse, dense and vision by default, and of the two tuned configurations.
DEFAULT_WEIGHTS = {"m": 0.3, "s": 0.4, "d": 0.3, "v": 0.0}
STANDARD_WEIGHTS = {"m": 0.19, "s": 0.39, "d": 0.56, "v": 0.05}
HARD_WEIGHTS = {"m": 0.11, "s": 0.28, "d": 0.72, "v": 0.12}


def _by_q(*order: Column | str):
    return Window.partitionBy("q").orderBy(*order)


def minmax(scores: DataFrame, out: str = "norm", least: float = 1e-9, slack: float = 0.0) -> DataFrame:
    """Scores of each question from 0 to 1; a range below `least` gives 0. `slack` is added to the range."""
    w = Window.partitionBy("q")
    low, high = F.min("score").over(w), F.max("score").over(w)
    value = (F.col("score") - low) / (high - low + slack)
    return scores.withColumn(out, F.when(high - low < least, F.lit(0.0)).otherwise(value))


def _wide(channels: Mapping[str, DataFrame], value: str) -> DataFrame:
    """(q, item_id, one column for each channel) by one aggregation over the union: no chain of outer joins."""
    rows = None
    for name, df in channels.items():
        part = df.select("q", "item_id", *[(F.col(value) if name == n else F.lit(None)).cast("double").alias(n) for n in channels])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("q", "item_id").agg(*[F.max(n).alias(n) for n in channels])


def rrf(channels: Mapping[str, DataFrame], weights: Mapping[str, float | Column], n_items: DataFrame | None = None, k: int = RRF_K, zero_channel: str = "constant") -> DataFrame:
    """Reciprocal rank fusion: the sum of w / (k + rank) over the channels.

    An item that a channel lacks has a rank there as well:
      `constant`  one more than the number of items (`n_items`, one row n), the same for all;
      `absent`    none, the term is 0;
    The faithful rule of ranking such items in corpus order is `rrf_positional`.
    """
    live = {n: df for n, df in channels.items() if not (isinstance(weights[n], int | float) and weights[n] == 0)}
    wide = _wide({n: df if "rank" in df.columns else ranked(df) for n, df in live.items()}, "rank")
    terms = []
    if zero_channel == "constant":
        wide = wide.crossJoin(F.broadcast(n_items.select(F.col("n").alias("_n"))))
        terms = [F.lit(weights[n]) / (k + F.coalesce(F.col(n), F.col("_n") + 1)) for n in live]
    else:
        terms = [F.coalesce(F.lit(weights[n]) / (k + F.col(n)), F.lit(0.0)) for n in live]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return wide.select("q", "item_id", F.round(total, DIGITS + 2).alias("score"))


def rrf_positional(channels: Mapping[str, DataFrame], items: DataFrame, questions: DataFrame, weights: Mapping[str, float], top: int, k: int = RRF_K) -> DataFrame:
    """(q, item_id, score) of fusion in which the items that a channel lacks are ranked after the others, in corpus order.

    All items get a rank in every channel, yet only few can matter: of the items that no channel has, the
    `top` first in the corpus rank above the rest in every channel. So the candidates of a question are the
    items some channel has and `top` others; where a channel lacks a candidate at position p, its rank is
    p plus the number of the channel's items behind p. `items` is (item_id, pos) with pos from 1 without gaps.
    """
    names = list(channels)
    rows = None
    for c in names:
        part = channels[c].select("q", "item_id", *[(F.col("rank") if n == c else F.lit(None)).cast("long").alias(n) for n in names])
        rows = part if rows is None else rows.unionByName(part)
    found = rows.groupBy("q", "item_id").agg(*[F.max(n).alias(n) for n in names]).join(items, "item_id")
    # the j-th position that no channel has is j plus the number of found items with fewer than j free positions before them
    free = found.select("q", "pos", (F.col("pos") - F.row_number().over(_by_q("pos"))).alias("free"))
    js = questions.select("q").distinct().select("q", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("j"))
    before = free.where(F.col("free") < top).groupBy("q", "free").agg(F.count("*").alias("c"))
    spot = js.join(before, (js["q"] == before["q"]) & (before["free"] < js["j"]), "left").groupBy(js["q"], "j").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    others = spot.select("q", (F.col("j") + F.col("c")).alias("pos")).join(items, "pos").select("q", "item_id", *[F.lit(None).cast("long").alias(n) for n in names], "pos")
    every = found.select("q", "item_id", *names, "pos").unionByName(others)
    upto = _by_q("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("q")
    score = F.lit(0.0)
    for n in names:
        rank = F.when(F.col(n).isNotNull(), F.col(n)).otherwise(F.col("pos") + F.count(n).over(whole) - F.count(n).over(upto))
        score = score + F.lit(weights[n]) / (k + rank)
    return every.select("q", "item_id", F.round(score, DIGITS + 2).alias("score"))


def weighted_sum(channels: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """The weighted sum of min-max scores, 0 counting as the least score of a channel that lacks items."""
    normed = {}
    for n, df in channels.items():
        w = Window.partitionBy("q")
        high = F.max("score").over(w)
        normed[n] = df.withColumn("norm", F.when(high < 1e-9, F.lit(0.0)).otherwise(F.greatest(F.col("score"), F.lit(0.0)) / high))
    wide = _wide(normed, "norm")
    total = F.lit(0.0)
    for n in channels:
        total = total + F.lit(weights[n]) * F.coalesce(F.col(n), F.lit(0.0))
    return wide.select("q", "item_id", F.round(total, DIGITS).alias("score"))


def list_rrf(lists: DataFrame, weights: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fusion of named lists (q, list_name, item_id, rank) with a weight for each name: the sum of w / (k + rank)."""
    return lists.join(weights, "list_name").groupBy("q", "item_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), DIGITS + 2).alias("score"))


def cached_list_rrf(lists: Mapping[str, DataFrame], weights: Mapping[str, float], max_k: int, k: int = RRF_K) -> DataFrame:
    """Fusion of cached lists; an item that a list lacks has rank max_k + 1 there."""
    wide = _wide(lists, "rank")
    total = F.lit(0.0)
    for n in lists:
        total = total + F.lit(weights[n]) / (k + F.coalesce(F.col(n), F.lit(max_k + 1)))
    return wide.select("q", "item_id", F.round(total, DIGITS + 2).alias("score"))


def interleave(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The two lists in turn, each item at its first place, k in all."""
    rows = first.select("q", "item_id", (F.col("rank") * 2).alias("o")).unionByName(second.select("q", "item_id", (F.col("rank") * 2 + 1).alias("o")))
    once = rows.groupBy("q", "item_id").agg(F.min("o").alias("o"))
    return once.select("q", "item_id", F.row_number().over(_by_q("o")).alias("rank")).where(F.col("rank") <= k)


def keep_first(lists: Sequence[DataFrame]) -> DataFrame:
    """The union of ranked lists: all of the first, then what the next adds, in order."""
    rows = None
    for n, df in enumerate(lists):
        part = df.select("q", "item_id", F.struct(F.lit(n).alias("l"), F.col("rank").cast("int").alias("r")).alias("o"))
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy("q", "item_id").agg(F.min("o").alias("o"))
    return once.select("q", "item_id", F.row_number().over(_by_q("o", "item_id")).alias("rank"))


def alpha_hybrid(sparse: DataFrame, cosine: DataFrame, alpha: float) -> DataFrame:
    """alpha * normalised sparse score + (1 - alpha) * cosine; the range of the former has a millionth added."""
    wide = _wide({"s": minmax(sparse, least=0.0, slack=1e-6).withColumn("value", F.col("norm")), "c": cosine.withColumn("value", F.col("score"))}, "value")
    score = alpha * F.coalesce(F.col("s"), F.lit(0.0)) + (1 - alpha) * F.coalesce(F.col("c"), F.lit(0.0))
    return wide.select("q", "item_id", F.round(score, DIGITS).alias("score"))


def rerank(first: DataFrame, scores: DataFrame, pool: int) -> DataFrame:
    """The first `pool` places by new score, ties in old order; the tail as it was."""
    rows = first.join(scores.select("q", "item_id", F.col("score").alias("new")), ["q", "item_id"], "left")
    inside = F.col("rank") <= pool
    order = [F.desc(inside), F.desc(F.when(inside, F.coalesce("new", F.lit(0.0)))), F.col("rank")]
    return rows.select("q", "item_id", F.row_number().over(_by_q(*order)).alias("rank"))


def overlap_scores(pairs: DataFrame, q_tokens: str = "q_tokens", item_tokens: str = "item_tokens") -> DataFrame:
    """A reranker without a model: the share of the question's distinct tokens that the item has."""
    want = F.array_distinct(F.col(q_tokens))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(want, F.col(item_tokens))), F.size(want)), F.lit(0.0))
    return pairs.select("q", "item_id", F.round(share, DIGITS).alias("score"))


def low_confidence(lists: DataFrame, questions: DataFrame, least_top: float = 0.01, least_found: int = 3) -> DataFrame:
    """(q, low): whether a result is empty, its best score is small, or fewer than three items score at all."""
    stats = lists.groupBy("q").agg(F.max("score").alias("best"), F.count_if(F.col("score") > 1e-9).alias("n"))
    low = F.col("best").isNull() | (F.col("best") < least_top) | (F.col("n") < least_found)
    return questions.select("q").join(stats, "q", "left").select("q", low.alias("low"))


def expand(primary: DataFrame, extra: DataFrame, gate: DataFrame, k: int) -> DataFrame:
    """The primary list, and behind it the extra list where the gate is low."""
    more = extra.join(gate.where("low").select("q"), "q", "left_semi")
    return keep_first([primary, more]).where(F.col("rank") <= k)


def inject_vision(weights: Mapping[str, Column], vision: Column, visual: Column) -> dict[str, Column]:
    """Weights in which vision takes its share from all others, where the question is visual."""
    share = F.when(visual, vision).otherwise(F.lit(0.0))
    return {n: w * (1 - share) for n, w in weights.items()} | {"v": share}


def adaptive_vision(weights: Mapping[str, float], visual_weight: float, visual: Column) -> dict[str, Column]:
    """Vision's weight where the question is visual; the difference comes from the dense channel, not below 0."""
    v = F.when(visual, F.lit(visual_weight)).otherwise(F.lit(weights["v"]))
    d = F.when(visual, F.lit(max(0.0, weights["d"] - (visual_weight - weights["v"])))).otherwise(F.lit(weights["d"]))
    return {"m": F.lit(weights["m"]), "s": F.lit(weights["s"]), "d": d, "v": v}


def modality_fallback(lists: DataFrame, other: DataFrame, kinds: DataFrame, kind: str = "email", share: float = 0.95, top: int = 10) -> DataFrame:
    """The other list for questions whose first `top` places are nearly all of one kind."""
    head = lists.where(F.col("rank") <= top).join(kinds, "item_id", "left")
    full = head.groupBy("q").agg(F.avg((F.col("kind") == kind).cast("double")).alias("s")).where(F.col("s") >= share).select("q")
    mine = lists.select("q", "item_id", "rank").join(full, "q", "left_anti")
    return mine.unionByName(other.select("q", "item_id", "rank").join(full, "q", "left_semi"))


def cascade(coarse: DataFrame, fine: DataFrame, pool: int, k: int) -> DataFrame:
    """The best of a coarse pool by a fine score."""
    kept = coarse.where(F.col("rank") <= pool).select("q", "item_id").join(fine, ["q", "item_id"], "left")
    return ranked(kept.select("q", "item_id", F.coalesce("score", F.lit(0.0)).alias("score")), k=k)


def linked(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Hits, then the items that they link to, in order of the hit; each once. links: (src, dst)."""
    direct = hits.select("q", "item_id", F.col("rank").cast("long").alias("o"), F.lit(False).alias("linked"))
    one = hits.join(links, hits["item_id"] == links["src"]).select("q", F.col("dst").alias("item_id"), (F.col("rank") + F.lit(1 << 32)).alias("o"), F.lit(True).alias("linked"))
    once = direct.unionByName(one).groupBy("q", "item_id").agg(F.min(F.struct("o", "linked")).alias("x"))
    return once.select("q", "item_id", "x.linked", F.row_number().over(_by_q("x.o", "item_id")).alias("rank"))


def needle_pool(gold: DataFrame, retrieved: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(q, item_id, is_gold, place): pools of k items that hold all gold items.

    More gold than k: gold alone. Else the first k retrieved, of which as many of the lowest without gold go
    as gold items are missing; these are added. Nothing retrieved: gold alone. Places are by a hash.
    """
    want = gold.select("q", "item_id").distinct()
    n_gold = want.groupBy("q").agg(F.count("*").alias("n_gold"))
    head = retrieved.where(F.col("rank") <= k).select("q", "item_id", "rank")
    head = head.join(want.withColumn("g", F.lit(True)), ["q", "item_id"], "left").join(n_gold, "q").where(F.col("n_gold") <= k)
    got = head.groupBy("q").agg(F.count_if("g").alias("got"))
    plain = head.where("g is null").withColumn("from_last", F.row_number().over(_by_q(F.desc("rank"))))
    plain = plain.join(got, "q").where(F.col("from_last") > F.col("n_gold") - F.col("got")).select("q", "item_id", F.lit(False).alias("is_gold"))
    pool = want.select("q", "item_id", F.lit(True).alias("is_gold")).unionByName(plain)
    order = F.xxhash64(F.lit(seed), F.lit(k), F.col("q"), F.col("item_id"))
    return pool.withColumn("place", F.row_number().over(_by_q(order, "item_id")))


def needle_valid(pool: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(q, n, valid): whether a pool has all gold, no item twice, and k items if the gold fits."""
    want = gold.select("q", "item_id").distinct()
    missing = want.join(pool, ["q", "item_id"], "left_anti").groupBy("q").agg(F.count("*").alias("missing"))
    size = pool.groupBy("q").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("d"))
    n_gold = want.groupBy("q").agg(F.count("*").alias("n_gold"))
    rows = n_gold.join(size, "q", "left").join(missing, "q", "left")
    fits = F.when(F.col("n_gold") <= k, F.col("n") <= k).otherwise(F.col("n") == F.col("n_gold"))
    return rows.select("q", F.coalesce("n", F.lit(0)).alias("n"), (F.col("missing").isNull() & (F.col("n") == F.col("d")) & fits).alias("valid"))
