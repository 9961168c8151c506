"""Search for fusion weights: rank vectors are kept once, and each pass over them weighs many settings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fusion import RRF_K, _wide
from ..operators.links import stored

#: What recall at each depth counts in the aim of a search.
AIM = {1: 0.2, 5: 0.2, 10: 0.3, 25: 0.2, 50: 0.1}
#: Settings that a batch is weighed by at once, and settings of one pass.
BLOCK, PASS = 64, 4096
SHARES = 1024
#: Items of a question that are read before they are compared, and items that are compared at once.
READ, COMPARED = 1 << 13, 256


def normal(weights: np.ndarray) -> tuple[float, ...]:
    """Weights that are not negative and sum to one, of four digits."""
    w = np.clip(weights, 0.0, None)
    w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
    return tuple(float(x) for x in np.round(w, 4))


def _band(ranks: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the items with fewer than `depth` others that come before them under any weights: no rank worse, and the smaller id."""
    codes = np.unique(ids, return_inverse=True)[1].astype(np.float64)
    order = np.lexsort((codes, ranks.sum(1)))  # what is before an item under any weights comes first
    rows = np.column_stack([ranks, codes])[order]
    kept, places = rows[:0], []
    for at in range(0, len(rows), COMPARED):
        part = rows[at : at + COMPARED]
        before = np.full(len(part), -1)  # each item is counted once with itself
        for others in (kept, part):
            hit = np.ones((len(part), len(others)), bool)
            for c in range(rows.shape[1]):
                hit &= others[:, c] <= part[:, c, None]
            before += hit.sum(1)
        some = before < depth
        kept = np.concatenate([kept, part[some]])
        places.append(order[at : at + COMPARED][some])
    return np.concatenate(places) if places else order


def _bands(depth: int):
    """The band of each question, from rows (q, item_id, r) that have the rows of a question together; a task holds one band and READ rows."""

    def of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        width = len(whole.column("r")[0])
        ranks = np.asarray(whole.column("r").flatten(), np.float64).reshape(-1, width)
        return whole.take(pa.array(np.sort(_band(ranks, whole.column("item_id").to_numpy(zero_copy_only=False), depth))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, parts = None, []
        for batch in batches:
            names = batch.column("q").to_pylist()
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(names)], strict=True):
                if parts and names[start] != q:
                    yield of(parts)
                    parts = []
                q = names[start]
                parts.append(batch.slice(start, end - start))
                if len(parts) > 1 and sum(p.num_rows for p in parts[1:]) >= READ:
                    parts = [of(parts)]
        if parts:
            yield of(parts)

    return cut


def _ahead(settings: np.ndarray, k: int):
    """Counts, in each batch and for each aim, the rivals that come before it under each setting."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            aim = np.asarray(batch.column("aim"))
            codes, place = np.unique(aim, return_inverse=True)
            width = settings.shape[1]
            mine, rival = (1.0 / (k + np.asarray(batch.column(c).flatten(), np.float64).reshape(-1, width)) for c in ("mine", "rival"))
            first = np.asarray(batch.column("first").to_numpy(zero_copy_only=False), bool)
            out = np.zeros((len(codes), len(settings)), np.int64)
            for at in range(0, len(settings), BLOCK):
                ws = settings[at : at + BLOCK]
                scores = [sum(np.outer(side[:, c], ws[:, c]) for c in range(width)) for side in (mine, rival)]
                a, b = (np.rint(s * 1e8) for s in scores)
                np.add.at(out[:, at : at + BLOCK], place, (b > a) | ((b == a) & first[:, None]))
            where, setting = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(codes[where]), pa.array(setting.astype(np.int32)), pa.array(out[where, setting])], ["aim", "config", "ahead"])

    return count


@dataclass(frozen=True)
class Found:
    """A setting with its aim and its recalls."""

    weights: dict[str, float]
    value: float
    recalls: dict[int, float]


class WeightSearch:
    """Weights of reciprocal rank fusion that recall the gold items best.

    lists: (q, item_id, rank) for each channel; gold: (q, item_id), questions without gold don't count. A list that lacks an item
    gives it the rank n_items + 1; a gold item of no list is not found. Equal scores, of eight digits, go to the smaller
    item_id. Weights are not negative.

    Only the depths of the aim count. An item that as many others as the largest depth come before under any weights is within no
    depth, so it is left out, in each task and then for each question; of what comes before an item that is within a depth, all
    is kept. What is left of a question does not grow with its lists, but with their logarithm where channels are independent.

    A gold item's rank is one more than the items before it, so nothing is sorted. What is kept for it are the rank vectors of its
    rivals: an item that is behind it in all channels and has the larger id never passes it and is left out; one that is before it
    in all and has the smaller id always does and is only counted. That depends on no weights, so all settings of all
    passes read one table, and a pass costs the same scan for one setting as for many.
    """

    def __init__(self, lists: Mapping[str, DataFrame], gold: DataFrame, n_items: int, k: int = RRF_K, aim: Mapping[int, float] = AIM):
        self.names, self.k, self.aim = list(lists), k, dict(aim)
        wide = _wide(lists, "rank")
        ranks = F.array(*[F.coalesce(F.col(n), F.lit(float(n_items + 1))) for n in self.names])
        wide = wide.select("q", "item_id", ranks.alias("r"))
        gold = gold.select("q", "item_id").where("q is not null and item_id is not null").distinct()
        wide = wide.join(gold.select("q").distinct(), "q", "left_semi")
        bands = _bands(max(self.aim))
        wide = stored(wide.repartition("q", "item_id").sortWithinPartitions("q").mapInArrow(bands, wide.schema), "near")
        wide = stored(wide.repartition("q").sortWithinPartitions("q").mapInArrow(bands, wide.schema), "bands")
        aims = gold.join(wide, ["q", "item_id"], "left").select("q", F.col("item_id").alias("g"), F.col("r").alias("mine"))
        aims = stored(aims.withColumn("aim", F.monotonically_increasing_id()), "aims")
        seen = aims.where("mine is not null")
        pairs = wide.join(seen, "q").where("item_id <> g").withColumnRenamed("r", "rival").withColumn("first", F.col("item_id") < F.col("g"))
        each = range(len(self.names))
        behind = reduce(and_, [F.col("rival")[c] >= F.col("mine")[c] for c in each])
        before = reduce(and_, [F.col("rival")[c] <= F.col("mine")[c] for c in each])
        rivals = pairs.select("aim", "q", "mine", "rival", "first", (before & F.col("first")).alias("always")).where(~(behind & ~F.col("first")))
        rivals = stored(rivals, "rivals")
        always = rivals.where("always").groupBy("aim").agg(F.count("*").alias("always"))
        self.aims = stored(aims.join(always, "aim", "left").select("aim", "q", F.col("mine").isNotNull().alias("listed"), F.coalesce("always", F.lit(0)).alias("always")), "aims")
        self.rivals = rivals.where("not always").select("aim", "q", "mine", "rival", "first")

    def table(self, settings: Sequence[Sequence[float]], share: float = 1.0) -> DataFrame:
        """(config, n, recall_<depth>...): mean recalls of each setting, by its place; share: of the questions, by a hash."""
        if len(settings) > PASS:
            raise ValueError(f"one pass weighs {PASS} settings")
        spark = self.aims.sparkSession
        some = F.pmod(F.xxhash64("q"), F.lit(SHARES)) < max(1, round(share * SHARES))
        matrix = np.asarray(settings, np.float64).reshape(len(settings), len(self.names))
        counts = self.rivals.where(some).select("aim", "mine", "rival", "first").mapInArrow(_ahead(matrix, self.k), "aim long, config int, ahead long")
        counts = counts.groupBy("aim", "config").agg(F.sum("ahead").alias("ahead"))
        configs = spark.range(len(settings)).select(F.col("id").cast("int").alias("config"))
        aims = self.aims.where(some)
        rows = aims.crossJoin(F.broadcast(configs)).join(counts, ["aim", "config"], "left")
        rank = F.when(F.col("listed"), 1 + F.col("always") + F.coalesce("ahead", F.lit(0)))
        per = rows.groupBy("config", "q").agg(*[(F.count_if(rank <= d) / F.count("*")).alias(f"recall_{d}") for d in self.aim])
        return per.groupBy("config").agg(F.count("*").alias("n"), *[F.round(F.avg(f"recall_{d}"), 6).alias(f"recall_{d}") for d in self.aim])

    def evaluate(self, settings: Sequence[Sequence[float]], share: float = 1.0) -> list[Found]:
        """Each setting with its values, in the given order; without a question all are zero."""
        rows = {r["config"]: r for at in range(0, len(settings), PASS) for r in self._shifted(settings, at, share)}
        out = []
        for i, s in enumerate(settings):
            recalls = {d: rows[i][f"recall_{d}"] if i in rows else 0.0 for d in self.aim}
            out.append(Found(dict(zip(self.names, s, strict=True)), round(sum(self.aim[d] * r for d, r in recalls.items()), 9), recalls))
        return out

    def _shifted(self, settings, at: int, share: float) -> list[dict]:
        return [{**r.asDict(), "config": r["config"] + at} for r in self.table(settings[at : at + PASS], share).collect()]

    def best(self, settings: Sequence[Sequence[float]], share: float = 1.0) -> Found:
        """The first of the best settings."""
        return max(self.evaluate(settings, share), key=lambda f: f.value)

    def grid(self, steps: int = 10) -> list[tuple[float, ...]]:
        """All settings whose weights are multiples of 1 / steps and sum to one."""

        def parts(left: int, places: int):
            if places == 1:
                yield (left,)
            else:
                for x in range(left + 1):
                    yield from ((x, *rest) for rest in parts(left - x, places - 1))

        return [tuple(x / steps for x in p) for p in parts(steps, len(self.names))]

    def drawn(self, n: int, seed: int) -> list[tuple[float, ...]]:
        """Random settings, spread evenly over all that sum to one."""
        return [normal(w) for w in np.random.default_rng(seed).dirichlet(np.ones(len(self.names)), n)]

    def halve(self, settings: Sequence[Sequence[float]], start: float = 0.25) -> Found:
        """Successive halving: the better half of the settings goes on to twice the questions; the last pass asks all."""
        left, share = list(settings), start
        while share < 1.0 and len(left) > 1:
            found = self.evaluate(left, share)
            order = sorted(range(len(left)), key=lambda i: (-found[i].value, i))
            left, share = [left[i] for i in sorted(order[: (len(left) + 1) // 2])], share * 2
        return self.best(left)

    def evolve(self, seed: int = 42, population: int = 24, generations: int = 6, start: Sequence[Sequence[float]] = ()) -> Found:
        """Differential evolution: each generation of settings is weighed in one pass, and a child that is not worse replaces its parent."""
        if population < 4:
            raise ValueError("a generation needs four settings")
        rng = np.random.default_rng(seed)
        now = [*map(tuple, start), *self.drawn(population, seed)][: max(population, len(start))]
        found = self.evaluate(now)
        for _ in range(generations):
            top = now[max(range(len(now)), key=lambda i: found[i].value)]
            children = []
            for i, parent in enumerate(now):
                b, c = rng.choice([j for j in range(len(now)) if j != i], 2, replace=False)
                moved = np.add(parent, 0.5 * np.subtract(top, parent) + 0.7 * np.subtract(now[b], now[c]))
                kept = rng.random(len(parent)) < 0.8
                children.append(normal(np.where(kept, moved, parent)))
            tried = self.evaluate(children)
            for i, (old, new) in enumerate(zip(found, tried, strict=True)):
                if new.value >= old.value:
                    now[i], found[i] = children[i], new
        return max(found, key=lambda f: f.value)
