"""Exact fused top k over whole rankings, without ranking every item: a threshold algorithm over sorted channels.

A channel gives the first items of each question (`top`), the exact score or rank of given items (`scores`, `ranks`),
and nothing else. Lists of some depth are read from every channel. What a list has not shown yet can add no more than its
last place does, so an item in no list is at most the sum of those; where that sum is below the k-th score that
is certain already, lists need not go deeper. Questions that are not settled are asked again, four times as deep.
Then the items that can still be among the first k, by what they have and what their missing lists could add, get
their missing ranks or scores exactly, and the k best are the answer. The result equals ranking everything.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.channels import DIGITS, dense, ranked
from .dense import VectorIndex, pair_ranks, pair_scores
from .held import held
from .lexical import LexicalIndex, counted_ranks

RRF_K = 60
DEPTH = 128


class Channel(Protocol):
    def top(self, questions: DataFrame, k: int) -> DataFrame: ...

    def scores(self, pairs: DataFrame, questions: DataFrame) -> DataFrame: ...

    def ranks(self, pairs: DataFrame, questions: DataFrame) -> DataFrame: ...


@dataclass
class Stored:
    """A channel whose scores (q, item_id, score) are a table."""

    every: DataFrame

    def top(self, questions: DataFrame, k: int) -> DataFrame:
        return ranked(self.every.join(questions.select("q"), "q", "left_semi"), k=k)

    def scores(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return self.every.join(pairs.select("q", "item_id"), ["q", "item_id"], "left_semi")

    def ranks(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return counted_ranks(self.every, *held(self.scores(pairs, questions)))


@dataclass
class Lexical:
    """Questions need `question`."""

    index: LexicalIndex
    variant: str = "plus1"

    def prepared(self, questions: DataFrame) -> Channel:
        """For these questions: their scores, written once, while they have few postings."""
        every = self.index.few_scores(questions, self.variant)
        return self if every is None else Stored(every)

    def top(self, questions: DataFrame, k: int) -> DataFrame:
        return self.index.top(questions, k, self.variant)

    def scores(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return self.index.scores(pairs, questions, self.variant)

    def ranks(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return self.index.ranks(pairs, questions, self.variant)


@dataclass
class Dense:
    """Questions need `vector`."""

    index: VectorIndex

    def top(self, questions: DataFrame, k: int) -> DataFrame:
        return self.index.top(questions, k)

    def scores(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return self.index.scores(pairs, questions)

    def ranks(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return self.index.ranks(pairs, questions)


@dataclass
class Scan:
    """Vectors (item_id, vector) without an index, for questions that are asked once. Questions need `vector`."""

    items: DataFrame

    def top(self, questions: DataFrame, k: int) -> DataFrame:
        return ranked(dense(self.items, questions, k).where("score > 0"), k=k)

    def scores(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return pair_scores(self.items, pairs, questions)

    def ranks(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return pair_ranks(self.items, pairs, questions)


@dataclass
class Fixed:
    """A ranking (item_id, pos) that is the same for all questions, pos from 1 without gaps."""

    order: DataFrame

    def top(self, questions: DataFrame, k: int) -> DataFrame:
        first = self.order.where(F.col("pos") <= k).select("item_id", (-F.col("pos")).cast("double").alias("score"), F.col("pos").alias("rank"))
        return questions.select("q").join(F.broadcast(first)).select("q", "item_id", "score", "rank")  # k rows for each question

    def scores(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return pairs.join(self.order, "item_id").select("q", "item_id", (-F.col("pos")).cast("double").alias("score"))

    def ranks(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return pairs.join(self.order, "item_id").select("q", "item_id", F.col("pos").alias("rank"))


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _lists(channels: Mapping[str, Channel], questions: DataFrame, depth: int, value: str, keep: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(q, item_id, a column for each channel) of the lists, and (q, for each channel: how many it has, its first and last value)."""
    rows = ends = None
    for name, channel in channels.items():
        found, _ = held(channel.top(questions, depth))
        one = found.select("q", "item_id", *[(F.col(value) if c == name else F.lit(None)).cast("double").alias(c) for c in channels])
        rows = one if rows is None else rows.unionByName(one)
        end = found.groupBy("q").agg(F.count("*").alias(f"n_{name}"), F.max("score").alias(f"high_{name}"), F.min("score").alias(f"last_{name}"))
        ends = end if ends is None else ends.join(end, "q", "full")
    wide = rows.groupBy("q", "item_id").agg(*[F.max(c).alias(c) for c in channels])
    return (wide if keep is None else wide.join(keep, "item_id", "left_semi")), ends


def fused_top(
    channels: Mapping[str, Channel],
    questions: DataFrame,
    k: int,
    weights: Mapping[str, float],
    *,
    kind: str = "rrf",
    n_items: int = 0,
    rrf_k: int = RRF_K,
    keep: DataFrame | None = None,
    depth: int = DEPTH,
) -> DataFrame:
    """(q, item_id, score, rank): the k best of the weighted fusion of whole rankings.

    kind `rrf`: the sum of w / (rrf_k + rank); an item that a channel does not find has rank n_items + 1 there.
    kind `sum`: the sum of w * score / best score of the channel for the question; 0 where it is not found.
    `keep` (item_id): a hard filter, applied after ranking: ranks and best scores are those among all items.
    Only items that some channel finds are in the answer.
    """
    names = [c for c in channels if weights[c]]
    questions, _ = held(questions)
    channels = {c: channels[c].prepared(questions) if hasattr(channels[c], "prepared") else channels[c] for c in names}
    by_rank = kind == "rrf"
    value, digits = ("rank", DIGITS + 2) if by_rank else ("score", DIGITS)
    slack = 2 * 10**-digits

    def worth(c: str, column: Column) -> Column:
        return F.lit(weights[c]) / (rrf_k + column) if by_rank else F.lit(weights[c]) * column / F.col(f"high_{c}")

    lost = {c: F.lit(weights[c]) / (rrf_k + F.lit(n_items) + 1) if by_rank else F.lit(0.0) for c in names}
    settled, open_ = None, questions
    while True:
        wide, ends = _lists(channels, open_, depth, value, keep)
        ends = ends.withColumns({f"n_{c}": F.coalesce(f"n_{c}", F.lit(0)) for c in names})
        ends = ends.withColumns({f"whole_{c}": F.col(f"n_{c}") < depth for c in names})  # the channel has no more
        next_ = {c: F.when(F.col(f"whole_{c}"), lost[c]).otherwise(worth(c, F.lit(depth + 1) if by_rank else F.col(f"last_{c}"))) for c in names}
        ends = ends.withColumns({"unseen": _sum([next_[c] for c in names]), "whole": F.expr(" and ".join(f"whole_{c}" for c in names))})
        ends, _ = held(ends)
        rows = wide.join(ends, "q")
        rows = rows.withColumns({"least": _sum([F.coalesce(worth(c, F.col(c)), lost[c]) for c in names]), "most": _sum([F.coalesce(worth(c, F.col(c)), next_[c]) for c in names])})
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("least"), "item_id"))
        reached = F.max(F.when(F.col("place") == k, F.col("least"))).over(Window.partitionBy("q"))
        rows = rows.withColumn("place", place).withColumn("reached", F.coalesce(reached, F.lit(-1.0)))
        rows = rows.withColumn("done", F.col("whole") | (F.col("reached") > F.col("unseen") + slack))
        rows, _ = held(rows.where(F.col("done") & (F.col("most") >= F.col("reached") - slack)))
        settled = rows if settled is None else settled.unionByName(rows)
        # a filter may leave a question without rows: it is open until its lists end
        pending, _ = held(ends.where("not whole").select("q").join(rows.select("q").distinct(), "q", "left_anti"))
        if pending.isEmpty():
            break
        open_ = questions.join(pending, "q", "left_semi")
        depth *= 4
    found = settled
    for c in names:
        missing, _ = held(found.where(F.col(c).isNull() & ~F.col(f"whole_{c}")).select("q", "item_id"))
        if missing.isEmpty():
            continue
        asked = questions.join(missing.select("q").distinct(), "q", "left_semi")
        exact = channels[c].ranks(missing, asked) if by_rank else channels[c].scores(missing, asked)
        exact, few = held(exact.select("q", "item_id", F.col(value).cast("double").alias("_exact")))
        settled = settled.join(F.broadcast(exact) if few else exact, ["q", "item_id"], "left").withColumn(c, F.coalesce(F.col(c), F.col("_exact"))).drop("_exact")
    total = _sum([F.coalesce(worth(c, F.col(c)), lost[c]) for c in names])
    return ranked(settled.select("q", "item_id", F.round(total, digits).alias("score")), k=k)
