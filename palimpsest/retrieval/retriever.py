"""One call from questions to the fused, routed or reranked first k items.

A `Retriever` is fitted on items (item_id, text and, if they are there, date and location). It keeps a lexical index, a
vector index of given vectors or of an encoder's, and optionally a second vector index for images. Questions are a table
(q, question and, without an encoder, vector). All methods take all questions at once and return (q, item_id, score, rank).

    retrieve   weighted fusion of whole rankings (`fused.fused_top`), with or without a metadata channel and a hard date filter
    routed     one strategy a question by its signals, a confidence gate that adds what the other channels find, reranking
    adaptive   fusion by weights that follow each question's signals, hard or soft by question

Strategies with a metadata filter keep items whose date is unknown or within the question's range. A gate that is still low
after an expansion stays as it is: a further round would ask the same channels for the same items.

Defined results
    null question    has no terms; it can be answered by its vector
    no vector        the question has no dense hits
    no constraint    the metadata channel has no rows for the question
    repeated q       must not be
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import channels, fusion
from ..operators import query as ask
from . import fused
from .dense import VectorIndex
from .held import held
from .lexical import LexicalIndex

Encoder = Callable[[Column], Column]


@dataclass
class Metadata:
    """The metadata channel. Questions need start, end and locations."""

    items: DataFrame

    def _all(self, questions: DataFrame) -> DataFrame:
        return channels.metadata(self.items, questions.select("q", "start", "end", "locations")).select("q", "item_id", "score")

    def top(self, questions: DataFrame, k: int) -> DataFrame:
        return channels.ranked(self._all(questions), k=k)

    def scores(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        return self._all(questions).join(pairs, ["q", "item_id"], "left_semi")

    def ranks(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        """Scores have few values: an item's rank is the number of items of better values and of those of its own up to it."""
        every = self._all(questions)
        mine = every.join(pairs, ["q", "item_id"], "left_semi")
        better = every.groupBy("q", "score").agg(F.count("*").alias("n"))
        ahead = better.alias("b").join(better.alias("o"), "q").where("o.score > b.score").groupBy("q", F.col("b.score").alias("score")).agg(F.sum("o.n").alias("ahead"))
        same = mine.alias("m").join(every.alias("e"), ["q", "score"]).where("e.item_id <= m.item_id").groupBy("q", "score", F.col("m.item_id").alias("item_id")).agg(F.count("*").alias("own"))
        return same.join(ahead, ["q", "score"], "left").select("q", "item_id", (F.col("own") + F.coalesce("ahead", F.lit(0))).alias("rank"))


def arrow_scorer(score: Callable[[pa.Array, pa.Array], pa.Array]) -> Callable[[Column, Column], Column]:
    """A reranker's hook: a function of Arrow arrays of questions and texts that gives their scores, batch by batch."""

    def run(questions: pa.Array, texts: pa.Array) -> pa.Array:
        return score(questions, texts).cast(pa.float64())

    return F.arrow_udf(run, "double")


class Retriever:
    def __init__(self, items: DataFrame, lexical: LexicalIndex, dense: VectorIndex | None = None, vision: VectorIndex | None = None, encoder: Encoder | None = None):
        self.items, self.lexical, self.dense, self.vision, self.encoder = items, lexical, dense, vision, encoder

    @classmethod
    def fit(cls, items: DataFrame, *, vectors: DataFrame | None = None, encoder: Encoder | None = None, images: DataFrame | None = None) -> Retriever:
        """`vectors` and `images` are (item_id, vector). With an `encoder`, texts and questions are encoded by it instead."""
        if encoder is not None:
            vectors = items.select("item_id", encoder(F.col("text")).alias("vector"))
        made = [None if v is None else VectorIndex.build(v) for v in (vectors, images)]
        return cls(items, LexicalIndex.build(items), *made, encoder)

    @property
    def _dated(self) -> DataFrame:
        have = self.items.columns
        date, place = (F.col(c) if c in have else F.lit(None) for c in ("date", "location"))
        return self.items.select("item_id", date.cast("date").alias("date"), place.cast("string").alias("location"))

    def _asked(self, questions: DataFrame) -> DataFrame:
        if self.encoder is not None:
            questions = questions.drop("vector").withColumn("vector", self.encoder(F.col("question")))
        return held(questions)[0]

    def _channels(self, variant: str = "okapi") -> dict[str, fused.Channel]:
        out: dict[str, fused.Channel] = {"m": Metadata(self._dated), "s": fused.Lexical(self.lexical, variant)}
        if self.dense is not None:
            out["d"] = fused.Dense(self.dense)
        if self.vision is not None:
            out["v"] = fused.Dense(self.vision)
        return out

    def _masked(self, channel: fused.Channel, questions: DataFrame, k: int) -> DataFrame:
        """The first k of a channel among items that pass the question's dates: lists grow until they hold k of them or end."""
        settled, depth, days = None, 4 * k, self._dated.select("item_id", "date")
        while True:
            found, _ = held(channel.top(questions, depth))
            dates = questions.select("q", "start", "end")
            fit = found.join(days, "item_id").join(dates, "q").where(channels.passes_date(F.col("date"), F.col("start"), F.col("end")))
            sizes = found.groupBy("q").agg(F.count("*").alias("n")).join(fit.groupBy("q").agg(F.count("*").alias("fit")), "q", "left")
            open_, _ = held(sizes.where((F.col("n") >= depth) & (F.coalesce("fit", F.lit(0)) < k)).select("q"))
            good = fit.join(open_, "q", "left_anti").select("q", "item_id", "score")
            settled = good if settled is None else settled.unionByName(good)
            if open_.isEmpty():
                return channels.ranked(settled, k=k)
            questions, depth = questions.join(open_, "q", "left_semi"), depth * 4

    def _fused(self, asked: DataFrame, k: int, weights: Mapping[str, float], kind: str, variant: str, hard: bool) -> DataFrame:
        live = {n: c for n, c in self._channels(variant).items() if weights.get(n)}
        if not hard:
            return fused.fused_top(live, asked, k, weights, kind=kind, n_items=self.lexical.n)
        whole = _Fused(live, weights, kind, self.lexical.n)
        return self._masked(whole, asked, k)

    def retrieve(self, questions: DataFrame, k: int, *, weights: Mapping[str, float] = fusion.DEFAULT_WEIGHTS, kind: str = "rrf", filter_mode: str = "soft", variant: str = "okapi") -> DataFrame:
        """Fusion of whole rankings. filter_mode `hard` drops items outside of the question's dates, after ranking."""
        asked = self._asked(ask.with_constraints(questions))
        return self._fused(asked, k, weights, kind, variant, filter_mode == "hard")

    def routed(self, questions: DataFrame, k: int, *, primary: int = 50, expand: int = 100, weights: Mapping[str, float] = fusion.DEFAULT_WEIGHTS, least_top: float = 0.01, least_found: int = 3, scorer=None, pool: int = 20) -> DataFrame:
        """(q, item_id, rank, strategy): by strategy, the gate, and a scorer of (question, text) columns for the first `pool`."""
        asked = self._asked(ask.with_signals(questions).withColumn("strategy", ask.hard_route()))
        chan = self._channels()
        lexical, dense = chan["s"], chan.get("d", chan["s"])
        of = lambda *names: asked.where(F.col("strategy").isin(*names))
        hybrid = lambda rows, n: self._fused(rows, n, weights, "rrf", "okapi", False)
        parts = [
            lexical.top(of("BM25_ONLY"), primary),
            dense.top(of("DENSE_ONLY"), primary),
            self._masked(lexical, of("META_THEN_BM25"), primary),
            self._masked(dense, of("META_THEN_DENSE"), primary),
            hybrid(of("FULL_HYBRID"), primary),
        ]
        first = parts[0]
        for p in parts[1:]:
            first = first.unionByName(p)
        first, _ = held(first)
        low, _ = held(fusion.low_confidence(first, asked, least_top, least_found).where("low").join(asked, "q"))
        more = lambda *names: low.where(F.col("strategy").isin(*names))
        meta = ("META_THEN_BM25", "META_THEN_DENSE")
        extra = [dense.top(more("BM25_ONLY"), expand), lexical.top(more("DENSE_ONLY", *meta), expand), hybrid(more("FULL_HYBRID"), expand)]
        behind = [dense.top(more(*meta), expand)]  # after what the lexical channel adds
        lists = [first.select("q", "item_id", "rank"), extra[0].unionByName(extra[1]).unionByName(extra[2]).select("q", "item_id", "rank"), behind[0].select("q", "item_id", "rank")]
        merged = fusion.keep_first(lists).where(F.col("rank") <= F.greatest(F.lit(expand), F.lit(primary)))
        if scorer is not None:
            merged, _ = held(merged)
            merged = self.reranked(asked, merged, scorer, pool)
        return merged.where(F.col("rank") <= k).join(asked.select("q", "strategy"), "q").select("q", "item_id", "rank", "strategy")

    def reranked(self, questions: DataFrame, first: DataFrame, scorer: Callable[[Column, Column], Column], pool: int) -> DataFrame:
        """`first` (q, item_id, rank) with its first `pool` by the scorer of (question, text)."""
        head = first.where(F.col("rank") <= pool).select("q", "item_id")
        texts = head.join(self.items.select("item_id", "text"), "item_id").join(questions.select("q", "question"), "q")
        scores = texts.select("q", "item_id", F.round(scorer(F.col("question"), F.col("text")), channels.DIGITS).alias("score"))
        return fusion.rerank(first, scores, pool)

    def adaptive(self, questions: DataFrame, k: int, *, hard_set: bool = False) -> DataFrame:
        """(q, item_id, score, rank, strategy): questions of one strategy share their weights and are answered together."""
        signals = ask.with_signals(questions)
        asked = self._asked((ask.with_hard_weights if hard_set else ask.with_adaptive_weights)(signals))
        out = None
        for s in asked.select("strategy", "w_m", "w_s", "w_d", "filter_mode").distinct().collect():  # a row a rule of the router
            mine = asked.where((F.col("strategy") == s["strategy"]) & (F.col("filter_mode") == s["filter_mode"]))
            found = self._fused(mine, k, {"m": s["w_m"], "s": s["w_s"], "d": s["w_d"]}, "rrf", "okapi", s["filter_mode"] == "hard")
            found = found.withColumn("strategy", F.lit(s["strategy"]))
            out = found if out is None else out.unionByName(found)
        if out is None:
            raise ValueError("no questions")
        return out


@dataclass
class _Fused:
    """A fusion as a channel, whose lists can be asked for deeper and deeper."""

    channels: Mapping[str, fused.Channel]
    weights: Mapping[str, float]
    kind: str
    n_items: int

    def top(self, questions: DataFrame, k: int) -> DataFrame:
        return fused.fused_top(self.channels, questions, k, self.weights, kind=self.kind, n_items=self.n_items)
