"""Indexes in folders, whole-ranking fusion and the retriever, held against scoring everything."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import channels, fusion
from palimpsest.operators import query as ask
from palimpsest.plans import base
from palimpsest.retrieval import dense, fused, lexical
from palimpsest.retrieval.dense import VectorIndex
from palimpsest.retrieval.lexical import LexicalIndex
from palimpsest.retrieval.retriever import Metadata, Retriever, arrow_scorer


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("q", "item_id", "score", "rank"))).collect())


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return base.items(spark, sf).select("item_id", "text"), base.asked(spark, sf)


@pytest.fixture(scope="module")
def index(corpus):
    return LexicalIndex.build(corpus[0])


@pytest.mark.parametrize("variant", ["plus1", "okapi"])
def test_lexical_top_equals_scoring_everything(corpus, index, variant):
    items, asked = corpus
    full = channels.bm25(items, asked, variant)
    for prune in (None, True):
        assert rows(index.top(asked, 10, variant, prune=prune)) == rows(channels.ranked(full, k=10))
    assert rows(index.all_scores(asked, variant), "q", "item_id", "score") == rows(full, "q", "item_id", "score")


def test_few_blocks_bring_candidates(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 16)
    rng = np.random.default_rng(1)
    texts = [" ".join(["the"] * int(rng.integers(1, 9)) + [f"w{int(x)}" for x in rng.zipf(1.6, 20)]) for _ in range(2000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    asked = spark.createDataFrame([(1, "the w7 w120"), (2, "the w3"), (3, "nothing here"), (4, "the"), (5, None)], "q long, question string")
    index = LexicalIndex.build(items)
    assert index.segments[0].bits == 7
    assert rows(index.top(asked, 10, prune=True)) == rows(channels.ranked(channels.bm25(items, asked), k=10))
    read, every = index.blocks_read(asked.where("q < 4"), 10)
    assert read < every / 2


def test_ranks_are_counted(corpus, index):
    items, asked = corpus
    every = channels.ranked(channels.bm25(items, asked))
    some = every.where("rank in (1, 2, 50, 130) or item_id % 37 = 0").select("q", "item_id", "rank")
    missing = asked.select("q", F.lit(-5).cast("long").alias("item_id"))
    assert rows(index.ranks(some.select("q", "item_id").unionByName(missing), asked), "q", "item_id", "rank") == rows(some, "q", "item_id", "rank")


def test_batches_equal_a_fresh_build(spark, corpus, tmp_path):
    items, asked = corpus
    path = f"file://{tmp_path}/index"
    parts = [items.where(f"item_id % 3 = {k}") for k in range(3)]
    index = LexicalIndex.build(parts[0], path, "a")
    assert index.add(parts[1], "b") and index.add(parts[2].limit(0), "empty")
    before = index.version
    assert not index.add(parts[1], "b") and index.version == before  # a batch that is run again
    other = LexicalIndex(spark, path)  # another reader, who then writes
    assert other.add(parts[2], "c") and len(other.segments) == 4 and len(index.segments) == 3
    for variant in ("plus1", "okapi"):
        assert rows(other.top(asked, 7, variant, prune=variant == "plus1")) == rows(channels.ranked(channels.bm25(items, asked, variant), k=7))
    scores = rows(other.all_scores(asked), "q", "item_id", "score")
    other.compact()
    assert len(other.segments) == 1 and other.segments[0].batches == ("a", "b", "empty", "c") and not other.add(parts[2], "c")
    assert rows(LexicalIndex(spark, path).all_scores(asked), "q", "item_id", "score") == scores
    assert rows(other.top(asked, 7)) == rows(channels.ranked(channels.bm25(items, asked), k=7))


def test_an_empty_index_has_no_hits(corpus):
    items, asked = corpus
    empty = LexicalIndex.build(items.limit(0))
    assert empty.top(asked, 3).collect() == [] and empty.all_scores(asked).collect() == []


def test_a_stream_fills_the_index(spark, corpus, tmp_path):
    from palimpsest.streaming.timeline import index_stream

    items, asked = corpus
    for k in range(3):
        items.where(f"item_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("item_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        index_stream(stream, f"file://{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination()
    index = LexicalIndex(spark, f"file://{tmp_path}/index")
    assert len(index.segments) == 3
    assert rows(index.top(asked, 5)) == rows(channels.ranked(channels.bm25(items, asked), k=5))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 5
    v = [(k, [float(x) for x in centres[k % 20] + rng.normal(size=16)]) for k in range(3000)]
    v += [(5000 + k, v[7][1]) for k in range(40)] + [(9000, None)]  # equal vectors
    q = [(k, [float(x) for x in centres[k] + rng.normal(size=16)]) for k in range(12)] + [(50, v[7][1]), (51, None)]
    return spark.createDataFrame(v, "item_id long, vector array<double>"), spark.createDataFrame(q, "q long, vector array<double>")


def test_dense_equals_brute_force_and_reads_few_cells(clustered):
    items, asked = clustered
    index = VectorIndex.build(items, cells=20)
    every = channels.ranked(channels.dense(items, asked, 10**6).where("score > 0"))
    for q in asked.where("q in (3, 50)").collect():
        index.read = [0, 0]
        mine = asked.where(F.col("q") == q["q"])
        assert rows(index.top(mine, 10)) == rows(every.where((F.col("q") == q["q"]) & (F.col("rank") <= 10)))
        assert index.read[0] < index.read[1]
    assert rows(index.top(asked, 10)) == rows(every.where("rank <= 10"))
    some = every.where("rank in (1, 11, 30, 400) or item_id % 97 = 0").select("q", "item_id", "rank")
    assert rows(index.ranks(some.select("q", "item_id"), asked), "q", "item_id", "rank") == rows(some, "q", "item_id", "rank")


def test_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "a b b c."), (3, "x y z"), (4, ""), (5, None)], "item_id long, text string")
    got = {r["item_id"]: r["v"] for r in df.select("item_id", dense.hashed(F.col("text"), 64).alias("v")).collect()}
    assert got[1] == got[2] and got[4] is None and got[5] is None
    assert abs(sum(x * x for x in got[3]) - 1) < 1e-12 and abs(sum(a * b for a, b in zip(got[1], got[3], strict=True))) < 0.9


@pytest.mark.parametrize("depth", [2, 128])
def test_fusion_equals_ranking_everything(spark, sf, corpus, index, depth):
    items, asked = corpus
    vectors, asking = base.item_vectors(spark, sf), base.question_vectors(spark, sf)
    asked = asked.where("q < 12")
    both = asked.join(asking, "q", "left")
    chan = {"s": fused.Lexical(index), "d": fused.Dense(VectorIndex.build(vectors))}
    s = channels.ranked(channels.bm25(items, asked))
    d = channels.ranked(channels.dense(vectors, asking.where("q < 12"), 10**6).where("score > 0"))
    n = items.count()
    w = {"s": 0.4, "d": 0.6}
    whole = fusion.rrf({"s": s, "d": d}, w, spark.createDataFrame([(n,)], "n long"))
    keep = items.where("item_id % 5 = 1").select("item_id")
    assert rows(fused.fused_top(chan, both, 10, w, n_items=n, depth=depth)) == rows(channels.ranked(whole, k=10))
    assert rows(fused.fused_top(chan, both, 10, w, n_items=n, depth=depth, keep=keep)) == rows(channels.ranked(whole.join(keep, "item_id", "left_semi"), k=10))
    sums = fusion.weighted_sum({"s": s.drop("rank"), "d": d.drop("rank")}, w)
    assert rows(fused.fused_top(chan, both, 10, w, kind="sum", depth=depth)) == rows(channels.ranked(sums, k=10))


@pytest.fixture(scope="module")
def album(spark):
    places = ["Porto", "Kyoto", "Lima", None]
    words = ["dinner", "receipt", "beach", "museum", "photo", "train", "cake", "total"]
    rng = np.random.default_rng(9)
    made = [(k, " ".join(rng.choice(words, 6)), f"2024-{k % 12 + 1:02d}-{k % 27 + 1:02d}" if k % 7 else None, places[k % 4]) for k in range(400)]
    items = spark.createDataFrame(made, "item_id long, text string, date string, location string").withColumn("date", F.to_date("date"))
    asked = spark.createDataFrame(
        [(1, "How much was the dinner receipt total on 2024-03-04"), (2, "help me find the photo of a beach, I remember a cake"), (3, "the train in Porto"), (4, "museum photo 2024-05-02 in Kyoto"), (5, "zzz")],
        "q long, question string",
    )
    return items, asked


def test_retriever_fuses_three_channels(spark, album):
    items, asked = album
    encoder = lambda c: dense.hashed(c, 32)
    it = Retriever.fit(items, encoder=encoder)
    c = ask.with_constraints(asked)
    m = channels.ranked(channels.metadata(items, c).select("q", "item_id", "score"))
    s = channels.ranked(channels.bm25(items, asked, "okapi"))
    d = channels.ranked(channels.dense(items.select("item_id", encoder(F.col("text")).alias("vector")), asked.select("q", encoder(F.col("question")).alias("vector")), 10**6).where("score > 0"))
    w = {"m": 0.3, "s": 0.4, "d": 0.3}
    whole = fusion.rrf({"m": m, "s": s, "d": d}, w, spark.createDataFrame([(400,)], "n long"))
    assert rows(it.retrieve(asked, 8, weights=w)) == rows(channels.ranked(whole, k=8))
    fit = whole.join(items, "item_id").join(c.select("q", "start", "end"), "q").where(channels.passes_date(F.col("date"), F.col("start"), F.col("end")))
    assert rows(it.retrieve(asked, 8, weights=w, filter_mode="hard")) == rows(channels.ranked(fit.select("q", "item_id", "score"), k=8))
    some = m.where("rank in (1, 5, 60)").select("q", "item_id", "rank")
    assert rows(Metadata(items).ranks(some.select("q", "item_id"), c), "q", "item_id", "rank") == rows(some, "q", "item_id", "rank")


def test_routes_gate_and_reranker(album):
    items, asked = album
    it = Retriever.fit(items, encoder=lambda c: dense.hashed(c, 32))
    signals = ask.with_signals(asked).withColumn("strategy", ask.hard_route())
    strategy = {r["q"]: r["strategy"] for r in signals.collect()}
    got = it.routed(asked, 6)
    assert {r["q"]: r["strategy"] for r in got.collect()} == {q: s for q, s in strategy.items() if q != 5}  # of the last nothing is found
    assert strategy[1].startswith("META") and strategy[2] == "DENSE_ONLY"
    fit = channels.bm25(items, asked.where("q = 1"), "okapi").join(items, "item_id").join(signals.select("q", "start", "end"), "q")
    fit = channels.ranked(fit.where(channels.passes_date(F.col("date"), F.col("start"), F.col("end"))).select("q", "item_id", "score"), k=6)
    assert rows(got.where("q = 1"), "q", "item_id", "rank") == rows(fit, "q", "item_id", "rank")
    first = it.dense.top(it._asked(asked).where("q = 2"), 6)
    assert rows(got.where("q = 2"), "q", "item_id", "rank") == rows(first, "q", "item_id", "rank")
    low = it.routed(asked.where("q = 2"), 100, primary=2, expand=30, least_found=3)  # two found: what the words find follows
    merged = fusion.keep_first([it.dense.top(it._asked(asked).where("q = 2"), 2), it.lexical.top(asked.where("q = 2"), 30, "okapi")]).where("rank <= 30")
    assert rows(low, "q", "item_id", "rank") == rows(merged, "q", "item_id", "rank")
    longest = arrow_scorer(lambda question, text: pc.utf8_length(text))
    again = {(r["q"], r["item_id"]): r["rank"] for r in it.routed(asked, 5, scorer=longest, pool=5).collect()}
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    mine = [i for (q, i), _ in sorted(again.items(), key=lambda x: x[1]) if q == 2]
    assert [len(texts[i]) for i in mine] == sorted((len(texts[i]) for i in mine), reverse=True)
    assert isinstance(pa.array([1]), pa.Array)


def test_adaptive_weights_are_used(spark, album):
    items, asked = album
    it = Retriever.fit(items, encoder=lambda c: dense.hashed(c, 32))
    weights = {r["q"]: r for r in ask.with_adaptive_weights(ask.with_signals(asked)).collect()}
    got = it.adaptive(asked, 5)
    for q in (2, 3):
        w = {"m": weights[q]["w_m"], "s": weights[q]["w_s"], "d": weights[q]["w_d"]}
        assert rows(got.where(F.col("q") == q)) == rows(it.retrieve(asked.where(F.col("q") == q), 5, weights=w, filter_mode=weights[q]["filter_mode"]))


def test_pruning_that_leaves_much_scans_instead(spark, monkeypatch):
    """Blocks, candidates and pairs beyond what is sent: the rows stay, and no posting is shuffled."""
    rng = random.Random(12)
    items = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 30)))) for i in range(600)], "item_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(60)}" for _ in range(6))) for q in range(8)], "q long, question string")
    monkeypatch.setattr(lexical, "BUCKET_ITEMS", 100)
    index = lexical.LexicalIndex.build(items)
    assert index.segments[0].buckets == 6
    best = {tuple(r) for r in channels.ranked(channels.bm25(items, asked), k=5).collect()}
    every = channels.bm25(items, asked)
    some = every.where("item_id % 3 = 0").select("q", "item_id")
    want = {tuple(r) for r in every.where("item_id % 3 = 0").collect()}
    held = lexical.held
    for rows in (lexical.HELD_ROWS, 60):
        monkeypatch.setattr(lexical, "HELD_ROWS", rows)
        monkeypatch.setattr(lexical, "held", lambda df, rows=rows: held(df, rows))
        assert {tuple(r) for r in index.top(asked, 5, prune=True).collect()} == best
        scores = index.scores(some, asked)
        assert {tuple(r) for r in scores.collect()} == want
        if rows > 60:
            found = index.scores(some.limit(9), asked)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in found and "hashpartitioning(term" not in found
