import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vectors as vx
from palimpsest.operators import channels, evaluate, fusion
from palimpsest.operators import query as ask
from palimpsest.plans import base, retrieval

GAZETTEER = ["Porto", "Lisbon", "Tokyo", "Cambridge"]
ITEMS = [
    (1, "email00021", "2023-03-20", "", "hotel booking confirmation, two nights in Lisbon"),
    (2, "20230401_120000", "2023-04-01", "Lisbon, Portugal", "hotel lobby; travel, hotel"),
    (3, "20230402_180000", "2023-04-02", "Porto, Portugal", "dinner with Grace; food, family"),
    (4, "20221225_140000", "2022-12-25", "Cambridge, UK", "Christmas dinner; holiday, food"),
    (5, "20231001_100000", "2023-10-01", "Tokyo, Japan", "ramen shop; travel, food"),
]


@pytest.fixture(scope="module")
def items(spark):
    rows = spark.createDataFrame(ITEMS, "item_id long, name string, date string, location string, body string")
    return rows.select("item_id", "name", F.to_date("date").alias("date"), "location", F.concat_ws(" ", "body", "date", "location").alias("text")).cache()


def search(spark, items, question, hard=False, how="rrf"):
    asked = ask.with_constraints(spark.createDataFrame([(1, question)], "q long, question string"), gazetteer=GAZETTEER)
    found = {"m": channels.ranked(channels.metadata(items, asked, hard=hard)), "s": channels.ranked(channels.bm25(items, asked))}
    n = items.agg(F.count("*").alias("n"))
    out = fusion.rrf(found, fusion.DEFAULT_WEIGHTS, n) if how == "rrf" else fusion.weighted_sum(found, fusion.DEFAULT_WEIGHTS)
    if hard:
        keep = items.join(F.broadcast(asked)).where(channels.passes_date(F.col("date"), F.col("start"), F.col("end"))).select("q", "item_id")
        out = out.join(keep, ["q", "item_id"], "left_semi")
    return [r.name for r in channels.ranked(out).join(items, "item_id").orderBy("rank").collect()]


def test_keywords_find_the_item(spark, items):
    assert search(spark, items, "Where did I have dinner with Grace?")[0] == "20230402_180000"


def test_soft_filter_prefers_what_fits(spark, items):
    assert "20230402_180000" in search(spark, items, "Show photos from April 2023 in Porto")[:2]


def test_hard_filter_excludes(spark, items):
    names = search(spark, items, "Show photos from December 2022 in Cambridge", hard=True)
    assert names[0] == "20221225_140000" and not [n for n in names if n.startswith("2023")]


@pytest.mark.parametrize("how", ["rrf", "weighted_sum"])
def test_both_fusions_agree_on_the_first(spark, items, how):
    assert search(spark, items, "Where did I have ramen in Tokyo?", how=how)[0] == "20231001_100000"


def test_empty_corpus(spark, items):
    assert search(spark, items.limit(0), "anything at all") == []


CASES = [
    ("What happened in 2023?", "2023-01-01", "2023-12-31", None),
    ("photos of April 2023", "2023-04-01", "2023-04-30", None),
    ("on 2023-04-02 please", "2023-04-02", "2023-04-02", None),
    ("Today is 2024-01-15. What now?", "2024-01-15", "2024-01-15", "2024-01-15"),
    ("on 2023-13-02 or 2021", None, None, None),
    ("February 2024", "2024-02-01", "2024-02-29", None),
    ("", None, None, None),
]


def test_question_dates(spark):
    rows = ask.with_constraints(spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "q long, question string")).collect()
    text = lambda d: None if d is None else str(d)
    assert {r.q: (text(r.start), text(r.end), text(r.today)) for r in rows} == {k: c[1:] for k, c in enumerate(CASES)}


def test_gazetteer_and_capitals(spark):
    df = spark.createDataFrame([("Dinner in Porto with Grace in May",)], "question string")
    assert ask.with_constraints(df, gazetteer=GAZETTEER).first().locations == ["porto"]
    assert ask.with_constraints(df).first().locations == ["porto", "grace"]


def test_ranks_are_permutations_and_ignore_scale(spark):
    rng = random.Random(1)
    rows = [(q, i, round(rng.random(), 1)) for q in range(4) for i in range(20)]
    df = spark.createDataFrame(rows, "q long, item_id long, score double")
    ranks = channels.ranked(df)
    assert all(sorted(r["rank"] for r in ranks.where(F.col("q") == q).collect()) == list(range(1, 21)) for q in range(4))
    n = spark.createDataFrame([(20,)], "n long")
    one, two = (fusion.rrf({"s": d}, {"s": 1.0}, n) for d in (df, df.withColumn("score", F.col("score") * 7)))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


def test_positional_fusion_equals_the_dense_form(spark):
    rng = random.Random(2)
    for _ in range(3):
        n, top = 30, 6
        ranks = {c: dict(zip(rng.sample(range(1, n + 1), rng.randrange(1, 12)), range(1, 40))) for c in "sd"}
        score = {}
        for i in range(1, n + 1):
            total = 0.0
            for c, w in (("s", 0.4), ("d", 0.6)):
                lacking = [j for j in range(1, n + 1) if j not in ranks[c]]
                total += w / (60 + (ranks[c].get(i) or len(ranks[c]) + lacking.index(i) + 1))
            score[i] = round(total, 8)
        want = sorted(score, key=lambda i: (-score[i], i))[:top]
        frames = {c: spark.createDataFrame([(1, i, r) for i, r in ranks[c].items()], "q long, item_id long, rank int") for c in "sd"}
        items = spark.createDataFrame([(i, i) for i in range(1, n + 1)], "item_id long, pos long")
        got = fusion.rrf_positional(frames, items, spark.createDataFrame([(1,)], "q long"), {"s": 0.4, "d": 0.6}, top)
        assert [r.item_id for r in channels.ranked(got, k=top).orderBy("rank").collect()] == want


def test_dense_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, vector array<float>")
    asked = df.where("item_id < 9").withColumnRenamed("item_id", "q")
    one, two = ({tuple(r) for r in channels.ranked(channels.dense(df, asked, 5, block=b), k=5).collect()} for b in (4096, 4))
    assert one == two and len(one) == 45
    assert channels.dense(df, asked.limit(0), 5).count() == 0


@pytest.mark.parametrize("batch", (7, 10000))
def test_own_items_take_no_place_however_often_they_come(spark, tmp_path, batch):
    """Thirteen rows of each id in one task, two of them with other vectors, and a row without an id: all of the ten best others are there."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(45, 8))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)  # an item is nearest to itself
    rows = [(i, (v[i] if c else -v[i]).tolist()) for c in range(12) for i in range(45)] + [(i, (v[i] * 1.01).tolist()) for i in range(45)] + [(None, v[0].tolist())]
    ids, matrix = [i for i, _ in rows], np.array([x for _, x in rows], np.float64)
    spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set()
    for q in (0, 20, 40):
        pairs = [(float(np.round(matrix[a] @ matrix[b], 6)) + 0.0, ids[b]) for a in range(len(ids)) if ids[a] == q for b in range(len(ids)) if ids[b] not in (q, None)]
        want |= {(q, i, s, rank) for rank, (s, i) in enumerate(sorted(pairs, key=lambda p: (-p[0], p[1]))[:10], 1)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = retrieval.dense_topk_exclude_self(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 30 and {tuple(r) for r in got} == want


def test_searches_compare_all_rows_with_every_twentieth(spark, tmp_path):
    """The questions are all ids divisible by 20; the items are all rows, in whatever file."""
    v = np.random.default_rng(6).normal(size=(700, 3)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = v.astype(np.float64)
    both = np.concatenate((v, v * v), axis=1)
    both /= np.linalg.norm(both, axis=1)[:, None]
    for run, matrix, own in ((retrieval.dense_topk_exclude_self, v, False), (retrieval.dual_embedding_topk, both, True)):
        want = {(q, i) for q in range(0, 700, 20) for i in sorted((i for i in range(700) if own or i != q), key=lambda i: (-np.round(matrix[q] @ matrix[i], 6), i))[:10]}
        got = {(r.q, r.item_id) for r in run(spark, str(tmp_path)).collect()}
        assert got == want and {i for _, i in got if i % 20}


def test_recall_rises_and_ignores_repeats(spark):
    gold = spark.createDataFrame([(1, 5), (1, 6), (1, 5), (2, 9)], "q long, item_id long")
    ranked = evaluate.deduplicated(spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 7, 3), (1, 6, 4)], "q long, item_id long, rank int"))
    asked = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    rows = {r.q: r for r in evaluate.recall_at(ranked, gold, asked, (1, 2, 3, 10)).collect()}
    assert [rows[1][f"recall_{k}"] for k in (1, 2, 3, 10)] == [0.5, 0.5, 1.0, 1.0] and rows[3].n_gold == 0 and rows[3].recall_10 == 0
    assert {r.q for r in evaluate.recall_at(ranked, gold, asked, (1,), empty_gold="skip").collect()} == {1, 2}


def test_needle_pools(spark):
    gold = spark.createDataFrame([(1, 100), (1, 3), (2, 7), *((3, i) for i in range(9))], "q long, item_id long")
    found = spark.createDataFrame([(1, i, i) for i in range(1, 8)], "q long, item_id long, rank int")
    pool = fusion.needle_pool(gold, found, 5)
    got = {q: {r.item_id for r in pool.where(F.col("q") == q).collect()} for q in (1, 2, 3)}
    assert got == {1: {1, 2, 3, 4, 100}, 2: {7}, 3: set(range(9))}
    assert all(r.valid for r in fusion.needle_valid(pool, gold, 5).collect())


def test_contained_texts_by_runs_of_words(spark):
    rows = spark.createDataFrame([(1, "xx one two three four five six seven yy"), (2, "one two three four five seven six"), (3, "a tiny text")], "item_id long, text string")
    asked = spark.createDataFrame([(10, "one two three four five six seven"), (11, "tiny")], "q long, question string")
    assert {tuple(r) for r in base.contained(rows, asked).collect()} == {(10, 1), (11, 3)}


def test_contained_texts_stay_where_they_are(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "xx one two three four five six seven yy"), (2, "one two three four five seven six"), (3, "a tiny text"), (None, "no id")], "item_id long, text string")
    asked = spark.createDataFrame([(10, "one two three four five six seven"), (11, "tiny"), (12, None)], "q long, question string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that Spark does not send by itself
    try:
        found = base.contained(rows, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and not re.search(r"Exchange hashpartitioning\((item_id|_key)#\d+L, \d+\), ENSURE", plan)
        sent = {tuple(r) for r in found.collect()}
        monkeypatch.setattr(base, "SENT_QUESTIONS", 2)
        assert "SortMergeJoin" in base.contained(rows, asked)._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in base.contained(rows, asked).collect()} == sent == {(10, 1), (11, 3)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_gold_is_found_once(spark, sf):
    found = base.gold(spark, sf)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in base.contained(base.items(spark, sf), base.asked(spark, sf)).collect()}


def test_rerank_and_fallback(spark):
    first = spark.createDataFrame([(1, i, i) for i in range(1, 7)], "q long, item_id long, rank int")
    scores = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.9), (1, 6, 5.0)], "q long, item_id long, score double")
    assert [r.item_id for r in fusion.rerank(first, scores, 3).orderBy("rank").collect()] == [2, 3, 1, 4, 5, 6]
    other = first.withColumn("item_id", F.col("item_id") + 10)
    kinds = spark.createDataFrame([(i, "email") for i in range(1, 7)], "item_id long, kind string")
    assert {r.item_id for r in fusion.modality_fallback(first, other, kinds).collect()} == set(range(11, 17))


def test_scoring_tasks_grow_with_the_pairs(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} all") for i in range(40)], "item_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} all") for q in range(5)], "q long, question string")
    one = {tuple(r) for r in channels.bm25(items, asked).collect()}
    monkeypatch.setattr(channels, "TASK_PAIRS", 10)  # 200 pairs
    many = channels.bm25(items, asked)
    assert "REPARTITION_BY_NUM" in (plan := many._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(item_id" in plan and ", 20)" in plan
    assert {tuple(r) for r in many.collect()} == one
    grouped = channels.bm25(items.withColumn("half", F.col("item_id") % 2), asked, group="half")
    assert {(r.q, r.item_id, r.score) for r in grouped.collect()} == one


def test_products_are_made_in_bounded_blocks(spark, monkeypatch):
    made = []
    keep = np.partition
    monkeypatch.setattr(channels, "PRODUCTS", 50)
    monkeypatch.setattr(channels.np, "partition", lambda a, *x, **y: made.append(a.size) or keep(a, *x, **y))
    vectors = pa.array([[float(i), 1.0] for i in range(20)], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), vectors], ["item_id", "vector"])

    class Shared:
        value = (list(range(30)), np.array([[1.0, q] for q in range(30)]))

    rows = [r for b in channels._nearest(Shared, 3, 6)([batch]) for r in b.to_pylist()]
    assert max(made) <= 50 and sorted(r["item_id"] for r in rows if r["q"] == 4) == [17, 18, 19] and len(rows) == 90


def test_a_task_leaves_the_best_of_all_its_batches():
    class Shared:
        value = ([7, 8], np.array([[1.0, 0.0], [0.0, 1.0]]))

    def batch(ids, vectors):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], ["item_id", "vector"])

    equal = [batch(range(at, at - 10, -1), [[0.5, 0.25]] * 10) for at in (39, 29, 19, 9)]  # 40 equal vectors
    better = [batch([50, 51], [[0.75, 0.0], [float("nan"), 0.5]])]
    rows = [tuple(r.values()) for b in channels._nearest(Shared, 3, 6)([*equal, *better]) for r in b.to_pylist()]
    assert len(rows) == 6 and {r[:2] for r in rows if r[0] == 8} >= {(8, 51), (8, 0)}
    assert {r[:2] for r in rows if r[0] == 7} == {(7, 51), (7, 50), (7, 0)}  # NaN is the largest, as Spark and SQL have it
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 4, (50, 30)) / 4
    ids = rng.permutation(30)
    for k in (1, 5, 30, 99):
        got = channels._best(scores, ids, k)
        for row, s, i in zip(scores, *got, strict=True):
            assert sorted(zip(-s, i, strict=True)) == sorted(zip(-row, ids, strict=True))[:k]


def test_a_norm_is_computed_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "i int, v array<float>").select("i", vx.normalized(F.col("v")).alias("v"))
    assert rows._jdf.queryExecution().analyzed().toString().lower().count("sqrt") == 1
    assert [r.v for r in rows.orderBy("i").collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_all_terms_are_summed_up_where_items_are_dealt(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} all") for i in range(40)], "item_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} all") for q in range(5)], "q long, question string")
    one = {tuple(r) for r in channels.bm25(items, asked, "okapi").collect()}
    monkeypatch.setattr(channels, "SPREAD_BYTES", 0)
    large = channels.bm25(items, asked, "okapi")
    assert not re.search(r"hashpartitioning\(item_id#\d+L?, length", large._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in large.collect()} == one
