import random
import time

import numpy as np
import pytest

from palimpsest.llm import decontaminate as d

SCHEMA = "doc_id long, text string, found string"


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(1)
    items = [(i, words(rng, n)) for i, n in enumerate((30, 12, 10, 9, 3, 1, 25))] + [(7, None), (8, ""), (9, "--!"), (None, words(rng, 14))]
    docs = []
    for i in range(60):
        text = words(rng, rng.randrange(0, 60), 400)
        if rng.random() < 0.5:
            text += " , " + (rng.choice(items)[1] or "").upper() + "\n" + words(rng, 5, 400)
        docs.append((i, text, "x"))
    docs += [(90, None, None), (91, "", None), (92, "é" * 10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.f for r in d.find_matches(spark.createDataFrame(docs, SCHEMA), bench, out="f").collect()}
    want = d.brute_force([(i, t) for i, t, _ in docs], items)
    for i, f in got.items():
        hit = sum(s.end - s.start for s in f.spans)
        assert (f.n_words, hit, sorted(f["items"])) == want[i][:3], i


@pytest.mark.parametrize("shard_words", [16, 50, 1 << 20])
def test_shards_and_long_texts(spark, shard_words):
    rng = random.Random(2)
    item = words(rng, 40, 1000)
    text = " ".join([words(rng, 70, 50), item, words(rng, 33, 50), item[: len(item) // 2], words(rng, 20, 50)])
    docs = spark.createDataFrame([(1, text, ""), (1, text, "")], SCHEMA)
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    want = d.brute_force([(1, text)], [(5, item)])[1]
    rows = d.find_matches(docs, bench, shard_words=shard_words, out="f").collect()
    assert len(rows) == 2
    for r in rows:
        assert (r.f.n_words, sum(s.end - s.start for s in r.f.spans)) == want[:2]
        assert r.f.longest_words == 40 and r.f.longest_item == "5" and r.f.longest_doc_pos == 70


def test_blocks_of_the_benchmark_give_the_same(spark):
    rng = random.Random(3)
    items = [(i, words(rng, 15, 300)) for i in range(12)]
    docs = spark.createDataFrame([(i, words(rng, 8, 300) + " " + items[i % 12][1] + " " + items[(i * 5) % 12][1], "") for i in range(20)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, str(r.f.spans), str(r.f["items"])) for r in d.find_matches(docs, bench, out="f").collect()}
    longest = {r.doc_id: (r.f.longest_words, r.f.longest_doc_pos) for r in d.find_matches(docs, bench, out="f").collect()}
    for passes in (100, 3, 1):
        rows = d.find_matches(docs, bench, block_bytes=100, pass_blocks=passes, keep_text=True, out="f")
        assert rows.columns == [*docs.columns, "f"]
        rows = rows.collect()
        assert {(r.doc_id, str(r.f.spans), str(r.f["items"])) for r in rows} == one
        assert {r.doc_id: (r.f.longest_words, r.f.longest_doc_pos) for r in rows} == longest


def test_word_pieces_are_the_words():
    text = ("Ab cé,d! " * 50).encode()
    whole = list(d.word_pieces(text, 1 << 20))[0]
    for piece in (7, 16, 100):
        assert [w for part in d.word_pieces(text, piece) for w in part] == whole


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, item, "k"), (2, "clean", "k"), (3, None, None)], SCHEMA)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = d.decontaminate(docs, bench)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2, 3}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert d.find_matches(docs, bench, out="f").count() == 0
    rows = d.find_matches(spark.createDataFrame([(1, "a b", "")], SCHEMA), bench, out="f").collect()
    assert rows[0].f.n_words == 2 and not rows[0].f["items"]


def test_query_on_the_table(spark, sf):
    rows = d.op1_decontamination(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = d.brute_force(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in rows} == {i: (w[0], w[1], w[3], w[1] > 0) for i, w in want.items()}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, _found string")
    out = d.decontaminate(docs, spark.createDataFrame([(1, "c")], "item_id long, text string"))
    assert [tuple(r) for r in out.collect()] == [(1, "a b", "x")]


def longest_by_hand(text, items):
    w, best = d.words_of(text), (0, None)
    for _, t in items:
        other = d.words_of(t)
        for a in range(len(w)):
            for b in range(len(other)):
                k = 0
                while a + k < len(w) and b + k < len(other) and w[a + k] == other[b + k]:
                    k += 1
                if k > best[0] or k == best[0] and k and a < best[1]:
                    best = (k, a)
    return best


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 9, 200])
def test_shards_equal_brute_force(vocabulary):
    rng = random.Random(vocabulary)
    for _ in range(30):
        items = [(str(i), words(rng, rng.choice((1, 2, 4, 9, 10, 11, 30, 60)), vocabulary)) for i in range(rng.randrange(1, 5))]
        tests = d.Suffixes([(i, d.words_of(t)) for i, t in items], 10)
        shard, docs = d.Shard(tests, 1 << 20), []
        for k in range(4):
            text = words(rng, rng.randrange(1, 50), vocabulary) + " x " + rng.choice(items)[1]
            docs.append((text, {"words": 0, "spans": [], "items": set(), "longest": (0, None, None, None)}))
            w = d.words_of(text)
            shard.add(docs[-1][1], np.array([tests.code.get(x, 0) for x in w], np.int32), 0)
        shard.flush()
        want = d.brute_force([(k, t) for k, (t, _) in enumerate(docs)], items)
        for k, (text, doc) in enumerate(docs):
            assert (sum(b - a for a, b in d.merged(doc["spans"])), sorted(doc["items"])) == want[k][1:3]
            assert (doc["longest"][0], doc["longest"][3]) == longest_by_hand(text, items)


def test_one_word_many_times():
    n = 20_000
    tests = d.Suffixes([("a", [b"ha"] * n), ("b", [b"ha"] * n), ("c", [b"ha"] * 3)], 10)
    shard, doc = d.Shard(tests, 1 << 20), {"words": 0, "spans": [], "items": set(), "longest": (0, None, None, None)}
    shard.add(doc, np.ones(n, np.int32), 0)
    began = time.process_time()
    shard.flush()
    assert time.process_time() - began < 10 and doc["spans"] == [(0, n)] and doc["items"] == {"a", "b", "c"} and doc["longest"][0] == n
