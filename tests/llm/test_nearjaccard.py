import random

import pyarrow as pa
import pytest

import corpus_pipeline
from palimpsest.llm import nearjaccard as d
from palimpsest.llm import simhash


def random_texts(rng):
    rows = []
    common = [" ".join(f"c{rng.randrange(50)}" for _ in range(30)) for _ in range(3)]
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.randrange(1, 7)):
            rows.append((len(rows), " ".join([*words, rng.choice(common)] if rng.random() < 0.5 else words)))
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "edited"
    return rows + [(900, None), (901, " \n"), (902, "Two  words"), (903, "two words"), (904, ""), (905, "two\twordS ")]


@pytest.mark.parametrize("stars,portion", [(0, 1 << 21), (2, 50)])
def test_all_pairs_so_alike_are_found(spark, monkeypatch, stars, portion):
    monkeypatch.setattr(d, "STARS", stars)
    monkeypatch.setattr(d, "PORTION", portion)
    monkeypatch.setattr(d, "FEW", 0.0)
    rows = random_texts(random.Random(2))
    kept = d.deduplicate_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(d.brute_force(rows).values()))


def test_long_texts_are_cut(monkeypatch):
    text = " ".join(f"w{k % 37}" for k in range(500)) + "  end "
    whole = d.shingle_sets(pa.array([text, None, "a b"]))
    parts = d.shingle_sets(pa.array([text, None, "a b"]), long=40)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts] and len(whole[0]) > 30


def test_odd_rows_of_the_deduplication(spark):
    rows = [(None, "first text here", "a"), (None, "second text there", "b"), (7, "one", "c"), (7, "two", "c"), (7, "two", "c"), (8, "two", "d"), (None, "two", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    for options in ({}, {"similarity": 0.8, "width": 5}):
        kept = simhash.deduplicate(docs, **options)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == [(0, "first text here"), (0, "second text there"), (7, "one"), (7, "two")]
        assert simhash.deduplicate(docs.limit(0), **options).count() == 0


def test_edited_copies_do_not_pass_the_pipeline(spark, sf):
    words = [f"word{k}" for k in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:60], "edited", *words[61:]])), (3, " ".join(words[:60])), (None, "a text without an id"), (None, "and quite another one")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 1, 3]


def test_stage_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = d.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_fingerprints_link_before_blocks_do(spark, sf, monkeypatch):
    made = d.Nodes.__init__

    def without_blocks(self, *args):
        made(self, *args)
        self.blocks = self.blocks.limit(0)

    monkeypatch.setattr(d.Nodes, "__init__", without_blocks)
    rng = random.Random(4)
    words = [f"w{rng.randrange(9000)}" for _ in range(3000)]
    rows = [(2, " ".join(words)), (1, " ".join(words[1:])), (3, " ".join(words[:900])), (4, None)]
    assert (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count() <= 2
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
