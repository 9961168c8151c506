import random

import pytest

from palimpsest.llm import simhash as d
from palimpsest.llm.common import Scratch, connected_components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots(values):
    name = {v: v for v in values}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    values = sorted(values)
    for k, a in enumerate(values):
        for b in values[:k]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {v: root(v) for v in values}


@pytest.mark.parametrize("crowd", [1, 24])
def test_links_join_what_is_near(spark, crowd):
    rng = random.Random(1)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.randrange(12)):
            x ^= 1 << rng.randrange(64)
            x ^= rng.choice((0, 1 << rng.randrange(64)))
            values.add(x)
    values = {signed(v) for v in values}
    scratch = Scratch(spark, "test")
    links = d.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), scratch, crowd=crowd)
    got = {v: v for v in values} | {r.node: r.component for r in connected_components(links, scratch).collect()}
    assert got == roots(values)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7000, 7000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[7000] == 7000


def test_query_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in d.op7_simhash(spark, sf).collect()} == d.brute_force(docs)


def test_odd_rows(spark):
    rows = [(1, "a b c d", "en"), (1, "a b c d", "en"), (2, None, None), (3, "", None), (4, " \t\n", None), (5, "AÉ", None), (6, "aÉ", None), (None, "a b c d", None), (None, "x y z w v", None)]
    found = d.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, []).append((r.fp, r.component_id))
    assert len(found) == 9 and by[2] == by[3] == by[4] == [(0, 2)] and by[5] == by[6]
    assert {c for _, c in by[1]} == {1} and {c for _, c in by[None]} == {1, None}


def test_long_texts_in_pieces():
    text = ("Alpha beta\tgamma épsilon\n" * 300).encode()
    whole = [w for part in d._word_lists(text) for w in part]
    for piece in (5, 64, 1000):
        assert [w for part in d._word_lists(text, piece) for w in part] == whole


def test_one_of_each_group_stays(spark):
    rows = [(3, "same words here now", "x"), (1, "same words here now", "y"), (9, "quite other words in this one", "z"), (1, "same words here now", "y")]
    kept = d.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 9] and kept.columns == ["doc_id", "text", "lang"]


def test_groups_without_an_id_and_groups_that_share_one_stay_apart(spark):
    rows = [(None, "one two three four five", "a"), (None, "quite other words in this one", "b"), (None, "one two three four five", "c"), (7, "red green blue and white", "d"), (7, "some more words of another text", "e"), (None, "red green blue and white", "f")]
    kept = d.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _id string")).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept)) == sorted({(0, rows[0][1]), (0, rows[1][1]), (7, rows[3][1]), (7, rows[4][1])})


def test_empty_table(spark):
    assert d.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
