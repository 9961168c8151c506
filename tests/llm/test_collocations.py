import random
import re
from collections import Counter

import duckdb
import pytest

from palimpsest.llm import collocations


def plain(docs, max_n=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, max_n + 1) for i in range(len(words) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        held = any(lang == other and len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), b in cand.items())
        if not held:
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    rows = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        rows += [(lang, k + 1, *r[1:]) for k, r in enumerate(mine[:top])]
    return sorted(rows)


def made(seed, docs=60):
    rng = random.Random(seed)
    words = ["a", "B", "c", "new", "York", "City", "Été", "x\x00y", " ", "#"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", " \r\n", "; ", "?"]
    return [("".join(rng.choice(words) + rng.choice(gaps[:3] if rng.random() < 0.8 else gaps) for _ in range(rng.randint(0, 60))), rng.choice(["en", None, "und", "d\te"])) for _ in range(docs)]


@pytest.mark.parametrize("max_n", [2, 3, 4])
@pytest.mark.parametrize("block", [7, 1 << 20])
def test_phrases_equal_brute_force(spark, monkeypatch, max_n, block):
    docs = made(max_n) + [(None, "en"), ("", None), ("new york city " * 400, "en"), ("New York City", "en"), ("new york city", "en")]
    frame = spark.createDataFrame([(k, t, x, 1) for k, (t, x) in enumerate(docs)], "phrase int, text string, lang string, n int").repartition(3)
    if block == 7:
        monkeypatch.setattr(collocations, "BLOCK", block)  # only in this process: the rows are made here
        batches = frame.select("lang", "text").toArrow().to_batches()
        rows = Counter()
        for batch in batches:
            fixed = [x or "und" for x in batch.column(0).to_pylist()]
            batch = batch.set_column(0, "lang", collocations.pa.array(fixed))
            for out in collocations._gram_rows(1, max_n)(iter([batch])):
                rows.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)))
        whole = {r["gram"]: r["s"] for r in collocations.grams(frame, 1, max_n).groupBy("gram").agg(collocations.F.sum("f").alias("s")).collect()}
        assert whole == dict(rows)
        if max_n > 2:  # between frequent grams of one word less
            pa = collocations.pa
            frequent = [g for g, f in rows.items() if g.split("\t")[0].count(" ") == max_n - 2 and f >= 3]
            within = collocations.gram_filter(spark.createDataFrame([(g,) for g in frequent], "gram string"))
            assert collocations.has(within, pa.array(frequent)).all()
            cut = Counter()
            for batch in batches:
                batch = batch.set_column(0, "lang", pa.array([x or "und" for x in batch.column(0).to_pylist()]))
                for out in collocations._gram_rows(max_n, max_n, type("Shared", (), {"value": within}))(iter([batch])):
                    cut.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)))
            often = {g for g in rows if collocations.has(within, pa.array([g]))[0]}

            def inside(gram):
                phrase, lang = gram.split("\t", 1)
                return {phrase.rsplit(" ", 1)[0] + "\t" + lang, phrase.split(" ", 1)[1] + "\t" + lang} <= often

            assert cut == {g: f for g, f in rows.items() if g.split("\t")[0].count(" ") == max_n - 1 and inside(g)}
        return
    scratch = collocations.Scratch(spark, "phrases")
    every = sorted(map(tuple, collocations._counted(collocations.grams(frame, 1, max_n), 3).collect()))
    assert sorted(map(tuple, collocations.phrase_counts(frame, scratch, max_n, 3).collect())) == every
    with monkeypatch.context() as m:
        m.setattr(collocations, "FILTER_BITS", 64)  # a full filter, which has everything
        assert sorted(map(tuple, collocations.phrase_counts(frame, scratch, max_n, 3).collect())) == every
    for least, inside, top in ((10, 50, 2000), (2, 100, 5)):
        got = sorted(tuple(r) for r in collocations.collocations(frame, max_n=max_n, least=least, inside=inside, top=top).collect())
        assert got == plain(docs, max_n, least, inside, top)


def test_phrases_match_sql(spark, sf):
    from palimpsest.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in QUERIES["op13_collocations"](spark, sf).collect()) == sorted(con.sql(ORACLE_SQL["op13_collocations"]).fetchall())


def test_long_texts_and_no_rows(spark):
    docs = spark.createDataFrame([("one two three four " * 100_000, "en")], "text string, lang string")
    got = collocations.collocations(docs).collect()
    assert {r["phrase"] for r in got} == {p for p in ("one two three", "two three four", "three four one", "four one two")} and {r["n"] for r in got} == {400_000}
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a = 10**12 + 7
    counts = spark.createDataFrame([("en", "x", 1, a + 3), ("en", "y", 1, a + 11), ("en", "x y", 2, a)], "lang string, phrase string, length int, f long")
    assert [r["score"] for r in collocations.scored(counts).collect()] == [10**6 * a * a // ((a + 3) * (a + 11))]
