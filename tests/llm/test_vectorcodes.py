import hashlib
import math

import duckdb
import numpy as np
import pytest

from palimpsest.llm import vectorcodes


def plain(rows, parts=4, entries=256, rounds=4):
    """The contract at length, in Python integers. rows: (id, vector, label), kept ones only."""
    rows = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows]
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in rows] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [nearest(books[p], x)[1] for x in cut[p]]
            for k in set(found):
                mine = [x for x, f in zip(cut[p], found, strict=True) if f == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [[nearest(books[p], x) for x in cut[p]] for p in range(parts)]
    errors = [sum(last[p][n][0] for p in range(parts)) for n in range(len(rows))]
    labels = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{last[p][n][1]:02x}" for p in range(parts)), errors[n], labels[label], sha) for n, (i, _, label) in enumerate(rows)]


def test_codes_match_sql(spark, sf):
    from palimpsest.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op12_vector_codes"](spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == sorted(con.sql(ORACLE_SQL["op12_vector_codes"]).fetchall())


@pytest.mark.parametrize("scale", [1, 3000, 1 << 24])
def test_tree_equals_brute_force(scale):
    rng = np.random.default_rng(scale)
    entries = rng.integers(-scale, scale + 1, (256, 6)).astype(np.int64)
    entries[100:140] = entries[7]  # equal entries
    points = np.concatenate([rng.integers(-scale, scale + 1, (3000, 6)), entries, np.zeros((1, 6), np.int64)]).astype(np.int64)
    found, away, compared = vectorcodes.BallTree(entries).nearest(points)
    all_ = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2) if scale > 3000 else ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (found == np.array(all_.tolist()).argmin(1)).all() and (away == np.array(all_.tolist()).min(1)).all()
    assert compared < len(points) * 256


def test_whole_balls_are_passed_over():
    rng = np.random.default_rng(5)
    entries = np.concatenate([rng.integers(0, 50, (16, 4)) + 10_000 * k for k in range(16)]).astype(np.int64)
    points = entries[rng.integers(0, 256, 2000)] + rng.integers(-3, 4, (2000, 4))
    _, _, compared = vectorcodes.BallTree(entries).nearest(points)
    assert compared <= 2000 * 32


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(k, [float(x) for x in rng.integers(-3, 4, 8) / 4], "a" if k % 3 else None) for k in range(40)]
    good[5] = (5, [-0.0003] * 8, "a")  # floors go down
    good[6] = (6, good[4][1], "b")  # ties
    bad = [(-1, None, "a"), (-2, [1.0] * 7 + [None], "a"), (-3, [float("nan")] + [0.0] * 7, "a"), (-4, [float("inf")] + [0.0] * 7, None), (-5, [], "b"), (-6, [1.0] * 7, "b"), (90, [1.0] * 4, "b")]
    frame = spark.createDataFrame([(i, v, x, 1, "clash") for i, v, x in good + bad], "vec_id long, embedding array<double>, label string, part int, code string").repartition(5)
    got = sorted(tuple(r) for r in vectorcodes.compressed(frame, entries=16, rounds=3).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == plain(good, entries=16, rounds=3)
    assert vectorcodes.compressed(frame.limit(0)).collect() == []
    few = frame.where("vec_id in (3, 4)")
    assert sorted(r["error"] for r in vectorcodes.compressed(few).collect()) == [0, 0]
    twice = few.unionByName(few).unionByName(few.withColumn("vec_id", vectorcodes.F.lit(None).cast("long")))
    assert len(vectorcodes.compressed(twice).collect()) == 6
    coded = vectorcodes.encoded(frame, vectorcodes.trained(frame, entries=16))
    shuffled = vectorcodes.label_errors(coded, sent_bytes=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, vectorcodes.label_errors(coded).collect()))


def test_decoding_gives_what_the_error_says(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.floor(rng.normal(size=8) * 1024) / 1024], 0) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = vectorcodes.trained(frame, entries=32)
    out = vectorcodes.decoded(vectorcodes.encoded(frame, books), books).join(frame.select("vec_id", "embedding"), "vec_id").collect()
    for r in out:
        assert r["error"] == round(sum(((a - b) * 1024) ** 2 for a, b in zip(r["approximation"], r["embedding"], strict=True)))


def test_components_beyond_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30] * 4, 0), (2, [0.0] * 4, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        vectorcodes.compressed(frame).collect()
