import random
import re

from pyspark.sql import functions as F

from palimpsest.operators.facts import current_facts, fact_history
from palimpsest.operators.links import components, similar_sets

KIND = "owner string, seq long, text string, removes boolean"


def words(text):
    return frozenset(re.findall("[a-z0-9]+", (text or "").lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def read_one_by_one(statements, least):
    """The store as one reader sees it: all live facts of the owner are compared with each statement."""
    stores, seen, out = {}, {}, {}
    for owner, seq, text, removes in statements:
        if seq is not None:
            k = (text is not None, text or "", bool(removes))
            seen[owner, seq] = min(seen.get((owner, seq), (k, text, bool(removes))), (k, text, bool(removes)))
    for (owner, seq), (_, text, removes) in sorted(seen.items(), key=lambda x: x[0][1]):
        store = stores.setdefault(owner, {})
        mine = words(text)
        same = [f for f, (ws, _) in store.items() if ws == mine]
        near = [(-jaccard(mine, ws), f) for f, (ws, _) in store.items() if jaccard(mine, ws) >= least - 1e-9]
        fact = same[0] if same else min(near)[1] if near else None
        if removes:
            out[owner, seq] = ("none", None, None) if fact is None else ("delete", fact, store.pop(fact)[1] + 1)
        elif fact is None:
            store[seq] = (mine, 1)
            out[owner, seq] = ("add", seq, 1)
        elif same:
            out[owner, seq] = ("none", fact, store[fact][1])
        else:
            store[fact] = (mine, store[fact][1] + 1)
            out[owner, seq] = ("update", fact, store[fact][1])
    return out, {(o, f): v for o, s in stores.items() for f, (_, v) in s.items()}


def check(spark, statements, least=0.6):
    history = fact_history(spark.createDataFrame(statements, KIND), least).persist()
    wanted, live = read_one_by_one(statements, least)
    assert {(r.owner, r.seq): (r.action, r.fact, r.version) for r in history.collect()} == wanted
    assert {(r.owner, r.fact): r.version for r in current_facts(history).collect()} == live
    history.unpersist()


def test_history_and_state_equal_one_reader(spark):
    rng = random.Random(5)
    names = [f"w{k}" for k in range(9)]
    rows = []
    for seq in range(400):
        owner = "hot" if rng.random() < 0.5 else rng.choice("abc")
        rows.append((owner, seq, " ".join(rng.sample(names, rng.randint(1, 6))), rng.random() < 0.2))
    check(spark, rows)
    check(spark, rows, 0.34)


def test_a_run_again_changes_nothing_and_odd_rows_have_a_result(spark):
    rows = [("a", 1, "lives in Rome", False), ("a", 2, "lives in Paris", False), ("a", 3, "LIVES, in Paris!", False), (None, 1, "x y", False), (None, 2, None, None), (None, 3, "", False)]
    rows += [("a", 4, "in Paris", True), ("a", 5, "in Paris", True), ("a", None, "lost", False), ("b", 9, "word " * 20_000, False), ("", 1, "x y", True)]
    check(spark, rows + rows, 0.5)
    check(spark, rows + rows, 0.5)


def test_no_statements(spark):
    history = fact_history(spark.createDataFrame([], KIND))
    assert history.collect() == [] and current_facts(history).collect() == []


def test_similar_sets_equal_all_pairs(spark):
    rng = random.Random(8)
    rows = sorted({(rng.choice("uv"), *sorted(rng.sample(range(14), rng.randint(0, 8)))) for _ in range(150)})
    rows = [(r[0], k, [str(t) for t in r[1:]]) for k, r in enumerate(rows)]
    for least in (0.5, 0.6, 0.75, 1.0):
        found = similar_sets(spark.createDataFrame(rows, "by string, id long, tokens array<string>"), least, "by")
        want = {(a, b) for o, a, x in rows for p, b, y in rows if o == p and a < b and jaccard(set(x), set(y)) >= least - 1e-9}
        assert {(r.a, r.b) for r in found.collect()} == want


def test_components_of_a_chain_a_hub_and_a_pair(spark):
    links = [(k, k + 1) for k in range(10, 60)] + [(200, k) for k in range(201, 260)] + [(5, 300), (300, 5), (7, 7)]
    random.Random(1).shuffle(links)
    found = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 10 for k in range(10, 61)} | {k: 200 for k in range(200, 260)} | {5: 5, 300: 5}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.col("id") > 0).collect() == []


def test_what_is_written_is_a_part_of_the_texts(spark):
    from pathlib import Path

    from palimpsest.retrieval.held import shared_root

    rng = random.Random(3)
    names = [f"{rng.getrandbits(64):x}" for _ in range(600)]
    rows = [("hot", seq, " ".join(rng.sample(names, 200)), False) for seq in range(300)]
    rows += [("hot", 300 + seq, rows[seq][2] + " more", False) for seq in range(10)]
    root = Path(shared_root(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in root.rglob("*.parquet"))
    before = size()
    assert fact_history(spark.createDataFrame(rows, KIND), text=False).where("action = 'update'").count() == 10
    assert size() - before < sum(len(r[2]) for r in rows) / 4


def test_cells_and_rows_that_come_twice(spark, monkeypatch):
    from palimpsest.operators import links

    monkeypatch.setattr(links, "CELL", 5)
    test_similar_sets_equal_all_pairs(spark)
    rng = random.Random(9)
    rows = [("a", rng.randint(0, 30), " ".join(rng.sample("pqrstu", rng.randint(0, 6))), rng.random() < 0.2) for _ in range(120)]
    check(spark, rows)
