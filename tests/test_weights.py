import random

import pytest

from palimpsest.retrieval.weights import WeightSearch


def corpus(seed=4, questions=25, items=60):
    rng = random.Random(seed)
    lists = {c: [(q, i, r + 1) for q in range(questions) for r, i in enumerate(rng.sample(range(items), rng.randint(0, 40)))] for c in "abc"}
    gold = [(q, i) for q in range(questions) if q % 6 for i in rng.sample(range(items), rng.randint(1, 4))]
    return lists, gold, items


def recalls(lists, gold, n, settings, depths, k=60):
    """All items of all lists are scored and sorted for each setting."""
    ranks = {c: {(q, i): r for q, i, r in rows} for c, rows in lists.items()}
    wanted = {}
    for q, i in set(gold):
        wanted.setdefault(q, set()).add(i)
    out = []
    for ws in settings:
        per = []
        for q, good in wanted.items():
            pool = {i for rs in ranks.values() for p, i in rs if p == q}
            score = {i: round(sum(w / (k + ranks[c].get((q, i), n + 1)) for c, w in zip(lists, ws, strict=True)), 8) for i in pool}
            order = sorted(pool, key=lambda i: (-score[i], i))
            per.append([len(good & set(order[:d])) / len(good) for d in depths])
        out.append([round(sum(x) / len(per), 6) for x in zip(*per, strict=True)])
    return out


@pytest.fixture(scope="module")
def search(spark):
    lists, gold, n = corpus()
    frames = {c: spark.createDataFrame(rows, "q long, item_id long, rank int") for c, rows in lists.items()}
    return WeightSearch(frames, spark.createDataFrame(gold + gold[:3], "q long, item_id long"), n)


def test_recalls_equal_sorted_lists(search):
    lists, gold, n = corpus()
    settings = [*search.grid(4), *search.drawn(60, 1), (0.0, 0.0, 0.0)]
    found = search.evaluate(settings)
    want = recalls(lists, gold, n, settings, search.aim)
    for f, w in zip(found, want, strict=True):
        assert list(f.recalls.values()) == pytest.approx(w, abs=2e-6)


def test_a_grid_is_a_special_case_and_a_seed_repeats(search):
    grid = search.grid(4)
    assert len(grid) == 15 and all(abs(sum(g) - 1) < 1e-9 for g in grid)
    by_grid = search.best(grid)
    first = search.evolve(seed=3, population=6, generations=2, start=grid)
    assert first == search.evolve(seed=3, population=6, generations=2, start=grid)
    assert first.value >= by_grid.value
    halved = search.halve(grid)
    assert halved == search.halve(grid) and halved.value <= by_grid.value


def test_empty_lists_and_no_gold(spark):
    none = spark.createDataFrame([], "q long, item_id long, rank int")
    one = spark.createDataFrame([(1, 5, 1)], "q long, item_id long, rank int")
    gold = spark.createDataFrame([(1, 5), (None, 5), (2, 9)], "q long, item_id long")
    assert WeightSearch({"a": one, "b": none}, gold, 9).evaluate([(1.0, 0.0)])[0].recalls[1] == 0.5
    assert WeightSearch({"a": one}, gold.where("q > 5"), 9).evaluate([(1.0,)])[0].value == 0


def test_what_can_be_within_a_depth_is_kept_and_little_else(spark):
    rng = random.Random(9)
    n = 4000
    lists = {c: [(1, i, r + 1) for r, i in enumerate(rng.sample(range(n), n - 500))] for c in "ab"}
    gold = [(1, i) for i in rng.sample(range(n), 40)] + [(1, lists["a"][k][1]) for k in range(0, 30, 3)]
    frames = {c: spark.createDataFrame(rows, "q long, item_id long, rank int") for c, rows in lists.items()}
    search = WeightSearch(frames, spark.createDataFrame(gold, "q long, item_id long"), n)
    settings = [*search.grid(10), (0.0, 0.0)]
    found = search.evaluate(settings)
    for f, w in zip(found, recalls(lists, gold, n, settings, search.aim), strict=True):
        assert list(f.recalls.values()) == pytest.approx(w, abs=2e-6)
    assert search.rivals.count() < 10 * n  # 50 gold items by nearly 4000 rivals before
