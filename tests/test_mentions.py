import random

from palimpsest.operators.mentions import best_match, occurring

ENTRY, ITEM = "entry long, statement string, tokens array<string>", "item_id string, ord long, text string"


def all_pairs(entries, items):
    out = {}
    for entry, statement, tokens in entries:
        ts = {t.lower() for t in tokens or () if t}
        best = (0, None)
        for item, _, text in sorted(items, key=lambda x: x[1]):
            name = (item or "").lower()
            if name and (name in (statement or "").lower() or name in ts):
                best = (100, item)
                break
            score = sum(len(t) >= 4 and t in (text or "").lower() for t in ts)
            if score > best[0]:
                best = (score, item)
        if best[0] >= 2:
            out[entry] = best
    return out


def check(spark, entries, items):
    found = best_match(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(items, ITEM)).collect()
    assert {r.entry: (r.score, r.item_id) for r in found} == all_pairs(entries, items)
    assert len({r.entry for r in found}) == len(found)


def test_best_match_equals_all_pairs(spark):
    rng = random.Random(3)
    names = ["rome", "rome trip", "paris", "café noir", "the", "at", "Ünsal", "birthday", "day trip", "😀 smile", "a.b*c", "road"]
    items = [(f"item{k}", k, " ".join(rng.choice(names) for _ in range(rng.randint(0, 6)))) for k in range(80)]
    entries = [(k, "saw item1x" if k % 17 == 0 else f"of Item{k % 90}" if k % 5 == 0 else "nothing", rng.sample(names, rng.randint(0, 6)) + (["ITEM7"] if k % 13 == 0 else [])) for k in range(120)]
    check(spark, entries, items)


def test_odd_rows_have_a_result(spark):
    items = [("a1", 0, None), ("", 1, "first second"), (None, 2, "first second third"), ("A1", 3, "first second third " + "x" * 100_000), ("7", 4, "")]
    entries = [(1, None, None), (2, "", ["first", "second"]), (3, "see a1", ["first", "second"]), (4, None, [None, "", "third", "second", "THIRD"]), (5, "7", []), (6, "none", ["first", "first"]), (7, None, ["absent", "second", "first"]), (8, None, ["absent", "first"])]
    check(spark, entries, items)
    check(spark, entries, [])
    check(spark, [], items)


def test_occurring_finds_short_and_frequent_strings(spark):
    texts = [(k, "the same words " + "again" * (k % 3)) for k in range(200)] + [(500, "q")]
    patterns = ["q", "th", "same words", "againagain", "words again", "missing", "s", "e s"]
    found = occurring(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame(texts, "id long, text string"))
    assert {tuple(r) for r in found.collect()} == {(p, i) for p in patterns for i, t in texts if p in t}
