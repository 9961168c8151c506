import pytest
from pyspark.sql import functions as F

from palimpsest.operators import enrich


def test_caches_and_cleaning(spark):
    rows = spark.createDataFrame([("/a/x.jpg",), ("/a/y.jpg",)], "path string")
    caches = {name: spark.createDataFrame([("x", value)], "stem string, value string") for name, value in (("city", '"Porto"'), ("tags", "Food, a, sea"), ("entities", "Grace: person"), ("safety_content", ""))}
    got = {r.path: r for r in enrich.cleaned_fields(enrich.enriched(rows, caches, "path")).collect()}
    assert got["/a/x.jpg"].city == "Porto" and got["/a/x.jpg"].tags == ["food", "sea"] and got["/a/x.jpg"].entities[0].type == "person"
    assert got["/a/y.jpg"].city == "" and got["/a/y.jpg"].safety_content == "safe"


def test_pools_and_variants(spark):
    qa = spark.createDataFrame([("1", "q", ["a"], ["b", "c"]), ("2", "q", ["a"], None)], "id string, question string, evidence_ids array<string>, niah_evidence_ids array<string>")
    assert {r.id: r.evidence_ids for r in enrich.pool_evidence(qa).collect()} == {"1": ["b", "c"], "2": ["a"]}
    with pytest.raises(Exception, match="no pool for question 2"):
        enrich.pool_evidence(qa, strict=True).collect()
    assert enrich.without_answers(qa).columns == ["id", "question"]
    rows = spark.createDataFrame([("1", "image", "c")], "id string, type string, caption string")
    assert enrich.memory_variant(rows, "text").columns == ["id", "type", "caption"]
    with pytest.raises(ValueError):
        enrich.memory_variant(rows, "none")


def test_replies_shown_and_updates(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    done, waiting = enrich.replied(rows, spark.createDataFrame([(1, "r")], "id int, reply string"), "id")
    assert [r.id for r in done.collect()] == [1] and [r.id for r in waiting.collect()] == [2]
    items = spark.createDataFrame([("a", "A"), ("b", "B")], "item_id string, text string")
    ids = spark.createDataFrame([(1, ["b", "zz", "a"])], "q int, ids array<string>")
    assert [(r.n, r.text) for r in enrich.shown(ids, items).orderBy("n").collect()] == [(0, "B"), (1, None), (2, "A")]
    notes = spark.createDataFrame([(0, "c", ["t"])], "ord int, context string, tags array<string>")
    updates = spark.createDataFrame([(0, "new", ["u"], 1), (0, "newer", None, 2)], "ord int, context string, tags array<string>, pos int")
    assert tuple(enrich.linked_notes(notes, updates).first()) == (0, "newer", ["t"])
    assert spark.createDataFrame([("a cat ran",)], "t string").select(enrich.categorised(F.col("t"), {"animal": ["cat"], "food": ["cake"]}).alias("x")).first().x == ["animal"]
