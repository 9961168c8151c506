import corpus_pipeline
from palimpsest.llm import decontaminate, language, mixing, nearjaccard
from tests.llm.test_other_operators import expected_tokens


def test_stages_do_what_their_operators_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        rows = docs.collect()
        if name != "token_output":
            assert docs.columns == columns
        if name == "language_id":
            profiles = language.learn_profiles(before.select("text", "lang"))
            scores = {r["row"].doc_id: r.score for r in language.identify(before.select("doc_id", "text"), profiles).collect()}
            assert {r.doc_id for r in rows} == {i for i, s in scores.items() if s >= language.MIN_SCORE} == set(kept)
        elif name == "near_duplicates":
            want = nearjaccard.brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in rows) == sorted(set(want.values()))
        elif name == "decontamination":
            want = decontaminate.brute_force([(r.doc_id, r.text) for r in before.collect()], bench)
            assert {r.doc_id for r in rows} == {i for i, w in want.items() if not w[1]}
        elif name == "mixing":
            taken = {r.id: r.copies for r in mixing.mixture(before).collect()}
            got = [r.doc_id for r in rows]
            assert {i: got.count(i) for i in taken} == taken
        else:
            assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected_tokens(sorted((r.doc_id, r.text) for r in before.collect()))
    assert language.UNKNOWN not in columns


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = out.orderBy("start").collect()
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
