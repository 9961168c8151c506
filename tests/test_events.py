import json

from pyspark.sql import functions as F

from palimpsest.operators import events, render
from palimpsest.sources import records

HOME, AWAY = "Cambridge, United Kingdom", "Bangkok, Thailand"


def media(spark, rows):
    df = spark.createDataFrame([(1, k, day, city) for k, (day, city) in enumerate(rows)], "owner long, item_ord long, ts string, city string")
    return df.withColumns({"ts": F.to_timestamp("ts"), "item_id": F.col("item_ord")})


def clustered(spark, rows):
    return events.events(media(spark, rows), "owner").orderBy("event").collect()


def test_gap_merges_and_splits(spark):
    (e,) = clustered(spark, [("2023-01-01", HOME), ("2023-01-02", HOME), ("2023-01-04", HOME)])
    assert (e.event_id, str(e.start), str(e.end), e.days, e.item_count) == ("E0001", "2023-01-01", "2023-01-04", 3, 3)
    assert len(clustered(spark, [("2023-01-01", HOME), ("2023-01-10", HOME)])) == 2


def test_city_splits_and_makes_trips(spark):
    assert len(clustered(spark, [("2023-01-01", HOME), ("2023-01-02", AWAY)])) == 2
    got = clustered(spark, [(f"2023-01-0{d}", HOME) for d in range(1, 6)] + [(f"2023-01-0{d}", AWAY) for d in range(6, 9)])
    assert [(e.kind, e.city, e.item_count) for e in got] == [("event", HOME, 5), ("trip", AWAY, 3)]


def test_items_are_conserved_and_undated_left_out(spark):
    rows = [("2023-01-01", HOME), (None, HOME), ("2023-02-01", None), ("2023-02-01", AWAY), ("2023-05-01", "")]
    assert sum(e.item_count for e in clustered(spark, rows)) == 4
    assert events.members(media(spark, rows), "owner").count() == 4


def test_ties_go_to_the_first_seen(spark):
    (e,) = clustered(spark, [("2023-01-01 10:00:00", AWAY), ("2023-01-01 11:00:00", HOME)])
    assert e.city == AWAY


def test_mails_in_range(spark):
    found = events.events(media(spark, [("2023-01-01", HOME), ("2023-01-03", HOME)]), "owner")
    mails = spark.createDataFrame([("email1", "2023-01-02"), ("email2", "2023-03-01")], "id string, day string").withColumn("day", F.to_date("day"))
    assert [r.id for r in events.in_range(mails, found, "day").collect()] == ["email1"]


def test_repairs(spark):
    ranges = spark.createDataFrame([(1, 1, 4, "a"), (1, 3, 6, "b"), (1, 9, 30, "c"), (1, 4, 5, "d")], "batch int, start int, end int, title string")
    got = sorted((r.start, r.end, r.title) for r in events.repair_ranges(ranges, 1, 12).collect())
    assert got == [(1, 4, "a"), (5, 6, "b"), (7, 8, None), (9, 12, "c")]
    groups = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 1, "x"), (1, 2, 2, "zz")], "batch int, grp int, pos int, seed string")
    seeds = spark.createDataFrame([(1, "x"), (1, "y")], "batch int, seed string")
    assert {(r.grp, r.seed) for r in events.repair_groups(groups, seeds).collect()} == {("1", "x"), ("solo:y", "y")}


def test_corpus_from_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"image_path": "/p/20230401_120000.jpg", "timestamp": "2023-04-01 12:00:00", "short_caption": "lobby", "tags": ["hotel"]}]))
    (tmp_path / "e.json").write_text(json.dumps([{"id": "email1", "timestamp": "2023-03-20", "short_summary": "booking", "detail": "Subject: Hi"}]))
    images = records.media_rows(spark, str(tmp_path / "i.json")).withColumn("pos", F.lit(0))
    mails = records.email_rows(spark, str(tmp_path / "e.json")).withColumn("pos", F.lit(0))
    rows = records.corpus(mails, images, images.limit(0)).orderBy("item_ord").collect()
    assert [r.item_id for r in rows] == ["email1", "20230401_120000"] and rows[1].text == "ID: 20230401_120000\nType: image\nTimestamp: 2023-04-01 12:00:00\nShort Caption: lobby\nTags: hotel"
    assert rows[1].metadata == {"timestamp": "2023-04-01 12:00:00"}


def test_questions_in_both_forms(spark, tmp_path):
    qa = [{"id": "1", "question": "q?", "answer": "a", "evidence_ids": ["x"]}]
    for name, value in (("a.json", qa), ("b.json", {"qas": qa})):
        (tmp_path / name).write_text(json.dumps(value))
        assert [r.id for r in records.questions(spark, str(tmp_path / name)).collect()] == ["1"]


def test_readers(spark, tmp_path):
    (tmp_path / "dirty.json").write_text('noise {"answer": 1} tail')
    assert records.json_recovered(spark, str(tmp_path / "dirty.json")).first().json == '{"answer": 1}'
    run = tmp_path / "runs/t/a/m/q1/output"
    run.mkdir(parents=True)
    (run / "answer.json").write_text('{"answer": "x"}')
    ids = spark.createDataFrame([("q1",), ("q2",)], "id string")
    assert {(r.id, r.status) for r in records.run_artifacts(spark, str(tmp_path / "runs"), ids).collect()} == {("q1", "ok"), ("q2", "missing")}
    assert {r.path.rsplit("/", 1)[1] for r in records.files(spark, str(tmp_path), ("json",)).collect()} == {"dirty.json", "answer.json"}
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert records.stored(spark, df, str(tmp_path / "index"), {"k": 1}).collect() == records.stored(spark, df.limit(0), str(tmp_path / "index"), {"k": 1}).collect()
    assert records.schema_problems(df, {"n": "int", "m": "string"}) == ["m: missing, not string"]
    assert records.markdown(df) == "| n | s |\n| --- | --- |\n| 1 | a |"


def test_video_and_image_metadata(spark):
    probe = '{"format": {"duration": "2.5", "tags": {"location": "+48.85+002.35/"}}, "streams": [{"width": 10, "height": 20, "codec_name": "h264"}]}'
    v = spark.createDataFrame([(probe,)], "p string").select(records.video_metadata(F.col("p")).alias("v")).first().v
    assert (v.duration, v.width, v.codec, v.rotation, v.location) == (2.5, 10, "h264", 0, [48.85, 2.35])
    import struct

    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0110, 2, 6, 26) + struct.pack("<I", 0) + b"Cam X\0"
    got = spark.createDataFrame([(b"\xff\xd8..Exif\0\0" + tiff,), (b"none",)], "c binary").select(records.image_metadata("c").alias("m")).collect()
    assert got[0].m.device == "Cam X" and got[1].m.device is None


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + k % 26) for k in range(2000))
    rows = render.chunk_text(spark.createDataFrame([(1, text), (2, "short"), (3, "")], "item_id int, text string")).collect()
    mine = sorted((r.chunk, r.chunk_text) for r in rows if r.item_id == 1)
    assert "".join(c if k == 0 else c[100:] for k, (_, c) in enumerate(mine)) == text and {r.item_id for r in rows} == {1, 2, 3}
