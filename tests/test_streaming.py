from pyspark.sql import functions as F

from palimpsest.streaming import timeline


def feed(spark, tmp_path, parts):
    """Files that arrive one after the other, the last one only to move the watermark on."""
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = df.schema
    return timeline.event_stream(spark, str(tmp_path / "in"), schema)


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return spark.table(name).collect()


PARTS = [
    [(1, 1, "2024-01-01 10:00:00", "a"), (2, 1, "2024-01-02 10:00:00", "a"), (3, 2, "2024-01-01 09:00:00", "b")],
    [(4, 1, "2024-01-10 10:00:00", "a"), (5, 2, "2024-01-02 09:00:00", "c")],
    [(6, 9, "2024-03-01 00:00:00", "z"), (1, 1, "2024-01-10 10:00:00", "a")],
    [(7, 9, "2024-03-02 00:00:00", "z")],
]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    rows = run(spark, timeline.sessions(feed(spark, tmp_path, PARTS)), tmp_path, "sessions")
    assert {(r.user_id, str(r.start)[:10], r.n) for r in rows} >= {(1, "2024-01-01", 2), (2, "2024-01-01", 2)}


def test_open_events_close_by_gap_and_city(spark, tmp_path):
    rows = run(spark, timeline.open_events(feed(spark, tmp_path, PARTS)), tmp_path, "open_events")
    assert {(r.user_id, r.city, r.n) for r in rows} >= {(1, "a", 2), (2, "b", 1)}


def test_short_term_memory_gives_up_the_oldest(spark, tmp_path):
    rows = run(spark, timeline.short_term(feed(spark, tmp_path, PARTS), 1), tmp_path, "short_term")
    assert {(r.user_id, r.event_id) for r in rows} >= {(1, 1), (2, 3)}
