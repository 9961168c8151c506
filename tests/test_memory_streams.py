import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import memory
from palimpsest.streaming.timeline import event_stream

KIND = "item_id long, owner long, ms long, label string"
START = 1_704_067_200_000
HOUR = 3_600_000


def rows_of(seed, n=300):
    rng = random.Random(seed)
    at, out = START, []
    for k in range(n):
        at += rng.choice([0, HOUR, 5 * HOUR, 20 * HOUR])
        out.append((k, rng.choice([1, 1, 1, 2, 3]), at, rng.choice("aabbcde")))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def ms(t):
    return int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def moves(df):
    return sorted((r.owner, r.seq, ms(r.ts), r.item_id, r.topic, r.move, round(r.heat, 5)) for r in df.collect())


def by_hand(rows, short, middle, hot, half):
    """The tiers of each owner, item by item, with heats that are brought forward at every step."""
    out = []
    for owner in sorted({r[1] for r in rows}):
        queue, heats, last, seq = [], {}, None, 0
        for item, _, at, topic in sorted((r for r in rows if r[1] == owner), key=lambda r: (r[2], r[0])):
            if last is not None:
                heats = {t: h * 0.5 ** ((at - last) / (half * 24 * HOUR)) for t, h in heats.items()}
            last = at
            queue.append((item, topic))
            if len(queue) > short:
                old, name = queue.pop(0)
                heats[name] = heats.get(name, 0) + 1
                found = [(old, name, "middle", heats[name])]
                if heats[name] >= hot:
                    found.append((old, name, "long", heats.pop(name)))
                elif len(heats) > middle:
                    cold = min(heats, key=lambda t: (round(heats[t], 9), t))
                    found.append((None, cold, "forgotten", heats.pop(cold)))
                for i, t, move, h in found:
                    out.append((owner, seq, at, i, t, move, round(h, 5)))
                    seq += 1
    return sorted(out)


def close(a, b):
    assert [x[:6] for x in a] == [x[:6] for x in b]
    assert [x[6] for x in a] == pytest.approx([x[6] for x in b], abs=1e-4)


TIERS = memory.Tiers(short=3, middle=2, hot=2.5, half_days=4.0)


def test_tiers_equal_a_reading_by_hand(spark):
    rows = rows_of(1)
    want = by_hand(rows, 3, 2, 2.5, 4.0)
    assert {m[5] for m in want} == {"middle", "long", "forgotten"}
    odd = [(None, 1, START, "x"), (900, None, START, "x"), (901, 1, None, "x"), (902, 7, START, None)]
    close(moves(memory.tier_moves(frame(spark, rows + rows[:40] + odd), TIERS, topic="label")), want)
    assert memory.tier_moves(frame(spark, []), TIERS, topic="label").collect() == []


def played(spark, tmp_path, build, parts, name):
    """The rows of a stream of one file for each part."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", memory.ROCKSDB)
    try:
        for part in parts:
            df = frame(spark, part)
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = build(event_stream(spark, str(tmp_path / "in"), df.schema))
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert not q.isActive
        return spark.table(name)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def out_of_order(rows, cuts=4):
    """Files that overlap in time by less than the watermark's delay, repeated rows among them, and one that moves it past all."""
    rng = random.Random(9)
    late = sorted(rows, key=lambda r: (r[2] + rng.random() * 36 * HOUR))
    size = -(-len(late) // cuts)
    parts = [late[k : k + size] for k in range(0, len(late), size)]
    parts[1] = parts[1] + parts[1][:10]
    end = max(r[2] for r in rows) + 40 * 24 * HOUR
    return [*parts, [(10_000, 99, end, "z")], [(10_001, 99, end + HOUR, "z")]]


def test_a_stream_of_tiers_equals_the_table(spark, tmp_path):
    rows = rows_of(2, 120)
    found = played(spark, tmp_path, lambda s: memory.tier_stream(s, TIERS, "2 days", topic="label"), out_of_order(rows), "tiers")
    close(moves(found), by_hand(rows, 3, 2, 2.5, 4.0))


def test_a_stream_of_city_events_equals_the_table(spark, tmp_path):
    rows = rows_of(3, 120)
    found = played(spark, tmp_path, lambda s: memory.city_event_stream(s, 1, "2 days", city="label"), out_of_order(rows), "cities")
    want = memory.city_events(frame(spark, rows), 1, city="label")
    key = lambda df: sorted((r.owner, ms(r.start), ms(r.end), r.city, r.n) for r in df.collect())
    assert key(found.where("owner < 99")) == key(want)
