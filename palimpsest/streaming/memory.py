"""Memory that streams keep, in the order of time whatever the order of arrival: tiers with heat, and events of one city."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What `transformWithState` needs as spark.sql.streaming.stateStore.providerClass.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
MOVES = "owner long, seq long, ts timestamp, item_id long, topic string, move string, heat double"
EVENTS = "owner long, start timestamp, end timestamp, city string, n long"
WAITING = "item_id long, ms long, label string"


@dataclass(frozen=True)
class Tiers:
    """Short: the last `short` items, first in first out. Middle: segments by topic, `middle` at most, whose heat halves in `half_days`
    and grows by one with each item that comes from the short tier. Long: a segment goes there when its heat reaches `hot`.
    """

    short: int = 10
    middle: int = 4
    hot: float = 5.0
    half_days: float = 7.0

    def heat(self, segment: tuple, ms: int) -> float:
        return segment[0] * math.pow(0.5, max(0, ms - segment[1]) / (self.half_days * DAY_MS))

    def take(self, queue: list, segments: dict, moved: int, item: int, ms: int, topic: str) -> list[tuple]:
        """Puts an item in the short tier; what moves then, as (seq, ms, item_id, topic, move, heat). The state is changed in place.

        The coldest segment, the first by topic among equals, is forgotten when there is one too many; the segment that the item
        went to may be that one.
        """
        out = []

        def tell(item_id, name, move, heat):
            out.append((moved + len(out), ms, item_id, name, move, round(heat, 6)))

        queue.append((item, topic))
        while len(queue) > self.short:
            old, name = queue.pop(0)
            heat = self.heat(segments[name], ms) + 1.0 if name in segments else 1.0
            tell(old, name, "middle", heat)
            if heat >= self.hot - 1e-9:
                tell(old, name, "long", heat)
                segments.pop(name, None)
                continue
            segments[name] = (heat, ms)
            if len(segments) > self.middle:
                cold = min(segments, key=lambda s: (round(self.heat(segments[s], ms), 9), s))
                tell(None, cold, "forgotten", self.heat(segments.pop(cold), ms))
        return out


def _labels(rows: DataFrame, owner: str, item: str, ts: str, label: str) -> DataFrame:
    clean = rows.select(F.col(owner).cast("long").alias("owner"), F.col(item).cast("long").alias("item_id"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(label), F.lit("")).alias("label"))
    return clean.where("owner is not null and item_id is not null and ts is not null")


def _moves(owner: int, told: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(told, columns=["seq", "ts", "item_id", "topic", "move", "heat"])
    out["ts"] = pd.to_datetime(out["ts"], unit="ms").astype("datetime64[us]")
    out["item_id"] = out["item_id"].astype("Int64")
    out.insert(0, "owner", owner)
    return out


def tier_moves(rows: DataFrame, tiers: Tiers = Tiers(), owner: str = "owner", item: str = "item_id", ts: str = "ts", topic: str = "topic") -> DataFrame:
    """(owner, seq, ts, item_id, topic, move, heat): every move between the tiers of each owner, from a whole table.

    Items are taken by time (milliseconds), then item_id; seq numbers an owner's moves from 0. move: `middle`, `long`, `forgotten` (item_id null).
    Null topics are an empty one; rows without owner, item or time are left out; an item that comes twice at one time is one.
    The order is one of time, so an owner is read by one task, row by row; the task holds the tiers of one owner.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, queue, segments, moved = None, [], {}, 0
        for rows in parts:
            told: dict[int, list] = {}
            for who, item_id, ms, name in zip(rows["owner"], rows["item_id"], rows["ms"], rows["label"], strict=True):
                if who != now:
                    now, queue, segments, moved = who, [], {}, 0
                new = tiers.take(queue, segments, moved, int(item_id), int(ms), name)
                moved += len(new)
                told.setdefault(int(who), []).extend(new)
            for who, some in told.items():
                if some:
                    yield _moves(who, some)

    clean = _labels(rows, owner, item, ts, topic).withColumn("ms", F.unix_millis("ts"))
    once = clean.groupBy("owner", "ms", "item_id").agg(F.min("label").alias("label"))
    return once.repartition("owner").sortWithinPartitions("owner", "ms", "item_id").mapInPandas(read, MOVES)


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then takes them by time: results depend on no batch.

    A timer stands at the earliest row that waits. Rows later than the watermark are dropped by Spark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def pass_on(self, owner: int, rows: list[tuple], watermark: int) -> pd.DataFrame | None:
        """Takes rows (ms, item_id, label), in order, none of which will be followed by an earlier one."""
        raise NotImplementedError

    def wake_at(self) -> int | None:
        """A further time at which `pass_on` is to be called."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            stamps = part["ts"].astype("datetime64[ms]").astype("int64")
            new += [(int(i), int(ms), str(x)) for i, ms, x in zip(part["item_id"], stamps, part["label"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(ms for _, ms, _ in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted({(ms, i): x for i, ms, x in sorted(held, key=lambda r: r[2], reverse=True) if ms <= mark}.items())
        rest = [r for r in held if r[1] > mark]
        if ready:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[1] for r in rest))
            else:
                self.waiting.clear()
        out = self.pass_on(int(key[0]), [(ms, i, x) for (ms, i), x in ready], mark)
        wake = self.wake_at()
        if wake is not None and wake > mark:
            self.handle.registerTimer(wake)
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


class _TierProcessor(InOrder):
    def __init__(self, tiers: Tiers):
        self.tiers = tiers

    def open(self, handle):
        self.queue = handle.getListState("short", "item_id long, topic string")
        self.segments = handle.getMapState("middle", "topic string", "heat double, ms long")
        self.moved = handle.getValueState("moved", "n long")

    def pass_on(self, owner, rows, watermark):
        if not rows:
            return None
        queue = [tuple(r) for r in self.queue.get()]
        segments = {k[0]: tuple(v) for k, v in self.segments.iterator()}
        before, moved, told = set(segments), (self.moved.get() or (0,))[0], []
        for ms, item, topic in rows:
            told += self.tiers.take(queue, segments, moved + len(told), item, ms, topic)
        self.queue.put(queue)
        for topic in before - set(segments):
            self.segments.removeKey((topic,))
        for topic, value in segments.items():
            self.segments.updateValue((topic,), value)
        self.moved.update((moved + len(told),))
        return _moves(owner, told) if told else None


class _CityProcessor(InOrder):
    def __init__(self, gap_days: int):
        self.gap_days = gap_days

    def open(self, handle):
        self.event = handle.getValueState("event", "start long, end long, city string, n long")

    def pass_on(self, owner, rows, watermark):
        self.now = self.event.get() if self.event.exists() else None
        closed = []
        for ms, _, city in rows:
            now = self.now
            if now is not None and city == now[2] and ms // DAY_MS - now[1] // DAY_MS <= self.gap_days:
                self.now = (now[0], ms, city, now[3] + 1)
            else:
                closed += [now] if now is not None else []
                self.now = (ms, ms, city, 1)
        if self.now is not None and watermark >= self.over(self.now):
            closed.append(self.now)
            self.now = None
        if self.now is None:
            self.event.clear()
        else:
            self.event.update(tuple(self.now))
        out = pd.DataFrame([tuple(c) for c in closed], columns=["start", "end", "city", "n"])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c], unit="ms").astype("datetime64[us]")
        out.insert(0, "owner", owner)
        return out

    def over(self, event) -> int:
        """When no row can belong to an event any more: its last day, the gap and a day."""
        return (event[1] // DAY_MS + self.gap_days + 1) * DAY_MS

    def wake_at(self):
        return None if self.now is None else self.over(self.now)


def _streamed(stream: DataFrame, processor: InOrder, kind: str, late: str, *columns: str) -> DataFrame:
    rows = _labels(stream, *columns).withWatermark("ts", late)
    return rows.groupBy("owner").transformWithStateInPandas(processor, kind, "Append", "EventTime")


def tier_stream(stream: DataFrame, tiers: Tiers = Tiers(), late: str = "1 day", owner: str = "owner", item: str = "item_id", ts: str = "ts", topic: str = "topic") -> DataFrame:
    """`tier_moves` of a stream. The tiers are list, map and value state; rows wait for the watermark. Needs the `ROCKSDB` state store and UTC sessions."""
    return _streamed(stream, _TierProcessor(tiers), MOVES, late, owner, item, ts, topic)


def city_event_stream(stream: DataFrame, gap_days: int = 2, late: str = "1 day", owner: str = "owner", item: str = "item_id", ts: str = "ts", city: str = "city") -> DataFrame:
    """`city_events` of a stream; an event comes out when another follows, or a timer says that none of its rows can come any more."""
    return _streamed(stream, _CityProcessor(gap_days), EVENTS, late, owner, item, ts, city)


def city_events(rows: DataFrame, gap_days: int = 2, owner: str = "owner", item: str = "item_id", ts: str = "ts", city: str = "city") -> DataFrame:
    """(owner, start, end, city, n): runs of one city without a gap of more than `gap_days` calendar days, from a whole table.

    Rows are taken by time (milliseconds), then item; those without owner, item or time are left out, null cities are an empty one, and
    an item that comes twice at one time is one.
    """
    clean = _labels(rows, owner, item, ts, city).withColumn("ms", F.unix_millis("ts"))
    once = clean.groupBy("owner", "ms", "item_id").agg(F.min("label").alias("city"))
    w = Window.partitionBy("owner").orderBy("ms", "item_id")
    day = F.floor(F.col("ms") / DAY_MS)
    once = once.withColumn("_day", day)
    new = (F.lag("city").over(w) != F.col("city")) | (F.col("_day") - F.lag("_day").over(w) > gap_days)
    runs = once.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long")).withColumn("_run", F.sum("_new").over(w))
    out = runs.groupBy("owner", "_run", "city").agg(F.min("ms").alias("a"), F.max("ms").alias("b"), F.count("*").alias("n"))
    return out.select("owner", F.timestamp_millis("a").alias("start"), F.timestamp_millis("b").alias("end"), "city", "n")
