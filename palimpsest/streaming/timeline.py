"""Streaming forms of the sequential parts: sessions, open events, resumption, incremental indexing, tiered memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def event_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def sessions(stream: DataFrame, gap: str = "3 days", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): sessions by inactivity. An approximation of the batch islands, which count calendar days."""
    out = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", "w.start", "w.end", "n")


def sliding_counts(stream: DataFrame, width: str = "1 day", slide: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(start, end, event_type, n): counts in sliding windows; an extension."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select("w.start", "w.end", "event_type", "n")


def once_each(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark: resumption without repeats."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


OPEN_EVENT = "user_id long, start timestamp, end timestamp, city string, n long"


def open_events(stream: DataFrame, gap_days: int = 2, late: str = "1 day") -> DataFrame:
    """(user_id, start, end, city, n): events that are closed by a gap, a change of city, or time.

    The open event of each user is the state: its first and last time, its city and its size. Rows of a batch
    are taken in the order of time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = []
        if state.hasTimedOut:
            closed.append(state.get)
            state.remove()
        else:
            now = list(state.get) if state.exists else None
            if now is not None:
                now[:2] = map(pd.Timestamp, now[:2])
            rows = pd.concat(list(parts)).sort_values("ts")
            for ts, city in zip(rows["ts"], rows["event_type"], strict=True):
                if now is not None and (ts.normalize() - now[1].normalize()).days <= gap_days and city == now[2]:
                    now[1], now[3] = max(now[1], ts), now[3] + 1
                else:
                    if now is not None:
                        closed.append(tuple(now))
                    now = [ts, ts, city, 1]
            state.update(tuple(now))
            state.setTimeoutTimestamp(int(max(now[1].timestamp(), state.getCurrentWatermarkMs() / 1000) * 1000) + (gap_days + 1) * 86_400_000)
        if closed:
            yield pd.DataFrame([(key[0], *c) for c in closed], columns=["user_id", "start", "end", "city", "n"])

    rows = stream.select("user_id", "ts", "event_type").withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(step, OPEN_EVENT, "start timestamp, end timestamp, city string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def short_term(stream: DataFrame, capacity: int, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, ts): what leaves a first-in first-out memory of `capacity` items for each user."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times = (list(x) for x in state.get) if state.exists else ([], [])
        for rows in parts:
            for i, ts in sorted(zip(rows["event_id"], rows["ts"], strict=True), key=lambda x: (x[1], x[0])):
                ids.append(int(i))
                times.append(ts)
        gone = max(0, len(ids) - capacity)
        state.update((ids[gone:], times[gone:]))
        if gone:
            yield pd.DataFrame({"user_id": key[0], "event_id": ids[:gone], "ts": times[:gone]})

    rows = stream.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp", "ids array<long>, times array<timestamp>", "append", GroupStateTimeout.NoTimeout)


def index_stream(items: DataFrame, path: str, checkpoint: str, most_segments: int = 8) -> StreamingQuery:
    """Adds each batch of items (item_id, text) to the lexical index at `path`, and merges its segments when there are many.

    A batch that is run again after a failure is known by its number and changes nothing.
    """
    from ..retrieval.lexical import LexicalIndex

    def add(batch: DataFrame, number: int) -> None:
        index = LexicalIndex(batch.sparkSession, path)
        if index.add(batch, str(number)) and len(index.segments) > most_segments:
            index.compact()

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
