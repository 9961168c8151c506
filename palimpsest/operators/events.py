"""Events and trips from dated items, and repairs of groupings that a model proposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_DAYS = 2
CAPTIONS, TAGS, ENTITIES, LOCATIONS = 5, 8, 8, 4


def dominant(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): the most frequent non-empty value of each group; ties go to the one seen first."""
    counts = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    if not keys:
        return counts.orderBy(F.desc("_n"), "_first").limit(1).select(value)
    best = F.min_by(value, F.struct(-F.col("_n"), F.col("_first")))
    return counts.groupBy(*keys).agg(best.alias(value))


def home_city(items: DataFrame, owner: str | None = None) -> DataFrame:
    """The city of most dated items, for all or for each owner."""
    dated = items.where("ts is not null").select("*", F.struct("ts", "item_ord").alias("_o"))
    return dominant(dated, [owner] if owner else [], "city", "_o")


def day_cities(items: DataFrame, owner: str) -> DataFrame:
    """(owner, day, city, n): each active day with its dominant city, empty if no item has one."""
    dated = items.where("ts is not null").select(owner, F.to_date("ts").alias("day"), "city", F.struct("ts", "item_ord").alias("_o"))
    days = dated.groupBy(owner, "day").agg(F.count("*").alias("n"))
    return days.join(dominant(dated, [owner, "day"], "city", "_o"), [owner, "day"], "left").select(owner, "day", F.coalesce("city", F.lit("")).alias("city"), "n")


def event_days(items: DataFrame, owner: str, gap_days: int = GAP_DAYS) -> DataFrame:
    """(owner, day, city, n, event): days are one event while the gap to the day before and the city allow.

    The city is compared with that of the day before. Windows are by owner and over days, so a row is a day
    of an owner, however many items it has.
    """
    w = Window.partitionBy(owner).orderBy("day")
    days = day_cities(items, owner)
    new = F.coalesce((F.datediff("day", F.lag("day").over(w)) > gap_days) | (F.lag("city").over(w) != F.col("city")), F.lit(True))
    return days.withColumn("_new", new.cast("int")).withColumn("event", F.sum("_new").over(w).cast("int")).drop("_new")


def event_id(number: Column) -> Column:
    return F.concat(F.lit("E"), F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string")))


def events(items: DataFrame, owner: str, gap_days: int = GAP_DAYS) -> DataFrame:
    """(owner, event, event_id, kind, start, end, days, city, cities, item_count) of each event.

    A trip is an event whose city is known and not the owner's home.
    """
    days = event_days(items, owner, gap_days)
    base = days.groupBy(owner, "event").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("days"), F.sum("n").alias("item_count"),
        F.array_sort(F.collect_set(F.when(F.col("city") != "", F.col("city")))).alias("cities"),
    )
    city = dominant(days, [owner, "event"], "city", "day")
    home = home_city(items, owner).withColumnRenamed("city", "home")
    out = base.join(city, [owner, "event"], "left").join(home, owner, "left")
    trip = (F.coalesce("city", F.lit("")) != "") & (F.coalesce("home", F.lit("")) != "") & (F.col("city") != F.col("home"))
    return out.select(owner, "event", event_id(F.col("event")).alias("event_id"), F.when(trip, "trip").otherwise("event").alias("kind"), "start", "end", "days", F.coalesce("city", F.lit("")).alias("city"), "cities", "item_count")


def members(items: DataFrame, owner: str, gap_days: int = GAP_DAYS) -> DataFrame:
    """The dated items with the number of their event."""
    days = event_days(items, owner, gap_days).select(owner, "day", "event")
    return items.where("ts is not null").withColumn("day", F.to_date("ts")).join(days, [owner, "day"])


def top_values(rows: DataFrame, keys: list[str], value: Column, order: str, k: int, out: str) -> DataFrame:
    """(keys, out): the k most frequent values of each group as an array; ties in order of appearance."""
    each = rows.select(*keys, value.alias("_v"), F.col(order).alias("_o")).where("_v is not null and _v <> ''")
    counts = each.groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.min("_o").alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first", "_v"))
    few = counts.withColumn("_r", place).where(F.col("_r") <= k)
    return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias(out))


def sampled(rows: DataFrame, keys: list[str], value: str, order: list[str], k: int = CAPTIONS) -> DataFrame:
    """(keys, n, value): every step-th row of a group from the first, k at most; step = max(1, size // k)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.select(*keys, F.col(value), F.row_number().over(w).alias("_r"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    taken = numbered.where((F.col("_r") - 1) % step == 0).withColumn("n", ((F.col("_r") - 1) / step + 1).cast("int"))
    return taken.where(F.col("n") <= k).select(*keys, "n", value)


def in_range(rows: DataFrame, ranges: DataFrame, day: str, start: str = "start", end: str = "end", owner: str | None = None) -> DataFrame:
    """Rows joined to the ranges that hold their day. Ranges are spread over their days, so it is an equi-join.

    A range costs a row for each of its days; with an owner the join keeps owners apart.
    """
    spread = ranges.withColumn("_day", F.explode(F.sequence(start, end)))
    on = rows[day] == spread["_day"]
    if owner:
        on = on & (rows[owner] == spread[owner])
        spread = spread.withColumnRenamed(owner, "_owner")
        on = (rows[day] == spread["_day"]) & (rows[owner] == spread["_owner"])
    return rows.join(spread, on).drop("_day", "_owner")


def chunks(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds chunk: rows of a group in order, `size` to a chunk, from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def overlapping_windows(rows: DataFrame, keys: list[str], order: list[str], size: int, overlap: int) -> DataFrame:
    """Adds window: rows of a group in windows of `size` that share `overlap` rows; a row has one row for each of its windows."""
    step = max(1, size - overlap)
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    first = F.greatest(F.lit(0), F.floor((F.col("_r") - size) / step) + 1)
    return numbered.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("_r") / step)))).drop("_r")


def repair_ranges(ranges: DataFrame, lo: int, hi: int, key: str = "batch") -> DataFrame:
    """(key, start, end, title) that cover lo to hi without overlap: clamped, cut where they overlap, gaps filled.

    ranges: (key, start, end, title). A range that others cover whole goes.
    """
    clamped = ranges.select(key, F.greatest(F.col("start"), F.lit(lo)).alias("start"), F.least(F.col("end"), F.lit(hi)).alias("end"), "title").where("start <= end")
    w = Window.partitionBy(key).orderBy("start", "end", "title").rowsBetween(Window.unboundedPreceding, -1)
    cut = clamped.withColumn("_before", F.coalesce(F.max("end").over(w), F.lit(lo - 1)))
    kept = cut.where(F.col("end") > F.col("_before")).select(key, F.greatest(F.col("start"), F.col("_before") + 1).alias("start"), "end", "title")
    order = Window.partitionBy(key).orderBy("start")
    gaps = kept.select(key, (F.coalesce(F.lag("end").over(order), F.lit(lo - 1)) + 1).alias("start"), (F.col("start") - 1).alias("end")).where("start <= end")
    tail = kept.groupBy(key).agg((F.max("end") + 1).alias("start")).select(key, "start", F.lit(hi).alias("end")).where("start <= end")
    return kept.unionByName(gaps.unionByName(tail).withColumn("title", F.lit(None).cast("string")))


def repair_groups(groups: DataFrame, seeds: DataFrame, key: str = "batch") -> DataFrame:
    """(key, grp, seed): every seed in one group: unknown seeds go, the first group that claims a seed has it, the rest stand alone.

    groups: (key, grp, pos, seed); seeds: (key, seed).
    """
    known = groups.join(seeds, [key, "seed"], "left_semi")
    first = known.groupBy(key, "seed").agg(F.min(F.struct("grp", "pos")).alias("x")).select(key, F.col("x.grp").cast("string").alias("grp"), "seed")
    alone = seeds.join(first, [key, "seed"], "left_anti").select(key, F.concat(F.lit("solo:"), F.col("seed").cast("string")).alias("grp"), "seed")
    return first.unionByName(alone)


def carry_over(groups: DataFrame, owner: str, order: list[str], continues: str = "continues") -> DataFrame:
    """Adds event: a group that continues the one before belongs to its event; the first never does."""
    w = Window.partitionBy(owner).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.coalesce(F.col(continues), F.lit(False))).cast("int"))
    return groups.withColumn("_new", new).withColumn("event", F.sum("_new").over(w)).drop("_new")


def chronological(rows: DataFrame, keys: list[str], ts: str, order: str, out: str = "place") -> DataFrame:
    """Adds each row's place by time; rows without one come last."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_last(), order)))


def frame_budget(rows: DataFrame, keys: list[str], order: list[str], per_item: int, total: int, frames: str = "frames") -> DataFrame:
    """Adds granted: frames in turn, at most per_item for each and total for all."""
    want = F.least(F.col(frames), F.lit(per_item))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(want).over(w), F.lit(0))
    return rows.withColumn("granted", F.greatest(F.lit(0), F.least(want, F.lit(total) - used)))


def frame_times(videos: DataFrame, n: int, duration: str = "duration") -> DataFrame:
    """One row for each of n frames at even distances, none at the ends."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k * F.col(duration) / (n + 1)))
    return videos.select("*", at.alias("frame", "at"))


def merged_seeds(seeds: DataFrame, groups: DataFrame, k: int = 8) -> DataFrame:
    """(batch, grp, start, end, days, item_count, tags) of merged seed events. seeds: (batch, seed, start, end, days, item_count, tags)."""
    rows = groups.join(seeds, ["batch", "seed"])
    tags = F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "seed", "tags"))), lambda x: x["tags"]))), 1, k)
    return rows.groupBy("batch", "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("days").alias("days"), F.sum("item_count").alias("item_count"), tags.alias("tags"))
