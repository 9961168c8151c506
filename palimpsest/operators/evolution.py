"""Notes that change their neighbours as they are added, worked out for all notes at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .links import stored

REPLY = "links array<long>, own_tags array<string>, contexts array<string>, tags array<array<string>>"


def answered(replies: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Replies that are kept by prompt: (prompt, links, own_tags, contexts, tags). A prompt without one changes nothing."""
    kept = replies.dropDuplicates(["prompt"])
    return lambda prompts: prompts.join(kept, "prompt").drop("prompt")


def _prompts(notes: DataFrame, near: DataFrame, writes: DataFrame, asked: DataFrame | None) -> DataFrame:
    """(ord, prompt): what each note that is asked for sees: itself, and its neighbours as they are just before it."""
    mine = notes if asked is None else notes.join(asked, "ord", "left_semi")
    reads = near if asked is None else near.join(asked, "ord", "left_semi")
    nothing = (F.lit(None).cast("string").alias("context"), F.lit(None).cast("array<string>").alias("tags"))
    read = reads.select(F.col("neighbour").alias("target"), F.col("ord").alias("at"), F.lit(0).alias("wrote"), "pos", *nothing)
    first = notes.select(F.col("ord").alias("target"), F.lit(-1).cast("long").alias("at"), F.lit(1).alias("wrote"), F.lit(-1).alias("pos"), "context", "tags")
    later = writes.select("target", F.col("writer").alias("at"), F.lit(1).alias("wrote"), "pos", "context", "tags")
    known = first.unionByName(later)
    if asked is not None:
        known = known.join(read.select("target").distinct(), "target", "left_semi")
    until = Window.partitionBy("target").orderBy("at", "wrote", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = known.unionByName(read).select("at", "wrote", "pos", F.last("context", True).over(until).alias("context"), F.last("tags", True).over(until).alias("tags"))
    around = seen.where("wrote = 0").groupBy(F.col("at").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("pos", "context", "tags"))).alias("near"))
    shown = mine.join(around, "ord", "left").withColumn("near", F.transform(F.coalesce("near", F.array()), lambda x: F.struct(x["context"].alias("context"), x["tags"].alias("tags"))))
    return shown.select("ord", F.to_json(F.struct("content", "context", "tags", "near")).alias("prompt"))


def evolve_notes(notes: DataFrame, near: DataFrame, answer: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> tuple[DataFrame, int]:
    """((ord, context, tags, links), number of generations): the notes after all of them have been added in the order of ord.

    notes: (ord, content, context, tags), ord unique and from 0; near: (ord, pos, neighbour), each note's neighbours among earlier notes by
    pos from 0; later ones are left out. A note that is added sees its neighbours as they are then. Its reply may link it to earlier
    notes (other numbers are left out), give it tags, and give its neighbours new contexts and tags, by pos; null ones change nothing.
    answer: from (ord, prompt) to (ord, links, own_tags, contexts, tags), a row for each note that evolves; equal prompts get equal replies.

    The first generation asks for all notes as if none had changed another. Then only the notes that saw something that is
    different now are asked again, until there are none. A note depends on earlier ones alone, so after g generations the
    first g notes at least are final, and the end is that of adding one note after the other. The number of generations is
    the longest chain of changes. States as of a note come from one window by neighbour, so a hub costs its reads and writes, not their product.
    """
    spark = notes.sparkSession
    notes = stored(notes.select(F.col("ord").cast("long"), "content", "context", "tags"), "notes")
    near = stored(near.select(F.col("ord").cast("long"), F.col("pos").cast("int"), F.col("neighbour").cast("long")).where("neighbour < ord").join(notes.select(F.col("ord").alias("neighbour")), "neighbour", "left_semi"), "near")
    writes = spark.createDataFrame([], "writer long, pos int, target long, context string, tags array<string>")
    links = spark.createDataFrame([], "ord long, links array<long>")
    asked = None
    for generation in range(1, rounds + 1):
        replies = stored(answer(_prompts(notes, near, writes, asked)).selectExpr("ord", "links", "own_tags", "contexts", "tags"), "replies")
        own = replies.where(F.size("own_tags") > 0).select(F.col("ord").alias("writer"), F.lit(-1).alias("pos"), F.col("ord").alias("target"), F.lit(None).cast("string").alias("context"), F.col("own_tags").alias("tags"))
        told = near.join(replies, "ord").select(F.col("ord").alias("writer"), "pos", F.col("neighbour").alias("target"), F.get("contexts", F.col("pos")).alias("context"), F.get("tags", F.col("pos")).alias("tags"))
        new = stored(own.unionByName(told.where("context is not null or tags is not null")), "writes")
        good = F.filter("links", lambda x: (x >= 0) & (x < F.col("ord")))
        made = replies.select("ord", F.coalesce(good, F.array().cast("array<long>")).alias("links"))
        if asked is None:
            changed, writes, links = new, new, stored(made, "links")
        else:
            again = asked.withColumnRenamed("ord", "writer")
            old = writes.join(again, "writer", "left_semi").select(*new.columns)
            changed = old.exceptAll(new).unionByName(new.exceptAll(old))
            changed = stored(changed, "changed")
            writes = stored(writes.join(again, "writer", "left_anti").select(*new.columns).unionByName(new), "writes")
            links = stored(links.join(asked, "ord", "left_anti").unionByName(made), "links")
        since = changed.groupBy(F.col("target").alias("neighbour")).agg(F.min("writer").alias("since"))
        asked = stored(near.join(since, "neighbour").where("ord > since").select("ord").distinct(), "asked")
        if asked.isEmpty():
            break
    else:
        raise RuntimeError(f"notes did not settle in {rounds} generations")
    order = F.struct("writer", "pos")
    last = writes.groupBy(F.col("target").alias("ord")).agg(F.max_by("context", F.when(F.col("context").isNotNull(), order)).alias("_c"), F.max_by("tags", F.when(F.col("tags").isNotNull(), order)).alias("_t"))
    rows = notes.join(last, "ord", "left").join(links, "ord", "left")
    out = rows.select("ord", F.coalesce("_c", "context").alias("context"), F.coalesce("_t", "tags").alias("tags"), F.coalesce("links", F.array().cast("array<long>")).alias("links"))
    return out, generation
