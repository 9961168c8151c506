"""Readers and writers of records, and the corpus that they make up."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.render import email_text, media_text
from ..schemas import EMAIL, MEDIA, QA

MODALITY_SPAN = 1 << 40


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """A file of JSON lines; a bad line ends the job, or with strict=False is skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a list, or from an object with a list under `qas`."""
    wrapped = T.StructType([*QA.fields, T.StructField("qas", T.ArrayType(QA))])
    rows = json_array(spark, path, wrapped)
    inner = rows.where("qas is not null").select(F.explode("qas").alias("r")).select("r.*")
    return rows.where("qas is null").drop("qas").unionByName(inner)


def evidence_list(c: Column, strict: bool = False) -> Column:
    """A list that may be written as a Python literal; strict takes such a text as empty."""
    if strict:
        return F.array().cast("array<string>")
    return F.coalesce(F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>"), F.array().cast("array<string>"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def json_recovered(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): the first balanced object of each file; null if it has none."""
    from ..functions.jsonx import balanced_object

    return whole_files(spark, path).select("path", balanced_object("value").alias("json"))


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, modificationTime, length, md5) of all files below a folder, of these suffixes in either case."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if suffixes:
        rows = rows.where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + r")$"))
    return rows.select("path", "modificationTime", "length", F.md5("content").alias("md5"))


def base64_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("payload"))


def run_artifacts(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(tag, agent, model, id, status, json) for each expected id and run: ok, malformed or missing.

    Layout: tag/agent/model/id/output/answer.json.
    """
    pattern = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)/output/answer\.json$"
    got = whole_files(spark, f"{path}/*/*/*/*/output/answer.json")
    part = lambda k: F.regexp_extract("path", pattern, k)
    got = got.select(part(1).alias("tag"), part(2).alias("agent"), part(3).alias("model"), part(4).alias("id"), "value", F.get_json_object("value", "$.answer").alias("answer"))
    runs = got.select("tag", "agent", "model").distinct()
    want = runs.join(ids.select("id").distinct())
    rows = want.join(got, ["tag", "agent", "model", "id"], "left")
    status = F.when(F.col("value").isNull(), "missing").when(F.col("answer").isNull(), "malformed").otherwise("ok")
    return rows.select("tag", "agent", "model", "id", status.alias("status"), F.col("value").alias("json"))


SWEEP = r"sweep_([a-z]+)_([a-z_]+)_m([0-9.]+)_s([0-9.]+)_d([0-9.]+)_([a-z]+)"


def sweep_parameters(name: Column) -> Column:
    """(split, fusion, m, s, d, filter) from a directory's name; null if it is none of a sweep."""
    part = lambda k: F.regexp_extract(name, SWEEP, k)
    fields = F.struct(part(1).alias("split"), part(2).alias("fusion"), *[part(k).try_cast("double").alias(n) for k, n in ((3, "m"), (4, "s"), (5, "d"))], part(6).alias("filter"))
    return F.when(name.rlike(SWEEP), fields)


def schema_problems(df: DataFrame, required: Mapping[str, str]) -> list[str]:
    """What a table lacks of the required columns and types."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'missing')}, not {t}" for c, t in required.items() if have.get(c) != t]


def question_counts(qa: DataFrame) -> DataFrame:
    """One row: questions, those without evidence, those whose answer abstains, those without id or question."""
    return qa.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0).alias("no_evidence"),
        F.count_if(tx.is_abstention("answer")).alias("abstain"),
        F.count_if((tx.blank("id") == "") | (tx.blank("question") == "")).alias("incomplete"),
    )


def corpus(emails: DataFrame, images: DataFrame, videos: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Memory items: emails, images, then videos, in the order of column `pos` of each table.

    item_ord is the rank of the kind times 2^40 plus the position; it is the tie-break everywhere.
    """
    parts = []
    for rank, (kind, df, path) in enumerate((("email", emails, None), ("image", images, "image_path"), ("video", videos, "video_path"))):
        item = F.col("id") if path is None else tx.stem(path)
        df = df.withColumns({"item_id": item, "modality": F.lit(kind)})
        text = email_text(df, fields) if path is None else media_text(df, fields)
        meta = F.map_filter(
            F.create_map(*[x for n in ("timestamp", "location_name", "city", "subject", "sender") if n in df.columns for x in (F.lit(n), tx.blank(n))]), lambda _, v: v != ""
        )
        parts.append(
            df.select(
                "item_id", "modality", text.alias("text"), (F.col("image_path") if kind == "image" else F.lit(None).cast("string")).alias("image_path"),
                (F.col("video_path") if kind == "video" else F.lit(None).cast("string")).alias("video_path"), meta.alias("metadata"),
                (F.lit(rank * MODALITY_SPAN) + F.col("pos")).alias("item_ord"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def index_key(config: Mapping[str, object]) -> str:
    """The name of a stored index: a digest of its settings."""
    import hashlib
    import json

    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def stored(spark: SparkSession, df: DataFrame, root: str, config: Mapping[str, object]) -> DataFrame:
    """The table of these settings below `root`: read if it is there, else made and written."""
    path = f"{root}/index_key={index_key(config)}"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> Column | bool:
    """Whether two tables have the same set of keys."""
    return a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty()


def eml_headers(raw: Column) -> Column:
    """The headers of a raw email as a map with lower-case names; folded lines are joined, the first of a name wins."""
    head = F.regexp_replace(F.split(F.replace(tx.blank(raw), F.lit("\r\n"), F.lit("\n")), "\n\n", 2)[0], r"\n[ \t]+", " ")
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike("^[!-9;-~]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), 1)["v"]))


def eml_body(raw: Column) -> Column:
    """What follows the headers, as text if it is a page."""
    body = F.coalesce(F.try_element_at(F.split(F.replace(tx.blank(raw), F.lit("\r\n"), F.lit("\n")), "\n\n", 2), F.lit(2)), F.lit(""))
    return F.trim(F.when(body.rlike(r"(?is)<(html|body|p|div|br)\b"), tx.html_to_text(body)).otherwise(body))


ISO6709 = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"


def video_location(c: Column) -> Column:
    """[lat, lon] of an ISO 6709 text; null if it is none or out of range."""
    lat, lon = (F.regexp_extract(c, ISO6709, k).try_cast("double") for k in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.array(lat, lon))


def video_metadata(probe: Column) -> Column:
    """Duration, size, codec, rotation and place from the JSON of a media probe."""
    at = lambda p: F.get_json_object(probe, p)
    place = F.coalesce(at("$.format.tags.location"), at("$['format']['tags']['com.apple.quicktime.location.ISO6709']"))
    return F.struct(
        at("$.format.duration").try_cast("double").alias("duration"), at("$.streams[0].width").try_cast("int").alias("width"), at("$.streams[0].height").try_cast("int").alias("height"),
        at("$.streams[0].codec_name").alias("codec"), F.coalesce(at("$.streams[0].tags.rotate").try_cast("int"), F.lit(0)).alias("rotation"), video_location(place).alias("location"),
        at("$.format.tags.creation_time").alias("timestamp"),
    )


EXIF = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("device", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


def _exif(content: bytes) -> dict:
    """Timestamp, model and place of a JPEG's EXIF block, by the tags of the TIFF format."""
    import struct

    at = content.find(b"Exif\0\0")
    if at < 0:
        return {}
    tiff = content[at + 6 :]
    order = "<" if tiff[:2] == b"II" else ">"
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def entries(offset: int) -> dict:
        out = {}
        (n,) = struct.unpack_from(order + "H", tiff, offset)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, offset + 2 + 12 * k)
            size = sizes.get(kind, 1) * count
            where = offset + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", tiff, offset + 10 + 12 * k)[0]
            if kind == 2:
                out[tag] = tiff[where : where + count].split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (3, 4):
                out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, where)[0]
            elif kind in (5, 10):
                pairs = struct.unpack_from(order + ("II" if kind == 5 else "ii") * count, tiff, where)
                out[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        return out

    try:
        first = entries(struct.unpack_from(order + "I", tiff, 4)[0])
        inner = entries(first[0x8769]) if 0x8769 in first else {}
        gps = entries(first[0x8825]) if 0x8825 in first else {}
    except (struct.error, IndexError):
        return {}

    def degrees(values: int, side: int):
        if not isinstance(gps.get(values), list) or len(gps[values]) < 3:
            return None
        d, m, s = gps[values][:3]
        return (-1 if str(gps.get(side)).upper() in ("S", "W") else 1) * (d + m / 60 + s / 3600)

    return {"timestamp": inner.get(0x9003) or first.get(0x0132), "device": first.get(0x0110), "lat": degrees(2, 1), "lon": degrees(4, 3)}


@F.pandas_udf(EXIF)
def image_metadata(content: pd.Series) -> pd.DataFrame:
    """EXIF of image files. Binary structures are beyond column functions."""
    out = pd.DataFrame([_exif(c or b"") for c in content], columns=["timestamp", "device", "lat", "lon"])
    return out.astype({"timestamp": object, "device": object, "lat": float, "lon": float})


def media_rows(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, MEDIA)


def email_rows(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, EMAIL)


def write_rows(df: DataFrame, path: str, kind: str = "json", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """JSON lines, CSV with header, or Parquet."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown: `most` rows at most, for reports."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows])


def html_report(df: DataFrame, title: str, most: int = 1000) -> str:
    import html

    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.limit(most).collect())
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"
