"""Line dedup with two Bloom filters and exact confirmation.

Pass 1 hashes the keys of eligible lines. Each task combines equal hashes, so a hot line is one word a
task, and sends the words to shards of the hash space. A shard fills two Bloom filters in the order of
arrival: `once` for what has been seen, and `twice` for what was in `once` already. Pass 2 probes the
`twice` filters while it reads the documents: a line not in them occurs in one document only and stays
without any shuffle. The rest are suspects; they alone are shuffled, by their full key, counted exactly and
given their one document. Pass 3 joins the lines to drop to their documents.

A filter never misses a repeat, and false suspects fall out in the exact count. Filters are sized by the
number of words of their shard, up to `filter_bytes` in all, the bound of what is broadcast. Beyond it they
fill up and more lines become suspects: the exact count then does more of the work, with the same result.

Defined results
    lines            the text split at \\n; null or empty text is one empty line
    key              the line with ASCII white space stripped at both ends and A-Z lower-cased
    dropped          keys of at least `min_length` code points found in at least `min_docs` documents lose all
                     their lines but those in the document with the largest id that holds it
    repeated rows    rows with one id are one document for the count, and each is rewritten
    null id          is one document, smaller than all others
    extra columns    are kept by `drop_repeated_lines`
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

MIN_LENGTH = 40
MIN_DOCS = 5
FILTER_BYTES = 64 << 20
BITS_PER_WORD = 12
PROBES = 6
#: Words that a task holds before it sends them on.
HELD_WORDS = 1 << 20
#: The white space that is stripped.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes, min_length: int) -> bytes | None:
    """The key of an eligible line, else None."""
    key = line.strip(SPACE)
    if len(key) < min_length or (len(key) < 4 * min_length and len(key.decode()) < min_length):
        return None
    return key.lower()


def keys_of(data: bytes, min_length: int) -> set[bytes]:
    return {k for k in (line_key(x, min_length) for x in data.split(b"\n")) if k is not None}


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for text in batch.column(batch.schema.get_field_index(column)):
        data = text.as_buffer()
        yield b"" if data is None else data.to_pybytes()


def _places(words: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers of each word, by double hashing; `bits` is a power of two."""
    step = (words >> np.uint64(32)) | np.uint64(1)
    return (words[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


class Bloom:
    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits >> 3, np.uint8) if data is None else data

    def has(self, words: np.ndarray) -> np.ndarray:
        at = _places(words, self.bits)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, words: np.ndarray) -> None:
        at = _places(words, self.bits).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _words_by_shard(shards: int, min_length: int):
    """(shard, words, again): hashes of eligible keys, once for each task that has them; `again` if two documents of it do."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def flush():
            words, count = np.unique(np.array(held, np.uint64), return_counts=True)
            held.clear()
            shard = (words % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            words, count, shard = words[order], count[order], shard[order]
            ids, starts = np.unique(shard, return_index=True)
            ends = np.append(starts[1:], len(shard))
            parts = [(words[a:b], words[a:b][count[a:b] > 1]) for a, b in zip(starts, ends, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([w.astype("<u8").tobytes() for w, _ in parts], pa.binary()), pa.array([t.astype("<u8").tobytes() for _, t in parts], pa.binary())],
                ["shard", "words", "again"],
            )

        for batch in batches:
            for data in _texts(batch, "text"):
                if len(data) >= min_length:
                    held += [xxhash.xxh3_64_intdigest(k) for k in keys_of(data, min_length)]
                if len(held) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    return scan


def _fill(max_bits: int):
    """(shard, bits, twice) of one shard: its words are kept as they come, 8 bytes each, to size the filters, then added in turn."""

    def fill(key, shard):
        parts = [(w.as_py(), a.as_py()) for w, a in zip(shard.column("words"), shard.column("again"), strict=True)]
        total = sum(len(w) for w, _ in parts) >> 3
        bits = min(max_bits, max(1 << 10, 1 << (total * BITS_PER_WORD).bit_length()))
        once, twice = Bloom(bits), Bloom(bits)
        for w, a in parts:
            words = np.frombuffer(w, "<u8").astype(np.uint64)
            if len(again := np.concatenate((np.frombuffer(a, "<u8").astype(np.uint64), words[once.has(words)]))):
                twice.add(again)
            once.add(words)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits], pa.int64()), "twice": pa.array([twice.data.tobytes()], pa.binary())})

    return fill


def twice_seen(docs: DataFrame, *, min_length: int = MIN_LENGTH, filter_bytes: int = FILTER_BYTES) -> tuple[int, dict[int, tuple[int, bytes]]]:
    """The number of shards and the filter of each shard that has words: at most filter_bytes in all."""
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = 1 << max(10, (8 * filter_bytes // shards).bit_length() - 1)
    words = docs.select("text").mapInArrow(_words_by_shard(shards, min_length), "shard long, words binary, again binary")
    filters = words.groupBy("shard").applyInArrow(_fill(most), "shard long, bits long, twice binary")
    return shards, {r["shard"]: (r["bits"], bytes(r["twice"])) for r in filters.toLocalIterator()}


def _suspects(shared, shards: int, min_length: int):
    """(id, key) of lines whose hash a filter has: each key once for a row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: Bloom(bits, np.frombuffer(data, np.uint8)) for s, (bits, data) in shared.value.items()}
        for batch in batches:
            keys, row = [], []
            for n, data in enumerate(_texts(batch, "text")):
                found = keys_of(data, min_length) if len(data) >= min_length else ()
                keys += found
                row += [n] * len(found)
            if not keys:
                continue
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            shard = (words % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            seen = np.zeros(len(keys), bool)
            ids, starts = np.unique(shard[order], return_index=True)
            for s, a, b in zip(ids.tolist(), starts.tolist(), np.append(starts[1:], len(order)).tolist(), strict=True):
                seen[order[a:b]] = filters[s].has(words[order[a:b]])
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")).take(pa.array(np.array(row, np.int64)[at])), pa.array([keys[k] for k in at.tolist()], pa.binary()).cast(pa.string())], ["id", "key"]
            )

    return scan


def lines_to_drop(docs: DataFrame, scratch: Scratch, *, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id, keys): the keys whose lines the document loses, from (id, text)."""
    shards, filters = twice_seen(docs, min_length=min_length, filter_bytes=filter_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = T.StructType([docs.schema["id"], T.StructField("key", T.StringType())])
    suspects = scratch.write(docs.select("id", "text").mapInArrow(_suspects(shared, shards, min_length), schema), "suspects")
    holders = suspects.groupBy("key", "id").agg(F.lit(1).alias("one"))
    often = holders.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    often = scratch.write(often.select("key", "keeper"), "often")  # a plain table, so that Spark can split a frequent line in the join
    drop = suspects.join(often, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
    return drop.groupBy("id").agg(F.collect_set("key").alias("keys"))  # no more than the document's own lines


def _rewrite(min_length: int, keep_text: bool, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop = batch.column(batch.schema.get_field_index("keys")).to_pylist()
            total, dropped, out = [], [], []
            for data, keys in zip(_texts(batch, "text"), drop, strict=True):
                lines = data.split(b"\n")
                total.append(len(lines))
                if keys:
                    gone = {k.encode() for k in keys}
                    lines = [x for x in lines if line_key(x, min_length) not in gone]
                dropped.append(total[-1] - len(lines))
                data = b"\n".join(lines)
                out.append(data if keep_text else hashlib.sha256(data).hexdigest())
            rest = [batch.column(batch.schema.get_field_index(n)) for n in names]
            text = pa.array(out, pa.binary()).cast(pa.string()) if keep_text else pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*rest, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), text], [*names, "n_lines", "n_dropped", "kept"])

    return scan


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES, keep_text: bool = True) -> DataFrame:
    """(row, n_lines, n_dropped, kept) for each row: `row` has the columns but the text; `kept` is the new text or its SHA-256."""
    scratch = Scratch(docs.sparkSession, "lines")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*rest).alias("row"))
    drop = lines_to_drop(rows.select("id", "text"), scratch, min_length=min_length, min_docs=min_docs, filter_bytes=filter_bytes)
    drop = drop.withColumnRenamed("id", "drop_id")
    joined = rows.join(drop, F.col("id").eqNullSafe(F.col("drop_id")), "left").select("row", "text", "keys")
    schema = T.StructType([rows.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_rewrite(min_length, keep_text, ["row"]), schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


#: Every document after its repeated lines have gone.
OP10_SQL = """
WITH line AS (
    SELECT doc_id, row_number() OVER () AS u, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), one AS (
    SELECT doc_id, u, unnest(range(1, len(ls) + 1)) AS nr, unnest(ls) AS line FROM line
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM one
), often AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT keyed.*, often.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, u
"""
