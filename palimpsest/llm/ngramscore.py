"""Stupid-backoff scores of documents against the n-gram counts of all other documents.

Documents are read in blocks. A block's distinct n-grams, with their counts in the block, are split by hash
into packs, and the packs of one bucket meet in one task: that is the part of the count table with these
hashes. The packs are the exploded n-grams of a block in bulk; joined to the table, each gets the totals of
its n-grams back. Packs with totals then meet the word sequence of their block, and each document's n-gram
scores are summed. A frequent n-gram is one entry of each block's pack, so no bucket is hot.

    S(w | v) = c(v w) / c(v)          if c(v w) > 0
             = alpha c(w) / N         else, if c(w) > 0
             = alpha^2 / N            else
The first word has no context: c(w) / N, or alpha / N. With a higher `order` S(w | u v) is c(u v w) / c(u v) if
that count is there, else alpha S(w | v), and so on; a word near the start has the context there is. Counts c and the number of words N leave out what the
document itself adds, so a document is judged by the others alone. N is at least 1.

Defined results
    words           as for decontamination: runs of [0-9a-z] or U+0080 and above, after lower-casing A-Z
    null text       has no words: log_score 0, mean_score null
    repeated rows   each row is a document; the other rows with the same text count as other documents
    empty table     no rows
    long texts      are one block of their own if longer than a block
    hashes          64 bits stand for an n-gram
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table
from .decontaminate import word_pieces

ALPHA = 0.4
ORDER = 2
BLOCK_WORDS = 1 << 20
#: Odd constants that mix two hashes into one.
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * _MIX[0] + (b ^ (b >> np.uint64(31))) * _MIX[1]
        x ^= x >> np.uint64(32)
        x *= _MIX[0]
        return x ^ (x >> np.uint64(29))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _deltas(sorted_hashes: np.ndarray) -> np.ndarray:
    """Bytes of the gaps, plane by plane: the high planes are nearly all zero."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T


def _undeltas(planes: np.ndarray) -> np.ndarray:
    gaps = np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8")
    return np.cumsum(gaps, dtype=np.uint64)


class Block:
    """Word sequences of some documents, as places in the list of the block's words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids, self.sizes, self.parts, self.words = [], [], [], 0

    def add(self, id_, text: bytes) -> None:
        size = 0
        for words in word_pieces(text):
            number = self.number
            self.parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            size += len(words)
        self.ids.append(id_)
        self.sizes.append(size)
        self.words += size


def _grams(hashes: np.ndarray, seq: np.ndarray, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of 1 to `order` words that end at each position, and the position's place in its document."""
    place = np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = [hashes[seq]]
    for _ in range(1, order):
        longer = np.zeros(len(seq), np.uint64)
        longer[1:] = _pair(found[-1][:-1], found[0][1:])
        found.append(longer)
    return found, place


def _distinct(row: dict, buckets: int, order: int) -> tuple:
    """The n-grams of a block in the order of bucket and hash, their counts and buckets, and its positions' n-grams and places."""
    levels, place = _grams(_unpack(row["hashes"], "<u8"), _unpack(row["seq"], "<i4"), np.array(row["sizes"], np.int64), order)
    grams, counts = np.unique(np.concatenate([g[place >= k] for k, g in enumerate(levels)]), return_counts=True)
    bucket = (grams % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return grams[by], counts[by], bucket[by], levels, place


def _sequences(block_words: int):
    """(block, ids, sizes, seq, hashes): the documents of a block, their numbers of words, and all words in turn."""

    def row_of(block: Block, number: int) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, block.number), np.uint64, len(block.number))
        seq = np.concatenate(block.parts) if block.parts else np.zeros(0, np.int32)
        arrays = [
            pa.array([number], pa.int64()),
            pa.array([block.ids], pa.list_(pa.int64())),
            pa.array([block.sizes], pa.list_(pa.int64())),
            pa.array([_pack(seq)], pa.binary()),
            pa.array([_pack(hashes)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "sizes", "seq", "hashes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer()
                block.add(id_, b"" if data is None else data.to_pybytes())
                if block.words >= block_words or len(block.ids) >= block_words:
                    yield row_of(block, number)
                    number, block = number + 1, Block()
        if block.ids:
            yield row_of(block, number)

    return scan


def _packs(buckets: int, order: int):
    """(block, bucket, data, counts): the n-grams of a block by bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                grams, counts, bucket, *_ = _distinct(row, buckets, order)
                ids, starts = np.unique(bucket, return_index=True)
                spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(grams)], strict=True)) if len(ids) else []
                arrays = [
                    pa.array([row["block"]] * len(ids), pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array([_pack(_deltas(grams[lo:hi])) for lo, hi in spans], pa.binary()),
                    pa.array([_pack(counts[lo:hi].astype("<u4")) for lo, hi in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "bucket", "data", "counts"])

    return scan


def _totals(bucket):
    """Adds up the packs of a bucket and gives each its totals, in its own order: (block, bucket, totals)."""
    parts = [(b.as_py(), d.as_py(), c.as_py()) for b, d, c in zip(bucket.column("block"), bucket.column("data"), bucket.column("counts"), strict=True)]
    grams = [_undeltas(_unpack(d, np.uint8)) for _, d, _ in parts]
    counts = [_unpack(c, "<u4").astype(np.int64) for _, _, c in parts]
    every, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    ends = np.cumsum([0, *map(len, grams)])
    packed = [_pack(total[place[a:b]].astype("<i8").view(np.uint8).reshape(-1, 8).T) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"block": pa.array([p[0] for p in parts], pa.int64()), "bucket": bucket.column("bucket"), "totals": pa.array(packed, pa.binary())})


def _own_counts(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each (document, n-gram) of two parallel columns occurs, at each of its positions."""
    _, inverse, count = np.unique((doc << 32) | place, return_inverse=True, return_counts=True)
    return count[inverse]


def _score(words: int, buckets: int, alpha: float, order: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                ids, sizes = pa.array(row["ids"], pa.int64()), np.array(row["sizes"], np.int64)
                grams, _, _, levels, place = _distinct(row, buckets, order)
                packs = sorted(row["packs"] or [], key=lambda p: p["bucket"])
                totals = [np.ascontiguousarray(_unpack(p["totals"], np.uint8).reshape(8, -1).T).reshape(-1).view("<i8") for p in packs]
                totals = np.concatenate(totals) if totals else np.zeros(0, np.int64)
                by = np.argsort(grams)
                grams, totals = grams[by], totals[by]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                n = np.maximum(words - sizes, 1)[doc]
                context = np.minimum(place, order - 1)
                before, seen = None, np.zeros(len(place), bool)
                for k, level in enumerate(levels):
                    count, rest = np.zeros(len(place), np.int64), np.flatnonzero(place >= k)
                    at = np.searchsorted(grams, level[rest])
                    count[rest] = totals[at] - _own_counts(doc[rest], at)
                    seen = count > 0
                    if k == 0:
                        s = np.power(alpha, context) * np.where(seen, count / n, alpha / n)
                    else:
                        s = np.where(seen, np.power(alpha, np.maximum(context - k, 0)) * (count / np.maximum(before, 1)), s)
                    before = np.ones(len(place), np.int64)
                    before[1:] = count[:-1]
                ends, logs = np.cumsum(sizes), np.log(s)
                score = [float(logs[a:b].sum()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                back = [int((~seen[a:b]).sum()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                mean = [x / m if m else None for x, m in zip(score, sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array(back, pa.int64()), pa.array(score, pa.float64()), pa.array(mean, pa.float64())],
                    ["id", "n_words", "n_backoff", "log_score", "mean_score"],
                )

    return scan


def backoff_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, order: int = ORDER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_backoff, log_score, mean_score) for each row; n_backoff words have no count with `order` - 1 words before."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = rows.mapInArrow(_sequences(block_words), "block long, ids array<long>, sizes array<long>, seq binary, hashes binary")
    blocks = scratch.write(blocks, "sequences", compression="none")
    words = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    packs = blocks.select("block", "sizes", "seq", "hashes").mapInArrow(_packs(buckets, order), "block long, bucket long, data binary, counts binary")
    found = packs.groupBy("bucket").applyInArrow(_totals, "block long, bucket long, totals binary")
    found = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("packs"))  # one block's own n-grams
    both = blocks.join(found, "block", "left")
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_backoff", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_score", T.DoubleType())])
    return both.mapInArrow(_score(words, buckets, alpha, order), out)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    found = backoff_scores(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 6).alias("mean_score"))


#: Leave-one-out stupid-backoff scores of every document.
OP2_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS u, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws
    FROM documents
), t AS (
    SELECT u, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d
), p AS (
    SELECT u, k, w, lag(w) OVER (PARTITION BY u ORDER BY k) AS v FROM t
), u1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
o1 AS (SELECT u, w, count(*) AS c FROM t GROUP BY u, w),
u2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT u, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY u, v, w),
n AS (SELECT count(*) AS n FROM t),
s AS (
    SELECT p.u, u1.c - o1.c AS cw, coalesce(u2.c - o2.c, 0) AS cvw, uv.c - ov.c AS cv, p.v, greatest(n.n - len(d.ws), 1) AS n
    FROM p JOIN d USING (u) JOIN u1 USING (w) JOIN o1 ON o1.u = p.u AND o1.w = p.w CROSS JOIN n
    LEFT JOIN u2 ON u2.v = p.v AND u2.w = p.w LEFT JOIN o2 ON o2.u = p.u AND o2.v = p.v AND o2.w = p.w
    LEFT JOIN u1 uv ON uv.w = p.v LEFT JOIN o1 ov ON ov.u = p.u AND ov.w = p.v
), x AS (
    SELECT u, cvw > 0 AS seen, ln(CASE WHEN cvw > 0 THEN cvw / cv::DOUBLE
        ELSE (CASE WHEN v IS NULL THEN 1.0 ELSE 0.4 END)::DOUBLE * (CASE WHEN cw > 0 THEN cw / n::DOUBLE ELSE 0.4::DOUBLE / n END) END) AS s
    FROM s
), a AS (SELECT u, count(*) FILTER (WHERE NOT seen) AS b, sum(s) AS s FROM x GROUP BY u)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(a.b, 0) AS n_backoff, round(coalesce(a.s, 0), 4) AS log_score,
    round(a.s / len(d.ws), 6) AS mean_score
FROM d LEFT JOIN a USING (u)
"""
