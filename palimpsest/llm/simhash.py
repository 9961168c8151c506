"""SimHash near-duplicate groups: fingerprints, pigeonhole blocks, verified links, components.

Distinct fingerprints alone take part in the search, so copies cost nothing more. A fingerprint is split
into `PARTS` parts; two fingerprints that differ in at most 2 bits agree in all but 2 of the parts, so they
share one of the keys made of PARTS - 2 parts. Fingerprints are joined on these keys and each candidate
pair is verified. A key that more than `crowd` fingerprints share would make pairs in the square of its
size. Its members are linked instead through every value one bit away: two values within 2 bits of each
other always have such a value in common, and any two values that have one in common are within 2 bits,
so these links are exact too, 65 rows for each member.

Defined results
    null or blank text   no shingles; fingerprint zero, linked like any other
    fewer words          a text of fewer words than a shingle is one shingle of all of them
    repeated rows        each row is returned; the same text gives the same fingerprint and component
    null doc_id          takes part in its group, never names it unless the group has no other id (then null)
    ties                 a component is named by its smallest doc_id
    long texts           are hashed in pieces that carry over the last words, so memory is bounded
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, table
from .nearjaccard import deduplicate_similar, one_of_each

SHINGLE = 3
DISTANCE = 2
SEED = 42
PARTS = 6
CROWD = 24
PIECE = 1 << 20


def _word_lists(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Lower-cased words of a UTF-8 text, in lists from about `piece` bytes each."""
    if len(data) <= piece:
        yield data.lower().split()
        return
    at, rest = 0, b""
    while at < len(data):
        part = rest + data[at : at + piece].lower()
        at += piece
        words = part.split()
        rest = b""
        if at < len(data) and words and not part[-1:].isspace():
            rest = words.pop()
        yield words
    if rest:
        yield [rest]


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros(64, np.int64)
    for k in range(0, len(bits), 255):
        total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    data = text.encode() if text else b""
    total, count, held = np.zeros(64, np.int64), 0, []
    for words in _word_lists(data):
        held += words
        if len(held) >= width:
            for at in range(0, len(held) - width + 1, 1 << 15):
                got = _hashes(held[at : at + (1 << 15) + width - 1], width)
                total, count = total + _ones(got), count + len(got)
            held = held[len(held) - width + 1 :] if width > 1 else []
    if not count and held:
        total, count = _ones(_hashes(held, len(held))), 1
    return sum(1 << b for b in np.flatnonzero(2 * total > count).tolist())


def _fingerprints(column: str, width: int, out: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(column)
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(k)], np.uint64).view(np.int64)
            keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != column]
            yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(found)], [n for n, _ in keep] + [out])

    return scan


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", width: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """The rows without their text, with the fingerprint as a signed 64-bit integer."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField(out, T.LongType())])
    return docs.mapInArrow(_fingerprints(text_col, width, out), schema)


def _keys(value, parts: int):
    """One (table, key) for each choice of parts - DISTANCE parts; the key is the value with the other parts cleared."""
    edges = [64 * k // parts for k in range(parts + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(parts), parts - DISTANCE)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(number).alias("t"), value.bitwiseAND(F.lit(mask).cast("long")).alias("k")))
    return F.array(*out)


def fingerprint_links(values: DataFrame, scratch: Scratch, *, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """(u, v) links between distinct `fp` values; all are within 2 bits, and they connect what is within 2 bits."""
    keyed = values.select("fp", F.explode(_keys(F.col("fp"), parts)).alias("b")).select("fp", "b.t", "b.k")
    size = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    keyed = scratch.write(keyed.join(size, ["t", "k"]), "blocks")
    few = keyed.where(F.col("n") <= crowd)
    a, b = few.select("t", "k", F.col("fp").alias("u")), few.select("t", "k", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    pairs = a.join(b, ["t", "k"]).where((F.col("u") < F.col("v")) & near).select("u", "v")
    crowded = keyed.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit((1 << k) - ((k == 63) << 64)).cast("long") for k in range(64)]])
    around = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    shared = around.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("z", "v")
    stars = around.join(shared, "z").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def _grouped(docs: DataFrame, *, id_col: str, text_col: str, width: int, parts: int, crowd: int) -> DataFrame:
    """(id, text_hash, fp, component, component_id) for each row; `component` names its group also where ids are null."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = scratch.write(with_fingerprint(rows, width=width, out="fp"), "fingerprints")
    values = rows.groupBy("fp").agg(F.min("id").alias("low"))
    links = fingerprint_links(values.select("fp"), scratch, parts=parts, crowd=crowd)
    groups = scratch.write(connected_components(links, scratch), "components")
    named = values.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    named = scratch.write(named, "named")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lows, "component").select("fp", "component", "component_id"), "fp").select("id", "text_hash", "fp", "component", "component_id")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    parts: int = PARTS,
    crowd: int = CROWD,
) -> DataFrame:
    """(id, fp, component_id) for each row: its fingerprint and the smallest id that links can reach."""
    return _grouped(docs, id_col=id_col, text_col=text_col, width=width, parts=parts, crowd=crowd).select("id", "fp", "component_id")


def deduplicate(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    similarity: float | None = None,
    parts: int = PARTS,
    crowd: int = CROWD,
) -> DataFrame:
    """One row of each group stays: that with the smallest id, of rows with that id the one with the smallest text hash.

    Groups are those of the 64-bit fingerprints. With `similarity` what fingerprints link is verified on whole shingle sets,
    and the sets find what is left (`nearjaccard`): at a similarity of 0.8 fingerprints differ in about 10 of 64 bits, in
    which no part of useful width stays equal.
    """
    if similarity is not None:
        scratch = Scratch(docs.sparkSession, "simhash-links")
        rows = docs.select(F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
        prints = scratch.write(with_fingerprint(rows, width=width, out="fp"), "fingerprints")
        links = scratch.write(fingerprint_links(prints.select("fp").distinct(), scratch, parts=parts, crowd=crowd), "links")
        return deduplicate_similar(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity, linked=(prints, links))
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    grouped = _grouped(docs, id_col=id_col, text_col=text_col, width=width, parts=parts, crowd=crowd)
    return one_of_each(docs, grouped.select("id", "text_hash", "component"), scratch, id_col=id_col, text_col=text_col)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple]) -> dict:
    """For tests: {id: (fingerprint hex, component)} by comparing all pairs of plain rows."""
    prints = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, SEED) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    name = {i: i for i in prints}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, j in combinations(sorted(prints), 2):
        if (prints[i] ^ prints[j]).bit_count() <= DISTANCE:
            a, b = sorted((root(i), root(j)))
            name[b] = a
    return {i: (f"{p:016x}", root(i)) for i, p in prints.items()}
