"""Token ids in Parquet list columns that allow selective reads of tokens and metadata.

Documents are put in order of their id by a range shuffle, encoded while they stream through a task, and
written by Spark's Parquet writer: ids as a dictionary-encoded list column, counts and offsets as
delta-encoded integers, row groups and pages of bounded size with page indexes. Each file holds a range of
document ids; `part` is its place in the order and `local_start` counts ids within it, so the global start
of a document needs one sum for each file only.

Where the tokenizer's own definition says that white space is dropped and no token crosses it, a text is cut at
ASCII white space and each distinct piece of a batch is encoded once. A Python worker remembers the ids of words
it saw of late, in at most `REMEMBERED` bytes; others are encoded again.

Defined results
    null text       is encoded as the empty text: the end id alone
    repeated ids    rows with one id follow each other in the order of their text's hash; each has its own ids
    null id         comes first
    long texts      are one list; a document's ids are the unit of reading
    empty table     files without rows, which read back as none
    extra columns   those named in `metadata` are written beside the ids, the others are not
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, batches_of, table, trimmed

END_ID = 2
#: Bytes of words that a Python worker remembers, what an entry takes at most, and the longest word that is kept.
REMEMBERED = 64 << 20
ENTRY_BYTES = 256
LONG_WORD = 24
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
BATCH_BYTES = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: How a tokenizer must be defined for the fast path, and the letters from U+00C0 to U+00FF, which are
#: their own canonical form and have one lower-case letter each.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = f"^[!-~{LETTERS}]+$"
_WORDS = "(" + WORD_PATTERN.replace("\\s\\p{L}\\p{N}", f"a-z{LETTERS}0-9").replace("\\p{L}", f"a-z{LETTERS}").replace("\\p{N}", "0-9") + ")"


def _byte_signs() -> dict[int, str]:
    """The sign by which a byte-level model writes each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Recent:
    """A dictionary that holds about `limit` bytes: of two halves the older one goes when the newer one is full."""

    def __init__(self, limit: int):
        self.half, self.new, self.old = limit // 2, {}, {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        out = list(map(self.new.get, keys))
        if self.old:
            back = {}
            for k in [k for k, found in enumerate(out) if found is None]:
                if (found := self.old.get(keys[k])) is not None:
                    out[k] = back[keys[k]] = found
            self.keep(back)
        return out

    def keep(self, found: dict[str, bytes]) -> None:
        """Takes in what is new, as far as it is short and there is room; the rest is a loss of time only."""
        items = [x for x in found.items() if len(x[0]) <= LONG_WORD]
        room = max(1, self.half // ENTRY_BYTES)
        for at in range(0, len(items), room):
            part = items[at : at + room]
            if len(self.new) + len(part) > room:
                self.old, self.new = self.new, {}
            self.new.update(part)


class Encoder:
    """Encodes texts to unsigned 32-bit ids.

    Where the tokenizer's definition says that white space is dropped and no token crosses it, the texts of a
    batch are cut at ASCII white space and each distinct piece is encoded once for the batch. Pieces of ASCII and
    Latin-1 letters are cut into words here, and the library's model gets each word that is not remembered;
    other pieces go through the whole tokenizer. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = _tokenizer(path)
        self.known = Recent(remembered)
        made = json.loads(self.tokenizer.to_str())
        added = made["added_tokens"]
        self.special = sorted(t["content"] for t in added)
        parts = lambda key, inner: (made[key] or {}).get(inner)
        apart = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]]) for t in added)
        self.in_pieces = (
            apart and parts("normalizer", "normalizers") == NORMALIZERS and parts("pre_tokenizer", "pretokenizers") == PRE_TOKENIZERS
            and made["model"]["type"] == "BPE" and not made["model"]["dropout"] and made["post_processor"] is None and made["truncation"] is None
        )
        self.signs = _byte_signs()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words that the model gets as they are."""
        tokenize, signs = self.tokenizer.model.tokenize, self.signs
        out = self.known.find(words)
        new = {}
        for k in [k for k, found in enumerate(out) if found is None]:
            word = words[k]
            tokens = tokenize(word if word.isascii() else "".join(map(signs.__getitem__, word.encode())))
            out[k] = new[word] = array("I", [t.id for t in tokens]).tobytes()
        self.known.keep(new)
        return out

    def _odd(self, pieces: list[str]) -> list[bytes]:
        names = [f" {p}" for p in pieces]  # no word begins with a space
        out = self.known.find(names)
        new = [k for k, found in enumerate(out) if found is None]
        for k, found in zip(new, self._ids([pieces[k] for k in new]), strict=True):
            out[k] = found
        self.known.keep({names[k]: out[k] for k in new})
        return out

    def _pieces(self, pieces: pa.StringArray) -> pa.ListArray:
        """The ids of each piece: those of its words in a row, or the tokenizer's answer to one with other signs."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        for special in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(pieces, special)))
        cut = pc.ascii_split_whitespace(pc.ascii_rtrim(pc.replace_substring_regex(pc.utf8_lower(pieces.filter(plain)), _WORDS, r"\1 "), " "))
        words = cut.flatten().dictionary_encode()
        ids, starts = _strung(_lists(self._words(words.dictionary.to_pylist())), words.indices, np.asarray(cut.offsets))
        if (odd := pc.invert(plain)).true_count:
            other = _lists(self._odd(pieces.filter(odd).to_pylist()))
            both = pa.concat_arrays([pa.ListArray.from_arrays(starts, ids), other])
            place = np.empty(len(pieces), np.int32)
            place[np.flatnonzero(np.asarray(plain))] = np.arange(len(starts) - 1)
            place[np.flatnonzero(np.asarray(odd))] = np.arange(len(starts) - 1, len(pieces))
            return both.take(pa.array(place))
        return pa.ListArray.from_arrays(starts, ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and the number of ids of each text."""
        if not self.in_pieces:
            found = _lists(self._ids(["" if t is None else t for t in texts.to_pylist()]))
            return np.asarray(found.values), np.diff(np.asarray(found.offsets, np.int64))
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = cut.flatten().dictionary_encode()
        ids, starts = _strung(self._pieces(pieces.dictionary), pieces.indices, np.asarray(cut.offsets) - cut.offsets[0].as_py())
        return np.asarray(ids), np.diff(np.asarray(starts, np.int64))


def _lists(ids: list[bytes]) -> pa.ListArray:
    size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4")))


def _strung(lists: pa.ListArray, chosen: pa.Array, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The chosen lists in a row, and where each run of them, which `ends` part, starts and the last one ends."""
    row = lists.take(chosen)
    return row.flatten(), pa.array(np.asarray(row.offsets)[ends])


@cache
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def _encode(path: str, end_id: int, keep: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, start = _encoder(path), 0
        part = TaskContext.get().partitionId()
        for batch in batches_of(batches, 4096, BATCH_BYTES, "text"):
            ids, sizes = encoder.encode(batch.column(batch.schema.get_field_index("text")))
            at = np.cumsum(sizes)
            flat = np.insert(ids.view(np.int32), at, np.int32(end_id))
            sizes = sizes + 1
            ends = at + np.arange(1, len(at) + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), lists], [*keep, "part", "local_start", "n_tokens", "ids"]
            )
            start += int(ends[-1])

    return scan


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = (),
    tokenizer: str | None = None,
    end_id: int = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Writes the token files of `docs` under `path`, in order of the id. `tokenizer` is a file that all executors have."""
    meta = F.struct(*[F.col(f"`{c}`") for c in metadata]).alias("metadata")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([meta] if metadata else []))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    keep = [c for c in rows.columns if c != "text"]
    added = [T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    coded = rows.mapInArrow(trimmed(_encode(tokenizer or default_tokenizer(), end_id, keep)), T.StructType([rows.schema[c] for c in keep] + added))
    coded.write.options(
        **{"compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0"}
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files with the global `start` of each; columns that are not used are not read."""
    rows = spark.read.parquet(path)
    size = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = size.select("part", before.alias("base"))  # one row for each file
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start", "part")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        flat = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
        ends = lists.offsets.to_pylist()
        sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
        names = ["doc_id", "start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sums, pa.int64())], [*names, "ids_crc32"])


def token_index(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of `read_tokens`."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, schema)


def tokenized(docs: DataFrame, **options) -> DataFrame:
    """Writes the token files of `docs` to the shared folder and returns the index read back from them."""
    path = Scratch(docs.sparkSession, "tokens").path("files")
    write_tokens(docs, path, **options)
    return token_index(read_tokens(docs.sparkSession, path))


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), metadata=("source", "lang"))
