"""Exact token counts of whole texts, most of them without the tokenizer.

`whole_tokens` proves ahead of counting which vocabulary strings the tokenizer encodes alone as one token: the
library's model merges each string, in tasks over slices of the vocabulary, and those that come out as
themselves stay. The proof is a table and is sent to the counting tasks; it is as large as the vocabulary at most.

A text is cut at spaces before a sign that is no white space. No pre-token crosses such a place, because in the
byte-level pattern a pre-token with a space in it begins with it, or is white space alone and leaves the last
space to the word that follows. A piece is counted once and remembered: it is taken apart by the pattern, or by
the library's own pre-tokenizer where it has signs other than ASCII and Latin-1 letters; each pre-token that is
proven counts one, and only the others are merged by the model. A Python worker remembers at most `REMEMBERED`
short pieces, and as many words; what it forgets is counted again.

The cut is used where the tokenizer's own definition is the byte-level one that it rests on (`in_pieces`). Other
tokenizers' .json files, and sentencepiece's .model files, get whole texts.

Defined results
    null text        counts as the empty text: no bytes, no tokens
    special strings  in a text are special tokens, as the library has it: one token each, and they end a pre-token
    long texts       are counted whole, without truncation; a piece without a space is merged as one
    repeated rows    each row is counted, whatever its id
    null id          is kept
    empty table      no rows
    extra columns    are left out, or kept beside the counts where `keep` names them
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, table, trimmed
from .tokens import _byte_signs

LIMIT = 512
BATCH_BYTES = 4 << 20
#: Short pieces that a worker remembers, and how long such a piece is at most.
REMEMBERED = 1 << 18
SHORT = 32
#: Vocabulary entries that one task of the proof takes.
SLICE = 4096
#: The pre-tokenizer whose pre-tokens the cut keeps whole, and its pattern for texts of PLAIN signs.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(rf"[\t\n\r !-~{LETTERS}]*")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Signs that are white space or might be in some library: no text is cut before a space that one of them follows.
BLANK = r"\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff"
CUT = re.compile(f"(?= [^{BLANK}])")
UNCUT = re.compile(rf" [{BLANK}]| \Z")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _library(path: str):
    """The tokenizer of a .json file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def _pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def in_pieces(path: str) -> bool:
    """Whether the tokenizer's definition is byte-level BPE with special tokens that take nothing beside them."""
    if not path.endswith(".json"):
        return False
    made = json.loads(_library(path).to_str())
    plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made["added_tokens"])
    return plain and made["normalizer"] is None and made["pre_tokenizer"] == BYTE_LEVEL and made["post_processor"] is None and made["model"]["type"] == "BPE" and not made["model"]["dropout"]


def _special(path: str) -> list[str]:
    """Special strings, the longest first: of two that begin alike the library takes the longer."""
    return sorted((t["content"] for t in json.loads(_library(path).to_str())["added_tokens"]), key=lambda s: (-len(s), s))


def _prove(path: str, first: int, last: int) -> list[tuple[int, str]]:
    tokenizer = _library(path)
    special, model = set(_special(path)), tokenizer.model
    strings = [(k, tokenizer.id_to_token(k)) for k in range(first, last)]
    return [(k, s) for k, s in strings if s is not None and s not in special and [t.value for t in model.tokenize(s)] == [s]]


def whole_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, token): the vocabulary strings, in the model's own signs for bytes, that are one token when merged alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                proven = _prove(path, first, min(first + SLICE, size))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in proven], pa.int64()), pa.array([s for _, s in proven], pa.string())], ["id", "token"])

    size = _library(path).get_vocab_size(with_added_tokens=True)
    slices = -(-size // SLICE)
    return spark.range(0, slices * SLICE, SLICE, slices).mapInArrow(scan, "id long, token string")


class Remembered(dict):
    """What `find` says of a string, kept for at most REMEMBERED short ones."""

    def __init__(self, find: Callable[[str], int]):
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> int:
        found = self.find(key)
        if len(key) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found


class Counter:
    """Counts the tokens of texts for a byte-level tokenizer, of which `whole` are proven whole tokens in its own signs."""

    def __init__(self, path: str, whole: frozenset[str] = frozenset()):
        tokenizer = _library(path)
        self.whole, self.merge, self.parts = whole, tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        self.signs = _byte_signs()
        self.special = re.compile("|".join(map(re.escape, _special(path))) or "(?!)")
        self.merged = 0  # pre-tokens that the model had to merge
        self.word = Remembered(lambda word: self._signed("".join(map(self.signs.__getitem__, word.encode())))).__getitem__
        self.piece = Remembered(self._piece).__getitem__
        self.spaced = Remembered(lambda piece: self._piece(" " + piece)).__getitem__

    def _signed(self, part: str) -> int:
        if part in self.whole:
            return 1
        self.merged += 1
        return len(self.merge(part))

    def _piece(self, piece: str) -> int:
        if PLAIN.fullmatch(piece):
            return sum(map(self.word, WORDS.findall(piece)))
        return sum(self._signed(part) for part, _ in self.parts(piece))

    def __call__(self, text: str) -> int:
        parts = self.special.split(text)
        count = len(parts) - 1
        for part in parts:
            if UNCUT.search(part):
                count += sum(map(self.piece, CUT.split(part)))
            else:  # every space is a place to cut
                first, *rest = part.split(" ")
                count += self.piece(first) + sum(map(self.spaced, rest))
        return count


def counter(path: str, whole: frozenset[str] = frozenset()) -> Callable[[str], int]:
    """A function that counts a text's tokens as the library does."""
    if path.endswith(".model"):
        model = _pieces_model(path)
        return lambda text: len(model.encode(text))
    if in_pieces(path):
        return Counter(path, whole)
    tokenizer = _library(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


#: The counter of a Python worker for all its tasks, by tokenizer.
_counters: dict[str, Callable[[str], int]] = {}


def _counts(path: str, shared, limit: int, keep: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = counter(path, frozenset() if shared is None else shared.value)
        count = _counters[path]
        for batch in batches_of(batches, 4096, BATCH_BYTES, "text"):
            text = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            n = np.fromiter((count(t.as_py()) for t in text), np.int64, len(text))
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])

    return scan


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit[, kept]) of each row; `tokenizer` is a .json or .model file that all executors have.

    Columns that `keep` names come back in one struct `kept`, so that their names can't clash.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *kept, F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = None
    if in_pieces(path):
        shared = spark.sparkContext.broadcast(frozenset(r["token"] for r in whole_tokens(spark, path).toLocalIterator()))  # a vocabulary at most
    names = [c for c in rows.columns if c != "text"]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(trimmed(_counts(path, shared, limit, names)), schema)


def op11_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
