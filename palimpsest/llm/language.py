"""Language identification with rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of a language, by rank. A document's own list is
compared to each profile by the out-of-place distance: for each of its n-grams the difference of the two
ranks, or the profile's length where the profile lacks it. The nearest profile names the language.

N-grams are runs of 1 to 3 letters of the lower-cased text, where each run of other characters is one
boundary mark, so that n-grams see the start and the end of words. All n-grams of whole texts count, in the
profiles as in the documents. Profiles are learned from the counts of all training documents: each task
sums them by language and n-gram, and one shuffle adds up the sums.

Defined results
    null text or no letter   lang_pred is `und`, score 0
    null lang, null doc_id   a document without lang teaches nothing; one without id counts as id ""
    ties                     equal counts rank by code points; equal distances go to the first lang by code points
    nothing to learn from    every lang_pred is `und`
    long texts               are counted in batches of bounded size; a longer text is counted in pieces and added up
    repeated rows            each row is a document
    extra columns            are kept by `identify`, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, bounded_batches, table, trimmed

LENGTH = 400
UNKNOWN = "und"
#: A score below this is no language. Texts of a learned language reach 0.4 and more, those that share few n-grams stay below 0.1.
MIN_SCORE = 0.2
#: Characters of a batch that are counted together.
BATCH_CHARS = 1 << 19
BATCH_ROWS = 4096
#: Bits of a letter's code within a batch. Letters past the last code, in the order of code points, share it.
BITS = 16


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    found = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalpha():
            found[c] = True
    return found


class Counted:
    """N-gram counts of some texts: rows (owner, gram, count), ordered by owner and gram.

    A gram is up to three letters; each is coded by its place in `alphabet` plus one, a boundary by zero, in
    the order of code points, so that the order of codes is that of the grams in any batch.
    """

    def __init__(self, texts: list[str], owner: np.ndarray):
        low = [t.lower() for t in texts]
        points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
        who = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)) + 1)[: len(points)]
        letter = _letters()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one boundary after each word
        points, who, letter = points[keep], who[keep], letter[keep]
        self.alphabet = np.unique(points[letter])
        self.alphabet = self.alphabet[: (1 << BITS) - 1]
        table_ = np.zeros(int(self.alphabet[-1]) + 1 if len(self.alphabet) else 1, np.int64)
        table_[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        code = np.where(letter, table_[np.minimum(points, len(table_) - 1)], 0)
        before = np.concatenate(([0], code[:-1]))  # each text ends in a boundary, or the text before it does
        if len(who):
            before[1:][who[1:] != who[:-1]] = 0
        after = np.concatenate((code[1:], [0]))
        if len(who):
            after[:-1][who[1:] != who[:-1]] = 0
        at = code > 0
        mine = owner[who].astype(np.int64) << (3 * BITS + 2)
        one = mine + (1 << 3 * BITS) + (code << 2 * BITS)
        two = mine + (2 << 3 * BITS) + (before << 2 * BITS) + (code << BITS)
        end = mine + (2 << 3 * BITS) + (code << 2 * BITS)
        three = mine + (3 << 3 * BITS) + (before << 2 * BITS) + (code << BITS) + after
        keys = np.concatenate((one[at], two[at], end[at & (after == 0)], three[at]))
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(first, len(keys)))
        self.owner = (keys[first] >> (3 * BITS + 2)).astype(np.int64)
        self.gram = keys[first] & ((1 << (3 * BITS + 2)) - 1)

    def names(self, grams: np.ndarray) -> list[str]:
        """The grams as strings; a boundary is a space."""
        signs = [" ", *map(chr, self.alphabet.tolist())]
        out = []
        for g in grams.tolist():
            n = g >> 3 * BITS
            out.append("".join(signs[g >> (2 - k) * BITS & ((1 << BITS) - 1)] for k in range(n)))
        return out

    def codes(self, names: list[str]) -> np.ndarray:
        """The codes of grams, or -1 for those with a letter that is not in the alphabet."""
        place = {" ": 0} | {chr(c): k + 1 for k, c in enumerate(self.alphabet.tolist())}
        out = []
        for name in names:
            got = [place.get(c, -1) for c in name]
            out.append(-1 if -1 in got else (len(name) << 3 * BITS) + sum(c << (2 - k) * BITS for k, c in enumerate(got)))
        return np.array(out, np.int64)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and their numbers in portions of about BATCH_CHARS; a longer text comes in pieces that end where a word does."""
    held, who, size = [], [], 0
    for n, text in enumerate(texts):
        at, text = 0, text or ""
        while True:
            to = at + BATCH_CHARS
            while to < len(text) and text[to - 1].isalpha() and text[to].isalpha() and to - at < 2 * BATCH_CHARS:
                to += 1
            part = text[at:to]
            held.append(part)
            who.append(n)
            size += len(part)
            at = to
            if size >= BATCH_CHARS:
                yield held, np.array(who)
                held, who, size = [], [], 0
            if at >= len(text):
                break
    if held:
        yield held, np.array(who)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): the sums of a task, in portions."""
    total: dict[tuple[str, str], int] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])
        total.clear()
        return out

    for batch in batches_of(batches, BATCH_ROWS, 4 * BATCH_CHARS, "text"):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        known = sorted(set(langs))
        number = np.array([known.index(x) for x in langs])
        for texts, who in _pieces(batch.column(batch.schema.get_field_index("text")).to_pylist()):
            got = Counted(texts, number[who])
            for o, g, c in zip(got.owner.tolist(), got.names(got.gram), got.count.tolist(), strict=True):
                key = (known[o], g)
                total[key] = total.get(key, 0) + c
        if len(total) > 200_000:
            yield flush()
    if total:
        yield flush()


def learn_profiles(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(lang, rank, gram) from (text, lang): the `length` most frequent n-grams of each language."""
    bounded_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = rows.mapInArrow(trimmed(_counts), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram"))
    return sums.withColumn("rank", order - 1).where(F.col("rank") < length).select("lang", "rank", "gram")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, str]], length: int):
        self.length = length
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = sorted({gram for _, _, gram in rows})
        row, column = {g: k for k, g in enumerate(self.grams)}, {x: k for k, x in enumerate(self.langs)}
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: a gram of no profile
        for lang, rank, gram in rows:
            self.ranks[row[gram], column[lang]] = rank

    def nearest(self, got: Counted, n: int) -> tuple[list[str], list[float]]:
        """The language and score of each of n owners."""
        none = [UNKNOWN] * n, [0.0] * n
        if not len(got.owner) or not self.langs:
            return none
        order = np.lexsort((-got.count, got.owner))  # stable: ties stay in the order of grams
        owner, gram = got.owner[order], got.gram[order]
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
        top = rank < self.length
        owner, gram, rank = owner[top], gram[top], rank[top]
        codes = got.codes(self.grams)
        by_code = np.argsort(codes, kind="stable")
        place = np.minimum(np.searchsorted(codes[by_code], gram), len(codes) - 1)
        found = by_code[place]
        found = np.where(codes[found] == gram, found, len(self.grams))
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.append(start, len(owner)))
        away = np.empty((len(start), len(self.langs)))
        for k in range(len(self.langs)):
            there = self.ranks[found, k]
            away[:, k] = np.add.reduceat(np.where(there < 0, self.length, np.abs(there - rank)), start)
        best = away.argmin(axis=1)
        score = 1 - away[np.arange(len(start)), best] / (size * self.length)
        langs, scores = none
        for o, b, s in zip(owner[start].tolist(), best.tolist(), score.tolist(), strict=True):
            langs[o], scores[o] = self.langs[b], min(1.0, max(0.0, s))
        return langs, scores


def _added(parts: list[Counted], n: int) -> Counted:
    """The counts of pieces of one text, with one alphabet."""
    out = object.__new__(Counted)
    out.alphabet = np.unique(np.concatenate([p.alphabet for p in parts]))[: (1 << BITS) - 1]
    total: dict[int, int] = {}
    for p in parts:
        for g, c in zip(out.codes(p.names(p.gram)).tolist(), p.count.tolist(), strict=True):
            total[g] = total.get(g, 0) + c
    out.gram = np.array(sorted(total), np.int64)
    out.count = np.array([total[g] for g in out.gram.tolist()], np.int64)
    out.owner = np.full(len(out.gram), n)
    return out


def _portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch, whose first column is a struct with the text, in portions of bounded size."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(pc.struct_field(batch.column(0), column)), 0), np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + BATCH_ROWS, int(np.searchsorted(ends, ends[at] + 4 * BATCH_CHARS, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def _predict(shared, length: int, column: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value, length)
        for batch in (part for whole in batches for part in _portions(whole, column)):
            texts = pc.struct_field(batch.column(0), column).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            split: dict[int, list[Counted]] = {}
            for part, who in _pieces(texts):
                if len(part) == 1 and len(texts[who[0]]) > BATCH_CHARS:
                    split.setdefault(int(who[0]), []).append(Counted(part, np.zeros(1, np.int64)))
                    continue
                alone = [k for k, n in enumerate(who.tolist()) if len(texts[n] or "") > BATCH_CHARS]
                for k in alone:
                    split.setdefault(int(who[k]), []).append(Counted([part[k]], np.zeros(1, np.int64)))
                rest = [k for k in range(len(part)) if k not in alone]
                got = profiles.nearest(Counted([part[k] for k in rest], np.arange(len(rest))), len(rest))
                for k, lang, score in zip(rest, *got, strict=True):
                    langs[who[k]], scores[who[k]] = lang, score
            for n, parts in split.items():
                (langs[n],), (scores[n],) = profiles.nearest(_added(parts, 0), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return scan


def identify(docs: DataFrame, profiles: DataFrame, *, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(row, lang_pred, score): each row of `docs` as a struct, with its language.

    The profiles are broadcast: `length` n-grams for each language that the training rows name.
    """
    rows = [(r["lang"], r["rank"], r["gram"]) for r in profiles.select("lang", "rank", "gram").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(trimmed(_predict(shared, length, text_col)), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def keep_identified(docs: DataFrame, profiles: DataFrame, *, text_col: str = "text", min_score: float = MIN_SCORE, length: int = LENGTH) -> DataFrame:
    """The rows of `docs` with a language, at `min_score` or more: a text far from every profile goes."""
    found = identify(docs, profiles, text_col=text_col, length=length)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~held_out()).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def brute_force_profile(texts: list[str], length: int = LENGTH) -> list[str]:
    """For tests: the n-grams of some texts by rank, counted one by one."""
    from collections import Counter

    total: Counter = Counter()
    for text in texts:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for w in words:
            padded = f" {w} "
            total.update(w)
            total.update(padded[k : k + 2] for k in range(len(padded) - 1))
            total.update(padded[k : k + 3] for k in range(len(padded) - 2))
    return [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:length]]
