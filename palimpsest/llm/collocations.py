"""Phrases whose words go together more often than by chance, mined for each language.

All 1- to max_n-grams of the pieces between punctuation become rows, those of a block of about a million words
with their number in the block, and are counted by a hash aggregation, which Spark does partially in each task
first. Grams of three words or more are left out only where that is sure to change nothing: if a gram of one word less
inside is too rare, as a filter of bounded size tells. Phrases of two or more words that come up at least `least` times are candidates. Each way to cut one in two
is a row; it is joined with the counts of its first and its last part and scored in Decimal, and the lowest score
counts. A candidate that a longer one explains is anti-joined away: it is enough to look one word further, since of
the candidates that hold it and are frequent enough each has one of the next length inside that holds it too and is
at least as frequent. Ranks are windows over each language, whose rows are first cut down to `top` in `SALTS`
parts, so that no task sorts a whole language.

A gram travels as one string, its words, a tab and its language: words hold no tabs. Only words and grams that come
up `least` times are written, for a part of a frequent gram is as frequent as it or more.

Defined results
    null text       counts as the empty text
    null language   counts as `und`, together with texts of that language
    empty pieces    have no words
    ties            of cuts go to the smallest first part; of ranks to the more frequent phrase, then in byte order
    repeated rows   each row's words count
    long texts      are split whole, and their words counted a block at a time
    empty table     no rows
    extra columns   are not read
    counts          of 10^16 or more don't fit the Decimal products and are an error, not a wrong score
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batches_of, table, trimmed

MAX_N = 3
LEAST = 10
#: Per cent of a phrase's occurrences that a longer candidate must have to stand for it.
INSIDE = 50
TOP = 2000
SALTS = 64
#: Bits of the filter of frequent grams at most (32 MB).
FILTER_BITS = 1 << 28
#: Bytes of text that are split at once, and words whose grams are counted at once.
BATCH_BYTES = 8 << 20
BLOCK = 1 << 20
#: What parts pieces, the name of no language, and the score of words that only come together.
BREAKS = r"[.,;:!?\n-\r]+"
UNKNOWN = "und"
SCALE = 1_000_000
#: The seed of Spark's XXH64.
HASH_SEED = 42


def _split(text: pa.Array) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
    """The words of all texts as codes, the words' names, where pieces end, and the text of each word.

    Signs that part pieces become words of their own: a dot, which no word holds. Only spaces and tabs are left to split at.
    """
    parted = pc.replace_substring_regex(pc.binary_join_element_wise(pc.ascii_lower(pc.fill_null(text, "")), ".", ""), BREAKS, " . ")
    lists = pc.ascii_split_whitespace(parted)
    words = lists.flatten().dictionary_encode()
    codes = np.asarray(words.indices, np.int64)
    ends = np.asarray(pc.is_in(words.dictionary, pa.array([".", ""])))[codes]
    return codes, words.dictionary, ends, np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    found = pa.array(keys).dictionary_encode()
    return np.asarray(found.indices, np.int64), len(found.dictionary)


def _gram_rows(first_n: int, last_n: int, shared=None):
    """Rows of the first_n- to last_n-grams. With `shared`, a filter of grams of one word less, only those between two of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1 << 16, BATCH_BYTES, "text"):
            codes, names, ends, owner = _split(batch.column(1))
            langs = batch.column(0).dictionary_encode()
            lang = np.asarray(langs.indices, np.int64)[owner]

            def strings(at: np.ndarray, n: int) -> pa.StringArray:
                words = [names.take(pa.array(codes[at + k])) for k in range(n)]
                return pc.binary_join_element_wise(pc.binary_join_element_wise(*words, " "), langs.dictionary.take(pa.array(lang[at])), "\t")

            for first in range(0, len(codes), BLOCK):
                at = first + np.flatnonzero(~ends[first : first + BLOCK + 1])
                key = lang[at]
                for n in range(1, last_n + 1):
                    if n > 1:  # every text ends with a dot, so a word's next one is of the same text
                        keep = ~ends[at + n - 1]
                        if n == first_n and shared is not None:
                            good = np.zeros(BLOCK + 2, bool)  # whether a gram of the filter begins here
                            good[at - first] = has(shared.value, strings(one, n - 1))[key]
                            keep &= good[at - first] & good[at - first + 1]
                        at, key = at[keep], key[keep]
                    if n == first_n:
                        key, at = key[at < first + BLOCK], at[at < first + BLOCK]
                    key, size = _numbered(key * len(names) + codes[at + n - 1])
                    one = np.empty(size, np.int64)  # where each distinct gram occurs
                    one[key] = at
                    if n >= first_n:
                        yield pa.RecordBatch.from_arrays([strings(one, n), pa.array(np.bincount(key, minlength=size))], ["gram", "f"])

    return scan


def gram_filter(known: DataFrame) -> np.ndarray:
    """A Bloom filter of (gram), of about 16 bits a gram and FILTER_BITS at most: as 64-bit words, which Spark aggregates."""
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * known.count()).bit_length()))
    hashed = known.select(F.xxhash64("gram").alias("h"))
    places = hashed.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("h")).select(F.col("h").bitwiseAND(bits - 1).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("mask")).view(np.uint64)
    return out


def has(words: np.ndarray, grams_: pa.StringArray) -> np.ndarray:
    """Whether the filter has each gram; now and then it has one that was not put in."""
    h = np.fromiter((xxhash.xxh64_intdigest(g, HASH_SEED) for g in grams_.to_pylist()), np.uint64, len(grams_))
    found = np.ones(len(h), bool)
    for at in (h, h >> np.uint64(32)):
        at = at & np.uint64(len(words) * 64 - 1)
        found &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def grams(docs: DataFrame, first_n: int = 1, last_n: int = MAX_N, *, within: np.ndarray | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(gram, f): the first_n- to last_n-grams of the texts, each with a tab and its language after it, once for each block that has it.

    `within` is a filter of grams of first_n - 1 words: only grams that begin and end with one of them are rows then.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN))
    rows = docs.select(lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = None if within is None else docs.sparkSession.sparkContext.broadcast(within)
    return rows.mapInArrow(trimmed(_gram_rows(first_n, last_n, shared)), "gram string, f long")


def _counted(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, length, f) of rows of `grams`: all words, and longer grams that occur at least `least` times."""
    counts = rows.groupBy("gram").agg(F.sum("f").alias("f"))
    at = F.position(F.lit("\t"), F.col("gram"))
    phrase = F.substring("gram", F.lit(1), at - 1)
    counts = counts.select(F.substring("gram", at + 1, F.length("gram")).alias("lang"), phrase.alias("phrase"), (F.regexp_count(phrase, F.lit(" ")) + 1).alias("length"), "f")
    return counts.where((F.col("length") == 1) | (F.col("f") >= least))


def phrase_counts(docs: DataFrame, scratch: Scratch, max_n: int = MAX_N, least: int = LEAST, **columns) -> DataFrame:
    """(lang, phrase, length, f): how often each word occurs, and each longer gram that occurs at least `least` times.

    Words and pairs are counted first. A longer gram can be frequent only if the grams of one word less at its begin and
    its end are, so a filter of these is sent to the tasks, and only grams between two that it has become rows. What it has
    by mistake is counted like the rest, so the filter's bounded size changes no result.
    """
    out = scratch.write(_counted(grams(docs, 1, min(2, max_n), **columns), least), "counts")
    for n in range(3, max_n + 1):
        known = out.where((F.col("length") == n - 1) & (F.col("f") >= least)).select(F.concat("phrase", F.lit("\t"), "lang").alias("gram"))
        out = out.unionByName(scratch.write(_counted(grams(docs, n, n, within=gram_filter(known), **columns), least), f"counts-{n}"))
    return out


def _first(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, length, a, score, l, r) of each candidate, by its lowest-scoring cut."""
    known = counts.where(F.col("f") >= least).select("lang", "phrase", "f")
    phrase, length = F.col("phrase"), F.col("length")
    cuts = counts.where((length > 1) & (F.col("f") >= least)).select("lang", "phrase", "length", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _first(phrase, F.col("k")), "rest": _first(phrase, F.col("k") - length)})
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    exact = lambda name: f"cast({name} as decimal(16, 0))"
    score = F.expr(f"({exact('a')} * {exact('a')} * {SCALE}bd) div ({exact('l')} * {exact('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "length", "a", "cut.score", "cut.l", "cut.r")


def unexplained(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """`found` without candidates that lie in a longer one which has `inside` per cent of their occurrences or more."""
    shorter = F.array(_first(F.col("phrase"), F.col("length") - 1), _first(F.col("phrase"), 1 - F.col("length")))
    longer = found.where("length > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return found.alias("c").join(longer.alias("e"), F.expr(f"c.lang = e.lang and c.phrase = e.phrase and 100 * e.most >= {inside} * c.a"), "left_anti")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """`found` with `rank`: the first `top` of each language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    few = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", some).where(F.col("rank") <= top).drop("rank", "salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, *, max_n: int = MAX_N, least: int = LEAST, inside: int = INSIDE, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language, its number of words in n."""
    scratch = Scratch(docs.sparkSession, "phrases")
    counts = phrase_counts(docs, scratch, max_n, least, text_col=text_col, lang_col=lang_col)
    words = counts.where("length = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    best = ranked(unexplained(scratch.write(scored(counts, least), "scored"), inside), top)
    long = ["rank", "a", "l", "r", "n", "score"]
    out = best.join(words, "lang")
    return out.select(*[F.col(c).cast("long").alias(c) if c in long else F.col(c) for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")])


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The definition at length: all grams, all cuts of candidates, all candidates of three words, in 128-bit integers.
OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
    SELECT lang, ws[i] AS phrase, 1 AS len FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)
    UNION ALL SELECT lang, ws[i] || ' ' || ws[i + 1], 2 FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM words)
    UNION ALL SELECT lang, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], 3 FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)
), f AS MATERIALIZED (
    SELECT lang, phrase, len, count(*) AS f FROM grams GROUP BY lang, phrase, len
), total AS (
    SELECT lang, sum(f) AS n FROM f WHERE len = 1 GROUP BY lang
), cand AS (
    SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE len > 1 AND f >= 10
), cuts AS (
    SELECT lang, phrase, len, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len)) AS k FROM cand)
), half AS MATERIALIZED (
    SELECT c.*, l.f AS l FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first
), scored AS (
    SELECT c.*, r.f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r.f) AS score FROM half c JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, len)) AS i FROM cand WHERE len = 3) GROUP BY ALL
), kept AS (
    SELECT b.* FROM best b LEFT JOIN inside e USING (lang, phrase) WHERE e.most IS NULL OR 100 * e.most < 50 * b.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
