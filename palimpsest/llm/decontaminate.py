"""Benchmark decontamination with training suffix arrays.

Each task turns its share of the training documents into shards of word codes and sorts the suffixes of every
shard (a suffix array), ranked together with the suffixes of the benchmark. Every benchmark suffix is then
binary-searched in it: where it would stand, how far it agrees with its neighbours there (its longest verbatim
match), and the range of training suffixes that begin with its window. Ranks come from doubling the number of
words that they tell apart, so equal words in long rows cost no more than others, and any two suffixes are
compared in a logarithmic number of steps.

Defined results
    words       maximal runs of [0-9a-z] or of characters from U+0080 on, after lower-casing A-Z
    window      `width` consecutive words of an item; an item of fewer, but not none, is one window
    longest     the longest run of words that the document and an item share, from one word on; of equally long
                ones that with the smallest place in the document, and there the last benchmark suffix before
                it in the order of suffixes, else the first after it
    null text   no words; such a document is kept, such an item has no window
    repeats     repeated document rows are judged one by one; repeated item ids count once for a document
    null item   an item without id takes part under the id ""
    empty       no benchmark or no documents: nothing is contaminated, or no rows
    long texts  are read in pieces of at most `shard_words` words that overlap by the longest item
    benchmark   is sent to the tasks in blocks of about `block_bytes` of text, whose suffixes a task has in memory
                one block at a time, and at most `pass_blocks` of them; what is left takes further passes over the
                documents, which are then written once, with a key
    columns     all others are kept, whatever their names
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, batches_of, bounded_batches, fresh, table, trimmed

WIDTH = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 4 << 20
PASS_BLOCKS = 16
#: Bytes of documents that wait for their shards together.
HELD_BYTES = 8 << 20
PIECE = 1 << 20

#: Bytes of words stand for themselves, upper-case letters for lower-case ones; all else is a space.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def word_pieces(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text, in lists from about `piece` bytes each."""
    if len(data) <= piece:
        yield data.translate(_WORD_BYTES).split()
        return
    at = 0
    rest = b""
    while at < len(data):
        part = rest + data[at : at + piece].translate(_WORD_BYTES)
        at += piece
        cut = part.rfind(b" ") + 1 if at < len(data) else len(part)
        rest = part[cut:]
        yield part[:cut].split()


class Suffixes:
    """The suffixes of a block of benchmark items, as word codes from 1; code 0 is any other word and ends an item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        items = [(i, words) for i, words in items if words]
        self.code = {w: k + 1 for k, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.items = sorted({i for i, _ in items})
        order = {i: k for k, i in enumerate(self.items)}
        codes, item, pos, left = [], [], [], []
        for i, words in items:
            codes += [self.code[w] for w in words] + [0]
            item += [order[i]] * (len(words) + 1)
            pos += range(len(words) + 1)
            left += range(len(words), -1, -1)
        self.codes = np.array(codes, np.int32)
        self.item = np.array(item, np.int32)
        self.pos = np.array(pos, np.int32)
        left = np.array(left, np.int32)
        size = left + self.pos
        #: Length of the window that starts at each suffix; 0 where none does.
        self.window = np.where(size >= width, np.where(left >= width, width, 0), np.where(self.pos == 0, size, 0)).astype(np.int32)
        self.longest = int(left.max()) if len(left) else 0
        self.bits = max(1, int(len(self.code)).bit_length())


class Ranked:
    """Suffixes of `codes` (which ends in a 0) in order, as far as `depth` words; a code of 0 ends a suffix.

    Level j has, for each place, the rank of its next lengths[j] codes. Places that no other ties with keep their rank.
    """

    def __init__(self, codes: np.ndarray, depth: int, bits: int):
        n = len(codes)
        step = min(8, 63 // bits, n)
        self.codes = codes
        zeros = np.flatnonzero(codes == 0)
        self.left = np.repeat(zeros, np.diff(np.concatenate(([-1], zeros)))) - np.arange(n)  # words to the end
        key = codes.astype(np.int64)
        for j in range(1, step):
            key <<= bits
            key[: n - j] |= codes[j:]
        if step > 1:  # codes after an end do not count
            short = np.minimum(self.left, step)
            key = (key >> ((step - short) * bits)) << ((step - short) * bits)
        order = np.flatnonzero(codes)
        order = order[np.argsort(key[order], kind="stable")]
        key = key[order]
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(order) else np.zeros(0, bool)
        rank = np.full(n, -1, np.int32)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        self.lengths, self.levels = [step], [rank]
        alone = first & np.concatenate((first[1:], [True])) if len(order) else first
        at = np.flatnonzero(~alone & (self.left[order] >= step))  # places in the order that are tied and go on; ties end together
        while len(at) and self.lengths[-1] < depth:
            long, rank = self.lengths[-1], self.levels[-1]
            where = order[at]
            group, then = rank[where], rank[where + long]
            by = np.lexsort((then, group))
            where, group, then = where[by], group[by], then[by]
            new = np.concatenate(([True], group[1:] != group[:-1]))
            cut = new | np.concatenate(([True], then[1:] != then[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            inner = np.maximum.accumulate(np.where(cut, np.arange(len(at)), 0))
            place = group + (np.arange(len(at)) - start)
            order[place] = where
            rank = rank.copy()
            rank[where] = group + (inner - start)
            self.lengths.append(2 * long)
            self.levels.append(rank)
            alone = cut & np.concatenate((cut[1:], [True]))
            at = np.sort(place[~alone & (self.left[where] >= 2 * long)])
        self.order = order

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words the suffixes at p and q share, up to the depth at least."""
        size = np.zeros(len(p), np.int64)
        for length, rank in zip(reversed(self.lengths), reversed(self.levels), strict=True):
            a = p + size
            size += length * ((rank[a] == rank[q + size]) & (self.left[a] >= length))
        for _ in range(self.lengths[0] - 1):
            own = self.codes[p + size]
            size += (own == self.codes[q + size]) & (own != 0)
        return size


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [lo, hi), and the number of the range of each."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def _beside(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last marked one before it and the first after it, or -1."""
    n = len(marked)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(marked, at, -1))
    after = np.minimum.accumulate(np.where(marked, at, n)[::-1])[::-1]
    return before, np.where(after == n, -1, after)


class Shard:
    """Collects segments of documents up to a number of words, then searches them."""

    def __init__(self, tests: Suffixes, shard_words: int):
        self.tests, self.limit = tests, shard_words
        self.clear()

    def clear(self):
        self.parts, self.owner, self.offset, self.words = [], [], [], 0

    def add(self, doc, codes: np.ndarray, offset: int):
        self.parts += [codes, np.zeros(1, np.int32)]  # a zero parts the documents
        self.owner.append((doc, len(codes)))
        self.offset.append(offset)
        self.words += len(codes) + 1

    def flush(self) -> None:
        if self.parts and self.tests.longest:
            self._search()
        self.clear()

    def _search(self) -> None:
        tests, base = self.tests, self.words
        ranked = Ranked(np.concatenate([*self.parts, tests.codes]), tests.longest, tests.bits)
        sizes = np.array([n for _, n in self.owner]) + 1
        starts = np.cumsum(sizes) - sizes
        order = ranked.order
        is_test = order >= base
        train = order[~is_test]
        if not len(train):
            return
        self._longest(ranked, order, is_test, starts)
        live, least = self._found_windows(ranked, order, is_test)
        if not len(live):
            return
        # One suffix stands for all with the same window.
        by = np.lexsort((live, least))
        live, least = live[by], least[by]
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (ranked.common(order[live[1:]], order[live[:-1]]) < least[1:])))
        group = np.cumsum(new) - 1
        where, width = order[live[new]], least[new].astype(np.int64)
        middle = np.cumsum(~is_test)[live[new]]  # the training suffixes before it
        lo, hi = np.zeros_like(middle), middle.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            same = ranked.common(train[mid], where) >= width
            hi, lo = np.where(open_ & same, mid, hi), np.where(open_ & ~same, mid + 1, lo)
        first, lo, hi = lo, middle.copy(), np.full_like(middle, len(train))
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, len(train) - 1)
            same = ranked.common(train[mid], where) >= width
            lo, hi = np.where(open_ & same, mid + 1, lo), np.where(open_ & ~same, mid, hi)
        place, which = ranges(first, lo)
        at = train[place]
        sets: dict[tuple, int] = {}
        item = tests.item[order[live] - base]
        pairs = np.unique(np.stack([group, item]), axis=1)
        cuts = np.flatnonzero(np.diff(pairs[0])) + 1
        of_group = np.array([sets.setdefault(tuple(x.tolist()), len(sets)) for x in np.split(pairs[1], cuts)])
        names = [{tests.items[i] for i in x} for x in sets]
        seg = np.searchsorted(starts, at, "right") - 1
        for s, k in np.unique(np.stack([seg, of_group[which]]), axis=1).T.tolist():
            self.owner[s][0]["items"] |= names[k]
        edge = np.bincount(at, minlength=base + 1) - np.bincount(at + width[which], minlength=base + 1)
        hit = np.cumsum(edge) > 0
        turn = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        seg = np.searchsorted(starts, turn[::2], "right") - 1
        for s, a, b in zip(seg.tolist(), turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            move = self.offset[s] - int(starts[s])
            self.owner[s][0]["spans"].append((a + move, b + move))

    def _longest(self, ranked: Ranked, order: np.ndarray, is_test: np.ndarray, starts: np.ndarray) -> None:
        """The longest match of each document: that of a training suffix with a benchmark suffix beside it."""
        mine = np.flatnonzero(~is_test)
        size, test = np.zeros(self.words, np.int64), np.zeros(self.words, np.int64)
        for beside in _beside(is_test):
            near = beside[mine]
            p, q = order[mine[near >= 0]], order[near[near >= 0]]
            found = ranked.common(p, q)
            better = found > size[p]
            size[p[better]], test[p[better]] = found[better], q[better] - self.words
        for s, k in enumerate(np.maximum.reduceat(size, starts).tolist()):
            doc = self.owner[s][0]
            if k and k >= doc["longest"][0]:
                at = int(starts[s] + np.argmax(size[starts[s] : starts[s] + self.owner[s][1]]))
                place = at - int(starts[s]) + self.offset[s]
                if k > doc["longest"][0] or place < doc["longest"][3]:
                    item, pos = int(self.tests.item[test[at]]), int(self.tests.pos[test[at]])
                    doc["longest"] = (k, self.tests.items[item], pos, place)

    def _found_windows(self, ranked: Ranked, order: np.ndarray, is_test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the order of benchmark suffixes whose window occurs, and its length."""
        mine = np.flatnonzero(is_test)
        window = self.tests.window[order[mine] - self.words]
        mine, window = mine[window > 0], window[window > 0]
        found = np.zeros(len(mine), bool)
        for beside in _beside(~is_test):
            near = beside[mine]
            there = np.flatnonzero(near >= 0)
            found[there] |= ranked.common(order[mine[there]], order[near[there]]) >= window[there]
        return mine[found], window[found]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest_words", T.IntegerType()),
        T.StructField("longest_item", T.StringType()),
        T.StructField("longest_item_pos", T.LongType()),
        T.StructField("longest_doc_pos", T.LongType()),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
        ("longest_words", pa.int32()),
        ("longest_item", pa.string()),
        ("longest_item_pos", pa.int64()),
        ("longest_doc_pos", pa.int64()),
    ]
)


class _Row:
    """A batch whose documents wait for their shard, with what each has found so far."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.found = [{"words": 0, "spans": [], "items": set(), "longest": (0, None, None, None)} for _ in range(batch.num_rows)]


def _scan(blocks: list, width: int, shard_words: int, column: str, out: str, keep_text: bool):
    """The function of one pass: adds column `out` with what these blocks of items find to each row."""

    def segments(data: bytes, code: dict, overlap: int) -> Iterator[tuple[int, np.ndarray, int]]:
        """(offset, codes, words so far) of segments of at most shard_words codes, which overlap."""
        held, at, total = np.zeros(0, np.int32), 0, 0
        for words in word_pieces(data):
            got = np.fromiter(map(code.get, words, repeat(0)), np.int32, len(words))
            total += len(words)
            held = np.concatenate((held, got)) if len(held) else got
            while len(held) > shard_words + overlap:
                yield at, held[: shard_words + overlap], total
                held, at = held[shard_words:], at + shard_words
        yield at, held, total

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Suffixes([(i, words_of(t)) for i, t in blocks[0].value], width) if len(blocks) == 1 else None

        def searched(held: list[_Row]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                tests = own or Suffixes([(i, words_of(t)) for i, t in block.value], width)
                shard, overlap = Shard(tests, shard_words), max(0, tests.longest - 1)
                for row in held:
                    for doc, text in zip(row.found, row.batch.column(row.batch.schema.get_field_index(column)), strict=True):
                        data = text.as_buffer()
                        if data is None or not data.size:
                            continue
                        for offset, codes, total in segments(data.to_pybytes(), tests.code, overlap):
                            doc["words"] = total
                            if len(codes):
                                shard.add(doc, codes, offset)
                            if shard.words >= shard_words:
                                shard.flush()
                shard.flush()
            for row in held:
                rows = []
                for doc in row.found:
                    size, item, pos, place = doc["longest"]
                    rows.append(
                        {"n_words": doc["words"], "spans": [{"start": a, "end": b} for a, b in merged(doc["spans"])], "items": sorted(doc["items"]), "longest_words": size, "longest_item": item, "longest_item_pos": pos, "longest_doc_pos": place}
                    )
                columns = {n: c for n, c in zip(row.batch.schema.names, row.batch.columns, strict=True) if keep_text or n != column}
                columns[out] = pa.array(rows, _ARROW)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        held, size = [], 0
        for batch in batches_of(batches, 1 << 14, HELD_BYTES, column):
            held.append(_Row(batch))
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)

    return scan


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items, streamed to the driver, in lists of bounded size."""
    rows, size = [], 0
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    for row in items.where("t is not null").toLocalIterator():
        rows.append((row["i"], row["t"]))
        size += len(row["t"].encode())
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _added(found: list[Column]) -> Column:
    """What several passes found of a row, as one struct."""
    longest = F.sort_array(F.array(*[F.struct(-f["longest_words"], f["longest_doc_pos"], F.lit(k).alias("k"), f.alias("f")) for k, f in enumerate(found)]))[0]["f"]
    spans = F.sort_array(F.flatten(F.array(*[f["spans"] for f in found])))
    kind = "array<struct<start:bigint,end:bigint>>"

    def put(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.struct(
        found[0]["n_words"].alias("n_words"),
        F.aggregate(spans, F.array().cast(kind), put).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[f["items"] for f in found])))).alias("items"),
        *[longest[c].alias(c) for c in ("longest_words", "longest_item", "longest_item_pos", "longest_doc_pos")],
    )


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
    pass_blocks: int = PASS_BLOCKS,
    keep_text: bool = False,
    out: str = "found",
) -> DataFrame:
    """Adds to each row a struct `out`: n_words, the hit word spans, the items, and the longest match and its place.

    The text itself goes unless keep_text. See the module's docstring for the defined results.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    broadcast = spark.sparkContext.broadcast

    def scanned(rows: DataFrame, blocks: list, name: str, keep: bool) -> DataFrame:
        fields = [f for f in rows.schema.fields if keep or f.name != text_col]
        return rows.mapInArrow(trimmed(_scan(blocks, width, shard_words, text_col, name, keep)), T.StructType([*fields, T.StructField(name, _FOUND)]))

    parts = iter(_blocks(benchmark, item_col, item_text_col, block_bytes))
    now = list(islice(parts, pass_blocks)) or [[]]
    more = next(parts, None)
    if more is None:
        return scanned(docs, list(map(broadcast, now)), out, keep_text)
    scratch, key = Scratch(spark, "matches"), fresh(docs, "_key")
    rows = scratch.write(docs.withColumn(key, F.monotonically_increasing_id()), "documents")
    done = []
    while now:
        sent = list(map(broadcast, now))
        done.append(scratch.write(scanned(rows.select(key, text_col), sent, f"f{len(done)}", False), "pass"))
        for x in sent:
            x.destroy()
        now = [more, *islice(parts, pass_blocks - 1)] if more is not None else []
        more = next(parts, None) if more is not None else None
    found = done[0]
    for x in done[1:]:
        found = found.join(x, key)
    found = found.select(key, _added([F.col(f"f{k}") for k in range(len(done))]).alias(out))
    keep = [c for c in docs.columns if keep_text or c != text_col]
    return rows.join(found, key).select(*[F.col(f"`{c}`") for c in keep], out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs, with the columns of `docs`."""
    out = fresh(docs, "_found")
    found = find_matches(docs, benchmark, keep_text=True, out=out, **options)
    return found.where(F.size(f"{out}.items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.col("found.items"), ",")
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("found.longest_words").alias("longest_words"),
        F.col("found.longest_item").alias("longest_item"),
        F.col("found.longest_item_pos").alias("longest_item_pos"),
        F.col("found.longest_doc_pos").alias("longest_doc_pos"),
    )


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> dict:
    """For tests: {doc key: (n_words, n_hit, item ids, items_sha256)} by sliding windows over plain lists."""
    windows: dict[tuple, set[str]] = {}
    for i, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = {}
    for key, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out[key] = (len(w), len(hit), sorted(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
