"""Groups of texts whose word shingles are alike: every pair of texts at Jaccard `similarity` or more is linked.

A text's fingerprint is the set of its shingle hashes, that is a bit vector of 2^64 places; the Hamming distance
of two fingerprints is the size of their symmetric difference. Sets of n shingles that are so alike differ in so
few places that, by the pigeonhole principle, each has one of its first n - ceil(similarity n) + 1 shingles in
the other's first ones too, in any order that is the same for all sets. These are the blocks on which sets meet.
The order puts frequent shingles last, the most frequent after the rest, so that passages that many texts share
seldom make a block: shingles are counted over all texts in portions, and those that are frequent within a portion
are summed up. The order changes the cost, never the result.

Equal sets are one node from the start. Where links of 64-bit fingerprints are given, what they link is verified and
joined first; the blocks then find what fingerprints can't reach. The nodes of a block do not make pairs. First, in some rounds, every node
meets a few of the block, whose choice differs from round to round; what is verified joins components. Then the
nodes of a block that are in different components still meet each other, those of like sizes, which is exact.
Candidates are checked by size and by the places of the shingle that they share, as if it were their first common
one, which some block of theirs holds; then by the Hamming distance of parities, which that of the sets bounds: of
256 while nodes of a block are compared, so that few pairs leave it, and of two to a shingle; then by the whole
sets, which are made again from the texts that still need them.

Defined results
    words           as for fingerprints: A-Z lower-cased, split at ASCII white space
    null or blank   the empty set; all these are one group
    fewer words     a text of fewer words than a shingle is one shingle of all of them
    null id         is larger than all others when the row that stays is chosen
    repeated rows   of rows with equal id and text one stays
    empty table     no rows
    long texts      are cut at white space into pieces of bounded size; a node's set is the unit of verification
    extra columns   are kept, whatever their names
    hashes          64 bits stand for a shingle and for a set
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batches_of, connected_components, fresh, trimmed

WIDTH = 5
SIMILARITY = 0.8
#: Parities of a set at least, and to each of its shingles.
PARITIES = 512
TO_EACH = 2
#: Shingles that are counted together, and how often one must come up among them to be put forward as frequent.
PORTION = 1 << 21
OFTEN = 4
#: Frequent shingles that are sent to tasks at most: 12 bytes each.
HOT = 1 << 20
#: Rounds in which every node of a block meets the block's centres, at most: one in the first round, then as many as this. From the second on they end when so few pairs to a
#: node are left, or more than this share of those before.
STARS = 6
CENTRES = 8
FEW = 1.0
STUCK = 0.9
#: Texts whose hashes are sent to tasks at most, 8 bytes each; beyond that Spark shuffles them.
SENT = 1 << 22
BATCH_BYTES = 4 << 20
#: Keeps quotients such as 0.8 * 5 from missing a whole number.
EPS = 1e-9
#: Odd constants that mix hashes.
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in turn, and where each text's words end."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = cut.flatten().dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    hashes, ends = own[np.asarray(words.indices)], np.asarray(cut.offsets, np.int64)
    ends = ends - ends[0]
    empty = np.asarray(words.indices) == _index(words.dictionary, "")  # of texts that start or end in white space
    if empty.any():
        ends = ends - np.concatenate(([0], np.cumsum(empty)))[ends]
        hashes = hashes[~empty]
    return hashes, ends


def _index(values: pa.Array, value: str) -> int:
    return pc.index(values, value).as_py()


def _strung(words: np.ndarray) -> np.ndarray:
    """The hash of each run of as many words as there are rows of `words`."""
    with np.errstate(over="ignore"):
        total = words[0].copy()
        for row in words[1:]:
            total = total * _MIX[0] + row
    return _mixed(total + np.uint64(len(words)))


def _parts(text: str, size: int) -> Iterator[str]:
    """A text cut at ASCII white space into parts of about `size` characters."""
    at = 0
    while at < len(text):
        to = at + size
        while to < len(text) and text[to] not in " \t\n\v\f\r":
            to += 1
        yield text[at:to]
        at = to


def _long_set(text: str, width: int, size: int) -> np.ndarray:
    found, held = [], np.zeros(0, np.uint64)
    for part in _parts(text, size):
        held = np.concatenate((held, _word_hashes(pa.array([part]))[0]))
        if len(held) >= width:
            found.append(np.unique(_strung(np.stack([held[k : len(held) - width + 1 + k] for k in range(width)]))))
            held = held[len(held) - width + 1 :]
    if not found and len(held):
        return _strung(held[:, None])
    return np.unique(np.concatenate(found)) if found else held


def shingle_sets(texts: pa.Array, width: int = WIDTH, long: int = BATCH_BYTES) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    texts = pc.fill_null(texts, "")
    size = np.asarray(pc.binary_length(texts), np.int64)
    if len(size) and size.max() > long:
        return [s for k in range(len(texts)) for s in ([_long_set(texts[k].as_py(), width, long)] if size[k] > long else shingle_sets(texts.slice(k, 1), width, long))]
    hashes, ends = _word_hashes(texts)
    n = len(hashes) - width + 1
    runs = _strung(np.stack([hashes[k : n + k] for k in range(width)])) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out.append(np.unique(runs[a : b - width + 1]) if b - a >= width else _strung(hashes[a:b, None]) if b > a else hashes[:0])
    return out


def _frequent(width: int):
    """(token, n): shingles that at least OFTEN texts of a portion have, and how many."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = n >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

        for batch in batches_of(batches, 4096, BATCH_BYTES, "text"):
            held += shingle_sets(batch.column(0), width)
            size += sum(map(len, held[-batch.num_rows :]))
            if size >= PORTION:
                yield flush()
                size = 0
        if held:
            yield flush()

    return scan


def _first(own: np.ndarray, hot: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set on which it meets others: in the order of their hashes, those of `hot` after the rest, by their rank."""
    if len(hot) and len(own):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        late = hot[at] == own
        own = np.concatenate((own[~late], own[late][np.argsort(rank[at[late]])]))
    return own[: len(own) - math.ceil(similarity * len(own) - EPS) + 1]


def _parities(own: np.ndarray) -> bytes:
    """Whether the shingles with each value of the lowest bits of their hash are odd in number."""
    n = max(PARITIES, 1 << (TO_EACH * len(own) - 1).bit_length()) if len(own) else PARITIES
    odd = np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _folded(parities: bytes) -> list[int]:
    """The parities by the 8 lowest bits of the hash, in four integers."""
    return np.bitwise_xor.reduce(np.frombuffer(parities, "<i8").reshape(-1, 4)).tolist()


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many parities two sets differ; the longer ones are those of more bits of the hash, and fold."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sets(width: int, similarity: float, shared):
    """(id, text_hash, node, n, parities, folded, first): the last three are null for a set that the task has seen before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, rank), seen = shared.value, set()
        for batch in batches_of(batches, 4096, BATCH_BYTES, "text"):
            node, size, parities, folded, first = [], [], [], [], []
            for own in shingle_sets(batch.column(2), width):
                node.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                size.append(len(own))
                known = node[-1] in seen
                parities.append(None if known else _parities(own))
                folded.append(None if known else _folded(parities[-1]))
                first.append(None if known else _first(own, hot, rank, similarity).view(np.int64))
                seen.add(node[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(parities, pa.binary()), pa.array(folded, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))],
                ["id", "text_hash", "node", "n", "parities", "folded", "first"],
            )

    return scan


def _alike(similarity: float):
    """The (u, v) of (u, v, nu, nv, a, b) whose parities a and b allow the similarity."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (1 - similarity) / (1 + similarity) * (np.asarray(batch.column(2)) + np.asarray(batch.column(3))) + EPS
            keep = [_apart(np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)) <= m for a, b, m in zip(batch.column(4), batch.column(5), most, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return scan


def _whole(width: int):
    """(node, data): the whole set of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 4096, BATCH_BYTES, "text"):
            raw = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(0), width)]
            node = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(raw, pa.binary())], ["node", "data"])

    return scan


def _verified(similarity: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - EPS)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return scan


class Nodes:
    """The sets of some texts: rows, one node for each distinct set, and the blocks on which nodes meet."""

    def __init__(self, rows: DataFrame, scratch: Scratch, width: int, similarity: float):
        self.scratch, self.width, self.similarity, self.docs = scratch, width, similarity, rows
        spark = scratch.spark
        often = rows.select("text").mapInArrow(trimmed(_frequent(width)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        hot = often.orderBy(F.desc("n"), "token").limit(HOT).select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)
        by_hash = np.argsort(hot)
        shared = spark.sparkContext.broadcast((hot[by_hash], (len(hot) - by_hash).astype(np.int32)))  # the most frequent ranks last
        id_type = rows.schema["id"].dataType.simpleString()
        sets = rows.mapInArrow(trimmed(_sets(width, similarity, shared)), f"id {id_type}, text_hash long, node long, n long, parities binary, folded array<long>, first array<long>")
        self.rows = scratch.write(sets, "sets")
        self.parities = scratch.write(self.rows.where("first is not null").select("node", "n", "parities", "folded").dropDuplicates(["node"]), "parities")
        self.data = None
        keys = self.rows.where("first is not null").select(F.posexplode("first").alias("at", "token"), "node", "n")
        many = F.count("*").over(Window.partitionBy("token"))
        met = scratch.write(keys.withColumn("c", many).where("c > 1").select("token", "node", "n", "at"), "met").distinct()
        self.blocks = scratch.write(met.withColumn("c", many).where("c > 1"), "blocks")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the (u, v) whose sets are so alike."""
        scratch, s = self.scratch, self.similarity
        of = lambda table, end, names: table.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in names])
        both = pairs.distinct().join(of(self.parities, "u", ["n", "parities"]), "u").join(of(self.parities, "v", ["n", "parities"]), "v")
        both = both.where(F.least("n_u", "n_v") >= s * F.greatest("n_u", "n_v") - EPS).select("u", "v", "n_u", "n_v", "parities_u", "parities_v")
        near = scratch.write(both.mapInArrow(_alike(s), "u long, v long"), "candidates")
        data = self._data(near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct())
        both = near.join(of(data, "u", ["data"]), "u").join(of(data, "v", ["data"]), "v").select("u", "v", "data_u", "data_v")
        return scratch.write(both.mapInArrow(_verified(s), "u long, v long"), "near")

    def _data(self, nodes: DataFrame) -> DataFrame:
        """(node, data): the whole sets of these nodes and some others; each is made from its text once."""
        if self.data is not None:
            nodes = nodes.join(self.data, "node", "left_anti")
        wanted = self.rows.select("node", "text_hash").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
        wanted = self.scratch.write(wanted.select("text_hash").distinct(), "wanted")
        if count := wanted.count():
            texts = self.docs.select("text_hash", "text").join(F.broadcast(wanted) if count <= SENT else wanted, "text_hash", "left_semi")
            new = self.scratch.write(texts.select("text").mapInArrow(trimmed(_whole(self.width)), "node long, data binary").dropDuplicates(["node"]), "data")
            self.data = new if self.data is None else self.data.unionByName(new)
        return self.data if self.data is not None else self.scratch.spark.createDataFrame([], "node long, data binary")


def fingerprint_pairs(nodes: Nodes, prints: DataFrame, links: DataFrame) -> DataFrame:
    """(u, v) of nodes that fingerprints link: each with the first of its own fingerprint, and the first ones of linked fingerprints.

    prints: (text_hash, fp); links: (u, v) between values of fp.
    """
    of = nodes.rows.select("text_hash", "node").distinct().join(prints.select("text_hash", "fp").distinct(), "text_hash").select("node", "fp").distinct()
    first = nodes.scratch.write(of.groupBy("fp").agg(F.min("node").alias("first")), "first")
    own = of.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    across = links.join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select("a", "b")
    return own.unionByName(across).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def similar_components(nodes: Nodes, met: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that have a link; those of the pairs `met` that are so alike are joined first."""
    scratch, s = nodes.scratch, nodes.similarity
    links, groups = None, scratch.spark.createDataFrame([], "node long, component long")

    def joined(pairs: DataFrame):
        nonlocal links, groups
        near = nodes.verified(pairs)
        links = near if links is None else links.unionByName(near)
        groups = scratch.write(connected_components(links, scratch), "components")

    def open_blocks() -> DataFrame:
        """The blocks that have nodes of more than one component."""
        of = groups.withColumnRenamed("component", "in")
        now = nodes.blocks.join(of, "node", "left").select("token", "node", "n", "at", "c", F.coalesce("in", "node").alias("component"))
        parted = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        return scratch.write(now.where("c > 2").join(parted, "token", "left_semi"), "open")  # the nodes of a block of two have met

    def pairs_left(now: DataFrame) -> float:
        """The pairs of different components that share a block, to a row of `now`."""
        parts = now.groupBy("token", "component").agg(F.count("*").cast("double").alias("m"))
        pairs = parts.groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"))
        found = pairs.agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m") - F.col("mm")).alias("pairs")).first()
        return (found["pairs"] or 0) / 2 / max(1, found["rows"] or 0)

    def may_be_alike(n: Column, at: Column, n2: Column, at2: Column) -> Column:
        """Whether two sets whose first common shingle has these places in their orders can share enough: the rest from there on bounds it."""
        return (F.least(n, n2) >= s * F.greatest(n, n2) - EPS) & (F.least(n - at, n2 - at2) >= s / (1 + s) * (n + n2) - EPS)

    now, before = nodes.blocks.withColumn("component", F.col("node")), math.inf
    if met is not None:
        joined(met)
        now = nodes.blocks.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    for turn in range(STARS):
        if now.isEmpty():
            return groups
        if turn > 1:
            left = pairs_left(now)
            if left <= FEW or left > STUCK * before:
                break
            before = left
        order = F.struct("n", "node") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "node"), "node")
        part = F.pmod(F.xxhash64(F.lit(-turn), "node"), F.lit(CENTRES if turn else 1))
        centre = now.groupBy("token", part.alias("part")).agg(F.min(F.struct(order.alias("o"), "node", "n", "at", "component")).alias("x"))
        centre = centre.select("token", F.col("x.node").alias("v"), F.col("x.n").alias("nv"), F.col("x.at").alias("atv"), F.col("x.component").alias("cv"))
        met = now.join(centre, "token").where((F.col("component") != F.col("cv")) & may_be_alike(F.col("n"), F.col("at"), F.col("nv"), F.col("atv")))
        joined(met.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")))
        now = open_blocks()
    # A set meets sets of its own class of sizes and of the next one, into which no set much larger falls.
    own = F.floor(F.log(F.greatest("n", F.lit(1))) / (-1.01 * math.log(s)) if s < 1 else F.col("n")).cast("int")
    now = now.join(nodes.parities.select("node", "folded"), "node")
    right = now.select("token", own.alias("class"), "component", "node", "n", "at", "folded")
    left = now.where(F.col("n") - F.col("at") >= 2 * s / (1 + s) * F.col("n") - EPS)  # the smaller set meets no other further on
    left = left.select("token", F.explode(F.array(own, own + 1)).alias("class"), F.col("component").alias("cu"), F.col("node").alias("u"), F.col("n").alias("nu"), F.col("at").alias("au"), F.col("folded").alias("fu"))
    smaller = (F.col("nu") < F.col("n")) | ((F.col("nu") == F.col("n")) & (F.col("u") < F.col("node")))
    apart = sum((F.bit_count(F.col("fu")[k].bitwiseXOR(F.col("folded")[k])) for k in range(1, 4)), F.bit_count(F.col("fu")[0].bitwiseXOR(F.col("folded")[0])))
    near = (F.col("cu") != F.col("component")) & smaller & (apart <= (1 - s) / (1 + s) * (F.col("nu") + F.col("n")) + EPS) & may_be_alike(F.col("nu"), F.col("au"), F.col("n"), F.col("at"))
    pairs = left.join(right, ["token", "class"]).where(near)
    joined(pairs.select(F.greatest("u", "node").alias("u"), F.least("u", "node").alias("v")))
    return groups


def deduplicate_similar(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, linked: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """One row of each group of similar texts stays: that with the smallest id, then the smallest text hash.

    linked: fingerprints (text_hash, fp) and their links (u, v). What they link is verified and joined first.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    nodes = Nodes(rows, scratch, width, similarity)
    groups = similar_components(nodes, fingerprint_pairs(nodes, *linked) if linked else None)
    grouped = nodes.rows.select("id", "text_hash", "node").join(groups, "node", "left").select("id", "text_hash", F.coalesce("component", "node").alias("component"))
    return one_of_each(docs, grouped, scratch, id_col=id_col, text_col=text_col)


def one_of_each(docs: DataFrame, grouped: DataFrame, scratch: Scratch, *, id_col: str, text_col: str) -> DataFrame:
    """One row of `docs` for each component of `grouped` (id, text_hash, component): the smallest id, then text hash."""
    first = F.struct(F.col("id").isNull(), "id", "text_hash")
    keep = grouped.groupBy("component").agg(F.min(first).alias("first")).select("first.id", "first.text_hash")
    id_, hash_ = fresh(docs, "_id"), fresh(docs, "_text_hash")
    keep = scratch.write(keep.select(F.xxhash64("id").alias(id_), F.col("text_hash").alias(hash_)).distinct(), "keep")
    rows = docs.withColumns({id_: F.xxhash64(f"`{id_col}`"), hash_: F.xxhash64(f"`{text_col}`")})
    return rows.join(keep, [id_, hash_]).dropDuplicates([id_, hash_]).select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_force(rows: list[tuple], width: int = WIDTH, similarity: float = SIMILARITY) -> dict:
    """For tests: {id: smallest id of its group} by comparing all pairs of plain rows."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} or ({b" ".join(words)} if words else set())
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= similarity * either - EPS:
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return {i: root(i) for i in ids}
