"""Retrieval queries: channels, fusion, reranking, recall."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions import vectors as vx
from ..functions.text import tokens
from ..operators import analytics, channels, evaluate, fusion
from ..retrieval.fused import fused_top
from . import base
from .base import DENSE_SQL, RANK, TOKENS, bm25_sql, query, values

TOP = 10


def _top(cte: str, name: str, k: int = TOP) -> str:
    return f"WITH {cte} SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM {name}) WHERE rank <= {k}"


OKAPI = {"idf": "(CASE WHEN r < 0 THEN 0.25e0 * mean_r ELSE r END)", "weight": "qtf"}


@query(_top(bm25_sql(), "bm"))
def bm25_topk(spark, sf_dir):
    return base.first_sparse(spark, sf_dir, TOP)


@query(_top(bm25_sql(**OKAPI), "bm"))
def bm25_okapi_topk(spark, sf_dir):
    return base.first_sparse(spark, sf_dir, TOP, "okapi")


@query(_top(bm25_sql("WHERE lang = 'en'"), "bm"))
def bm25_filtered_topk(spark, sf_dir):
    return channels.ranked(channels.bm25(base.items(spark, sf_dir).where("location = 'en'"), base.asked(spark, sf_dir)), k=TOP)


@query(_top(bm25_sql(), "bm"))
def bm25_indexed_topk(spark, sf_dir):
    """The same from the index, which a session builds once."""
    return base.lexical(spark, sf_dir).top(base.asked(spark, sf_dir), TOP)


@query(_top(bm25_sql(), "bm"))
def bm25_pruned_topk(spark, sf_dir):
    """The same with block-max pruning, whatever the number of postings."""
    return base.lexical(spark, sf_dir).top(base.asked(spark, sf_dir), TOP, prune=True)


@query(
    f"WITH {bm25_sql()} SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM bm) WHERE rank = 1 OR (score > 0 AND rank <= 5)"
)
def search_tool_hits(spark, sf_dir):
    return base.first_sparse(spark, sf_dir, 5).where("rank = 1 or score > 0")


@query(f"WITH {bm25_sql()} SELECT t AS term, df, round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM raw")
def term_statistics(spark, sf_dir):
    rows = base.items(spark, sf_dir)
    df = channels.postings(rows).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(channels.corpus_size(rows))).select("term", "df", F.round(idf, 6).alias("idf"))


SELF_SQL = """
p AS (
    SELECT a.vec_id AS q, b.vec_id AS item_id, a.label AS q_label, b.label, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 {}
)"""


@query(_top(SELF_SQL.format(""), "p"))
def dense_topk(spark, sf_dir):
    rows = base.vectors(spark, sf_dir)
    asked = rows.where("item_id % 20 = 0").select(F.col("item_id").alias("q"), "vector")
    return channels.ranked(channels.dense(rows, asked, TOP), k=TOP)


@query(_top(SELF_SQL.format("AND a.vec_id <> b.vec_id"), "p"))
def dense_topk_exclude_self(spark, sf_dir):
    rows = base.vectors(spark, sf_dir)
    asked = rows.where("item_id % 20 = 0").select(F.col("item_id").alias("q"), "vector")
    return channels.ranked(channels.dense(rows, asked, TOP, others=True), k=TOP)


@query(
    f"WITH {SELF_SQL.format('AND a.vec_id <> b.vec_id')}, r AS (SELECT *, {RANK} AS rank FROM p), "
    "n AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label) "
    "SELECT q, n AS n_gold, round(coalesce(count(*) FILTER (WHERE r.label = q_label AND rank <= 10) / n::DOUBLE, 0), 6) AS recall_10 "
    "FROM r JOIN n ON n.label = r.q_label GROUP BY q, n"
)
def dense_label_recall(spark, sf_dir):
    rows = base.vectors(spark, sf_dir)
    asked = rows.where("item_id % 20 = 0").select(F.col("item_id").alias("q"), "vector", F.col("label").alias("q_label"))
    top = channels.ranked(channels.dense(rows, asked, TOP + 1).where("q <> item_id"), k=TOP)
    size = rows.groupBy(F.col("label").alias("q_label")).agg((F.count("*") - 1).alias("n_gold"))
    good = top.join(rows.select("item_id", "label"), "item_id").join(asked.select("q", "q_label"), "q").groupBy("q").agg(F.count_if(F.col("label") == F.col("q_label")).alias("hits"))
    return asked.select("q", "q_label").join(size, "q_label").join(good, "q", "left").select("q", "n_gold", F.round(F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)).cast("double"), F.col("n_gold")), F.lit(0.0)), 6).alias("recall_10"))


@query(
    "WITH u AS (SELECT vec_id, label, list_concat(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: x * x)) AS v FROM embeddings), "
    "n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM u), "
    "p AS (SELECT a.vec_id AS q, b.vec_id AS item_id, round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) AS score FROM n a, n b WHERE a.vec_id % 20 = 0) "
    f"SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM p) WHERE rank <= {TOP}"
)
def dual_embedding_topk(spark, sf_dir):
    both = vx.dual(F.col("vector"), F.transform("vector", lambda x: x.cast("double") * x.cast("double")))
    rows = base.vectors(spark, sf_dir).select("item_id", both.alias("vector"))
    asked = rows.where("item_id % 20 = 0").select(F.col("item_id").alias("q"), "vector")
    return channels.ranked(channels.dense(rows, asked, TOP), k=TOP)


# -- metadata channel over events --------------------------------------------

CONSTRAINED = [(1, "2024-01-05", "2024-01-07", ["click"]), (2, "2024-01-10", "2024-01-10", []), (3, None, None, ["view", "purchase"]), (4, None, None, [])]
CONSTRAINT_TYPE = "q long, start string, end string, locations array<string>"


def _constraints(spark):
    rows = spark.createDataFrame(CONSTRAINED, CONSTRAINT_TYPE)
    return rows.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def _dated(spark, sf_dir):
    return base.table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("location"))


def _metadata_sql(hard: bool) -> str:
    cases = values(CONSTRAINED, "q, s, e, locs")
    return f"""
WITH c AS (SELECT q, s::DATE AS s, e::DATE AS e, locs::VARCHAR[] AS locs FROM {cases}),
x AS (
    SELECT q, event_id AS item_id,
        CASE WHEN s IS NULL THEN 0 WHEN ts::DATE BETWEEN s AND e THEN 1 ELSE 0 END + CASE WHEN len(locs) = 0 THEN 0 WHEN len(list_filter(locs, lambda l: contains(event_type, l))) > 0 THEN 1 ELSE 0 END AS hit,
        CASE WHEN s IS NULL THEN 0 ELSE 1 END + CASE WHEN len(locs) = 0 THEN 0 ELSE 1 END AS parts, s IS NULL OR ts::DATE BETWEEN s AND e AS pass
    FROM c, events
)
SELECT q, item_id, round(hit / parts::DOUBLE, 6) AS score, pass FROM x WHERE parts > 0 AND hit > 0 {"AND pass" if hard else ""}"""


@query(_metadata_sql(False))
def metadata_channel_soft(spark, sf_dir):
    return channels.metadata(_dated(spark, sf_dir), _constraints(spark))


@query(_metadata_sql(True))
def metadata_channel_hard(spark, sf_dir):
    return channels.metadata(_dated(spark, sf_dir), _constraints(spark), hard=True)


# -- fusion -------------------------------------------------------------------

#: A document's language stands in for its place; each question asks for the place of its own language, `en`.
PLACE = "en"
W = fusion.STANDARD_WEIGHTS
CHANNELS = f"""{bm25_sql()}, {DENSE_SQL},
s AS (SELECT q, item_id, rank FROM (SELECT *, {RANK} AS rank FROM bm) WHERE rank <= 100),
d AS (SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM dn WHERE score > 0) WHERE rank <= 50),
nn AS (SELECT count(*) AS n FROM documents)"""


#: Whole rankings: all hits of both channels.
WHOLE = f"""{bm25_sql()}, {DENSE_SQL},
s AS (SELECT q, item_id, score, {RANK} AS rank FROM bm),
d AS (SELECT q, item_id, score, {RANK} AS rank FROM dn WHERE score > 0),
nn AS (SELECT count(*) AS n FROM documents)"""


def _sparse(spark, sf_dir, k=100):
    return base.first_sparse(spark, sf_dir, k)


RRF_SQL = f"""
WITH {WHOLE},
f AS (
    SELECT coalesce(s.q, d.q) AS q, coalesce(s.item_id, d.item_id) AS item_id,
        round({W['s']}::DOUBLE / (60 + coalesce(s.rank, n + 1)) + {W['d']}::DOUBLE / (60 + coalesce(d.rank, n + 1)), 8) AS score
    FROM s FULL JOIN d ON s.q = d.q AND s.item_id = d.item_id CROSS JOIN nn
)
"""


def fused(spark, sf_dir, k=TOP, **options):
    """The first k by fusion of whole rankings."""
    n = base.items(spark, sf_dir).count()
    return fused_top(base.both_channels(spark, sf_dir), base.asked_both(spark, sf_dir), k, {"s": W["s"], "d": W["d"]}, n_items=n, **options)


@query(RRF_SQL + f"SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= {TOP}")
def hybrid_rrf(spark, sf_dir):
    return fused(spark, sf_dir)


@query(
    f"""
WITH {WHOLE}, pos AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents),
a AS (
    SELECT b.item_id AS q, p.item_id, p.pos, s.rank AS sr, d.rank AS dr FROM benchmark b CROSS JOIN pos p
    LEFT JOIN s ON s.q = b.item_id AND s.item_id = p.item_id LEFT JOIN d ON d.q = b.item_id AND d.item_id = p.item_id
), r AS (
    SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY sr NULLS LAST, pos) AS sr, row_number() OVER (PARTITION BY q ORDER BY dr NULLS LAST, pos) AS dr FROM a
), f AS (SELECT q, item_id, round({W['s']}::DOUBLE / (60 + sr) + {W['d']}::DOUBLE / (60 + dr), 8) AS score FROM r)
SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= {TOP}"""
)
def hybrid_rrf_positional(spark, sf_dir):
    rows = positioned(base.items(spark, sf_dir).select("item_id"), "item_id")
    whole = base.items(spark, sf_dir).count()
    found = fusion.rrf_positional({"s": channels.ranked(base.sparse(spark, sf_dir)), "d": base.nearest(spark, sf_dir, whole)}, rows, base.asked(spark, sf_dir), W, TOP)
    return channels.ranked(found, k=TOP)


@query(f"WITH {DENSE_SQL} SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM dn WHERE score > 0) WHERE rank <= {TOP}")
def dense_indexed_topk(spark, sf_dir):
    """Nearest items from the cells of the vector index that can hold them."""
    return base.vector_index(spark, sf_dir).top(base.question_vectors(spark, sf_dir), TOP)


@query(
    f"""
WITH {WHOLE.replace(bm25_sql(), bm25_sql(**OKAPI))},
f AS (
    SELECT coalesce(s.q, d.q) AS q, coalesce(s.item_id, d.item_id) AS item_id,
        round(0.4e0 / (60 + coalesce(s.rank, n + 1)) + 0.3e0 / (60 + coalesce(d.rank, n + 1)), 8) AS score
    FROM s FULL JOIN d ON s.q = d.q AND s.item_id = d.item_id CROSS JOIN nn
)
SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= {TOP}"""
)
def retriever_topk(spark, sf_dir):
    """One call of the retriever on its indexes, without a metadata channel."""
    found = base.retriever(spark, sf_dir).retrieve(base.asked_both(spark, sf_dir), TOP, weights={"s": 0.4, "d": 0.3})
    return found.select("q", "item_id", "score", "rank")


def positioned(rows, order: str):
    """Adds pos: each row's place from 1 in the order of a column, by written range partitions and one offset for each of them."""
    from pyspark.sql import Window

    from ..retrieval.held import fresh_folder

    path = fresh_folder(rows.sparkSession, "positions")
    rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()).write.parquet(path)  # once, so that both uses see the same ranges
    parts = rows.sparkSession.read.parquet(path)
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    base_ = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(F.broadcast(base_), "_p").withColumn("pos", F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


@query(
    f"""
WITH {WHOLE}, m AS (SELECT item_id, rank FROM (SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE lang = '{PLACE}')),
k AS (SELECT q, item_id FROM s UNION SELECT q, item_id FROM d UNION SELECT b.item_id, m.item_id FROM benchmark b, m),
f AS (
    SELECT k.q, k.item_id, round({W['m']}::DOUBLE / (60 + coalesce(m.rank, n + 1)) + {W['s']}::DOUBLE / (60 + coalesce(s.rank, n + 1)) + {W['d']}::DOUBLE / (60 + coalesce(d.rank, n + 1))
        + {W['v']}::DOUBLE / (60 + coalesce(d.rank, n + 1)), 8) AS score
    FROM k LEFT JOIN s ON s.q = k.q AND s.item_id = k.item_id LEFT JOIN d ON d.q = k.q AND d.item_id = k.item_id LEFT JOIN m ON m.item_id = k.item_id CROSS JOIN nn
)
SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= {TOP}"""
)
def hybrid_four_channel(spark, sf_dir):
    """Metadata, sparse, dense and vision over their whole rankings; all questions ask for one place."""
    from ..retrieval.fused import Fixed

    rows = base.items(spark, sf_dir).where(F.col("location") == PLACE).select("item_id")
    chan = base.both_channels(spark, sf_dir)
    n = base.items(spark, sf_dir).count()
    return fused_top({"m": Fixed(positioned(rows, "item_id")), **chan, "v": chan["d"]}, base.asked_both(spark, sf_dir), TOP, W, n_items=n)


@query(
    f"""
WITH {WHOLE}, ok AS (SELECT doc_id FROM documents WHERE lang = '{PLACE}'),
f AS (
    SELECT coalesce(s.q, d.q) AS q, coalesce(s.item_id, d.item_id) AS item_id,
        round({W['s']}::DOUBLE / (60 + coalesce(s.rank, n + 1)) + {W['d']}::DOUBLE / (60 + coalesce(d.rank, n + 1)), 8) AS score
    FROM s FULL JOIN d ON s.q = d.q AND s.item_id = d.item_id CROSS JOIN nn
)
SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f WHERE item_id IN (SELECT doc_id FROM ok)) WHERE rank <= {TOP}"""
)
def hybrid_rrf_hard(spark, sf_dir):
    """A hard filter drops rows after they are ranked and fused: ranks count all items."""
    keep = base.items(spark, sf_dir).where(F.col("location") == PLACE).select("item_id")
    return fused(spark, sf_dir, keep=keep)


@query(
    f"""
WITH {WHOLE}, sb AS (SELECT bm.q, bm.item_id, score, max(score) OVER (PARTITION BY q) AS h FROM bm), db AS (SELECT q, item_id, score, max(score) OVER (PARTITION BY q) AS h FROM d),
f AS (
    SELECT coalesce(s.q, d.q) AS q, coalesce(s.item_id, d.item_id) AS item_id, round({W['s']}::DOUBLE * coalesce(s.score / s.h, 0) + {W['d']}::DOUBLE * coalesce(d.score / d.h, 0), 6) AS score
    FROM sb s FULL JOIN db d ON s.q = d.q AND s.item_id = d.item_id
)
SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= {TOP}"""
)
def hybrid_weighted_sum(spark, sf_dir):
    return fused(spark, sf_dir, kind="sum")


LISTS = f"{CHANNELS}, a AS (SELECT q, item_id, rank FROM s WHERE rank <= 20), b AS (SELECT q, item_id, rank FROM d WHERE rank <= 20)"


def _two(spark, sf_dir, k=20):
    return _sparse(spark, sf_dir, k).select("q", "item_id", "rank"), base.nearest(spark, sf_dir, k).select("q", "item_id", "rank")


@query(
    f"WITH {LISTS}, l AS (SELECT q, item_id, rank, 2e0 AS w FROM a UNION ALL SELECT q, item_id, rank, 1e0 FROM b), f AS (SELECT q, item_id, round(sum(w / (60 + rank)), 8) AS score FROM l GROUP BY q, item_id) "
    f"SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= {TOP}"
)
def list_rrf_anchor(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    lists = a.withColumn("list_name", F.lit("anchor")).unionByName(b.withColumn("list_name", F.lit("sub")))
    weights = spark.createDataFrame([("anchor", 2.0), ("sub", 1.0)], "list_name string, weight double")
    return channels.ranked(fusion.list_rrf(lists, weights), k=TOP)


@query(
    f"WITH {LISTS}, f AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.item_id, b.item_id) AS item_id, round(0.4e0 / (60 + coalesce(a.rank, 21)) + 0.6e0 / (60 + coalesce(b.rank, 21)), 8) AS score "
    f"FROM a FULL JOIN b ON a.q = b.q AND a.item_id = b.item_id) SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= {TOP}"
)
def adaptive_list_rrf(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return channels.ranked(fusion.cached_list_rrf({"s": a, "d": b}, {"s": 0.4, "d": 0.6}, 20), k=TOP)


@query(
    f"WITH {LISTS}, o AS (SELECT q, item_id, min(o) AS o FROM (SELECT q, item_id, rank * 2 AS o FROM a UNION ALL SELECT q, item_id, rank * 2 + 1 FROM b) GROUP BY q, item_id) "
    f"SELECT q, item_id, rank FROM (SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY o) AS rank FROM o) WHERE rank <= {TOP}"
)
def interleave_dedupe(spark, sf_dir):
    return fusion.interleave(*_two(spark, sf_dir), TOP)


@query(
    f"WITH {LISTS}, o AS (SELECT q, item_id, min(o) AS o FROM (SELECT q, item_id, rank AS o FROM a UNION ALL SELECT q, item_id, rank + 1000000 FROM b) GROUP BY q, item_id) "
    "SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY o, item_id) AS rank FROM o"
)
def union_keep_first(spark, sf_dir):
    return fusion.keep_first(_two(spark, sf_dir))


@query(f"WITH {bm25_sql()}, w AS (SELECT *, min(score) OVER (PARTITION BY q) AS lo, max(score) OVER (PARTITION BY q) AS hi FROM bm) SELECT q, item_id, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE round((score - lo) / (hi - lo), 6) END AS norm FROM w")
def minmax_normalise(spark, sf_dir):
    return fusion.minmax(base.sparse(spark, sf_dir)).select("q", "item_id", F.round("norm", 6).alias("norm"))


@query(
    f"WITH {CHANNELS}, w AS (SELECT *, min(score) OVER (PARTITION BY q) AS lo, max(score) OVER (PARTITION BY q) AS hi FROM bm), "
    "f AS (SELECT coalesce(w.q, d.q) AS q, coalesce(w.item_id, d.item_id) AS item_id, round(0.5e0 * coalesce((w.score - lo) / (hi - lo + 1e-6), 0) + 0.5e0 * coalesce(d.score, 0), 6) AS score "
    f"FROM w FULL JOIN d ON w.q = d.q AND w.item_id = d.item_id) SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= {TOP}"
)
def alpha_hybrid(spark, sf_dir):
    return channels.ranked(fusion.alpha_hybrid(base.sparse(spark, sf_dir), base.nearest(spark, sf_dir), 0.5), k=TOP)


# -- reranking and expansion --------------------------------------------------

OVERLAP_SQL = f"""
qx AS (SELECT item_id AS q, list_distinct({TOKENS.format('text')}) AS qt FROM benchmark),
ov AS (
    SELECT s.q, s.item_id, s.rank, round(len(list_intersect(qt, list_distinct({TOKENS.format('text')}))) / len(qt)::DOUBLE, 6) AS new
    FROM s JOIN qx USING (q) JOIN documents ON doc_id = s.item_id WHERE s.rank <= 30
)"""


def _overlap(spark, sf_dir, head):
    asked = base.asked(spark, sf_dir).select("q", tokens("question").alias("q_tokens"))
    texts = base.items(spark, sf_dir).select("item_id", tokens("text").alias("item_tokens"))
    return fusion.overlap_scores(head.join(asked, "q").join(texts, "item_id"))


@query(
    f"WITH {CHANNELS}, {OVERLAP_SQL} SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY (rank <= 20) DESC, CASE WHEN rank <= 20 THEN new END DESC NULLS LAST, rank) AS rank FROM ov"
)
def rerank_tail(spark, sf_dir):
    first = _sparse(spark, sf_dir, 30).select("q", "item_id", "rank")
    return fusion.rerank(first, _overlap(spark, sf_dir, first.where("rank <= 20")), 20)


@query(
    f"WITH {CHANNELS}, c AS (SELECT s.q, s.item_id, coalesce(d.score, 0) AS score FROM s LEFT JOIN d ON d.q = s.q AND d.item_id = s.item_id WHERE s.rank <= 50) "
    f"SELECT q, item_id, score, rank FROM (SELECT *, {RANK} AS rank FROM c) WHERE rank <= {TOP}"
)
def cascade_coarse_dense(spark, sf_dir):
    return fusion.cascade(_sparse(spark, sf_dir, 50), base.nearest(spark, sf_dir), 50, TOP)


@query(
    f"WITH {CHANNELS}, g AS (SELECT b.item_id AS q, max(score) IS NULL OR max(score) < 20 OR count(*) FILTER (WHERE score > 1e-9) < 3 AS low FROM benchmark b LEFT JOIN bm ON bm.q = b.item_id GROUP BY b.item_id), "
    "a AS (SELECT q, item_id, rank AS o FROM s WHERE rank <= 10), b AS (SELECT q, item_id, rank + 1000000 AS o FROM d JOIN g USING (q) WHERE low AND rank <= 10), "
    "u AS (SELECT q, item_id, min(o) AS o FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY q, item_id) "
    "SELECT q, item_id, rank FROM (SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY o, item_id) AS rank FROM u) WHERE rank <= 15"
)
def confidence_expand(spark, sf_dir):
    first = base.sparse(spark, sf_dir)
    gate = fusion.low_confidence(first, base.asked(spark, sf_dir), least_top=20.0)
    return fusion.expand(channels.ranked(first, k=10), base.nearest(spark, sf_dir, 10), gate, 15)


@query(
    f"WITH {LISTS}, e AS (SELECT q FROM a LEFT JOIN documents ON doc_id = a.item_id WHERE rank <= 10 GROUP BY q HAVING avg((lang = 'en')::INT) >= 0.95) "
    "SELECT q, item_id, rank FROM a WHERE q NOT IN (SELECT q FROM e) UNION ALL SELECT q, item_id, rank FROM b WHERE q IN (SELECT q FROM e)"
)
def modality_fallback(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return fusion.modality_fallback(a, b, base.items(spark, sf_dir).select("item_id", F.col("location").alias("kind")), kind="en")


@query(
    f"WITH {CHANNELS}, h AS (SELECT q, item_id, rank FROM s WHERE rank <= 5), l AS (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM documents), "
    "u AS (SELECT q, item_id, rank::BIGINT AS o, false AS linked FROM h UNION ALL SELECT q, dst, rank + 4294967296, true FROM h JOIN l ON src = item_id WHERE dst IS NOT NULL), "
    "x AS (SELECT q, item_id, min(o) AS o, bool_and(linked) AS linked FROM u GROUP BY q, item_id) SELECT q, item_id, linked, row_number() OVER (PARTITION BY q ORDER BY o, item_id) AS rank FROM x"
)
def linked_expand(spark, sf_dir):
    from pyspark.sql import Window

    nxt = F.lead("item_id").over(Window.partitionBy("source").orderBy("item_id"))
    links = base.items(spark, sf_dir).select(F.col("item_id").alias("src"), nxt.alias("dst")).where("dst is not null")
    return fusion.linked(_sparse(spark, sf_dir, 5), links)


@query(
    f"WITH {CHANNELS} SELECT 'sparse' AS channel, q, item_id, rank FROM s WHERE rank <= 5 UNION ALL SELECT 'dense', q, item_id, rank FROM d WHERE rank <= 5"
)
def explain_channels(spark, sf_dir):
    a, b = _two(spark, sf_dir, 5)
    return a.select(F.lit("sparse").alias("channel"), "q", "item_id", "rank").unionByName(b.select(F.lit("dense").alias("channel"), "q", "item_id", "rank"))


# -- recall -------------------------------------------------------------------

GOLD_SQL = "gold AS (SELECT b.item_id AS q, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
KS = (1, 5, 10, 25, 50)


@query(f"WITH {GOLD_SQL} SELECT q, item_id FROM gold")
def gold_pairs(spark, sf_dir):
    return base.gold(spark, sf_dir)


def _recall_sql(kind: str) -> str:
    cols = ", ".join(f"round(coalesce(count(*) FILTER (WHERE s.rank <= {k}) / nullif(count(gold.q), 0)::DOUBLE, 0), 6) AS recall_{k}" for k in KS)
    hits = ", ".join(f"(count(*) FILTER (WHERE s.rank <= {k}) > 0)::INT AS hit_{k}" for k in KS)
    return f"WITH {CHANNELS}, {GOLD_SQL}, per AS (SELECT b.item_id AS q, count(gold.q) AS n_gold, {cols}, {hits} FROM benchmark b {kind} JOIN gold ON gold.q = b.item_id LEFT JOIN s ON s.q = gold.q AND s.item_id = gold.item_id GROUP BY b.item_id)"


def _recall(spark, sf_dir, empty_gold="zero"):
    per = evaluate.recall_at(_sparse(spark, sf_dir), base.gold(spark, sf_dir), base.asked(spark, sf_dir), KS, empty_gold=empty_gold)
    return per.withColumns({f"recall_{k}": F.round(f"recall_{k}", 6) for k in KS})


@query(_recall_sql("LEFT") + " SELECT * FROM per")
def recall_at_k(spark, sf_dir):
    return _recall(spark, sf_dir)


MEANS = ", ".join(f"round(coalesce(avg(recall_{k}), 0), 6) AS recall_{k}" for k in KS)


def _means(df):
    return df.select("n", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in KS])


@query(_recall_sql("LEFT") + f" SELECT count(*) AS n, {MEANS} FROM per")
def recall_summary_zero(spark, sf_dir):
    return _means(evaluate.recall_summary(_recall(spark, sf_dir), KS))


@query(_recall_sql("INNER") + f" SELECT count(*) AS n, {MEANS} FROM per")
def recall_summary_skip(spark, sf_dir):
    return _means(evaluate.recall_summary(_recall(spark, sf_dir, "skip"), KS))


@query(
    f"WITH {CHANNELS}, {GOLD_SQL}, n AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q) "
    "SELECT n.q, n_gold, round(count(*) FILTER (WHERE s.rank <= n_gold) / n_gold::DOUBLE, 6) AS recall_gt, coalesce(max((s.rank = 1)::INT), 0) AS hit_1 "
    "FROM n JOIN gold USING (q) LEFT JOIN s ON s.q = n.q AND s.item_id = gold.item_id GROUP BY n.q, n_gold"
)
def r_precision_hit1(spark, sf_dir):
    return evaluate.r_precision(_sparse(spark, sf_dir), base.gold(spark, sf_dir)).withColumn("recall_gt", F.round("recall_gt", 6))


@query(
    f"WITH {CHANNELS}, {GOLD_SQL}, sc AS (SELECT doc_id AS q, quality::DOUBLE AS score FROM labels), n AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q), ks AS (SELECT unnest([1, 5, 10]) AS k), "
    "per AS (SELECT n.q, k, sc.score, (SELECT count(*) FROM gold g JOIN s ON s.q = g.q AND s.item_id = g.item_id WHERE g.q = n.q AND s.rank <= k) / n_gold::DOUBLE AS r FROM n CROSS JOIN ks LEFT JOIN sc ON sc.q = n.q) "
    "SELECT k, count(score) AS n, count(*) - count(score) AS missing, round(coalesce(avg(CASE WHEN score IS NOT NULL THEN (score > 0 AND r = 1)::INT END), 0), 6) AS strict, "
    "round(coalesce(avg(CASE WHEN score IS NOT NULL THEN (score > 0)::INT * r END), 0), 6) AS partial FROM per GROUP BY k"
)
def joint_accuracy(spark, sf_dir):
    scores = base.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("q"), F.col("quality").cast("double").alias("score"))
    out = evaluate.joint_accuracy(_sparse(spark, sf_dir), base.gold(spark, sf_dir), scores, (1, 5, 10))
    return out.select("k", "n", "missing", F.round("strict", 6).alias("strict"), F.round("partial", 6).alias("partial"))


# -- needle pools -------------------------------------------------------------

NIAH = 8


@query(
    f"WITH {CHANNELS}, {GOLD_SQL}, n AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q), h AS (SELECT s.q, s.item_id, s.rank, gold.q IS NOT NULL AS g, n_gold FROM s JOIN n USING (q) LEFT JOIN gold ON gold.q = s.q AND gold.item_id = s.item_id WHERE s.rank <= {NIAH} AND n_gold <= {NIAH}), "
    "got AS (SELECT q, count(*) FILTER (WHERE g) AS got FROM h GROUP BY q), p AS (SELECT q, item_id, n_gold, row_number() OVER (PARTITION BY q ORDER BY rank DESC) AS l FROM h WHERE NOT g) "
    "SELECT q, item_id, true AS is_gold FROM gold UNION ALL SELECT p.q, item_id, false FROM p JOIN got USING (q) WHERE l > n_gold - got"
)
def niah_pools(spark, sf_dir):
    return fusion.needle_pool(base.gold(spark, sf_dir), _sparse(spark, sf_dir), NIAH).drop("place")


@query()
def niah_validate(spark, sf_dir):
    gold = base.gold(spark, sf_dir)
    return fusion.needle_valid(fusion.needle_pool(gold, _sparse(spark, sf_dir), NIAH), gold, NIAH)


@query()
def niah_order(spark, sf_dir):
    return fusion.needle_pool(base.gold(spark, sf_dir), _sparse(spark, sf_dir), NIAH)


# -- sweeps -------------------------------------------------------------------

CONFIGS = [("sparse", 1.0, 0.0), ("dense", 0.0, 1.0), ("even", 0.5, 0.5), ("standard", 0.39, 0.56), ("hard", 0.28, 0.72)]
SWEEP_SQL = f"""
WITH {CHANNELS}, {GOLD_SQL}, c AS (SELECT config, ws::DOUBLE AS ws, wd::DOUBLE AS wd FROM {values(CONFIGS, 'config, ws, wd')}),
w AS (SELECT coalesce(s.q, d.q) AS q, coalesce(s.item_id, d.item_id) AS item_id, s.rank AS sr, d.rank AS dr FROM s FULL JOIN d ON s.q = d.q AND s.item_id = d.item_id),
f AS (SELECT config, q, item_id, round(ws / (60 + coalesce(sr, n + 1)) + wd / (60 + coalesce(dr, n + 1)), 8) AS score FROM w, c, nn),
r AS (SELECT *, row_number() OVER (PARTITION BY config, q ORDER BY score DESC, item_id) AS rank FROM f),
g AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q),
per AS (SELECT config, g.q, count(r.q) FILTER (WHERE rank <= 10) / n_gold::DOUBLE AS recall_10 FROM g CROSS JOIN c JOIN gold ON gold.q = g.q LEFT JOIN r USING (config) WHERE (r.q = g.q AND r.item_id = gold.item_id) GROUP BY config, g.q, n_gold),
m AS (SELECT config, round(sum(coalesce(recall_10, 0)) / (SELECT count(*) FROM g), 6) AS recall_10 FROM c LEFT JOIN per USING (config) GROUP BY config)
"""


def _sweep(spark, sf_dir):
    wide = fusion._wide({"s": _sparse(spark, sf_dir).select("q", "item_id", "rank"), "d": base.nearest(spark, sf_dir).select("q", "item_id", "rank")}, "rank").withColumn("m", F.lit(None).cast("double"))
    configs = spark.createDataFrame([(n, 0.0, s, d) for n, s, d in CONFIGS], "config string, w_m double, w_s double, w_d double")
    lists = analytics.sweep(wide, configs, 60, base.n_items(spark, sf_dir), 10)
    gold = base.gold(spark, sf_dir)
    size = gold.groupBy("q").agg(F.count("*").alias("n_gold"))
    hits = gold.join(lists, ["q", "item_id"]).groupBy("config", "q").agg(F.count("*").alias("hits")).join(size, "q")
    sums = hits.groupBy("config").agg(F.sum(F.col("hits") / F.col("n_gold")).alias("t"))
    n = size.agg(F.count("*").alias("n"))
    return configs.select("config").join(sums, "config", "left").crossJoin(F.broadcast(n)).select("config", F.round(F.coalesce(F.try_divide(F.coalesce("t", F.lit(0.0)), F.col("n")), F.lit(0.0)), 6).alias("recall_10"))


@query(SWEEP_SQL + "SELECT config, recall_10 FROM m")
def sweep_grid(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(SWEEP_SQL + "SELECT config, recall_10 FROM m ORDER BY recall_10 DESC, config LIMIT 1")
def best_config(spark, sf_dir):
    return analytics.best_config(_sweep(spark, sf_dir), "recall_10")


COMPOSITE_WEIGHTS = {1: 0.2, 5: 0.2, 10: 0.3, 25: 0.2, 50: 0.1}


@query(_recall_sql("LEFT") + " SELECT q, round(" + " + ".join(f"{w}::DOUBLE * recall_{k}" for k, w in COMPOSITE_WEIGHTS.items()) + ", 6) AS composite FROM per")
def composite_score(spark, sf_dir):
    total = sum((F.lit(w) * F.col(f"recall_{k}") for k, w in COMPOSITE_WEIGHTS.items()), F.lit(0.0))
    return _recall(spark, sf_dir).select("q", F.round(total, 6).alias("composite"))


PAIR_SQL = f"""
WITH {CHANNELS}, {GOLD_SQL}, g AS (SELECT q, count(*) AS n FROM gold GROUP BY q),
x AS (
    SELECT g.q, round(count(s.q) FILTER (WHERE s.rank <= 10) / n::DOUBLE, 6) AS bm25, round(count(d.q) FILTER (WHERE d.rank <= 10) / n::DOUBLE, 6) AS dense
    FROM g JOIN gold USING (q) LEFT JOIN s ON s.q = g.q AND s.item_id = gold.item_id LEFT JOIN d ON d.q = g.q AND d.item_id = gold.item_id GROUP BY g.q, n
)
"""


def _pair(spark, sf_dir):
    gold, asked = base.gold(spark, sf_dir), base.asked(spark, sf_dir)
    a = evaluate.recall_at(_sparse(spark, sf_dir), gold, asked, (10,), empty_gold="skip").select("q", F.round("recall_10", 6).alias("bm25"))
    b = evaluate.recall_at(base.nearest(spark, sf_dir), gold, asked, (10,), empty_gold="skip").select("q", F.round("recall_10", 6).alias("dense"))
    return a.join(b, "q")


@query(PAIR_SQL + "SELECT q, bm25, dense, greatest(bm25, dense) AS oracle FROM x")
def oracle_best_of_two(spark, sf_dir):
    return _pair(spark, sf_dir).withColumn("oracle", F.greatest("bm25", "dense"))


@query(
    PAIR_SQL + "SELECT CASE WHEN bm25 > 0 AND dense > 0 THEN 'both' WHEN bm25 > 0 THEN 'bm25_only' WHEN dense > 0 THEN 'dense_only' ELSE 'neither' END AS bucket, count(*) AS n, "
    "round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM x GROUP BY bucket"
)
def error_buckets(spark, sf_dir):
    rows = _pair(spark, sf_dir)
    return analytics.histogram(rows.select(analytics.error_buckets(rows, "bm25", "dense").alias("bucket")), "bucket")


@query(
    PAIR_SQL + "SELECT count(*) AS n, count(*) FILTER (WHERE dense > bm25) AS improved, count(*) FILTER (WHERE dense < bm25) AS degraded, count(*) FILTER (WHERE dense = bm25) AS unchanged, "
    "round(coalesce(avg(CASE WHEN dense > bm25 THEN dense - bm25 END), 0), 6) AS mean_gain, round(coalesce(avg(CASE WHEN dense < bm25 THEN dense - bm25 END), 0), 6) AS mean_loss FROM x"
)
def rerank_impact(spark, sf_dir):
    return analytics.impact(_pair(spark, sf_dir).select(F.col("bm25").alias("before"), F.col("dense").alias("after")))


