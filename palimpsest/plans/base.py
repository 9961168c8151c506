"""Registration of queries and small helpers that Spark and SQL forms share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels
from ..retrieval.dense import VectorIndex
from ..retrieval.fused import Scan, Stored
from ..retrieval.held import fresh_folder
from ..retrieval.lexical import LexicalIndex
from ..retrieval.retriever import Retriever

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("location"), "source")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document vectors: that of the same number, a made-up pairing that exercises the channel."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).join(items(spark, sf_dir).select("item_id"), "item_id", "left_semi")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("q").join(vectors(spark, sf_dir).select(F.col("item_id").alias("q"), "vector"), "q")


def n_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).agg(F.count("*").alias("n"))


#: Questions with their texts that are sent to the tasks at most.
SENT_QUESTIONS = 1 << 16


#: The indexes of a session, by what they were built from.
_built: dict[tuple, object] = {}


def _kept(rows: DataFrame, kind: str, build: Callable[[], object]):
    """The index of these files in this session; it is built where it is first asked for."""
    key = (rows.sparkSession.sparkContext.applicationId, kind, *sorted(rows.inputFiles()))
    if key not in _built:
        _built[key] = build()
    return _built[key]


def lexical(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    rows = items(spark, sf_dir).select("item_id", "text")
    return _kept(rows, "lexical", lambda: LexicalIndex.build(rows))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    rows = item_vectors(spark, sf_dir)
    return _kept(rows, "vectors", lambda: VectorIndex.build(rows))


def retriever(spark: SparkSession, sf_dir: str) -> Retriever:
    return Retriever(items(spark, sf_dir), lexical(spark, sf_dir), vector_index(spark, sf_dir))


def both_channels(spark: SparkSession, sf_dir: str) -> dict[str, Stored | Scan]:
    """The lexical and the dense channel for questions that are asked once: scores are written, vectors scanned."""
    path = fresh_folder(spark, "scores")
    sparse(spark, sf_dir).write.parquet(path)
    return {"s": Stored(spark.read.parquet(path)), "d": Scan(item_vectors(spark, sf_dir))}


def asked_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, question, vector)."""
    return asked(spark, sf_dir).join(question_vectors(spark, sf_dir), "q", "left")


def sparse(spark: SparkSession, sf_dir: str, variant: str = "plus1") -> DataFrame:
    """(q, item_id, score) of all items that have a word of the question."""
    return channels.bm25(items(spark, sf_dir), asked(spark, sf_dir), variant)


def first_sparse(spark: SparkSession, sf_dir: str, k: int, variant: str = "plus1") -> DataFrame:
    """(q, item_id, score, rank) of the k best by words."""
    return channels.ranked(sparse(spark, sf_dir, variant), k=k)


def nearest(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    found = channels.dense(item_vectors(spark, sf_dir), question_vectors(spark, sf_dir), k)
    return channels.ranked(found.where("score > 0"), k=k)


def contained(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, item_id): items whose text holds the question's text as it is.

    The four words after a question's first are a key: a text that holds the question has them in a row. So
    items join by their own runs of four words, and only what joins is compared, beside its text: no text is shuffled where
    the questions can be sent. Shorter questions, if any, are compared with each item.
    """
    from ..functions.text import tokens

    asked_ = questions.withColumn("_ts", tokens("question"))
    runs = lambda ts: F.transform(F.sequence(F.lit(1), F.size(ts) - 3), lambda k: F.xxhash64(F.array_join(F.slice(ts, k, 4), " ")))
    long = asked_.where(F.size("_ts") >= 6).select("q", "question", F.xxhash64(F.array_join(F.slice("_ts", 2, 4), " ")).alias("_key"))
    coded = rows.withColumn("_ts", tokens("text")).where(F.size("_ts") >= 4)
    long = long.select("_key", "q", "question")
    few = questions.limit(SENT_QUESTIONS + 1).count() <= SENT_QUESTIONS
    keyed = coded.select("item_id", *(["text"] if few else []), F.explode_outer(F.array_distinct(runs(F.col("_ts")))).alias("_key"))  # outer: see `channels.postings`
    keyed = keyed.join(F.broadcast(long) if few else long, "_key")
    hits = (keyed if few else keyed.select("item_id", "q", "question").join(rows.select("item_id", "text"), "item_id")).where(F.contains("text", "question"))
    short = asked_.where(F.size("_ts") < 6).select("q", "question")
    rest = rows.join(short, F.contains("text", "question"))
    return hits.select("q", "item_id").unionByName(rest.select("q", "item_id")).distinct()


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, item_id), written once: queries join it more than once."""
    path = fresh_folder(spark, "gold")
    contained(items(spark, sf_dir), asked(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def literal(value) -> str:
    """A value in SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: Sequence[Sequence], columns: str) -> str:
    """A VALUES table in SQL; columns: `name, name`."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({columns})"


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def bm25_sql(where: str = "", idf: str = "ln(1 + (n - df + 0.5e0) / (df + 0.5e0))", weight: str = "1") -> str:
    """Common table expressions that end in bm(q, item_id, score)."""
    return f"""
tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents {where}),
post AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY doc_id, t),
dl AS (SELECT doc_id, len({TOKENS.format('text')}) AS dl FROM documents {where}),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT t, count(*) AS df FROM post GROUP BY t),
raw AS (SELECT t, df, n, avgdl, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS r FROM df, st),
eps AS (SELECT avg(r) AS mean_r FROM raw),
qt AS (SELECT q, t, count(*) AS qtf FROM (SELECT item_id AS q, unnest({TOKENS.format('text')}) AS t FROM benchmark) GROUP BY q, t),
bm AS (
    SELECT q, doc_id AS item_id, round(sum({weight} * {idf} * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))), 6) AS score
    FROM qt JOIN post USING (t) JOIN raw USING (t) JOIN dl USING (doc_id) CROSS JOIN eps GROUP BY q, doc_id
)"""


DENSE_SQL = """
dn AS (
    SELECT b.item_id AS q, d.doc_id AS item_id, round(list_dot_product(qv.embedding::DOUBLE[], iv.embedding::DOUBLE[]), 6) AS score
    FROM benchmark b JOIN embeddings qv ON qv.vec_id = b.item_id CROSS JOIN (SELECT doc_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id) d
    JOIN embeddings iv ON iv.vec_id = d.doc_id
)"""
RANK = "row_number() OVER (PARTITION BY q ORDER BY score DESC, item_id)"
