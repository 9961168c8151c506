"""Secret scanning with a random forest that removes false positives, with DataFrame functions only.

A candidate is a run of at least `LEAST` letters, digits and the signs + / _ - with a digit in it. Its
features are its length and make-up, how likely its character pairs are in the words of the corpus, how much
of it dictionary words cover, the path of its document and the words around it. The dictionary and the
character pairs are counted over all texts. The forest learns from labelled findings: at most
`LABELLED_ROWS` of them, chosen by a hash, which is the one bounded sample here. Copies of a value with one
label are one finding. Where a class is cut, the others keep their rows as far as equal shares go, and rows
weigh as many findings as they stand for.

Labelled findings are a table of the caller's, or those that `rule_labels` can tell: well-known key formats
and assigned values are secrets, runs of digits and of one repeated sign, UUIDs and example values are not.
All other candidates are scored without a label.

Defined results
    null text       has no candidates
    null path       counts as the empty path
    repeated rows   each row's candidates are returned; `nth` counts the words before it in its text
    no labels       or only one class: the probability is 1 for a candidate that a rule calls a secret, else 0
    empty table     no rows
    long texts      only those with a candidate are split; a row holds one candidate, not the text
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

LEAST = 16
LABELLED_ROWS = 20_000
TREES = 20
DEPTH = 8
SEED = 7
#: A word counts as one of the dictionary from so many occurrences on.
WORD_COUNT = 5
SIGN = r"[A-Za-z0-9+/_\-]"
CANDIDATE = rf"(?<!{SIGN})(?=[A-Za-z+/_\-]*[0-9]){SIGN}{{{LEAST},}}"
#: Words by which secrets are named, and those of made-up values and paths.
NAMES = r"(?i)(pass|pwd|secret|token|api|key|auth|cred|private)"
MADE_UP = r"(?i)(example|sample|test|dummy|fake|mock|fixture|placeholder|xxxx|your)"
KEY_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35})$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

FEATURES = [
    "n", "digits", "uppers", "signs", "is_hex", "turns", "variety", "pair_odds", "covered", "path_length", "path_depth", "path_made_up",
    "named_here", "named_before", "assigned", "quoted", "made_up", "before_plain", "after_plain",
]


def find_candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, path, nth, part, value, lead, tail, before2, before, after): each candidate with the words around it."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(CANDIDATE)).select("id", "path", F.split("text", r"\s+").alias("words"))
    word = rows.select("id", "path", "words", F.posexplode("words").alias("nth", "word")).where(F.col("word").rlike(CANDIDATE))
    at = lambda k: F.coalesce(F.get("words", F.col("nth") + k), F.lit(""))
    word = word.select("id", "path", "nth", "word", at(-2).alias("before2"), at(-1).alias("before"), at(1).alias("after"))
    each = word.select("*", F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("part", "value"))
    place = F.position("value", "word")
    lead, tail = F.substring("word", F.lit(1), place - 1), F.substring("word", place + F.length("value"), F.length("word"))
    return each.select("id", "path", "nth", "part", "value", lead.alias("lead"), tail.alias("tail"), "before2", "before", "after")


def dictionary(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word, n): lower-case words of three or more ASCII letters and how often all texts have them."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{3,}"), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _pairs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda k: F.substring(text, k, F.lit(2)))


def pair_odds(words: DataFrame) -> DataFrame:
    """(pair, odds): the logarithm of the probability of a letter after another, in the words; at most 26 * 26 rows."""
    pairs = words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select("pair", F.log(F.col("n") / F.sum("n").over(Window.partitionBy(F.substring("pair", 1, 1)))).alias("odds"))


def with_features(found: DataFrame, words: DataFrame, scratch: Scratch) -> DataFrame:
    """The candidates of `find_candidates` with the columns FEATURES. Only distinct values are looked up."""
    values = found.select("value").distinct()
    low = F.lower("value")
    odds = F.broadcast(pair_odds(words))
    pairs = values.select("value", F.explode(_pairs(low)).alias("pair")).join(odds, "pair", "left")
    pairs = pairs.groupBy("value").agg(F.avg(F.coalesce("odds", F.lit(-12.0))).alias("pair_odds"))
    runs = values.select("value", F.explode(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    known = runs.join(words.where(F.col("n") >= WORD_COUNT).select("word"), "word", "left_semi")
    known = known.groupBy("value").agg(F.sum(F.length("word")).alias("letters"))
    out = found.join(pairs, "value").join(known, "value", "left")
    n = F.length("value").cast("double")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    flag = lambda test: test.cast("double")
    plain = r"^[^0-9=:\"'<>]+$"
    return out.select(
        *found.columns,
        n.alias("n"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[^A-Za-z0-9]").alias("signs"),
        flag(F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("is_hex"),
        (F.regexp_count("value", F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) / n).alias("turns"),
        (F.size(F.array_distinct(F.split("value", ""))) / n).alias("variety"),
        F.col("pair_odds"),
        (F.coalesce("letters", F.lit(0)) / n).alias("covered"),
        F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("[/.]")).cast("double").alias("path_depth"),
        flag(F.col("path").rlike(MADE_UP)).alias("path_made_up"),
        flag(F.col("lead").rlike(NAMES)).alias("named_here"),
        flag(F.concat_ws(" ", "before2", "before").rlike(NAMES)).alias("named_before"),
        flag(F.col("lead").rlike("[=:]") | F.col("before").rlike("[=:]$")).alias("assigned"),
        flag(F.col("lead").rlike("[\"']$") & F.col("tail").rlike("^[\"']")).alias("quoted"),
        flag(F.concat_ws(" ", "value", "lead", "before").rlike(MADE_UP)).alias("made_up"),
        flag(F.col("before").rlike(plain)).alias("before_plain"),
        flag(F.col("after").rlike(plain)).alias("after_plain"),
    )


def rule_labels(featured: DataFrame) -> DataFrame:
    """`featured` with `label`: 1 for a secret, 0 for none, null where the rules can't tell."""
    value = F.col("value")
    named = ((F.col("named_here") == 1) | (F.col("named_before") == 1)) & (F.col("assigned") == 1)
    no = value.rlike("^[0-9+/_-]+$") | value.rlike(UUID) | value.rlike(r"(.)\1{7}") | (F.col("made_up") == 1)
    label = F.when(no, 0.0).when(value.rlike(KEY_FORMATS) | named, 1.0).when(F.col("covered") >= 0.5, 0.0)
    return featured.withColumn("label", label)


def scored(featured: DataFrame, scratch: Scratch, *, labelled_rows: int = LABELLED_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """`featured` (with `label`) with `probability`. Every labelled value is one finding to learn from."""
    known = featured.where("label is not null").groupBy("value", "label").agg(F.min(F.struct(*FEATURES)).alias("f")).select("value", "label", "f.*")
    known = scratch.write(known, "findings")
    counts = sorted((r["count"], r["label"]) for r in known.groupBy("label").count().collect())
    if len(counts) < 2:
        return featured.withColumn("probability", F.coalesce("label", F.lit(0.0)))
    sample, room = None, labelled_rows
    for k, (count, label) in enumerate(counts):
        taken = min(count, max(1, room // (len(counts) - k)))
        room -= taken
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("value"), "value").limit(taken).withColumn("weight", F.lit(count / taken))
        sample = part if sample is None else sample.unionByName(part)
    sample = scratch.write(sample.coalesce(1), "labelled")
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    path = scratch.path("forest")
    RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, labelCol="label", weightCol="weight").fit(gather.transform(sample)).save(path)
    forest = RandomForestClassificationModel.load(path)  # a model as fitted would take its training summary, and with that the session, to the tasks
    out = forest.transform(gather.transform(featured))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("probability", "features", "rawPrediction", "prediction").withColumnRenamed("p", "probability")


def scan_secrets(docs: DataFrame, *, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", **options) -> DataFrame:
    """Every candidate of `docs` with its place, features, label and probability.

    `findings` (value, label) are labelled by the caller; without it the rules label what they can.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.write(find_candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col), "candidates")
    words = scratch.write(dictionary(docs, text_col=text_col), "dictionary")
    featured = with_features(found, words, scratch)
    if findings is None:
        featured = rule_labels(featured)
    else:
        mine = findings.groupBy("value").agg(F.max(F.col("label").cast("double")).alias("label"))
        featured = featured.join(mine, "value", "left")
    return scored(scratch.write(featured, "features"), scratch, **options)


def redact(docs: DataFrame, found: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with each secret of `found` replaced by `mark`; documents without one are as they were."""
    key, values = fresh(docs, "_id"), fresh(docs, "_values")
    secrets = found.where(F.col("probability") >= threshold).groupBy(F.col("id").alias(key)).agg(F.sort_array(F.collect_set("value"), asc=False).alias(values))
    rows = docs.join(secrets, F.col(id_col).eqNullSafe(F.col(key)), "left")
    clean = F.aggregate(F.coalesce(values, F.array().cast("array<string>")), F.col(f"`{text_col}`"), lambda t, v: F.replace(t, v, F.lit(mark)))
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("nth").cast("long").alias("word_number"),
        F.col("part").cast("long").alias("part"),
        F.sha2("value", 256).alias("value_sha256"),
        F.col("n").cast("long").alias("length"),
        F.round("probability", 6).alias("probability"),
        (F.col("probability") >= 0.5).alias("is_secret"),
    )
