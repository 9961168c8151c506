"""Question analysis on a fixed list of questions, and answer scoring on fixed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, jsonx, numbers
from ..functions import text as tx
from ..operators import evaluate
from ..operators import query as ask
from . import base
from .base import query, values

QUESTIONS = [
    (1, "Where did I have dinner with Grace in Porto?"),
    (2, "Show photos from April 2023 in Porto"),
    (3, "What did I do on 2023-04-02 in Lisbon?"),
    (4, "Today is 2024-01-15. How much was the total bill yesterday?"),
    (5, "Help me find that photo of the dessert I may have eaten"),
    (6, "How much did the Eiffel Tower tickets cost in 2022?"),
    (7, "what does the place look like"),
    (8, "Which flight number is on the receipt from 2023-13-02?"),
    (9, "I remember a place where we ate last week, can you find it"),
    (10, ""),
    (11, "Recall the NeurIPS invoice on Dec 12, 2021"),
    (12, "Which museum did we visit in Tokyo and Kyoto, Japan?"),
    (13, "when is the deadline"),
    (14, "the postcard"),
    (15, "2020/05 trip to Madrid"),
]
Q_SQL = values(QUESTIONS, "q, question")
MONTHS_SQL = "|".join(dates.MONTH_NAMES)


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "q int, question string")


CONSTRAINT_CTE = rf"""
qs AS (SELECT * FROM {Q_SQL}),
p AS (
    SELECT q, question, regexp_extract(question, '\b((?:19|20)\d{{2}})[-/](\d{{1,2}})(?:[-/](\d{{1,2}}))?\b', 1) AS y, regexp_extract(question, '\b((?:19|20)\d{{2}})[-/](\d{{1,2}})(?:[-/](\d{{1,2}}))?\b', 2) AS m,
        regexp_extract(question, '\b((?:19|20)\d{{2}})[-/](\d{{1,2}})(?:[-/](\d{{1,2}}))?\b', 3) AS d, regexp_extract(question, '\b((?:19|20)\d{{2}})\b', 1) AS yy,
        lower(regexp_extract(question, '(?i)\b({MONTHS_SQL})\b', 1)) AS mm,
        regexp_extract(question, '(?i)today\s+is\s+((?:19|20)\d{{2}}[-/]\d{{1,2}}[-/]\d{{1,2}})', 1) AS t,
        regexp_extract_all(trim(question), '[A-Za-z][A-Za-z\-'']+') AS ws
    FROM qs
), b AS (
    SELECT *, CASE WHEN mm = '' THEN NULL ELSE list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], left(mm, 3)) END AS mn FROM p
), r AS (
    SELECT q, question,
        CASE WHEN y <> '' THEN try_cast(concat(y, '-', lpad(m, 2, '0'), '-', CASE WHEN d = '' THEN '01' ELSE lpad(d, 2, '0') END) AS DATE) WHEN yy <> '' THEN make_date(yy::INT, coalesce(mn, 1)::INT, 1) END AS s,
        y <> '' AND d <> '' AS one_day, y <> '' AS written, mn, try_cast(t AS DATE) AS today,
        list_distinct(list_transform(list_filter(ws[2:], lambda w: regexp_matches(w, '^[A-Z]') AND len(w) >= 3 AND NOT list_contains({list(dates.MONTH_NAMES)}, lower(w))), lambda w: lower(w))) AS locs
    FROM b
), c AS (
    SELECT q, question, s AS "start", CASE WHEN one_day THEN s WHEN written OR mn IS NOT NULL THEN last_day(s) WHEN s IS NOT NULL THEN make_date(year(s), 12, 31) END AS "end", today, locs FROM r
)"""


@query(f'WITH {CONSTRAINT_CTE} SELECT q, "start"::VARCHAR AS "start", "end"::VARCHAR AS "end", today::VARCHAR AS today, array_to_string(list_sort(locs), \',\') AS locations FROM c')
def query_constraints(spark, sf_dir):
    return ask.with_constraints(_questions(spark)).select("q", *[F.col(c).cast("string").alias(c) for c in ("start", "end", "today")], F.array_join(F.array_sort("locations"), ",").alias("locations"))


def _sql_any(patterns) -> str:
    return "(?i)" + "|".join(patterns).replace("'", "''")


SIGNAL_CTE = (
    CONSTRAINT_CTE
    + rf""", e AS (
    SELECT *, len(list_filter(regexp_extract_all(question, '{ask.ENTITY}'), lambda x: NOT list_contains({list(ask.ENTITY_STOP)}, x))) > 0 AS has_entity,
        regexp_matches(question, '{_sql_any(ask.VAGUE_DATE)}') AS vague_date, regexp_matches(question, '{_sql_any(ask.VISUAL)}') AS visual,
        least(1.0::DOUBLE, 0.4e0 * len(regexp_extract_all(question, '{_sql_any(ask.KEYWORD)}'))) AS k0, round(least(1.0::DOUBLE, 0.4e0 * len(regexp_extract_all(question, '{_sql_any(ask.SEMANTIC)}'))), 6) AS sem,
        round(CASE WHEN "start" IS NULL THEN 0 WHEN regexp_matches(question, '{_sql_any(ask.FIRM_DATE)}') THEN 0.7e0 ELSE 0.5e0 END + CASE WHEN len(locs) > 0 THEN 0.3e0 ELSE 0 END, 6) AS meta,
        CASE WHEN regexp_matches(question, '(?i)\bhow\s+much\b|\btotal\b|\bamount\b|\bprice\b|\bcost\b') THEN 'number'
            WHEN regexp_matches(question, '(?i)\bhelp\s+me\s+find\b|\brecall\b|\bfind\s+(?:that|the)\s+photo\b') THEN 'list_recall' ELSE '' END AS hint
    FROM c
), g AS (SELECT *, round(CASE WHEN has_entity THEN greatest(k0, 0.2e0) ELSE k0 END, 6) AS kw FROM e)"""
)


@query(f"WITH {SIGNAL_CTE} SELECT q, kw, sem, meta, hint, has_entity, vague_date, visual FROM g")
def query_signals(spark, sf_dir):
    return ask.with_signals(_questions(spark)).select("q", "kw", "sem", "meta", "hint", "has_entity", "vague_date", "visual")


@query(
    f"WITH {SIGNAL_CTE} SELECT q, CASE WHEN meta >= 0.6e0 AND kw >= sem THEN 'META_THEN_BM25' WHEN meta >= 0.6e0 THEN 'META_THEN_DENSE' WHEN kw >= 0.4e0 AND sem < 0.2e0 THEN 'BM25_ONLY' "
    "WHEN sem >= 0.4e0 AND kw < 0.2e0 THEN 'DENSE_ONLY' WHEN hint = 'number' AND kw >= 0.2e0 THEN 'BM25_ONLY' WHEN hint = 'list_recall' AND sem >= 0.2e0 THEN 'DENSE_ONLY' ELSE 'FULL_HYBRID' END AS strategy FROM g"
)
def route_strategy(spark, sf_dir):
    return ask.with_signals(_questions(spark)).select("q", ask.hard_route().alias("strategy"))


def _weight_sql(table: dict, clamp: bool) -> str:
    rows = []
    for name, (m, s, d) in table.items():
        if clamp:
            m, s, d = min(m, 0.15), min(s, 0.35), max(d, 0.5)
        rows.append((name, m, s, d))
    return values(rows, "strategy, m, s, d")


ADAPTIVE_SQL = """CASE WHEN meta >= 0.6e0 AND vague_date AND sem >= 0.3e0 THEN 'meta+dense_rel' WHEN meta >= 0.6e0 AND kw >= sem THEN 'meta+bm25' WHEN meta >= 0.6e0 THEN 'meta+dense'
    WHEN kw >= 0.4e0 AND sem < 0.2e0 AND meta >= 0.3e0 THEN 'bm25_tilt+meta' WHEN kw >= 0.4e0 AND sem < 0.2e0 THEN 'bm25_tilt' WHEN sem >= 0.4e0 AND kw < 0.2e0 AND has_entity THEN 'dense+entity'
    WHEN sem >= 0.4e0 AND kw < 0.2e0 THEN 'dense_tilt' WHEN kw >= 0.2e0 AND kw > sem THEN 'bm25_nudge' WHEN sem >= 0.2e0 AND sem > kw THEN 'dense_nudge' WHEN has_entity THEN 'balanced+entity' ELSE 'balanced' END"""
HARD_SQL = """CASE WHEN sem >= 0.4e0 AND has_entity THEN 'hard_dense+ent' WHEN sem >= 0.4e0 THEN 'hard_dense_tilt' WHEN kw >= 0.4e0 AND meta >= 0.3e0 THEN 'hard_kw+meta' WHEN kw >= 0.4e0 THEN 'hard_kw_mild'
    WHEN meta >= 0.6e0 THEN 'hard_meta' WHEN kw >= 0.2e0 AND kw > sem THEN 'hard_kw_nudge' WHEN sem >= 0.2e0 THEN 'hard_sem_nudge' ELSE 'hard_baseline' END"""
SHARES = ", ".join(f"round({c}::DOUBLE / (m::DOUBLE + s::DOUBLE + d::DOUBLE), 6) AS w_{c}" for c in "msd")


@query(
    f"WITH {SIGNAL_CTE}, n AS (SELECT q, {ADAPTIVE_SQL} AS strategy, CASE WHEN meta >= 0.6e0 AND NOT vague_date THEN 'hard' ELSE 'soft' END AS filter_mode FROM g) "
    f"SELECT q, strategy, filter_mode, {SHARES} FROM n JOIN {_weight_sql(ask.ADAPTIVE, False)} USING (strategy)"
)
def adaptive_weights(spark, sf_dir):
    return ask.with_adaptive_weights(ask.with_signals(_questions(spark))).select("q", "strategy", "filter_mode", "w_m", "w_s", "w_d")


@query(f"WITH {SIGNAL_CTE}, n AS (SELECT q, {HARD_SQL} AS strategy FROM g) SELECT q, strategy, 'soft' AS filter_mode, {SHARES} FROM n JOIN {_weight_sql(ask.HARD_ADAPTIVE, True)} USING (strategy)")
def adaptive_weights_hard(spark, sf_dir):
    return ask.with_hard_weights(ask.with_signals(_questions(spark))).select("q", "strategy", "filter_mode", "w_m", "w_s", "w_d")


@query(
    f"WITH {SIGNAL_CTE}, n AS (SELECT q, {ADAPTIVE_SQL} AS strategy FROM g) SELECT strategy, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM n GROUP BY strategy"
)
def strategy_histogram(spark, sf_dir):
    from ..operators import analytics

    return analytics.histogram(ask.with_adaptive_weights(ask.with_signals(_questions(spark))), "strategy")


@query(
    f"WITH {SIGNAL_CTE} SELECT q, round(0.19e0 * (1 - w), 6) AS m, round(0.39e0 * (1 - w), 6) AS s, round(0.56e0 * (1 - w), 6) AS d, w AS v FROM (SELECT q, CASE WHEN visual THEN 0.2e0 ELSE 0.0e0 END AS w FROM g)"
)
def conditional_vl(spark, sf_dir):
    from ..operators import fusion

    rows = _questions(spark)
    w = fusion.inject_vision({"m": F.lit(0.19), "s": F.lit(0.39), "d": F.lit(0.56)}, F.lit(0.2), ask.is_visual(F.col("question")))
    return rows.select("q", *[F.round(w[k], 6).alias(k) for k in "msdv"])


SUBS = [(1, 0, "Where was the dinner"), (1, 1, "dinner place"), (1, 2, " WHERE was the dinner "), (1, 3, ""), (1, 4, "Porto dinner"), (1, 5, "more"), (2, 0, "only")]


@query(
    f"WITH s AS (SELECT * FROM {values(SUBS, 'q, n, text')}), o AS (SELECT *, row_number() OVER (PARTITION BY q, lower(trim(text)) ORDER BY n) AS r FROM s WHERE trim(text) <> ''), "
    "k AS (SELECT q, text, row_number() OVER (PARTITION BY q ORDER BY n) AS n FROM o WHERE r = 1) SELECT q, n, text FROM k WHERE n <= 3"
)
def sub_queries(spark, sf_dir):
    return ask.sub_queries(spark.createDataFrame(SUBS, "q int, n int, text string"), 2)


# -- answers ------------------------------------------------------------------

ANSWERS = [
    (1, "number", "£12.85 (with railcard)", "The fare was £12.85", "How much was it?"),
    (2, "number", "March 3-5, 2022", "from Mar 3 to 5 2022", "When?"),
    (3, "number", "4:00 PM", "16:00", "At what time?"),
    (4, "number", "three sessions", "3", "How many?"),
    (5, "list_recall", "20230401_120000, email00021", "I found 20230401_120000 and EMAIL00021 there", "Which?"),
    (6, "open_end", "Unknown", "There is no information", "Who?"),
    (7, "open_end", "Unknown", "Grace", "Who?"),
    (8, "open_end", "yes", "no", "Did I?"),
    (9, "open_end", "12 High Street, Oxford", "It is on High Street in Oxford", "Where?"),
    (10, "open_end", "K702AB", "The code: K702AB", "Code?"),
    (11, "open_end", "K702AB", "The code: K703AB", "Code?"),
    (12, "open_end", "tomorrow at noon", "March 02 at 12:00", "Today is 2022-03-01, when?"),
    (13, "open_end", "red, green and blue", "blue, red and green", "Colours?"),
    (14, "number", "1250", "1250", "How many?"),
    (15, "number", "$20", "20 euros", "How much?"),
    (16, "open_end", "A Star Wars-themed event", "star wars-themed event", "What?"),
    (17, "number", "2022-07-25", "July 25", "When?"),
    (18, "number", "2022-07-25", "July 26", "When?"),
    (19, "open_end", "the quick brown fox jumps", "quick brown fox jumps high", "What?"),
    (20, "list_recall", "cake; tea", "tea", "What?"),
]
ANSWER_TYPE = "id int, qtype string, answer string, prediction string, question string"
A_SQL = values(ANSWERS, "id, qtype, answer, prediction, question")


def _answers(spark):
    return spark.createDataFrame(ANSWERS, ANSWER_TYPE)


@query()
def em_cascade(spark, sf_dir):
    return evaluate.with_exact_match(_answers(spark)).select("id", "qtype", "exact")


@query()
def list_jaccard(spark, sf_dir):
    return _answers(spark).where("qtype = 'list_recall'").select("id", F.round(evaluate.list_score(F.col("answer"), F.col("prediction")), 6).alias("score"))


@query()
def qtype_detect(spark, sf_dir):
    return _answers(spark).select("id", evaluate.question_type(F.col("answer")).alias("found"), evaluate.question_type(F.col("answer"), F.col("qtype")).alias("kind"))


@query()
def extract_dates(spark, sf_dir):
    rows = _answers(spark)
    return rows.select("id", F.array_join(dates.answer_dates("answer"), ",").alias("dates"), F.array_join(dates.answer_times("answer"), ",").alias("times"))


@query()
def extract_amounts(spark, sf_dir):
    rows = _answers(spark)
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("double").cast("string")), ",")
    return rows.select("id", join(numbers.amounts("answer")).alias("amounts"), join(numbers.numbers("answer")).alias("numbers"), F.array_join(numbers.currencies("answer"), ",").alias("currencies"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b')) AS n_numbers FROM documents")
def extract_numbers(spark, sf_dir):
    return base.table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(numbers.NUMBER), F.lit(0))).alias("n_numbers"))


@query(rf"SELECT id, array_to_string(list_concat(regexp_extract_all(prediction, '\b\d{{8}}_\d{{6}}\b'), list_transform(regexp_extract_all(prediction, '(?i)\bemail\d+\b'), lambda x: lower(x))), ',') AS ids FROM {A_SQL}")
def extract_ids(spark, sf_dir):
    return _answers(spark).select("id", F.array_join(tx.memory_ids("prediction"), ",").alias("ids"))


@query(
    "WITH x AS (SELECT CASE WHEN toxic = 1 THEN 'number' WHEN doc_id % 3 = 0 THEN 'list_recall' ELSE 'open_end' END AS kind, quality::DOUBLE AS s FROM labels), "
    "k AS (SELECT unnest(['number', 'list_recall', 'open_end']) AS kind), a AS (SELECT kind, count(s) AS n, coalesce(sum(s), 0) AS correct FROM k LEFT JOIN x USING (kind) GROUP BY kind UNION ALL SELECT 'all', count(*), coalesce(sum(s), 0) FROM x) "
    "SELECT kind, n, correct, CASE WHEN n = 0 THEN 0 ELSE round(correct / n, 6) END AS accuracy FROM a"
)
def score_by_qtype(spark, sf_dir):
    kind = F.when(F.col("toxic") == 1, "number").when(F.col("doc_id") % 3 == 0, "list_recall").otherwise("open_end")
    rows = base.table(spark, sf_dir, "labels").select(kind.alias("qtype"), F.col("quality").cast("double").alias("score"))
    return evaluate.summarize_scores(rows).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "SELECT lang, toxic, count(*) AS n, round(avg(quality), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (toxic), (lang, toxic))"
)
def breakdown_grouping_sets(spark, sf_dir):
    rows = base.table(spark, sf_dir, "labels").join(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows.createOrReplaceTempView("labelled_documents")
    return spark.sql("SELECT lang, toxic, count(*) AS n, round(avg(quality), 6) AS accuracy FROM labelled_documents GROUP BY GROUPING SETS ((lang), (toxic), (lang, toxic))")


# -- replies of models --------------------------------------------------------

REPLIES = [
    (1, '<think>hm {"m": 9}</think> {"m": 1, "s": 1, "d": 2, "v": 0}'),
    (2, "no json"),
    (3, '{"m": -1, "s": 1, "d": 0, "v": 3}'),
    (4, '```json\n{"m": 0, "s": 0, "d": 0, "v": 0}\n```'),
]


@query()
def llm_json_parse(spark, sf_dir):
    rows = spark.createDataFrame(REPLIES, "id int, reply string")
    w = jsonx.router_weights(F.col("reply"), {"m": 0.3, "s": 0.4, "d": 0.3, "v": 0.0})
    return rows.withColumn("w", w).select("id", *[F.round(f"w.{k}", 6).alias(k) for k in "msdv"], jsonx.without_fence("reply").alias("unfenced"))


VERDICTS = [(1, '{"accuracy": true}'), (2, 'It is "accuracy": false here'), (3, "incorrect"), (4, "nope"), (5, "yes indeed")]


@query(
    f"SELECT id, CASE WHEN json_valid(regexp_extract(raw, '(?s)\\{{.*\\}}')) THEN json_extract(regexp_extract(raw, '(?s)\\{{.*\\}}'), '$.accuracy')::BOOLEAN WHEN regexp_matches(lower(raw), '\"accuracy\": ?true') THEN true "
    f"WHEN regexp_matches(lower(raw), '\"accuracy\": ?false') THEN false ELSE regexp_matches(lower(raw), 'accurate|correct|matches|true|yes') END AS verdict FROM {values(VERDICTS, 'id, raw')}"
)
def judge_parse(spark, sf_dir):
    return spark.createDataFrame(VERDICTS, "id int, raw string").select("id", jsonx.judged("raw").alias("verdict"))
