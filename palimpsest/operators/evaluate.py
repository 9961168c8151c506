"""Scores of answers and of retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..schemas import COMPOSITE, KS, QTYPES

#: Names by which question types are written.
QTYPE_NAMES = {
    "number": "number num numeric".split(),
    "list_recall": "list_recall list-recall list listrecall".split(),
    "open_end": "open_end open-end open openended open-ended open_ended".split(),
}


# -- question types ----------------------------------------------------------


def is_number_answer(answer: Column) -> Column:
    """Whether nothing is left of an answer without its numbers, dates, times and currencies."""
    clean = text.between_to_range(text.strip_breakdowns(text.strip_parentheses(text.preprocess(text.blank(answer)))))
    some = (
        (F.size(dates.answer_dates(clean)) > 0)
        | (F.size(dates.answer_times(clean)) > 0)
        | (F.size(numbers.numbers(clean)) > 0)
        | (F.size(numbers.currencies(clean)) > 0)
        | (F.size(numbers.amounts(clean)) > 0)
    )
    rest = dates.without_dates(clean)
    rest = F.regexp_replace(rest, r"(?i)\b(" + "|".join(text.DAY_NAMES) + r")\b", " ")
    rest = F.regexp_replace(rest, r"(?i)\b(on|at|from|to|between|and|or|around|about|approx|approximately|before|after|until|till|by|in|of|for)\b", " ")
    rest = F.regexp_replace(rest, r"(?i)\b(usd|gbp|eur|aud|jod|dollars?|pounds?|euros?)\b", " ")
    rest = text.squeeze(F.regexp_replace(rest, r"[£$€\d\-–~/:,.;]", " "))
    return (text.blank(answer) != "") & ~text.is_abstention(answer) & some & (rest == "")


def is_list_answer(answer: Column) -> Column:
    """Whether an answer holds memory ids and nothing else."""
    answer = text.blank(answer)
    rest = F.regexp_replace(answer, r"(?i)\b\d{8}_\d{6}\b|\bemail\d+\b|\band\b", " ")
    return (F.size(text.memory_ids(answer)) > 0) & ~rest.rlike("[A-Za-z0-9]")


def question_type(answer: Column, written: Column | None = None) -> Column:
    """The type that is written, by any of its names; else number, list_recall or open_end by the answer's form."""
    found = F.when(is_number_answer(answer), "number").when(is_list_answer(answer), "list_recall").otherwise("open_end")
    if written is None:
        return found
    low = F.lower(F.trim(written))
    named = None
    for kind, names in QTYPE_NAMES.items():
        named = F.when(low.isin(names), kind) if named is None else named.when(low.isin(names), kind)
    return F.coalesce(named, found)


# -- exact match -------------------------------------------------------------


def semantic_match(truth: Column, prediction: Column) -> Column:
    """Whether dates, times and amounts agree loosely and four fifths of the long content tokens occur."""
    td, pd = dates.answer_dates(truth), dates.answer_dates(prediction)
    tt, pt = dates.answer_times(truth), dates.answer_times(prediction)
    ta, pa = numbers.amounts(truth), numbers.amounts(prediction)
    ends = lambda a: F.transform(a, lambda x: F.right(x, F.lit(4)))
    days = (F.size(td) == 0) | F.arrays_overlap(ends(td), ends(pd))
    times = (F.size(tt) == 0) | (F.size(pt) == 0) | F.arrays_overlap(tt, pt)
    money = (F.size(ta) == 0) | ((F.size(pa) > 0) & numbers.same_bag(ta, pa))
    long = lambda c: F.array_distinct(F.filter(text.content_tokens(c), lambda t: F.length(t) > 2))
    want, got = long(truth), long(prediction)
    share = (F.size(want) == 0) | (F.size(F.array_intersect(want, got)) >= F.size(want) * 0.8)
    return days & times & money & share


def with_exact_match(df: DataFrame, truth: str = "answer", prediction: str = "prediction", question: str | None = "question", out: str = "exact") -> DataFrame:
    """Adds whether the prediction gives the answer: an ordered cascade of rules.

    Intermediate columns keep each part of the plan small; they are dropped again.
    """
    reference = dates.reference_date(F.col(question)) if question else F.lit(None).cast("date")
    df = df.withColumn("_ref", reference)
    df = df.withColumns({"_t": text.clean_answer(dates.resolve_relative(F.col(truth), F.col("_ref"))), "_p": text.clean_answer(dates.resolve_relative(F.col(prediction), F.col("_ref")))})
    t, p = F.col("_t"), F.col("_p")
    df = df.withColumns(
        {
            "_tn": text.normalize_text(t), "_pn": text.normalize_text(p), "_ta": text.is_abstention(F.col(truth)), "_pa": text.is_abstention(F.col(prediction)),
            "_codes": numbers.codes(t), "_td": dates.answer_dates(t), "_pd": dates.answer_dates(p), "_tt": dates.answer_times(t), "_pt": dates.answer_times(p),
            "_tc": dates.without_dates(t), "_pc": dates.without_dates(p), "_items": text.split_list(t),
        }
    )
    tc, pc = F.col("_tc"), F.col("_pc")
    df = df.withColumns(
        {
            "_tr": text.strip_context(text.normalize_text(tc)), "_pr": text.strip_context(text.normalize_text(pc)), "_tcur": numbers.currencies(tc), "_pcur": numbers.currencies(pc),
            "_tam": numbers.amounts(tc), "_pam": numbers.amounts(pc), "_tnum": numbers.numbers(tc), "_pnum": numbers.numbers(pc),
        }
    )
    c, size = F.col, F.size
    said = F.regexp_replace(F.upper(p), r"\b(?:CODE|ID|REFERENCE|REF|NUMBER|NUM|LABEL):\s*", "")
    has_amounts = size("_tam") > 0
    not_amount = lambda nums, ams: F.when(has_amounts, F.filter(c(nums), lambda x: ~F.array_contains(c(ams), x))).otherwise(c(nums))
    tnum, pnum = not_amount("_tnum", "_tam"), not_amount("_pnum", "_pam")
    dated = (size("_td") > 0) | (size("_tt") > 0)
    yes_no = c("_tn").startswith("yes") | c("_tn").startswith("no")
    exact = (
        F.when(c("_ta") | c("_pa"), c("_ta") & c("_pa"))
        .when(~F.forall("_codes", lambda x: F.contains(said, x)), False)
        .when((size("_td") > 0) & ((size("_pd") == 0) | ~dates.dates_match(c("_td"), c("_pd"))), False)
        .when((size("_tt") > 0) & (size("_pt") > 0) & ~numbers.same_bag(c("_tt"), c("_pt")), False)
        .when(dated & ((c("_tr") == "") | text.token_subset(c("_tr"), c("_pr"))), True)
        .when((size("_tcur") > 0) & (size("_pcur") > 0) & (c("_tcur") != c("_pcur")), False)
        .when(has_amounts & ((size("_pam") == 0) | ~numbers.same_bag(c("_tam"), c("_pam"))), False)
        .when((size(tnum) > 0) & ((size(pnum) == 0) | ~numbers.same_bag(tnum, pnum)), False)
        .when(size("_items") >= 2, F.forall("_items", lambda x: F.contains(c("_pn"), x)))
        .when(yes_no & c("_pn").isin("yes", "no"), F.startswith(c("_tn"), c("_pn")))
        .when(text.address_match(t, p), True)
        .when((F.length("_tn") >= 3) & F.contains(c("_pn"), c("_tn")), True)
        .when((F.length("_pn") >= 3) & F.contains(c("_tn"), c("_pn")), True)
        .when(text.token_subset(t, p), True)
        .when(semantic_match(t, p), True)
        .otherwise(c("_tn") == c("_pn"))
    )
    made = [x for x in df.columns if x.startswith("_")]
    return df.withColumn(out, exact).drop(*made)


def list_score(truth: Column, prediction: Column) -> Column:
    """Jaccard of the items of a list answer and of a prediction."""
    return text.jaccard(F.array_distinct(text.split_list(truth)), F.array_distinct(text.list_items(prediction)))


def clamped(score: Column) -> Column:
    return F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def summarize_scores(scores: DataFrame, kind: str = "qtype", score: str = "score", domain: Sequence[str] = QTYPES) -> DataFrame:
    """(kind, n, correct, accuracy) for each of a fixed domain, and for all; a kind outside of it counts as the last."""
    known = F.when(F.lower(kind).isin(*domain), F.lower(kind)).otherwise(domain[-1])
    per = scores.select(known.alias("kind"), clamped(F.col(score)).alias("s")).rollup("kind").agg(F.count("*").alias("n"), F.sum("s").alias("correct"))
    per = per.withColumn("kind", F.coalesce("kind", F.lit("all")))
    every = scores.sparkSession.createDataFrame([(k,) for k in (*domain, "all")], "kind string")
    out = every.join(per, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("correct", F.lit(0.0)).alias("correct"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct"), F.col("n")), F.lit(0.0)))


# -- retrieval ---------------------------------------------------------------


def deduplicated(ranked: DataFrame, q: str = "q", item: str = "item_id", rank: str = "rank") -> DataFrame:
    """Each item once for a question, at its first place, ranked anew."""
    first = ranked.groupBy(q, item).agg(F.min(rank).alias("_r"))
    return first.select(q, item, F.row_number().over(Window.partitionBy(q).orderBy("_r", item)).alias(rank))


def recall_at(ranked: DataFrame, gold: DataFrame, questions: DataFrame, ks: Sequence[int] = KS, q: str = "q", item: str = "item_id", empty_gold: str = "zero") -> DataFrame:
    """(q, n_gold, recall_k..., hit_k...) for each question: the share of its gold items among the first k.

    `empty_gold`: questions without gold have recall 0 (`zero`) or are left out (`skip`).
    """
    want = gold.select(q, item).distinct()
    found = want.join(ranked.select(q, item, "rank"), [q, item])
    hits = found.groupBy(q).agg(*[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in ks])
    sizes = want.groupBy(q).agg(F.count("*").alias("n_gold"))
    out = questions.select(q).join(sizes, q, "left" if empty_gold == "zero" else "inner").join(hits, q, "left")
    n = F.coalesce("n_gold", F.lit(0))
    got = lambda k: F.coalesce(f"found_{k}", F.lit(0))
    return out.select(q, n.alias("n_gold"), *[F.coalesce(F.try_divide(got(k), n), F.lit(0.0)).alias(f"recall_{k}") for k in ks], *[(got(k) > 0).cast("int").alias(f"hit_{k}") for k in ks])


def recall_summary(per_question: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """One row: the number of questions and the mean recall at each cut-off."""
    return per_question.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(f"recall_{k}"), F.lit(0.0)).alias(f"recall_{k}") for k in ks])


def r_precision(ranked: DataFrame, gold: DataFrame, q: str = "q", item: str = "item_id") -> DataFrame:
    """(q, n_gold, recall_gt, hit_1) for questions with gold: recall at as many places as there are gold items."""
    want = gold.select(q, item).distinct()
    sizes = want.groupBy(q).agg(F.count("*").alias("n_gold"))
    found = want.join(ranked.select(q, item, "rank"), [q, item]).join(sizes, q)
    hits = found.groupBy(q).agg(F.count_if(F.col("rank") <= F.col("n_gold")).alias("hits"), F.max((F.col("rank") == 1).cast("int")).alias("hit_1"))
    return sizes.join(hits, q, "left").select(q, "n_gold", (F.coalesce("hits", F.lit(0)) / F.col("n_gold")).alias("recall_gt"), F.coalesce("hit_1", F.lit(0)).alias("hit_1"))


def joint_accuracy(ranked: DataFrame, gold: DataFrame, scores: DataFrame, ks: Sequence[int], q: str = "q", item: str = "item_id", numeric: bool = False) -> DataFrame:
    """(k, n, missing, strict, partial): correct answers whose gold is all, or in part, among the first k.

    Any score above 0 is correct; with `numeric` the score itself weighs. Questions without a score are missing.
    """
    per = recall_at(ranked, gold, gold.select(q).distinct(), ks, q, item).join(scores.select(q, "score"), q, "left")
    right = F.col("score") if numeric else (F.col("score") > 0).cast("double")
    long = per.select(q, "score", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("r")) for k in ks])).alias("x"))
    there = F.col("score").isNotNull()
    return long.groupBy(F.col("x.k").alias("k")).agg(
        F.count_if(there).alias("n"),
        F.count_if(~there).alias("missing"),
        F.coalesce(F.avg(F.when(there, right * (F.col("x.r") == 1).cast("double"))), F.lit(0.0)).alias("strict"),
        F.coalesce(F.avg(F.when(there, right * F.col("x.r"))), F.lit(0.0)).alias("partial"),
    )


def composite(prefix: str = "recall_") -> Column:
    """The weighted recall over all cut-offs."""
    return sum((F.lit(w) * F.col(f"{prefix}{k}") for k, w in COMPOSITE.items()), F.lit(0.0))
