"""Question analysis: constraints, signals, routes and adaptive weights, as columns of the question table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import blank

SHORT_MONTHS = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
#: Patterns of questions for exact words, of vague questions, of firm dates, of vague dates and of visual things.
KEYWORD = (
    rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+{SHORT_MONTHS}\w*", rf"{SHORT_MONTHS}\w*\s+\d{{1,2}}", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\bhow\s+much\b",
    r"\btotal\s+(?:amount|cost|price|bill|payment)\b", r"\bwhat\s+(?:time|date|day)\b", r"\bwhen\s+(?:is|was|did|do|does)\b", r"\bdeadline\b",
    r"\border\s+(?:number|id|confirmation)\b", r"\breceipt\b", r"\binvoice\b", r"\bbooking\s+(?:ref|reference|confirmation|number)\b",
    r"\bflight\s+(?:number|code)\b", r"\btoday\s+is\b",
)
SEMANTIC = (
    r"\bI\s+remember\b", r"\bhelp\s+me\s+(?:find|recall|remember)\b", r"\bcan\s+you\s+(?:find|help|recall)\b", r"\bphoto\s+of\b", r"\bpicture\s+of\b",
    r"\ba\s+place\s+where\b", r"\bwhere\s+(?:I|we)\s+(?:had|ate|went|saw|visited|took)\b", r"\bwhat.*(?:look|looked)\s+like\b", r"\brecommend\b",
    r"\bwhat'?s?\s+(?:my|the)\s+(?:wifi|password)\b", r"\bdescri(?:be|ptive)\b", r"\bpostcard\b", r"\bpaint\b", r"\bdessert\b", r"\bcream\b",
    r"\bmochi\b", r"\bpet-friendly\b",
)
FIRM_DATE = (r"\b(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}\b", r"\btoday\s+is\s+\w+\s+\d", rf"\bon\s+{SHORT_MONTHS}\w*\s+\d{{1,2}}")
VAGUE_DATE = (
    r"\blast\s+(?:week|month|weekend|night|time|friday|monday|saturday|sunday)\b", r"\ba\s+few\s+days\s+ago\b", r"\brecently\b", r"\bthe\s+other\s+day\b",
    r"\byesterday\b",
)
VISUAL = (
    r"\bphoto(?:s|graph)?\b", r"\bimage(?:s)?\b", r"\bpicture(?:s)?\b", r"\bvideo(?:s)?\b", r"\bsnapshot(?:s)?\b", r"\bscreenshot(?:s)?\b",
    r"\bselfie(?:s)?\b", r"\bsticker(?:s)?\b", r"\bcollect(?:ing|ion)\b", r"\bfind\s+all\b", r"\bsheep\b", r"\bcat\b", r"\bdog\b", r"\bflower\b",
    r"\bbird\b", r"\bbridge\b", r"\btower\b", r"\bcastle\b", r"\bmuseum\b", r"\bsunset\b", r"\bsunrise\b", r"\bbeach\b", r"\bmountain\b", r"\bfood\b",
    r"\bdish\b", r"\bdessert\b", r"\bcake\b", r"\blandmark\b", r"\bmonument\b", r"\bstatue\b", r"\blook(?:s|ed)?\s+like\b",
    r"\bwhat\s+(?:animal|building|object|place|scene)\b",
)
#: Capitalised words that name nothing.
ENTITY_STOP = (
    "What", "Where", "When", "How", "Which", "Who", "Why", "Do", "Did", "Does", "Can", "Could", "Would", "Should", "The", "That", "This", "There",
    "These", "Those", "Help", "Recall", "Find", "Tell", "Describe", "Today", "Yesterday", "Tomorrow", "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul",
    "Aug", "Sep", "Oct", "Nov", "Dec", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November",
    "December", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)
ENTITY = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*\b|\b[A-Z]{2,}\d*\b"
NON_LATIN = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"


def any_of(patterns: Sequence[str]) -> str:
    return "(?i)" + "|".join(patterns)


def is_visual(q: Column) -> Column:
    return blank(q).rlike(any_of(VISUAL))


def location_needles(q: Column, gazetteer: Sequence[str] | None = None) -> Column:
    """Lower-case words that may name places: those of the gazetteer, or else capitalised words but the first and months."""
    words = F.regexp_extract_all(F.trim(blank(q)), F.lit(r"[A-Za-z][A-Za-z\-']+"), F.lit(0))
    if gazetteer:
        known = sorted({g.lower() for g in gazetteer})
        return F.filter(F.transform(words, F.lower), lambda w: w.isin(known))
    fit = F.filter(words, lambda w, i: (i > 0) & w.rlike("^[A-Z]") & (F.length(w) >= 3) & ~F.lower(w).isin(dates.MONTH_NAMES))
    return F.array_distinct(F.transform(fit, F.lower))


def with_constraints(questions: DataFrame, text: str = "question", gazetteer: Sequence[str] | None = None) -> DataFrame:
    """Adds start, end, today and locations."""
    days = dates.question_dates(F.col(text))
    return questions.withColumn("_d", days).select("*", "_d.start", "_d.end", "_d.today", location_needles(F.col(text), gazetteer).alias("locations")).drop("_d")


def with_signals(questions: DataFrame, text: str = "question", gazetteer: Sequence[str] | None = None) -> DataFrame:
    """Adds the constraints and kw, sem, meta, hint, has_entity, vague_date, non_latin, visual."""
    df = with_constraints(questions, text, gazetteer)
    q = blank(F.col(text))
    count = lambda p: F.least(F.lit(1.0), F.regexp_count(q, F.lit(any_of(p))) * 0.4)
    entities = F.filter(F.regexp_extract_all(q, F.lit(ENTITY), F.lit(0)), lambda e: ~e.isin(*ENTITY_STOP))
    df = df.withColumns({"has_entity": F.size(entities) > 0, "non_latin": q.rlike(NON_LATIN), "vague_date": q.rlike(any_of(VAGUE_DATE)), "visual": is_visual(q)})
    named = F.col("has_entity") | F.col("non_latin")
    dated = F.col("start").isNotNull()
    meta = F.when(dated, F.when(q.rlike(any_of(FIRM_DATE)), 0.7).otherwise(0.5)).otherwise(0.0) + F.when(F.size("locations") > 0, 0.3).otherwise(0.0)
    hint = F.when(q.rlike(r"(?i)\bhow\s+much\b|\btotal\b|\bamount\b|\bprice\b|\bcost\b"), "number").when(
        q.rlike(r"(?i)\bhelp\s+me\s+find\b|\brecall\b|\bfind\s+(?:that|the)\s+photo\b"), "list_recall"
    )
    kw = count(KEYWORD)
    return df.withColumns({"kw": F.round(F.when(named, F.greatest(kw, F.lit(0.2))).otherwise(kw), 6), "sem": F.round(count(SEMANTIC), 6), "meta": F.round(F.least(meta, F.lit(1.0)), 6), "hint": F.coalesce(hint, F.lit(""))})


def hard_route() -> Column:
    """One of six strategies by the signals; the first rule that fits."""
    kw, sem, meta, hint = (F.col(c) for c in ("kw", "sem", "meta", "hint"))
    return (
        F.when((meta >= 0.6) & (kw >= sem), "META_THEN_BM25")
        .when(meta >= 0.6, "META_THEN_DENSE")
        .when((kw >= 0.4) & (sem < 0.2), "BM25_ONLY")
        .when((sem >= 0.4) & (kw < 0.2), "DENSE_ONLY")
        .when((hint == "number") & (kw >= 0.2), "BM25_ONLY")
        .when((hint == "list_recall") & (sem >= 0.2), "DENSE_ONLY")
        .otherwise("FULL_HYBRID")
    )


#: Name, weights of metadata, sparse and dense, of each rule of the adaptive router, and of that for hard questions.
ADAPTIVE = {
    "meta+dense_rel": (0.15, 0.20, 0.65), "meta+bm25": (0.25, 0.45, 0.30), "meta+dense": (0.25, 0.20, 0.55), "bm25_tilt+meta": (0.15, 0.40, 0.45),
    "bm25_tilt": (0.10, 0.40, 0.50), "dense+entity": (0.08, 0.25, 0.67), "dense_tilt": (0.07, 0.18, 0.75), "bm25_nudge": (0.10, 0.30, 0.60),
    "dense_nudge": (0.08, 0.17, 0.75), "balanced+entity": (0.10, 0.25, 0.65), "balanced": (0.10, 0.20, 0.70),
}
HARD_ADAPTIVE = {
    "hard_dense+ent": (0.05, 0.25, 0.70), "hard_dense_tilt": (0.05, 0.20, 0.75), "hard_kw+meta": (0.10, 0.30, 0.60), "hard_kw_mild": (0.08, 0.30, 0.62),
    "hard_meta": (0.12, 0.25, 0.63), "hard_kw_nudge": (0.07, 0.30, 0.63), "hard_sem_nudge": (0.06, 0.22, 0.72), "hard_baseline": (0.07, 0.27, 0.67),
}


def _weights(name: Column, table: dict[str, tuple[float, float, float]], clamp: bool = False) -> Column:
    parts = []
    for j, part in enumerate("msd"):
        value = None
        for key, row in table.items():
            w = row[j]
            if clamp:
                w = max(w, 0.5) if part == "d" else min(w, 0.35 if part == "s" else 0.15)
            value = F.when(name == key, F.lit(w)) if value is None else value.when(name == key, F.lit(w))
        parts.append(value)
    total = parts[0] + parts[1] + parts[2]
    return F.struct(*[F.round(p / total, 6).alias(k) for k, p in zip("msd", parts, strict=True)])


def with_adaptive_weights(signals: DataFrame) -> DataFrame:
    """Adds strategy, w_m, w_s, w_d (of sum 1) and filter_mode."""
    kw, sem, meta, vague = (F.col(c) for c in ("kw", "sem", "meta", "vague_date"))
    named = F.col("has_entity") | F.col("non_latin")
    strong = meta >= 0.6
    name = (
        F.when(strong & vague & (sem >= 0.3), "meta+dense_rel")
        .when(strong & (kw >= sem), "meta+bm25")
        .when(strong, "meta+dense")
        .when((kw >= 0.4) & (sem < 0.2) & (meta >= 0.3), "bm25_tilt+meta")
        .when((kw >= 0.4) & (sem < 0.2), "bm25_tilt")
        .when((sem >= 0.4) & (kw < 0.2) & named, "dense+entity")
        .when((sem >= 0.4) & (kw < 0.2), "dense_tilt")
        .when((kw >= 0.2) & (kw > sem), "bm25_nudge")
        .when((sem >= 0.2) & (sem > kw), "dense_nudge")
        .when(named, "balanced+entity")
        .otherwise("balanced")
    )
    out = signals.withColumn("strategy", name).withColumn("_w", _weights(F.col("strategy"), ADAPTIVE))
    return out.select("*", "_w.*", F.when(strong & ~vague, "hard").otherwise("soft").alias("filter_mode")).drop("_w").withColumnsRenamed({"m": "w_m", "s": "w_s", "d": "w_d"})


def with_hard_weights(signals: DataFrame) -> DataFrame:
    """The same for hard questions: always soft, dense at least half before the weights are brought to sum 1."""
    kw, sem, meta = (F.col(c) for c in ("kw", "sem", "meta"))
    named = F.col("has_entity") | F.col("non_latin")
    name = (
        F.when((sem >= 0.4) & named, "hard_dense+ent")
        .when(sem >= 0.4, "hard_dense_tilt")
        .when((kw >= 0.4) & (meta >= 0.3), "hard_kw+meta")
        .when(kw >= 0.4, "hard_kw_mild")
        .when(meta >= 0.6, "hard_meta")
        .when((kw >= 0.2) & (kw > sem), "hard_kw_nudge")
        .when(sem >= 0.2, "hard_sem_nudge")
        .otherwise("hard_baseline")
    )
    out = signals.withColumn("strategy", name).withColumn("_w", _weights(F.col("strategy"), HARD_ADAPTIVE, clamp=True))
    return out.select("*", "_w.*", F.lit("soft").alias("filter_mode")).drop("_w").withColumnsRenamed({"m": "w_m", "s": "w_s", "d": "w_d"})


def execute_routes(questions: DataFrame, lists: dict[str, DataFrame], strategy: str = "strategy", k: int = 10) -> DataFrame:
    """Each question's list by its strategy: lists is {strategy: (q, item_id, score)}; all branches stay lazy."""
    from .channels import ranked

    rows = None
    for name, df in lists.items():
        mine = df.join(questions.where(F.col(strategy) == name).select("q"), "q", "left_semi").select("q", "item_id", "score", F.lit(name).alias("strategy"))
        rows = mine if rows is None else rows.unionByName(mine)
    return ranked(rows, k=k)


def sub_queries(parts: DataFrame, most: int) -> DataFrame:
    """(q, n, text): the anchor question first, then sub-questions, each once whatever its case, at most `most` + 1.

    parts: (q, n, text), n = 0 for the anchor.
    """
    from pyspark.sql import Window

    key = F.lower(F.trim("text"))
    first = parts.where(F.trim("text") != "").withColumn("_k", key)
    once = first.withColumn("_r", F.row_number().over(Window.partitionBy("q", "_k").orderBy("n"))).where("_r = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("n"))).where(F.col("n") <= most + 1).select("q", "n", "text")
