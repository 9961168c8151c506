"""Dates, times and the constraints that questions put on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

#: The months in order; each may be shortened to three letters, September also to four.
MONTHS = "january february march april may june july august september october november december".split()
MONTH_NAMES = sorted({m for full in MONTHS for m in (full, full[:3])} | {"sept"}, key=lambda m: (-len(m), m))
MONTH = "|".join(MONTH_NAMES)
#: The forms of timestamps in records, and in emails.
RECORD_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
EVENT_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
EMAIL_FORMATS = ("M/d/yyyy, h:mm a", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
ISO = r"\b((?:19|20)\d{2})[-/](\d{1,2})(?:[-/](\d{1,2}))?\b"
YEAR = r"\b((?:19|20)\d{2})\b"


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name or short name."""
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    at = F.array_position(names, F.left(F.lower(name), F.lit(3))).cast("int")
    return F.when(at > 0, at)


def try_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none such."""
    text = F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def _parsed(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def record_date(c: Column | str) -> Column:
    """The date of a record's timestamp; else of the first date within it, its first day if it names a month only."""
    text = F.trim(blank(c))
    inside = [F.nullif(F.regexp_extract(text, ISO, k), F.lit("")) for k in (1, 2, 3)]
    return F.coalesce(_parsed(text, RECORD_FORMATS).cast("date"), try_date(inside[0], inside[1], F.coalesce(inside[2], F.lit("1"))))


def event_timestamp(c: Column | str) -> Column:
    """The timestamp that an organiser sees: three forms, each tried on the start of the text."""
    text = F.trim(blank(c))
    return F.coalesce(*[F.try_to_timestamp(F.left(text, F.lit(n)), F.lit(f)) for f, n in zip(EVENT_FORMATS, (19, 19, 10), strict=True)])


def email_timestamp(c: Column | str) -> Column:
    """The timestamp of an email; a time zone at the end and the day's name are dropped if need be."""
    text = F.trim(blank(c))
    bare = F.regexp_replace(F.regexp_replace(text, r"\s*[+-]\d{4}.*$", ""), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(_parsed(text, EMAIL_FORMATS), _parsed(bare, EMAIL_FORMATS))


def utc_timestamp(c: Column | str) -> Column:
    """A timestamp with or without zone, as UTC without zone."""
    text = F.trim(blank(c))
    zoned = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX")])
    return F.coalesce(zoned, _parsed(text, RECORD_FORMATS)).cast("timestamp_ntz")


def month_range(year: Column, month: Column) -> Column:
    """(start, end) of a month, or of the year if month is null."""
    first = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
    last = F.when(month.isNull(), F.make_date(year, F.lit(12), F.lit(31))).otherwise(F.last_day(first))
    return F.struct(first.alias("start"), last.alias("end"))


def question_dates(q: Column | str) -> Column:
    """(start, end, today): the date range that a question asks for, and the day that it calls today.

    A written date comes first, even one that is the day called today; if it is no date there is no range.
    Else a month and a year, or a year. The word `may` counts as a month.
    """
    q = blank(q)
    part = lambda pattern, k: F.nullif(F.regexp_extract(q, pattern, k), F.lit(""))
    anchor = r"(?i)today\s+is\s+((?:19|20)\d{2})[-/](\d{1,2})[-/](\d{1,2})"
    today = try_date(part(anchor, 1), part(anchor, 2), part(anchor, 3))
    y, m, d = (part(ISO, k) for k in (1, 2, 3))
    exact = try_date(y, m, d)
    first = try_date(y, m, F.lit("1"))
    written = F.when(d.isNotNull(), F.struct(exact.alias("start"), exact.alias("end"))).otherwise(F.struct(first.alias("start"), F.last_day(first).alias("end")))
    year = part(YEAR, 1).cast("int")
    named = month_number(part(rf"(?i)\b({MONTH})\b", 1))
    loose = F.when(year.isNotNull(), month_range(year, named))
    chosen = F.when(y.isNotNull(), written).otherwise(loose)
    return F.struct(chosen["start"].alias("start"), chosen["end"].alias("end"), today.alias("today"))


# -- dates and times in answers --------------------------------------------

#: The forms of dates and times in answers.
ANSWER_ISO = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
COMPACT = r"\b((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\b"
TAIL = r"(?:,?\s*(\d{4}))?\b"
NTH = r"(?:st|nd|rd|th)?"
MONTH_DAYS = rf"(?i)\b({MONTH})\s+(\d{{1,2}}){NTH}\s*(?:-|to|–)\s*(\d{{1,2}}){NTH}{TAIL}"
MONTH_DAY = rf"(?i)\b({MONTH})\s+(\d{{1,2}}){NTH}{TAIL}"
DAY_MONTH = rf"(?i)\b(\d{{1,2}}){NTH}\s+({MONTH}){TAIL}"
TIME_RANGE = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*(?:-|to|–|and)\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\b"
TIME_AMPM = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
TIME_24H = r"\b([01]?\d|2[0-3]):([0-5]\d)\b"


def _matches(c: Column, pattern: str, groups: int, form) -> Column:
    """form(group, ...) for each match of the pattern."""
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: form(*[F.regexp_extract(m, pattern, k + 1) for k in range(groups)]))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("int").cast("string"), 2, "0")


def answer_dates(c: Column | str) -> Column:
    """Date tokens YYYYMMDD, or MMDD without a year, and ranges of them; each once."""
    c = blank(c)
    year = lambda y: F.when(y == "", F.lit("")).otherwise(F.lpad(y, 4, "0"))
    month = lambda m: F.lpad(month_number(m).cast("string"), 2, "0")
    numeric = lambda y, m, d: F.concat(year(y), _two(m), _two(d))
    span = _matches(c, MONTH_DAYS, 4, lambda m, a, b, y: F.concat(year(y), month(m), _two(a), F.lit("-"), year(y), month(m), _two(b)))
    rest = F.regexp_replace(c, MONTH_DAYS, " ")
    return F.array_distinct(
        F.concat(
            _matches(c, ANSWER_ISO, 3, numeric),
            _matches(c, COMPACT, 3, numeric),
            span,
            _matches(rest, MONTH_DAY, 3, lambda m, d, y: F.concat(year(y), month(m), _two(d))),
            _matches(rest, DAY_MONTH, 3, lambda d, m, y: F.concat(year(y), month(m), _two(d))),
        )
    )


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    h = hour.cast("int")
    h = F.when(half == "", h).otherwise(F.when(h == 12, 0).otherwise(h) + F.when(F.lower(half) == "pm", 12).otherwise(0))
    return F.concat(_two(h), F.lit(":"), F.when(minute == "", F.lit("00")).otherwise(F.lpad(minute, 2, "0")))


def answer_times(c: Column | str) -> Column:
    """Time tokens HH:MM and ranges of them; each once."""
    c = F.lower(blank(c))
    for word, time in (("noon", "12:00"), ("midday", "12:00"), ("midnight", "00:00"), ("a.m.", "am"), ("p.m.", "pm"), ("a. m.", "am"), ("p. m.", "pm")):
        c = F.replace(c, F.lit(word), F.lit(time))

    def span(h1, m1, p1, h2, m2, p2):
        p1 = F.when((p1 == "") & (p2 != ""), p2).otherwise(p1)
        return F.concat(_clock(h1, m1, p1), F.lit("-"), _clock(h2, m2, p2))

    rest = F.regexp_replace(c, TIME_RANGE, " ")
    return F.array_distinct(
        F.concat(_matches(c, TIME_RANGE, 6, span), _matches(rest, TIME_24H, 2, lambda h, m: _clock(h, m, F.lit(""))), _matches(rest, TIME_AMPM, 3, _clock))
    )


def without_dates(c: Column | str) -> Column:
    """The text without its dates and times."""
    c = blank(c)
    for pattern in (ANSWER_ISO, COMPACT, MONTH_DAYS, MONTH_DAY, DAY_MONTH, TIME_RANGE, TIME_24H, TIME_AMPM, r"noon|midday|midnight|a\. ?m\.|p\. ?m\."):
        c = F.regexp_replace(c, pattern, " ")
    return c


def reference_date(question: Column | str) -> Column:
    """The first full date of a question."""
    full = F.filter(answer_dates(question), lambda d: F.length(d) == 8)
    return F.try_to_timestamp(F.try_element_at(full, F.lit(1)), F.lit("yyyyMMdd")).cast("date")


def resolve_relative(c: Column | str, reference: Column) -> Column:
    """today, tonight, tomorrow and yesterday as `Month DD`, if there is a reference date."""
    c = blank(c)
    out = c
    for word, days in (("today", 0), ("tonight", 0), ("tomorrow", 1), ("yesterday", -1)):
        said = F.date_format(F.date_add(reference, days), "MMMM dd")
        for form in (word.upper(), word.capitalize(), word):
            out = F.replace(out, F.lit(form), said)
    out = F.regexp_replace(out, r"(?i)(today|tonight|tomorrow|yesterday)\s*\([^)]+\)", "$1")
    return F.when(reference.isNull(), c).otherwise(out)


def _same_day(a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 4) | (F.length(b) == 4), F.right(a, F.lit(4)) == F.right(b, F.lit(4))).otherwise(a == b)


def same_date(a: Column, b: Column) -> Column:
    """Whether two date tokens agree; a token without a year agrees with any year."""
    spans = a.contains("-")
    first, last = lambda x: F.substring_index(x, "-", 1), lambda x: F.substring_index(x, "-", -1)
    return F.when(spans, b.contains("-") & _same_day(first(a), first(b)) & _same_day(last(a), last(b))).otherwise(~b.contains("-") & _same_day(a, b))


def dates_match(truth: Column, prediction: Column) -> Column:
    """Whether each date of the truth finds one of the prediction that no other has taken; the first that fits is taken."""

    def take(left: Column, token: Column) -> Column:
        hits = F.transform(left, lambda p: same_date(token, p))
        at = F.array_position(hits, F.lit(True)).cast("int")
        kept = F.filter(left, lambda _, i: i != at - 1)
        return F.when(left.isNull() | (at == 0), F.lit(None)).otherwise(kept)

    return F.aggregate(truth, prediction, take).isNotNull()


def duration_text(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = seconds.cast("long")
    h, m, r = (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))
