"""Numbers, amounts and codes in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, number_words

NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
ANY_NUMBER = r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"
AMOUNT_BEFORE = r"[£$€]\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"
AMOUNT_AFTER = r"(?i)(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:USD|GBP|EUR|AUD|JOD|dollars?|pounds?|euros?)\b"
#: The currency that a sign, a word or a code stands for.
CURRENCIES = {"GBP": r"£|\bgbp\b|\bpounds?\b", "USD": r"\$|\busd\b|\bdollars?\b", "EUR": r"€|\beur\b|\beuros?\b", "AUD": r"\baud\b", "JOD": r"\bjod\b"}


def _decimals(found: Column) -> Column:
    values = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(38,10)"))
    return F.filter(values, lambda x: x.isNotNull())


def amounts(c: Column | str, fixed_numbers: bool = False) -> Column:
    """Amounts with a currency sign before or a currency after, each once.

    Only up to three digits before a comma count, so `$1250` has the amount 125; `fixed_numbers` counts all.
    """
    c = F.regexp_replace(number_words(blank(c)), r"(\d),(\d)", "$1$2")
    wide = lambda p: p.replace(r"\d{1,3}", r"\d+") if fixed_numbers else p
    found = [F.regexp_extract_all(c, F.lit(wide(p)), F.lit(1)) for p in (AMOUNT_BEFORE, AMOUNT_AFTER)]
    return F.array_distinct(_decimals(F.concat(*found)))


def numbers(c: Column | str, fixed_numbers: bool = False) -> Column:
    """Numbers in the order of the text. A run of four digits or more is none, unless `fixed_numbers`."""
    return _decimals(F.regexp_extract_all(number_words(blank(c)), F.lit(ANY_NUMBER if fixed_numbers else NUMBER), F.lit(0)))


def currencies(c: Column | str) -> Column:
    """The codes of the currencies that a text names, sorted."""
    c = F.lower(blank(c))
    named = F.array(*[F.when(c.rlike(p), code) for code, p in CURRENCIES.items()])
    return F.array_sort(F.filter(named, lambda x: x.isNotNull()))


def codes(c: Column | str) -> Column:
    """Upper-case tokens of four or more letters and digits that have both; no ordinals; each once."""
    found = F.transform(F.regexp_extract_all(blank(c), F.lit(r"(?i)\b[A-Z0-9]{4,}\b"), F.lit(0)), F.upper)
    mixed = F.filter(found, lambda x: x.rlike("[A-Z]") & x.rlike("[0-9]") & ~x.rlike("^[0-9]{1,2}(ST|ND|RD|TH)$"))
    return F.array_distinct(mixed)


def same_bag(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)
