"""Functions on JSON and on the free text that models wrap it in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank


def without_thoughts(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(blank(c), r"(?s)<think>.*?</think>", ""))


def greedy_object(c: Column | str) -> Column:
    """From the first to the last brace, without thoughts; empty if there is none."""
    return F.regexp_extract(without_thoughts(c), r"(?s)\{.*\}", 0)


def without_fence(c: Column | str) -> Column:
    """The inside of the first code fence, or the text itself."""
    inside = F.regexp_extract(blank(c), r"(?s)```[A-Za-z]*\s*(.*?)```", 1)
    return F.trim(F.when(inside != "", inside).otherwise(blank(c)))


def _first_object(text: str | None) -> str | None:
    start = (text or "").find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for at in range(start, len(text)):
            c = text[at]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return text[start : at + 1]
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def balanced_object(texts: pd.Series) -> pd.Series:
    """The first balanced JSON object of dirty text. Counting braces is beyond regular expressions."""
    return texts.map(_first_object)


def support(c: Column | str) -> Column:
    """A critic's support: fully, partially or none."""
    low = F.lower(blank(c))
    return F.when(low.contains("full"), "fully").when(low.contains("part"), "partially").otherwise("none")


def utility(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(1)), F.lit(1)), F.lit(5))


def judged(raw: Column | str) -> Column:
    """A judge's verdict: its JSON if it has one, else words of assent; so `incorrect` counts as assent."""
    raw = blank(raw)
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "accuracy boolean")["accuracy"]
    low = F.lower(raw)
    said = F.when(low.rlike(r'"accuracy": ?true'), True).when(low.rlike(r'"accuracy": ?false'), False)
    return F.coalesce(parsed, said, low.rlike("accurate|correct|matches|true|yes"))


def router_weights(c: Column | str, default: dict[str, float], most_vision: float = 0.4) -> Column:
    """Weights m, s, d, v of a router's reply: none below 0, vision at most 0.4, of sum 1; else the default."""
    got = F.from_json(greedy_object(c), "m double, s double, d double, v double")
    parts = {k: F.greatest(F.coalesce(got[k], F.lit(0.0)), F.lit(0.0)) for k in "msd"}
    parts["v"] = F.least(F.greatest(F.coalesce(got["v"], F.lit(0.0)), F.lit(0.0)), F.lit(most_vision))
    total = parts["m"] + parts["s"] + parts["d"] + parts["v"]
    chosen = F.struct(*[F.try_divide(parts[k], total).alias(k) for k in "msdv"])
    return F.when(total > 0, chosen).otherwise(F.struct(*[F.lit(float(default[k])).alias(k) for k in "msdv"]))


def token_field(usage: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds a whole number of at least 0."""
    found = [F.get_json_object(usage, p) for p in paths]
    whole = [F.when(x.rlike(r"^\d+(\.0+)?$"), x.try_cast("double").try_cast("bigint")) for x in found]
    return F.coalesce(*whole)


def canonical_usage(usage: Column) -> Column:
    """Token counts of a usage record whatever names it uses."""
    uncached = token_field(usage, "$.input_tokens", "$.prompt_tokens", "$.inputTokens", "$.promptTokens", "$.input")
    created = token_field(usage, "$.cache_creation_input_tokens", "$.cacheCreationInputTokens", "$.cache_creation")
    read = token_field(usage, "$.cache_read_input_tokens", "$.cacheReadInputTokens", "$.cached_tokens", "$.prompt_tokens_details.cached_tokens", "$.cache_read")
    output = token_field(usage, "$.output_tokens", "$.completion_tokens", "$.outputTokens", "$.completionTokens", "$.output")
    nothing = uncached.isNull() & created.isNull() & read.isNull()
    input_ = F.when(~nothing, F.coalesce(uncached, F.lit(0)) + F.coalesce(created, F.lit(0)) + F.coalesce(read, F.lit(0)))
    explicit = token_field(usage, "$.total_tokens", "$.totalTokens", "$.total")
    total = F.coalesce(explicit, F.when(input_.isNotNull() | output.isNotNull(), F.coalesce(input_, F.lit(0)) + F.coalesce(output, F.lit(0))))
    cost = F.get_json_object(usage, "$.cost").try_cast("double")
    return F.struct(
        input_.alias("input"), output.alias("output"), total.alias("total"), read.alias("cache_read"), created.alias("cache_creation"), uncached.alias("uncached"), cost.alias("cost")
    )


def usage_objects(value: object) -> Iterator[dict]:
    """All dicts under a key `usage` in nested JSON values."""
    if isinstance(value, dict):
        for key, inner in value.items():
            if key == "usage" and isinstance(inner, dict):
                yield inner
            else:
                yield from usage_objects(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from usage_objects(inner)


@F.pandas_udf(T.ArrayType(T.StringType()))
def usages(texts: pd.Series) -> pd.Series:
    """The usage objects of a JSON record at any depth, as JSON. Recursion is beyond fixed paths."""
    import json

    def found(text: str | None) -> list[str]:
        try:
            return [json.dumps(u) for u in usage_objects(json.loads(text or ""))]
        except ValueError:
            return []

    return texts.map(found)
