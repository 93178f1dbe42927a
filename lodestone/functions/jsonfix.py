"""Tolerant JSON as column expressions: fences, surrounding prose, and the damage that small models do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import clamp
from .text import let, strip, text_of


def unfenced(c: Column) -> Column:
    return strip(F.regexp_replace(strip(text_of(c)), r"(?s)```(?:json)?\s*(.*?)```", "$1"))


def repaired(c: Column) -> Column:
    """Trailing commas, curly quotes, Python's constants, line comments and line feeds."""
    # What is repaired, in this order.
    steps = [(r",\s*([\]}])", "$1"), ("[“”]", '"'), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null"), (r'//[^\n"]*', ""), (r"\s*\n\s*", " ")]
    for bad, good in steps:
        c = F.regexp_replace(c, bad, good)
    return c


def _within(c: Column, opens: str, closes: str) -> Column:
    start = F.instr(c, opens)
    end = F.length(c) - F.instr(F.reverse(c), closes) + 1
    return F.when((start > 0) & (end > start), F.substring(c, start, end - start + 1))


def _valid(c: Column) -> Column:
    return F.when(F.try_parse_json(c).isNotNull(), c)


def json_text(c: Column) -> Column:
    """The first of these that is valid JSON, else null: the text, its outermost object, that repaired, the same for an array."""

    def tries(t: Column) -> Column:
        part = lambda ends: let(_within(t, *ends), lambda p: F.coalesce(_valid(p), let(repaired(p), _valid)))
        return F.coalesce(_valid(t), part("{}"), part("[]"))

    return let(unfenced(c), tries)


def _text(v: Column, path: str, n: int) -> Column:
    return F.left(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")), F.lit(n))


def _list(v: Column, name: str, most: int, width: int) -> Column:
    """A list of texts, or a text as a list of one; blanks dropped before the list is cut."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    many = F.transform(F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None")))
    one = strip(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))
    filled = F.slice(F.transform(F.filter(many, lambda x: strip(x) != ""), lambda x: F.left(x, F.lit(width))), 1, most)
    return F.when(kind.startswith("ARRAY"), filled).when((kind == "STRING") & (one != ""), F.array(F.left(one, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def judged(reply: Column) -> Column:
    """A judge's reply as a struct; ``score`` null and ``error`` set if it has no usable score. Repaired and parsed once."""
    return let(json_text(reply), lambda raw: let(F.try_parse_json(raw), lambda v: _judgement(raw, v)))


def _judgement(raw: Column, v: Column) -> Column:
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    number = r"^\s*\d+\s*$"
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.score", "variant")), F.lit(""))
    as_text = F.try_variant_get(v, "$.score", "string")
    score = F.when((kind == "STRING") & ~as_text.rlike(number), None).when(kind == "BOOLEAN", F.try_variant_get(v, "$.score", "boolean").cast("double")).otherwise(F.trim(as_text).try_cast("double"))
    score = F.when(is_object, clamp(score))
    confidence = F.coalesce(F.try_variant_get(v, "$.confidence", "string").try_cast("double"), F.lit(0.0))
    years_kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.years_relevant", "variant")), F.lit(""))
    years = F.when(years_kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$.years_relevant", "double"))
    said = F.lower(strip(_text(v, "$.recommendation", 900)))
    first = F.when(raw.isNull(), "could not parse JSON").when(~is_object, "unexpected JSON type").when(score.isNull(), "no 'score' field in model output")
    return F.struct(
        score.alias("score"), F.when(is_object, clamp(confidence, 0.0, 1.0)).otherwise(0.0).alias("confidence"), F.when(is_object, years).alias("years_relevant"),
        F.when(is_object, _text(v, "$.seniority", 32)).otherwise("").alias("seniority"), _list(v, "strengths", 5, 220).alias("strengths"), _list(v, "gaps", 5, 220).alias("gaps"),
        F.when(is_object, F.left(strip(_text(v, "$.reasoning", 100000)), F.lit(900))).otherwise("").alias("reasoning"),
        F.when(is_object & said.isin("strong_fit", "moderate_fit", "weak_fit"), said).otherwise("").alias("recommendation"), first.alias("error"),
    )
