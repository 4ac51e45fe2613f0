"""Rates, ratios, lenient numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import _col, trimmed


def rate_0_1(x: Column | str) -> Column:
    """A share on one of three scales as 0 to 1: up to 1 as it is, up to 100 in percent, up to 10000 in hundredths of a percent."""
    v = _col(x).try_cast("double")
    return F.when(v <= 1, v).when(v <= 100, v / 100).when(v <= 10000, v / 10000).otherwise(v)


def percent(x: Column | str) -> Column:
    """Shares up to 1 scaled by 100, others as they are."""
    v = _col(x).cast("double")
    return F.when(v <= 1.0, v * 100).otherwise(v)


def ratio(x: Column | str) -> Column:
    """struct(a, b, rate) of a text like `30 / 45 (67%)`; the rate is the percentage where given, else a / b, else 0."""
    text = trimmed(x)
    a = F.coalesce(F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", 1).try_cast("int"), F.lit(0))
    b = F.coalesce(F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", 2).try_cast("int"), F.lit(0))
    shown = F.regexp_extract(text, r"\(\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*\)", 1).try_cast("double")
    return F.struct(a.alias("a"), b.alias("b"), F.when(shown.isNotNull(), shown / 100).when(b > 0, a / b).otherwise(F.lit(0.0)).alias("rate"))


def coverage_text(count: Column, total: Column) -> Column:
    """`30 / 45 (67%)` with a whole percentage; `-` where there is nothing to cover."""
    return F.when(total > 0, F.concat(count.cast("string"), F.lit(" / "), total.cast("string"), F.lit(" ("), F.floor(100 * count / total).cast("string"), F.lit("%)"))).otherwise(F.lit("-"))


def lenient_int(x: Column | str, default: int = 0) -> Column:
    """The first signed whole number of a text."""
    return F.coalesce(F.regexp_extract(trimmed(x), r"-?\d+", 0).try_cast("long"), F.lit(default))


def lenient_double(x: Column | str) -> Column:
    """A number with thousands commas and a percent sign removed; null where that is none."""
    return F.regexp_replace(trimmed(x), "[,%]", "").try_cast("double")


def hhmmss(x: Column | str) -> Column:
    """Seconds of h:m or h:m:s; anything else is 0."""
    text = trimmed(x)
    pattern = r"^(\d+)\s*:\s*(\d+)\s*(?::\s*(\d+))?$"
    part = lambda k: F.coalesce(F.regexp_extract(text, pattern, k).try_cast("long"), F.lit(0))
    return part(1) * 3600 + part(2) * 60 + part(3)


def levels(value: Column | str, bounds: list[float]) -> Column:
    """How many of the ascending bounds a value reaches."""
    v = _col(value).try_cast("double")
    level = F.lit(0)
    for bound in bounds:
        level = level + F.when(v >= bound, 1).otherwise(0)
    return level


#: Bounds of the warning levels.
METRIC_BOUNDS = {"V(G)": [11, 21, 31], "LEVEL": [6, 11], "CALLING": [6, 11], "CALLS": [8, 13]}


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; the shorter array counts as padded with zeros."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 for null, empty or zero vectors."""
    x, y = _col(a), _col(b)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.coalesce(F.when(norms > 0, dot(x, y) / norms), F.lit(0.0))


def vector_text(x: Column | str) -> Column:
    """A vector as text with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(x), lambda v: F.format_string("%.6f", v.cast("double"))), ","), F.lit("]"))


#: Ranks of safety levels and weights of kinds of change.
LEVEL_RANK = {"QM": 0, "A": 1, "B": 2, "C": 3, "D": 4}
CHANGE_WEIGHT = {"SIGNATURE": 4, "NEW": 3, "DELETE": 3, "BODY": 2, "VARIABLE": 2, "HEADER": 1}


def mapped(x: Column | str, values: dict, default) -> Column:
    chain = F
    for key, value in values.items():
        chain = chain.when(_col(x) == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def risk_score(max_rank: Column, mean_weight: Column, n: Column) -> Column:
    return F.floor(max_rank * 10 + F.least(mean_weight * 7.5, F.lit(30.0)) + F.least(n * 3, F.lit(30))).cast("int")


def risk_grade(score: Column, max_rank: Column, escalated: Column) -> Column:
    return (
        F.when((score >= 70) | (escalated & (max_rank >= 3)), F.lit("CRITICAL"))
        .when((score >= 50) | escalated, F.lit("HIGH"))
        .when(score >= 25, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
