"""Row filters: path prefixes, globs, names and text lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import _col


def under(path: Column | str, prefix: str) -> Column:
    p = _col(path)
    return (p == prefix) | p.startswith(prefix + "/")


def path_filter(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    """A path under an included prefix (none: all) and under no excluded one."""
    any_of = lambda prefixes: reduce(lambda a, b: a | b, [under(path, p) for p in prefixes])
    wanted = any_of(include) if include else F.lit(True)
    return wanted & ~any_of(exclude) if exclude else wanted


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole text."""
    out = ""
    for c in pattern:
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
    return f"(?s)^{out}$"


def any_glob(path: Column | str, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_col(path).rlike(glob_regex(p)) for p in patterns]) if patterns else F.lit(False)


def view_page(rows: DataFrame, equal: dict[str, str], query: str, columns: list[str], order: list[str], number: int, size: int) -> DataFrame:
    """Rows with equal values (`all` passes) and a text anywhere in the joined columns, one page with the total."""
    from tracelake.operators.history import page

    kept = rows
    for column, value in equal.items():
        if value and value.lower() != "all":
            kept = kept.filter(F.col(column) == value)
    if query:
        kept = kept.filter(F.lower(F.concat_ws(" ", *columns)).contains(query.lower()))
    return page(kept, [F.col(o) for o in order], number, size)


def among(rows: DataFrame, name: str, names: DataFrame, wanted: str) -> DataFrame:
    """Rows whose name is among the wanted ones, whatever the case."""
    keys = names.select(F.lower(wanted).alias("wanted_key")).distinct()
    return rows.join(keys, F.lower(rows[name]) == F.col("wanted_key"), "left_semi")


def first_of_pair(rows: DataFrame, file: str, function: str, order: str) -> DataFrame:
    """Trimmed rows without blanks and TOTALS, the first of each (file, function)."""
    clean = rows.withColumns({c: F.trim(c) for c in (file, function)})
    clean = clean.filter((F.col(file) != "") & (F.col(function) != "") & ~F.upper(F.col(function)).contains("TOTALS") & ~F.upper(F.col(file)).contains("TOTALS"))
    w = Window.partitionBy(file, function).orderBy(order)
    return clean.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def line_hits(lines: DataFrame, query: str, regex: bool = False, match_case: bool = False, most: int | None = None, order: tuple[str, ...] = ("path", "line_no")) -> DataFrame:
    """Lines (path, line_no, text) that hold a text or match an expression, capped in file order."""
    subject = F.col("text") if match_case else F.lower("text")
    needle = query if match_case else query.lower()
    hits = lines.filter(F.col("text").rlike(query if match_case else f"(?i){query}") if regex else subject.contains(needle))
    return hits.orderBy(*order).limit(most) if most else hits


def phrase_or_tokens(lines: DataFrame, query: str, most: int, order: tuple[str, ...] = ("path", "line_no")) -> DataFrame:
    """Lines that hold the phrase or, each on its own, any of its words."""
    text = F.lower("text")
    words = [w for w in re.findall(r"\w{2,}", query.lower())]
    holds = reduce(lambda a, b: a | b, [text.contains(w) for w in words], text.contains(query.lower()))
    return lines.filter(holds).orderBy(*order).limit(most)


def warnings_only(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """Findings that are warnings, errors or style remarks."""
    return findings.filter(F.lower(severity).isin("warning", "warn", "error", "style", "performance", "portability"))


def auto_deviations(findings: DataFrame, known: DataFrame, catalog: DataFrame, author: str, status: str) -> DataFrame:
    """Deviation records for findings that have none yet, with the rule's text; reason tells why others are skipped."""
    keys = ["tool", "file", "line", "id"]
    seen = known.select(*keys, F.lit(True).alias("known")).distinct()
    rules = catalog.select(F.col("rule").alias("id"), "description")
    joined = findings.join(seen, keys, "left").join(rules, "id", "left")
    reason = F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("no_rule")).when(F.col("known"), F.lit("exists")).otherwise(F.lit("created"))
    return joined.select(*keys, F.coalesce("description", "message").alias("text"), F.lit(author).alias("author"), F.lit(status).alias("status"), reason.alias("reason"))


#: Path segments that a change report leaves out.
IGNORED_SEGMENTS = [".git", "__pycache__", "node_modules", ".venv", "dist", "build", ".pytest_cache"]


def relevant(path: Column | str, ignored: list[str] | None = None) -> Column:
    segments = F.split(_col(path), "/")
    return F.size(F.array_intersect(segments, F.array(*[F.lit(s) for s in (ignored or IGNORED_SEGMENTS)]))) == 0
