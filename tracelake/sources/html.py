"""HTML reports as rows, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import numbers
from tracelake.functions.text import _col, without_tags


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, html: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def _entities(x: Column) -> Column:
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(code), F.lit(char))
    return x


def inner_text(x: Column | str) -> Column:
    """Text between tags with the common entities resolved."""
    return F.trim(_entities(without_tags(x)))


def title(html: Column | str) -> Column:
    return inner_text(F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column | str, most: int = 20) -> Column:
    """Texts of the first h1 and h2 elements."""
    return F.slice(F.transform(F.regexp_extract_all(_col(html), F.lit(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), F.lit(1)), inner_text), 1, most)


def links(html: Column | str) -> Column:
    """Targets of all links in order."""
    return F.regexp_extract_all(_col(html), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def tables(html: Column | str) -> Column:
    """array(table) of array(row) of array(cell text); nested tables are not told apart."""
    found = F.regexp_extract_all(_col(html), F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))
    rows = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), inner_text)
    return F.transform(found, lambda t: F.transform(rows(t), cells))


def key_values(html: DataFrame, keys: list[str], column: str, most_tables: int = 10, most_keys: int = 50) -> DataFrame:
    """First two cells of each row of the first tables as key and value; a key's first value stays: keys, table, key, value."""
    each = html.select(*keys, F.posexplode(F.slice(tables(column), 1, most_tables)).alias("table", "rows")).select(*keys, "table", F.posexplode("rows").alias("row", "cells"))
    pairs = each.filter(F.size("cells") >= 2).select(*keys, "table", "row", F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("value")).filter("key <> ''")
    first = pairs.groupBy(*keys, "table", "key").agg(F.min(F.struct("row", "value")).alias("b"))
    w = Window.partitionBy(*keys, "table").orderBy("b.row")
    return first.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most_keys).select(*keys, "table", "key", F.col("b.value").alias("value"))


def table_rows(html: DataFrame, keys: list[str], column: str, required: list[str] | None = None) -> DataFrame:
    """Rows of every table below its header row, or of the first table whose headers include all `required`:
    keys, table, row (from 1), cells as map(header -> text), headers upper-cased."""
    each = html.select(*keys, F.posexplode(tables(column)).alias("table", "rows")).filter(F.size("rows") > 1)
    each = each.withColumn("headers", F.transform(F.get("rows", F.lit(0)), lambda h: F.upper(F.trim(h))))
    if required:
        wanted = F.array(*[F.lit(r.upper()) for r in required])
        each = each.filter(F.size(F.array_except(wanted, "headers")) == 0)
        each = each.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("table"))).filter("_place = 1").drop("_place")
    rows = each.select(*keys, "table", "headers", F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("r", "cells"))
    # A header that comes twice keeps its first column.
    spots = F.filter(F.sequence(F.lit(0), F.size("headers") - 1), lambda i: (F.array_position("headers", F.get("headers", i)) == i + 1))
    cells = F.map_from_entries(F.transform(spots, lambda i: F.struct(F.get("headers", i).alias("h"), F.coalesce(F.get("cells", i), F.lit("")).alias("v"))))
    return rows.select(*keys, "table", (F.col("r") + 1).alias("row"), cells.alias("cells"))


def coverage_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage table rows: keys, row, unit (filled forward), subprogram, kind (detail, total, grand_total), ccn, statements, branches."""
    cell = lambda name: F.coalesce(F.element_at("cells", name), F.lit(""))
    w = Window.partitionBy(*keys, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    unit = F.last(F.nullif(cell("UNIT"), F.lit("")), ignorenulls=True).over(w)
    part = cell("SUBPROGRAM")
    kind = F.when(F.upper(cell("UNIT")).contains("GRAND TOTALS"), F.lit("grand_total")).when(F.upper(part).contains("TOTALS") | F.upper(cell("UNIT")).contains("TOTALS"), F.lit("total")).otherwise(F.lit("detail"))
    return rows.select(*keys, "row", unit.alias("unit"), part.alias("subprogram"), kind.alias("kind"), cell("COMPLEXITY").try_cast("int").alias("ccn"), numbers.ratio(cell("STATEMENTS")).alias("statements"), numbers.ratio(cell("BRANCHES")).alias("branches"))


def metric_rows(html: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Metric reports with an h3 a file, an h4 a function and a two-row table of codes and values:
    keys, file, function, metric, value."""
    parts = html.select(*keys, F.posexplode(F.slice(F.split(_col(column), r"(?i)<h3\b[^>]*>"), 2, 100_000)).alias("f", "file_part"))
    parts = parts.select(*keys, "f", inner_text(F.regexp_extract("file_part", r"(?is)^(.*?)</h3>", 1)).alias("file"), F.posexplode(F.slice(F.split("file_part", r"(?i)<h4\b[^>]*>"), 2, 100_000)).alias("g", "part"))
    parts = parts.select(*keys, "file", inner_text(F.regexp_extract("part", r"(?is)^(.*?)</h4>", 1)).alias("function"), F.get(tables("part"), F.lit(0)).alias("t")).filter(F.size("t") >= 2)
    pairs = F.arrays_zip(F.get("t", F.lit(0)).alias("metric"), F.get("t", F.lit(1)).alias("value"))
    return parts.select(*keys, "file", "function", F.inline(pairs)).filter("metric is not null and metric <> ''")
