"""Coverage and compliance reports: key figures, worst modules, rules and files, report summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import numbers, text
from tracelake.functions.text import _col
from tracelake.sources import html


def full_report(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The row ALL (else the first) of a report's status table as ratios and seconds: keys, build, testcases, expected,
    statements, branches, functions, function_calls, execute_seconds, build_seconds."""
    rows = html.table_rows(pages, keys, column, ["TESTCASES"])
    cell = lambda n: F.element_at("cells", n)
    name = F.upper(F.trim(F.coalesce(cell("NAME"), F.get(F.map_values("cells"), F.lit(0)))))
    first = rows.groupBy(*keys).agg(F.min_by("cells", F.struct((name != "ALL").alias("other"), "row")).alias("cells"))
    ratios = [numbers.ratio(cell(n)).alias(n.lower().replace(" ", "_")) for n in ("TESTCASES", "EXPECTED", "STATEMENTS", "BRANCHES", "FUNCTIONS", "FUNCTION CALLS")]
    return first.select(*keys, F.coalesce(cell("BUILD"), F.lit("")).alias("build"), *ratios, numbers.hhmmss(cell("EXECUTE TIME")).alias("execute_seconds"), numbers.hhmmss(cell("BUILD TIME")).alias("build_seconds"))


def metric_percentages(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean and number of the percentages in cells whose class has `col_metric`."""
    cells = F.regexp_extract_all(_col(column), F.lit(r"(?is)<td\b[^>]*\bclass\s*=\s*[\"'][^\"']*col_metric[^\"']*[\"'][^>]*>(.*?)</td>"), F.lit(1))
    values = pages.select(*keys, F.explode(cells).alias("c")).select(*keys, F.regexp_extract(html.inner_text("c"), r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double").alias("v")).filter("v is not null")
    return values.groupBy(*keys).agg(F.bround(F.avg("v"), 2).alias("avg_pct"), F.count(F.lit(1)).alias("samples"))


def module_coverage(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Modules of aggregate reports: keys, module, covered and total lines and branches."""
    parts = F.split(_col(column), r"Code Coverage for\s+")
    each = pages.select(*keys, F.posexplode(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))).alias("ordinal", "part"))
    n = lambda what, k: F.regexp_extract("part", rf"(\d+)\s+of\s+(\d+)\s+{what} Covered", k).try_cast("long")
    out = each.select(*keys, "ordinal", html.inner_text(F.regexp_extract("part", r"^([^<\n]+)", 1)).alias("module"), n("Lines", 1).alias("line_covered"), n("Lines", 2).alias("line_total"), n("Branches", 1).alias("branch_covered"), n("Branches", 2).alias("branch_total"))
    return out.filter("line_total is not null or branch_total is not null")


def worst_modules(modules: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """The modules of least line rate (percent; none counts as 0), ties in order."""
    rate = F.when(F.col("line_total") > 0, F.bround(100.0 * F.col("line_covered") / F.col("line_total"), 2))
    w = Window.partitionBy(*keys).orderBy(F.coalesce("line_rate", F.lit(0.0)), "ordinal")
    return modules.withColumn("line_rate", rate).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def coverage_totals(modules: DataFrame, keys: list[str]) -> DataFrame:
    """Line and branch rates (percent) over all modules."""
    rate = lambda a, b: F.when(F.sum(b) > 0, F.bround(100.0 * F.sum(a) / F.sum(b), 2))
    return modules.groupBy(*keys).agg(rate("line_covered", "line_total").alias("line_rate"), rate("branch_covered", "branch_total").alias("branch_rate"))


def column_totals(rows: DataFrame, keys: list[str], label: str, n: int = 6) -> DataFrame:
    """Sums of every column of a wide count table (cells) but the label's, the largest `n`: keys, rule, count."""
    each = rows.select(*keys, F.explode("cells").alias("rule", "value")).filter(F.col("rule") != label.upper())
    sums = each.groupBy(*keys, "rule").agg(F.sum(F.coalesce(numbers.lenient_double("value"), F.lit(0.0))).alias("count"))
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), "rule")
    return sums.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


def remapped(path: Column | str, rules: list[tuple[str, str]], job: str) -> Column:
    """A path with the first fitting prefix replaced; `{job}` in a rule stands for the job's name."""
    chain, p = F, _col(path)
    for old, new in rules:
        old, new = old.replace("{job}", job), new.replace("{job}", job)
        chain = chain.when(p.startswith(old), F.concat(F.lit(new), F.substr(p, F.lit(len(old) + 1))))
    return chain.otherwise(p) if rules else p


def report_index(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Reports of a listing with kind, group and the timestamp of their folder."""
    from tracelake.functions.dates import folder_timestamp

    return files.withColumns({"kind": text.report_type(path), "group": text.report_group(path), "built": folder_timestamp(path)})


def scan_summary(files: DataFrame) -> DataFrame:
    """Files (rel_path, ext, size, text) by extension: number, bytes and the sums of their key words' counts."""
    return files.withColumn("kpi", text.kpis("text")).groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), *[F.sum(f"kpi.{k}").alias(k) for k in text.KPI_WORDS])


def top_scanned(files: DataFrame, n: int) -> DataFrame:
    """Files (rel_path, text) with the most failures, errors and warnings."""
    score = 3 * F.col("kpi.fail") + 2 * F.col("kpi.error") + F.col("kpi.warn")
    return files.withColumn("kpi", text.kpis("text")).select("rel_path", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "rel_path").limit(n)


def environment_files(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Files of environment reports (rows whose first cell is of class i0): keys, row, file, statements, branches."""
    rows = F.regexp_extract_all(_col(column), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    each = pages.select(*keys, F.posexplode(rows).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), html.inner_text)
    each = each.select(*keys, "row", "r", cells.alias("cells"))
    heads = each.filter(F.array_contains(F.transform("cells", lambda c: F.upper(c)), "FILE / ENVIRONMENT")).groupBy(*keys).agg(F.min_by(F.transform("cells", lambda c: F.upper(c)), F.col("row")).alias("headers"))
    files = each.filter(F.col("r").rlike(r"(?is)^\s*<td\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?i0(?:\s[^\"']*)?[\"']") & (F.get("cells", F.lit(0)) != ""))
    cell = lambda name: numbers.ratio(F.get("cells", F.array_position("headers", name).cast("int") - 1))
    return files.join(heads, keys).select(*keys, "row", F.get("cells", F.lit(0)).alias("file"), cell("STATEMENTS").alias("statements"), cell("BRANCHES").alias("branches"))


def worst_files(files: DataFrame, keys: list[str], what: str, n: int = 15) -> DataFrame:
    """The files of least rate of `what` (statements or branches), ties in order."""
    w = Window.partitionBy(*keys).orderBy(f"{what}.rate", "row")
    return files.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def sections(pages: DataFrame, keys: list[str], column: str, level: int = 2) -> DataFrame:
    """keys, ordinal, heading, body (HTML) of each section below headings of one level."""
    parts = F.split(_col(column), rf"(?i)<h{level}\b[^>]*>")
    each = pages.select(*keys, F.posexplode(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))).alias("ordinal", "part"))
    return each.select(*keys, "ordinal", html.inner_text(F.regexp_extract("part", rf"(?is)^(.*?)</h{level}>", 1)).alias("heading"), F.regexp_replace("part", rf"(?is)^.*?</h{level}>", "").alias("body"))


def test_cases(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Key and value pairs of each test case section: keys, testcase, key, value; and its code blocks under `code:<heading>`."""
    cases = sections(pages, keys, column, 2).filter(F.lower("heading").contains("test"))
    pairs = html.key_values(cases, [*keys, "ordinal", "heading"], "body").select(*keys, "ordinal", F.col("heading").alias("testcase"), "key", "value")
    blocks = cases.select(*keys, "ordinal", F.col("heading").alias("testcase"), F.explode(F.regexp_extract_all("body", F.lit(r"(?is)(<h4\b[^>]*>.*?</h4>\s*<pre\b[^>]*>.*?</pre>)"), F.lit(1))).alias("b"))
    code = blocks.select(*keys, "ordinal", "testcase", F.concat(F.lit("code:"), html.inner_text(F.regexp_extract("b", r"(?is)<h4\b[^>]*>(.*?)</h4>", 1))).alias("key"), html.inner_text(F.regexp_extract("b", r"(?is)<pre\b[^>]*>(.*?)</pre>", 1)).alias("value"))
    return pairs.unionByName(code)
