"""Aggregations: pass rates, gates, fill rates, compliance, scores and levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import numbers, text


def unit_breakdown(tests: DataFrame, unit: str, passed: str) -> DataFrame:
    """unit, passed, failed, total, pass_rate (0 to 1) for each unit; a null result is a failure."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    out = tests.groupBy(F.coalesce(F.col(unit).cast("string"), F.lit("UNKNOWN")).alias("unit")).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("pass_rate", F.col("passed") / F.col("total"))


def result_summary(tests: DataFrame, result: str) -> DataFrame:
    """One row: total, passed, failed, skipped, unknown and pass_rate (0 to 1)."""
    kind = text.result_class(result)
    out = tests.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(kind == k).alias(name) for k, name in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"), ("unknown", "unknown"))])
    return out.withColumn("pass_rate", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(F.lit(0.0)))


def failure_categories(tests: DataFrame, texts: list[str], failed: Column) -> DataFrame:
    """Count of failed rows in each of the five classes, zero where none fell."""
    spark = tests.sparkSession
    found = tests.filter(failed).groupBy(text.failure_class(*texts).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    classes = spark.createDataFrame([(c,) for c in text.FAILURE_CLASSES], "category string")
    return classes.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


#: Gates by safety level: pass rate, line rate, branch rate, new failures.
LEVEL_GATES = {"QM": (95, 70, 60, 5), "A": (97, 80, 70, 2), "B": (99, 90, 85, 0), "C": (99.5, 95, 90, 0), "D": (100, 100, 95, 0)}
DEFAULT_GATES = (99, 90, 85, 0)


def quality_gates(summary: DataFrame, keys: list[str], gates: tuple[float, float, float, float] = DEFAULT_GATES) -> DataFrame:
    """Four gate rows for each row of `summary` (pass_rate, coverage_line, coverage_branch, new_failures):
    keys, gate, actual, threshold, status.

    Values up to 1 are read as shares. The two coverage gates warn from 0.8 of their threshold on.
    A missing value counts as 0.
    """
    shares = [("pass_rate", gates[0], False), ("coverage_line", gates[1], True), ("coverage_branch", gates[2], True)]
    rows = []
    for name, threshold, warns in shares:
        actual = numbers.percent(F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
        low = F.when(actual >= threshold * 0.8, F.lit("warn")).otherwise(F.lit("fail")) if warns else F.lit("fail")
        rows.append(F.struct(F.lit(name).alias("gate"), F.bround(actual, 1).alias("actual"), F.lit(float(threshold)).alias("threshold"), F.when(actual >= threshold, F.lit("pass")).otherwise(low).alias("status")))
    failures = F.coalesce(F.col("new_failures").cast("double"), F.lit(0.0))
    rows.append(F.struct(F.lit("new_failures").alias("gate"), failures.alias("actual"), F.lit(float(gates[3])).alias("threshold"), F.when(failures <= gates[3], F.lit("pass")).otherwise(F.lit("fail")).alias("status")))
    return summary.select(*keys, F.inline(F.array(*rows)))


def overall_gate(gates: DataFrame, keys: list[str]) -> DataFrame:
    """overall_pass: no gate of a key failed."""
    return gates.groupBy(*keys).agg(F.bool_and(F.col("status") != "fail").alias("overall_pass"))


def executive_verdict(summary: DataFrame, keys: list[str]) -> DataFrame:
    """verdict of rows with failed and overall_pass: FAIL where a gate failed, PASS_WITH_ISSUES where tests failed."""
    verdict = F.when(~F.col("overall_pass"), F.lit("FAIL")).when(F.col("failed") > 0, F.lit("PASS_WITH_ISSUES")).otherwise(F.lit("PASS"))
    return summary.select(*keys, verdict.alias("verdict"))


def code_metrics(rows: DataFrame, file: str, function: str, nloc: str) -> DataFrame:
    """One row: files, functions (distinct pairs) and nloc, the sum of each pair's largest value."""
    per = rows.groupBy(F.col(file).alias("f"), F.col(function).alias("g")).agg(F.max(F.coalesce(F.col(nloc).cast("double"), F.lit(0.0))).alias("n"))
    return per.agg(F.count_distinct("f").alias("files"), F.count(F.lit(1)).alias("functions"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("nloc"))


def group_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """count, max, mean and linear 95th percentile of a metric for each group.

    Rows are counted by value first; the percentile is read off the running counts, which a window
    sorts and spills, so no buffer holds a group's values.
    """
    v, n = F.col("_v"), F.col("_n")
    counts = rows.select(group, F.col(value).cast("double").alias("_v")).groupBy(group, "_v").agg(F.count("_v").alias("_n"))
    w = Window.partitionBy(group)
    seen, place = F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), (F.sum("_n").over(w) - 1) * 0.95
    at = lambda x: F.min(F.when(F.col("_seen") > x, v))
    out = counts.withColumns({"_seen": seen, "_place": place}).groupBy(group)
    low, high = at(F.floor("_place")), at(F.ceil("_place"))
    share = F.max(F.col("_place") - F.floor("_place"))
    return out.agg(F.sum(n).alias("n"), F.max(v).alias("largest"), (F.sum(v * n) / F.nullif(F.sum(n), F.lit(0))).alias("mean"), (low + (high - low) * share).alias("p95"))


def warning_levels(rows: DataFrame, metric: str, value: str, bounds: dict[str, list[float]] | None = None) -> DataFrame:
    """Number of rows at each warning level of each metric; metrics without bounds are at level 0."""
    level = F.lit(0)
    for name, limits in (bounds or numbers.METRIC_BOUNDS).items():
        level = F.when(F.col(metric) == name, numbers.levels(value, limits)).otherwise(level)
    return rows.groupBy(F.col(metric).alias("metric"), level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def totals(rows: DataFrame, unit: str, part: str, sums: list[str]) -> DataFrame:
    """Detail rows, one total a unit and a grand total: unit, part, kind and the sums."""
    kind = F.when(F.grouping_id() == 0, F.lit("detail")).when(F.grouping_id() == 1, F.lit("total")).otherwise(F.lit("grand_total"))
    return rows.rollup(F.col(unit).alias("unit"), F.col(part).alias("part")).agg(kind.alias("kind"), *[F.sum(s).alias(s) for s in sums])


def coverage_ratios(rows: DataFrame, keys: list[str], covered: str, total: str) -> DataFrame:
    """covered, total, rate and text of each key."""
    out = rows.groupBy(*keys).agg(F.sum(covered).alias("covered"), F.sum(total).alias("total"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(F.lit(0.0))).withColumn("text", numbers.coverage_text(F.col("covered"), F.col("total")))


def fill_rates(rows: DataFrame, checks: dict[str, Column], keys: list[str] | None = None, applies: dict[str, Column] | None = None) -> DataFrame:
    """One row a key and check: check, n, of, rate (percent, one decimal). `applies` narrows a check's base; an empty base gives 0."""
    applies = applies or {}
    parts = []
    for name, holds in checks.items():
        base = F.coalesce(applies.get(name, F.lit(True)), F.lit(False))
        parts += [F.count_if(base & F.coalesce(holds, F.lit(False))).alias(f"n_{name}"), F.count_if(base).alias(f"of_{name}")]
    wide = rows.groupBy(*(keys or [])).agg(*parts)
    row = lambda name: F.struct(F.lit(name).alias("check"), F.col(f"n_{name}").alias("n"), F.col(f"of_{name}").alias("of"), F.when(F.col(f"of_{name}") > 0, F.bround(100.0 * F.col(f"n_{name}") / F.col(f"of_{name}"), 1)).otherwise(F.lit(0.0)).alias("rate"))
    return wide.select(*(keys or []), F.inline(F.array(*[row(name) for name in checks])))


#: Thresholds of the quick gate (percent) and of the field gate (shares).
QUICK_THRESHOLDS = {"called": 95, "calling": 95, "input": 90, "output": 90, "description": 90, "asil": 50, "related": 70}
TRUST_THRESHOLDS = {"description_trusted": 60, "asil_trusted": 40, "related_trusted": 50}
FIELD_THRESHOLDS = {"description": 0.70, "input": 0.20, "output": 0.10, "global": 0.35, "static": 0.15, "called": 0.50, "calling": 0.25, "asil": 0.30, "related": 0.30, "traceability": 0.20}


def threshold_gate(rates: DataFrame, thresholds: dict[str, float], scale: float = 1.0) -> DataFrame:
    """Adds threshold and ok to fill-rate rows; a check without a threshold never fails."""
    limit = numbers.mapped("check", {k: float(v) * scale for k, v in thresholds.items()}, None).cast("double")
    return rates.withColumn("threshold", limit).withColumn("ok", F.coalesce(F.col("rate") >= limit, F.lit(True)))


def compliance(rows: DataFrame, items: dict[str, Column], key: str | None = None) -> DataFrame:
    """Share of rows that hold each checklist item: item, n, of, rate, status (PASS from 95 %, WARN from 70 %)."""
    rates = fill_rates(rows, items, [key] if key else None)
    status = F.when(F.col("rate") >= 95, F.lit("PASS")).when(F.col("rate") >= 70, F.lit("WARN")).otherwise(F.lit("FAIL"))
    return rates.withColumnRenamed("check", "item").withColumn("status", status)


def lowest_compliance(rows: DataFrame, items: dict[str, Column], key: str, n: int = 10) -> DataFrame:
    """The rows with the fewest items held: key, held, score (percent)."""
    held = reduce(lambda a, b: a + b, [F.when(F.coalesce(h, F.lit(False)), 1).otherwise(0) for h in items.values()])
    return rows.select(F.col(key), held.alias("held")).withColumn("score", F.bround(100.0 * F.col("held") / len(items), 1)).orderBy("held", key).limit(n)


#: Trust in a field by where it comes from.
SOURCE_CONFIDENCE = {"comment": 1.00, "sds": 0.95, "srs": 0.95, "reference": 0.90, "ai": 0.85, "rule": 0.75, "inference": 0.60}


def confidence(rows: DataFrame, sources: list[str], keys: list[str]) -> DataFrame:
    """Mean confidence of the fields' sources for each key, and its grade A to D."""
    mean = reduce(lambda a, b: a + b, [numbers.mapped(F.lower(F.col(s)), SOURCE_CONFIDENCE, 0.0) for s in sources]) / len(sources)
    out = rows.groupBy(*keys).agg(F.avg(mean).alias("confidence"), F.count(F.lit(1)).alias("n"))
    grade = F.when(F.col("confidence") >= 0.95, F.lit("A")).when(F.col("confidence") >= 0.90, F.lit("B")).when(F.col("confidence") >= 0.80, F.lit("C")).otherwise(F.lit("D"))
    return out.withColumn("grade", grade)


def overall_score(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the metrics (metric_name, value, threshold) that have a threshold, halved where below it;
    where none has one, the mean of the `*_pct` metrics, and 0 without those."""
    gated = F.when(F.col("threshold").isNotNull(), F.when(F.col("value") >= F.col("threshold"), F.col("value")).otherwise(F.col("value") * 0.5))
    plain = F.when(F.col("metric_name").endswith("_pct"), F.col("value"))
    return metrics.groupBy(*keys).agg(F.coalesce(F.avg(gated), F.avg(plain), F.lit(0.0)).alias("overall_score"))


def advice(scores: DataFrame) -> DataFrame:
    """Metrics below their threshold: metric_name, value, threshold, gap, priority (high over 30, medium over 10)."""
    out = scores.filter(F.col("value") < F.col("threshold")).withColumn("gap", F.col("threshold") - F.col("value"))
    return out.withColumn("priority", F.when(F.col("gap") > 30, F.lit("high")).when(F.col("gap") > 10, F.lit("medium")).otherwise(F.lit("low")))


def balanced_ids(flows: DataFrame, key: str, ids: str, most_share: float = 0.2) -> DataFrame:
    """Drops ids that over `most_share` of the flows use (at least one flow) from flows that have several."""
    most = max(1, int(flows.count() * most_share))
    used = flows.select(key, F.explode(F.array_distinct(ids)).alias("one"))
    common = used.groupBy("one").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") > most).select("one", F.lit(True).alias("common"))
    marked = used.join(common, "one", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("common").isNull(), F.col("one")))).alias("rare"), F.sort_array(F.collect_list("one")).alias("every"))
    return marked.select(key, F.when(F.size("every") > 1, F.col("rare")).otherwise(F.col("every")).alias(ids))


def count_by(rows: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """Rows of each key and, if asked for, the latest value of a column."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *([F.max(latest).alias("latest")] if latest else []))


def churn(stats: DataFrame, path: str = "path", added: str = "added", deleted: str = "deleted", top: int = 10) -> DataFrame:
    """The files with most changed lines: path, added, deleted, total."""
    out = stats.groupBy(F.col(path).alias("path")).agg(F.sum(F.coalesce(F.col(added), F.lit(0))).alias("added"), F.sum(F.coalesce(F.col(deleted), F.lit(0))).alias("deleted"))
    return out.withColumn("total", F.col("added") + F.col("deleted")).orderBy(F.desc("total"), "path").limit(top)


def top_directories(paths: DataFrame, path: str, n: int = 5) -> DataFrame:
    """The most common first path segments."""
    top = F.when(F.col(path).contains("/"), F.split_part(F.col(path), F.lit("/"), F.lit(1))).otherwise(F.lit("."))
    return paths.groupBy(top.alias("directory")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "directory").limit(n)
