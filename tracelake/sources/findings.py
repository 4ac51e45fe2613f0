"""Findings of static checkers as one schema: tool, file, line, severity, id, message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["tool", "file", "line", "severity", "id", "message"]


def clang_tidy(lines: DataFrame) -> DataFrame:
    """From output lines (text): path:line:column: severity: message [check]."""
    p = r"^(.+?):(\d+):(\d+):\s*(warning|error|note):\s*(.*?)(?:\s*\[([^\]]+)\])?$"
    g = lambda k: F.regexp_extract("text", p, k)
    return lines.filter(F.col("text").rlike(p)).select(F.lit("clang-tidy").alias("tool"), g(1).alias("file"), g(2).cast("int").alias("line"), g(4).alias("severity"), g(6).alias("id"), g(5).alias("message"))


def semgrep(bodies: DataFrame, column: str) -> DataFrame:
    """From JSON texts with `results`."""
    schema = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>>"
    r = bodies.select(F.explode(F.from_json(column, schema)["results"]).alias("r"))
    return r.select(F.lit("semgrep").alias("tool"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.lower("r.extra.severity").alias("severity"), F.col("r.check_id").alias("id"), F.col("r.extra.message").alias("message"))


def cppcheck(spark: SparkSession, path: str) -> DataFrame:
    """From XML result files: one row an error, placed at its first location."""
    schema = "_id string, _severity string, _msg string, _cwe string, location array<struct<_file:string,_line:int>>"
    rows = spark.read.format("xml").option("rowTag", "error").schema(schema).load(path)
    first = F.get("location", F.lit(0))
    return rows.select(F.lit("cppcheck").alias("tool"), first["_file"].alias("file"), first["_line"].alias("line"), F.col("_severity").alias("severity"), F.col("_id").alias("id"), F.col("_msg").alias("message"))


def numstat(lines: DataFrame) -> DataFrame:
    """path, added, deleted, total from `added<TAB>deleted<TAB>path` lines; `-` counts as 0."""
    p = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    n = lambda k: F.coalesce(F.regexp_extract("text", p, k).try_cast("long"), F.lit(0))
    return lines.filter(F.col("text").rlike(p)).select(F.regexp_extract("text", p, 3).alias("path"), n(1).alias("added"), n(2).alias("deleted"), (n(1) + n(2)).alias("total"))


def commits(lines: DataFrame, separator: str = "\x1f") -> DataFrame:
    """hash, date, author, subject from separated lines."""
    parts = F.split("text", separator, 4)
    return lines.filter(F.size(parts) == 4).select(parts[0].alias("hash"), parts[1].try_cast("timestamp").alias("date"), parts[2].alias("author"), parts[3].alias("subject"))


def unified_diffs(files: DataFrame, column: str) -> DataFrame:
    """file, diff: a unified diff text cut into its files."""
    parts = files.select(F.explode(F.split(column, r"(?m)^(?=diff --git |--- a/)")).alias("diff")).filter(F.trim("diff") != "")
    return parts.select(F.coalesce(F.nullif(F.regexp_extract("diff", r"(?m)^\+\+\+ b/(.+)$", 1), F.lit("")), F.regexp_extract("diff", r"(?m)^--- a/(.+)$", 1)).alias("file"), "diff").filter("file <> ''")
