"""Sinks: versioned upserts, CSV and JSON outputs, append-only records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`current` with the rows of `changes` put in place of those with the same keys; keys compare null-safe."""
    marked = changes.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]
    return current.join(marked, same, "left_anti").unionByName(changes, allowMissingColumns=True)


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """A new version beside the old ones, so that readers of an old one are not disturbed."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Spark commits the files of a job together, so readers see all of them or none."""
    df.write.mode("overwrite").json(path)


def append_records(df: DataFrame, path: str, by: str) -> None:
    """Append-only run records, one folder a key."""
    df.write.mode("append").partitionBy(by).json(path)


def complexity_rows(entries: DataFrame) -> DataFrame:
    """file, function, ccn, nloc; nloc is the number of statements, 1 where unknown."""
    return entries.select("file", "function", "ccn", F.coalesce(F.nullif(F.col("statements.total"), F.lit(0)), F.lit(1)).alias("nloc"))


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text column: a Markdown row of each row."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("value"))


def case_rows(cases: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One row a sequence and one column a variable, for CSV files of test cases."""
    # One aggregation by case: a pivot keeps the pairs of case and variable in memory before it.
    return cases.groupBy(*keys).agg(*[F.first(F.when(F.col(name) == n, F.col(value)), ignorenulls=True).alias(n) for n in names])
