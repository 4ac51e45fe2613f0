"""Build and test logs as classified lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.text import trimmed

#: What makes a line an error, a warning or a key event, and what opens and closes a stage.
ERROR = r"(?i)\b(error|fatal|exception|fail(?:ed|ure)?|unable|cannot|crash|abort|denied|rejected)\b"
WARNING = r"(?i)\b(warn(?:ing)?|caution|deprecated|timeout|retry|skip(?:ped)?)\b"
KEY_EVENT = r"(?i)((?:build|test|compile|link|deploy|checkout|svn|git|coverage|pass|result|complete|finish|start|begin)\b)"
STAGE_OPEN = r"\[Pipeline\] \{ \((.+?)\)"
STAGE_CLOSE = r"\[Pipeline\] // stage"
STAMPS = [r"^(\d{2}:\d{2}:\d{2}\.\d+)\s+(.*)", r"^\[(\d{4}-\d{2}-\d{2}T[\d:]+)\]\s+(.*)", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+(.*)"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1), text of text files; one row a line, whole files in one row each before."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines_of(files, ["path"], "value")


def lines_of(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    """The lines of a text column: keys, line_no (from 1), text."""
    return rows.select(*keys, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\r\n|\n|\r")).alias("k", "text")).select(*keys, (F.col("k") + 1).alias("line_no"), "text")


def level(line: Column | str) -> Column:
    text = F.col(line) if isinstance(line, str) else line
    return F.when(text.rlike(ERROR), F.lit("ERROR")).when(text.rlike(WARNING), F.lit("WARNING")).when(text.rlike(KEY_EVENT), F.lit("KEY")).otherwise(F.lit("INFO"))


def stamped(line: Column | str) -> Column:
    """struct(stamp, message): a leading time in one of three forms, else an empty stamp and the line."""
    text = F.col(line) if isinstance(line, str) else line
    chain = F
    for pattern in STAMPS:
        chain = chain.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("stamp"), F.regexp_extract(text, pattern, 2).alias("message")))
    return chain.otherwise(F.struct(F.lit("").alias("stamp"), text.alias("message")))


def classify(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds level, message (200 characters) and the open stage of each line.

    A line that opens or closes a stage is of level STAGE; a closing line ends any stage.
    """
    text = trimmed("text")
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("text", STAGE_OPEN, 1)
    mark = F.when(name != "", name).when(F.col("text").rlike(STAGE_CLOSE), F.lit(""))
    kind = F.when(mark.isNotNull(), F.lit("STAGE")).otherwise(level(text))
    return lines.select(*keys, "line_no", kind.alias("level"), F.substring(text, 1, 200).alias("message"), F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")).alias("stage"))


def stages(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Stages with their errors, warnings and status: failure where a line is an error."""
    out = classified.filter("stage is not null").groupBy(*keys, "stage").agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARNING").alias("warnings"), F.min("line_no").alias("first_line"))
    return out.withColumn("status", F.when(F.col("errors") > 0, F.lit("failure")).otherwise(F.lit("success")))


def stage_records(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every run of every stage: keys, ordinal, stage, start_line, end_line, line_count, errors, warnings, status.

    A stage runs until a closing line; one without it, at the end or before the next stage opens,
    has no end and stays `running`. A stage that runs twice has two records.
    """
    text = trimmed("text")
    name = F.regexp_extract("text", STAGE_OPEN, 1)
    kind = F.when(name != "", F.lit("open")).when(F.col("text").rlike(STAGE_CLOSE), F.lit("close")).otherwise(level(text))
    upto = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(*keys, "line_no", kind.alias("kind"), name.alias("name"), F.count_if(name != "").over(upto).alias("ordinal")).filter("ordinal > 0")
    before = Window.partitionBy(*keys, "ordinal").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("closed", F.coalesce(F.count_if(F.col("kind") == "close").over(before), F.lit(0))).filter("closed = 0")
    end = F.min(F.when(F.col("kind") == "close", F.col("line_no")))
    out = inside.groupBy(*keys, "ordinal").agg(F.max("name").alias("stage"), F.min("line_no").alias("start_line"), end.alias("end_line"), F.count_if(F.col("kind") == "ERROR").alias("errors"), F.count_if(F.col("kind") == "WARNING").alias("warnings"))
    status = F.when(F.col("end_line").isNull(), F.lit("running")).when(F.col("errors") > 0, F.lit("failure")).otherwise(F.lit("success"))
    return out.withColumns({"line_count": F.col("end_line") - F.col("start_line"), "status": status})


def first_of_level(classified: DataFrame, keys: list[str], caps: dict[str, int]) -> DataFrame:
    """The first lines of each level, as many as `caps` allows."""
    w = Window.partitionBy(*keys, "level").orderBy("line_no")
    most = F.lit(0)
    for name, n in caps.items():
        most = F.when(F.col("level") == name, n).otherwise(most)
    return classified.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= most).drop("_place")
