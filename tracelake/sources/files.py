"""Text, CSV, JSON and XML files, file listings and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import numbers
from tracelake.operators.filters import any_glob, path_filter


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def text_limited(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """path, text of the first bytes of each file, truncated; bytes that are no UTF-8 become U+FFFD."""
    files = binary(spark, path)
    return files.select("path", F.decode(F.substring("content", 1, most_bytes), "UTF-8").alias("text"), (F.col("length") > most_bytes).alias("truncated"))


def tail(spark: SparkSession, path: str, most_bytes: int, most_lines: int | None = None) -> DataFrame:
    """path, text of the last bytes of each file, and of those the last lines."""
    part = F.decode(F.substring("content", -most_bytes, most_bytes), "UTF-8")
    text = part if most_lines is None else F.array_join(F.slice(F.split(part, "\n"), -F.least(F.lit(most_lines), F.size(F.split(part, "\n"))), F.lit(most_lines)), "\n")
    return binary(spark, path).select("path", text.alias("text"))


def listing(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, root: str = "", distinct: str | None = None) -> DataFrame:
    """rel_path, ext, size, mtime of files; prefix filters on rel_path; `distinct` is 'path' or 'name'."""
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root}/?", "") if root else F.col("path")
    out = binary(spark, path).select(rel.alias("rel_path"), F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    out = out.filter(path_filter("rel_path", include or [], exclude or []))
    if distinct == "path":
        return out.dropDuplicates(["rel_path"])
    return out.withColumn("name", F.regexp_extract("rel_path", r"([^/]+)$", 1)).dropDuplicates(["name", "size"]).drop("name") if distinct == "name" else out


def snapshot(spark: SparkSession, path: str, watch: list[str], ignore: list[str]) -> DataFrame:
    """rel_path, mtime, md5 of watched files."""
    files = binary(spark, path).select(F.col("path").alias("rel_path"), F.unix_micros("modificationTime").alias("mtime"), F.md5("content").alias("md5"))
    return files.filter(any_glob("rel_path", watch) & ~any_glob("rel_path", ignore))


def csv_rows(spark: SparkSession, path: str, limit: int | None = 5000, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Rows of a CSV file with a header; every column is text."""
    rows = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).csv(path)
    return rows.limit(limit) if limit else rows


#: Header words that a complexity table has.
COMPLEXITY_HEADERS = {"nloc": ["nloc", "lines", "loc"], "ccn": ["ccn", "complexity", "cyclomatic"], "function": ["function", "name", "long_name"], "file": ["file", "filename", "path"]}


def complexity_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, function, ccn, nloc of a complexity table with any of three separators and lines before its header.

    Only the first 80 lines come to the driver, to find the header.
    """
    head = [r[0] for r in spark.read.text(path).limit(80).collect()]
    best = max(((sum(any(c.strip().strip('"').lower() in names for c in line.split(sep)) for names in COMPLEXITY_HEADERS.values()), -i, sep) for i, line in enumerate(head) for sep in ",;\t"), default=(0, 0, ","))
    at, sep = -best[1], best[2]
    header = [c.strip().strip('"').lower() for c in head[at].split(sep)] if head else []
    place = {k: next((i for i, c in enumerate(header) if c in names), None) for k, names in COMPLEXITY_HEADERS.items()}
    lines = spark.read.option("sep", sep).option("mode", "PERMISSIVE").csv(path, schema=", ".join(f"c{i} string" for i in range(max(1, len(header)))))
    cell = lambda k: F.trim(F.col(f"c{place[k]}")) if place[k] is not None else F.lit(None).cast("string")
    rows = lines.select(cell("file").alias("file"), cell("function").alias("function"), cell("ccn").try_cast("int").alias("ccn"), cell("nloc").try_cast("int").alias("nloc"))
    return rows.filter("ccn is not null and nloc is not null and function is not null")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, body (variant; null where a file is no JSON), and the first 20 keys with the number of keys."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    keys = F.json_object_keys("value")
    return files.select("path", F.try_parse_json("value").alias("body"), F.slice(keys, 1, 20).alias("keys"), F.coalesce(F.size(keys), F.lit(0)).alias("n_keys"))


def coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """line_rate and branch_rate (0 to 1) of coverage reports' root elements; a file may hold several."""
    # With a schema the files are read once, not once more for their columns.
    rows = spark.read.format("xml").option("rowTag", "coverage").schema("`_line-rate` string, `_branch-rate` string").load(path)
    rate = lambda name: numbers.rate_0_1(F.col(f"`_{name}`"))
    return rows.select(rate("line-rate").alias("line_rate"), rate("branch-rate").alias("branch_rate"))


def rule_catalog(spark: SparkSession, path: str) -> DataFrame:
    """rule, description: the longest description of each rule of XML rule files (elements `rule` with an id and a text)."""
    rows = spark.read.format("xml").option("rowTag", "rule").option("valueTag", "text").option("inferSchema", False).load(path)
    pick = lambda names: F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in rows.columns], F.lit(None).cast("string"))
    out = rows.select(pick(["_id", "id", "_name", "name"]).alias("rule"), pick(["description", "message", "text"]).alias("description")).filter("rule is not null")
    return out.groupBy("rule").agg(F.max_by("description", F.length("description")).alias("description"))


def trace_mappings(body: Column) -> Column:
    """array(struct(requirement_id, source_ids)) of a JSON text: a list, an object with `mappings`, or a plain object."""
    entry = "array<struct<requirement_id:string,req_id:string,id:string,source_ids:array<string>,sources:string>>"
    listed, wrapped = F.from_json(body, entry), F.from_json(body, f"struct<mappings:{entry}>")["mappings"]
    plain = F.from_json(body, "map<string,array<string>>")
    rows = lambda a: F.transform(a, lambda e: F.struct(F.coalesce(e["requirement_id"], e["req_id"], e["id"]).alias("requirement_id"), F.coalesce(e["source_ids"], F.split(e["sources"], r"\s*[,;]\s*")).alias("source_ids")))
    pairs = F.transform(F.map_entries(plain), lambda e: F.struct(e["key"].alias("requirement_id"), e["value"].alias("source_ids")))
    valid = lambda a: F.when(F.exists(a, lambda e: e["requirement_id"].isNotNull()), a)
    return F.coalesce(valid(rows(listed)), valid(rows(wrapped)), valid(pairs))
