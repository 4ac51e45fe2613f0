"""Queries that write tables to the session's shared folder as files, and read them back through the file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.graph import checkpoint_folder
from tracelake.plans.registry import query, table
from tracelake.sources import files, sinks

#: A file for each brand's parts of one block of keys, so files stay small however many parts there are.
PAGE_KEYS = 4_096
#: Blocks whose pages' reports stand in one file where a file may hold several, so that files are few.
FILE_BLOCKS = 16
PAGES_SQL = f"p as (select *, replace(p_brand, '#', '') || '_' || p_partkey // {PAGE_KEYS} as page from part)"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _say(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _files(spark: SparkSession, sf_dir: str, line: Column, before: str = "", after: str = "") -> str:
    """A folder with a text file a page, a line a part in order of the keys."""
    page = _say(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), "_", F.floor(F.col("p_partkey") / PAGE_KEYS))
    lines = table(spark, sf_dir, "part").select(page.alias("page"), F.struct("p_partkey", line.alias("line")).alias("r")).groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    folder = _folder(spark, "files")
    text = F.concat(F.lit(before), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit(after))
    lines.select("page", text.alias("value")).repartition("page").write.partitionBy("page").text(folder)
    return folder


def _page(path: str = "path") -> Column:
    return F.regexp_extract(path, r"page=([^/]+)/", 1)


@query(
    f"""
    with {PAGES_SQL},
    t as (select page, string_agg(p_partkey || ' ' || p_name, chr(10) order by p_partkey) || chr(10) as body from p group by 1),
    u as (select page, body, length(body) as size, string_split(right(body, 60), chr(10)) as ends from t)
    select page, left(body, 40) as head, size > 40 as truncated, array_to_string(ends[greatest(1, len(ends) - 2):], chr(10)) as ending, size, md5(body) as md5, '.txt' as ext from u
    """
)
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bytes, last lines, sizes and digests of text files."""
    folder = _files(spark, sf_dir, _say(F.col("p_partkey"), " ", F.col("p_name")))
    head = files.text_limited(spark, folder, 40).select(_page().alias("page"), F.col("text").alias("head"), "truncated")
    end = files.tail(spark, folder, 60, 3).select(_page().alias("page"), F.col("text").alias("ending"))
    listed = files.listing(spark, folder, distinct="path").select(_page("rel_path").alias("page"), "size", "ext")
    seen = files.snapshot(spark, folder, ["*.txt"], ["*.csv"]).select(_page("rel_path").alias("page"), "md5")
    return head.join(end, "page").join(listed, "page").join(seen, "page")


@query(
    """
    select 'src/f' || p_partkey % 40 || '.c' as file, p_name || p_partkey as function, p_size as ccn, case when p_partkey % 7 = 0 then 1 else p_partkey % 7 end::int as nloc from part
    """
)
def complexity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity rows as CSV files with headers, read back by their headers."""
    total = F.when(F.col("p_partkey") % 14 != 0, (F.col("p_partkey") % 7).cast("int"))
    entries = table(spark, sf_dir, "part").select(_say("src/f", F.col("p_partkey") % 40, ".c").alias("file"), _say(F.col("p_name"), F.col("p_partkey")).alias("function"), F.col("p_size").alias("ccn"), F.struct(total.alias("total")).alias("statements"))
    path = _folder(spark, "complexity")
    sinks.write_csv(sinks.complexity_rows(entries), path)
    return files.complexity_csv(spark, path)


@query(f"with {PAGES_SQL} select page, case when min(p_partkey) % 3 = 0 then '' else 'name,size' end as keys, case when min(p_partkey) % 3 = 0 then 0 else 2 end as n_keys, min(p_partkey) % 3 <> 0 as valid from p group by 1")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the first part of each page, a third of them cut short."""
    first = F.col("p_partkey")
    page = _say(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), "_", F.floor(first / PAGE_KEYS))
    one = table(spark, sf_dir, "part").groupBy(page.alias("page")).agg(F.min_by(F.struct("p_partkey", "p_name", "p_size"), "p_partkey").alias("r"))
    text = F.concat(F.lit('{"name": "'), F.col("r.p_name"), F.lit('",\n "size": '), F.col("r.p_size").cast("string"), F.when(F.col("r.p_partkey") % 3 == 0, "").otherwise("}"))
    folder = _folder(spark, "json")
    one.select("page", text.alias("value")).repartition("page").write.partitionBy("page").text(folder)
    found = files.json_documents(spark, folder)
    return found.select(_page().alias("page"), F.coalesce(F.array_join("keys", ","), F.lit("")).alias("keys"), "n_keys", F.col("body").isNotNull().alias("valid"))


@query(f"with {PAGES_SQL} select n % 7 / 10 as line_rate, n % 9 / 100 as branch_rate, count(*) as pages from (select page, count(*) as n from p group by 1) group by 1, 2")
def coverage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage reports with rates as shares and, over 1, as percentages."""
    block = F.floor(F.col("p_partkey") / PAGE_KEYS)
    page = _say(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), "_", block)
    n = table(spark, sf_dir, "part").groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("n"), F.min(block).alias("block"))
    text = _say('<coverage line-rate="', F.col("n") % 7 / 10, '" branch-rate="', F.when(F.col("n") % 9 < 2, (F.col("n") % 9 / 100).cast("string")).otherwise((F.col("n") % 9).cast("string")), '"><packages/></coverage>')
    folder = _folder(spark, "coverage")
    lots = n.groupBy(F.floor(F.col("block") / FILE_BLOCKS).alias("lot")).agg(F.concat(F.lit('<?xml version="1.0"?>\n<reports>'), F.array_join(F.collect_list(text), "\n"), F.lit("</reports>")).alias("value"))
    lots.repartition("lot").write.partitionBy("lot").text(folder)
    return files.coverage_xml(spark, folder).groupBy(F.round("line_rate", 6).alias("line_rate"), F.round("branch_rate", 6).alias("branch_rate")).agg(F.count(F.lit(1)).alias("pages"))


@query("select 'R' || p_size as rule, arg_max(p_name || ' of ' || p_type, length(p_name || ' of ' || p_type) * 1000000 - p_partkey) as description from (select p_size, p_name, p_type, p_partkey from part) group by 1")
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest description of each rule over XML rule files; of equally long ones the first part's."""
    text = _say(F.col("p_name"), " of ", F.col("p_type"))
    part = table(spark, sf_dir, "part").withColumn("text", text)
    # One description of each length, so the longest is one.
    best = part.groupBy("p_size", F.length("text").alias("n")).agg(F.min_by("text", "p_partkey").alias("text"), F.min("p_partkey").alias("p_partkey"))
    line = F.when(F.col("p_partkey") % 2 == 0, _say('<rule id="R', F.col("p_size"), '"><message>', F.col("text"), "</message></rule>")).otherwise(_say('<rule name="R', F.col("p_size"), '"><description>', F.col("text"), "</description></rule>"))
    folder = _folder(spark, "rules")
    page = best.select("p_size", F.struct("p_partkey", line.alias("line")).alias("r")).groupBy("p_size").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    text = F.concat(F.lit("<rules>\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n</rules>"))
    page.select("p_size", text.alias("value")).repartition("p_size").write.partitionBy("p_size").text(folder)
    return files.rule_catalog(spark, folder)


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 5 = 0 then 1 else 0 end as version from orders where o_orderkey % 7 <> 0 or o_orderkey % 5 = 0")
def upserted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's first version, and a second one with a fifth of all orders put in."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    folder = _folder(spark, "versions")
    first = sinks.write_version(orders.filter("o_orderkey % 7 <> 0").withColumn("version", F.lit(0)), folder, 0)
    changes = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1).alias("version"))
    return spark.read.parquet(sinks.write_version(sinks.upserted(spark.read.parquet(first), changes, ["o_orderkey"]), folder, 1))


@query("select event_type, count(*) as n, round(sum(value), 4) as value from events group by 1")
def appended_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records appended in two turns, a folder a kind."""
    events, path = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), _folder(spark, "records")
    for turn in (0, 1):
        sinks.append_records(events.filter(F.col("event_id") % 2 == turn), path, "event_type")
    back = spark.read.schema("event_id long, value double, event_type string").json(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("select '| ' || p_name || ' | ' || case when p_size % 3 = 0 then '' else p_size::varchar end || ' |' as value, count(*) as n from part group by 1")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown rows of a table, written as JSON and read back."""
    part = table(spark, sf_dir, "part").select("p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size"))
    path = _folder(spark, "markdown")
    sinks.write_json(sinks.markdown_table(part, ["p_name", "size"]), path)
    return spark.read.schema("value string").json(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey as unit, max(l_quantity) filter (l_linenumber = 1) as v1, max(l_quantity) filter (l_linenumber = 2) as v2, max(l_quantity) filter (l_linenumber = 3) as v3 from (select l_orderkey, l_linenumber, min(l_quantity) as l_quantity from lineitem group by 1, 2) group by 1")
def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of named variables as one row a case."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name")).agg(F.min("l_quantity").alias("value"))
    return sinks.case_rows(lines, ["unit"], "name", "value", ["v1", "v2", "v3"])
