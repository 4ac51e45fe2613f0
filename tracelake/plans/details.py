"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import numbers, text
from tracelake.operators import change, filters, generate, graph, history, quality, relate, sets
from tracelake.plans.registry import query, table
from tracelake.plans.relations import EDGES_SQL, _edges
from tracelake.sources import code


@query("select p_brand, p_name, p_partkey, p_size from (select *, row_number() over (partition by p_brand, p_name order by p_partkey) as k from part) where k = 1")
def first_of_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.first_of_pair(table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", "p_size"), "p_brand", "p_name", "p_partkey")


@query(
    """
    with f as (select event_id, event_type, user_id % 10 as rule from events), k as (select distinct event_type, rule from f where event_id % 3 = 0)
    select event_id, case when k.rule is not null then 'exists' else 'created' end as reason, n_name as text from f left join k using (event_type, rule) join nation on n_nationkey = f.rule
    """
)
def auto_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings of ten rules; nations are the catalog."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), F.lit("f").alias("file"), F.col("event_id").alias("line"), (F.col("user_id") % 10).cast("string").alias("id"), F.lit("").alias("message"))
    seen = events.filter("line % 3 = 0").select("tool", "id").distinct()
    known = events.join(seen, ["tool", "id"], "left_semi").select("tool", "file", "line", "id")
    catalog = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("rule"), F.col("n_name").alias("description"))
    return filters.auto_deviations(events, known, catalog, "auto", "open").select(F.col("line").alias("event_id"), "reason", "text")


@query(
    """
    with f as (select p_partkey, p_brand, case when p_size < 20 then p_size end as r from part),
    d as (select 'SWTR_' || r as req_id, p_partkey::varchar as name, 'related' as via from f where r is not null union select 'SWTR_' || s_nationkey, p_partkey::varchar, 'design' from f join supplier on p_brand = 'Brand#' || (s_suppkey % 25) where r is null)
    select distinct req_id, name, via from d where req_id in (select 'SWTR_' || n_nationkey from nation)
    """
)
def requirement_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("component"), F.when(F.col("p_size") < 20, F.concat(F.lit("see SwTR_"), F.col("p_size").cast("string"))).alias("related"))
    designs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("component"), F.concat(F.lit("SwTR_"), F.col("s_nationkey").cast("string")).alias("req_id"))
    requirements = table(spark, sf_dir, "nation").select(F.concat(F.lit("SwTR_"), F.col("n_nationkey").cast("string")).alias("req_id"))
    return relate.requirement_functions(requirements, functions, designs)


@query(
    EDGES_SQL
    + """, x as (select src, dst from e), y as (select src, dst from e where (src + dst) % 5 <> 0)
    select x.src, count(*) as n_expected, count(y.dst) as n_documented, count(y.dst) as n_both, count(*) = count(y.dst) as same from x left join y on x.src = y.src and x.dst = y.dst group by 1"""
)
def call_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth call is not documented."""
    edges = _edges(spark, sf_dir)
    return relate.call_agreement(edges, edges.filter("(src + dst) % 5 <> 0"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name")))


@query(EDGES_SQL + "select src, dst, case when p_brand = 'Brand#1' then 'internal' else 'external' end as kind from e join part on p_partkey = dst")
def internal_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").filter("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("name"))
    return graph.internal_external(_edges(spark, sf_dir).select("src", "dst"), known)


@query("select l_suppkey as name, count(distinct l_partkey) as n, count(distinct l_partkey) as listed from lineitem group by 1")
def globals_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("name"), F.col("l_partkey").alias("function"))
    return relate.globals_usage(usage).select("name", "n", F.size("functions").cast("long").alias("listed"))


@query(
    """
    with f as (select distinct l_orderkey as k, l_returnflag as id from lineitem union select distinct l_orderkey, 'S' || (l_suppkey % 40) from lineitem),
    c as (select id from f group by id having count(*) > greatest(1, floor((select count(distinct k) from f) * 0.2))), n as (select k, count(*) as n from f group by 1)
    select k, count(*) filter (n = 1 or f.id not in (select id from c)) as kept from f join n using (k) group by 1
    """
)
def balanced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flows; return flags are the ids that too many use."""
    lines = table(spark, sf_dir, "lineitem")
    ids = lines.select(F.col("l_orderkey").alias("k"), F.explode(F.array("l_returnflag", F.concat(F.lit("S"), (F.col("l_suppkey") % 40).cast("string")))).alias("id")).groupBy("k").agg(F.collect_set("id").alias("ids"))
    return quality.balanced_ids(ids, "k", "ids").select("k", F.size("ids").cast("long").alias("kept"))


@query("with p as (select regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path from pages) select case when contains(path, '/') then split_part(path, '/', 1) else '.' end as directory, count(*) as n from p group by 1 order by n desc, directory limit 5")
def top_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_directories(table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path")), "path")


@query(
    """
    with a as (select c_custkey % 60 as k, c_name as name, 0 as p from customer union all select s_suppkey % 80 + 20, s_name, 1 from supplier)
    select k, name, p as priority from a qualify row_number() over (partition by k order by p, name) = 1
    """
)
def first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 60).alias("k"), F.col("c_name").alias("name"))
    two = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 80 + 20).alias("k"), F.col("s_name").alias("name"))
    return sets.first_by_priority([one, two], "k", "name")


@query(
    """
    with f as (select event_id, event_type as message, case event_type when 'error' then 'error' when 'click' then 'warning' when 'view' then 'style' else 'other' end as severity, 'f' || (user_id % 10) as file, event_id as line from events)
    select severity, file, line, case severity when 'error' then 1 when 'warning' then 4 when 'style' then 6 else 13 end as severity_rank from f order by severity_rank, file, line::varchar, message limit 200
    """
)
def static_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = numbers.mapped("event_type", {"error": "error", "click": "warning", "view": "style"}, "other")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("message"), severity.alias("severity"), F.concat(F.lit("f"), (F.col("user_id") % 10).cast("string")).alias("file"), F.col("event_id").alias("line"))
    return history.static_issues(rows, 200).drop("message")


@query("select o_orderkey from orders where o_orderdate >= timestamp '1998-06-01' - interval 30 day or o_orderkey in (1, 2)")
def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created"))
    return history.retained(orders, "created", "o_orderkey", 30, F.lit("1998-06-01").cast("timestamp"), ["1", "2"]).select("o_orderkey")


@query(
    """
    with v as (select p_partkey, p_name || case p_partkey % 6 when 0 then '_u16_x' when 1 then ' s32s_y' when 2 then ' float z' when 3 then '_Flag' when 4 then ' bool' else '' end as name from part)
    select p_partkey, case when regexp_matches(name, '(?i)\\bu8[gs]?_|uint8|U8|BYTE') then 'uint8_t' when regexp_matches(name, '(?i)\\bu16[gs]?_|uint16|U16|WORD') then 'uint16_t'
      when regexp_matches(name, '(?i)\\bu32[gs]?_|uint32|U32|DWORD') then 'uint32_t' when regexp_matches(name, '(?i)\\bs8[gs]?_|int8[^_]|S8') then 'int8_t' when regexp_matches(name, '(?i)\\bs16[gs]?_|int16|S16') then 'int16_t'
      when regexp_matches(name, '(?i)\\bs32[gs]?_|int32|S32') then 'int32_t' when regexp_matches(name, '(?i)\\bBits\\.|_F\\b|_Flag|_Sta\\b|_Enable|_Disable') then 'bit' when regexp_matches(name, '(?i)\\bf32|float') then 'float'
      when regexp_matches(name, '(?i)\\bbool\\b|BOOL|boolean') then 'bool' else 'uint8_t' end as kind from v
    """
)
def variable_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(x) for x in ("_u16_x", " s32s_y", " float z", "_Flag", " bool", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", generate.variable_type(F.concat("p_name", ends)).alias("kind"))


@query(
    """
    with c as (select p_partkey as unit, p_size as t, ['>', '<', '>=', '<=', '==', '!='][(p_partkey % 6 + 1)::int] as op from part)
    select unit, 'size' as name, op, t::varchar as threshold, (case op when '>' then t + 1 when '!=' then t + 1 when '<' then t - 1 else t end)::bigint as true_value,
      (case op when '==' then t + 1 when '<=' then t + 1 when '>=' then t - 1 else t end)::bigint as false_value from c
    """
)
def condition_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.array(*[F.lit(x) for x in (">", "<", ">=", "<=", "==", "!=")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return generate.condition_cases(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.concat_ws(" ", F.lit("size"), op, F.col("p_size").cast("string")).alias("condition")))


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::int as a, 50 as b, l_quantity::int / 50 as rate from lineitem")
def ratio_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("l_quantity").cast("int").cast("string")
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.inline(F.array(numbers.ratio(F.concat(whole, F.lit(" / 50"))))))


@query(r"select doc_id, len(list_distinct([trim(x) for x in string_split(text, chr(10)) if trim(x) <> ''])) as n_lines from documents")
def distinct_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.distinct_lines("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(lines == "", 0).otherwise(F.size(F.split(lines, "\n"))).cast("long").alias("n_lines"))


@query("with c as (select case when regexp_matches(lower(url), '(^|/)tests?/|test_|_test\\.') then 'test' when regexp_matches(lower(url), '\\.(md|rst|docx?|txt)$|(^|/)docs?/') then 'docs' when regexp_matches(lower(url), '\\.(ya?ml|toml|ini|cfg|json)$') then 'config' when regexp_matches(lower(url), '\\.(c|h|cpp|py|js|jsx|ts)$') then 'code' else 'other' end as kind from pages) select kind, count(*) as n, row_number() over (order by count(*) desc, case kind when 'test' then 1 when 'docs' then 2 when 'config' then 3 when 'code' then 4 else 5 end) as k from c group by 1")
def work_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.work_type(table(spark, sf_dir, "pages").select("url"), "url")


@query("with f as (select p_partkey, 'src/' || replace(p_type, ' ', '_') || '.c' as file from part), c as (select distinct 'x/' || replace(p_type, ' ', '_') || '.c' as path from part where p_size > 45) select p_partkey as name, file from f where split_part(file, '/', 2) in (select split_part(path, '/', 2) from c)")
def file_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    path = lambda folder: F.concat(F.lit(folder), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".c"))
    return change.file_functions(part.filter("p_size > 45").select(path("x/").alias("path")), part.select(F.col("p_partkey").alias("name"), path("src/").alias("file")))


@query("select p_partkey as name, case when p_size % 2 = 0 then replace(p_type, ' ', '_') else split_part(p_name, ' ', 1) end as module, case when p_size % 2 = 0 then 0.9::double else 0.6::double end as confidence from part")
def module_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".c")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), file.alias("file"))
    joined = relate.module_candidates(rows.withColumn("name", F.concat("name", F.lit("#"), F.col("key").cast("string"))), "name", "file")
    return joined.select(F.split_part("name", F.lit("#"), F.lit(2)).cast("long").alias("name"), "module", F.col("confidence").cast("double").alias("confidence"))


@query("select p_partkey, p_size % 7 as n, 'f' || p_partkey as callee from part where p_size % 7 > 0")
def source_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as C functions with one call, repeated and commented out."""
    call = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit("(1);"))
    body = F.concat(F.lit("int g"), F.col("p_partkey").cast("string"), F.lit("(int a)\n{ /* h(); */ if (a) { "), F.repeat(call, (F.col("p_size") % 7).cast("int")), F.lit(" } }\n"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("text"), (F.col("p_size") % 7).alias("n"))
    found = code.functions(files)
    edges = code.call_edges(found).select(F.substring("src", 2, 20).cast("long").alias("p_partkey"), F.col("dst").alias("callee"))
    return edges.join(files.select(F.col("path").cast("long").alias("p_partkey"), "n"), "p_partkey").select("p_partkey", "n", "callee")
