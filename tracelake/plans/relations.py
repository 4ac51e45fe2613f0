"""Queries of the relation, search, graph, change, generator and source operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import numbers, text
from tracelake.operators import change, filters, generate, graph, relate, search, sets
from tracelake.plans.registry import parts_of, query, table
from tracelake.sources import html, logs

# -- traceability and diffs -------------------------------------------------------------------


@query(
    """
    with c as (select l_partkey, avg(l_discount) as s, max(l_tax) as b from lineitem group by 1),
    r as (select l_partkey, count(distinct l_suppkey) as n from lineitem group by 1)
    select p_partkey, round(s, 9) as statement_rate, b as branch_rate, coalesce(n, 0) as n_requirements, coalesce(s > 0, false) as covered
    from part left join c on l_partkey = p_partkey left join r on r.l_partkey = p_partkey
    """
)
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions, line items as coverage, suppliers as requirements."""
    lines = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("Fn_"), F.col(c).cast("string")).alias("name")
    functions = table(spark, sf_dir, "part").select("p_partkey", name("p_partkey"))
    coverage = lines.groupBy("l_partkey").agg(F.avg("l_discount").alias("statement_rate"), F.max("l_tax").alias("branch_rate")).select(name("l_partkey"), "statement_rate", "branch_rate")
    requirements = lines.select(F.col("l_suppkey").cast("string").alias("req_id"), name("l_partkey"))
    out = relate.coverage_matrix(functions, coverage, requirements)
    return out.select("p_partkey", F.round("statement_rate", 9).alias("statement_rate"), "branch_rate", F.size("requirements").cast("long").alias("n_requirements"), "covered")


@query(
    """
    with c as (select p_partkey, coalesce(avg(l_discount) > 0, false) as covered, count(distinct l_suppkey) > 0 as traced from part left join lineitem on l_partkey = p_partkey group by 1)
    select count(*) as functions, count(*) filter (covered) as covered, count(*) filter (traced) as traced,
      round_even(100.0 * count(*) filter (covered) / count(*), 1) as coverage_pct, round_even(100.0 * count(*) filter (traced) / count(*), 1) as trace_pct from c
    """
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    functions = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"))
    coverage = lines.groupBy(F.col("l_partkey").cast("string").alias("name")).agg(F.avg("l_discount").alias("statement_rate"), F.max("l_tax").alias("branch_rate"))
    requirements = lines.select(F.col("l_suppkey").cast("string").alias("req_id"), F.col("l_partkey").cast("string").alias("name"))
    return relate.coverage_summary(relate.coverage_matrix(functions, coverage, requirements))


TRACE_SQL = """
    with d as (select 'REQ-' || c_nationkey as req_id, o_orderkey::varchar as testcase, 'orders' as source, case o_orderstatus when 'F' then 'PASS' else 'FAIL' end as result from orders join customer on o_custkey = c_custkey),
    g as (select distinct 'REQ-' || s_nationkey as req_id, s_suppkey from supplier),
    i as (select g.req_id, l_orderkey::varchar as testcase, 'lines' as source, min(case l_linestatus when 'F' then 'PASS' else 'FAIL' end) as result from lineitem join g on l_suppkey = s_suppkey group by 1, 2),
    t as (select req_id, testcase, source, min(result) as result, 'direct' as trace_type from d group by 1, 2, 3 union all select *, 'indirect' from i)
"""


def _trace_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = lambda c: F.when(F.col(c) == "F", F.lit("PASS")).otherwise(F.lit("FAIL")).alias("result")
    req = lambda c: F.concat(F.lit("req - "), F.col(c).cast("string")).alias("req_id")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    direct = orders.select(req("c_nationkey"), F.col("o_orderkey").cast("string").alias("testcase"), F.lit("orders").alias("source"), outcome("o_orderstatus"))
    designs = table(spark, sf_dir, "supplier").select(req("s_nationkey"), F.col("s_suppkey").alias("component"))
    indirect = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_orderkey").cast("string").alias("testcase"), F.lit("lines").alias("source"), outcome("l_linestatus"))
    return relate.trace_tests(direct, designs, indirect)


@query(TRACE_SQL + "select * from t")
def trace_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as requirements; orders link at once, line items over the suppliers."""
    return _trace_tests(spark, sf_dir)


@query(
    TRACE_SQL
    + """, a as (select req_id, count(*) as tests, count(*) filter (result = 'PASS') as passed, count(*) filter (trace_type = 'direct') as n_d, count(*) filter (trace_type = 'indirect') as n_i from t group by 1)
    select 'REQ-' || n_nationkey as req_id, coalesce(tests, 0) as tests, coalesce(passed, 0) as passed,
      case when n_d > 0 and n_i > 0 then 'mixed' when n_d > 0 then 'direct' when n_i > 0 then 'indirect' else 'none' end as confidence
    from nation left join a on a.req_id = 'REQ-' || n_nationkey"""
)
def trace_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    requirements = table(spark, sf_dir, "nation").select(F.concat(F.lit("REQ-"), F.col("n_nationkey").cast("string")).alias("req_id"))
    return relate.trace_matrix(requirements, _trace_tests(spark, sf_dir))


@query(
    """
    with a as (select distinct c_custkey % 40 as k from customer), b as (select distinct s_suppkey % 50 + 10 as k from supplier)
    select 'REQ' || coalesce(a.k, b.k) as req_id, case when a.k is null then 'extra' when b.k is null then 'missing' else 'mapped' end as state from a full join b on a.k = b.k
    """
)
def mapping_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("req "), c.cast("string")).alias("req_id")
    return relate.mapping_state(table(spark, sf_dir, "customer").select(key(F.col("c_custkey") % 40)), table(spark, sf_dir, "supplier").select(key(F.col("s_suppkey") % 50 + 10)))


VERSIONS_SQL = """
    with o as (select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderkey % 10 as m from orders),
    a as (select o_orderkey, o_orderstatus, o_orderpriority from o where m <> 0),
    b as (select o_orderkey, case when m = 1 then 'X' else o_orderstatus end as o_orderstatus, case when m in (1, 2) then ' Y ' else o_orderpriority end as o_orderpriority from o where m <> 9)
"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of all orders: tenths are added, removed and changed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 10).alias("m"))
    changed = orders.withColumn("o_orderstatus", F.when(F.col("m") == 1, F.lit("X")).otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("m").isin(1, 2), F.lit(" Y ")).otherwise(F.col("o_orderpriority")))
    return orders.filter("m <> 0").drop("m"), changed.filter("m <> 9").drop("m")


@query(
    VERSIONS_SQL
    + """select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' else 'modified' end as state,
      case when a.o_orderkey is null or b.o_orderkey is null then '' else concat_ws(',', case when a.o_orderstatus <> b.o_orderstatus then 'o_orderstatus' end, case when a.o_orderpriority <> b.o_orderpriority then 'o_orderpriority' end) end as changed
    from a full join b on a.o_orderkey = b.o_orderkey where a.o_orderkey is null or b.o_orderkey is null or a.o_orderstatus <> b.o_orderstatus or a.o_orderpriority <> b.o_orderpriority"""
)
def keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.keyed_diff(*_versions(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(
    VERSIONS_SQL
    + """, j as (select a.o_orderkey, a.o_orderstatus as s1, b.o_orderstatus as s2, trim(a.o_orderpriority) as p1, trim(b.o_orderpriority) as p2 from a join b on a.o_orderkey = b.o_orderkey)
    select o_orderkey, 'o_orderstatus' as field, s1 as old, s2 as new from j where s1 <> s2 union all select o_orderkey, 'o_orderpriority', p1, p2 from j where p1 <> p2"""
)
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.field_diff(*_versions(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(
    """
    with a as (select p_brand, p_partkey as r, 1 as c, p_name as v from part where p_partkey % 7 <> 0 union all select p_brand, p_partkey, 2, p_type from part where p_partkey % 7 <> 0),
    b as (select p_brand, p_partkey as r, 1 as c, case when p_partkey % 5 = 0 then upper(p_name) else p_name end as v from part where p_partkey % 11 <> 0 union all select p_brand, p_partkey, 2, p_type from part where p_partkey % 11 <> 0),
    ra as (select distinct p_brand, r from a), rb as (select distinct p_brand, r from b)
    select coalesce(ra.p_brand, rb.p_brand) as sheet, coalesce(ra.r, rb.r) as "row", 0 as col, case when ra.r is null then 'added_row' else 'removed_row' end as state, null as old, null as new from ra full join rb on ra.p_brand = rb.p_brand and ra.r = rb.r where ra.r is null or rb.r is null
    union all select a.p_brand, a.r, a.c, 'changed', a.v, b.v from a join b on a.p_brand = b.p_brand and a.r = b.r and a.c = b.c where a.v <> b.v
    """
)
def cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sheet rows by brand, in two versions."""
    part = table(spark, sf_dir, "part")
    cells = lambda df: df.select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row"), F.inline(F.array(F.struct(F.lit(1).alias("col"), F.col("p_name").alias("value")), F.struct(F.lit(2).alias("col"), F.col("p_type").alias("value")))))
    new = part.filter("p_partkey % 11 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return relate.cell_diff(cells(part.filter("p_partkey % 7 <> 0")), cells(new))


@query(
    """
    with f as (select l_suppkey, l_partkey, l_linestatus as v, sum(l_linenumber)::bigint as nloc, max(l_quantity)::bigint as ccn from lineitem group by 1, 2, 3),
    a as (select * from f where v = 'F'), b as (select * from f where v = 'O')
    select coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, coalesce(a.l_partkey, b.l_partkey) as l_partkey,
      case when a.v is null then 'added' when b.v is null then 'removed' else 'modified' end as state, coalesce(abs(b.nloc - a.nloc) + 10 * abs(b.ccn - a.ccn), 0) as score
    from a full join b on a.l_suppkey = b.l_suppkey and a.l_partkey = b.l_partkey where a.v is null or b.v is null or abs(b.nloc - a.nloc) + 10 * abs(b.ccn - a.ccn) > 0
    """
)
def function_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_suppkey", "l_partkey"]
    rows = table(spark, sf_dir, "lineitem").groupBy(*keys, "l_linestatus").agg(F.sum("l_linenumber").alias("nloc"), F.max("l_quantity").cast("long").alias("ccn"))
    return relate.function_changes(rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'"), keys)


@query(
    """
    with a as (select l_partkey as k, count(*) as n_old from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey as k, count(*) as n_new from lineitem where l_returnflag = 'R' group by 1)
    select coalesce(a.k, b.k) as l_partkey, coalesce(n_old, 0) as n_old, coalesce(n_new, 0) as n_new from a full join b on a.k = b.k where coalesce(n_old, 0) <> coalesce(n_new, 0)
    """
)
def count_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return relate.count_diff(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'"), "l_partkey")


@query(
    """
    with n as (select distinct p_name as name from part), e as (select distinct p_type as entry from part union select distinct split_part(p_name, ' ', 1) from part),
    c as (select name, entry, least(length(name), length(entry)) / greatest(length(name), length(entry)) as ratio from n join e on contains(lower(name), lower(entry)) or contains(lower(entry), lower(name)))
    select name, entry, round(ratio, 9) as ratio from c where ratio >= 0.5 qualify row_number() over (partition by name order by ratio desc, entry) = 1
    """
)
def fuzzy_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entries = part.select(F.col("p_type").alias("entry")).union(part.select(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return relate.best_containment(part, "p_name", entries, "entry").withColumn("ratio", F.round("ratio", 9))


@query(
    """
    with s as (select lower(trim(p_name)) as k, min(p_type) as t from part group by 1)
    select p_partkey, case when p_size > 25 then s.t else p_brand end as brand, case when p_size > 25 then 'design' else 'own' end as brand_source from part left join s on lower(trim(p_name)) = s.k
    """
)
def fill_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of large parts are blanked and filled from the types of parts with the same name."""
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.trim("p_name").alias("p_name"), F.when(F.col("p_size") > 25, F.lit("TBD")).otherwise(F.col("p_brand")).alias("brand"))
    source = part.select(F.trim("p_name").alias("key"), F.col("p_type").alias("brand"))
    return relate.fill_blank(rows, "p_name", source, "key", ["brand"], "design").drop("p_name")


# -- search -----------------------------------------------------------------------------------


@query(
    r"""
    with t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as x from documents),
    c as (select doc_id, x, unnest(range(0, greatest(length(x), 1), 1000)) as i from t), w as (select doc_id, i // 1000 as k, substr(x, i + 1, 1200) as s from c)
    select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk, length(s) as n, md5(s) as digest from w where regexp_matches(s, '\S')
    """
)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


QUERY = "the license token"


@query(
    """
    with d as (select doc_id, lower(text) as h from documents), c as (select doc_id, x.t, ((length(h) - length(replace(h, x.t, ''))) / length(x.t))::int as c from d, (values ('the'), ('license'), ('token')) x(t)),
    s as (select doc_id, sum(case when c > 0 then least(c, 5) / (1 + 0.5 * c) else 0 end) * (0.5 + 0.5 * count(*) filter (c > 0) / 3) as score from c group by 1)
    select doc_id, round(score, 9) as score from s where score > 0 order by s.score desc, doc_id limit 50
    """
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_search(table(spark, sf_dir, "documents"), "doc_id", ["text"], QUERY, 50).withColumn("score", F.round("score", 9))


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


COSINE_SQL = """
    with q as (select embedding::double[] as v from embeddings order by vec_id limit 1),
    c as (select vec_id, list_dot_product(embedding::double[], q.v) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q.v, q.v))) as score from embeddings, q)
"""


@query(COSINE_SQL + "select vec_id, round(score, 6) as score from c where score > 0 order by c.score desc, vec_id limit 20")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.semantic_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    COSINE_SQL
    + """, e as (select doc_id as id, lower(text) as h from documents join embeddings on doc_id = vec_id),
    k as (select id, ((length(h) - length(replace(h, 'the', ''))) / 3)::int as n from e),
    kr as (select id, row_number() over (order by case when n > 0 then least(n, 5) / (1 + 0.5 * n) else 0 end desc, id) as r from k where n > 0 qualify r <= 50),
    vr as (select vec_id as id, row_number() over (order by score desc, vec_id) as r from c join e on e.id = vec_id where score > 0 qualify r <= 50)
    select id, round(sum(1.0 / (60 + r)), 9) as score from (select * from kr union all select * from vr) group by 1 order by sum(1.0 / (60 + r)) desc, id limit 10"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    out = search.hybrid_search(entries, "id", ["text"], "embedding", "the", _first_vector(spark, sf_dir), 10)
    return out.withColumn("score", F.round("score", 9))


@query(
    """
    with h as (select 'docs' as domain, doc_id as id, n_chars / 100000.0 as score from documents
      union all select 'reports', page_id, length(url) / 1000.0 from pages union all select 'logs', conv_id * 1000 + turn, length(text) / 100000.0 from conversations)
    select domain, id, round(score, 9) as score, case domain when 'reports' then 10 when 'logs' then 9 else 8 end as priority from h order by priority desc, h.score desc, id limit 400
    """
)
def domain_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("docs").alias("domain"), F.col("doc_id").alias("id"), (F.col("n_chars") / 100000.0).alias("score"))
    pages = table(spark, sf_dir, "pages").select(F.lit("reports").alias("domain"), F.col("page_id").alias("id"), (F.length("url") / 1000.0).alias("score"))
    talks = table(spark, sf_dir, "conversations").select(F.lit("logs").alias("domain"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.length("text") / 100000.0).alias("score"))
    return search.domain_ranked(docs.union(pages).union(talks), ["reports", "logs", "docs", "code"], 400, "id").withColumn("score", F.round("score", 9))


@query("select doc_id, line_no, line as text from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents) where contains(lower(line), 'license')")
def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = logs.lines_of(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return filters.line_hits(lines, "license", order=("doc_id", "line_no")).withColumn("line_no", F.col("line_no").cast("long"))


# -- graphs -----------------------------------------------------------------------------------

EDGES_SQL = """
    with recursive c as (select l_orderkey, l_partkey as src, lead(l_partkey) over w as dst, row_number() over w as ordinal from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)),
    e as (select src, dst, min(l_orderkey * 100 + ordinal) as ordinal from c where dst is not null and src <> dst group by 1, 2)
"""


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """An order's lines have fewer edges than lines."""
    return parts_of(table(spark, sf_dir, "lineitem"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: a part calls the next part of an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = _parts(spark, sf_dir)
    calls = lines.repartition(parts, "l_orderkey").select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.row_number().over(w).alias("ordinal"))
    return calls.filter("dst is not null and src <> dst").repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.min(F.col("l_orderkey") * 100 + F.col("ordinal")).alias("ordinal"))


@query(EDGES_SQL + "select src, dst, ordinal from e")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(
    EDGES_SQL
    + """, u as (select src, dst from e union select dst, src from e),
    h0 as (select 0::bigint as node), h1 as (select distinct dst as node from u join h0 on src = node where dst not in (select node from h0)),
    h2 as (select distinct dst as node from u join h1 on src = node where dst not in (select node from h0 union select node from h1))
    select node, 0 as hop from h0 union all select node, 1 from h1 union all select node, 2 from h2"""
)
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(0,)], "node long")
    return graph.hops(graph.both_ways(_edges(spark, sf_dir)), seeds, 2, parts=_parts(spark, sf_dir))


@query(
    EDGES_SQL
    + """, m as (select e.src, e.dst from e join part a on a.p_partkey = e.src join part b on b.p_partkey = e.dst where a.p_brand = b.p_brand),
    u as (select src, dst from m union select dst, src from m), h0 as (select 0::bigint as node),
    h1 as (select distinct dst as node from u join h0 on src = node where dst not in (select node from h0)),
    h2 as (select distinct dst as node from u join h1 on src = node where dst not in (select node from h0 union select node from h1))
    select node::varchar as node, 'direct' as "group" from h0 union all select node::varchar, 'indirect_1hop' from h1 union all select node::varchar, 'indirect_2hop' from h2"""
)
def impact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops inside a brand from part 0."""
    edges = _edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    modules = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("module"))
    return graph.impact_groups(edges, modules, spark.createDataFrame([("0",)], "node string"), parts=_parts(spark, sf_dir))


IMPACT_SQL = (
    EDGES_SQL
    + """, d as (select 0::bigint as node union select dst from e join d on src = node), a as (select 0::bigint as node union select src from e join a on dst = node),
    i as (select node from d union select node from a)"""
)


@query(IMPACT_SQL + "select node from i")
def directed_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed closure from part 0 over all calls."""
    return graph.directed_impact(_edges(spark, sf_dir), spark.createDataFrame([(0,)], "node long"), _parts(spark, sf_dir))


@query(IMPACT_SQL + "select coalesce(nullif(p_brand, 'Brand#3'), 'unknown') as component, count(*) as n_nodes, count(*) filter (node = 0) as n_seeds from i left join part on p_partkey = node group by 1")
def impacted_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure from part 0 by brand; parts of one brand have no component."""
    seeds = spark.createDataFrame([(0,)], "node long")
    modules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.nullif("p_brand", F.lit("Brand#3")).alias("module"))
    return graph.impacted_components(graph.directed_impact(_edges(spark, sf_dir), seeds, _parts(spark, sf_dir)), modules, seeds)


@query(
    EDGES_SQL
    + """, t as (select 0::bigint as entry, 0 as depth, 0::bigint as node, ['0'] as path, false as cycle
      union all select t.entry, t.depth + 1, e.dst, list_append(t.path, e.dst::varchar), list_contains(t.path, e.dst::varchar) from t join e on e.src = t.node where t.depth < 2 and not t.cycle)
    select entry, depth, node, array_to_string(path, '>') as path, cycle, depth = 2 and not cycle and node in (select src from e) as truncated from t"""
)
def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.call_tree(_edges(spark, sf_dir), spark.createDataFrame([(0,)], "node long"), 2)


@query(EDGES_SQL + "select distinct a.p_brand as from_component, b.p_brand as to_component from e join part a on a.p_partkey = src join part b on b.p_partkey = dst where a.p_brand <> b.p_brand")
def dependency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.component_edges(_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("component")))


@query(
    EDGES_SQL
    + """, f as (select a.src, b.dst as far, min(struct_pack(o1 := a.ordinal, o2 := b.ordinal)) as first from e a join e b on b.src = a.dst where a.src <> b.dst and not exists (select 1 from e x where x.src = a.src and x.dst = b.dst) group by 1, 2)
    select src, far as dst, (row_number() over (partition by src order by first, far))::int as k from f qualify k <= 20"""
)
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_hop(_edges(spark, sf_dir))


@query(
    EDGES_SQL
    + """, x as (select e.*, a.p_brand as module, row_number() over (partition by src order by ordinal, dst) as k from e join part a on a.p_partkey = src join part b on b.p_partkey = dst where a.p_brand <> b.p_brand)
    select src as name, module, string_agg(dst::varchar, '>' order by k) as chain from x where k <= 4 group by 1, 2 order by 1 limit 120"""
)
def integration_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("module"))
    return relate.integration_flows(functions, _edges(spark, sf_dir))


@query(EDGES_SQL + ", g as (select dst, count(distinct src) as n from e group by 1) select dst, n from g")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers_of(_edges(spark, sf_dir)).select("dst", F.size("callers").cast("long").alias("n"))


# -- change, generators, sources --------------------------------------------------------------

MATRIX_SQL = ", ".join(f"('{kind}', '{target}', {2 if d == 'FLAG' else 1 if d == 'AUTO' else 0})" for kind, row in change.DECISIONS.items() for target, d in zip(change.TARGETS, row, strict=True))


@query(
    f"""
    with m(kind, target, rank) as (values {MATRIX_SQL}),
    c as (select distinct user_id, case event_type when 'view' then 'BODY' when 'click' then 'VARIABLE' when 'error' then 'SIGNATURE' when 'purchase' then 'HEADER' else 'NEW' end as kind from events)
    select user_id, target, case max(rank) when 2 then 'FLAG' when 1 then 'AUTO' else '-' end as decision from c join m using (kind) group by 1, 2
    """
)
def decision_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = numbers.mapped("event_type", {"view": "BODY", "click": "VARIABLE", "error": "SIGNATURE", "purchase": "HEADER"}, "NEW")
    return change.decisions(table(spark, sf_dir, "events").select("user_id", kind.alias("kind")), ["user_id"])


@query(
    """
    with s as (select p_name || '.c' as p, p_partkey, p_size, md5(p_type) as h from part),
    a as (select p_partkey, p_size as t, h from s where p_partkey % 9 <> 0), b as (select p_partkey, case when p_partkey % 4 = 0 then p_size + 1 else p_size end as t, h from s where p_partkey % 8 <> 0)
    select coalesce(a.p_partkey, b.p_partkey)::varchar as rel_path, case when a.t is null then 'added' when b.t is null then 'removed' else 'changed' end as state from a full join b on a.p_partkey = b.p_partkey where a.t is null or b.t is null or a.t <> b.t
    """
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("rel_path"), F.col("p_size").alias("mtime"), F.md5(F.col("p_type").cast("binary")).alias("md5"))
    new = rows.filter("k % 8 <> 0").withColumn("mtime", F.when(F.col("k") % 4 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return change.snapshot_diff(rows.filter("k % 9 <> 0").drop("k"), new.drop("k"))


@query(
    """
    with v as (select p_brand as unit, p_name as name, row_number() over (partition by p_brand order by p_partkey) - 1 as ordinal from part),
    s(k, strategy, value) as (values (1, 'BV_MIN_INV', -1.0), (2, 'BV_MIN', 0.0), (3, 'BV_MID', 127.0), (4, 'BV_MAX', 255.0), (5, 'BV_MAX_INV', 256.0), (6, 'MIXED', null))
    select unit, k as seq, strategy, name, coalesce(value, case when ordinal % 2 = 0 then 0.0 else 255.0 end)::double as value from v, s
    """
)
def boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    variables = table(spark, sf_dir, "part").select(F.col("p_brand").alias("unit"), (F.row_number().over(w) - 1).alias("ordinal"), F.col("p_name").alias("name"))
    return generate.boundary_rows(variables)


@query(
    """
    with f as (select distinct p_brand as flow, p_type as name from part), b(k, value, expected) as (values (1, -1.0, 0.0), (2, 0.0, 0.0), (3, 16383.0, 16383.0), (4, 32767.0, 32767.0), (5, 49151.0, 49151.0), (6, 65535.0, 65535.0), (7, 65536.0, 32767.0))
    select flow, name, k as sub, value::double as value, expected::double as expected from f, b
    """
)
def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.flow_rows(table(spark, sf_dir, "part").select(F.col("p_brand").alias("flow"), F.col("p_type").alias("name"), F.lit("uint16").alias("kind")).distinct())


@query("select count(*) as total, count(l_partkey) as covered, round_even(100.0 * count(l_partkey) / count(*), 1) as pct from part left join (select distinct case when l_quantity > 49 then l_partkey end as l_partkey from lineitem) on l_partkey = p_partkey")
def requirement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") > 49, F.col("l_partkey")).alias("p_partkey"))
    return generate.requirement_coverage(table(spark, sf_dir, "part").select("p_partkey"), cases, "p_partkey")


LINES_SQL = r"""
    with l as (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '[^\x00-\x7F]', 'x', 'g') as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents),
    c as (select doc_id, line_no, case when regexp_matches(line, '(?i)\b(error|fatal|exception|fail(?:ed|ure)?|unable|cannot|crash|abort|denied|rejected)\b') then 'ERROR'
      when regexp_matches(line, '(?i)\b(warn(?:ing)?|caution|deprecated|timeout|retry|skip(?:ped)?)\b') then 'WARNING'
      when regexp_matches(line, '(?i)((?:build|test|compile|link|deploy|checkout|svn|git|coverage|pass|result|complete|finish|start|begin)\b)') then 'KEY' else 'INFO' end as level from l)
"""


@query(LINES_SQL + "select doc_id, level, count(*) as n, min(line_no) as first_line from c group by 1, 2")
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = logs.lines_of(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return lines.groupBy("doc_id", logs.level("text").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("first_line"))


@query(
    r"""
    with l as (select conv_id, turn as line_no, case when role = 'system' then 1 end as open, case when role <> 'system' then text else '' end as text from conversations),
    s as (select *, max(case when open = 1 then line_no end) over (partition by conv_id order by line_no) as st from l)
    select conv_id, 'stage' || st as stage, count(*) filter (regexp_matches(text, '(?i)\b(error|fatal|exception|fail(?:ed|ure)?|unable|cannot|crash|abort|denied|rejected)\b')) as errors, min(line_no) as first_line
    from s where st is not null group by 1, 2
    """
)
def log_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs: a system message opens a stage."""
    opening = F.concat(F.lit("[Pipeline] { (stage"), F.col("turn").cast("string"), F.lit(") "), F.col("text"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.when(F.col("role") == "system", opening).otherwise(F.col("text")).alias("text"))
    return logs.stages(logs.classify(lines, ["conv_id"]), ["conv_id"]).select("conv_id", "stage", "errors", "first_line")


@query(r"""select page_id, len(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']')) as n_links, len(regexp_extract_all(html, '(?is)<h[12][^>]*>.*?</h[12]>')) as n_headings, length(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) > 0 as titled from pages""")
def html_titles_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(html.links("html")).cast("long").alias("n_links"), F.size(html.headings("html", 100_000)).cast("long").alias("n_headings"), (F.length(html.title("html")) > 0).alias("titled"))


@query(r"""with t as (select page_id, unnest(regexp_extract_all(html, '(?is)<table\b[^>]*>(.*?)</table>', 1)) as t from pages) select page_id, count(*) as tables, sum(len(regexp_extract_all(t, '(?is)<t[dh]\b[^>]*>.*?</t[dh]>')))::bigint as cells from t group by 1""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(html.tables("html")).alias("t"))
    cells = F.aggregate(F.transform("t", lambda r: F.size(r).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("tables"), F.sum(cells).alias("cells"))


@query(r"select page_id, case when contains(lower(url), 'spec') or contains(lower(url), 'doc') or contains(lower(url), 'guide') or contains(lower(url), 'requirement') then 'docs' when regexp_matches(lower(url), 'function|class|symbol|file|source') then 'code' when regexp_matches(lower(url), 'git|diff|commit|branch|staged|checkout') then 'git' when regexp_matches(lower(url), 'coverage|line rate|branch rate|gcov') then 'coverage' when regexp_matches(lower(url), 'finding|warn|static') then 'findings' when regexp_matches(lower(url), 'log|error|fail|traceback|exception|build|test') then 'troubleshooting' else 'general' end as kind from pages")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as questions."""
    return table(spark, sf_dir, "pages").select("page_id", text.question_type("url").alias("kind"))
