"""Queries over C text that is written from the tables: nested flow, test steps, guards, declarations, macros, ranges, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import descriptions
from tracelake.operators import branches, changelog, designs, generate, graph, ranges, search, units
from tracelake.plans.registry import parts_of, query, table
from tracelake.sources import code, flow, pdf, sidedocs
from tracelake.streaming import jobs

#: Bodies of orders: `deep` conditions inside one another (a guard's name where 3 divides the key), an else at the
#: outermost one of even keys, a switch, a loop and a return.
SHAPE_SQL = """
o as (select o_orderkey as k, o_custkey as c, o_orderkey % 7 as deep, least(o_orderkey % 7, 4) as m, case when o_orderkey % 7 > 0 and o_orderkey % 2 = 0 then 1 else 0 end as e,
  case when o_orderkey % 3 = 0 then 'err_' else 'a' end as name from orders),
lv as (select *, unnest(range(1, m + 1)) as i from o where m > 0)
"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # The table may come in one part: its keys are dealt out before the bodies are written, as they are narrow.
    dealt = orders.repartition(parts_of(orders))
    o = dealt.select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    deep, k = (F.col("k") % 7).cast("int"), F.col("k")
    s = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    each = F.sequence(F.lit(1), F.greatest(deep, F.lit(1)))
    opened = F.array_join(F.transform(each, lambda i: s("if (", F.when(k % 3 == 0, "err_").otherwise("a"), i.cast("string"), " > ", (k % 100).cast("string"), ") { t", i.cast("string"), "(); ")), "")
    nested = F.when(deep > 0, s(opened, F.repeat(F.lit("} "), deep), F.when(k % 2 == 0, s("else { e", k.cast("string"), "(x, \"; }\"); }")).otherwise(""))).otherwise("")
    body = s("int v", F.col("c").cast("string"), " = ", F.col("c").cast("string"), "; // set\ninit", (k % 5).cast("string"), "();\n", nested, "\nswitch (mode) { case ", (k % 3).cast("string"), ": f", (k % 4).cast("string"), "(); break; default: g(); }\nwhile (n < ", F.col("c").cast("string"), ") step(", k.cast("string"), ");\nreturn v", F.col("c").cast("string"), ";")
    return o.select("name", body.alias("body"))


@query(
    f"""
    with {SHAPE_SQL},
    n as (select k, 0 as node, -1 as parent, '' as branch, 0 as depth, 'assign' as kind, 'int v' || c || ' = ' || c as text, '' as detail, 0 as last from o
      union all select k, 1, -1, '', 0, 'call', 'init' || (k % 5), '', 1 from o
      union all select k, 2 * i, case when i = 1 then -1 else 2 * i - 2 end, case when i = 1 then '' else 'true' end, i - 1, 'if', name || i || ' > ' || (k % 100), case when i = 1 and e = 1 then 'else' else '' end, 2 * m + 1 + case when i = 1 then e else 0 end from lv
      union all select k, 2 * i + 1, 2 * i, 'true', i, 'call', 't' || i, '', 2 * i + 1 from lv
      union all select k, 2 * m + 2, 2, 'false', 1, 'call', 'e' || k, '', 2 * m + 2 from o where e = 1
      union all select k, 2 * m + e + 2, -1, '', 0, 'switch', 'mode', '', 2 * m + e + 6 from o
      union all select k, 2 * m + e + 3, 2 * m + e + 2, 'case', 1, 'case', (k % 3)::text, '', 2 * m + e + 4 from o
      union all select k, 2 * m + e + 4, 2 * m + e + 3, 'case', 1, 'call', 'f' || (k % 4), '', 2 * m + e + 4 from o
      union all select k, 2 * m + e + 5, 2 * m + e + 2, 'case', 1, 'default', '', '', 2 * m + e + 6 from o
      union all select k, 2 * m + e + 6, 2 * m + e + 5, 'default', 1, 'call', 'g', '', 2 * m + e + 6 from o
      union all select k, 2 * m + e + 7, -1, '', 0, 'loop', 'n < ' || c, 'while', 2 * m + e + 8 from o
      union all select k, 2 * m + e + 8, 2 * m + e + 7, 'body', 1, 'call', 'step', '', 2 * m + e + 8 from o
      union all select k, 2 * m + e + 9, -1, '', 0, 'return', 'v' || c, '', 2 * m + e + 9 from o)
    select k::text as function, node::int as node, parent::int as parent, branch, depth::int as depth, kind, text, detail, last::int as last,
      (case when kind in ('case', 'default') then 1 when branch in ('case', 'default') then 2 else depth end)::int as enclosing from n
    """
)
def flow_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_tree(_bodies(spark, sf_dir)).withColumn("enclosing", F.size("path")).drop("path")


@query(
    f"""
    with {SHAPE_SQL},
    init as (select k, 'init' || (k % 5) as f from o),
    cases as (select k, m + 1 - i as case_no, i, 'true' as way from lv
      union all select k, m + 1, 1, 'false' from o where e = 1
      union all select k, m + e + j, 0, w from o, (values (1, 'case'), (2, 'default'), (3, 'body'), (4, 'none')) as w(j, w)
      union all select k, m + e + 5, 0, 'guard' from o where name = 'err_' and m > 0),
    s as (select k, case_no, 0 as p, f || '() 호출' as action, f || ' 정상 실행 확인' as expected from cases join init using (k)
      union all select c.k, case_no, 10 * lv.i, '조건 충족 설정: ' || name || lv.i || ' > ' || (c.k % 100), '조건 분기 → True 경로 진입' from cases c join lv on c.k = lv.k and c.way = 'true' and lv.i <= c.i
      union all select c.k, case_no, 10 * lv.i + 1, 't' || lv.i || '() 호출 확인', 't' || lv.i || ' 정상 실행' from cases c join lv on c.k = lv.k and c.way = 'true' and lv.i <= c.i
      union all select c.k, case_no, 1, '조건 미충족 설정: NOT (' || name || '1 > ' || (c.k % 100) || ')', '조건 분기 → False/else 경로 진입' from cases c join o using (k) where way = 'false'
      union all select k, case_no, 2, 'e' || k || '() 호출 확인', 'e' || k || ' 정상 실행' from cases where way = 'false'
      union all select k, case_no, 1, 'mode = ' || (k % 3) || ' 설정', 'switch 분기 → case ' || (k % 3) || ' 진입' from cases where way = 'case'
      union all select k, case_no, 2, 'f' || (k % 4) || '() 호출 확인', 'f' || (k % 4) || ' 정상 실행' from cases where way = 'case'
      union all select k, case_no, 1, 'mode = 정의되지 않은 값 설정', 'switch 분기 → default 진입' from cases where way = 'default'
      union all select k, case_no, 2, 'g() 호출 확인', 'g 정상 실행' from cases where way = 'default'
      union all select c.k, case_no, 1, 'while 루프 조건 설정: n < ' || o.c, '루프 정상 진입' from cases c join o using (k) where way = 'body'
      union all select k, case_no, 2, '루프 내 step() 호출 확인', 'step 반복 실행 확인' from cases where way = 'body'
      union all select c.k, case_no, 1, 'while 루프 즉시 종료 조건 설정: NOT (n < ' || o.c || ')', '루프 미진입 (0회 반복)' from cases c join o using (k) where way = 'none'
      union all select c.k, case_no, 1, '함수 반환값 확인', '반환값: v' || o.c from cases c join o using (k) where way = 'guard'
      union all select c.k, case_no, 10 * lv.i, '에러 조건 설정: ' || name || lv.i || ' > ' || (c.k % 100), '에러 처리 경로 진입' from cases c join lv on c.k = lv.k where way = 'guard'
      union all select k, case_no, 100, '에러 처리 결과 확인', '에러 상태 반환 또는 안전 동작 수행' from cases where way = 'guard')
    select k::text as function, case_no::int as case_no, row_number() over (partition by k, case_no order by p)::int as step_no, action, expected from s
    """
)
def branch_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches.branch_steps(flow.flow_trees(_bodies(spark, sf_dir)), most_cases=None, most_steps=None)


@query(
    """
    with b as (select p_partkey as k, case p_partkey % 3 when 0 then 'uint8_t' when 1 then 'Opaque' else 'bit' end as t, p_partkey % 4 = 0 as guard, p_partkey % 4 in (1, 2) as clamp from part),
    s(strategy, j) as (values ('min_inv', 1), ('min', 2), ('mid', 3), ('max', 4), ('max_inv', 5)),
    v as (select b.*, s.*, case when t = 'bit' then [-1, 0, 0, 1, 2] else [-1, 0, 127, 255, 256] end as bounds, guard or clamp or t <> 'Opaque' as held from b, s)
    select k::text as function, 'u8_x' as name, strategy,
      case when t = 'bit' and j in (1, 5) then bounds[4]::text when held and j = 1 then bounds[2]::text when held and j = 5 then bounds[4]::text
        when j in (1, 5) then '[검증 필요] ' || bounds[j] else bounds[j]::text end as expected from v
    """
)
def guarded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an output reads under each strategy, guarded, clamped (flat and nested) or plain by the part's key."""
    k = F.col("p_partkey")
    body = F.when(k % 4 == 0, F.concat(F.lit("if (u8_x > "), k.cast("string"), F.lit(") { f(); }"))).when(k % 4 == 1, F.lit("u8_x = MAX_X;")).when(k % 4 == 2, F.lit("while (go) { if (z) { u8_x = MIN_X; } }")).otherwise(F.lit("g(u8_x);"))
    part = table(spark, sf_dir, "part").select(k.cast("string").alias("name"), body.alias("body"), F.when(k % 3 == 0, "uint8_t").when(k % 3 == 1, "Opaque").otherwise("bit").alias("type"))
    facts = branches.guards_and_clamps(flow.flow_tree(part), part.select(F.col("name").alias("function"), F.lit("u8_x").alias("name")))
    return branches.expected_values(facts.join(part.select(F.col("name").alias("function"), "type"), "function"))


@query(
    """
    with o as (select o_orderkey as k, o_custkey as t, ['<', '>', '<=', '>=', '==', '!='][o_orderkey % 6 + 1] as op from orders)
    select k::text as function, 'u8_a' as name, op, '0x' || printf('%X', t) as threshold,
      (t + case op when '<' then -1 when '>' then 1 when '!=' then 1 else 0 end)::double as true_value,
      (t + case op when '<=' then 1 when '==' then 1 when '>=' then -1 else 0 end)::double as false_value from o
    union all
    select k::text, 's16_b', op, 'other', (case op when '<' then -32768 when '<=' then -32768 when '==' then 0 when '!=' then -32768 else 32767 end)::double,
      (case op when '<' then 32767 when '<=' then 32767 when '==' then -32768 when '!=' then 0 else -32768 end)::double from o
    """
)
def decision_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that make comparisons with a number and with a name true and false; the second stands in an else."""
    o = table(spark, sf_dir, "orders")
    op = F.element_at(F.array(*[F.lit(x) for x in ("<", ">", "<=", ">=", "==", "!=")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    body = F.concat(F.lit("if (u8_a "), op, F.lit(" 0x"), F.hex("o_custkey"), F.lit(") { f(); } else if ((s16_b "), op, F.lit(" other)) { g(); h(); }"))
    tree = flow.flow_tree(o.select(F.col("o_orderkey").cast("string").alias("name"), body.alias("body")), spread=spark.sparkContext.defaultParallelism)
    return branches.decision_values(tree).drop("node")


DECLARED_SQL = """
    with c as (select c_custkey as k, c_nationkey as n from customer)
    select k::text as path, 'variable' as kind, 'a' || k as name, 'const U8' as type, '' as array, n::text as init, true as is_static from c
    union all select k::text, 'variable', 'b' || k, 'const U8 *', '', null, true from c
    union all select k::text, 'variable', 't' || k, 'const U8', '[3]', '{ 1, 2 }', true from c
    union all select k::text, 'variable', 's' || n, 'int', '', null, false from c
    union all select k::text, 'static local', 'h' || k, 'int', '', '1', true from c where k % 2 = 0
    union all select k::text, 'prototype', 'p' || k, 'int', '', 'int (*cb)(int, char), map<a, b> m', false from c
    union all select k::text, 'parameter', 'cb', 'int (*)(int, char)', '', 'INOUT', false from c
    union all select k::text, 'parameter', 'm', 'map<a, b>', '', 'IN', false from c
"""


@query(DECLARED_SQL)
def declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of statements with several names, statics inside functions, prototypes, and parameters with nested brackets."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(
        F.lit("#define S struct { int x; }\nstatic const U8 a"), k, F.lit(" = "), n, F.lit(",\n  *b"), k, F.lit(", t"), k, F.lit("[3] = { 1, 2 }; /* ; */\nextern int s"), n, F.lit(";\nint p"), k,
        F.lit("(int (*cb)(int, char), map<a, b> m);\nint p"), k, F.lit("(int (*cb)(int, char), map<a, b> m) {\n  for (int i = 0; i < 3; i++) { "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("static int h"), k, F.lit(" = 1;"))).otherwise(""), F.lit(" }\n  return h == 1;\n}\n"),
    )
    # The keys come in few tasks; each of them becomes a text to read.
    files = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition(spark.sparkContext.defaultParallelism).select(k.alias("path"), text.alias("text"))
    found = code.functions(files)
    variables = flow.declarations(flow.statements(files)).filter("depth = 0").select("path", F.lit("variable").alias("kind"), "name", "type", "array", "init", "is_static")
    local = flow.static_locals(found).select(F.regexp_extract("function", r"(\d+)", 1).alias("path"), F.lit("static local").alias("kind"), "name", "type", F.lit("").alias("array"), "init", F.lit(True).alias("is_static"))
    declared = flow.prototypes(files).select("path", F.lit("prototype").alias("kind"), "name", F.col("returns").alias("type"), F.lit("").alias("array"), F.col("parameters").alias("init"), F.lit(False).alias("is_static"))
    given = code.parameters(found).select(F.regexp_extract("function", r"(\d+)", 1).alias("path"), F.lit("parameter").alias("kind"), "name", "type", F.lit("").alias("array"), F.col("direction").alias("init"), F.lit(False).alias("is_static"))
    return variables.unionByName(local).unionByName(declared).unionByName(given)


@query(
    """
    with p as (select p_partkey as k, p_partkey - p_partkey % 8 as b, p_partkey % 8 as j from part),
    v as (select k, j, b, b as v0, (b + 2) * 3 as v1 from p),
    w as (select *, v1 * 2 as v2 from v), x as (select *, v2 + v1 as v3, (v2 + v1) // 4 as v4 from w),
    y as (select *, case when v4 % 2 = 1 then 7 else 6 end as v5 from x)
    select 'P' || k as name,
      case j when 0 then v0 when 1 then v1 when 2 then v2 when 3 then v3 when 4 then v4 when 5 then v5 when 6 then 64 | 3 end as value,
      case j when 0 then '0x' || printf('%x', k) when 1 then '(' || v0 || ' + 2) * 3' when 2 then v1 || ' << 1' when 3 then v2 || ' - -' || v1
        when 4 then v3 || ' / 4' when 5 then v4 || ' & 1 | 6' when 6 then '1 << 6 | 3 && 0 | 3' else 'unknown + ' || v5 end as text from y
    """.replace("1 << 6 | 3 && 0 | 3", "(1 << 6) | (5 - 2 * 1)")
)
def macro_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros that lean on one another: chains of six, precedence, brackets, and names that nothing defines."""
    k = F.col("p_partkey")
    at = lambda d: F.concat(F.lit("P"), (k - d).cast("string"))
    j = k % 8
    value = F.when(j == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(j == 1, F.concat(F.lit("("), at(1), F.lit(" + 2) * 3"))).when(j == 2, F.concat(at(1), F.lit(" << 1"))).when(j == 3, F.concat(at(1), F.lit(" - -"), at(2)))
    value = value.when(j == 4, F.concat(at(1), F.lit(" / 4"))).when(j == 5, F.concat(at(1), F.lit(" & 1 | 6"))).when(j == 6, F.lit("(1 << 6) | (5 - 2 * 1)")).otherwise(F.concat(F.lit("unknown + "), at(2)))
    return code.constants(table(spark, sf_dir, "part").select(at(0).alias("name"), value.alias("value")))


@query(
    """
    with v as (select p_partkey as k, ['U8', 'S16', 'struct T'][p_partkey % 3 + 1] as type, case p_partkey % 4 when 0 then 'LIM_MAX' when 1 then 'ONE' when 2 then p_size::text end as init, p_size as s from part),
    r as (select *, case when k % 5 = 0 then s || ' ~ LIM_MAX' when init = 'LIM_MAX' then '4 ~ 300' when init = 'ONE' then '1' when type = 'U8' then '0 ~ 255' when type = 'S16' then '-32768 ~ 32767' else coalesce(init, '3 ~ 0x1F') end as text,
      case when k % 5 = 0 then 'comment' when init = 'LIM_MAX' then 'macro pair' when init = 'ONE' then 'macro' when type in ('U8', 'S16') then 'type' when init is not null then 'init' else 'declaration' end as source from v),
    e as (select *, case source when 'comment' then s when 'macro pair' then 4 when 'macro' then 1 when 'init' then s when 'declaration' then 3 when 'type' then case type when 'U8' then 0 else -32768 end end as low,
      case source when 'comment' then 300 when 'macro pair' then 300 when 'macro' then 1 when 'init' then s when 'declaration' then 31 when 'type' then case type when 'U8' then 255 else 32767 end end as high from r)
    select 'v' || k as name, low::bigint as low, high::bigint as high, text, source, coalesce(type = 'U8' and high > 255, false) as outside_type from e
    """
)
def variable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of variables declared in text that is written from parts, by the first source that tells one."""
    k, name = F.col("p_partkey"), F.concat(F.lit("v"), F.col("p_partkey").cast("string"))
    size = F.col("p_size").cast("string")
    text = F.concat(F.when(k % 5 == 0, F.concat(F.lit("/* size\n * Range: "), size, F.lit(" ~ LIM_MAX\n */\n"))).otherwise(""), F.lit("int "), name, F.lit(";\n"))
    part = table(spark, sf_dir, "part")
    comments = ranges.range_comments(part.select(name.alias("path"), text.alias("text")))
    kind = F.element_at(F.array(F.lit("U8"), F.lit("S16"), F.lit("struct T")), (k % 3 + 1).cast("int"))
    init = F.when(k % 4 == 0, F.lit("LIM_MAX")).when(k % 4 == 1, F.lit("ONE")).when(k % 4 == 2, size)
    defines = spark.createDataFrame([("LIM_MIN", "2 + 2"), ("LIM_MAX", "300"), ("ONE", "1")], "name string, value string")
    return ranges.value_ranges(part.select(name.alias("name"), kind.alias("type"), init.alias("init"), F.lit("3 ~ 0x1F").alias("declared")), code.constants(defines), comments)


@query(
    """
    with l as (select l_orderkey as o, l_linenumber as n, l_partkey as p from lineitem),
    e as (select a.p as src, b.p as dst, min(a.o * 10 + a.n) as ord from l a join l b on a.o = b.o and b.n = a.n + 1 where a.p <> b.p group by 1, 2),
    w as (select src, count(*) as calls from e group by 1),
    x as (select e.*, w.calls from e join part s on s.p_partkey = e.src join part d on d.p_partkey = e.dst left join w on w.src = e.dst where s.p_brand = d.p_brand),
    h0 as (select p_partkey as f, lower(p_type) as v from part where p_size % 3 = 0),
    h1 as (select x.src as f, v, arg_min(x.dst, (ord, x.dst::text)) as via, arg_min(x.dst, (ord, x.dst::text)) as origin from x join h0 on h0.f = x.dst group by 1, 2),
    n1 as (select * from h1 where not exists (from h0 where h0.f = h1.f and h0.v = h1.v)),
    h2 as (select x.src as f, v, arg_min(x.dst, (ord, x.dst::text)) as via, arg_min(n1.origin, (ord, x.dst::text)) as origin from x join n1 on n1.f = x.dst where calls <= 30 group by 1, 2)
    select f::text as function, v as variable, 0 as hop, null as via, f::text as origin from h0
    union all select f::text, v, 1, via::text, origin::text from n1
    union all select f::text, v, 2, via::text, origin::text from h2 where not exists (from h0 where h0.f = h2.f and h0.v = h2.v) and not exists (from n1 where n1.f = h2.f and n1.v = h2.v)
    """
)
def propagated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as variables that parts hold, carried along the lines of orders inside brands: two hops, bridges of up to 30 callees."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    after = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").cast("string").alias("dst"))
    edges = l.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").cast("string").alias("src"), "dst", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    part = table(spark, sf_dir, "part")
    facts = part.filter("p_size % 3 = 0").select(F.col("p_partkey").cast("string").alias("function"), F.lit("global").alias("kind"), F.lower("p_type").alias("variable"))
    return graph.propagated(edges, part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("module")), facts, 2, 30).drop("kind")


RUNS_SQL = """
    o as (select o_orderkey as k, o_custkey as doc, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders semi join lineitem on l_orderkey = o_orderkey),
    l as (select l_orderkey as k, 'F' || (l_suppkey % 6) as name, min_by({'n': [l_partkey % 3, l_linenumber % 2], 'flag': l_returnflag}, (l_partkey % 3) || ',' || (l_linenumber % 2) || ',' || l_returnflag) as e from lineitem group by 1, 2),
    a as (select o.doc, o.k, o.prev, l.name, l.e from o join l using (k)), b as (select o.doc, o.k, o.prev, l.name, l.e from o join l on l.k = o.prev),
    d as (select coalesce(a.doc, b.doc) as doc, coalesce(a.k, b.k) as k, coalesce(a.prev, b.prev) as prev, coalesce(a.name, b.name) as name, a.e as new, b.e as old,
        case when b.name is null then 'created' when a.name is null then 'removed' when a.e <> b.e then 'changed' end as change
      from a full join b on a.k = b.k and a.name = b.name)
"""


def _line_parts(spark: SparkSession, sf_dir: str) -> int:
    return parts_of(table(spark, sf_dir, "lineitem"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their customers' documents; suppliers as entries with a list and a text."""
    # Where the tables are shuffled, lines follow the orders into as many parts.
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(_line_parts(spark, sf_dir), "o_orderkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit(" F"), (F.col("l_suppkey") % 6).cast("string")).alias("name"), F.array(F.col("l_partkey") % 3, (F.col("l_linenumber") % 2).cast("long")).alias("calls"), F.concat("l_returnflag", F.lit(" ")).alias("level"))  # noqa: E741
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query(
    f"""
    with {RUNS_SQL}
    select doc as o_custkey, k as o_orderkey, prev as previous_run, name, change,
      case when change = 'changed' then concat_ws(',', case when new.n <> old.n then 'calls' end, case when new.flag <> old.flag then 'level' end) else change end as fields_changed, old.flag as level_before, new.flag as level_after, case when new is null then null else len(new.n) end::int as calls_after
    from d where change is not null
    """
)
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog.change_log(_entries(spark, sf_dir), "o_custkey", "o_orderkey", ["o_orderdate"], "name", ["calls", "level"], _line_parts(spark, sf_dir))
    return log.select("o_custkey", "o_orderkey", "previous_run", "name", "change", F.array_join("fields_changed", ",").alias("fields_changed"), F.col("before.level").alias("level_before"), F.col("after.level").alias("level_after"), F.col("after.calls_count").alias("calls_after"))


@query(
    f"""
    with {RUNS_SQL}
    select o.doc as o_custkey, o.k as o_orderkey, o.prev as previous_run, case when count(change) > 0 then 'completed' else 'unchanged' end as status,
      count(*) filter (change = 'created') as created, count(*) filter (change = 'removed') as removed, count(*) filter (change = 'changed') as changed
    from o left join d using (k) group by 1, 2, 3
    """
)
def change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, parts = _entries(spark, sf_dir), _line_parts(spark, sf_dir)
    log = changelog.change_log(entries, "o_custkey", "o_orderkey", ["o_orderdate"], "name", ["calls", "level"], parts)
    return changelog.change_totals(log, entries, "o_custkey", "o_orderkey", ["o_orderdate"], parts)


@query(
    """
    with e as (select user_id as job, ts, case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then null else 'running' end as status from events),
    f as (select *, last_value(status ignore nulls) over (partition by job order by ts rows between unbounded preceding and current row) as now, epoch_us(lead(ts) over (partition by job order by ts)) - epoch_us(ts) as gap from e)
    select job, arg_max(now, ts) as status, min(ts) filter (now = 'running') as started_at, max(ts) as updated_at, max(ts) filter (now in ('completed', 'failed')) as finished_at, count(*) as updates,
      count(*) filter (coalesce(now not in ('completed', 'failed'), true) and gap > 21600000000) as stalls from f group by job
    """
)
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: views are heartbeats, and six hours without any event stall a job that is not finished."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") != "view", "running")
    return jobs.job_history(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", status.alias("status")), 21_600)


@query(
    """
    with u as (select user_id as key, ts, value from events where event_type in ('signup', 'click')), r as (select user_id as key, ts, event_id from events where event_type not in ('signup', 'click'))
    select r.key, r.ts, r.event_id, case when epoch_us(r.ts) - epoch_us(u.ts) <= 86400000000 then u.value end as value, coalesce(epoch_us(r.ts) - epoch_us(u.ts) <= 86400000000, false) as hit
    from r asof left join u on r.key = u.key and r.ts >= u.ts
    """
)
def read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and signups set a user's entry for a day; every other event reads it."""
    events, sets = table(spark, sf_dir, "events").withColumn("key", F.col("user_id")), F.col("event_type").isin("signup", "click")
    return jobs.read_through(events.filter(~sets).select("key", "ts", "event_id"), events.filter(sets).select("key", "ts", "value"), 86_400)


@query(
    """
    with p as (select p_partkey as k, p_partkey % 12 as j, p_partkey % 7 as o, p_partkey // 12 % 40 as f, p_size % 3 as d, p_partkey % 2 = 0 as is_global from part),
    e as (select 'u' || f as function, k as ordinal, d = 2 as indirect,
        case j when 0 then 'u8g_In' || o when 1 then 'u16s_Out' || o when 2 then 'REG_P' || o when 3 then 'g_State' || o when 4 then 'plain' || o when 5 then 'other' || o when 6 then 'tagged' || o when 9 then 'r_x' || o else null end as name, j, is_global from p),
    r as (select *, case when j = 5 then true when j = 6 then false when j = 1 then false when j in (0, 2, 3, 9) then not indirect else is_global and not indirect end as reads,
      case when j = 5 then false when j = 6 then true when j = 1 then true when j = 0 then false when j in (2, 3, 9) then true else not is_global end as writes from e where name is not null)
    select function, name, min(ordinal)::int as ordinal, bool_or(reads) as reads, bool_or(writes) as writes, bool_or(indirect) as indirect from r group by 1, 2
    """
)
def variable_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by tags, prefixes, registers and kinds; temporaries, types and short names are left out."""
    k, o = F.col("p_partkey"), (F.col("p_partkey") % 7).cast("string")
    name = F.element_at(F.array(*[F.concat(F.lit(p), o) for p in ("u8g_In", "u16s_Out", "REG_P", "g_State", "plain", "other", "tagged", "tmp_x", "U8; ", "r_x", "9lives", "ab")]), (k % 12 + 1).cast("int"))
    name = F.when(k % 12 == 8, F.lit("const U8")).when(k % 12 == 11, F.lit("ab")).otherwise(name)
    tag = F.concat(F.when(F.col("p_size") % 3 == 2, "[INDIRECT] ").otherwise(""), F.when(k % 12 == 5, "[IN] ").when(k % 12 == 6, "[OUT] ").otherwise(""), F.lit("U8 *"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("u"), (F.floor(k / 12) % 40).cast("string")).alias("function"), k.cast("int").alias("ordinal"), F.when(k % 2 == 0, "global").otherwise("static").alias("kind"), F.concat(tag, name, F.lit(";")).alias("entry"))
    return units.variable_roles(rows)


@query(
    """
    with p as (select p_partkey as f, p_size % 4 as n_in, p_size % 3 as n_glob, case when p_partkey % 2 = 0 then 'uint8' else 'int16' end as kind from part),
    b as (select *, case kind when 'uint8' then [-1, 0, 63, 127, 191, 255, 256] else [-32769, -32768, -16384, 0, 16383, 32767, 32768] end::double[] as v from p),
    fed as (select * from b where n_in > 0),
    c as (select f, n_in, n_glob, v, k + 1 as num, 'b' as part, k as t from fed, range(7) r(k)
      union all select f, n_in, n_glob, v, 8 + t, 'c', t from fed, range(3) r(t) where n_in >= 2 and t < n_in
      union all select f, n_in, n_glob, v, 8 + case when n_in >= 2 then n_in else 0 end + t, 'e', t from fed, range(2) r(t)
      union all select f, n_in, n_glob, v, 10 + case when n_in >= 2 then n_in else 0 end + t, 'g', t from fed, range(2) r(t) where t < n_glob),
    d as (select *, case part when 'b' then (t + 1)::varchar when 'c' then 'COND_' || (t + 1) || ' [in' || t || '=' || case when t % 2 = 0 then '최솟값' else '최댓값' end || ']' when 'e' then 'ERR_PROP_' || (t + 1) || ' [' || case when t = 0 then '하한 초과' else '상한 초과' end || ']' else 'GLOBAL_' || (t + 1) || ' [glob' || t || '=min]' end as label,
      case part when 'b' then ['bench', 'car'][t % 2 + 1] when 'c' then '조건 조합: in' || t || '=' || case when t % 2 = 0 then '최솟값' else '최댓값' end || ', 나머지=중간값' when 'e' then '에러 전파: 입력 ' || case when t = 0 then '하한 초과' else '상한 초과' end || ' → 콜체인 방어 처리 확인' else '글로벌 상태: glob' || t || '=최솟값, 입력=중간값 → 상태 의존 분기 커버' end as pre from c where num <= 12),
    i as (select f, num, label, pre, 'input' as side, 'in' || o as name, case part when 'b' then v[t + 1] when 'c' then case when o <> t then v[4] when t % 2 = 0 then v[2] else v[6] end when 'e' then case when t = 0 then v[1] else v[7] end else v[4] end as value from d, range(3) r(o) where o < n_in
      union all select f, num, label, pre, 'expected', 'out', case part when 'b' then case t when 0 then v[2] when 6 then v[4] else v[t + 1] end when 'e' then case when t = 0 then v[2] else v[6] end else v[4] end from d
      union all select f, num, label, pre, unnest(['input', 'expected']), 'glob' || t, v[2] from d where part = 'g')
    select f::bigint as flow, num::int as case_num, label as case_label, pre as precondition, side, name, value::varchar as value from i
    union all
    select f, k + 1, (k + 1)::varchar, ['bench', 'car'][k % 2 + 1], unnest(['input', 'expected']), unnest(['Scenario', 'out']), unnest([['Normal operation', 'Boundary condition', 'Error / fault injection', 'Post-initialization state', 'Concurrent invocation', 'Recovery sequence', 'Stress / extended run'][k + 1], 'N/A']) from b, range(7) r(k) where n_in = 0
    """
)
def integration_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-cases of flows with none to three inputs and none to two globals, twelve a flow at most."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("flow"), (F.col("p_size") % 4).alias("n_in"), (F.col("p_size") % 3).alias("n_glob"), F.when(F.col("p_partkey") % 2 == 0, "uint8").otherwise("int16").alias("kind"))
    side = lambda s, n, name: part.filter(n > 0).select("flow", F.lit(s).alias("side"), F.explode(F.sequence(F.lit(0), n - 1)).alias("ordinal"), "kind").select("flow", "side", "ordinal", F.concat(F.lit(name), F.col("ordinal").cast("string")).alias("name"), "kind")
    out = part.select("flow", F.lit("expected").alias("side"), F.lit(0).alias("ordinal"), F.lit("out").alias("name"), "kind")
    variables = side("input", F.col("n_in"), "in").unionByName(side("global", F.col("n_glob"), "glob")).unionByName(out)
    return units.integration_cases(part, variables, 12, ["bench", "car"])


@query(
    """
    with c as (select l_suppkey as unit, l_linenumber % 5 = 0 or l_partkey % 3 = 0 as no_title, l_quantity < 26 as no_step, l_partkey % 2 as seqs, l_suppkey % 4 = 0 and l_linenumber = 1 or l_suppkey % 4 = 1 as linked from lineitem),
    g as (select unit, count(*) as total, count(*) filter (no_title) as nt, count(*) filter (no_step) as ns, sum(seqs) as seqs, count(*) filter (linked) as nl from c group by 1)
    select unit, 'issue' as level, 'title' as check, nt as n, total from g where nt > total * 0.3
    union all select unit, 'warning', 'step', ns, total from g where ns > total * 0.5
    union all select unit, 'issue', 'cases range', total, total from g where total < 580 or total > 620
    union all select unit, 'issue', 'seqs range', seqs, total from g where seqs < 290 or seqs > 320
    union all select unit, 'warning', 'linked', 0, total from g where nl = 0
    """
)
def case_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as cases of their suppliers: titles, steps, numbers and links that they lack."""
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    cases = table(spark, sf_dir, "lineitem").select(s.alias("unit"), ((n % 5 == 0) | (F.col("l_partkey") % 3 == 0)).alias("no_title"), (F.col("l_quantity") < 26).alias("no_step"), (F.col("l_partkey") % 2).alias("seqs"), (((s % 4 == 0) & (n == 1)) | (s % 4 == 1)).alias("linked"))
    return units.case_checks(cases, ["unit"], {"title": (F.col("no_title"), 0.3, "issue"), "step": (F.col("no_step"), 0.5, "warning")}, {"cases": (580, 620), "seqs": (290, 320)})


@query(
    """
    select doc_id, round(n_chars / 1000.0 + case when lang = 'en' then 0.15 else 0 end + case when source = 'src1' then 0.1 else 0 end + case when contains(coalesce(text, '') || ' ' || coalesce(source, ''), 'src7') then 0.25 else 0 end
      + case when source in ('src3', 'src1', 'src11') then 0.3 else 0 end + 0.02 * (doc_id % 5) + 0.01 * coalesce(nullif(doc_id % 3, 0), 0), 9) as score from documents
    """
)
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores raised for role, stage, ids, project, applications and errors."""
    hits = table(spark, sf_dir, "documents").select("doc_id", "text", "source", (F.col("n_chars") / 1000.0).alias("score"), F.col("lang").alias("role"), F.col("source").alias("stage"), F.col("source").alias("project_root"), (F.col("doc_id") % 5).alias("apply_count"), F.nullif(F.col("doc_id") % 3, F.lit(0)).alias("error_count"))
    out = search.boosted(hits, "en", "src1", ["src7"], ["text", "source"], project=("builds of src3 and src11", 0.3), applied=0.02, errors=0.01, exact=0.25)
    return out.select("doc_id", F.round("score", 9).alias("score"))


@query(
    """
    with p as (select p_partkey as k, p_name, p_type, p_size, unnest(case when p_partkey % 10 = 0 then [0] else [1, 2] end) as page from part)
    select k::varchar as path, case when page > 0 then page end as page, case page when 1 then p_name || chr(10) || 'Size (' || p_size || ')' when 2 then p_type || ' of ' || k end as text, case when page = 0 then case when k % 20 = 0 then 'no PDF header' else 'encrypted' end end as error from p
    """
)
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two pages that are written from parts; a tenth is no PDF or encrypted."""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    k = F.col("p_partkey")
    text = say(
        F.when(k % 20 == 0, "%PS-1.4\n").otherwise("%PDF-1.4\n"), "1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [5 0 R 3 0 R] /Count 2 >> endobj\n3 0 obj << /Type /Page /Contents 4 0 R >> endobj\n",
        "4 0 obj << /Length 0 >>\nstream\nBT /F1 9 Tf [(", F.col("p_type"), ")-400(of)] TJ ( ", k.cast("string"), ") Tj ET\nendstream\nendobj\n5 0 obj << /Type /Page /Contents [6 0 R] >> endobj\n6 0 obj << /Length 0 >>\nstream\nBT (", F.col("p_name"), ") Tj 0 -12 Td (Size \\(",
        F.col("p_size").cast("string"), "\\)) Tj ET\nendstream\nendobj\ntrailer << /Root 1 0 R ", F.when(k % 20 == 10, "/Encrypt 7 0 R").otherwise(""), " >>",
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return pdf.pages(part.select(k.cast("string").alias("path"), text.cast("binary").alias("content")))


@query(
    """
    with p as (select p_partkey as k, ['s_DiagCheck', 'g_u8_Motor_Init', 'ReadSpeedValue', 'plain_thing', 'SetOutputPin', 'X_TimerTick'][p_partkey % 6 + 1] as name, case when p_size % 3 = 0 then [] when p_size % 3 = 1 then ['f' || p_size] else ['a', ' ', 'b', 'c', 'd', 'e', 'f'] end as calls, p_size from part)
    select k, name || ': ' || ['Diag Check', 'u8 Motor Init', 'Read Speed Value', 'plain thing', 'Set Output Pin', 'X Timer Tick'][k % 6 + 1] || ' 모듈에서 '
        || ['상태를 점검하고 진단 결과를 갱신한다', '초기화 절차를 수행하고 기본 파라미터를 설정한다', '요청된 데이터를 읽어 반환한다', '소프트웨어 유닛의 지정된 동작을 수행한다', '지정된 값을 대상 레지스터 또는 메모리에 기록한다', '주기적 타이머 이벤트를 처리한다'][k % 6 + 1] || '.'
        || case p_size % 3 when 0 then '' when 1 then ' 주요 호출 대상: f' || p_size || '.' else ' 주요 호출 대상: a, b, c, d, e.' end as description,
      case p_size % 4 when 0 then 'if (!sys_ready)' when 1 then 'if (p == NULL); if (mode != 0x' || k || ')' when 2 then 'assert(p_size > ' || p_size || ')' else case when k % 6 = 1 then 'N/A (initialization function)' else '' end end as precondition from p
    """
)
def function_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions from names and calls, and preconditions from bodies."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.element_at(F.array(*[F.lit(n) for n in ("s_DiagCheck", "g_u8_Motor_Init", "ReadSpeedValue", "plain_thing", "SetOutputPin", "X_TimerTick")]), (k % 6 + 1).cast("int"))
    calls = F.when(size % 3 == 0, F.array().cast("array<string>")).when(size % 3 == 1, F.array(F.concat(F.lit("f"), size.cast("string")))).otherwise(F.array(*[F.lit(c) for c in ("a", " ", "b", "c", "d", "e", "f")]))
    body = F.when(size % 4 == 0, F.lit("if (!sys_ready) { return; }")).when(size % 4 == 1, F.concat(F.lit("if (p == NULL) return; if (mode != 0x"), k.cast("string"), F.lit(") { x = 1; }"))).when(size % 4 == 2, F.concat(F.lit("assert(p_size > "), size.cast("string"), F.lit("); go();"))).otherwise(F.lit("x = y;"))
    return table(spark, sf_dir, "part").select(k.alias("k"), descriptions.described(name, calls).alias("description"), descriptions.precondition(body, name).alias("precondition"))


@query(
    """
    with u as (select s_suppkey as k, 'u' || s_suppkey as unit, case when s_suppkey % 3 = 0 then [] when s_suppkey % 3 = 1 then ['a', 'b'] else ['a', 'b', 'c', 'd', 'e', 'f', 'g'] end as calls, s_suppkey % 4 as g, s_suppkey % 2 = 0 as is_void, s_suppkey % 5 as n from supplier),
    r as (select *, unnest([1, 2, 3, 4]) as seq from u),
    d as (select k, unit, n, seq, ['NORMAL_CALL', 'ERROR_PATH', 'REPEAT_CALL', 'RETURN_CHECK'][seq] as strategy,
        case seq when 1 then unit || '() 정상 호출:' || case len(calls) when 0 then ' 예외 없이 완료되며 호출 후 상태 이상 없음' when 2 then ' 하위 함수 [a(), b()] 순차 호출 확인' else ' 하위 함수 [a(), b(), c(), d(), e() 외 2개] 순차 호출 확인' end
          when 2 then unit || '() 에러 경로: ' || case when g = 0 then '조건 [x > ' || k || '] 위반 상태에서 호출, ' else '의존 모듈/전역 변수 비정상 상태에서 호출, ' end || '에러 처리 루틴 진입 또는 안전 상태 유지 확인'
          when 3 then unit || '() 반복 호출 안정성: 100회 연속 호출 후 메모리 누수 없음, 시스템 상태 일관성 유지' else unit || '() 반환값 검증: 반환값이 정의된 범위 내 유효한 값임을 확인' end as description from r where seq < 4 or not is_void)
    select unit, seq::int as seq, strategy, description, null as name, null as value, null as expected from d where seq > 2 or n = 0
    union all
    select unit, seq::int, strategy, description, 'u16g_V' || o, (case seq when 1 then 32767 else 65536 end)::double, (case seq when 1 then 32767 else 65535 end)::double from d, range(4) r(o) where seq <= 2 and o < n
    """
)
def void_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of units without inputs and outputs, with none to four variables that their callees reach."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("unit", F.concat(F.lit("u"), k.cast("string")))
    letters = lambda x: F.array(*[F.lit(c) for c in x]).cast("array<string>")
    calls = F.when(k % 3 == 0, letters("")).when(k % 3 == 1, letters("ab")).otherwise(letters("abcdefg"))
    guard = F.when(k % 4 == 0, F.concat(F.lit("x > "), k.cast("string"))).when(k % 4 == 1, F.lit("ready"))
    rows = s.select("unit", F.when(k % 2 == 0, "void").otherwise("static U8").alias("returns"), calls.alias("calls"), guard.alias("guard"))
    far = s.select("unit", F.explode(F.sequence(F.lit(0), (k % 5).cast("int"))).alias("ordinal"), (k % 5).alias("n")).filter("ordinal < n").select("unit", "ordinal", F.concat(F.lit("u16g_V"), F.col("ordinal").cast("string")).alias("name"))
    return generate.void_rows(rows, far)


@query(
    """
    with p as (select p_partkey as k, p_size as s, p_partkey % 3 as level, p_partkey % 2 = 0 as fast from part)
    select k::varchar as path, case when level > 1 then 'deep' when level = 1 and s > 20 then 'mid' else 'flat' end as kept, case when fast then 1 else 0 end as fast, case when s >= 10 and not fast then 'slow_big' else 'rest' end as mode, case when s % 2 = 1 then 1 else 0 end as nested from p
    """
)
def conditioned_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which branches of conditional compilation stay, by definitions in the text."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("#define SIZE "), size, F.lit("\n#define LEVEL ("), (F.col("p_partkey") % 3).cast("string"), F.lit(")\n"), F.when(F.col("p_partkey") % 2 == 0, F.lit("#define FAST\n")).otherwise(""),
        F.lit("#if LEVEL > 1\nint deep;\n#elif LEVEL == 1 && SIZE > 20\nint mid;\n#else\nint flat;\n#endif\n#ifdef FAST\nint fast;\n#ifndef FAST\nint never;\n#else\n#undef FAST\n#endif\n#else\n#define WAS_SLOW 1\n#endif\n#if SIZE >= 10 && \\\n  defined(WAS_SLOW)\nint slow_big;\n#endif\n#if 1\n#if SIZE % 2\nint nested;\n#endif\n#endif\n"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    kept = code.conditioned(part.select(k.alias("path"), text.alias("text")))
    has = lambda name: F.col("text").rlike(rf"(?m)^int {name};$")
    return kept.select("path", F.when(has("never"), "never").when(has("deep"), "deep").when(has("mid"), "mid").when(has("flat"), "flat").alias("kept"), has("fast").cast("int").alias("fast"), F.when(has("slow_big"), "slow_big").otherwise("rest").alias("mode"), has("nested").cast("int").alias("nested"))


@query(
    """
    with p as (select 'f' || p_partkey as function, ['SIGNATURE', 'BODY', 'NEW', 'DELETE', 'VARIABLE', 'HEADER', 'OTHER'][p_size % 7 + 1] as change_type, p_size % 7 + 1 as i from part),
    d as (select function, change_type, 'uds' as document, ['함수 인터페이스 변경 → UDS 입출력/프로토타입 섹션 업데이트 필요', '로직 변경 → UDS 설명/로직 다이어그램 업데이트 필요', '신규 함수 → UDS 신규 섹션 생성 필요', '삭제된 함수 → UDS 해당 섹션 제거 필요', '변수 변경 → UDS 글로벌/로컬 변수 목록 업데이트', '헤더 변경 → UDS 인터페이스/의존성 정보 확인'][i] as felt from p
      union all select function, change_type, 'sds', ['아키텍처 인터페이스 변경 → SDS 모듈 인터페이스 업데이트', '로직 변경 → SDS 설계 설명 업데이트 필요', '신규 컴포넌트 → SDS 설계 추가', '컴포넌트 삭제 → SDS 설계 제거', '변수 변경 → SDS 데이터 흐름/인터페이스 업데이트'][i] from p)
    select document, function, change_type, '[' || function || '] ' || change_type || ' → ' || felt as impact from d where felt is not null
    """
)
def document_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("SIGNATURE", "BODY", "NEW", "DELETE", "VARIABLE", "HEADER", "OTHER")])
    changes = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("function"), F.element_at(kinds, F.col("p_size") % 7 + 1).alias("change_type"))
    return designs.document_impacts(changes, ["uds", "sds"])


@query(
    """
    with r as (select 'scm' || s_suppkey as scm_id, case when s_suppkey % 3 = 0 then 'svn' else 'git' end as scm_type, '/src/' || s_suppkey as source_root, case when s_suppkey % 4 = 0 then 'main' end as entry_ref from supplier),
    f as (select 'scm' || l_suppkey as scm_id, list_sort(list(distinct 'p' || (l_partkey % 9) || '.c')) as files from lineitem group by 1),
    q as (select 'scm' || c_custkey % 120 as scm_id, 't' || c_custkey as trigger_type, case when c_custkey % 5 = 0 then 'v' || c_custkey end as base_ref, c_custkey % 2 = 0 as dry_run, c_custkey % 3 = 0 as by_hand, c_custkey from customer)
    select scm_id, trigger_type, scm_type, source_root, case when r.scm_type is not null then coalesce(q.base_ref, entry_ref, case when scm_type = 'svn' then '' else 'HEAD~1' end) end as base_ref, dry_run,
      case when r.scm_type is null then '' when by_hand then 'm' || c_custkey || '.c' else coalesce(array_to_string(files, ','), '') end as changed_files, r.scm_type is not null as known
    from q left join r using (scm_id) left join f using (scm_id)
    """
)
def change_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests about suppliers' sources; some name files by hand, some ask for unknown sources."""
    scm = lambda c: F.concat(F.lit("scm"), c.cast("string"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    requests = table(spark, sf_dir, "customer").select(scm(c % 120).alias("scm_id"), F.concat(F.lit("t"), c.cast("string")).alias("trigger_type"), F.when(c % 5 == 0, F.concat(F.lit(" v"), c.cast("string"))).alias("base_ref"), (c % 2 == 0).alias("dry_run"), F.when(c % 3 == 0, F.array(F.lit(" "), F.concat(F.lit(" m"), c.cast("string"), F.lit(".c")))).alias("files"))
    registry = table(spark, sf_dir, "supplier").select(scm(s).alias("id"), F.when(s % 3 == 0, "SVN").alias("scm_type"), F.concat(F.lit("/src/"), s.cast("string")).alias("source_root"), F.when(s % 4 == 0, "main").alias("base_ref"))
    changed = table(spark, sf_dir, "lineitem").select(scm(F.col("l_suppkey")).alias("scm_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string"), F.lit(".c")).alias("path"))
    return designs.change_triggers(requests, registry, changed).withColumn("changed_files", F.array_join("changed_files", ","))


@query(
    """
    with s as (select p_brand || '/' || p_partkey // 512 as path, p_partkey as o, ['Motor', 'Pump', 'Valve'][p_partkey % 3 + 1] as m, 'Aux' || p_size % 5 as a, p_partkey % 4 = 0 as direct,
        case when p_partkey % 4 = 0 then 'SwCom_' || p_size % 3 || ': x' when p_partkey % 7 = 0 then 'Revision History' else 'H' || p_partkey % 11 end as heading, 'SwCom_' || p_size % 3 as com from part),
    t as (select *, 'calls g_' || m || '_run then s_' || a || '_go of ' || o as text, ['g_' || m || '_run', 's_' || a || '_go'] as fs, case when direct then [com] else [m, a] end as ms, heading = 'Revision History' as rest from s),
    r as (select path, 'function' as kind, unnest(fs) as title, o, heading, text, fs, ms, direct as leads from t where not rest union all select path, 'module', unnest(ms), o, heading, text, fs, ms, direct from t where not rest),
    h as (select path, kind, title, heading, min(o) as o, arg_min(leads, o) as leads from r group by all),
    hs as (select path, kind, title, string_agg(heading, '|' order by leads desc, case when leads then -o else o end) as headings from h group by all),
    g as (select path, kind, title, coalesce(arg_max(text, o) filter (leads), arg_min(text, o)) as summary, list_sort(list_distinct(flatten(list(fs)))) as fs, list_sort(list_distinct(flatten(list(ms)))) as ms from r group by all)
    select path, kind, title, summary, headings, array_to_string(fs, ',') as functions, array_to_string(ms, ',') as modules,
      case when kind = 'function' then concat_ws(',', case when title = 'g_Pump_run' then 'BODY' end, case when title = 's_Aux1_go' then 'NEW' end) else concat_ws(',', case when list_contains(fs, 'g_Pump_run') then 'BODY' end, case when list_contains(fs, 's_Aux1_go') then 'NEW' end) end as change_types,
      case when kind = 'module' then title in ('Pump', 'Aux1', 'SwCom_2') else list_has_any(ms, ['Pump', 'Aux1', 'SwCom_2']) end as review
    from g join hs using (path, kind, title)
    union all select path, 'section', heading, text, heading, array_to_string(fs, ','), array_to_string(ms, ','), '', false from t where rest
    """
)
def design_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections written from parts, in documents of a brand's blocks of keys, as functions, modules and other sections."""
    k, size = F.col("p_partkey"), F.col("p_size")
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    module = F.element_at(F.array(F.lit("Motor"), F.lit("Pump"), F.lit("Valve")), (k % 3 + 1).cast("int"))
    heading = F.when(k % 4 == 0, say("SwCom_", size % 3, ": x")).when(k % 7 == 0, F.lit("Revision  History")).otherwise(say("H", k % 11))
    sections = table(spark, sf_dir, "part").select(say(F.col("p_brand"), "/", F.floor(k / 512)).alias("path"), k.alias("ordinal"), heading.alias("heading"), say("calls g_", module, "_run then\n s_Aux", size % 5, "_go of ", k).alias("text"))
    changed = spark.createDataFrame([("g_Pump_run", "body"), ("s_Aux1_go", "NEW")], "name string, change_type string")
    items = designs.design_items(designs.section_facts(sections), changed, spark.createDataFrame([(" swcom_2",)], "module string"))
    return items.select("path", "kind", "title", "summary", F.array_join("headings", "|").alias("headings"), F.array_join("functions", ",").alias("functions"), F.array_join("modules", ",").alias("modules"), F.array_join("change_types", ",").alias("change_types"), "review")


@query(
    """
    with r as (select p_brand as path, p_partkey + 2 as row, 'HSI_' || p_partkey as id, case when p_size % 3 = 0 then '' else 'PIN ' || p_size end as signal_name, case when p_size % 2 = 0 then 'u8g_' || p_partkey || ', v' || p_size else '' end as sw_var_name from part where p_partkey % 5 <> 0),
    k as (select * from r where signal_name <> '' or sw_var_name <> ''),
    n as (select path, 'u8g_' || (row - 2) as name, 'variable' as kind from k where sw_var_name <> '' union all select path, substr(sw_var_name, strpos(sw_var_name, ', ') + 2), 'variable' from k where sw_var_name <> '' union all select path, replace(signal_name, ' ', '_'), 'signal' from k where signal_name <> '')
    select distinct path, name, kind from n
    """
)
def signal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of signal sheets whose cells are written from parts; a fifth of the rows are no signals."""
    k, size = F.col("p_partkey"), F.col("p_size")
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    values = {6: F.when(k % 5 == 0, say("N_", k)).otherwise(say("HSI_", k)), 7: F.when(size % 3 != 0, say("PIN ", size)), 20: F.when(size % 2 == 0, say("u8g_", k, ", v", size))}
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("path"), F.lit("2.HSIS").alias("sheet"), (k + 2).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in values.items()])).alias("c")).select("path", "sheet", "row", "c.col", "c.value")
    heads = part.select(F.col("p_brand").alias("path")).distinct().select("path", F.lit("2.HSIS").alias("sheet"), F.lit(1).cast("long").alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(v).alias("value")) for c, v in ((6, "ID"), (7, "Signal Name"), (20, "SW Variable Name"))])).alias("c")).select("path", "sheet", "row", "c.col", "c.value")
    return sidedocs.signal_names(sidedocs.signals(rows.unionByName(heads)))


@query(
    """
    with d as (select p_brand as path, lower(p_name) as name, arg_max('text ' || p_type || p_partkey, p_partkey) as description from part where p_size % 4 <> 0 group by 1, 2),
    f as (select name, max(description) as best from d group by 1)
    select s_suppkey::varchar as id, n as name, case when length(best) > 12 then best else '12 long text' end as description
    from (select s_suppkey, (select min(p_name) from part where p_partkey = s_suppkey) as n from supplier) s left join f on lower(s.n) = f.name
    """
)
def side_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of tables, the last of a name in each document, put in where they are longer than a function's own."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("path"), F.lit(0).alias("table"), (F.col("p_partkey") + 1).alias("row"), F.array(F.col("p_type"), F.concat(F.lit(" "), "p_name"), F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("text "), "p_type", F.col("p_partkey").cast("string"))).otherwise(" ")).alias("cells"))
    heads = part.select(F.col("p_brand").alias("path")).distinct().select("path", F.lit(0).alias("table"), F.lit(0).cast("long").alias("row"), F.array(F.lit("Kind"), F.lit("Function name"), F.lit("Description")).alias("cells"))
    functions = table(spark, sf_dir, "supplier").join(part.select(F.col("p_partkey").alias("s_suppkey"), "p_name"), "s_suppkey", "left").select(F.col("s_suppkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("12 long text").alias("description"))
    return sidedocs.longer_descriptions(functions, sidedocs.table_descriptions(rows.unionByName(heads)))
