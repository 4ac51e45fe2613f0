"""Queries of the quality, history, set and filter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import dates, numbers, text
from tracelake.operators import filters, history, quality, sets
from tracelake.plans.registry import query, table


@query(
    """
    with t as (select source as unit, quality = 1 as passed, toxic, n_chars from documents join labels using (doc_id)),
    u as (select unit, count(*) filter (passed) as n_passed, count(*) filter (not passed) as n_failed, count(*) as total, count(*) filter (n_chars > 400) / count(*) as line, avg(n_chars) / 50 as branch, sum(toxic) as fresh from t group by unit),
    g as (select unit, n_passed, n_failed, total, 'pass_rate' as gate, n_passed / total as v, 85.0 as threshold from u
      union all select unit, n_passed, n_failed, total, 'coverage_line', line, 80.0 from u union all select unit, n_passed, n_failed, total, 'coverage_branch', branch, 60.0 from u),
    p as (select *, case when v <= 1 then 100.0 * v else v end as pct from g)
    select unit, n_passed as passed, n_failed as failed, total, n_passed / total as pass_rate, gate, round_even(pct, 1) as actual, threshold::double as threshold,
      case when pct >= threshold then 'pass' when gate <> 'pass_rate' and pct >= threshold * 0.8 then 'warn' else 'fail' end as status from p
    union all select unit, n_passed, n_failed, total, n_passed / total, 'new_failures', fresh::double, 2.0, case when fresh <= 2 then 'pass' else 'fail' end from u
    """
)
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four gates of each source: labelled quality as test results, long texts as covered lines, a mean length as a percentage, toxic texts as new failures."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"), "toxic")
    tests = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id")
    facts = tests.groupBy(F.coalesce("source", F.lit("UNKNOWN")).alias("unit")).agg((F.count_if(F.col("n_chars") > 400) / F.count(F.lit(1))).alias("coverage_line"), (F.avg("n_chars") / 50).alias("coverage_branch"), F.sum("toxic").alias("new_failures"))
    per = quality.unit_breakdown(tests, "source", "ok").join(facts, "unit")
    return quality.quality_gates(per, ["unit", "passed", "failed", "total", "pass_rate"], (85, 80, 60, 2))


@query(
    """
    with c(category) as (values ('assertion'), ('timeout'), ('crash'), ('environment'), ('unknown')),
    t as (select upper(event_type || ' ' || props) as x from events),
    f as (select case when regexp_matches(x, 'MISMATCH|EXPECTED|ASSERT|!=|NOT EQUAL|COMPARISON|OUT OF RANGE|BOUNDARY') then 'assertion'
      when regexp_matches(x, 'TIMEOUT|TIME_OUT|TIMED OUT|DEADLINE') then 'timeout'
      when regexp_matches(x, 'CRASH|ABORT|SEGFAULT|EXCEPTION|ACCESS VIOLATION|SIGNAL|CORE DUMP|STACK OVERFLOW|PROTECTION FAULT|ILLEGAL INSTRUCTION|BUS ERROR') then 'crash'
      when regexp_matches(x, 'ENV|SETUP|CONFIG|LICENSE|CONNECTION|FILE NOT FOUND|MISSING|INITIALIZATION|COMPILE ERROR|LINK ERROR|BUILD FAILED|INSTRUMENT|HARNESS') then 'environment'
      else 'unknown' end as category from t)
    select c.category, count(f.category) as n from c left join f using (category) group by 1
    """
)
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failure_categories(table(spark, sf_dir, "events"), ["event_type", "props"], F.lit(True))


@query(
    """
    select l_returnflag as unit, count(*) filter (l_linestatus = 'F') as passed, count(*) filter (l_linestatus <> 'F') as failed,
      count(*) as total, count(*) filter (l_linestatus = 'F') / count(*) as pass_rate from lineitem group by 1
    """
)
def unit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "F").alias("ok"))
    return quality.unit_breakdown(tests, "l_returnflag", "ok")


@query(
    """
    with k as (select case when regexp_matches(upper(event_type), 'PASS|OK|SUCCESS') then 'pass' when regexp_matches(upper(event_type), 'SKIP|N/A|NOT RUN|NOTRUN') then 'skip'
      when regexp_matches(upper(event_type), 'FAIL|ERROR|NG|FATAL') then 'fail' else 'unknown' end as r from events)
    select count(*) as total, count(*) filter (r = 'pass') as passed, count(*) filter (r = 'fail') as failed, count(*) filter (r = 'skip') as skipped,
      count(*) filter (r = 'unknown') as unknown, count(*) filter (r = 'pass') / count(*) as pass_rate from k
    """
)
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.result_summary(table(spark, sf_dir, "events"), "event_type")


@query(
    """
    with s as (select l_suppkey as key, sum(l_discount * 1000)::double as covered, sum(100)::double as total from lineitem group by 1)
    select key, round(covered, 3) as covered, total, round(covered / total, 9) as rate from s
    """
)
def subprogram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage ratios of each supplier: discounts as covered statements."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_discount") * 1000).alias("c"), F.lit(100.0).alias("t"))
    out = quality.coverage_ratios(rows, ["key"], "c", "t")
    return out.select("key", F.round("covered", 3).alias("covered"), "total", F.round("rate", 9).alias("rate"))


@query(
    """
    select l_returnflag as unit, l_linestatus as part,
      case grouping(l_returnflag, l_linestatus) when 0 then 'detail' when 1 then 'total' else 'grand_total' end as kind,
      sum(l_quantity) as l_quantity from lineitem group by rollup (l_returnflag, l_linestatus)
    """
)
def totals_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.totals(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["l_quantity"])


@query("with p as (select l_suppkey, l_partkey, max(l_quantity) as q from lineitem group by 1, 2) select count(distinct l_suppkey) as files, count(*) as functions, sum(q) as nloc from p")
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.code_metrics(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


@query("select 'V(G)' as metric, (p_size >= 11)::int + (p_size >= 21)::int + (p_size >= 31)::int as level, count(*) as n from part group by 2")
def his_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.warning_levels(table(spark, sf_dir, "part").withColumn("metric", F.lit("V(G)")), "metric", "p_size")


@query("select p_brand, count(*) as n, max(p_size)::double as largest, round(avg(p_size), 6) as mean, round(quantile_cont(p_size::double, 0.95), 6) as p95 from part group by 1")
def file_stats_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.group_stats(table(spark, sf_dir, "part"), "p_brand", "p_size").withColumns({c: F.round(c, 6) for c in ("mean", "p95")})


FILL_SQL = """
    with d as (select source, lang, nullif(trim(text), '') as text, n_chars, quality from documents left join labels using (doc_id)),
    c as (select source, count(text) as n_t, count(*) filter (n_chars > 500) as n_l, count(quality) as n_q, count(*) filter (lang <> 'en') as n_f, count(*) as n from d group by source)
"""


def _fill(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs, {"text": F.trim("text") != "", "long": F.col("n_chars") > 500, "label": F.col("quality").isNotNull(), "foreign": F.col("lang") != "en"}


@query(FILL_SQL + "select source, x.check, x.n, c.n as of, round_even(100.0 * x.n / c.n, 1) as rate from c, lateral (values ('text', n_t), ('long', n_l), ('label', n_q), ('foreign', n_f)) x(check, n)".replace("x.check", 'x."check"').replace("x(check, n)", 'x("check", n)'))
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, checks = _fill(spark, sf_dir)
    return quality.fill_rates(docs, checks, ["source"])


@query(
    FILL_SQL
    + """, r as (select source, x.item, x.n, c.n as of, round_even(100.0 * x.n / c.n, 1) as rate from c, lateral (values ('text', n_t), ('long', n_l), ('label', n_q), ('foreign', n_f)) x(item, n))
    select *, case when rate >= 95 then 'PASS' when rate >= 70 then 'WARN' else 'FAIL' end as status from r"""
)
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, checks = _fill(spark, sf_dir)
    return quality.compliance(docs, checks, "source")


@query(
    FILL_SQL
    + """, m as (select source, x.m as metric_name, 100.0 * x.n / c.n as value, x.t as threshold from c, lateral (values ('text', n_t, 90.0), ('long', n_l, 60.0), ('label', n_q, 50.0), ('foreign_pct', n_f, null)) x(m, n, t))
    select source, round(avg(case when threshold is not null then case when value >= threshold then value else value * 0.5 end end), 6) as overall_score from m group by 1"""
)
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, checks = _fill(spark, sf_dir)
    limits = {"text": 90.0, "long": 60.0, "label": 50.0}
    rates = quality.fill_rates(docs, checks, ["source"])
    metrics = rates.select("source", F.when(F.col("check") == "foreign", F.lit("foreign_pct")).otherwise(F.col("check")).alias("metric_name"), (100.0 * F.col("n") / F.col("of")).alias("value"), numbers.mapped("check", limits, None).alias("threshold"))
    return quality.overall_score(metrics, ["source"]).withColumn("overall_score", F.round("overall_score", 6))


@query(
    FILL_SQL
    + """, m as (select source, x.m as metric_name, 100.0 * x.n / c.n as value, x.t as threshold from c, lateral (values ('text', n_t, 90.0), ('long', n_l, 60.0), ('label', n_q, 50.0)) x(m, n, t))
    select source, metric_name, round(threshold - value, 6) as gap, case when threshold - value > 30 then 'high' when threshold - value > 10 then 'medium' else 'low' end as priority from m where value < threshold"""
)
def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, checks = _fill(spark, sf_dir)
    rates = quality.fill_rates(docs, {k: v for k, v in checks.items() if k != "foreign"}, ["source"])
    scores = rates.select("source", F.col("check").alias("metric_name"), (100.0 * F.col("n") / F.col("of")).alias("value"), numbers.mapped("check", {"text": 90.0, "long": 60.0, "label": 50.0}, None).alias("threshold"))
    return quality.advice(scores).select("source", "metric_name", F.round("gap", 6).alias("gap"), "priority")


@query(
    """
    with r as (select o_orderstatus as k, case o_orderpriority when '1-URGENT' then 1.0 when '2-HIGH' then 0.95 when '3-MEDIUM' then 0.9 when '4-NOT SPECIFIED' then 0.75 else 0.6 end as c from orders)
    select k as status, round(avg(c), 9) as confidence, count(*) as n, case when avg(c) >= 0.95 then 'A' when avg(c) >= 0.9 then 'B' when avg(c) >= 0.8 then 'C' else 'D' end as grade from r group by 1
    """
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' priorities as sources of a field."""
    origin = numbers.mapped("o_orderpriority", {"1-URGENT": "comment", "2-HIGH": "sds", "3-MEDIUM": "reference", "4-NOT SPECIFIED": "rule"}, "inference")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), origin.alias("origin"))
    return quality.confidence(rows, ["origin"], ["status"]).withColumn("confidence", F.round("confidence", 9))


@query("select source, lang, count(*) as n, max(doc_id) as latest from documents group by 1, 2")
def kb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_by(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id")


@query("select l_partkey::varchar as path, sum(l_linenumber)::bigint as added, sum(l_quantity::bigint)::bigint as deleted, sum(l_linenumber + l_quantity::bigint)::bigint as total from lineitem group by 1 order by total desc, path limit 10")
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("added"), F.col("l_quantity").cast("long").alias("deleted"))
    return quality.churn(rows)


@query("select event_id, event_type, lag(event_id) over w as prev_run_id, round(value - lag(value) over w, 6) as score_delta from events window w as (partition by event_type order by ts, event_id)")
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return history.previous_run(runs, "event_type", ["ts", "event_id"], "event_id", "value").select("event_id", "event_type", "prev_run_id", F.round("score_delta", 6).alias("score_delta"))


@query(
    """
    with r as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
    select user_id, max(value) filter (k = 1) as value_latest, max(value) filter (k = 2) as value_previous,
      round(max(value) filter (k = 1) - max(value) filter (k = 2), 6) as value_delta from r where k <= 2 group by 1 having count(*) = 2
    """
)
def latest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return history.latest_two(rows, "user_id", ["ts", "event_id"], ["value"]).withColumn("value_delta", F.round("value_delta", 6))


@query(
    """
    with s as (select l_returnflag as k, l_linestatus as b, count(*) as total, count(*) filter (l_discount < 0.05) as failed, count(*) filter (l_discount >= 0.05) / count(*) as pass_rate from lineitem group by 1, 2),
    j as (select c.k, c.total - p.total as total_delta, c.failed - p.failed as failed_delta, c.pass_rate - p.pass_rate as d from s c join s p on c.k = p.k and c.b = 'O' and p.b = 'F')
    select k, true as available, round_even(100 * d, 2) as pass_rate_delta, total_delta, failed_delta, greatest(0, failed_delta) as new_failures, greatest(0, -failed_delta) as resolved_failures, d >= 0 as improved from j
    """
)
def build_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line status O against F as current and previous build."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), "l_linestatus").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_discount") < 0.05).alias("failed"))
    per = per.withColumn("pass_rate", (F.col("total") - F.col("failed")) / F.col("total"))
    return history.build_trend(per.filter("l_linestatus = 'O'"), per.filter("l_linestatus = 'F'"), "k")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as place from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5)")
def trend_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return history.last_n(rows, ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "place")


@query("select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 59999999 preceding and current row) as in_window from events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.preceding_count(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts").drop("ts")


@query("select user_id, event_type, round(1.0 + 0.1 * (count(*) - 1), 6) as weight, count(*) - 1 as apply_count, count(*) as error_count from events group by 1, 2")
def learn_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.learned(table(spark, sf_dir, "events"), ["user_id", "event_type"]).withColumn("weight", F.round("weight", 6))


@query(
    """
    with recursive v as (select user_id, value > 50 as good, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select user_id, 0::bigint as k, 1.0::double as w from (select distinct user_id from v)
      union all select f.user_id, v.k, greatest(0.1, f.w + case when v.good then 0.2 else -0.2 end) from f join v on v.user_id = f.user_id and v.k = f.k + 1)
    select f.user_id, round(f.w, 6) as weight, (select count(*) from v where v.user_id = f.user_id and good) as apply_count
    from f join (select user_id, max(k) as k from v group by 1) m on m.user_id = f.user_id and m.k = f.k
    """
)
def feedback_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") > 50).alias("good"))
    return history.feedback_weight(votes, "user_id", ["ts", "event_id"], "good")


@query("select doc_id, source, n_chars from documents order by n_chars desc, lang desc, doc_id desc limit 100")
def keep_max_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.keep_most(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang"), "n_chars", "lang", "doc_id", 100).drop("lang")


@query("select o_orderkey, o_totalprice, (select count(*) from orders) as total from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50)


@query("select conv_id, count(*) as messages, max(turn) as updated from conversations group by 1")
def conv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) as seq from conversations")
def seq_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"])


@query("select conv_id, max(turn) + 1 as next_seq from conversations group by 1")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.next_sequence(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(
    """
    with a as (select doc_id as id, row_number() over (order by n_chars desc, doc_id) as r from documents qualify r <= 100),
    b as (select vec_id as id, row_number() over (order by embedding[1]::double desc, vec_id) as r from embeddings qualify r <= 100)
    select id, round(sum(1.0 / (60 + r)), 9) as score from (select * from a union all select * from b) group by 1
    """
)
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.operators.search import ranked

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score")).orderBy(F.desc("score"), "id").limit(100)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(100)
    return history.fused_ranks([ranked(docs, "id"), ranked(vectors, "id")], "id").withColumn("score", F.round("score", 9))


@query("select user_id, arg_max(event_type, struct_pack(ts, event_id)) as event_type, arg_max(value, struct_pack(ts, event_id)) as value from events group by 1")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_progress(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query(
    """
    with p as (select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) // 20 as batch from documents)
    select source, batch::int as batch, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) as text from p group by 1, 2
    """
)
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("text"))
    return history.batches(rows, "source", ["doc_id"], 20, "text", ",")


@query("select p_partkey, p_brand, 'SwUFn_' || lpad(p_size::varchar, 2, '0') || lpad((row_number() over (partition by p_size order by p_partkey))::varchar, 4, '0') as unit_id from part")
def function_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.numbered(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "ordinal")
    unit = F.concat(F.lit("SwUFn_"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lpad(F.col("ordinal").cast("string"), 4, "0"))
    return out.select("p_partkey", "p_brand", unit.alias("unit_id"))


@query(
    """
    with p as (select page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path from pages)
    select page_id, path from p where (path in ('en', 'fr') or starts_with(path, 'en/') or starts_with(path, 'fr/')) and not (path = 'fr/825' or starts_with(path, 'fr/825/'))
    """
)
def url_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"))
    return pages.filter(filters.path_filter("path", ["en", "fr"], ["fr/825"]))


@query("select c_custkey, c_name, (select count(*) from customer where c_mktsegment = 'BUILDING' and lower(c_name || ' ' || c_mktsegment) like '%00%') as total from customer where c_mktsegment = 'BUILDING' and lower(c_name || ' ' || c_mktsegment) like '%00%' order by c_custkey limit 50 offset 50")
def view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return filters.view_page(rows, {"c_mktsegment": "BUILDING"}, "00", ["c_name", "c_mktsegment"], ["c_custkey"], 2, 50).drop("c_mktsegment")


@query("select p_brand, p_name, arg_min(p_type, struct_pack(a := -length(p_type), b := p_type)) as p_type from part group by 1, 2")
def longest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("k", F.concat_ws("|", "p_brand", "p_name"))
    out = sets.longest_per_key(rows, "k", "p_type")
    return out.select(F.split_part("k", F.lit("|"), F.lit(1)).alias("p_brand"), F.split_part("k", F.lit("|"), F.lit(2)).alias("p_name"), "p_type")


@query(
    """
    select o_orderkey, date_trunc('month', o_orderdate)::date::varchar as month_start, last_day(o_orderdate)::varchar as month_end,
      (date_trunc('month', o_orderdate) - interval 1 month)::date::varchar as previous_start, (date_trunc('month', o_orderdate) - interval 1 day)::date::varchar as previous_end,
      (o_orderdate::date - case isodow(o_orderdate) when 1 then 3 when 7 then 2 else 1 end)::date::varchar as business_day, isodow(o_orderdate) = 5 as weekly
    from orders
    """
)
def report_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    days = {"month_start": dates.month_start(d), "month_end": dates.month_end(d), "previous_start": dates.previous_month_start(d), "previous_end": dates.previous_month_end(d), "business_day": dates.previous_business_day(d)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[v.cast("string").alias(k) for k, v in days.items()], dates.is_weekly_day(d).alias("weekly"))


@query(
    r"""
    select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9가-힣_]{2,}'))) as n_tokens,
      length(trim(regexp_replace(regexp_replace(text, '/app/[^\s]+', '<PATH>', 'g'), '\s+', ' ', 'g'))) as n_message from documents
    """
)
def tokens_and_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens("text")).alias("n_tokens"), F.length(text.normalise_message("text")).alias("n_message"))


@query(
    r"""
    with k as (select doc_id, lower(coalesce(text, '') || case doc_id % 4 when 0 then ' 12 passed, Failed: ' || n_chars || ' (failures = 7)' when 1 then ' errors: 3' else '' end) as t from documents),
    n as (select doc_id, t,
      list_max(list_transform(regexp_extract_all(t, '\bfail(?:ed|ures)?\b[^0-9]{0,12}([0-9]{1,9})', 1), lambda x: x::bigint)) as f, list_max(list_transform(regexp_extract_all(t, '\berror(?:s)?\b[^0-9]{0,12}([0-9]{1,9})', 1), lambda x: x::bigint)) as e,
      list_max(list_transform(regexp_extract_all(t, '\bwarn(?:ing|ings)?\b[^0-9]{0,12}([0-9]{1,9})', 1), lambda x: x::bigint)) as w, list_max(list_transform(regexp_extract_all(t, '\bpass(?:ed|es)?\b[^0-9]{0,12}([0-9]{1,9})', 1), lambda x: x::bigint)) as p from k),
    m as (select *, coalesce(f, e, w, p) is not null as numeric_used from n)
    select doc_id, case when numeric_used then coalesce(f, 0) else len(regexp_extract_all(t, '\bfail(?:ed|ures)?\b')) end as fail, case when numeric_used then coalesce(e, 0) else len(regexp_extract_all(t, '\berror(?:s)?\b')) end as error,
      case when numeric_used then coalesce(w, 0) else len(regexp_extract_all(t, '\bwarn(?:ing|ings)?\b')) end as warn, case when numeric_used then coalesce(p, 0) else len(regexp_extract_all(t, '\bpass(?:ed|es)?\b')) end as pass from m
    """
)
def log_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest number beside each word; word counts where no word has a number. Summaries end a part of the texts."""
    end = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" 12 passed, Failed: "), F.col("n_chars").cast("string"), F.lit(" (failures = 7)"))).when(F.col("doc_id") % 4 == 1, F.lit(" errors: 3")).otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), end).alias("text"))
    return docs.select("doc_id", F.inline(F.array(text.kpis("text"))))


@query(
    """
    with c as (select o_custkey as k, case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 1 else 0 end as r,
      case o_orderstatus when 'F' then 4 when 'O' then 2 else 1 end as w, o_totalprice > 200000 as direct from orders),
    a as (select k, max(r) as mr, avg(w) as mw, count(*) as n, bool_or(direct and r >= 2) as esc from c group by k),
    s as (select *, floor(mr * 10 + least(mw * 7.5, 30.0) + least(n * 3, 30))::int as score from a)
    select k as o_custkey, score, case when score >= 70 or (esc and mr >= 3) then 'CRITICAL' when score >= 50 or esc then 'HIGH' when score >= 25 then 'MEDIUM' else 'LOW' end as grade from s
    """
)
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.operators import change

    level = numbers.mapped("o_orderpriority", {"1-URGENT": "D", "2-HIGH": "C", "3-MEDIUM": "B", "4-NOT SPECIFIED": "A"}, "QM")
    kind = numbers.mapped("o_orderstatus", {"F": "SIGNATURE", "O": "BODY"}, "HEADER")
    rows = table(spark, sf_dir, "orders").select("o_custkey", level.alias("level"), kind.alias("kind"), (F.col("o_totalprice") > 200000).alias("direct"))
    return change.risk(rows, ["o_custkey"], "level", "kind", "direct")
