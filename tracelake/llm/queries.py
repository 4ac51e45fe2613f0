"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import compression_quality, exact_dedup, language_id, license_scan, near_dedup, packing, periods, piece_tokens, quality_rules, repeats, secret_scan, spelling, url_filter
from tracelake.llm.shared import fold, table

#: (host, path, verdict), as the query's contract fixes them.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.filter(fold(F.col("doc_id"), 5) != 0))
    told = language_id.identify(docs, net)
    return told.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op2_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.encode(table(spark, sf_dir, "documents"), ids=False, digests=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.without_frequent_lines(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(piece_tokens.encode(table(spark, sf_dir, "documents"), ids=False))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2).drop("text_key")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs, license_scan.fit(docs))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression_quality.fit(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_uses(table(spark, sf_dir, "documents"), every=97))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.periodic_runs(periods.made_periodic(table(spark, sf_dir, "documents"))))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep="none").drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_piece_tokens": op2_piece_tokens,
    "op3_quality_rules": op3_quality_rules,
    "op3_clean_text": op3_clean_text,
    "op4_secret_scan": op4_secret_scan,
    "op5_packing": op5_packing,
    "op6_near_dedup": op6_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_license_scan": op9_license_scan,
    "op10_compression_quality": op10_compression_quality,
    "op11_spelling": op11_spelling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_repeats": op13_repeats,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
with t as (select doc_id, {LOWER.format("coalesce(text, '')")} as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g using (norm)
"""

OP8_SQL = f"""
with r(rule_host, rule_path, rule_verdict) as (values {", ".join(str(x) for x in URL_RULES)}),
u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select page_id, rule_host || rule_path as rule, rule_verdict,
        row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc, rule_verdict desc) as k
      from p join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select p.page_id, p.host, p.path, m.rule, coalesce(m.rule_verdict, 'allow') as verdict
from p left join m on p.page_id = m.page_id and m.k = 1
"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE_SQL, "op3_clean_text": quality_rules.CLEAN_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_spelling": spelling.ORACLE_SQL}
