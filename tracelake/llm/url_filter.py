"""URL filter: host-suffix and path-prefix expressions, joined on short digests, then confirmed.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that the equi-join compares.
SHORT_HEX = 8


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every host suffix of a label count that some rule has, with every path prefix of a length that some rule has."""
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in labels]))
    prefixes = F.array_distinct(F.array(*[F.substring(path, 1, n) for n in lengths]))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("suffix"), p.alias("prefix")))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict.

    `rules` has (host, path, verdict); a rule fits its host and all subdomains where the url's
    path starts with the rule's, character by character. The longest rule text (host plus path)
    wins, then the longer host, then block before allow. A url that no rule fits gets `default`
    and a null rule. Null urls and urls without `://` have an empty host and path, which no rule
    with a host fits. Repeated rows stay repeated; null ids are kept; other columns are not read.
    Rules whose host or path is null are ignored.

    Only the distinct label counts and path lengths of the rules come to the driver; both are
    bounded by the longest rule, not by the number of rules or pages.
    """
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).filter("rule_host is not null and rule_path is not null and rule_host <> ''")
    shape = known.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]) or [1], sorted(shape["lengths"]) or [0]
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p).cast("binary"), 256)
    # One row a short digest, so that the join neither drops nor repeats an expression.
    rank = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
        F.col("rule_digest").alias("digest"),
    )
    known = known.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).groupBy(F.substring("rule_digest", 1, SHORT_HEX).alias("short")).agg(F.collect_set(rank).alias("rules"))

    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    each = urls.select("page_id", "host", "path", F.posexplode(_expressions(F.col("host"), F.col("path"), labels, lengths)).alias("place", "part"))
    each = each.withColumn("digest", digest(F.col("part.suffix"), F.col("part.prefix"))).withColumn("short", F.substring("digest", 1, SHORT_HEX))
    met = each.join(known, "short", "left").withColumn("best", F.array_max(F.filter("rules", lambda r: r["digest"] == F.col("digest"))))
    best = met.groupBy("page_id", "host", "path").agg(F.max("best").alias("best"), F.count_if(F.col("place") == 0).cast("int").alias("times"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).drop("one")
