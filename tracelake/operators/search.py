"""Chunking, keyword, vector and fused search over a DataFrame of entries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import numbers, text
from tracelake.operators.history import fused_ranks

TOKEN = re.compile(r"[a-z0-9가-힣_]{2,}")


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(TOKEN.findall((query or "").lower())))


def windows(body: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Windows of a trimmed text as an array; blank ones are dropped, an empty text has none."""
    step = max(1, size - max(0, overlap))
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t)), F.lit(step)), lambda i: F.substr(t, i, F.lit(size)))
    # The text is trimmed once, as the lambda variable of a one-element array, not for each window.
    parts = F.flatten(F.transform(F.array(text.trimmed(body)), cut))
    return F.filter(parts, lambda p: text.trimmed(p) != "")


def chunks(docs: DataFrame, key: str, body: str, size: int = 1200, overlap: int = 200, most: int | None = None) -> DataFrame:
    """One row a window: key, chunk (from 0), text."""
    parts = windows(F.col(body), size, overlap)
    return docs.select(key, F.posexplode(F.slice(parts, 1, most) if most else parts).alias("chunk", "text"))


def requirement_chunks(docs: DataFrame, key: str, body: str, size: int = 1500, overlap: int = 300) -> DataFrame:
    """Segments from one requirement id to the next where a text has two or more, long ones cut again; else windows."""
    pattern = r"\b(?:REQ|SDS|SW|SWS|SWR|SRS|SWC|REQS)\s*[-_:]?\s*[A-Za-z0-9_.-]+\b"
    whole = text.trimmed(body)
    # The split stands before every id; the first part has no id of its own.
    parts = F.split(F.regexp_replace(whole, f"({pattern})", "\u0001$1"), "\u0001")
    segments = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), text.trimmed), lambda s: s != "")
    cut = F.flatten(F.transform(segments, lambda s: F.when(F.length(s) > 2 * size, windows(s, size, overlap)).otherwise(F.array(s))))
    chosen = F.when(F.regexp_count(whole, F.lit(pattern)) >= 2, cut).otherwise(windows(whole, size, overlap))
    return docs.select(key, F.posexplode(chosen).alias("chunk", "text"))


def function_chunks(files: DataFrame, key: str, body: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """C text cut before each function definition at line start, long parts cut again."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"(?m)^(?=[A-Za-z_][\w\s\*]*\([^;{}]*\)\s*\{)", "\u0001"), "\u0001")
    cut = F.flatten(F.transform(parts, lambda s: F.when(F.length(s) > 2 * size, windows(s, size, overlap)).otherwise(F.filter(F.array(text.trimmed(s)), lambda t: t != ""))))
    return files.select(key, F.posexplode(cut).alias("chunk", "text"))


def occurrences(haystack: Column, token: str) -> Column:
    """Non-overlapping occurrences of a text."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(token), F.lit("")))) / F.lit(len(token))).cast("int")


def keyword_score(haystack: Column, tokens: list[str]) -> Column:
    """Sum of min(c, 5) / (1 + 0.5 c) over tokens found c times, times half plus half the share of tokens found; 0 without any."""
    if not tokens:
        return F.lit(0.0)
    counts = [occurrences(haystack, t) for t in tokens]
    total = reduce(lambda a, b: a + b, [F.when(c > 0, F.least(c, F.lit(5)) / (1 + 0.5 * c)).otherwise(F.lit(0.0)) for c in counts])
    found = reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in counts])
    return total * (0.5 + 0.5 * found / len(tokens))


def restrict(entries: DataFrame, categories: list[str] | None = None, role: str | None = None, stage: str | None = None) -> DataFrame:
    """Entries of the asked categories, role and stage; Catalyst pushes these to the scan."""
    if categories:
        entries = entries.filter(F.col("category").isin(categories))
    if role:
        entries = entries.filter(F.col("role") == role)
    return entries.filter(F.col("stage") == stage) if stage else entries


def keyword_search(entries: DataFrame, key: str, texts: list[str], query: str, top: int = 20) -> DataFrame:
    """Best entries by keyword score: key, score. An empty query gives no rows."""
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts]))
    scored = entries.select(key, haystack.alias("haystack")).select(key, keyword_score(F.col("haystack"), query_tokens(query)).alias("score"))
    # The filter comes after the limit, or each score would be computed for the filter and once more for the order.
    return scored.orderBy(F.desc("score"), key).limit(top).filter("score > 0")


def semantic_search(entries: DataFrame, key: str, vector: str, query: list[float], top: int = 20, weight: str | None = None, tags: tuple[str, list[str]] | None = None) -> DataFrame:
    """Best entries by cosine times weight plus 0.05 a shared tag: key, score; scores of 0 and less are dropped."""
    score = numbers.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    if weight:
        score = score * F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    if tags:
        score = score + 0.05 * F.size(F.array_intersect(F.coalesce(F.col(tags[0]), F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags[1]]).cast("array<string>")))
    return entries.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(top).filter("score > 0")


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """Ranks 1, 2, ... of a bounded list of hits by score."""
    # The list is a top-k result, so one window over it stays small.
    return hits.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), key)).alias("rank"))


def hybrid_search(entries: DataFrame, key: str, texts: list[str], vector: str, query: str, query_vector: list[float], top: int = 5, alpha: float = 0.5) -> DataFrame:
    """Keyword hits for alpha 0, vector hits for 1, else both fused by reciprocal ranks over max(5 top, 20) candidates each."""
    n = max(5 * top, 20)
    if alpha <= 0:
        return keyword_search(entries, key, texts, query, top)
    if alpha >= 1:
        return semantic_search(entries, key, vector, query_vector, top)
    lists = [ranked(keyword_search(entries, key, texts, query, n), key), ranked(semantic_search(entries, key, vector, query_vector, n), key)]
    return fused_ranks(lists, key, top=top)


def boosted(hits: DataFrame, role: str | None = None, stage: str | None = None, ids: list[str] | None = None, texts: list[str] | None = None, recency: tuple[Column, float, float] | None = None, project: tuple[str, float] | None = None, applied: float = 0.0, errors: float = 0.0, exact: float = 0.4) -> DataFrame:
    """Adds to the score: 0.15 for the role, 0.1 for the stage, `exact` for a requirement id in the texts,
    up to `recency[2]` for entries younger than `recency[1]` days before `recency[0]`, `project[1]` where
    the entry's project_root stands in the query `project[0]`, and `applied` and `errors` for each time
    that an entry was applied (apply_count) and failed (error_count)."""
    score = F.col("score")
    if role:
        score = score + F.when(F.col("role") == role, 0.15).otherwise(0.0)
    if stage:
        score = score + F.when(F.col("stage") == stage, 0.1).otherwise(0.0)
    if recency:
        now, days, boost = recency
        age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 86_400_000_000
        score = score + F.when(age < days, boost * (1 - age / days)).otherwise(0.0)
    if ids and texts:
        body = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts])
        score = score + F.when(reduce(lambda a, b: a | b, [body.contains(i) for i in ids]), exact).otherwise(0.0)
    if project and project[1] > 0:
        root = F.coalesce(F.col("project_root").cast("string"), F.lit(""))
        score = score + F.when((root != "") & F.lit(project[0]).contains(root), project[1]).otherwise(0.0)
    for column, boost in (("apply_count", applied), ("error_count", errors)):
        if boost > 0:
            score = score + boost * F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    return hits.withColumn("score", score)


def domain_ranked(hits: DataFrame, domains: list[str], top: int, key: str) -> DataFrame:
    """Hits (domain, key, score) by the domain's place in the list, then score: scores never cross domains."""
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain"))
    return hits.filter(place > 0).withColumn("priority", (11 - place).cast("int")).orderBy(F.desc("priority"), F.desc("score"), key).limit(top)
