"""Previous runs, trends, ranks, pages, retention and ordered state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A key with more rows than this is cut into stretches of its order, so that no task sorts all its rows.
LARGE_KEY = 1_000_000

WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def large_keys(rows: DataFrame, key: str, least: int = LARGE_KEY, known: list | None = None) -> Column | None:
    """A condition that holds for the rows of large keys, or None where no key is large.

    With `known`, a list of the keys that the caller knows to be large (empty: none), nothing is counted
    and no job runs; so it has to be on a stream. Else the rows are counted by key first. At most as many keys as there are shuffle partitions are told, the largest first: any other key
    holds less than one partition's share of the rows.
    """
    if known is not None:
        found = known
    else:
        most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = rows.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
        found = [r.k for r in counts.orderBy(F.desc("n")).limit(most).collect()]
    if not found:
        return None
    named = F.coalesce(F.col(key).isin([k for k in found if k is not None]), F.lit(False))
    return named | F.col(key).isNull() if None in found else named


def _grows_with(rows: DataFrame, column: str) -> Column | None:
    """A double that never falls where the column rises; None for types without one."""
    kind, c = dict(rows.dtypes)[column], F.col(column)
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "timestamp_ntz":
        return (F.unix_date(c.cast("date")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    return c.cast("double") if kind in (*WHOLE_NUMBERS, "float", "double") or kind.startswith("decimal") else None


def _piece(at: Column, bounds: list[float], first: int = 0) -> Column:
    """How many bounds are not above `at`, as a tree of comparisons."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(at < bounds[m], _piece(at, bounds[:m], first)).otherwise(_piece(at, bounds[m + 1 :], first + m + 1))


def stretches(rows: DataFrame, key: str, order: list[str], least: int = LARGE_KEY, known: list | None = None) -> tuple[DataFrame, Column | None]:
    """The rows with `_stretch`, and the condition of large keys (None: no key is large, all stretches are 0).

    A large key's rows are cut at approximate quantiles of the first order column, one stretch a
    shuffle partition; a stretch comes wholly before the next. Rows with equal values of that column
    share a stretch, nulls come first. The bounds are literals, so a task that runs again cuts alike.
    An order column of another type than numbers, dates and times is not cut.
    """
    at = _grows_with(rows, order[0])
    large = None if at is None else large_keys(rows, key, least, known)
    if large is None:
        return rows.withColumn("_stretch", F.lit(0)), None
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(rows.filter(large).select(at.alias("at")).approxQuantile("at", shares, 0.5 / parts))) if shares else []
    return rows.withColumn("_stretch", F.when(~large, F.lit(0)).when(at.isNull(), F.lit(-1)).otherwise(_piece(at, bounds))), large


def _with_stretch_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join with the facts of large keys' stretches: at most the square of the shuffle partitions."""
    facts = facts.withColumnsRenamed({key: "_key", "_stretch": "_piece"})
    return rows.join(F.broadcast(facts), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_piece")), "left")


def previous_run(runs: DataFrame, kind: str, order: list[str], run_id: str, score: str, least: int = LARGE_KEY, known: list | None = None) -> DataFrame:
    """Each run with the run before it of the same kind: prev_run_id and score_delta (null for the first).

    The runs of a large kind are sorted in stretches; the last run of each is carried to the next.
    """
    dealt, large = stretches(runs, kind, order, least, known)
    w = Window.partitionBy(kind, "_stretch").orderBy(*order)
    run = F.struct(F.col(run_id).alias("id"), F.col(score).alias("score"))
    placed = dealt.withColumn("_before", F.lag(run).over(w))
    if large is not None:
        ends = dealt.filter(large).groupBy(kind, "_stretch").agg(F.max_by(run, F.struct(*order)).alias("_last"))
        ends = ends.select(kind, "_stretch", F.lag("_last").over(Window.partitionBy(kind).orderBy("_stretch")).alias("_carried"))
        placed = _with_stretch_facts(placed, ends, kind).withColumn("_before", F.coalesce("_before", "_carried"))
    return placed.select(*runs.columns, F.col("_before.id").alias("prev_run_id"), (F.col(score) - F.col("_before.score")).alias("score_delta"))


def latest_two(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """For each key with two rows or more: the latest values, those before, and the deltas.

    The limit on the rank lets Spark keep two rows of a key in each task before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    ranked = rows.select(key, *order, *values, F.row_number().over(w).alias("k")).filter("k <= 2")
    pick = lambda v, k: F.max(F.when(F.col("k") == k, F.col(v)))
    out = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[pick(v, 1).alias(f"{v}_latest") for v in values], *[pick(v, 2).alias(f"{v}_previous") for v in values]).filter("n = 2").drop("n")
    return out.withColumns({f"{v}_delta": F.col(f"{v}_latest") - F.col(f"{v}_previous") for v in values})


def build_trend(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Deltas between two builds (pass_rate, total, failed) by key; available is false where no build came before."""
    prev = previous.select(key, *[F.col(c).alias(f"p_{c}") for c in ("pass_rate", "total", "failed")], F.lit(True).alias("available"))
    from tracelake.functions.numbers import percent

    d = F.col("failed") - F.col("p_failed")
    rate, before = percent(F.col("pass_rate")), percent(F.col("p_pass_rate"))
    return current.join(prev, key, "left").select(
        key,
        F.coalesce("available", F.lit(False)).alias("available"),
        F.bround(rate - before, 2).alias("pass_rate_delta"),
        (F.col("total") - F.col("p_total")).alias("total_delta"),
        d.alias("failed_delta"),
        F.greatest(F.lit(0), d).alias("new_failures"),
        F.greatest(F.lit(0), -d).alias("resolved_failures"),
        (rate >= before).alias("improved"),
    )


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last `n` rows of each key with `place`, oldest first."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    kept = rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_place")))).drop("_place")


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "seq", least: int = LARGE_KEY, known: list | None = None) -> DataFrame:
    """1, 2, 3 ... within each key; a large key is numbered in stretches, each after the rows before it."""
    dealt, large = stretches(rows, key, order, least, known)
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(*order)))
    if large is None:
        return placed.select(*rows.columns, F.col("_place").alias(name))
    sizes = dealt.filter(large).groupBy(key, "_stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("_stretch")) - F.col("n")
    placed = _with_stretch_facts(placed, sizes.select(key, "_stretch", before.alias("_before")), key)
    return placed.select(*rows.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int").alias(name))


def next_sequence(existing: DataFrame, key: str, seq: str) -> DataFrame:
    """The next free number of each key."""
    return existing.groupBy(key).agg((F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next_seq"))


def function_ids(functions: DataFrame, module_no: str, order: list[str], digits: int = 2) -> DataFrame:
    """unit_id: SwUFn_, the module's number and a counter within the module."""
    counted = numbered(functions, module_no, order, "ordinal")
    pad = lambda c: F.lpad(F.col(c).cast("string"), digits, "0")
    return counted.withColumn("unit_id", F.concat(F.lit("SwUFn_"), pad(module_no), pad("ordinal"))).drop("ordinal")


def fused_ranks(ranked: list[DataFrame], key: str, k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists of (key, rank): key, score = sum of 1 / (k + rank)."""
    both = ranked[0].select(key, "rank")
    for more in ranked[1:]:
        both = both.unionByName(more.select(key, "rank"))
    out = both.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(top) if top else out


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows with the total; sizes are held to 1..500, pages count from 1."""
    size, number = min(500, max(1, size)), max(1, number)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", F.lit(rows.count()).cast("long"))


def top_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


#: Severities in the order they are listed.
SEVERITIES = ["error", "critical", "high", "warning", "medium", "style", "performance", "portability", "low", "information", "info", "note"]


def static_issues(findings: DataFrame, n: int) -> DataFrame:
    """The first `n` findings by severity, file and line as text."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower("severity")), F.lit(0)), F.lit(len(SEVERITIES) + 1))
    return findings.withColumn("severity_rank", rank.cast("int")).orderBy("severity_rank", "file", F.col("line").cast("string"), "message").limit(n)


def conversations(messages: DataFrame, conversation: str, updated: str) -> DataFrame:
    """Conversations with their number of messages and last update."""
    return messages.groupBy(conversation).agg(F.count(F.lit(1)).alias("messages"), F.max(updated).alias("updated"))


def keep_most(entries: DataFrame, weight: str, timestamp: str, key: str, most: int) -> DataFrame:
    """The `most` entries that stay when those of least weight, then least timestamp, are evicted."""
    return entries.orderBy(F.desc(weight), F.desc(timestamp), F.desc(key)).limit(most)


def retained(sessions: DataFrame, created: str, key: str, keep_days: int, now: Column, keep: list[str]) -> DataFrame:
    """Sessions young enough or on the keep list, newest first."""
    young = F.col(created) >= now - F.make_dt_interval(F.lit(keep_days))
    return sessions.filter(young | F.col(key).cast("string").isin(keep)).orderBy(F.desc(created), key)


def preceding_count(requests: DataFrame, client: str, ts: str, seconds: int = 60, least: int = LARGE_KEY, known: list | None = None) -> DataFrame:
    """Requests of the same client in the window before each one, itself included; rows exactly `seconds` older do not count.

    The requests of a large client are cut into pieces of `seconds`, and each is also seen by the
    piece after its own, which is as far as a window reaches.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    large = large_keys(requests, client, least, known)
    if large is None:
        w = Window.partitionBy(client).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
        return requests.withColumn("in_window", F.count(F.lit(1)).over(w))
    piece = F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint")
    pieces = F.when(large & micros.isNotNull(), F.array(piece, piece + 1)).otherwise(F.array(F.lit(None).cast("bigint")))
    seen = requests.select("*", F.explode(pieces).alias("_piece")).withColumn("_own", F.col("_piece").isNull() | (F.col("_piece") == piece))
    w = Window.partitionBy(client, "_piece").orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return seen.withColumn("in_window", F.count(F.lit(1)).over(w)).filter("_own").select(*requests.columns, "in_window")


def learned(events: DataFrame, keys: list[str]) -> DataFrame:
    """Weight and counters of entries learned again and again: weight 1 + 0.1 (n - 1), apply_count and error_count."""
    out = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, (F.lit(1.0) + 0.1 * (F.col("n") - 1)).alias("weight"), (F.col("n") - 1).alias("apply_count"), F.col("n").alias("error_count"))


def feedback_weight(votes: DataFrame, key: str, order: list[str], positive: str, least: int = LARGE_KEY, known: list | None = None) -> DataFrame:
    """Weight of each entry after its votes in order: plus or minus 0.2, never under 0.1; apply_count counts the good ones.

    The floor makes this a fold in order. The fold has a closed form: with running sums S of the
    steps, the end is the larger of 1 + S_n and 0.1 + S_n - min S_k over the votes. A large key's
    votes are summed in stretches; total and least sum of a stretch carry over to the next.
    """
    dealt, _ = stretches(votes, key, order, least, known)
    step = F.when(F.col(positive), F.lit(0.2)).otherwise(F.lit(-0.2))
    sums = F.sum(step).over(Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = dealt.select(key, "_stretch", F.col(positive).alias("good"), step.alias("step"), sums.alias("s"))
    runs = runs.groupBy(key, "_stretch").agg(F.sum("step").alias("total"), F.min("s").alias("least"), F.count_if("good").alias("good"))
    before = F.sum("total").over(Window.partitionBy(key).orderBy("_stretch")) - F.col("total")
    ends = runs.withColumn("least", before + F.col("least")).groupBy(key).agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.sum("good").alias("apply_count"))
    weight = F.greatest(1.0 + F.col("total"), 0.1 + F.col("total") - F.col("least"))
    return ends.select(key, F.round(weight, 6).alias("weight"), "apply_count")


def latest_progress(updates: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Last non-null value of each field of each key."""
    stamp = F.struct(*order)
    return updates.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), stamp)).alias(f) for f in fields])


def batches(rows: DataFrame, key: str, order: list[str], size: int, text: str, joined: str = "\n") -> DataFrame:
    """Documents of `size` rows each within a key: key, batch, n, text."""
    placed = numbered(rows, key, order, "k").withColumn("batch", F.floor((F.col("k") - 1) / size).cast("int"))
    parts = placed.groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("k", text))).alias("parts"))
    return parts.select(key, "batch", "n", F.array_join(F.transform("parts", lambda p: p[text]), joined).alias("text"))
