"""Job states with a heartbeat, and entries with a time to live: as streams with timed state, and over tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINISHED = ("completed", "failed")
#: Seconds after which a job that says nothing is reported; seconds that an entry lives.
SILENCE, LIFE = 15.0, 30.0
JOB = "job string, status string, stage string, message string, started_at timestamp, updated_at timestamp, finished_at timestamp, stalled boolean"
JOB_STATE = "status string, stage string, message string, started_at timestamp, updated_at timestamp, finished_at timestamp"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _follow(silence: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None] * 6
        if state.hasTimedOut:
            yield pd.DataFrame([(*key, *now, True)], columns=[c.split()[0] for c in JOB.split(", ")])
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for row in rows.itertuples():
            if now[4] is not None and row.ts < now[4]:
                continue  # an update from before the last one
            for i, value in enumerate((row.status, row.stage, row.message)):
                now[i] = value if value is not None else now[i]
            if now[0] == "running" and now[3] is None:
                now[3] = row.ts
            now[4] = row.ts
            now[5] = row.ts if now[0] in FINISHED else now[5]
        yield pd.DataFrame([(*key, *now, False)], columns=[c.split()[0] for c in JOB.split(", ")])
        if now[0] in FINISHED:
            state.remove()
        else:
            state.update(tuple(now))
            state.setTimeoutTimestamp(max(int(now[4].timestamp() * 1000 + silence * 1000), state.getCurrentWatermarkMs() + 1))

    return run


def job_states(updates: DataFrame, silence: float = SILENCE, late: str = "0 seconds") -> DataFrame:
    """State of each job after a batch of its updates (job, ts, status, stage, message; null fields stay as they were).

    A job that is not finished and sends nothing for `silence` seconds of event time is reported once more
    as stalled, and forgotten. A finished job is forgotten at once. Updates older than the last one count
    for nothing.
    """
    return updates.withWatermark("ts", late).groupBy("job").applyInPandasWithState(_follow(silence), JOB, JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def job_history(updates: DataFrame, silence: float = SILENCE) -> DataFrame:
    """The same over a table: job, status, started_at, updated_at, finished_at, updates, stalls.

    `stalls` counts the updates of an unfinished job after which nothing came for over `silence` seconds,
    the last one left out, as nothing tells how long it has been.
    """
    order = Window.partitionBy("job").orderBy("ts")
    last = F.last("status", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = updates.select("job", "ts", last.alias("now"), (micros(F.lead("ts").over(order)) - micros(F.col("ts"))).alias("gap"))
    done = F.col("now").isin(*FINISHED)
    best = F.max_by("now", "ts").alias("status")
    return rows.groupBy("job").agg(best, F.min(F.when(F.col("now") == "running", F.col("ts"))).alias("started_at"), F.max("ts").alias("updated_at"), F.max(F.when(done, F.col("ts"))).alias("finished_at"), F.count(F.lit(1)).alias("updates"), F.count_if(~F.coalesce(done, F.lit(False)) & (F.col("gap") > int(silence * 1_000_000))).alias("stalls"))


def _hold(life: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["key", "value", "ts", "event"]
        if state.hasTimedOut:
            value, ts = state.get
            state.remove()
            yield pd.DataFrame([(*key, value, ts, "expired")], columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        value, ts = rows["value"].iloc[-1], rows["ts"].iloc[-1]
        if state.exists and state.get[1] > ts:
            return
        state.update((value, ts))
        state.setTimeoutTimestamp(max(int(ts.timestamp() * 1000 + life * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, value, ts, "set")], columns=columns)

    return run


def expiring(updates: DataFrame, life: float = LIFE, late: str = "0 seconds") -> DataFrame:
    """Entries (key, value, ts) as they are set, and once more as expired after `life` seconds of event time without a new value."""
    out = "key string, value string, ts timestamp, event string"
    return updates.withWatermark("ts", late).groupBy("key").applyInPandasWithState(_hold(life), out, "value string, ts timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def read_through(reads: DataFrame, updates: DataFrame, life: float = LIFE) -> DataFrame:
    """Over tables: each read (key, ts, and its own columns) with the value it finds, and whether it is a hit.

    A read finds the last value set at or before its time, unless that is over `life` seconds old. Both
    sides meet in one ordered window of a key, not in a join of all pairs.
    """
    own = [c for c in reads.columns if c not in ("key", "ts")]
    told = updates.select("key", "ts", F.struct("ts", "value").alias("set"), F.lit(0).alias("late"), F.lit(None).cast(reads.select(F.struct("*").alias("r")).schema["r"].dataType).alias("read"))
    asked = reads.select("key", "ts", F.lit(None).cast(told.schema["set"].dataType).alias("set"), F.lit(1).alias("late"), F.struct(*[F.col(c) for c in reads.columns]).alias("read"))
    before = Window.partitionBy("key").orderBy("ts", "late", F.col("set.value")).rowsBetween(Window.unboundedPreceding, 0)
    met = told.unionByName(asked).withColumn("held", F.last("set", ignorenulls=True).over(before)).filter("late = 1")
    fresh = F.coalesce(micros(F.col("ts")) - micros(F.col("held.ts")) <= int(life * 1_000_000), F.lit(False))
    return met.select("key", "ts", *[F.col(f"read.{c}").alias(c) for c in own], F.when(fresh, F.col("held.value")).alias("value"), fresh.alias("hit"))
