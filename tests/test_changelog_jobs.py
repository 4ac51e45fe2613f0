"""Change logs against a slow comparison, and timed states as streams."""

import datetime as dt
import random

import pytest

from tracelake.operators import changelog
from tracelake.plans import catalog, registry
from tracelake.streaming import jobs


def clean(v):
    return [clean(x) for x in v] if isinstance(v, list) else ("" if v is None else str(v).strip())


def test_change_log_as_slow_comparison(spark):
    rnd = random.Random(6)
    rows = []
    for doc in "ab":
        for run in range(5):
            for name in rnd.sample(["f1", " F2", "f3 ", "f4"], rnd.randint(1, 4)):
                rows.append((doc, f"r{run}{doc}", run, name, rnd.choice([None, "x", " x "]), rnd.choice([None, [], ["p"], [" p", None]]), rnd.choice(["QM", "A"])))
    rows += [("a", "r9a", 9, "", "x", None, "A"), ("c", "only", 1, "f1", None, None, None)]
    entries = spark.createDataFrame(rows, "doc string, run string, at int, name string, description string, calls array<string>, asil string")
    fields = ["description", "calls", "asil"]
    want = set()
    for doc in "abc":
        runs = sorted({(r[2], r[1]) for r in rows if r[0] == doc})
        before = {}
        for k, (_, run) in enumerate(runs):
            now = {r[3].strip().lower(): r for r in rows if r[0] == doc and r[1] == run and r[3].strip()}
            for key in {*now, *before}:
                new, old = now.get(key), before.get(key)
                differ = "created" if old is None else "removed" if new is None else ",".join(f for f, a, b in zip(fields, old[4:], new[4:], strict=True) if (a is None) != (b is None) and f == "calls" or clean(a) != clean(b))
                if differ:
                    want.add((doc, run, runs[k - 1][1] if k else None, (new or old)[3].strip(), differ, None if old is None else clean(old[6]), None if new is None else len(new[5] or [])))
            before = now
    log = changelog.change_log(entries, "doc", "run", ["at"], "name", fields)
    got = {(r["doc"], r["run"], r["previous_run"], r["name"], ",".join(r["fields_changed"]), r["before"] and r["before"]["asil"], r["after"] and r["after"]["calls_count"]) for r in log.collect()}
    assert got == want
    totals = {(r["doc"], r["run"]): (r["status"], r["created"] + r["removed"] + r["changed"]) for r in changelog.change_totals(log, entries, "doc", "run", ["at"]).collect()}
    assert len(totals) == 12 and all(totals[k][1] == sum(1 for w in want if w[:2] == k) and (totals[k][0] == "unchanged") == (totals[k][1] == 0) for k in totals)
    assert changelog.change_log(entries.limit(0), "doc", "run", ["at"], "name", fields).count() == 0


def test_entries_stand_in_as_many_parts_as_their_rows_need(spark, monkeypatch):
    settled, checkpointed = [], changelog.checkpointed
    monkeypatch.setattr(changelog, "checkpointed", lambda df: settled.append(checkpointed(df)) or settled[-1])
    for name in ("change_log", "change_totals"):
        monkeypatch.setattr(registry, "ROWS_A_PART", 250_000)
        want = sorted(map(str, catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
        monkeypatch.setattr(registry, "ROWS_A_PART", 500)
        settled.clear()
        got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert [df.rdd.getNumPartitions() for df in settled] == [12]  # 6,000 lines
        assert sorted(map(str, got.collect())) == want


def at(s):
    return dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)


def streamed(spark, tmp_path, schema, batches, make):
    """All rows that a query gives for batches that come one after another."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        next((tmp_path / f"b{k}").glob("*.parquet")).rename(folder / f"{k:02}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    keep = lambda batch, _: seen.extend(batch.collect())
    query = make(stream).writeStream.outputMode("update").foreachBatch(keep) if make is jobs.job_states else make(stream).writeStream.foreachBatch(keep)
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return seen


@pytest.fixture
def utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_a_silent_job_is_reported(spark, tmp_path, utc):
    schema = "job string, ts timestamp, status string, stage string, message string"
    batches = [
        [("a", at(0), "queued", "prepare", "waits"), ("b", at(1), "running", "scan", None)],
        [("a", at(5), "running", "scan", None), ("a", at(3), None, None, "old"), ("b", at(9), None, None, "beat")],
        [("a", at(12), "completed", "done", None), ("c", at(40), "running", None, None)],
        [("c", at(41), None, "late", None)],
        [("c", at(90), "failed", None, None)],
    ]
    rows = streamed(spark, tmp_path, schema, batches, jobs.job_states)
    stalled = [(r["job"], r["stage"], r["message"], r["updated_at"]) for r in rows if r["stalled"]]
    assert [s[:3] for s in stalled][0] == ("b", "scan", "beat") and "a" not in {s[0] for s in stalled}
    done = next(r for r in rows if r["job"] == "a" and r["status"] == "completed")
    assert done["started_at"] is not None and done["finished_at"] is not None and done["message"] in ("waits", "old")


def test_entries_expire(spark, tmp_path, utc):
    batches = [[("k", "one", at(0)), ("m", "two", at(1))], [("k", "three", at(20))], [("z", "x", at(45))], [("z", "y", at(60))]]
    rows = [(r["key"], r["value"], r["event"]) for r in streamed(spark, tmp_path, "key string, value string, ts timestamp", batches, jobs.expiring)]
    assert rows.count(("m", "two", "expired")) == 1 and rows.count(("k", "three", "expired")) == 1
    assert ("k", "one", "expired") not in rows and ("k", "one", "set") in rows and ("k", "three", "set") in rows


def test_read_through_as_slow_lookup(spark):
    rnd = random.Random(2)
    sets = [(rnd.choice("ab"), f"v{i}", at(rnd.randint(0, 200))) for i in range(30)]
    sets = list({(k, t): (k, v, t) for k, v, t in sets}.values())
    reads = [(rnd.choice("abc"), at(rnd.randint(0, 260)), i) for i in range(60)]
    got = {r["n"]: (r["value"], r["hit"]) for r in jobs.read_through(spark.createDataFrame(reads, "key string, ts timestamp, n int"), spark.createDataFrame(sets, "key string, value string, ts timestamp"), 30).collect()}
    for key, ts, n in reads:
        last = max(((t, v) for k, v, t in sets if k == key and t <= ts), default=None)
        want = last[1] if last and (ts - last[0]).total_seconds() <= 30 else None
        assert got[n] == (want, want is not None)


def test_job_history_counts_stalls(spark):
    rows = [("a", at(0), "running"), ("a", at(20), None), ("a", at(30), "completed"), ("a", at(90), None), ("b", at(0), "running")]
    got = {r["job"]: (r["status"], r["stalls"], r["updates"]) for r in jobs.job_history(spark.createDataFrame(rows, "job string, ts timestamp, status string")).collect()}
    assert got == {"a": ("completed", 1, 4), "b": ("running", 0, 1)}
