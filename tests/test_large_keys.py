"""Ordered operators with a large key cut into stretches give the rows of one plain window."""

import random
from datetime import datetime, timedelta

import pytest

from tracelake.operators import history

LEAST = 50


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    start = datetime(2024, 3, 10)
    out = []
    for i in range(900):
        key = rng.choice(["hot", "hot", None, "a", "b", f"k{i}"])
        ts = None if rng.random() < 0.03 else start + timedelta(seconds=rng.choice([rng.randrange(3000), 77]))
        out.append((key, ts, i, rng.random() * 100, rng.random() < 0.4))
    return spark.createDataFrame(out, "k string, ts timestamp, id long, v double, good boolean").cache()


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    left, right = sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key)
    assert a.columns == b.columns and a.dtypes == b.dtypes
    assert left == right


@pytest.mark.parametrize("order", [["ts", "id"], ["id"]])
def test_numbers_and_previous_runs(rows, order):
    assert history.stretches(rows, "k", order, LEAST)[0].select("_stretch").distinct().count() > 3
    same(history.numbered(rows, "k", order, "n", LEAST), history.numbered(rows, "k", order, "n"))
    same(history.previous_run(rows, "k", order, "id", "v", LEAST), history.previous_run(rows, "k", order, "id", "v"))


def test_window_counts(rows):
    same(history.preceding_count(rows, "k", "ts", 60, LEAST), history.preceding_count(rows, "k", "ts", 60))


def test_feedback(rows):
    cut = history.feedback_weight(rows, "k", ["ts", "id"], "good", LEAST)
    same(cut, history.feedback_weight(rows, "k", ["ts", "id"], "good"))
    weights = {r.k: r.weight for r in cut.collect()}
    for key in ("hot", None):
        w = 1.0
        for r in sorted((r for r in rows.collect() if r.k == key), key=lambda r: (r.ts is not None, r.ts or datetime.min, r.id)):
            w = max(0.1, w + (0.2 if r.good else -0.2))
        assert weights[key] == pytest.approx(w, abs=1e-5)


def test_empty_and_text_order(rows):
    none = rows.filter("id < 0")
    assert history.numbered(none, "k", ["ts", "id"], "n", LEAST).count() == 0
    assert history.stretches(rows, "v", ["k"], LEAST)[1] is None


def test_known_keys_run_no_job_first(spark, rows):
    """With the large keys named, or named as none, the plan is made without a job and gives the same rows."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("known keys", "none so far")
    plan = history.numbered(rows, "k", ["ts", "id"], "n", known=[])
    assert not tracker.getJobIdsForGroup("known keys")
    spark.sparkContext._jsc.clearJobGroup()
    same(plan, history.numbered(rows, "k", ["ts", "id"], "n"))
    same(history.numbered(rows, "k", ["ts", "id"], "n", known=["hot", None]), history.numbered(rows, "k", ["ts", "id"], "n"))
    same(history.previous_run(rows, "k", ["ts", "id"], "id", "v", known=["hot"]), history.previous_run(rows, "k", ["ts", "id"], "id", "v"))
