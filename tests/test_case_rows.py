"""Cases as one row each."""

from tracelake.sources import sinks


def test_case_rows_take_one_aggregation(spark, capsys):
    rows = [(1, "v1", 1.0), (1, "v2", 2.0), (2, "v2", 3.0), (2, "other", 9.0), (3, "other", 4.0), (4, None, 5.0)]
    out = sinks.case_rows(spark.createDataFrame(rows, "unit int, name string, value double"), ["unit"], "name", "value", ["v1", "v2"])
    out.explain()
    assert "pivotfirst" not in capsys.readouterr().out
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1.0, 2.0), (2, None, 3.0), (3, None, None), (4, None, None)]
