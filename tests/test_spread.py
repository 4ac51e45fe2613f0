"""Tables that come in few files: what is written from their rows is read by all tasks."""

import pytest

from tracelake.plans import catalog


@pytest.mark.parametrize("name", ["pdf_texts", "conditioned_code", "requirement_tables"])
def test_rows_are_dealt_before_they_are_read(spark, capsys, name):
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
