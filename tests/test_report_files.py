"""Reports that are written as files: files stay few however many pages there are."""

from pathlib import Path

from tracelake.plans import catalog, exchanges


def test_many_coverage_reports_are_few_files(spark, tmp_path):
    rows = [(i * exchanges.PAGE_KEYS + j, "Brand#1") for i in range(48) for j in range(i % 3 + 1)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    folder = lambda: {f for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("coverage-*/**/*.txt")}
    exchanges.checkpoint_folder(spark)
    before = folder()
    got = catalog.QUERIES["coverage_files"](spark, str(tmp_path)).collect()
    assert sorted((r["line_rate"], r["branch_rate"], r["pages"]) for r in got) == [(0.1, 0.01, 16), (0.2, 0.02, 16), (0.3, 0.03, 16)]
    assert 0 < len(folder() - before) <= 48 // exchanges.FILE_BLOCKS
