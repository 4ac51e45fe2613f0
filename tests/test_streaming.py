from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelake.streaming import ingest


def drained(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_file_ingest_takes_only_what_is_new(spark, tmp_path):
    src, out, check = (tmp_path / n for n in ("src", "out", "check"))
    src.mkdir()
    (src / "a.txt").write_text("x" * 2500)
    run = lambda: ingest.append_to(ingest.chunk_stream(ingest.text_files(spark, str(src))), str(out), str(check)).awaitTermination()
    run()
    assert spark.read.parquet(str(out)).count() == 3
    (src / "b.txt").write_text("short")
    run()
    assert spark.read.parquet(str(out)).count() == 4


def test_batch_ingest_by_signature(spark):
    t = datetime(2024, 1, 1)
    seen = spark.createDataFrame([("a", t, 1), ("b", t, 1)], "path string, mtime timestamp, size int")
    now = spark.createDataFrame([("a", t, 1), ("b", t, 2), ("c", t, 1)], "path string, mtime timestamp, size int")
    assert sorted(r["path"] for r in ingest.changed_files(now, seen).collect()) == ["b", "c"]


def test_learned_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([("e", "f"), ("e", "f"), ("g", "h")], "error string, fix string")
    rows.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("error string, fix string").json(str(tmp_path / "in"))
    drained(ingest.learned(stream), "update", "learned_out")
    got = {(r["error"], r["fix"]): (round(r["weight"], 6), r["error_count"]) for r in spark.table("learned_out").collect()}
    assert got == {("e", "f"): (1.1, 2), ("g", "h"): (1.0, 1)}


def test_rate_limit_counts_accepted_only(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("c", i, start + timedelta(seconds=i)) for i in range(8)] + [("d", 100, start)]
    spark.createDataFrame(rows, "client string, request long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, request long, ts timestamp").parquet(str(tmp_path / "in"))
    drained(ingest.admitted(stream, limit=2, seconds=5.0), "append", "admitted_out")
    got = sorted(r["request"] for r in spark.table("admitted_out").filter("accepted").collect())
    assert got == [0, 1, 5, 6, 100]


def test_windowed_levels_and_latest_fields(spark, tmp_path):
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(start, "ERROR"), (start + timedelta(minutes=1), "ERROR"), (start + timedelta(minutes=7), "INFO")], "ts timestamp, level string").write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema("ts timestamp, level string").parquet(str(tmp_path / "lines"))
    drained(ingest.windowed_levels(stream, "ts", "level"), "complete", "levels_out")
    assert sorted((r["level"], r["n"]) for r in spark.table("levels_out").collect()) == [("ERROR", 2), ("INFO", 1)]
    spark.createDataFrame([("k", start, "a", None), ("k", start + timedelta(1), None, "m")], "k string, ts timestamp, stage string, message string").write.parquet(str(tmp_path / "up"))
    updates = spark.readStream.schema("k string, ts timestamp, stage string, message string").parquet(str(tmp_path / "up"))
    ingest.latest_fields(updates, str(tmp_path / "state"), "k", str(tmp_path / "cp")).awaitTermination()
    assert [(r["stage"], r["message"]) for r in spark.read.parquet(str(tmp_path / "state/version=0")).select(F.col("stage"), "message").collect()] == [("a", "m")]
