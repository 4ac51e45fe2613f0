"""Incremental ingest and keyed state with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.operators.search import windows


def text_files(spark: SparkSession, path: str, per_trigger: int = 1_000) -> DataFrame:
    """path, mtime, text of new files below a folder; the stream's checkpoint remembers those seen."""
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(path)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))


def chunk_stream(files: DataFrame, size: int = 1200, overlap: int = 200, most: int = 12) -> DataFrame:
    """path, mtime, chunk, text of a file stream."""
    return files.select("path", "mtime", F.posexplode(F.slice(windows(F.col("text"), size, overlap), 1, most)).alias("chunk", "text"))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Everything that is there now, once, as Parquet; a later run takes up what is new."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_files(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, mtime, size) whose signature is not among those seen: the batch form of the ingest."""
    signature = lambda df: df.withColumn("signature", F.concat_ws(":", F.unix_micros("mtime").cast("string"), F.col("size").cast("string")))
    return signature(listing).join(signature(seen).select("path", "signature"), ["path", "signature"], "left_anti")


def _learn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n = state.get[0] if state.exists else 0
    n += sum(len(b) for b in batches)
    state.update((n,))
    yield pd.DataFrame([(*key, 1.0 + 0.1 * (n - 1), n - 1, n)], columns=["error", "fix", "weight", "apply_count", "error_count"])


def learned(events: DataFrame) -> DataFrame:
    """Weight and counters of (error, fix) pairs as events come: an update of a pair for each batch it is in."""
    out = "error string, fix string, weight double, apply_count long, error_count long"
    return events.groupBy("error", "fix").applyInPandasWithState(_learn, out, "n long", "update", GroupStateTimeout.NoTimeout)


def _admit(limit: int, seconds: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        for batch in batches:
            rows = batch.sort_values(["ts", "request"])
            out = []
            for ts in rows["ts"]:
                now = ts.timestamp()
                accepted = [t for t in accepted if now - t < seconds]
                ok = len(accepted) < limit
                if ok:
                    accepted.append(now)
                out.append(ok)
            yield pd.DataFrame({"client": key[0], "request": rows["request"].to_numpy(), "ts": rows["ts"].to_numpy(), "accepted": out})
        state.update((accepted,))

    return run


def admitted(requests: DataFrame, limit: int = 300, seconds: float = 60.0) -> DataFrame:
    """Requests (client, request, ts) with whether they are under the limit of accepted ones in the last seconds.

    A client's state holds the times it was accepted at, `limit` at most.
    """
    return requests.groupBy("client").applyInPandasWithState(_admit(limit, seconds), "client string, request long, ts timestamp, accepted boolean", "accepted array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_levels(lines: DataFrame, ts: str, level: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines of each level in windows of event time; late rows are taken up to the watermark."""
    return lines.withWatermark(ts, late).groupBy(F.window(ts, length).alias("span"), F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n")).select("span.start", "span.end", "level", "n")


def latest_fields(updates: DataFrame, target: str, key: str, checkpoint: str):
    """Last value of each field of a key over all batches, as one Parquet version a batch beside `target`."""

    def merge(batch: DataFrame, epoch: int) -> None:
        fields = [c for c in batch.columns if c not in (key, "ts")]
        pick = batch.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ts"))).alias(f) for f in fields])
        if epoch:
            old = batch.sparkSession.read.parquet(f"{target}/version={epoch - 1}").select(key, *[F.col(f).alias(f"old_{f}") for f in fields])
            pick = pick.join(old, key, "full_outer").select(key, *[F.coalesce(f, f"old_{f}").alias(f) for f in fields])
        pick.write.mode("overwrite").parquet(f"{target}/version={epoch}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
