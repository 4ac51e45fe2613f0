"""Helpers the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def work_folder(spark: SparkSession) -> str:
    """The session's folder below `spark.checkpoint.dir` for checkpoints and tables between jobs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the session's checkpoint folder and cut its lineage.

    Lost executors cannot take the rows with them, and what follows sees one fixed set of rows.
    """
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet below the work folder and read again."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` gave, which nothing reads again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`; where a session names none, a temporary one, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="tracelake-checkpoint-")
    return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(row_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def slices(batch, columns: list[str], most: int = 4_000_000):
    """Cut an Arrow batch into runs of rows holding about `most` bytes of the text columns.

    A run has one row at least, so a single very long text is a run of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    size = np.zeros(batch.num_rows, dtype=np.int64)
    for name in columns:
        size += np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def hash_sample(df: DataFrame, id_col: str, want: int, seed: int) -> DataFrame:
    """About `want` rows of `df`, and never over twice as many: those whose id hashes below a threshold.

    The threshold follows the number of rows, so every size is sampled alike; tables of up to
    `want` rows are taken whole. Rows with a null id are left out.
    """
    rows = df.filter(F.col(id_col).isNotNull())
    n = rows.count()
    if n <= want:
        return rows
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30))
    return rows.filter(place < int((1 << 30) * want / n)).orderBy(place, id_col).limit(2 * want)


def join_by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, hot: int = 256, parts: int = 64) -> DataFrame:
    """`rows` left-joined with one row a key of `groups`; keys of over `hot` rows are dealt over `parts` tasks.

    Large groups are few (one in `hot` rows at most), so a copy of each for every part stays small.
    `spread` deals the rows of a key. Rows that met a large group get a key of their own in the
    second join, so that no key of it is hot.
    """
    facts = [c for c in groups.columns if c != key]
    large = groups.filter(F.col(size) > hot).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    first = rows.withColumn("part", F.pmod(F.hash(spread), F.lit(parts))).join(large, [key, "part"], "left").drop("part")
    small = groups.filter(F.col(size) <= hot).select(F.col(key).cast("string").alias("small_key"), *[F.col(c).alias(f"small_{c}") for c in facts])
    free = F.when(F.col(size).isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("of "), spread.cast("string")))
    both = first.withColumn("free_key", free).join(small, F.col("free_key") == F.col("small_key"), "left")
    return both.select(*rows.columns, *[F.coalesce(c, f"small_{c}").alias(c) for c in facts])
