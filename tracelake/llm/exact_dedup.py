"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes meets a fixed pattern, so equal stretches
of text give equal chunks wherever they stand. Each chunk's content is moved once per task that
holds it, to prove that a short identifier stands for one content only. From there on documents
are compared as ordered lists of identifiers, and no text moves again.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import join_by_size, settle, slices

WINDOW_STEPS = 5  # the rolling hash covers 2**5 bytes


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(0, 2**32, 256, dtype=np.uint32)


def boundaries(data: np.ndarray, mean_bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text's bytes; the last end is the text's length."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    rolling = _gear()[data]
    for step in range(WINDOW_STEPS):
        reach = 1 << step
        rolling[reach:] = rolling[reach:] + (rolling[:-reach] << np.uint32(reach))
    marks = np.flatnonzero((rolling >> np.uint32(32 - mean_bits)) == 0) + 1
    ends, last = [], 0
    for mark in marks.tolist():
        while mark - last > most:
            last += most
            ends.append(last)
        if mark - last >= least:
            last = mark
            ends.append(last)
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _short(content: bytes, bits: int) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True) >> (64 - bits)


def chunked(text: str | None, mean_bits: int, least: int, most: int) -> tuple[bytes, list[bytes]]:
    """The normalised text in UTF-8 (null: empty; A-Z lower-cased, nothing else) and its chunks."""
    whole = (text or "").encode("utf-8", "surrogatepass").lower()
    ends = boundaries(np.frombuffer(whole, dtype=np.uint8), mean_bits, least, most)
    return whole, [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _recipes(id_type: pa.DataType, id_bits: int, cut: tuple[int, int, int]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, ["text"]):
                shas, ids, proofs = [], [], []
                for text in part.column("text"):
                    whole, chunks = chunked(text.as_py(), *cut)
                    shas.append(hashlib.sha256(whole).hexdigest())
                    ids.append([_short(c, id_bits) for c in chunks])
                    proofs.append([hashlib.sha256(c).digest() for c in chunks])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(id_type), part.column("text_key"), pa.array(shas, pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array(proofs, pa.list_(pa.binary()))],
                    names=["doc_id", "text_key", "text_sha256", "recipe", "proofs"],
                )

    return run


def _contents(id_bits: int, cut: tuple[int, int, int]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, ["text"]):
                found = {c: None for text in part.column("text") for c in chunked(text.as_py(), *cut)[1]}
                yield pa.RecordBatch.from_arrays([pa.array([_short(c, id_bits) for c in found], pa.int64()), pa.array(list(found), pa.binary())], names=["chunk_id", "content"])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_bits: int = 11, least: int = 512, most: int = 16_384, id_bits: int = 64) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, text_key
    (xxhash64 of the text as it is).

    Texts are equal when identical after lower-casing A-Z only; a null text is the empty text.
    The row with the largest id of a group stays (a null id ranks below every other), and of
    repeated rows with that id exactly one. An empty table gives an empty result; other columns
    of `docs` are not read, so their names cannot clash. Texts of any length are cut whole.

    `id_bits` shortens the chunk identifiers. Identifiers found to stand for several contents
    are replaced by the contents' full digests, so fewer bits change the cost, not the result.
    """
    cut = (mean_bits, least, most)
    id_type = docs.schema[id_col].dataType
    arrow_id = pa.int64() if id_type.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    out_id = "long" if arrow_id == pa.int64() else "string"
    rows = docs.select(F.col(id_col).cast(out_id).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    recipes = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_recipes(arrow_id, id_bits, cut), f"doc_id {out_id}, text_key long, text_sha256 string, recipe array<long>, proofs array<binary>")
    recipes = settle(recipes.withColumn("row_no", F.monotonically_increasing_id()))
    # Grouping by the content itself is the proof: two groups of one identifier are a collision.
    contents = rows.select("text").mapInArrow(_contents(id_bits, cut), "chunk_id long, content binary").groupBy("chunk_id", "content").agg(F.count(F.lit(1)).alias("uses"))
    collided = settle(contents.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("chunk_id"))
    if collided.isEmpty():
        verified = recipes.withColumn("recipe", F.transform("recipe", lambda x: x.cast("string")))
    else:
        parts = recipes.select("row_no", F.posexplode(F.arrays_zip(F.col("recipe").alias("chunk_id"), F.col("proofs").alias("proof"))).alias("place", "part"))
        parts = parts.select("row_no", "place", F.col("part.chunk_id").alias("chunk_id"), F.col("part.proof").alias("proof"))
        marked = parts.join(collided.withColumn("clash", F.lit(True)), "chunk_id", "left")
        named = marked.withColumn("name", F.when(F.col("clash"), F.concat_ws(":", "chunk_id", F.hex("proof"))).otherwise(F.col("chunk_id").cast("string")))
        lists = named.groupBy("row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("recipe"))
        verified = recipes.drop("recipe").join(lists, "row_no", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<string>")))
    verified = verified.select("doc_id", "row_no", "text_key", "text_sha256", F.array_join("recipe", ",").alias("recipe"))
    groups = verified.groupBy("recipe").agg(F.max(F.struct("doc_id", "row_no")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    joined = join_by_size(verified, groups.filter("group_size > 1"), "recipe", "group_size", F.col("row_no"))
    alone = F.col("best").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("best.row_no"))).alias("kept"),
        "text_sha256",
        "text_key",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; exactly one row of each group."""
    groups = settle(exact_groups(docs, id_col, text_col, **options))
    kept = groups.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    repeats = groups.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    same = F.col(id_col).eqNullSafe(F.col("kept_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("kept_key"))
    if repeats.isEmpty():
        return docs.join(kept, same, "left_semi")
    # Only rows that repeat an id together with its text are gathered, one a group.
    again = docs.join(kept.join(repeats, ["kept_id", "kept_key"], "left_semi").unionByName(kept.filter("kept_id is null")), same, "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(kept, same, "left_semi").join(repeats, same, "left_anti").unionByName(again.join(repeats, same, "left_semi"))
