"""Quality score from compression: zstandard with a dictionary of good text against one of bad text.

A text is cut into blocks; each block is compressed with either dictionary. What the good
dictionary saves over the bad one, as a share of both sizes, is the raw measure; a logistic
curve fitted on labelled texts outside the dictionaries turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import hash_sample, slices

#: Labelled rows of each class used, whole texts, and a dictionary's bytes.
SAMPLE_ROWS = 1_000
DICT_BYTES = 131_072
BLOCK_BYTES = 512
SEGMENT_BYTES = 256
LEVEL = 6


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def compressors(self):
        import zstandard

        made = []
        for content in (self.good, self.bad):
            data = zstandard.ZstdCompressionDict(content or b" ")
            data.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made


def difference(text: str | None, good, bad) -> float | None:
    """Normalised compressed-size difference over all blocks of the whole text; None where there is nothing to compress."""
    data = (text or "").strip().encode("utf-8", "replace")
    if not data:
        return None
    a = b = 0
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES]
        a += len(good.compress(block))
        b += len(bad.compress(block))
    return (b - a) / (a + b)


def dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary trained on all blocks of the whole texts; of very few blocks, the texts themselves."""
    import zstandard

    data = [t.strip().encode("utf-8", "replace") for t in texts]
    blocks = [d[at : at + BLOCK_BYTES] for d in data for at in range(0, len(d), BLOCK_BYTES)]
    whole = b"\n".join(data)
    if len(whole) <= DICT_BYTES:
        return whole
    # The trainer wants samples of eight bytes and more.
    return zstandard.train_dictionary(DICT_BYTES, [b for b in blocks if len(b) >= 8], k=SEGMENT_BYTES, d=8).as_bytes()


def _terms(d: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones_like(d), 10 * d])


def _score(model: CompressionModel, d: float | None) -> float:
    if d is None:
        return model.prior
    z = float(_terms(np.array([d])) @ np.array(model.weights))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps on the ridge-penalised logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(texts: list[str], labels: list[int], good_share: float | None = None) -> CompressionModel:
    """Even rows fill the dictionaries and odd rows fit the curve; rows come in random order.

    Where the sample does not hold the classes in the proportion of all labelled rows, `good_share`
    tells that proportion, and the curve is moved by the difference of the log odds.
    """
    pools = {0: [t for t, y in zip(texts, labels, strict=True) if y == 0 and t], 1: [t for t, y in zip(texts, labels, strict=True) if y == 1 and t]}
    share = len(pools[1]) / max(1, len(pools[0]) + len(pools[1]))
    share = share if good_share is None else good_share
    if not pools[0] or not pools[1]:  # one class or none: nothing to tell apart
        return CompressionModel(b"", b"", (0.0, 0.0), 0.5 if not pools[0] and not pools[1] else share)
    content = {y: dictionary(pool[::2]) for y, pool in pools.items()}
    draft = CompressionModel(content[1], content[0], (0.0, 0.0), share)
    good, bad = draft.compressors()
    rows = [(difference(t, good, bad), y) for y, pool in pools.items() for t in (pool[1::2] or pool)]
    d = np.array([x for x, _ in rows if x is not None])
    y = np.array([y for x, y in rows if x is not None], dtype=float)
    if not len(d):
        return draft
    weights = _logistic(_terms(d), y)
    seen, true = ((p + 1e-6) / (1 - p + 1e-6) for p in (y.mean(), share))
    weights[0] += np.log(true / seen)
    return CompressionModel(content[1], content[0], tuple(weights.tolist()), share)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> CompressionModel:
    """Train on about `sample_rows` labelled rows of either class (never over twice as many), picked by a hash of the id.

    Only ids are ordered and only the picked rows' whole texts reach the driver, so neither grows
    with the corpus. Null ids, labels and texts are left out, and texts that occur again count
    once. Where labels of one id, or of equal texts, differ, the largest label counts.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [hash_sample(known.filter(F.col("label") == y), "doc_id", sample_rows, 10) for y in (0, 1)]
    ids = [r for part in picked for r in part.collect()]
    if not ids:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in ids], known.schema)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").filter("text is not null").collect()
    unique = dict(sorted((r["text"], r["label"]) for r in rows))
    shuffled = sorted(unique.items(), key=lambda x: _mix(x[0]))
    return train([t for t, _ in shuffled], [y for _, y in shuffled], n.get(1, 0) / sum(n.values()))


def _mix(text: str) -> bytes:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()


def _scores(model: CompressionModel):
    def run(batches):
        good, bad = model.compressors()
        for batch in batches:
            for part in slices(batch, ["text"]):
                scores = [_score(model, difference(t.as_py(), good, bad)) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, score (0 to 1, higher: better).

    Whole texts are read, block by block. A null, empty or blank text scores the share of good
    texts among the labelled ones. Null and repeated ids pass through; other columns are not read. The
    model holds two dictionaries of DICT_BYTES at most, whatever the corpus.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), f"doc_id {kind}, score double")
