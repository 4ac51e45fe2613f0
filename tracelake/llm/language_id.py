"""Language identification with a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length. Filters of several widths slide over
the bytes' embeddings, max pooling keeps each filter's strongest answer, and a softmax layer
gives a language distribution per window. A document's distribution is the mean over all its
windows, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import hash_sample, slices

#: Labelled rows used to train, whole texts.
SAMPLE_ROWS = 1_000
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
EMBEDDING = 6
EPOCHS = 6
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    langs: list[str]
    embed: np.ndarray  # (256, EMBEDDING); byte 0 also pads
    kernel: np.ndarray  # (max width * EMBEDDING, filters); narrow filters hold zeros at their end
    kernel_bias: np.ndarray
    dense: np.ndarray  # (filters, langs)
    dense_bias: np.ndarray


def _kernel_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS), EMBEDDING, FILTERS * len(WIDTHS)), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask.reshape(-1, FILTERS * len(WIDTHS))


def _unfold(net: ByteConvNet, windows: np.ndarray) -> np.ndarray:
    """(windows, positions, max width * EMBEDDING) of the embedded bytes."""
    padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
    flat = net.embed[padded].reshape(len(windows), -1)
    view = np.lib.stride_tricks.sliding_window_view(flat, max(WIDTHS) * EMBEDDING, axis=1)
    return np.ascontiguousarray(view[:, ::EMBEDDING])


def _forward(net: ByteConvNet, windows: np.ndarray):
    unfolded = _unfold(net, windows)
    answers = unfolded.reshape(-1, unfolded.shape[2]) @ net.kernel
    answers = answers.reshape(len(windows), -1, net.kernel.shape[1])
    strongest = answers.max(axis=1)
    pooled = np.maximum(strongest + net.kernel_bias, 0)
    logits = pooled @ net.dense + net.dense_bias
    logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    return unfolded, answers, pooled, e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text's bytes, the last one padded, and the bytes in each."""
    n = max(1, -(-len(data) // length))
    out = np.zeros(n * length, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    sizes = np.full(n, length, dtype=np.int64)
    sizes[-1] = len(data) - (n - 1) * length
    return out.reshape(n, length), sizes


def train(texts: list[str], langs: list[str], seed: int = 7) -> ByteConvNet | None:
    """Adam on the cross-entropy of windows of the given texts, each language with equal weight."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for text, lang in zip(texts, langs, strict=True):
        parts, sizes = windows_of(text.lower().encode("utf-8", "replace"))
        for part, size in zip(parts, sizes, strict=True):
            if size >= 8:
                x.append(part)
                y.append(names.index(lang))
                if rng.random() < 0.3:  # short texts must be told too
                    short = np.zeros_like(part)
                    n = rng.integers(8, 48)
                    short[:n] = part[:n]
                    x.append(short)
                    y.append(names.index(lang))
    filters = FILTERS * len(WIDTHS)
    mask = _kernel_mask()
    net = ByteConvNet(
        names,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(filters, dtype=np.float32),
        rng.normal(0, 0.2, (filters, len(names))).astype(np.float32),
        np.zeros(len(names), dtype=np.float32),
    )
    net.embed[0] = 0
    if len(names) == 1 or not x:
        return net
    x, y = np.stack(x), np.array(y)
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names)).clip(1))).astype(np.float32)
    params = [net.embed, net.kernel, net.kernel_bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = EPOCHS * max(1, min(8, 6_000 // len(y)))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            unfolded, answers, pooled, p = _forward(net, x[rows])
            grad = p.copy()
            grad[np.arange(len(rows)), y[rows]] -= 1
            grad *= weight[y[rows], None] / len(rows)
            g_dense, g_dense_bias = pooled.T @ grad, grad.sum(0)
            g_pooled = (grad @ net.dense.T) * (pooled > 0)
            best = answers.argmax(axis=1)  # (rows, filters)
            seen = unfolded[np.arange(len(rows))[:, None], best]  # (rows, filters, width * EMBEDDING)
            g_kernel = np.einsum("bf,bfk->kf", g_pooled, seen) * mask
            back = (g_pooled[:, :, None] * net.kernel.T[None]).reshape(len(rows), filters, max(WIDTHS), EMBEDDING)
            g_embed = np.zeros_like(net.embed)
            padded = np.pad(x[rows], ((0, 0), (0, max(WIDTHS) - 1)))
            for k in range(max(WIDTHS)):
                np.add.at(g_embed, padded[np.arange(len(rows))[:, None], best + k], back[:, :, k])
            g_embed[0] = 0
            step += 1
            for i, g in enumerate((g_embed, g_kernel, g_pooled.sum(0), g_dense, g_dense_bias)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: ByteConvNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text; `und` and 0 where there is no letter or no model."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
    parts, sizes, owner = [], [], []
    total = np.zeros((len(rows), len(net.langs))) if net else None
    bytes_of = np.zeros(len(rows))

    def flush() -> None:
        if parts:
            p = _forward(net, np.concatenate(parts))[3]
            w, o = np.concatenate(sizes), np.repeat(np.array([x for x, _ in owner]), [n for _, n in owner])
            np.add.at(total, o, p * w[:, None])
            np.add.at(bytes_of, o, w)
        parts.clear(), sizes.clear(), owner.clear()

    held = 0
    for k, i in enumerate(rows):
        whole, size = windows_of(texts[i].lower().encode("utf-8", "replace"))
        for at in range(0, len(whole), 256):
            parts.append(whole[at : at + 256])
            sizes.append(size[at : at + 256])
            owner.append((k, len(parts[-1])))
            held += len(parts[-1])
            if held >= 256:
                flush()
                held = 0
    flush()
    for k, i in enumerate(rows):
        p = total[k] / bytes_of[k]
        best = int(p.argmax())
        langs[i], scores[i] = net.langs[best], float(min(1.0, p[best]))
    return langs, scores


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ByteConvNet | None:
    """Train on the whole texts of about `sample_rows` rows (never over twice as many) with text and language, picked by a hash of the id.

    None where no row has both.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    sample = hash_sample(rows, "doc_id", sample_rows, 3).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def language(text_col: str, net: ByteConvNet | None):
    """Column struct<lang_pred, score> of the text column's whole texts."""

    @F.pandas_udf("lang_pred string, score double")
    def told(texts):
        import pandas as pd

        langs, scores = predict(net, [None if t is None or t != t else t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return told(F.col(text_col).cast("string"))


def _predictions(net: ByteConvNet | None):
    def run(batches):
        for batch in batches:
            for part in slices(batch, ["text"]):
                langs, scores = predict(net, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score (the mean probability of that language).

    Every window of a whole text counts. Null texts and texts without a letter are `und` with
    score 0, as is everything where there was nothing to learn from. Null and repeated ids pass
    through; other columns are not read. The network is a few thousand numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predictions(net), f"doc_id {kind}, lang_pred string, score double")
