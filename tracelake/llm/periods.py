"""Periodic runs of words, found only where a k-gram repeats inside its document.

A run of length n and smallest period q (n >= least, n >= 2q) matches itself shifted by q over n - q
>= max(least - q, q) words, so at least over k = ceil(least / 2). Each of its words thus lies in a
k-gram that its document holds twice, and words outside such grams cannot join a run. The stretches
that are left, of all documents of a batch at once, go through Main and Lorentz's divide and conquer:
runs over a middle are told by how far two places, one period apart, agree to the left and to the
right. These lengths come from names of 1, 2, 4 ... words (equal names: equal words), a level of the
recursion at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import WORD, slices

LEAST = 12


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each of `lengths`, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def repeated_gram_words(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Flags of the words that lie in a k-gram which stands twice in their document.

    Grams are told by a hash: a collision lets words through, none gets lost.
    """
    n = len(words) - k + 1
    flags = np.zeros(len(words) + 1, dtype=np.int32)
    if n > 0:
        with np.errstate(over="ignore"):
            gram = np.zeros(n, dtype=np.uint64)
            for i in range(k):
                gram = (gram ^ words[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                gram ^= gram >> np.uint64(29)
            gram = (gram ^ doc[:n].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        inside = np.flatnonzero(doc[:n] == doc[k - 1 :])
        order = inside[np.argsort(gram[inside])]
        same = gram[order[1:]] == gram[order[:-1]]
        again = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
        np.add.at(flags, again, 1)
        np.add.at(flags, again + k, -1)
    return np.cumsum(flags[:-1]) > 0


def word_names(symbols: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """names[j, i]: equal for places i whose 2**j symbols are equal; grams over the end of their stretch (`ends`, for each place) equal nothing."""
    place = np.arange(len(symbols))
    names, width = [symbols.astype(np.int32)], 1
    while 2 * width <= longest:
        valid = place[place + 2 * width <= ends]
        name = (-1 - place).astype(np.int32)
        pair = names[-1][valid].astype(np.int64) << 32 | names[-1][valid + width]
        name[valid] = np.unique(pair, return_inverse=True)[1]
        names.append(name)
        width *= 2
    return np.stack(names)


def agree_right(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from places i < j on are equal."""
    found, end = np.zeros(len(i), dtype=np.int64), names.shape[1]
    for level in range(len(names) - 1, -1, -1):
        b = j + found
        same = (b < end) & (names[level, np.minimum(i + found, end - 1)] == names[level, np.minimum(b, end - 1)])
        found += same << level
    return found


def agree_left(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before places i < j are equal, going left."""
    found = np.zeros(len(i), dtype=np.int64)
    for level in range(len(names) - 1, -1, -1):
        a = i - found - (1 << level)
        same = (a >= 0) & (names[level, np.maximum(a, 0)] == names[level, np.maximum(j - found - (1 << level), 0)])
        found += same << level
    return found


def stretch_runs(symbols: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs in stretches of these lengths that lie one after another in `symbols`."""
    if not len(lengths):
        return np.zeros((0, 3), dtype=np.int64)
    # After each stretch stands a symbol that equals no other.
    high = np.cumsum(lengths + 1) - 1
    low = high - lengths
    marked = -1 - np.arange(high[-1] + 1)
    marked[np.repeat(low, lengths) + ragged(lengths)] = symbols
    names, starts = word_names(marked, np.repeat(high, lengths + 1), int(lengths.max())), low
    found = []
    while len(low):
        middle = (low + high) // 2
        right, left = high - middle, middle - low
        # A run over the middle holds a whole period on its right or on its left.
        periods = [ragged(right) + 1, ragged(left) + 1]
        i = np.r_[np.repeat(middle, right), np.repeat(middle, left) - periods[1]]
        period = np.r_[periods[0], periods[1]]
        j = i + period
        # Right and left together agree over a period, so one of them over half of it.
        level = np.minimum(np.frexp((period + 1) // 2)[1] - 1, len(names) - 1)
        back, last = i - (1 << level), names.shape[1] - 1
        likely = (j <= last) & (names[level, i] == names[level, np.minimum(j, last)])
        likely |= (back >= 0) & (names[level, np.maximum(back, 0)] == names[level, np.maximum(back + period, 0)])
        i, j, period = i[likely], j[likely], period[likely]
        before, after = agree_left(names, i, j), agree_right(names, i, j)
        run = (before + after >= period) & (before + after + period >= least)
        found.append(np.stack([(i - before)[run], (j + after)[run], period[run]], axis=1))
        halves = np.r_[low, middle], np.r_[middle, high]
        large = halves[1] - halves[0] >= least
        low, high = halves[0][large], halves[1][large]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs[:, :2] -= (np.searchsorted(starts, runs[:, 0], "right") - 1)[:, None]
    # A stretch that has several periods is a run of the smallest.
    return runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]] if len(runs) else runs


def word_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period), in places of `words`, of the runs of all documents that lie one after another, by start and period."""
    kept = repeated_gram_words(words, doc, (least + 1) // 2)
    edge = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(kept & (edge | ~np.r_[False, kept[:-1]]))
    last = np.flatnonzero(kept & np.r_[edge[1:] | ~kept[1:], True]) if len(doc) else first
    large = last - first + 1 >= least
    first, lengths = first[large], (last - first + 1)[large]
    places = np.repeat(first, lengths) + ragged(lengths)
    runs = stretch_runs(words[places], lengths, least)
    shift = places[runs[:, 0]] - runs[:, 0]
    runs[:, :2] += shift[:, None]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(least: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, ["text"], 1 << 20):
                split = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in part.column("text").cast(pa.binary())]
                number: dict[bytes, int] = {}
                counts = np.array([len(w) for w in split], dtype=np.int64)
                words = np.fromiter((number.setdefault(w, len(number)) for each in split for w in each), dtype=np.int64, count=int(counts.sum()))
                runs = word_runs(words, np.repeat(np.arange(len(split)), counts), least)
                begins = np.cumsum(counts) - counts
                cut = np.searchsorted(runs[:, 0], np.r_[begins, counts.sum()])
                dropped = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
                np.add.at(dropped, runs[:, 1], -1)
                kept = np.cumsum(dropped) == 0
                text = [b" ".join([w for w, k in zip(each, kept[b : b + len(each)].tolist(), strict=True) if k]) for each, b in zip(split, begins.tolist(), strict=True)]
                owner = np.repeat(np.arange(len(split)), np.diff(cut))
                rows = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begins[owner]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(RUN))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs, collapsed.

    Words are runs of characters other than the six ASCII blanks; null and empty texts have none. `runs`
    holds (start, length, period) of each run by start, then period: a stretch of words with smallest
    period q and at least max(least, 2q) words, which no neighbouring word extends. `collapsed` has the
    words, joined by one space, that lie in no run after its first period. Repeated rows and null ids are
    kept as they are; an empty table gives an empty result; other columns are not read. No row leaves its
    task, and a task's memory follows its longest text: 4 bytes a word and level of names, for the words
    that repeat k-grams.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_find(least), f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def made_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of `docs`, where the words of one text in ten are periodic from some word on.

    With h the crc32 of the id as text and g = floor(h / 10): where 10 divides h, each of the n words from
    a = g % n on becomes word a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8)). Other texts,
    and those without a word, stay as they are.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    rows = rows.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", (F.col("g") % F.when(F.col("n") > 0, F.col("n"))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without a run) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("best.shorter")
    return rows.select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
