import hashlib
import random
import zlib

import numpy as np
import pytest

from tracelake.llm import periods


def slow_runs(words, least=12):
    """Each maximal stretch of each period, by its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            e = a
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > a and e + q - a >= max(least, 2 * q):
                found.setdefault((a, e + q), q)
            a = max(e, a + 1) if e > a else a + 1
    return sorted(((a, e - a, q) for (a, e), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize(("letters", "n"), [(1, 40), (2, 60), (2, 200), (3, 150), (4, 80), (2, 1_000)])
def test_runs_as_slow_search(letters, n):
    rnd = random.Random(letters * n)
    docs = [[rnd.randrange(letters) for _ in range(rnd.randint(0, n))] for _ in range(8)]
    for _ in range(8):  # powers of short words, cut and joined
        docs.append([w for _ in range(4) for w in [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 5)])
    fib = [[0], [0, 1]]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    docs += [fib[-1], [0] * 500, []]
    for least in (12, 5, 2):
        got = periods.word_runs(np.array([w for d in docs for w in d], dtype=np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), least)
        want, at = [], 0
        for d in docs:
            want += [(a + at, a + at + length, q) for a, length, q in slow_runs(d, least)]
            at += len(d)
        assert [tuple(r) for r in got.tolist()] == want


def test_only_words_in_repeated_grams_are_searched():
    words = np.array([1, 2, 3, 9, 1, 2, 3, 8, 7, 1, 2, 3])
    doc = np.array([0] * 9 + [1] * 3)
    assert periods.repeated_gram_words(words, doc, 3).tolist() == [True] * 3 + [False] + [True] * 3 + [False] * 5
    assert not periods.repeated_gram_words(words[:2], doc[:2], 3).any()


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = planted(doc_id, (text or "").encode().split())
        runs = slow_runs(words)
        gone = {i for a, length, q in runs for i in range(a + q, a + length)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_digests_as_slow_search(documents, awkward):
    for table in (documents.filter("length(text) < 20000"), awkward.filter("length(text) < 20000 or text is null")):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        got = periods.run_digests(periods.periodic_runs(periods.made_periodic(table))).collect()
        assert sorted(map(tuple, got), key=str) == expected(rows)


def test_awkward_rows_and_long_texts(awkward, empty):
    found = {(r["doc_id"], r["n_words"]): r for r in periods.periodic_runs(awkward).collect()}
    assert [tuple(x) for x in found[7, 40_000]["runs"]] == [(0, 40_000, 1)] and found[7, 40_000]["collapsed"] == "long"
    assert found[3, 0]["runs"] == found[4, 0]["runs"] == [] and found[5, 0]["collapsed"] == ""
    assert periods.periodic_runs(awkward).count() == awkward.count()
    assert periods.run_digests(periods.periodic_runs(periods.made_periodic(empty))).count() == 0


def test_a_long_text_of_nested_periods(spark):
    block = " ".join(f"w{i}" for i in range(300))
    text = " ".join([(block + " x y z") if i % 7 else block for i in range(700)])
    row = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = text.split()
    for run in row["runs"]:
        a, e, q = run["start"], run["start"] + run["length"], run["period"]
        assert words[a : e - q] == words[a + q : e] and run["length"] >= 2 * q
        assert a == 0 or words[a - 1] != words[a - 1 + q]
        assert e == len(words) or words[e] != words[e - q]
    assert any(r["period"] == 300 + 6 * 303 for r in row["runs"])
