import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracelake.llm import repeats


def brute(rows, length, keep):
    """Every window of every text, in the order of ids (a null id first)."""
    texts = sorted(((i is not None, i or 0, (t or "").encode()) for i, t in rows))
    windows = lambda t: [t[a : a + length] for a in range(len(t) - length + 1)]
    counts, seen, out = Counter(w for *_, t in texts for w in windows(t)), set(), []
    for has_id, i, text in texts:
        covered = bytearray(len(text))
        for a, w in enumerate(windows(text)):
            if w in seen if keep == "first" else counts[w] > 1:
                covered[a : a + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(text, covered, strict=True) if not c)
        spans = sum(1 for a in range(len(text)) if covered[a] and (a == 0 or not covered[a - 1]))
        out.append((i if has_id else None, len(text), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def shared_passages(spark):
    """Passages in many contexts, shifted copies, edits, periodic texts and repeats inside one text."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdeé漢", k=rnd.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    passages = [prose(40) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [prose(rnd.randint(0, 30)), rnd.choice(passages), prose(rnd.randint(0, 12)), rnd.choice(passages)[rnd.randint(0, 60) :]]
        rows.append((i, "".join(parts)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (202, rows[1][1][1:]), (203, "x" * 900), (204, "ab" * 150), (205, prose(100).replace("a", "\x00")), (206, rows[2][1][:150] + rows[2][1][151:]), (207, passages[0] * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize(("length", "names", "piece"), [(50, 2_048, 1 << 20), (101, 8, 1 << 20), (50, 3, 700)])
def test_as_brute_force(shared_passages, monkeypatch, keep, length, names, piece):
    """Also where blocks are small, so grams go start by start, and where texts are hashed in pieces."""
    monkeypatch.setattr(repeats, "BLOCK_NAMES", names)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = [(r["doc_id"], r["text"]) for r in shared_passages.collect()]
    got = told(repeats.remove_repeats(shared_passages, length=length, keep=keep))
    assert got == brute(rows, length, keep)
    assert sum(g[2] for g in got) > 10_000


@pytest.mark.parametrize("keep", ["first", "none"])
def test_documents_and_awkward_rows(documents, awkward, keep):
    for table in (documents, awkward):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        assert told(repeats.remove_repeats(table, keep=keep)) == brute(rows, 200, keep)


def test_spans_and_remaining_bytes(shared_passages):
    texts = {}
    for r in shared_passages.collect():
        texts.setdefault(r["doc_id"], r["text"].encode())
    for r in repeats.remove_repeats(shared_passages, length=60, with_bytes=True).collect():
        text, at, kept = texts[r["doc_id"]], 0, b""
        for span in r["spans"]:
            assert span["start"] >= at and span["end"] - span["start"] >= 60
            kept, at = kept + text[at : span["start"]], span["end"]
        assert r["kept"] == kept + text[at:] and hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_empty_table(empty):
    assert repeats.remove_repeats(empty).count() == 0


def test_bounds_are_refused(documents):
    for options in ({"keep": "last"}, {"length": 32}):
        with pytest.raises(ValueError, match="keep is first"):
            repeats.remove_repeats(documents, **options)


def test_factor_lengths_as_slow_search():
    rnd = random.Random(2)
    for n in (1, 9, 60, 300):
        text = bytes(rnd.choices(b"ab", k=n))
        data = np.frombuffer(text, dtype=np.uint8)
        levels = repeats.ranks(data, n)
        order = np.array(sorted(range(n), key=lambda i: text[i:]))
        got = dict(zip(order.tolist(), repeats.factor_lengths(data, levels, order, order).tolist(), strict=True))
        for i in range(n):
            common = lambda j: next((k for k in range(n - i) if text[i + k] != text[j + k]), n - i)  # noqa: E731, B023
            assert got[i] == max((common(j) for j in range(i)), default=0)


def test_least_places_as_slow_search():
    values = np.random.default_rng(3).integers(0, 9, 500, dtype=np.uint64) << np.uint64(40)
    for width in (1, 7, 169, 500):
        slow = [min(range(i, i + width), key=lambda j: (values[j], j)) for i in range(500 - width + 1)]
        assert repeats.least_places(values, width).tolist() == slow


def test_nearest_smaller_as_slow_search():
    values = np.random.default_rng(1).integers(0, 30, 200)
    slow = [next((j for j in range(i - 1, -1, -1) if values[j] < values[i]), -1) for i in range(200)]
    assert repeats.nearest_smaller(values).tolist() == slow
