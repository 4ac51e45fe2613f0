from collections import defaultdict

import pytest

from tracelake.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for members in groups.values():
        best = max((m for m in members if m is not None), default=None)
        out += [(m, best, len(members)) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_as_brute_force(documents, awkward, bits):
    """Three-bit identifiers stand for many contents; the result is the same."""
    for table in (documents, awkward):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = exact_dedup.exact_groups(table, id_bits=bits).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute(rows)
        assert sum(r["kept"] for r in got) == len({(t or "").translate(LOWER) for _, t in rows})


def test_deduplicated_keeps_one_row_each_with_all_columns(awkward):
    kept = exact_dedup.deduplicated(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    texts = [(r["text"] or "").translate(LOWER) for r in rows]
    assert len(texts) == len(set(texts))
    assert {r["doc_id"] for r in rows} == {None, 2, 4, 5, 6, 7, 8}


def test_chunks_are_cut_by_content():
    import numpy as np

    data = np.random.default_rng(0).integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    cut = lambda d: set(exact_dedup.chunked(d.decode(), 11, 512, 16_384)[1])
    whole, moved = cut(data), cut(b"some words before " + data)
    assert len(whole) > 10 and len(whole & moved) > 0.8 * len(whole)
    for text in ("", "x", "ab" * 40_000):
        raw, chunks = exact_dedup.chunked(text, 11, 512, 16_384)
        assert b"".join(chunks) == raw


def test_empty_table(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.deduplicated(empty).count() == 0
