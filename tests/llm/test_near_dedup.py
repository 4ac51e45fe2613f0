import random

from tracelake.llm import near_dedup


def shingles(text, n):
    w = (text or "").encode().lower().split()
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, rows, n):
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, n)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_documents_as_brute_force(spark, documents):
    check(spark, [(r["doc_id"], r["text"]) for r in documents.collect()], 2)


def test_crowd_with_links_off_the_hub(spark):
    """Copies of one text with more and more edits: many pairs lie just under the limit, and chains matter."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        edited = list(words)
        for _ in range(rng.randint(0, 14)):
            edited[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i + 1, " ".join(edited)))
    chain = list(words)
    for i in range(12):  # each step stays near the one before only
        chain[(i * 9) % 120 : (i * 9) % 120 + 5] = [f"c{i}_{k}" for k in range(5)]
        rows.append((1000 + i, "start " + " ".join(chain)))
    check(spark, rows, 2)


def test_many_repeats_of_two_near_texts(spark):
    words = [f"w{i}" for i in range(100)]
    other = [*words[:99], "x"]
    rows = [(1, " ".join(words))] * 1000 + [(2, " ".join(other))] * 1000 + [(3, "something else altogether")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=5).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, True, 1000), (2, 1, False, 1000), (3, 3, True, 1)]


def test_crowd_that_shares_a_passage(spark):
    """5,000 texts in one bucket, most linked with nothing: every near pair among them is found."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows, want = [], {}
    for i in range(2_500):
        own = [f"o{i}_{k}" for k in range(24)]
        rows.append((2 * i, " ".join(passage + own)))
        want[2 * i] = 2 * i
        if rng.random() < 0.5:
            own = own[:-1] + ["z"]
            want[2 * i + 1] = 2 * i
        else:
            own = [f"q{i}_{k}" for k in range(24)]
            want[2 * i + 1] = 2 * i + 1
        rows.append((2 * i + 1, " ".join(passage + own)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), words=5).collect()
    wrong = [r for r in got if r["component_id"] != want[r["doc_id"]]]
    assert not wrong


def test_awkward_rows(awkward):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(awkward, words=2).collect()]
    assert (2, 11, 1, False) in got and (1, 11, 1, True) in got
    assert (3, 0, 3, True) in got and (4, 0, 4, True) in got and (5, 0, 5, True) in got
    assert got.count((6, 1, 6, True)) == 2 and (7, 1, 7, True) in got
    assert [g for g in got if g[0] is None][0][2:] == (None, True)


def test_stage_keeps_columns(awkward, empty):
    kept = near_dedup.without_near_copies(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 3, 4, 5, 6, 7, 8}
    assert near_dedup.near_groups(empty).count() == 0


def test_estimate_is_near_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    other = np.unique(np.r_[base[:1800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    bits = near_dedup.packed_bits(near_dedup.minima([base, other]))
    true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
    assert abs(near_dedup.estimates(bits[:1], bits[1:])[0, 0] - true) < 0.15
