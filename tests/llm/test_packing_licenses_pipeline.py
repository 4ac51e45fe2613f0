import random
from collections import defaultdict

import corpus_pipeline
from tracelake.llm import license_scan, packing, piece_tokens


def check_packing(counted, sizes, **options):
    rows = [(r["doc_id"], max(r["n_tokens"] or 0, 0)) for r in counted.collect()]
    got = packing.pack(counted, sizes=sizes, **options).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[(r["row_no"], r["doc_id"])].append((r["start"], r["n_tokens"]))
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    assert sorted(((k[1], sum(n for _, n in p)) for k, p in pieces.items()), key=str) == sorted(rows, key=str)
    for p in pieces.values():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
    for members in bins.values():
        used = sum(m["n_tokens"] for m in members)
        assert {m["bin_used"] for m in members} == {used}
        assert {m["bin_size"] for m in members} == {min(s for s in sizes if s >= used)}
        at = 0
        for m in sorted(members, key=lambda m: m["bin_offset"]):
            assert m["bin_offset"] == at
            at += m["n_tokens"]
    return bins


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randint(1, 90), rng.randint(1, 600), 128, 5000])) for i in range(3000)] + [(1, None), (2, 0), (3, -4), (None, 77), (5, 77), (5, 77), (6, 10**6)]
    counted = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "'x' as bin_id", "1 as piece")
    bins = check_packing(counted, (32, 64, 128), shard_rows=500)
    used = sum(m["n_tokens"] for b in bins.values() for m in b)
    assert used >= 0.97 * sum(b[0]["bin_size"] for b in bins.values())


def slow_best_fit(lengths, sizes, limit, overhead):
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, waiting = [], sum(lengths)
    for i in order:
        n = lengths[i]
        waiting -= n
        fits = [(room, k) for k, (room, _) in enumerate(bins) if room >= n]
        if fits:
            room, k = min(fits)
            bins[k] = (room - n, bins[k][1] + n)
        else:
            allowed = [s for s in sizes if s >= n and s <= max(limit, min(x for x in sizes if x >= n))]
            size = min(allowed, key=lambda s: ((s + overhead) / min(s, n + waiting), s))
            bins.append((size - n, n))
    return sorted(used for _, used in bins)


def test_shard_is_best_fit_of_every_limit():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        sizes = [16, 32, 64]
        cost = lambda used: sum(min(s for s in sizes if s >= u) + 8 for u in used)
        place, used = packing.pack_shard(lengths, sizes, 8)
        tried = [slow_best_fit(lengths, sizes, limit, 8) for limit in sizes]
        assert cost(used) == min(map(cost, tried)) and sorted(used) in tried
        assert sum(used) == sum(lengths) and len(place) == len(lengths)


def test_sequences_hold_the_tokens(spark):
    docs = spark.createDataFrame([(i, "some words of text number " * (i % 9 + 1)) for i in range(40)], "doc_id long, text string")
    coded = piece_tokens.encode(docs)
    out = packing.sequences(packing.pack(coded, sizes=(16, 32, 64)), coded).collect()
    assert sum(len(r["ids"]) for r in out) == sum(len(r["ids"]) for r in coded.collect())
    assert all(len(r["ids"]) <= r["bin_size"] for r in out)


def test_packed_ids_in_any_shape(spark):
    rows = [(i, list(range(n))) for i, n in enumerate([1, 64, 65, 700, 3, 0])] + [(None, [5]), (2, [9, 9]), (2, [9, 9]), (8, None)]
    coded = spark.createDataFrame(rows, "doc_id long, ids array<int>").selectExpr("*", "'x' as shard", "1 as row_no")
    got = defaultdict(list)
    for r in packing.pack_ids(coded, sizes=(16, 64), shard_rows=4).collect():
        at = 0
        for i, start, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            got[i].append((start, r["ids"][at : at + n]))
            at += n
        assert at == r["bin_used"] == len(r["ids"]) <= r["bin_size"]
    assert sorted(got[2]) == sorted([(0, list(range(64))), (64, [64]), (0, [9, 9]), (0, [9, 9])]) and got[None] == [(0, [5])]
    assert [t for _, ids in sorted(got[3]) for t in ids] == list(range(700)) and 5 not in got and 8 not in got
    assert packing.pack_ids(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_licenses_of_planted_lines(spark, documents, awkward, empty):
    model = license_scan.fit(documents)
    plain = "Thonthsh ouinst from erble at antible haorea."
    rows, want = [], {}
    for i, (family, notice) in enumerate(license_scan.TEMPLATES):
        rows.append((i, f"{plain}\n{notice}\n{plain}"))
        want[i] = family
    for i, line in enumerate(license_scan.LOOKALIKES, 100):
        rows.append((i, f"{plain}\n{line}"))
    rows += [(200, plain), (201, None), (202, ""), (203, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (204, "All rights reserved.")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert {i: by_id[i]["license"] for i in want} == want
    assert all(by_id[i]["license"] in (None, "unknown") for i in range(100, 100 + len(license_scan.LOOKALIKES)))
    assert by_id[200]["license"] is None and by_id[201]["license"] is None and by_id[202]["score"] == 0
    assert by_id[203]["licenses"] == "cc-by-nc-4.0,mit" and by_id[None]["license"] == "mit" and by_id[204]["license"] == "unknown"
    assert license_scan.scan_licenses(awkward, model).count() == awkward.count()
    assert license_scan.scan_licenses(empty, license_scan.fit(empty)).count() == 0


def test_stages_take_awkward_rows(spark, awkward, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (awkward, empty):
        docs = table.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert sorted((i for r in packed for i, start in zip(r["doc_ids"], r["starts"], strict=True) if start == 0), key=str) == sorted((r["doc_id"] for r in docs.collect()), key=str)


def test_pipeline_as_single_steps(spark, documents):
    from test_exact_dedup import brute as exact
    from test_near_dedup import brute as near

    stages = dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    once = stages["exact_dedup"](spark, documents, "")
    kept = {r["doc_id"]: r["text"] for r in once.collect()}
    assert set(kept) == {best for _, best, _ in exact(rows)}
    left = {r["doc_id"] for r in stages["near_dedup"](spark, once, "").collect()}
    assert left == {c for _, c in near(list(kept.items()), 5).values()}
    assert stages["language_id"](spark, documents, "").count() >= 0.98 * len(rows)


def test_pipeline_is_its_stages(spark, documents):
    """The packed ids are those of the library on the redacted texts that the stages keep, each token once."""
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    want = {r["doc_id"]: library.encode(r["text"], add_bos=True, add_eos=True) for r in docs.collect()}
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [f.rsplit("/", 2)[1].split("-")[0] for f in packed.inputFiles()[:1]] == ["secret_scan"]  # earlier stages are not computed again
    got = defaultdict(list)
    for r in packed.collect():
        at = 0
        for i, start, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            got[i].append((start, r["ids"][at : at + n]))
            at += n
        assert at == r["bin_used"] == len(r["ids"]) and r["bin_size"] == min(s for s in packing.SIZES if s >= at)
    assert {i: [t for _, ids in sorted(parts) for t in ids] for i, parts in got.items()} == want
