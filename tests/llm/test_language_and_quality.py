from pyspark.sql import functions as F

from tracelake.llm import compression_quality, language_id
from tracelake.llm.shared import fold


def test_language_of_held_out_rows(documents):
    net = language_id.fit(documents.filter(fold(F.col("doc_id"), 5) != 0))
    told = language_id.identify(documents, net).join(documents.select("doc_id", "lang"), "doc_id").filter(fold(F.col("doc_id"), 5) == 0).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.95 * len(told)
    assert all(0 <= r["score"] <= 1 for r in told)


def test_language_of_awkward_rows(awkward, empty):
    net = language_id.fit(awkward)
    got = language_id.identify(awkward, net).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5))
    assert language_id.fit(empty) is None
    assert {r["lang_pred"] for r in language_id.identify(awkward, None).collect()} == {"und"}
    assert language_id.identify(empty, net).count() == 0


def slow_language(net, text):
    """Language and probability by loops over windows, filters, places and bytes."""
    import math

    data = text.lower().encode()
    total, held = [0.0] * len(net.langs), 0
    for at in range(0, len(data), language_id.WINDOW):
        window = data[at : at + language_id.WINDOW]
        padded = window + bytes(language_id.WINDOW - len(window) + max(language_id.WIDTHS) - 1)
        pooled = []
        for f in range(net.kernel.shape[1]):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            answers = [sum(float(net.embed[padded[place + k]] @ net.kernel[k * language_id.EMBEDDING : (k + 1) * language_id.EMBEDDING, f]) for k in range(width)) for place in range(language_id.WINDOW)]
            pooled.append(max(0.0, max(answers) + float(net.kernel_bias[f])))
        z = [sum(p * float(net.dense[f, k]) for f, p in enumerate(pooled)) + float(b) for k, b in enumerate(net.dense_bias)]
        e = [math.exp(v - max(z)) for v in z]
        for k, v in enumerate(e):
            total[k] += v / sum(e) * len(window)
        held += len(window)
    best = max(range(len(total)), key=total.__getitem__)
    return net.langs[best], total[best] / held


def test_language_as_slow_network(spark, documents):
    net = language_id.fit(documents, sample_rows=40)
    texts = sorted((r["text"] for r in documents.collect()), key=len)
    texts = [*texts[:3], texts[len(texts) // 2], "a", "1 b 2"]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, text in enumerate(texts):
        if any(map(str.isalpha, text)):
            lang, score = slow_language(net, text)
            assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-4


def test_windows_cover_the_whole_text():
    data = bytes(range(1, 200)) * 11
    windows, sizes = language_id.windows_of(data)
    assert windows.tobytes()[: len(data)] == data and sizes.sum() == len(data)


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = compression_quality.fit(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    rows = compression_quality.score(docs, model).join(labels, "doc_id").filter(fold(F.col("doc_id"), 4) == 2).collect()
    good, bad = [[r["score"] for r in rows if r["quality"] == y] for y in (1, 0)]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.85
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows) >= 0.85 * len(rows)


def test_quality_as_single_blocks(spark):
    """Scores as from every block compressed on its own with the one-shot interface; all labelled text enters the dictionaries."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    model = compression_quality.fit(docs, labels)
    assert any(r["text"] and r["text"].strip()[-40:].encode() in model.good for r in docs.join(labels.filter("quality = 1"), "doc_id").collect())
    for r in compression_quality.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        data, sizes = (r["text"] or "").strip().encode(), []
        for content in (model.good, model.bad):
            packer = zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(packer.compress(data[at : at + 512])) for at in range(0, len(data), 512)))
        want = 1 / (1 + math.exp(-(model.weights[0] + 10 * model.weights[1] * (sizes[1] - sizes[0]) / sum(sizes)))) if data else model.prior
        assert abs(r["score"] - want) < 0.02


def test_conflicting_labels_take_the_largest(spark):
    docs = spark.createDataFrame([(i, f"{'good words here' if i % 2 else 'bad noise there'} {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (3, 0), (4, None)], "doc_id long, quality int")
    agreed = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert compression_quality.fit(docs, labels) == compression_quality.fit(docs, agreed)


def test_quality_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (8, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = compression_quality.fit(awkward, labels)
    got = compression_quality.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    nothing = compression_quality.fit(empty, labels.limit(0))
    assert {r["score"] for r in compression_quality.score(awkward, nothing).collect()} == {0.5}
    assert compression_quality.score(empty, model).count() == 0
