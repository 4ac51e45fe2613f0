import hashlib
import random

import numpy as np
import pytest

from tracelake.llm import piece_tokens


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_tokens.default_model())


@pytest.fixture(scope="module")
def pieces():
    return piece_tokens.model(piece_tokens.default_model())


def random_texts(n):
    rng = random.Random(3)
    letters = "aaeinrst    \t\n.,▁éü漢字😀0011122\x00_-=Zz"
    plain = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    wide = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1000), rng.randint(0x3000, 0x9FFF)])) for _ in range(rng.randint(1, 50))) for _ in range(n // 2)]
    runs = ["".join(rng.choice("ab= -_<>") * rng.randint(1, 20) for _ in range(rng.randint(1, 12))) for _ in range(n // 2)]
    return plain + wide + runs + ["b" + " " * k + "漢" for k in range(1, 50)]


def test_same_ids_as_library(pieces, library):
    texts = random_texts(1500)
    assert [x.tolist() for x in pieces.encode_texts(texts)] == library.encode(texts, add_bos=True, add_eos=True)


def test_same_ids_with_and_without_kept_words(pieces):
    texts = random_texts(50)
    first = [x.tolist() for x in pieces.encode_texts(texts)]
    pieces._forget()
    assert [x.tolist() for x in pieces.encode_texts(list(reversed(texts)))] == first[::-1]


def test_decodes_any_ids_as_library(pieces, library):
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258), rng.randint(0, 300)]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(np.array(ids, dtype=np.int64)) == library.decode(ids), ids


def test_round_trip_and_digests(spark, awkward, library):
    rows = awkward.select("doc_id", "text").collect()
    got = piece_tokens.encode(awkward, digests=True).collect()
    assert len(got) == len(rows)
    key = lambda n, a, b: (n, a, b)
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append(key(len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(key(g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in got) == sorted(want)
    back = piece_tokens.decode(piece_tokens.encode(awkward)).collect()
    assert sorted(r["text"] for r in back) == sorted((r["text"] or "").replace("▁", " ") for r in rows)


def test_empty_table(empty):
    assert piece_tokens.encode(empty).count() == 0
