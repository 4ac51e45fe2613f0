import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tracelake.llm import queries, spelling


def counted(rows, every=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(uses):
    form, out = {}, {}
    for w, n in uses.items():
        found = sorted((-m, v) for v, m in uses.items() if near(w, v))
        form[w] = found[0][1] if found and -found[0][0] >= 2 * n else None
        out[w] = len(found)
    rows = []
    for w, n in uses.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], uses[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def told(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=str)


def test_close_words_as_brute_force(spark):
    """Few letters, so groups are full, runs of equal letters common and chains long."""
    rnd = random.Random(3)
    words = {"".join(rnd.choices("abcé漢", weights=[5, 3, 1, 1, 1], k=rnd.randint(4, 8))): rnd.choice([1, 2, 3, 3, 4, 7, 15, 31, 64, 200, 200]) for _ in range(600)}
    words |= {"aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 20, "aaaaaaaa": 50, "aaaaaaaaa": 101}
    uses = spark.createDataFrame(list(words.items()), "word string, n long")
    assert told(spelling.variants(uses)) == brute({w: n for w, n in words.items() if len(w) >= 5 and n >= 3})


def test_documents_as_brute_force(documents, awkward):
    for table in (documents.limit(60), awkward):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        assert told(spelling.variants(spelling.word_uses(table, every=97))) == brute(counted(rows))


def test_query_as_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(spelling.ORACLE_SQL)
    columns = [d[0] for d in want.description]
    rows = [dict(zip(columns, r, strict=True)) for r in want.fetchall()]
    got = queries.op11_spelling(spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert told(got) == sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows), key=str)


@pytest.mark.parametrize("every", [None, 1, 2])
def test_misspelt_runs(awkward, every):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    got = {r["word"]: r["n"] for r in spelling.word_uses(awkward, every=every).collect()}
    assert {w: n for w, n in got.items() if len(w) >= 5 and n >= 3} == counted(rows, every)


def test_empty_table(empty):
    assert spelling.variants(spelling.word_uses(empty)).count() == 0


def test_chains_of_any_length(spark):
    steps = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("lone", "w40")], "word string, root string")
    assert {r["root"] for r in spelling.chain_ends(steps).collect()} == {"w40"}
