from collections import defaultdict

from test_rules_secrets_urls import WORD

from tracelake.llm import quality_rules
from tracelake.llm.queries import ORACLE_SQL, op3_clean_text


def brute_clean(rows):
    norm = lambda line: " ".join(WORD.findall(line.lower()))
    documents = defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                documents[(host or "", norm(line))].add(text)
    out = []
    for doc_id, text, host in rows:
        lines = (text or "").split("\n")
        stays = [x for x in lines if not WORD.search(x) or len(documents[(host or "", norm(x))]) <= quality_rules.LINE_DOCUMENTS]
        out.append((doc_id, text if text is None else "\n".join(stays), len(lines) - len(stays)))
    return sorted(out, key=str)


def test_frequent_lines_are_gone_as_brute_force(spark, documents, awkward, empty):
    line = "This very line  stands on every page"
    extra = [(20_000 + i, f"{line.upper() if i % 2 else line}\n\nown {i}\n {line}\t\nend {i}\n", "a", "host") for i in range(12)]
    extra += [(30_000 + i, f"rare line\nown {i}", "a", "host") for i in range(quality_rules.LINE_DOCUMENTS)]
    extra += [(40_000, f"{line}\nelsewhere", "a", "other"), (40_001, "\n".join([line] * 3), "a", "host"), (None, extra[0][1], "a", "host"), (None, extra[0][1], "a", "other")]
    made = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string")
    for table in (documents.select("doc_id", "text", "lang", "source").union(made), awkward):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
        got = quality_rules.without_frequent_lines(table).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_clean(rows)
    clean = {r["doc_id"]: r["text"] for r in quality_rules.without_frequent_lines(made).collect()}
    assert clean[20_000] == "\nown 0\nend 0\n" and clean[40_000] == f"{line}\nelsewhere" and clean[40_001] == ""
    assert quality_rules.without_frequent_lines(empty).count() == 0


def test_clean_text_as_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(ORACLE_SQL["op3_clean_text"]).fetchall()
    assert sorted(map(tuple, op3_clean_text(spark, "/root/testdata/sf0.01").collect()), key=str) == sorted(want, key=str)
