from tracelake.llm import secret_scan

LIVE, COPIED = "Zx9kQ2mN7vB4tR8wL1pY", "Qw3eRt5yUi7oPa9sDf1g"


def scanned(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan_secrets(docs, **options)).collect()}


def test_one_owner_may_repeat_its_secret(spark):
    rows = [(i, f"key {LIVE} in {i}", "a") for i in range(30)] + [(100 + i, f"key {COPIED} in {i}", "ab"[i]) for i in range(2)]
    got = scanned(spark, rows)
    assert all(got[i]["spans"] == "owned:4:24" and got[i]["n_live"] == 1 for i in range(30))
    assert all(got[100 + i]["spans"] == "" and got[100 + i]["n_shared"] == 1 for i in range(2))


def test_copies_of_a_document_count_once(spark):
    rows = [(i, f"key {LIVE} here", "a") for i in range(30)]
    assert all(r["n_live"] == 1 for r in scanned(spark, rows, max_repositories=1).values())
    rows.append((30, f"key {LIVE} there", "a"))
    assert all(r["n_shared"] == 1 for r in scanned(spark, rows, max_repositories=1).values())


def test_a_stray_copy_does_not_share_a_secret(spark):
    """Nineteen repositories of one owner and one of another: still the first one's; five of each are shared."""
    rows = [(i, f"key {LIVE} in {i}", "a") for i in range(19)] + [(50, f"found {LIVE} there", "b")] + [(100 + i, f"key {COPIED} in {i}", "ab"[i % 2]) for i in range(10)]
    got = scanned(spark, rows)
    assert all(got[i]["n_live"] == 1 and (got[i]["most_owners"], got[i]["most_repositories"]) == (2, 20) for i in [*range(19), 50])
    assert all(got[100 + i]["n_shared"] == 1 and (got[100 + i]["most_owners"], got[100 + i]["most_repositories"]) == (2, 10) for i in range(10))
    copies = [(i, f"key {LIVE} here", "a") for i in range(30)] + [(40, f"key {LIVE} here", "b")]
    assert all((r["most_repositories"], r["n_shared"]) == (2, 1) for r in scanned(spark, copies).values())  # copies of an owner's text are one repository


def test_short_base_values_enter_the_count(spark):
    got = scanned(spark, [(1, "password = hunter22", "a"), (2, "x password: hunter22", "b"), (3, "token=only4me", "a"), (4, f"secret={LIVE}", "a")])
    assert [(got[i]["n_live"], got[i]["n_shared"]) for i in (1, 2, 3, 4)] == [(0, 1), (0, 1), (1, 0), (1, 0)]
    assert all(got[i]["n_assign"] == 1 for i in got)


def slow_owned(rows):
    """(spans, n_live, n_shared, most owners, most repositories) of each row: candidates found place by place, owners' texts counted in a dictionary."""
    import math
    import re

    held, owners = [], {}
    for _, text, owner in rows:
        text, base, places = text or "", [], set()
        for pattern, group, least in ((secret_scan.ASSIGN, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)):
            for m in pattern.finditer(text):
                if len(m[group]) >= least:
                    base.append((m.start(), m.end()))
                    places.add((m.start(group), m.end()))
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text):
            shares = [m[0].count(c) / len(m[0]) for c in set(m[0])]
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and -sum(p * math.log2(p) for p in shares) >= secret_scan.MIN_ENTROPY:
                places.add((m.start(), m.end()))
        for a, b in places:
            owners.setdefault(text[a:b], {}).setdefault(owner or "", set()).add(text)
        held.append((text, base, places))
    out = []
    sizes = {secret: [len(t) for t in texts.values()] for secret, texts in owners.items()}
    for text, base, places in held:
        live = {(a, b) for a, b in places if len(sizes[text[a:b]]) <= secret_scan.MAX_OWNERS or max(sizes[text[a:b]]) >= secret_scan.LEAST_LEAD * sum(sizes[text[a:b]])}
        extra = sorted((a, b) for a, b in live if not any(x < b and y > a for x, y in base))
        out.append((extra, len(live), len(places) - len(live), max((len(sizes[text[a:b]]) for a, b in places), default=0), max((sum(sizes[text[a:b]]) for a, b in places), default=0)))
    return out


def test_ownership_as_a_slow_count(spark, documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    rows += [(30_000 + i, f"{LIVE[5:]}{COPIED[:9]} no {i}", "a" if i else "b") for i in range(25)]
    rows += [(10_000 + i, f"key {LIVE} and {COPIED} with password = hunter{i % 2}22 {LIVE[::-1]}x", "ab"[i % 2]) for i in range(6)] + [(20_000, f"{COPIED}", None), (20_001, f"{COPIED[::-1]}9", ""), (20_002, f"{COPIED[::-1]}9", None)]
    got = scanned(spark, rows)
    for (i, *_), (extra, live, shared, most_owners, most_repositories) in zip(rows, slow_owned(rows), strict=True):
        owned = [tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(",") if s.startswith("owned")]
        assert (owned, got[i]["n_live"], got[i]["n_shared"], got[i]["most_owners"], got[i]["most_repositories"]) == (extra, live, shared, most_owners, most_repositories), i


def test_columns_that_clash_and_empty_tables(awkward, empty):
    """The fixture has columns named spans, score, kept and row_no."""
    assert secret_scan.digest(secret_scan.scan_secrets(awkward)).count() == awkward.count()
    assert secret_scan.scan_secrets(empty).count() == 0
    clean = secret_scan.without_secrets(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    assert sorted((r["doc_id"] is None, r["spans"], r["row_no"]) for r in clean.collect()) == sorted((r["doc_id"] is None, r["spans"], r["row_no"]) for r in awkward.collect())
