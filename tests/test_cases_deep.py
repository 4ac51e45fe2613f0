"""Test case data of any depth and length."""

from tracelake.sources import cases


def page(rows):
    cells = "".join(f'<tr><td class="i{d}">{n}</td>\n<td>int</td>\n<td>{v}</td></tr>\n' for d, n, v in rows)
    return f"<html>{cases.CASE_MARK}<table><tr><th>Unit Under Test</th><td>unit</td><th>Subprogram name</th><td>run</td></tr><tr><th>Test Case Name</th><td>run.1</td></tr></table>{cases.INPUT}<table>{cells}</table>"


def test_deep_and_long_tables(spark):
    head = [(0, "UUT: unit", ""), (1, "&lt;&lt;GLOBAL&gt;&gt; Globals", "")]
    deep = head + [(2, "g", "")] + [(d, f"n{d}", "") for d in range(3, 40)] + [(40, "x", "7"), (90, "far", "8")]
    long = head + [(2, f"v{i}", str(i)) for i in range(1_000)]
    pages = spark.createDataFrame([(1, page(deep)), (2, page(long)), (3, None), (4, "")], "id int, page string")
    got = {}
    for r in cases.case_items(pages, ["id"], "page").orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["variable"], r["value"]))
    path = ".".join(["g", *(f"n{d}" for d in range(3, 40)), "x"])
    assert got[1] == [(path, "7"), (f"{path}.far", "8")]
    assert got[2] == [(f"v{i}", str(i)) for i in range(1_000)] and set(got) == {1, 2}


def test_bank_of_a_report(spark):
    one, two = page([(0, "UUT: unit", ""), (1, "&lt;&lt;GLOBAL&gt;&gt;Globals", ""), (2, "b", "1"), (2, "a", "2")]), page([(0, "UUT: unit", ""), (1, "&lt;&lt;GLOBAL&gt;&gt;Globals", ""), (2, "c", "1"), (2, "b", "2"), (2, "d", "3")]).replace("run.1", "run.2")
    pages = spark.createDataFrame([(1, "<th>Environment Name</th>\n <td class='x'> env </td>" + one + two.removeprefix("<html>")), (2, one), (3, None)], "id int, page string")
    got = {r["id"]: tuple(r)[1:] for r in cases.case_bank(pages, ["id"], "page").collect()}
    assert got == {1: ("env", "unit", 2, ["b", "a", "c", "d"], [], 3, 0), 2: ("", "unit", 1, ["b", "a"], [], 2, 0)}


def test_tables_are_read_once_for_a_bank(spark, capsys):
    pages = spark.createDataFrame([(1, page([(0, "UUT: unit", "")]))], "id int, page string")
    cases.case_bank(pages, ["id"], "page").explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate posexplode") == 1 and plan.count("MapInArrow") == 1


def test_of_values_of_one_variable_the_last_counts(spark):
    rows = [(0, "UUT: unit", ""), (1, "&lt;&lt;GLOBAL&gt;&gt; Globals", ""), (2, "a", "1"), (2, "b", "2"), (2, "a", "3"), (2, "a", "")]
    got = cases.case_items(spark.createDataFrame([(1, page(rows))], "id int, page string"), ["id"], "page").select("variable", "place", "value").collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, "3"), ("b", 1, "2")]
