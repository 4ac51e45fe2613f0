"""Roles of unit variables, sub-cases of flows, and checks of generated cases."""

from pyspark.sql import functions as F

from tracelake.operators import search, units


def test_roles_and_sides(spark):
    entries = [
        ("f", 1, "global", "U8 u8g_A"), ("f", 2, "global", "[INDIRECT] U8 u8g_B;"), ("f", 3, "static", "u16s_C"), ("f", 4, "global", "REG_D"), ("f", 5, "global", "[INDIRECT] REG_E"), ("f", 6, "global", "tmp_x"), ("f", 7, "global", "i"),
        ("f", 8, "global", "[OUT] plain"), ("f", 9, "static", "plain"), ("f", 10, "global", None), ("f", 11, "static", "[INDIRECT2] kept"), ("v", 1, "global", "uint8_t"),
    ]
    e = spark.createDataFrame(entries, "function string, ordinal int, kind string, entry string")
    got = {r["name"]: (r["reads"], r["writes"], r["indirect"]) for r in units.variable_roles(e).collect()}
    assert got == {"u8g_A": (True, False, False), "u8g_B": (False, False, True), "u16s_C": (False, True, False), "REG_D": (True, True, False), "REG_E": (False, True, True), "plain": (False, True, False), "kept": (False, True, True)}
    params = spark.createDataFrame([("f", 0, "p", "IN"), ("f", 1, "q", "INOUT")], "function string, ordinal int, name string, direction string")
    owners = spark.createDataFrame([("f", "void"), ("v", "U8"), ("w", "void")], "function string, returns string")
    sides = {}
    for r in units.unit_variables(owners, params, e).orderBy("function", "side", "place").collect():
        sides.setdefault((r["function"], r["side"]), []).append(r["name"])
    assert sides == {("f", "input"): ["p", "q", "u8g_A", "REG_D"], ("f", "output"): ["q", "u16s_C", "REG_D", "REG_E", "plain", "kept"], ("f", "indirect"): ["u8g_B"], ("v", "output"): ["return_v"]}
    assert units.unit_variables(owners, params, e, most=1).filter("side = 'input'").count() == 1


def test_few_cases_and_class_labels(spark):
    flows = spark.createDataFrame([("a",), ("b",)], "flow string")
    v = spark.createDataFrame([("a", "input", 0, "x", "bool"), ("a", "expected", 0, "y", "bool"), ("a", "global", 0, "z", "bool")], "flow string, side string, ordinal int, name string, kind string")
    rows = units.integration_cases(flows, v, 3, classes=True).collect()
    assert sorted({(r["flow"], r["case_num"], r["case_label"]) for r in rows})[:2] == [("a", 1, "1 [EC1:무효-하한]"), ("a", 2, "2 [EC2:유효-하한]")]
    assert {r["case_num"]: r["value"] for r in rows if r["flow"] == "a" and r["side"] == "expected"} == {1: "0.0", 2: "0.0", 3: "0.0"}
    assert {(r["name"], r["value"]) for r in rows if r["flow"] == "b" and r["case_num"] == 1} == {("Scenario", "Normal operation"), ("Result", "N/A")}
    assert units.integration_cases(flows, v.limit(0), 1).count() == 4 and units.integration_cases(flows.limit(0), v.limit(0)).count() == 0


def test_checks_of_cases_and_sheets(spark):
    cases = spark.createDataFrame([("s", None, 1, True), ("s", "t", 1, False), ("t", "t", 5, False)], "book string, title string, seqs int, linked boolean")
    got = {tuple(r) for r in units.case_checks(cases, ["book"], {"title": (F.coalesce(F.trim("title"), F.lit("")) == "", 0.3, "issue")}, {"cases": (2, 9), "seqs": (1, 4)}).collect()}
    assert got == {("s", "issue", "title", 1, 2), ("t", "issue", "cases range", 1, 1), ("t", "issue", "seqs range", 5, 1), ("t", "warning", "linked", 0, 1)}
    sheets = spark.createDataFrame([("s", "Cases"), ("s", "Cover"), ("t", "Cover")], "book string, sheet string")
    assert {tuple(r) for r in units.sheet_issues(sheets, ["Cases"], ["Cover", "History"]).collect()} == {("t", "issue", "Cases"), ("s", "warning", "History"), ("t", "warning", "History")}


def test_all_boosts(spark):
    hits = spark.createDataFrame([("a", 1.0, "/p/x", 2, 3), ("b", 1.0, None, None, None), ("c", 1.0, "", 1, 0)], "id string, score double, project_root string, apply_count int, error_count int")
    got = {r["id"]: round(r["score"], 6) for r in search.boosted(hits, project=("build of /p/x now", 0.5), applied=0.1, errors=0.01).collect()}
    assert got == {"a": 1.73, "b": 1.0, "c": 1.1}
