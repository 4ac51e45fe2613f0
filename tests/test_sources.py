import zipfile

from pyspark.sql import functions as F

from tracelake.operators import change, filters, generate, graph, quality, relate, search
from tracelake.sources import code, files, findings, html, logs, office, sinks

C = """
/* @asil B
 * @req SwTR_12 */
#include "x.h"
#define LIMIT 10
#define CALL(x) helper(x)
static int counter = 0;
uint8_t g_state;
static void helper(int a) { counter += a; }
int process(const int *p, struct cfg c, uint8_t *out, int)
{
    /* unused(); */
    if (p[0] > LIMIT) { helper(1); g_state = counter; }
    for (int i = 0; i < 3; i++) { other("text(1)"); }
    return g_state;
}
"""


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_c_source_facts(spark):
    src = spark.createDataFrame([("a.c", C), ("b.c", None)], "path string, text string")
    found = code.functions(src)
    assert rows(found, "name", "returns", "is_static") == [("helper", "void", True), ("process", "int", False)]
    assert rows(code.call_edges(found), "src", "dst") == [("process", "helper"), ("process", "other")]
    assert rows(code.parameters(found), "function", "name", "direction") == [("helper", "a", "IN"), ("process", "__arg4", "IN"), ("process", "c", "INOUT"), ("process", "out", "INOUT"), ("process", "p", "IN")]
    assert ("counter", "int", True) in rows(code.global_variables(src), "name", "type", "is_static")
    assert rows(code.macros(src), "name", "value") == [("CALL(x)", "helper(x)"), ("LIMIT", "10")]
    names = spark.createDataFrame([("counter",), ("g_state",)], "name string")
    assert rows(code.variable_usage(found, names), "function", "name", "reads", "writes") == [("helper", "counter", 1, 1), ("process", "counter", 1, 0), ("process", "g_state", 1, 1)]
    assert [r[1] for r in rows(code.flow_nodes(found).filter("function = 'process'"), "ordinal", "type")] == ["if", "loop", "return"]
    assert rows(code.comment_facts(src), "tag", "value") == [("asil", "B"), ("req", "SwTR_12")]
    assert rows(code.first_definitions(found), "name", "definitions") == [("helper", 1), ("process", 1)]
    assert rows(generate.conditions(code.flow_nodes(found).filter("type = 'if'").withColumnRenamed("function", "unit")), "op", "threshold") == [(">", "LIMIT")]


METRICS = """<html><head><title> Metrics Report </title></head><body><h1>Unit &amp; Coverage</h1>
<table><tr><th>Unit</th><th>Subprogram</th><th>Complexity</th><th>Statements</th><th>Branches</th></tr>
<tr><td>a.c</td><td>f</td><td>3</td><td>30 / 45 (67%)</td><td>8 / 14 (57%)</td></tr>
<tr><td></td><td>g</td><td>2</td><td>5 / 5 (100%)</td><td></td></tr>
<tr><td></td><td>TOTALS</td><td>5</td><td>35 / 50 (70%)</td><td></td></tr>
<tr><td>GRAND TOTALS</td><td></td><td>5</td><td>35 / 50 (70%)</td><td></td></tr></table>
<a href="x.html">x</a></body></html>"""
HIS = "<h3>a.c</h3><h4>f</h4><table><tr><th>STCYC</th><th>STCAL</th></tr><tr><td>15</td><td>12</td></tr></table><h4>g</h4><table><tr><th>STCYC</th></tr><tr><td>2</td></tr></table>"


def test_html_reports(spark):
    pages = spark.createDataFrame([(1, METRICS), (2, None), (3, "<table>")], "id int, html string")
    got = html.coverage_rows(html.table_rows(pages, ["id"], "html", ["UNIT", "SUBPROGRAM"]), ["id"]).orderBy("row").collect()
    assert [(r["unit"], r["subprogram"], r["kind"], r["ccn"]) for r in got] == [("a.c", "f", "detail", 3), ("a.c", "g", "detail", 2), ("a.c", "TOTALS", "total", 5), ("GRAND TOTALS", "", "grand_total", 5)]
    assert tuple(got[0]["statements"]) == (30, 45, 0.67) and tuple(got[1]["branches"]) == (0, 0, 0.0)
    one = pages.filter("id = 1").select(html.title("html").alias("t"), html.headings("html").alias("h"), html.links("html").alias("l")).first()
    assert tuple(one) == ("Metrics Report", ["Unit & Coverage"], ["x.html"])
    assert ("a.c", "f") in rows(html.key_values(pages, ["id"], "html"), "key", "value")
    his = spark.createDataFrame([(1, HIS)], "id int, html string")
    assert rows(html.metric_rows(his, ["id"], "html"), "file", "function", "metric", "value") == [("a.c", "f", "STCAL", "12"), ("a.c", "f", "STCYC", "15"), ("a.c", "g", "STCYC", "2")]


LOG = """[Pipeline] { (Build)
compile ok
fatal error: x
[Pipeline] // stage
[Pipeline] { (Test)
12:00:01.5 tests passed with retry
[Pipeline] // stage
plain"""


def test_logs(spark, tmp_path):
    (tmp_path / "console.log").write_text(LOG)
    lines = logs.read_lines(spark, str(tmp_path))
    classified = logs.classify(lines, ["path"])
    assert [r["level"] for r in classified.orderBy("line_no").collect()] == ["STAGE", "KEY", "ERROR", "STAGE", "STAGE", "WARNING", "STAGE", "INFO"]
    assert rows(logs.stages(classified, ["path"]), "stage", "errors", "warnings", "status") == [("Build", 1, 0, "failure"), ("Test", 0, 1, "success")]
    stamp = lines.filter("line_no = 6").select(logs.stamped("text").alias("s")).first()["s"]
    assert tuple(stamp) == ("12:00:01.5", "tests passed with retry")
    assert logs.first_of_level(classified, ["path"], {"STAGE": 2, "ERROR": 5}).count() == 3


def test_files(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "cov.xml").write_text('<coverage line-rate="0.85" branch-rate="72"><x/></coverage>')
    (d / "m.csv").write_text("tool output\nnloc;ccn;function;file\n10;3;f;a.c\nbad\n5;1;g;a.c\n")
    (d / "r.json").write_text('{"a": 1, "b": {"c": 2}}')
    (d / "bad.json").write_text("{no")
    assert rows(files.coverage_xml(spark, str(d / "cov.xml")), "line_rate", "branch_rate") == [(0.85, 0.72)]
    assert rows(files.complexity_csv(spark, str(d / "m.csv")), "file", "function", "ccn", "nloc") == [("a.c", "f", 3, 10), ("a.c", "g", 1, 5)]
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.json_documents(spark, str(d / "*.json")).collect()}
    assert got["r.json"]["keys"] == ["a", "b"] and got["bad.json"]["n_keys"] == 0
    cut = {r["path"].rsplit("/", 1)[1]: r for r in files.text_limited(spark, str(d), 20).collect()}
    assert cut["m.csv"]["truncated"] and cut["m.csv"]["text"] == "tool output\nnloc;ccn"
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.tail(spark, str(d), 100, 2).collect()}["m.csv"] == "5;1;g;a.c\n"
    assert files.listing(spark, str(d), root=str(d), include=["m.csv"]).count() == 1
    old = files.snapshot(spark, str(d), ["*.csv"], [])
    assert rows(change.snapshot_diff(old.withColumn("md5", F.lit("x")), old), "state") == [("changed",)]
    assert [tuple(e) for e in spark.sql("""select '{"R1": ["a", "b"]}' t""").select(files.trace_mappings(F.col("t")).alias("m")).first()["m"]] == [("R1", ["a", "b"])]


def test_office(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>4</v></c></row><row r="2"><c r="B2"><f>A1</f></c></row></sheetData></worksheet>')
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    assert rows(office.xlsx_cells(spark, str(tmp_path)), "sheet", "row", "col", "value") == [("S1", 1, 1, "hello"), ("S1", 1, 28, "4"), ("S1", 2, 2, "(formula)")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert rows(office.docx_paragraphs(spark, str(tmp_path)), "kind", "style", "text") == [("paragraph", "Heading1", "Top"), ("row", "", "k\tv")]


def test_findings(spark, tmp_path):
    lines = spark.createDataFrame([("a/b.c:10:5: warning: bad thing [check-x]",), ("noise",), ("3\t-\tsrc/a.c",)], "text string")
    assert rows(findings.clang_tidy(lines), *findings.COLUMNS) == [("clang-tidy", "a/b.c", 10, "warning", "check-x", "bad thing")]
    assert rows(findings.numstat(lines), "path", "added", "deleted", "total") == [("src/a.c", 3, 0, 3)]
    body = spark.createDataFrame([('{"results": [{"check_id": "r", "path": "p", "start": {"line": 2}, "extra": {"severity": "ERROR", "message": "m"}}]}',)], "j string")
    assert rows(findings.semgrep(body, "j"), *findings.COLUMNS) == [("semgrep", "p", 2, "error", "r", "m")]
    (tmp_path / "c.xml").write_text('<results><errors><error id="nullPointer" severity="error" msg="bad"><location file="x.c" line="7"/></error></errors></results>')
    assert rows(findings.cppcheck(spark, str(tmp_path / "c.xml")), *findings.COLUMNS) == [("cppcheck", "x.c", 7, "error", "nullPointer", "bad")]


DIFF = """diff --git a/src/m.c b/src/m.c
--- a/src/m.c
+++ b/src/m.c
@@ -1,3 +1,3 @@ void stay(int a)
-int changed(int a)
+int changed(int a, int b)
+void fresh(void)
diff --git a/src/n.c b/src/n.c
--- a/src/n.c
+++ b/src/n.c
@@ -5 +5 @@ int body(void)
-  x = f(1)
+  x = f(2)
"""


def test_diff_classification(spark):
    diffs = findings.unified_diffs(spark.createDataFrame([(DIFF,)], "d string"), "d")
    assert rows(diffs, "file") == [("src/m.c",), ("src/n.c",)]
    assert rows(change.classify_diffs(diffs), "function", "kind") == [("body", "BODY"), ("changed", "SIGNATURE"), ("fresh", "NEW"), ("stay", "BODY")]
    files_ = spark.createDataFrame([("src/x.h",), ("y.c",)], "file string")
    assert rows(change.fallback_kinds(files_), "function", "kind") == [("x", "HEADER"), ("y", "BODY")]


def test_gates_and_scores(spark):
    s = spark.createDataFrame([(1, 0.99, 0.75, 80.0, 1.0)], "k int, pass_rate double, coverage_line double, coverage_branch double, new_failures double")
    gates = quality.quality_gates(s, ["k"])
    assert [(r["gate"], r["status"]) for r in gates.collect()] == [("pass_rate", "pass"), ("coverage_line", "warn"), ("coverage_branch", "warn"), ("new_failures", "fail")]
    assert quality.overall_gate(gates, ["k"]).first()["overall_pass"] is False
    m = spark.createDataFrame([("a_pct", 80.0, None), ("b_pct", 60.0, None), ("c", 5.0, None)], "metric_name string, value double, threshold double")
    assert quality.overall_score(m, []).first()[0] == 70.0
    flows = spark.createDataFrame([(i, ["common", f"r{i}"]) for i in range(10)] + [(99, ["common"])], "k int, ids array<string>")
    got = dict(rows(quality.balanced_ids(flows, "k", "ids").select("k", F.array_join("ids", ",").alias("ids")), "k", "ids"))
    assert got[3] == "r3" and got[99] == "common"


def test_search_details(spark):
    e = spark.createDataFrame([("a", "x x x x x x x x x x"), ("b", "x y"), ("c", "z")], "id string, t string")
    got = search.keyword_search(e, "id", ["t"], "x1 xx", 5)
    assert got.count() == 0
    got = {r["id"]: r["score"] for r in search.keyword_search(e.withColumn("t", F.regexp_replace("t", "x", "xx")), "id", ["t"], "xx yy", 5).collect()}
    assert abs(got["a"] - 5 / 6 * 0.75) < 1e-9 and abs(got["b"] - 1 / 1.5 * 0.75) < 1e-9
    docs = spark.createDataFrame([(1, "intro REQ-1 first text SRS_2 second"), (2, " "), (3, "only REQ-1 here")], "id int, t string")
    assert rows(search.requirement_chunks(docs, "id", "t"), "id", "chunk", "text") == [(1, 0, "REQ-1 first text"), (1, 1, "SRS_2 second"), (3, 0, "only REQ-1 here")]


def test_graph_details(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("c", "d", 1)], "src string, dst string, ordinal int")
    tree = graph.call_tree(e, spark.createDataFrame([("a",)], "node string"), 3)
    assert rows(tree, "depth", "path", "cycle") == [(0, "a", False), (1, "a>b", False), (2, "a>b>c", False), (3, "a>b>c>a", True), (3, "a>b>c>d", False)]
    assert rows(graph.missing_entries(e, spark.createDataFrame([("a",), ("q",)], "node string")), "node") == [("q",)]
    assert rows(graph.internal_external(e, spark.createDataFrame([("a",), ("b",)], "name string")), "dst", "kind") == [("a", "internal"), ("b", "internal"), ("c", "external"), ("d", "external")]


def test_relations_filters_and_sinks(spark, tmp_path):
    calls = spark.createDataFrame([("f", "g"), ("f", "h")], "src string, dst string")
    known = spark.createDataFrame([("g",), ("h",)], "name string")
    assert rows(relate.call_agreement(calls, calls.limit(1), known), "src", "n_both", "same") == [("f", 1, False)]
    paths = spark.createDataFrame([("src/a.c",), ("srcx/b.c",), ("src/gen/c.c",), ("build/x.o",)], "p string")
    assert rows(paths.filter(filters.path_filter("p", ["src"], ["src/gen"])), "p") == [("src/a.c",)]
    assert rows(paths.filter(filters.any_glob("p", ["*.o", "src/?.c"])), "p") == [("build/x.o",), ("src/a.c",)]
    assert rows(paths.filter(~filters.relevant("p")), "p") == [("build/x.o",)]
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "N"), (3, "c")], "k int, v string")
    assert sorted(r["v"] for r in sinks.upserted(old, new, ["k"]).collect()) == ["B", "N", "a", "c"]
    assert spark.read.parquet(sinks.write_version(old, str(tmp_path / "t"), 0)).count() == 3


def test_reports(spark):
    from tracelake.sources import reports

    status = "<table><tr><th>Name</th><th>Testcases</th><th>Statements</th><th>Execute Time</th></tr><tr><td>x</td><td>1 / 2 (50%)</td><td></td><td>0:01</td></tr><tr><td>ALL</td><td>69 / 79 (75%)</td><td>5/10</td><td>1:02:03</td></tr></table>"
    pages = spark.createDataFrame([(1, status)], "id int, html string")
    row = reports.full_report(pages, ["id"], "html").first()
    assert tuple(row["testcases"]) == (69, 79, 0.75) and tuple(row["statements"]) == (5, 10, 0.5) and row["execute_seconds"] == 3723
    text = "Code Coverage for a.c\n 5 of 10 Lines Covered 1 of 4 Branches Covered Code Coverage for b.c<br> 9 of 10 Lines Covered"
    modules = reports.module_coverage(spark.createDataFrame([(1, text)], "id int, html string"), ["id"], "html")
    assert tuple(reports.coverage_totals(modules, ["id"]).first()) == (1, 70.0, 25.0)
    assert [r["module"] for r in reports.worst_modules(modules, ["id"], 1).collect()] == ["a.c"]
    cells = spark.createDataFrame([(1, '<td class="a col_metric">50 %</td><td class="col_metric"><b>75.5%</b></td><td>9%</td>')], "id int, html string")
    assert tuple(reports.metric_percentages(cells, ["id"], "html").first()) == (1, 62.75, 2)
    wide = spark.createDataFrame([(1, "<table><tr><th>Files</th><th>R1</th><th>R2</th></tr><tr><td>a</td><td>1</td><td>2</td></tr><tr><td>b</td><td>5</td><td>x</td></tr></table>")], "id int, html string")
    assert rows(reports.column_totals(html.table_rows(wide, ["id"], "html"), ["id"], "Files", 1), "rule", "count") == [("R1", 6.0)]
    paths = spark.createDataFrame([("/ci/job1/source/a.c",)], "p string")
    assert rows(paths.select(reports.remapped("p", [("/ci/{job}/source/", "src/")], "job1").alias("q")), "q") == [("src/a.c",)]


def test_requirement_blocks(spark):
    from tracelake.sources import requirements

    doc = "intro\nID x SwTR_01\nName Door lock\nDescription Lock the\ndoor at\n\nnot read\nRelated ID SwCom_1, SwFn_2\nASIL ASIL-B\nSwTSR_02: Second\nDescription\nsafe\nType x\nmore"
    found = requirements.blocks(logs.lines_of(spark.createDataFrame([(1, doc), (2, None)], "doc int, t string"), ["doc"], "t"), ["doc"])
    assert rows(found, "id", "name", "description", "asil") == [("SwTR_01", "Door lock", "Lock the door at", "B"), ("SwTSR_02", "Second", "safe", "")]
    assert rows(requirements.components(found), "requirement_id", "kind", "target") == [("SwTR_01", "component", "SwCom_1"), ("SwTR_01", "function", "SwFn_2")]


def test_generated_cases(spark):
    flow = spark.createDataFrame([("f", 0, "if", "a > 10"), ("f", 1, "loop", "i < 3"), ("g", 0, "return", "0")], "function string, ordinal int, type string, condition string")
    reqs = spark.createDataFrame([("SwTR_1",), ("SwTR_2",)], "req_id string")
    cases = generate.test_cases(reqs, spark.createDataFrame([("SwTR_1", "f"), ("SwTR_2", "g")], "req_id string, function string"), flow)
    assert rows(cases, "testcase") == [("SwTC_TR_1_01",), ("SwTC_TR_1_02",), ("SwTC_TR_2_01",)]
    assert tuple(generate.case_quality(cases, reqs).first()) == (3, 2, 1.5, 100.0)
    toggles = generate.toggled_conditions(flow.filter("function = 'f'").withColumnRenamed("function", "unit"))
    assert rows(toggles, "strategy", "name", "value") == [("MCDC_0", "a", 10), ("MCDC_1", "i", 3), ("MCDC_BASE", "a", 11), ("MCDC_BASE", "i", 2)]
    v = spark.createDataFrame([("u", 0, "u16_speed"), ("u", 1, "s8_temp")], "unit string, ordinal int, name string")
    both = generate.sequences([generate.boundary_rows(v), generate.condition_rows(v), generate.loop_rows(v.limit(1))], 8)
    assert both.select("seq").distinct().count() == 8
    assert rows(generate.boundary_rows(v).filter("strategy = 'MIXED'"), "name", "value") == [("s8_temp", 127.0), ("u16_speed", 0.0)]
    sheet = spark.createDataFrame([("A", 1, 1, "x")], "sheet string, row int, col int, value string")
    assert rows(generate.structure_issues(sheet, ["A", "B"], {"A": (2, 9)}), "sheet", "issue") == [("A", "too_few"), ("B", "missing")]


def test_line_diffs_and_modules(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nc\nd"), (2, None, "")], "key int, x string, y string")
    assert rows(relate.line_diff(pairs, "x", "y"), "key", "added", "removed") == [(1, 1, 1), (2, 0, 0)]
    f = spark.createDataFrame([("g_ReadSensor", "src/adc.c"), ("MotorStart", None)], "name string, file string")
    assert rows(relate.module_candidates(f, "name", "file"), "module", "confidence") == [("Motor", 0.6), ("adc", 0.9)]


def test_environment_and_case_reports(spark):
    from tracelake.sources import reports

    page = '<table><tr><th>File / Environment</th><th>Statements</th><th>Branches</th></tr><tr><td class="i0 x">a.c</td><td>1 / 2 (50%)</td><td>0 / 4 (0%)</td></tr><tr><td class="i1">env</td><td>9/9</td><td></td></tr><tr><td class="i0">b.c</td><td>1 / 10 (10%)</td><td>3 / 4 (75%)</td></tr></table>'
    files_ = reports.environment_files(spark.createDataFrame([(1, page)], "id int, html string"), ["id"], "html")
    assert [r["file"] for r in reports.worst_files(files_, ["id"], "statements", 1).collect()] == ["b.c"]
    assert [r["file"] for r in reports.worst_files(files_, ["id"], "branches", 1).collect()] == ["a.c"]
    cases = "<h2>Intro</h2>x<h2>Test Case 1</h2><table><tr><td>Unit</td><td>a</td></tr></table><h4>Inputs</h4><pre>x = 1</pre>"
    got = reports.test_cases(spark.createDataFrame([(1, cases)], "id int, html string"), ["id"], "html")
    assert rows(got, "testcase", "key", "value") == [("Test Case 1", "Unit", "a"), ("Test Case 1", "code:Inputs", "x = 1")]


def test_macros_pointers_and_constants(spark):
    source = "#define CALL(x) helper(x)\n#define A 0x10\n#define B (A + 2)\n#define C B\n#define D (1 << 3)\n#define E text\nvoid f(void) { CALL(1); cb = &target; cb(2); other = &unused; }\n"
    src = spark.createDataFrame([("a.c", source)], "path string, text string")
    found, known = code.functions(src), code.macros(src)
    assert rows(code.macro_calls(found, known), "src", "dst") == [("f", "helper")]
    assert rows(code.pointer_calls(found, spark.createDataFrame([("target",), ("unused",)], "name string")), "src", "dst") == [("f", "target")]
    assert rows(code.constants(known).filter("value is not null"), "name", "value") == [("A", 16), ("B", 18), ("C", 18), ("D", 8)]


def test_token_match_and_defaults(spark):
    f = spark.createDataFrame([("g_ReadSpeedValue", "SwTR_1"), ("Lone", None)], "name string, related string")
    e = spark.createDataFrame([("SpeedRead", "SwTR_1, SwTR_2"), ("ReadSpeedValueFast", ""), ("Other", None)], "entry string, ids string")
    assert rows(relate.token_match(f, "name", "related", e, "entry", "ids"), "name", "entry", "score") == [("g_ReadSpeedValue", "SpeedRead", 14)]
    done = relate.finished_fields(spark.createDataFrame([("g_ReadSpeed", "tbd", " ", None)], "name string, asil string, related string, description string")).first()
    assert tuple(done) == ("g_ReadSpeed", "QM", "TBD", "Performs read speed.")
