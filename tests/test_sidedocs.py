"""Documents beside the requirements, on small fixtures of each rule."""

from tracelake.sources import sidedocs


def cells(sheet, *rows):
    return [("p", sheet, r + 1, c + 1, v) for r, row in enumerate(rows) for c, v in row.items()]


def test_signals(spark):
    head = {5: "ID", 6: "Signal Name", 19: "SW Variable Name"}
    rows = cells("1.Cover", {5: "HSI_9", 6: "no"}) + cells("2.HSIS", {0: "title"}, {5: "HSI_0", 6: "early"}, head, {5: "HSI_01", 6: "PTP 4", 11: "IN", 19: "u8g_A, u8g_B\nx9 9x"}, {5: "hsi_2", 19: "v_C"}, {5: "X_3", 6: "no"}, {5: "HSI_4", 6: None}, {5: "HSI_5", 6: "9"})
    found = sidedocs.signals(spark.createDataFrame(rows, "path string, sheet string, row int, col int, value string"))
    assert [(r["id"], r["signal_name"], r["direction"]) for r in found.orderBy("row").collect()] == [("HSI_01", "PTP 4", "IN"), ("hsi_2", "", ""), ("HSI_5", "9", "")]
    assert {(r["name"], r["kind"]) for r in sidedocs.signal_names(found).collect()} == {("u8g_A", "variable"), ("u8g_B", "variable"), ("x9", "variable"), ("v_C", "variable"), ("PTP_4", "signal")}
    assert sidedocs.signals(found.sparkSession.createDataFrame([], "path string, sheet string, row int, col int, value string")).count() == 0


def test_descriptions_strategy_and_summary(spark):
    paragraphs = [
        (1, "Normal", False, "before"), (2, "Heading 2", None, "F_One"), (3, "", False, "a"), (4, "", False, " b "), (5, None, None, ""), (6, "", False, "c"), (7, "", False, "d"), (8, "", True, "Test Scope here"), (9, "", False, "all of it, with more than twenty"), (10, "heading", False, "f_one"), (11, "", False, "later"),
    ]
    p = spark.createDataFrame([("p", *r) for r in paragraphs], "path string, ordinal int, style string, bold boolean, text string")
    got = {r["name"]: r["description"] for r in sidedocs.heading_descriptions(p).collect()}
    assert got == {"f_one": "later", "test scope here": "all of it, with more than twenty"}
    assert [r["text"] for r in sidedocs.strategy_lines(p).orderBy("place").collect()] == ["[Test Scope here]", "all of it, with more than twenty"]
    tables = [("p", 0, 0, ["No", "Function Name", "설명"]), ("p", 0, 1, ["1", "F", "one"]), ("p", 0, 2, ["2", " ", "none"]), ("p", 0, 3, ["3", "f ", "two"]), ("p", 1, 0, ["a", "b"]), ("p", 1, 1, ["x", "y"]), ("p", 2, 0, ["name"]), ("p", 2, 1, ["z"])]
    t = spark.createDataFrame(tables, "path string, table int, row int, cells array<string>")
    assert [(r["name"], r["description"]) for r in sidedocs.table_descriptions(t).collect()] == [("f", "two")]
    assert [r["text"] for r in sidedocs.summary_lines(p, t).orderBy("place").collect()] == ["[Section] F_One", "[Section] Test Scope here", "all of it, with more than twenty", "[Section] f_one", "1 | F | one", "2 | none", "3 | f | two"]
    functions = spark.createDataFrame([("S1", "F_one", "long enough"), ("S2", "F", None), ("f_one", "other", "abc"), ("S4", "none", None)], "id string, name string, description string")
    found = spark.createDataFrame([("f_one", "later on it is"), ("f", "two")], "name string, description string")
    assert [r["description"] for r in sidedocs.longer_descriptions(functions, found).orderBy("id").collect()] == ["later on it is", "two", None, "later on it is"]


def test_rows_beyond_the_header_are_needed(spark):
    t = spark.createDataFrame([("p", 0, 0, ["name", "description"])], "path string, table int, row int, cells array<string>")
    assert sidedocs.table_descriptions(t).count() == 0
