"""Design documents, document impacts and triggers on small fixtures of each rule."""

from tracelake.operators import designs


def test_sections_of_paragraphs(spark):
    rows = [
        ("p", 0, "text", "Normal", " before "), ("p", 1, "text", "Heading 1", "One"), ("p", 2, "row", "", "a\t\t b  c"), ("p", 3, "text", None, "line"), ("p", 4, "text", "heading2", "Empty"), ("p", 5, "text", "Title", "x" * 130), ("p", 6, "text", "Title", "Two"), ("p", 7, "text", "", ""), ("p", 8, "text", "", "last"),
    ]
    df = spark.createDataFrame(rows, "path string, ordinal int, kind string, style string, text string")
    got = [(r["heading"], r["text"]) for r in designs.document_sections(df).orderBy("ordinal").collect()]
    assert got == [("Document Overview", "before"), ("One", "a | b c\nline"), ("Empty", "x" * 130), ("Two", "last")]


def test_facts_and_items(spark):
    rows = [
        (1, "SwCom_3: Motor", "runs g_Motor_run and s_Aux_go"), (2, "Details", "g_Motor_run again"), (3, "Contents", "g_Never_seen"), (4, "Revision History", "g_Motor_run"), (5, "Many", "DoorCtrl, WindowCtrl and PumpManager"), (6, "One", "the DoorCtrl only"), (7, "Plain", "nothing"), (8, "SwCom 3 - more", "s_Aux_go"), (9, "", None),
    ]
    facts = designs.section_facts(spark.createDataFrame([("p", *r) for r in rows], "path string, ordinal int, heading string, text string"))
    got = {r["ordinal"]: (r["kind"], r["functions"], r["modules"]) for r in facts.collect()}
    assert got[1] == ("function", ["g_Motor_run", "s_Aux_go"], ["SwCom_3"]) and got[2] == ("function", ["g_Motor_run"], ["Motor"]) and got[3] == ("section", [], [])
    assert got[4][0] == "section" and got[5][0] == "section" and got[6] == ("module", [], ["DoorCtrl"]) and got[7] == ("section", [], []) and got[8][2] == ["SwCom_3"] and got[9][0] == "section"
    changed = spark.createDataFrame([("g_Motor_run", "body"), ("g_Door_x", "new")], "name string, change_type string")
    flagged = spark.createDataFrame([(" DOORCTRL",), ("",)], "module string")
    items = {(r["kind"], r["title"]): r for r in designs.design_items(facts, changed, flagged).collect()}
    run, aux, com, motor, door = (items[k] for k in (("function", "g_Motor_run"), ("function", "s_Aux_go"), ("module", "SwCom_3"), ("module", "Motor"), ("module", "DoorCtrl")))
    assert run["headings"] == ["SwCom_3: Motor", "Details"] and run["changed"] and run["change_types"] == ["BODY"] and run["review"] and run["modules"] == ["Motor", "SwCom_3"]
    assert aux["headings"] == ["SwCom 3 - more", "SwCom_3: Motor"] and aux["summary"] == "s_Aux_go" and not aux["changed"] and not aux["review"]
    assert com["changed"] and com["headings"] == ["SwCom 3 - more", "SwCom_3: Motor"] and motor["review"] and door["review"] and not door["changed"]
    assert {t for k, t in items if k == "section"} == {"Contents", "Revision History", "Many", "Plain", "Section 9"}
    assert designs.design_items(facts.limit(0), changed, flagged).count() == 0


def test_triggers(spark):
    requests = spark.createDataFrame([("g", "manual", "", None, [" a.c ", ""]), ("g", "push", "v1", True, None), ("s", "push", None, False, []), ("h", "push", None, None, None), ("x", "push", "v", None, ["b.c"])], "scm_id string, trigger_type string, base_ref string, dry_run boolean, files array<string>")
    registry = spark.createDataFrame([("g", None, "/src", "main"), ("s", "SVN", "/s", None), ("h", "git", "/h", " ")], "id string, scm_type string, source_root string, base_ref string")
    changed = spark.createDataFrame([("g", "z.c"), ("g", "b.c"), ("g", "b.c"), ("h", "q.h")], "scm_id string, path string")
    got = sorted((r["scm_id"], r["trigger_type"], r["scm_type"], r["base_ref"], r["dry_run"], r["changed_files"], r["known"]) for r in designs.change_triggers(requests, registry, changed).collect())
    assert got == [("g", "manual", "git", "main", False, ["a.c"], True), ("g", "push", "git", "v1", True, ["b.c", "z.c"], True), ("h", "push", "git", "HEAD~1", False, ["q.h"], True), ("s", "push", "svn", "", False, [], True), ("x", "push", None, None, False, [], False)]


def test_impacts(spark):
    changes = spark.createDataFrame([("f", "HEADER"), ("g", "NEW"), ("h", "OTHER"), ("i", None)], "function string, change_type string")
    got = {(r["document"], r["function"]): r["impact"] for r in designs.document_impacts(changes).collect()}
    assert {d for d, f in got if f == "f"} == {"uds", "sits"} and len([1 for d, f in got if f == "g"]) == 5 and not any(f in "hi" for _, f in got)
    assert got["suts", "g"] == "[g] NEW → 신규 함수 → TC 신규 생성 필요"
    assert designs.document_impacts(changes, ["sds"]).count() == 1
