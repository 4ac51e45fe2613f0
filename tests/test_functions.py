from datetime import date

import pytest
from pyspark.sql import functions as F

from tracelake.functions import dates, numbers, text


@pytest.fixture(scope="module")
def value(spark):
    def run(make, *values):
        """The expression over literal texts, one result for each."""
        rows = [(i, v) for i, v in enumerate(values)]
        got = spark.createDataFrame(rows, "i int, v string").select("i", make(F.col("v")).alias("r")).collect()
        return [r["r"] for r in sorted(got, key=lambda r: r["i"])]

    return run


def test_messages_and_tokens(value):
    assert value(text.normalise_message, " at /app/x/y.c  2024-01-02T03:04:05.678Z\n done ", None) == ["at <PATH> <TIME> done", ""]
    assert value(text.tokens, "Error a e2e Error 가나 _x", "") == [["error", "e2e", "가나", "_x"], []]


def test_failures_and_results(value):
    assert value(text.failure_class, "values mismatch", "Timed out", "SEGFAULT then", "no harness", "odd", None) == ["assertion", "timeout", "crash", "environment", "unknown", "unknown"]
    assert value(text.result_class, " passed ", "Not Run", "NG", "", "token") == ["pass", "skip", "fail", "unknown", "pass"]
    assert value(text.header_name, "Req  ID", "Test  Script name", "Stubbed", "UNIT", "other") == ["requirement_id", "test_script", "stubs", "unit", ""]


def test_ids(value):
    assert value(text.requirement_key, " req - 1 ") == ["REQ-1"]
    assert value(text.requirement_type, "SwTSR_1", "SwTR_1", "SwXX_1", None) == ["TSR", "TR", "OTHER", "OTHER"]
    assert value(text.document_ids, "SwTR_12 and swfn_3, SwTR_12") == [["SwTR_12", "swfn_3"]]
    assert value(text.test_ids, "SwTC_A1-b checks SRS-9") == [["SwTC_A1-b", "SRS-9"]]
    assert value(text.unit_id, "x swufn_007 y", "plain") == ["SwUFn_007", "plain"]
    assert value(text.component_label, "swcom_3 ( Main )", "SwCom_12") == ["SwCom_03(Main)", "SwCom_12"]


def test_levels_rules_and_lists(value):
    assert value(text.asil, "ASIL-B, b; QM", "tbd\nfoo\nfoo", "N/A", "none") == ["B, QM", "foo", "A", ""]
    assert value(text.rule_label, "MISRA Rule-5.3", "dir 1-1", "13.1", "free text") == ["Rule 5-3", "Dir 1-1", "Rule 13-1", "free text"]
    assert value(text.distinct_lines, "a\n b \na\n\n") == ["a\nb"]
    assert value(text.related_ids, "A, B;A\nC") == ["A, B, C"]


def test_reports_and_questions(value):
    assert value(text.report_type, "x/p_RCR_1.html", "a_full_report.html", "b.XLSX", "c") == ["prqa_rcr", "vcast_full", "xlsx", "other"]
    assert value(text.report_group, "x/p_RCR_1.html", "vcast.txt", "b.log") == ["prqa", "vectorcast", "log"]
    assert value(text.question_type, "Where is the spec of this function", "which symbol", "git status", "hello") == ["docs", "code", "git", "general"]
    assert value(lambda c: text.question_domains(text.question_type(c)), "why did the build fail") == [["reports", "logs", "docs", "code"]]


def test_kpis(value):
    got = value(text.kpis, "Failed: 3 errors 12 failed 7", "error error passed", None)
    assert [tuple(r) for r in got] == [(7, 12, 0, 0), (0, 2, 0, 1), (0, 0, 0, 0)]


def test_c_text(value):
    assert value(text.call_names, 'if (a) { f(b); /* g() */ h ("k()"); f(1); } // m()') == [["f", "h"]]
    assert value(text.name_words, "g_ReadSensorValue_u8") == [["Read", "Sensor", "Value"]]
    assert value(lambda c: text.limited_sentences(c, 1, 3, 100), "One two three four. Next one.") == ["One two three."]
    assert value(text.meaningful, "x", " n/a ", "-", "TBD", "", None) == [True, False, False, False, False, False]
    assert value(text.json_candidate, 'say ```json\n{"a": 1}\n``` ok', "{bad", 'x {"b": 2} y') == ['{"a": 1}', None, '{"b": 2}']


def test_ratios_and_rates(value):
    assert [tuple(r) for r in value(numbers.ratio, "30 / 45 (67%)", "8/14", "", None, "0 / 0")] == [(30, 45, 0.67), (8, 14, 8 / 14), (0, 0, 0.0), (0, 0, 0.0), (0, 0, 0.0)]
    assert value(numbers.rate_0_1, "0.5", "55", "7210", "99999", "x") == [0.5, 0.55, 0.721, 99999.0, None]
    assert value(numbers.hhmmss, "1:02", "1:02:03", "x") == [3720, 3723, 0]
    assert value(numbers.lenient_int, "a-12b3", "none") == [-12, 0]
    assert value(numbers.lenient_double, "1,234.5%", "x") == [1234.5, None]
    assert value(lambda c: numbers.levels(c, [11, 21, 31]), "10", "11", "31", "x") == [0, 1, 3, 0]


def test_vectors(spark):
    row = spark.sql("select array(1.0, 2.0) a, array(2.0, 4.0, 0.0) b, cast(array() as array<double>) e").select(numbers.cosine("a", "b").alias("x"), numbers.cosine("a", "e").alias("y"), numbers.vector_text("a").alias("t")).first()
    assert row["x"] == pytest.approx(1.0) and row["y"] == 0.0 and row["t"] == "[1.000000,2.000000]"


def test_dates(spark):
    d = spark.sql("select date'2024-03-04' d").select(dates.previous_business_day("d"), dates.previous_month_end("d"), dates.month_end("d"), dates.is_monthly_day("d"), dates.is_weekly_day("d")).first()
    assert tuple(d) == (date(2024, 3, 1), date(2024, 2, 29), date(2024, 3, 31), True, False)
