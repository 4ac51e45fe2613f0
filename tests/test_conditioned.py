"""Conditional compilation against malformed and nested directives, and texts about functions."""

from pyspark.sql import functions as F

from tracelake.functions import descriptions
from tracelake.sources import code


def kept(text, **defines):
    return [line for line in code._conditioned(text, defines).split("\n") if line]


def test_branches_and_malformed_directives():
    assert kept("#if A\na\n#else\nb\n#endif\nc", A="1") == ["a", "c"] and kept("#if A\na\n#else\nb\n#endif\nc") == ["b", "c"]
    assert kept("#endif\n#else\na\n#if 0\nb") == ["a"]
    assert kept("#if 0\n#if 1\na\n#else\nb\n#endif\n#elif 1\nc\n#elif 1\nd\n#else\ne\n#endif") == ["c"]
    assert kept("# ifdef X // why\nx\n# else /* no */\ny\n# endif", X="") == ["x"]
    assert kept("#if defined X && !defined(Y) || Z\nx\n#endif", X="") == ["x"]
    assert kept("#if A\na\n#endif", A="B", B="A") == [] and kept("#if f(1)\na\n#endif") == []
    assert kept("#define N 2\n#if N == 2\na\n#undef N\n#endif\n#ifdef N\nb\n#endif") == ["#define N 2", "a"]


def test_lines_keep_their_places(spark):
    files = spark.createDataFrame([("p", "a\n#if 0\nb\n#endif\nc"), ("q", None), ("r", "")], "path string, text string")
    got = {r["path"]: r["text"] for r in code.conditioned(files).collect()}
    assert got == {"p": "a\n\n\n\nc", "q": None, "r": ""}


def test_descriptions(spark):
    rows = [("s_MotorInit", ["a", " ", None]), (None, None), ("xyz", [])]
    df = spark.createDataFrame(rows, "name string, calls array<string>")
    got = [r[0] for r in df.select(descriptions.described("name", F.col("calls"))).collect()]
    assert got[0] == "s_MotorInit: Motor Init 모듈에서 초기화 절차를 수행하고 기본 파라미터를 설정한다. 주요 호출 대상: a."
    assert got[1].startswith("해당 소프트웨어 유닛: ") and got[2].endswith("소프트웨어 유닛의 지정된 동작을 수행한다.")
    bodies = spark.createDataFrame([("f", "if (NULL == p) x(); if (is_Ready) y();" + " " * 600 + "assert(long_enough)"), ("Motor_Init", "x = 1;"), ("Motor_Init", ""), ("f", None)], "name string, body string")
    assert [r[0] for r in bodies.select(descriptions.precondition("body", "name")).collect()] == ["if (is_Ready); if (NULL == p)", "N/A (initialization function)", "", ""]
