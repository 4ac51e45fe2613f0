"""Expressions, constants, propagation along calls and value ranges, against slow versions."""

import random
import re

import pytest

from tracelake.functions.expressions import value_of
from tracelake.operators import graph, ranges
from tracelake.sources import code


def test_expressions_as_python():
    rnd = random.Random(1)

    def make(depth):
        if depth == 0 or rnd.random() < 0.2:
            n = rnd.randint(0, 40)
            return rnd.choice([str(n) if n else "0", hex(n), f"{n}u" if n else "0U", f"{n}UL" if n else "0L"])
        kind = rnd.random()
        if kind < 0.2:
            return rnd.choice(["-", "~", "+"]) + "(" + make(depth - 1) + ")"
        if kind < 0.4:
            return "(" + make(depth - 1) + ")"
        return make(depth - 1) + rnd.choice([" + ", "-", " * ", "&", " | ", "^", " << ", " >> "]) + make(depth - 1)

    seen = 0
    for _ in range(3_000):
        text = make(4)
        try:
            want = eval(re.sub(r"(?<=[0-9a-f])[uUlL]+\b", "", text))
        except (ValueError, OverflowError, MemoryError):
            want = None
        shifts = re.search(r"<<|>>", text)
        if want is None or abs(want) >= 2**63:
            assert value_of(text) is None or shifts
        elif not shifts:
            assert value_of(text) == want, text
            seen += 1
        else:
            assert value_of(text) in (want, None), text
    assert seen > 500


@pytest.mark.parametrize(
    ("text", "value"),
    [("-7 / 2", -3), ("-7 % 2", -1), ("7 / 0", None), ("010", 8), ("08", None), ("1 < 2 && 3 != 3", 0), ("!0 || 1", 1), ("1 +", None), ("(1", None), ("1)", None), ("", None), (None, None), ("A + B", 7), ("A + C", None), ("1 2", None), ("f(1)", None), ("1.5", None), ("0x7FFFFFFFFFFFFFFF + 1", None), ("2 - -3", 5), ("-2 * -3", 6), ("5 - 2 - 1", 2), ("(uint8) 5", None), ("A(1)", None)],
)
def test_single_expressions(text, value):
    assert value_of(text, {"A": 3, "B": 4}) == value


def test_constants_of_any_chain(spark):
    macros = [("K0", "1")] + [(f"K{i}", f"(K{i - 1} + {i})") for i in range(1, 12)]
    macros += [("LOOP_A", "LOOP_B + K1"), ("LOOP_B", "LOOP_A"), ("SELF", "SELF"), ("TEXT", '"K0"'), ("MIX", "K0 + unknown * 0x10"), ("EMPTY", ""), ("F(x)", "x"), ("TWICE", "2"), ("TWICE", "3"), ("NONE", None)]
    got = {r["name"]: (r["value"], r["text"]) for r in code.constants(spark.createDataFrame(macros, "name string, value string")).collect()}
    assert [got[f"K{i}"][0] for i in range(12)] == [1 + i * (i + 1) // 2 for i in range(12)]
    assert got["LOOP_A"] == (None, "LOOP_B + 2") and got["SELF"] == (None, "SELF") and got["MIX"] == (None, "1 + unknown * 0x10")
    assert got["TWICE"][0] == 2 and got["EMPTY"] == (None, "") and got["NONE"][0] is None and "F(x)" not in got
    assert code.constants(spark.createDataFrame([], "name string, value string")).count() == 0


def slow_propagation(edges, modules, facts, hops, most):
    callees = {}
    for s, d, o in sorted(edges, key=lambda e: (e[2], e[1])):
        if s != d and d not in callees.setdefault(s, []):
            callees[s].append(d)
    have = {}
    for f, k, v in facts:
        have.setdefault(f, {}).setdefault((k, v.lower()), (0, None, f))
    direct = {f: set(x) for f, x in have.items()}
    out = {f: dict(x) for f, x in have.items()}
    for caller, called in callees.items():
        mine = out.setdefault(caller, {})
        m = modules.get(caller) or None
        for b in called:
            if m is None or m == (modules.get(b) or None):
                for key in sorted(direct.get(b, ())):
                    mine.setdefault(key, (1, b, b))
    if hops > 1:
        for caller, called in callees.items():
            m = modules.get(caller) or None
            for b in called:
                for leaf in callees.get(b, []):
                    if m and m == modules.get(b) == modules.get(leaf) and len(callees[b]) <= most and leaf != caller:
                        for key in sorted(direct.get(leaf, ())):
                            out[caller].setdefault(key, (2, b, leaf))
    return {(f, k, v, h) for f, x in out.items() for (k, v), (h, _, _) in x.items()}


def test_propagation_as_slow_walk(spark):
    rnd = random.Random(4)
    names = [f"f{i:02}" for i in range(40)]
    edges = [(rnd.choice(names), rnd.choice(names), i) for i in range(110)]
    modules = {n: rnd.choice(["m1", "m1", "m2", ""]) for n in names[:36]}
    facts = [(rnd.choice(names), rnd.choice(["global", "static"]), f"Var{rnd.randint(0, 30)}") for _ in range(60)]
    frames = spark.createDataFrame(edges, "src string, dst string, ordinal int"), spark.createDataFrame(list(modules.items()), "name string, module string"), spark.createDataFrame(facts, "function string, kind string, variable string")
    for hops, most in ((1, 5), (2, 5), (2, 2)):
        got = graph.propagated(*frames, hops, most).collect()
        assert {(r["function"], r["kind"], r["variable"].lower(), r["hop"]) for r in got} == slow_propagation(edges, modules, facts, hops, most)
        held = {(f, k, v.lower()) for f, k, v in facts}
        assert all((r["origin"], r["kind"], r["variable"].lower()) in held for r in got)
    far = graph.propagated(*frames, None, None).collect()
    assert len({(r["function"], r["kind"], r["variable"].lower()) for r in far}) == len(far) >= len(got)


def test_ranges_by_first_source(spark):
    source = """
#define SPEED_MIN 0
#define SPEED_MAX (0x10 * 2)
#define START 7
/* Speed of the wheel
   Range: 1 ~ SPEED_MAX */
static U8 by_comment = SPEED_MIN;
// Value Range: -5 .. 5
S16 by_line;
"""
    files = spark.createDataFrame([("a.c", source)], "path string, text string")
    comments = ranges.range_comments(files)
    assert sorted((r["name"], r["text"]) for r in comments.collect()) == [("by_comment", "1 ~ SPEED_MAX"), ("by_line", "-5 .. 5")]
    rows = [
        ("by_comment", "U8", "SPEED_MIN", None), ("by_line", "S16", None, None), ("by_pair", "U8", "SPEED_MAX", None), ("by_macro", "U8", "START", None), ("by_param", "U8", "x", None), ("by_type", "S8", "3", None),
        ("by_init", "struct T", "0x1F", None), ("by_decl", "struct T", None, "2 ~ 9"), ("by_word", "struct T", "next()", None), ("nothing", None, None, None), ("wide", "U8", None, None),
    ]
    variables = spark.createDataFrame(rows, "name string, type string, init string, declared string")
    params = spark.createDataFrame([("by_param", "[10, 20]"), ("wide", "0 ~ 300")], "name string, text string")
    found = ranges.value_ranges(variables, code.constants(code.macros(files)), comments, params)
    got = {r["name"]: (r["low"], r["high"], r["source"], r["outside_type"]) for r in found.collect()}
    assert got == {
        "by_comment": (1, 32, "comment", False), "by_line": (-5, 5, "comment", False), "by_pair": (0, 32, "macro pair", False), "by_macro": (7, 7, "macro", False), "by_param": (10, 20, "parameter", False), "by_type": (-128, 127, "type", False),
        "by_init": (31, 31, "init", False), "by_decl": (2, 9, "declaration", False), "by_word": (None, None, "init", False), "nothing": (None, None, None, False), "wide": (0, 300, "parameter", True),
    }
    usage = spark.createDataFrame([("f", "by_type"), ("f", "by_init"), ("g", "lost"), ("f", "by_type")], "function string, name string")
    bodies = spark.createDataFrame([("f", "x = a / by_type; y = by_init[i + 1] + by_init[ 2 ];"), ("g", None)], "name string, body string")
    pointers = spark.createDataFrame([("lost",)], "name string")
    got = {(r["function"], r["name"]): (r["low"], r["source"], r["note"]) for r in ranges.function_ranges(usage, found, bodies, pointers).collect()}
    assert got == {("f", "by_type"): (-128, "type", "divisor: no 0"), ("f", "by_init"): (31, "init", "idx: i + 1, 2"), ("g", "lost"): (None, None, "range: 0x00000000 ~ 0xFFFFFFFF")}


def test_fallback_calls(spark):
    text = "void a(void) { b(); }\nvoid lone(void);\nint x = c(1) + (*d)(2) + if_(3) + lone(1);\n#define Z b(1)\n"
    found = spark.createDataFrame([("p", "a", "b();"), ("p", "b", "a(); c(); a(); \"d()\";"), ("p", "c", ""), ("p", "d", None), ("p", "lone", "")], "path string, name string, body string")
    files = spark.createDataFrame([("p", text)], "path string, text string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = sorted((r["src"], r["ordinal"], r["dst"]) for r in code.fallback_calls(found, files, edges, reach=40).collect())
    assert [g for g in got if g[0] == "b"] == [("b", 0, "a"), ("b", 1, "c")]
    assert {g[2] for g in got if g[0] == "lone"} == {"a", "b", "c", "d"} and not any(g[0] == "a" for g in got)
