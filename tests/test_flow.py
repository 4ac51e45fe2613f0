"""Control flow against programs that are written from a known tree, and steps against a recursive walk of it."""

import random

import pytest

from tracelake.operators import branches
from tracelake.plans import catalog
from tracelake.sources import code, flow


def program(rnd, depth=0, most=6):
    """A random list of nodes: (kind, text, detail, parts) with parts as (branch, label, nodes)."""
    nodes = []
    for _ in range(rnd.randint(1, 3)):
        kind = rnd.choice(["call", "assign", "return", "if", "ifelse", "elif", "for", "while", "do", "switch"] if depth < most else ["call", "assign", "return"])
        inner = lambda: program(rnd, depth + 1, most)
        n = rnd.randint(0, 99)
        if kind == "call":
            nodes.append(("call", f"f{n}", "", []))
        elif kind == "assign":
            nodes.append(("assign", f"v{n} = {n} + 1", "", []))
        elif kind == "return":
            nodes.append(("return", f"v{n}", "", []))
        elif kind in ("if", "ifelse", "elif"):
            parts = [("true", "", inner())]
            if kind == "ifelse":
                parts.append(("false", "", inner()))
            if kind == "elif":
                parts.append(("false", "", [("if", f"e{n} < {n}", "", [("true", "", inner())])]))
            nodes.append(("if", f"c{n} == {n}", "else" if len(parts) > 1 else "", parts))
        elif kind == "switch":
            parts = [("case", f"K{k}", inner()) for k in range(rnd.randint(1, 3))] + ([("default", "", inner())] if n % 2 else [])
            nodes.append(("switch", f"s{n}", "", parts))
        else:
            nodes.append(("loop", f"i < {n}", kind, [("body", "", inner())]))
    return nodes


def written(rnd, nodes):
    out = []
    for kind, text, detail, parts in nodes:
        block = lambda p: "{ " + written(rnd, p[2]) + " }" if len(p[2]) != 1 or p[2][0][0] not in ("call", "assign", "return") or rnd.random() < 0.5 else written(rnd, p[2])
        if kind == "call":
            out.append(f"{text}(a, \"; {{\");")
        elif kind == "assign":
            out.append(f"{text}; /* if (x) {{ */")
        elif kind == "return":
            out.append(f"return {text};")
        elif kind == "if":
            s = f"if ({text}) {block(parts[0])}"
            if len(parts) > 1:
                own = parts[1][2]
                s += " else " + (written(rnd, own) if len(own) == 1 and own[0][0] == "if" else block(parts[1]))
            out.append(s)
        elif kind == "switch":
            out.append(f"switch ({text}) {{ " + " ".join((f"case {p[1]}: " if p[0] == "case" else "default: ") + written(rnd, p[2]) + " break;" for p in parts) + " }")
        elif detail == "do":
            out.append(f"do {block(parts[0])} while ({text});")
        elif detail == "for":
            out.append(f"for (i = 0; {text}; i++) {block(parts[0])}")
        else:
            out.append(f"while ({text}) {block(parts[0])}")
    return "\n".join(out)


def numbered(nodes, most):
    """(node, parent, branch, depth, kind, text, detail, last) of a tree cut below `most`, without empty control."""

    def cut(nodes, depth):
        kept = []
        for kind, text, detail, parts in nodes:
            if depth > most:
                continue
            under = [(b, label, cut(inner, depth + 1)) for b, label, inner in parts]
            if kind == "switch":
                under = [p for p in under if p[2]]
                if depth == most:
                    under = []
            if kind in ("call", "assign", "return") or any(p[2] for p in under):
                if kind == "if":
                    detail = "else" if len(under) > 1 and under[1][2] else ""
                kept.append((kind, text, detail, [p for p in under if p[2]]))
        return kept

    rows = []

    def add(nodes, parent, branch, depth):
        for kind, text, detail, parts in nodes:
            rows.append([len(rows), parent, branch, depth, kind, text, detail, 0])
            me = len(rows) - 1
            for b, label, inner in parts:
                if kind == "switch":
                    rows.append([len(rows), me, "case", depth + 1, b, label, "", 0])
                    at = len(rows) - 1
                    add(inner, at, b, depth + 1)
                    rows[at][7] = len(rows) - 1
                else:
                    add(inner, me, b, depth + 1)
            rows[me][7] = len(rows) - 1

    add(cut(nodes, 0), -1, "", 0)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("most", [4, 1, 9])
def test_trees_of_random_programs(most):
    for seed in range(150):
        rnd = random.Random(seed)
        nodes = program(rnd)
        text = written(rnd, nodes)
        assert [r[:8] for r in flow.flow_rows("{" + text + "}" if seed % 2 else text, None, most)] == numbered(nodes, most), text


GARBAGE = 'if ( ) { } ; else while ( for switch ( case default : do f ( g h a = b += ++ == 0 err != < > 1 return break [ ] , { } ; ( ) } case 1 : if ( x == 0 ) switch ( m ) { case K : goto é _é " // /* */ # \\ <<= -> 3.5f "" f(a); x = 1; = {'.split()


def test_no_text_is_read_otherwise_than_token_by_token():
    """The digest is that of the reader that went token by token."""
    import hashlib

    found = hashlib.sha256()
    for seed in range(3000):
        rnd = random.Random(seed)
        text = "".join(rnd.choice(GARBAGE) + rnd.choice([" ", "", "\n"]) for _ in range(rnd.randint(0, 90)))
        found.update(repr([(*r[:8], list(r[8])) for r in flow.flow_rows(text, None if seed % 3 else {"f", "a", "err"}, rnd.choice([1, 4]))]).encode())
    assert found.hexdigest() == "d320b1c518135eddfe182faf07cf0c7701c5a79ef04ff2cb7d2b80f9bcc121a5"


def test_a_body_is_read_in_a_few_times_what_its_tokens_take():
    import time

    texts = [f"int v{k} = {k};\ninit();\n" + "".join(f"if (a{i} > {k}) {{ t{i}(); " for i in range(k % 7)) + "} " * (k % 7) + f"switch (mode) {{ case {k}: f(); break; default: g(); }} while (n < {k}) step({k}); return v{k};" for k in range(700)]

    def least(read):
        took = []
        for _ in range(7):
            began = time.process_time()
            for text in texts:
                read(text)
            took.append(time.process_time() - began)
        return min(took)

    assert least(flow.flow_rows) < 8 * least(flow.TOKEN.findall)  # 4 by statements, 10 to 14 token by token


def walk(rows):
    """Cases by a recursive walk of node rows, one list of (action, expected) each."""
    children = {}
    for r in rows:
        children.setdefault((r[1], r[2]), []).append(r)
    cases = []
    step = lambda kind, text: (branches.STEPS[kind][0].replace("{}", text), branches.PLAIN_RETURN if kind.endswith("return") and not text else branches.STEPS[kind][1].replace("{}", text))

    def control(r, before):
        node, text = r[0], r[5]
        if r[4] == "if":
            for side in ("true", "false"):
                inner = children.get((node, side), [])
                if side == "true" or inner:
                    steps = [*before, step(side, worded(text))]
                    body(inner, steps)
                    cases.append(steps)
        elif r[4] == "loop":
            calls = [step("loop call", c[5]) for c in children.get((node, "body"), []) if c[4] == "call"]
            cases.append([*before, (f"{r[6]} 루프 조건 설정: {worded(text)}", "루프 정상 진입"), *calls])
            cases.append([*before, (f"{r[6]} 루프 즉시 종료 조건 설정: NOT ({worded(text)})", "루프 미진입 (0회 반복)")])
        else:
            for c in sorted(children.get((node, "case"), []), key=lambda c: c[4] == "default"):
                names = list(dict.fromkeys(x[5] for x in rows if c[0] < x[0] <= c[7] and x[4] == "call"))[:4]
                entry = step("default", text) if c[4] == "default" else (f"{text} = {c[5]} 설정", f"switch 분기 → case {c[5]} 진입")
                cases.append([*before, entry, *(step("inner call", n) for n in names)])

    def body(nodes, steps):
        for r in nodes:
            if r[4] == "assign":
                name, _, value = r[5].partition(" = ")
                steps.append((f"{name} = {value} 설정 확인", f"{name} 값 변경 정상"))
            elif r[4] in ("call", "return"):
                steps.append(step("inner " + r[4], r[5]))
            else:
                control(r, steps)

    root = []
    for r in children.get((-1, ""), []):
        if r[4] in ("call", "return"):
            root.append(step(r[4], r[5]))
        elif r[4] != "assign":
            control(r, root)
    guards = [worded(r[5]) for r in rows if r[4] == "if" and any(w in worded(r[5]).lower() for w in branches.GUARD_WORDS)][:4]
    if guards:
        cases.append([*root, *(step("guard", g) for g in guards), step("guard end", "")])
    return cases or ([root] if root else [])


def worded(text):
    import re

    text = re.sub(r"\b([A-Za-z_]\w*)\s*!=\s*0\b", r"\1", text)
    return re.sub(r"\b([A-Za-z_]\w*)\s*==\s*0\b", r"!\1", text)


@pytest.mark.parametrize(("cases", "steps"), [(None, None), (5, 15), (2, 3)])
def test_steps_as_recursive_walk(spark, cases, steps):
    texts = {}
    for seed in range(60):
        rnd = random.Random(1000 + seed)
        texts[f"g{seed:02}"] = written(rnd, program(rnd, 0, 4)).replace("c7 ==", "err_status <")
    found = spark.createDataFrame([(n, t) for n, t in texts.items()], "name string, body string")
    got = {}
    for r in branches.branch_steps(flow.flow_tree(found), cases, steps).orderBy("function", "case_no", "step_no").collect():
        got.setdefault(r["function"], {}).setdefault(r["case_no"], []).append((r["action"], r["expected"]))
    for name, text in texts.items():
        want = [c[:steps] for c in walk(flow.flow_rows(text))][:cases]
        assert [got.get(name, {}).get(k + 1, []) for k in range(len(want))] == want, text
        assert len(got.get(name, {})) == sum(1 for w in want if w)


def test_no_rows_of_trees_go_through_the_driver(spark):
    text = "a(); if (x == 0) { b(); } else { c(); } switch (m) { case 1: d(); default: e(); } return 1;"
    found = spark.range(1, 3).selectExpr("'f' || id as name", f"case id when 1 then '{text}' else 'h();' end as body")
    steps = branches.branch_steps(flow.flow_tree(found), None, None)
    assert "Broadcast" not in steps._jdf.queryExecution().executedPlan().toString()
    assert steps.groupBy("function").agg({"case_no": "max"}).orderBy("function").collect() == [("f1", 4), ("f2", 1)]


def test_rows_of_trees_are_not_moved(spark):
    from pyspark.sql import functions as F

    context, sf = spark.sparkContext, "/root/testdata/sf0.001"
    stages = lambda: context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    moved = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = moved()
    catalog.QUERIES["branch_cases"](spark, sf).write.format("noop").mode("overwrite").save()
    assert moved() - before <= spark.read.parquet(f"{sf}/orders.parquet").count() + 10
    # Rows of a tree in any order give the steps that whole trees give.
    found = spark.createDataFrame([(f"g{k}", written(random.Random(k), program(random.Random(k), 0, 4))) for k in range(20)], "name string, body string")
    rows = flow.flow_tree(found).orderBy(F.rand(3))
    assert sorted(map(tuple, branches.branch_steps(rows, None, None).collect())) == sorted(map(tuple, branches.branch_steps(flow.flow_trees(found), None, None).collect()))


def test_awkward_bodies(spark):
    found = spark.createDataFrame([("a", None, ["f"]), ("b", "", ["f"]), ("c", "if (x", ["f"]), ("d", "}}} f(); else g(1);", ["f"]), ("e", "int t[] = {1, 2}; f(t);", ["f"])], "name string, body string, calls array<string>")
    got = sorted((r["function"], r["kind"], r["text"]) for r in flow.flow_tree(found).collect())
    assert got == [("d", "call", "f"), ("e", "assign", "int t[] = {1, 2}"), ("e", "call", "f")]
    assert flow.flow_tree(found.limit(0)).count() == 0


def test_guards_clamps_and_expected_values(spark):
    bodies = [("guarded", "if (u8_In > 10) { f(); }"), ("clamped", "while (on) { if (a) { u8_In = MAX_IN; } }"), ("plain", "u8_Other = u8_Thing;")]
    tree = flow.flow_tree(spark.createDataFrame(bodies, "name string, body string"))
    names = spark.createDataFrame([(f, n) for f, _ in bodies for n in ("u8_In", "x_custom")], "function string, name string")
    got = {(r["function"], r["name"]): (r["has_guard"], r["has_clamp"]) for r in branches.guards_and_clamps(tree, names).collect()}
    assert {k: v for k, v in got.items() if k[1] == "u8_In"} == {("guarded", "u8_In"): (True, False), ("clamped", "u8_In"): (False, True), ("plain", "u8_In"): (False, False)}
    assert not any(any(v) for k, v in got.items() if k[1] == "x_custom")
    rows = [("f", "u8_In", False, False, "uint8_t"), ("f", "Thing", False, False, "Opaque"), ("f", "Thing", True, False, "Opaque"), ("f", "loop_cnt", False, False, "Opaque"), ("f", "fsm_state", False, False, "uint8_t"), ("f", "is_valid", False, False, "Opaque"), ("f", "b", False, False, "bit")]
    got = {}
    for r in branches.expected_values(spark.createDataFrame([(f"{f}{i}", *r) for i, (f, *r) in enumerate(rows)], "function string, name string, has_guard boolean, has_clamp boolean, type string")).collect():
        got.setdefault(r["function"], {})[r["strategy"]] = r["expected"]
    order = lambda k: [got[k][s] for s in ("min_inv", "min", "mid", "max", "max_inv")]
    assert order("f0") == ["0", "0", "127", "255", "255"]
    assert order("f1") == ["[검증 필요] -1", "0", "127", "255", "[검증 필요] 256"]
    assert order("f2") == ["0", "0", "127", "255", "255"]
    assert order("f3")[::4] == ["0", "255"] and order("f4")[::4] == ["0", "0"]
    assert order("f5")[1::2] == ["0", "1"] and order("f6")[::4] == ["1", "1"]


def test_decision_values(spark):
    body = "if (u8_A > 10 && s16_B <= -3) { f(); if (c == 0x1F) g(); } while (u8_A > 10) { h(); } if (f32_Temp != limit) { f(); }"
    tree = flow.flow_tree(spark.createDataFrame([("f", body)], "name string, body string"))
    got = sorted((r["name"], r["op"], r["threshold"], r["true_value"], r["false_value"]) for r in branches.decision_values(tree).collect())
    assert got == [("c", "==", "0x1F", 31.0, 32.0), ("f32_Temp", "!=", "limit", -40.0, 25.0), ("s16_B", "<=", "-3", -3.0, -2.0), ("u8_A", ">", "10", 11.0, 10.0)]


def test_parts_outside_brackets(spark):
    rows = [("int (*cb)(int, int (*g)(int)), char c", ["int (*cb)(int, int (*g)(int))", "char c"]), ("map<a, b> m, int x[2, 3]", ["map<a, b> m", "int x[2, 3]"]), ("a, , b)", ["a", "b)"]), (None, []), ("", []), ("void", ["void"])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(flow.top_level_parts("t")).collect()] == [w for _, w in rows]


def test_nested_callbacks_are_defined_and_cut(spark):
    text = "void f(int (*cb)(int, int (*g)(int)), char c)\n{ cb(1, 0); }\nstatic void k(map<a, b> m, const char *s) { }\nint (*table[2])(void);\nvoid proto(int a);\n"
    files = spark.createDataFrame([("a.c", text)], "path string, text string")
    found = code.functions(files)
    assert [(r["name"], r["parameters"]) for r in found.orderBy("ordinal").collect()] == [("f", "int (*cb)(int, int (*g)(int)), char c"), ("k", "map<a, b> m, const char *s")]
    got = [(r["function"], r["ordinal"], r["name"], r["direction"]) for r in code.parameters(found).orderBy("function", "ordinal").collect()]
    assert got == [("f", 0, "cb", "INOUT"), ("f", 1, "c", "IN"), ("k", 0, "m", "IN"), ("k", 1, "s", "IN")]


def test_statements_and_declarations(spark):
    text = '''
#define X 1; \\
   2
static const unsigned int a = 3,
    *b, c[2][3] = { {1, 2}, {3} }; // end;
extern int shared;
void (*handler)(int, char) = 0;
struct P { int x; } ;
int proto(int (*cb)(int), char *s);
extern void *far_away(void);
char *text = "; not { an end";
int f(void) { static int hits = 0, misses; static void (*cb)(int); int plain = 1; for (int i = 0; i < 3; i++) { static char deep[4]; } return plain == 1; }
'''
    files = spark.createDataFrame([("a.c", text)], "path string, text string")
    top = [(r["name"], r["type"], r["array"], r["init"], r["is_static"], r["is_extern"]) for r in flow.declarations(flow.statements(files)).filter("depth = 0").orderBy("ordinal", "item").collect()]
    assert top == [
        ("a", "const unsigned int", "", "3", True, False), ("b", "const unsigned int *", "", None, True, False), ("c", "const unsigned int", "[2][3]", "{ {1, 2}, {3} }", True, False),
        ("shared", "int", "", None, False, True), ("handler", "void", "", "0", False, False), ("text", "char *", "", '""', False, False),
    ]
    assert [(r["name"], r["returns"], r["parameters"], r["is_extern"]) for r in flow.prototypes(files).orderBy("ordinal").collect()] == [("proto", "int", "int (*cb)(int), char *s", False), ("far_away", "void *", "void", True)]
    local = flow.static_locals(code.functions(files)).orderBy("ordinal", "name").collect()
    assert [(r["function"], r["name"], r["type"], r["init"]) for r in local] == [("f", "hits", "int", "0"), ("f", "misses", "int", None), ("f", "cb", "void", None), ("f", "deep", "char", None)]


def test_parts_take_a_step_a_sign(spark):
    text = "a<b, 𝄞c>, (é,\n[1, 2]] , )x,, y - \\^z, {p, q}"
    rows = spark.range(1).selectExpr(f"'{text}' as t".replace("\\", "\\\\"))
    for brackets in ("()[]<>{}", "()", "<>{}"):
        want, part, depth = [], "", dict.fromkeys(brackets[::2], 0)
        for c in text:
            if c == "," and not any(depth.values()):
                want, part = [*want, part.strip(" ")], ""
                continue
            part += c
            for a, b in zip(brackets[::2], brackets[1::2], strict=True):
                depth[a] = max(0, depth[a] + (c == a) - (c == b))
        assert rows.select(flow.top_level_parts("t", brackets=brackets)).first()[0] == [p for p in [*want, part.strip(" ")] if p]
    # No list of all places of a text is made, and a text without a separator is not walked at all.
    assert "sequence(" not in rows.select(flow.top_level_parts("t"))._jdf.queryExecution().toString()
