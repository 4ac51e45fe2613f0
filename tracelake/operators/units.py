"""Units and integration flows under test: roles of their variables, sub-cases, and checks of generated sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.generate import FLOW_BOUNDS

#: Words that are types and no names, and patterns of temporaries.
TYPE_NAMES = [
    "U8", "U16", "U32", "S8", "S16", "S32", "uint8_t", "uint16_t", "uint32_t", "int8_t", "int16_t", "int32_t", "BOOL", "void", "char", "int", "float", "double", "long", "unsigned", "signed", "short", "const", "volatile", "static",
]
TEMPORARY = r"(?i)^(u8t_|u16t_|u32t_|s8t_|s16t_|s32t_|sf_t|tmpVal|temp_|tmp_|loop_|idx_|cnt_|i$|j$|k$|n$)"
#: Prefixes of variables that a unit reads or writes, and registers, which are both.
READ_PREFIX, WRITE_PREFIX, REGISTER = r"^(u8g_|u16g_|u32g_|s16g_|s8g_|s32g_)", r"^(u8s_|u16s_|u32s_|s16s_|s32s_)", r"^REG_|^lin_|^PS\.|^DiagData\."
#: Labels of the seven boundary values as classes, and of the runs of flows without inputs.
CLASS_LABELS = ["EC1:무효-하한", "EC2:유효-하한", "EC3:유효-정상-L", "EC4:유효-중간", "EC5:유효-정상-H", "EC6:유효-상한", "EC7:무효-상한"]
SCENARIOS = ["Normal operation", "Boundary condition", "Error / fault injection", "Post-initialization state", "Concurrent invocation", "Recovery sequence", "Stress / extended run"]


def variable_roles(entries: DataFrame) -> DataFrame:
    """function, ordinal, name, reads, writes, indirect of the globals that functions list (function, ordinal, kind, entry).

    `kind` is global or static. A tag decides ([IN], READ, RHS; [OUT], WRITE, LHS); without one the name:
    written prefixes, read prefixes, registers and g_ or r_ names (both), else statics are written and
    globals read. What is only reached through a callee ([INDIRECT]) is never read. Temporaries, type
    names, names of one or two characters and what starts with no letter are left out.
    """
    tag = F.upper("entry")
    bare = F.regexp_replace(F.regexp_replace(F.trim("entry"), r"^\[INDIRECT2?\]\s*", ""), r"^\[(?:IN|OUT|INOUT)\]\s*", "")
    name = F.regexp_replace(F.element_at(F.split(bare, r"\s+"), -1), r"^[*&;,]+|[*&;,]+$", "")
    rows = entries.select("function", "ordinal", "kind", tag.alias("tag"), name.alias("name"), tag.contains("[INDIRECT").alias("indirect"))
    rows = rows.filter((F.length("name") > 2) & F.col("name").rlike("^[A-Za-z_]") & ~F.col("name").isin(TYPE_NAMES) & ~F.col("name").rlike(TEMPORARY))
    named = lambda p: F.col("name").rlike(p)
    told_in, told_out = F.col("tag").rlike(r"\[IN\]|READ|RHS"), F.col("tag").rlike(r"\[OUT\]|WRITE|LHS")
    both = named(REGISTER) | named("^(g_|r_)")
    guess_in = F.when(named(WRITE_PREFIX), False).when(named(READ_PREFIX) | both, ~F.col("indirect")).otherwise((F.col("kind") == "global") & ~F.col("indirect"))
    guess_out = F.when(named(WRITE_PREFIX), True).when(named(READ_PREFIX), False).when(both, True).otherwise(F.col("kind") != "global")
    told = told_in | told_out
    each = rows.select("function", "ordinal", "name", "indirect", F.when(told, told_in).otherwise(guess_in).alias("reads"), F.when(told, told_out).otherwise(guess_out).alias("writes"))
    return each.groupBy("function", "name").agg(F.min("ordinal").alias("ordinal"), F.bool_or("reads").alias("reads"), F.bool_or("writes").alias("writes"), F.bool_or("indirect").alias("indirect"))


def unit_variables(units: DataFrame, parameters: DataFrame, entries: DataFrame, most: int | None = None, most_indirect: int = 5) -> DataFrame:
    """function, side (input, output, indirect), place, name of the variables of units (function, returns).

    Parameters (function, ordinal, name, direction) come first, then globals in their order, each name
    once a side; INOUT ones stand on both sides. A unit that writes nothing but returns something has the
    output return_<name>. Indirect variables are those on neither side, the first `most_indirect`.
    """
    side = lambda s, df, order: df.select("function", F.lit(s).alias("side"), order.alias("order"), "name")
    given = parameters.select("function", F.struct(F.lit(0).alias("part"), F.col("ordinal").cast("int").alias("ordinal")).alias("at"), "name", "direction")
    roles = variable_roles(entries).select("function", F.struct(F.lit(1).alias("part"), F.col("ordinal").cast("int").alias("ordinal")).alias("at"), "name", "reads", "writes", "indirect")
    both = side("input", given.filter("direction in ('IN', 'INOUT')"), F.col("at")).unionByName(side("output", given.filter("direction in ('OUT', 'INOUT')"), F.col("at")))
    both = both.unionByName(side("input", roles.filter("reads"), F.col("at"))).unionByName(side("output", roles.filter("writes"), F.col("at")))
    once = both.groupBy("function", "side", "name").agg(F.min("order").alias("order"))
    none = units.join(once.filter("side = 'output'").select("function").distinct(), "function", "left_anti").filter("lower(trim(returns)) <> 'void' and trim(returns) <> ''")
    result = none.select("function", F.lit("output").alias("side"), F.concat(F.lit("return_"), F.col("function")).alias("name"), F.struct(F.lit(2).alias("part"), F.lit(0).alias("ordinal")).alias("order"))
    far = roles.filter("indirect").join(once.select("function", "name").distinct(), ["function", "name"], "left_anti").select("function", F.lit("indirect").alias("side"), "name", F.col("at").alias("order"))
    place = F.row_number().over(Window.partitionBy("function", "side").orderBy("order", "name"))
    out = once.unionByName(result).unionByName(far).withColumn("place", place).filter((F.col("side") != "indirect") | (F.col("place") <= most_indirect))
    return (out.filter(F.col("place") <= most) if most else out).select("function", "side", "place", "name")


def _bounds(kind: Column) -> Column:
    chain = F
    for t, values in FLOW_BOUNDS.items():
        chain = chain.when(kind == t, F.array(*[F.lit(float(v)) for v in values]))
    return chain.otherwise(F.array(*[F.lit(float(v)) for v in FLOW_BOUNDS["uint8"]]))


def integration_cases(flows: DataFrame, variables: DataFrame, most: int = 15, environments: list[str] | None = None, classes: bool = False) -> DataFrame:
    """flow, case_num, case_label, precondition, side (input, expected), name, value of integration flows (flow).

    `variables` is (flow, side, ordinal from 0, name, kind) with sides input, expected and global. The
    first seven cases set all inputs to one boundary after the other; then come cases that set one of the
    first four inputs to an end and the others to the middle, two that drive all inputs out of range, and
    one for each of the first two globals at its least value. A flow without inputs runs its scenarios.
    At most `most` cases a flow. Preconditions go round the environments, where there are any.
    """
    v = variables.select("flow", "side", "ordinal", "name", _bounds(F.col("kind")).alias("b"))
    at = lambda k: F.get("b", k if isinstance(k, Column) else F.lit(k))
    inputs = v.filter("side = 'input'")
    width = inputs.groupBy("flow").agg(F.count(F.lit(1)).alias("inputs"))
    sized = flows.select("flow").distinct().join(width, "flow", "left")
    globals_ = v.filter("side = 'global' and ordinal < 2")
    turn = F.element_at(F.array(*[F.lit(e) for e in environments]), (F.col("k") % len(environments) + 1).cast("int")) if environments else (F.col("k") + 1).cast("string")
    label = F.concat((F.col("k") + 1).cast("string"), F.lit(" ["), F.element_at(F.array(*[F.lit(c) for c in CLASS_LABELS]), (F.col("k") + 1).cast("int")), F.lit("]")) if classes else (F.col("k") + 1).cast("string")
    columns = ["flow", "case_num", "case_label", "precondition", "side", "name", "value"]
    some = sized.filter("inputs is not null")

    # Boundaries: the first and the last case expect the nearest valid and the middle value.
    n = min(most, 7)
    plain = v.filter("side <> 'global'").join(some.select("flow"), "flow", "left_semi").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = F.when(F.col("side") == "input", at(F.col("k"))).when(F.col("k") == 0, at(1)).when(F.col("k") == n - 1, at(3)).otherwise(at(F.col("k")))
    out = plain.select("flow", (F.col("k") + 1).alias("case_num"), label.alias("case_label"), turn.alias("precondition"), "side", "name", value.cast("string").alias("value"))

    if most > 7:
        # What comes after, in order: part 0 conditions, 1 errors, 2 globals.
        first = inputs.filter("ordinal < 4").select("flow", F.col("ordinal").alias("t"), F.col("name").alias("toggled"))
        low = F.col("t") % 2 == 0
        end = F.when(low, F.lit("최솟값")).otherwise(F.lit("최댓값"))
        toggles = first.join(some.filter("inputs >= 2").select("flow"), "flow", "left_semi").select("flow", F.lit(0).alias("part"), "t", F.concat(F.lit("COND_"), (F.col("t") + 1).cast("string"), F.lit(" ["), F.col("toggled"), F.lit("="), end, F.lit("]")).alias("case_label"), F.concat(F.lit("조건 조합: "), F.col("toggled"), F.lit("="), end, F.lit(", 나머지=중간값")).alias("precondition"), F.lit(None).cast("string").alias("held"))
        beyond = F.when(F.col("t") == 0, F.lit("하한 초과")).otherwise(F.lit("상한 초과"))
        errors = some.select("flow", F.explode(F.array(F.lit(0), F.lit(1))).alias("t")).select("flow", F.lit(1).alias("part"), "t", F.concat(F.lit("ERR_PROP_"), (F.col("t") + 1).cast("string"), F.lit(" ["), beyond, F.lit("]")).alias("case_label"), F.concat(F.lit("에러 전파: 입력 "), beyond, F.lit(" → 콜체인 방어 처리 확인")).alias("precondition"), F.lit(None).cast("string").alias("held"))
        states = globals_.join(some.select("flow"), "flow", "left_semi").select("flow", F.lit(2).alias("part"), F.col("ordinal").alias("t"), F.concat(F.lit("GLOBAL_"), (F.col("ordinal") + 1).cast("string"), F.lit(" ["), F.col("name"), F.lit("=min]")).alias("case_label"), F.concat(F.lit("글로벌 상태: "), F.col("name"), F.lit("=최솟값, 입력=중간값 → 상태 의존 분기 커버")).alias("precondition"), F.col("name").alias("held"))
        more = toggles.unionByName(errors).unionByName(states).withColumn("case_num", F.row_number().over(Window.partitionBy("flow").orderBy("part", "t")) + 7).filter(F.col("case_num") <= most)
        met = more.join(v.filter("side <> 'global'"), "flow")
        conditions = F.when(F.col("side") == "expected", at(3)).when(F.col("ordinal") != F.col("t"), at(3)).when(low, at(1)).otherwise(at(5))
        driven = F.when(F.col("side") == "input", F.when(F.col("t") == 0, at(0)).otherwise(at(6))).when(F.col("t") == 0, at(1)).otherwise(at(5))
        out = out.unionByName(met.select("flow", "case_num", "case_label", "precondition", "side", "name", F.when(F.col("part") == 0, conditions).when(F.col("part") == 1, driven).otherwise(at(3)).cast("string").alias("value")))
        own = more.filter("part = 2").join(globals_.select("flow", F.col("name").alias("held"), "name", "b"), ["flow", "held"])
        out = out.unionByName(own.select("flow", "case_num", "case_label", "precondition", F.explode(F.array(F.lit("input"), F.lit("expected"))).alias("side"), "name", at(1).cast("string").alias("value")))

    bare = sized.filter("inputs is null").select("flow", F.posexplode(F.array(*[F.lit(s) for s in SCENARIOS[: min(most, len(SCENARIOS)) if most > 1 else 1]])).alias("k", "scenario"))
    wanted = v.filter("side = 'expected' and ordinal < 5").select("flow", "name")
    head = bare.select("flow", (F.col("k") + 1).alias("case_num"), label.alias("case_label"), turn.alias("precondition"), "scenario")
    out = out.unionByName(head.select("flow", "case_num", "case_label", "precondition", F.lit("input").alias("side"), F.lit("Scenario").alias("name"), F.col("scenario").alias("value")))
    result = head.join(wanted, "flow", "left").select("flow", "case_num", "case_label", "precondition", F.lit("expected").alias("side"), F.coalesce("name", F.lit("Result")).alias("name"), F.lit("N/A").alias("value"))
    return out.unionByName(result).select(*columns)


def case_checks(cases: DataFrame, keys: list[str], empty: dict[str, tuple[Column, float, str]], ranges: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """keys, level (issue, warning), check, n, total of what generated cases lack.

    `empty` names checks: (column that says a case lacks it, the share that may, the level). A group
    without cases has the issue `cases`; where no case of a group is linked (`linked` among the columns),
    that is a warning. `ranges` bounds the number of cases (`cases`) and of any summed column.
    """
    counts = [F.count_if(F.coalesce(c, F.lit(True))).alias(f"n_{name}") for name, (c, _, _) in empty.items()]
    sums = [F.sum(c).alias(f"sum_{c}") for c in (ranges or {}) if c != "cases"]
    linked = [F.count_if("linked").alias("n_linked")] if "linked" in cases.columns else []
    per = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts, *sums, *linked)
    row = lambda when, level, check, n: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(check).alias("check"), n.cast("long").alias("n"), F.col("total").cast("long").alias("total")))
    found = [row(F.col(f"n_{name}") > F.col("total") * share, level, name, F.col(f"n_{name}")) for name, (_, share, level) in empty.items()]
    for c, (low, high) in (ranges or {}).items():
        n = F.col("total") if c == "cases" else F.col(f"sum_{c}")
        found.append(row((n < low) | (n > high), "issue", f"{c} range", n))
    if linked:
        found.append(row(F.col("n_linked") == 0, "warning", "linked", F.col("n_linked")))
    return per.select(*keys, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def sheet_issues(sheets: DataFrame, wanted: list[str], optional: list[str]) -> DataFrame:
    """book, level, sheet of sheets that books (book, sheet) lack: an issue where wanted, a warning where optional."""
    spark = sheets.sparkSession
    asked = spark.createDataFrame([(s, "issue") for s in wanted] + [(s, "warning") for s in optional], "sheet string, level string")
    books = sheets.select("book").distinct()
    # As many rows a book as sheets are asked for.
    each = books.select("book", F.explode(F.array(*[F.lit(s) for s in [*wanted, *optional]])).alias("sheet"))
    return each.join(sheets.select("book", "sheet").distinct(), ["book", "sheet"], "left_anti").join(F.broadcast(asked), "sheet").select("book", "level", "sheet")
