"""Test rows generated from variables, conditions and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import _col, _first_class

#: Name patterns that tell a C type, in the order they are tried.
TYPE_PATTERNS = [
    (r"\bu8[gs]?_|uint8|U8|BYTE", "uint8_t"),
    (r"\bu16[gs]?_|uint16|U16|WORD", "uint16_t"),
    (r"\bu32[gs]?_|uint32|U32|DWORD", "uint32_t"),
    (r"\bs8[gs]?_|int8[^_]|S8", "int8_t"),
    (r"\bs16[gs]?_|int16|S16", "int16_t"),
    (r"\bs32[gs]?_|int32|S32", "int32_t"),
    (r"\bBits\.|_F\b|_Flag|_Sta\b|_Enable|_Disable", "bit"),
    (r"\bf32|float|FLOAT", "float"),
    (r"\bbool\b|BOOL|boolean", "bool"),
]
#: Fixed values: (min_inv, min, mid, max, max_inv) of each type.
UNIT_BOUNDS = {
    "uint8_t": (-1, 0, 127, 255, 256),
    "uint16_t": (-1, 0, 32767, 65535, 65536),
    "uint32_t": (-1, 0, 2**15, 2**32 - 1, 2**32),
    "int8_t": (-129, -128, 0, 127, 128),
    "int16_t": (-32769, -32768, 0, 32767, 32768),
    "int32_t": (-(2**31) - 1, -(2**31), 0, 2**31 - 1, 2**31),
    "float": (-1001.0, -1000.0, 0.0, 1000.0, 1001.0),
    "bool": (-1, 0, 0, 1, 2),
    "bit": (-1, 0, 0, 1, 2),
}
#: Words in a float's name that narrow its bounds.
FLOAT_BOUNDS = [
    ("voltage|volt|_v_|_vbat|_vcc", (-1.0, 0.0, 12.0, 60.0, 61.0)),
    ("temperature|temp|_temp|_t_", (-41.0, -40.0, 25.0, 150.0, 151.0)),
    ("speed|_spd|velocity|_vel", (-1.0, 0.0, 60.0, 300.0, 301.0)),
    ("pressure|_pres|_press", (-0.1, 0.0, 2.5, 10.0, 10.1)),
    ("current|_cur|_amp", (-0.1, 0.0, 5.0, 50.0, 51.0)),
    ("angle|_ang|degree|_deg", (-1.0, 0.0, 90.0, 360.0, 361.0)),
    ("percent|_pct|ratio|_ratio", (-1.0, 0.0, 50.0, 100.0, 101.0)),
]
#: Seven boundary values of each type for integration cases.
FLOW_BOUNDS = {
    "uint8": (-1, 0, 63, 127, 191, 255, 256),
    "uint16": (-1, 0, 16383, 32767, 49151, 65535, 65536),
    "uint32": (-1, 0, 0x3FFFFFFF, 0x7FFFFFFF, 0xBFFFFFFF, 0xFFFFFFFF, 0x100000000),
    "int8": (-129, -128, -64, 0, 63, 127, 128),
    "int16": (-32769, -32768, -16384, 0, 16383, 32767, 32768),
    "int32": (-2147483649, -2147483648, -1073741824, 0, 1073741823, 2147483647, 2147483648),
    "float": (-1.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.001),
    "bool": (-1, 0, 0, 0, 1, 1, 2),
}
STRATEGIES = ["BV_MIN_INV", "BV_MIN", "BV_MID", "BV_MAX", "BV_MAX_INV", "MIXED"]


def variable_type(name: Column | str) -> Column:
    """C type that a variable's name tells; uint8_t where it tells none."""
    return _first_class([(t, _col(name).rlike(f"(?i){p}")) for p, t in TYPE_PATTERNS], "uint8_t")


def unit_bounds(name: Column | str, kind: Column | str) -> Column:
    """The five boundary values as doubles."""
    as_array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    chain = F
    for words, values in FLOAT_BOUNDS:
        chain = chain.when((_col(kind) == "float") & F.lower(_col(name)).rlike(words), as_array(values))
    for t, values in UNIT_BOUNDS.items():
        chain = chain.when(_col(kind) == t, as_array(values))
    return chain.otherwise(as_array(UNIT_BOUNDS["uint8_t"]))


def boundary_rows(variables: DataFrame) -> DataFrame:
    """Six rows for each input variable (unit, ordinal from 0, name): unit, seq, strategy, name, value.

    MIXED takes the least valid value for even and the largest for odd ordinals.
    """
    kind = variable_type("name")
    bounds = unit_bounds("name", kind)
    rows = variables.select("unit", "ordinal", "name", bounds.alias("b"), F.posexplode(F.array(*[F.lit(s) for s in STRATEGIES])).alias("k", "strategy"))
    mixed = F.when(F.col("ordinal") % 2 == 0, F.get("b", F.lit(1))).otherwise(F.get("b", F.lit(3)))
    return rows.select("unit", (F.col("k") + 1).alias("seq"), "strategy", "name", F.when(F.col("strategy") == "MIXED", mixed).otherwise(F.get("b", F.col("k"))).alias("value"))


#: Runs of units without inputs and outputs, and what they say; {} takes the unit, then the calls or the guard.
VOID_RUNS = {
    "NORMAL_CALL": ("{}() 정상 호출:", " 하위 함수 [{}] 순차 호출 확인", " 예외 없이 완료되며 호출 후 상태 이상 없음"),
    "ERROR_PATH": ("{}() 에러 경로: ", "조건 [{}] 위반 상태에서 호출, 에러 처리 루틴 진입 또는 안전 상태 유지 확인", "의존 모듈/전역 변수 비정상 상태에서 호출, 에러 처리 루틴 진입 또는 안전 상태 유지 확인"),
    "REPEAT_CALL": ("{}() 반복 호출 안정성: 100회 연속 호출 후 메모리 누수 없음, 시스템 상태 일관성 유지", "", ""),
    "RETURN_CHECK": ("{}() 반환값 검증: 반환값이 정의된 범위 내 유효한 값임을 확인", "", ""),
}


def void_rows(units: DataFrame, indirect: DataFrame, most: int = 4) -> DataFrame:
    """Runs of units (unit, returns, calls, guard) that have neither inputs nor outputs: unit, seq, strategy, description, name, value, expected.

    A normal call, one on the error path (beyond the guard where there is one), a repeated one, and where
    something is returned a check of that. The first `most` variables that callees reach (unit, ordinal,
    name) are set to the middle for the normal call, and over their largest value, which they are held at,
    for the error path; other runs, and units without such variables, have a row with a null name.
    """
    say = lambda text, value: F.concat(F.lit(text.partition("{}")[0]), value, F.lit(text.partition("{}")[2]))
    calls = F.coalesce("calls", F.array().cast("array<string>"))
    named = F.concat(F.array_join(F.transform(F.slice(calls, 1, 5), lambda c: F.concat(c, F.lit("()"))), ", "), F.when(F.size(calls) > 5, F.concat(F.lit(" 외 "), (F.size(calls) - 5).cast("string"), F.lit("개"))).otherwise(""))
    guard = F.when(F.col("guard").rlike("[<>]|==|!=|NULL|null"), F.substring("guard", 1, 80))
    more = {"NORMAL_CALL": (F.size(calls) > 0, named), "ERROR_PATH": (guard.isNotNull(), guard)}
    runs = []
    for i, (strategy, (start, some, none)) in enumerate(VOID_RUNS.items()):
        held, value = more.get(strategy, (F.lit(False), F.lit("")))
        runs.append(F.struct(F.lit(i + 1).alias("seq"), F.lit(strategy).alias("strategy"), F.concat(say(start, F.col("unit")), F.when(held, say(some, value)).otherwise(F.lit(none))).alias("description")))
    kept = F.when(F.lower(F.trim("returns")).rlike("void") | (F.trim("returns") == ""), F.array(*runs[:3])).otherwise(F.array(*runs))
    each = units.select("unit", F.inline(kept))
    bounds = indirect.filter(F.col("ordinal") < most).select("unit", "name", unit_bounds("name", variable_type("name")).alias("b"))
    both = F.array(*[F.struct(F.lit(s).alias("strategy"), F.get("b", F.lit(v)).alias("value"), F.get("b", F.lit(e)).alias("expected")) for s, v, e in (("NORMAL_CALL", 2, 2), ("ERROR_PATH", 4, 3))])
    values = bounds.select("unit", "name", F.inline(both))
    return each.join(values, ["unit", "strategy"], "left").select("unit", "seq", "strategy", "description", "name", "value", "expected")


def condition_rows(variables: DataFrame, most: int = 4) -> DataFrame:
    """One row set for each of the first `most` inputs at its least value, the others at the middle: unit, strategy, name, value."""
    bounds = unit_bounds("name", variable_type("name"))
    v = variables.select("unit", "ordinal", "name", bounds.alias("b"))
    targets = v.select("unit", F.col("ordinal").alias("target")).filter(F.col("target") < most)
    joined = v.join(targets, "unit")
    return joined.select("unit", F.concat(F.lit("COND_COMB_"), F.col("target").cast("string")).alias("strategy"), "name", F.when(F.col("ordinal") == F.col("target"), F.get("b", F.lit(1))).otherwise(F.get("b", F.lit(2))).alias("value"))


def flow_rows(flows: DataFrame) -> DataFrame:
    """Seven boundary rows for each flow variable (flow, name, kind): flow, name, sub (1 to 7), value, expected.

    Values outside the valid range expect the nearest end; the upper one expects the middle value, as
    the reports that these rows feed have it.
    """
    chain = F
    for t, values in FLOW_BOUNDS.items():
        chain = chain.when(F.col("kind") == t, F.array(*[F.lit(float(v)) for v in values]))
    bounds = chain.otherwise(F.array(*[F.lit(float(v)) for v in FLOW_BOUNDS["uint8"]]))
    rows = flows.select("flow", "name", bounds.alias("b"), F.posexplode(bounds).alias("k", "value"))
    expected = F.when(F.col("k") == 0, F.get("b", F.lit(1))).when(F.col("k") == 6, F.get("b", F.lit(3))).otherwise(F.col("value"))
    return rows.select("flow", "name", (F.col("k") + 1).alias("sub"), "value", expected.alias("expected"))


def conditions(flow: DataFrame) -> DataFrame:
    """Conditions (unit, condition) as unit, name, op, threshold where they compare a name with a number or constant."""
    pattern = r"([A-Za-z_][\w.\[\]>-]*?)\s*(==|!=|<=|>=|<|>)\s*(-?\w+)"
    get = lambda k: F.regexp_extract("condition", pattern, k)
    return flow.select("unit", get(1).alias("name"), get(2).alias("op"), get(3).alias("threshold")).filter("name <> ''")


def condition_cases(flow: DataFrame) -> DataFrame:
    """Two values for each numeric condition: one that makes it true and one that makes it false."""
    c = conditions(flow).withColumn("t", F.col("threshold").try_cast("long")).filter("t is not null")
    true = F.when(F.col("op").isin("==", "<=", ">="), F.col("t")).when(F.col("op").isin("!=", ">"), F.col("t") + 1).otherwise(F.col("t") - 1)
    false = F.when(F.col("op").isin("==", "<="), F.col("t") + 1).when(F.col("op") == ">=", F.col("t") - 1).otherwise(F.col("t"))
    return c.select("unit", "name", "op", "threshold", true.alias("true_value"), false.alias("false_value"))


def generation_method(inputs: Column, has_conditions: Column) -> Column:
    """How a unit's tests are made, from its number of inputs and whether it has conditions."""
    return F.when(has_conditions & (inputs > 0), F.lit("AEC, ABV")).when(inputs > 2, F.lit("ABV, AOR")).when(inputs > 0, F.lit("ABV")).otherwise(F.lit("AOR"))


def test_method(inputs: Column, has_conditions: Column, has_loops: Column) -> Column:
    """How a unit is tested: FNCT with control flow, FIT with inputs, else RVW."""
    return F.when(has_conditions | has_loops, F.lit("FNCT")).when(inputs > 0, F.lit("FIT")).otherwise(F.lit("RVW"))


def incidence(cases: DataFrame, case: str, requirement: str) -> DataFrame:
    """Pairs of test case and requirement as 1, each once; long form of the 0/1 matrix."""
    return cases.select(case, requirement).distinct().withColumn("linked", F.lit(1))


def requirement_coverage(requirements: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """One row: total, covered, pct of requirements with a test case."""
    have = requirements.select(key).distinct()
    hit = have.join(cases.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    out = hit.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered"))
    return out.withColumn("pct", F.when(F.col("total") > 0, F.bround(100.0 * F.col("covered") / F.col("total"), 1)).otherwise(F.lit(0.0)))


#: Seed values of a parameter by its kind.
SEEDS = {"pointer": ["NULL", "valid"], "float": ["0.0", "1.0", "-1.0"], "bool": ["true", "false"], "int": ["0", "1", "-1", "max", "min"]}


def signature_cases(parameters: DataFrame, most: int) -> DataFrame:
    """Seed values of each parameter (function, ordinal, name, type), at most `most` rows a function: function, name, value."""
    kind = _first_class([("pointer", F.col("type").contains("*")), ("float", F.lower("type").rlike("float|double")), ("bool", F.lower("type").contains("bool"))], "int")
    chain = F
    for k, values in SEEDS.items():
        chain = chain.when(kind == k, F.array(*[F.lit(v) for v in values]))
    rows = parameters.select("function", "ordinal", "name", F.posexplode(chain.otherwise(F.array().cast("array<string>"))).alias("k", "value"))
    from pyspark.sql import Window

    w = Window.partitionBy("function").orderBy("ordinal", "k")
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("function", "name", "value", "n")


def loop_rows(units: DataFrame) -> DataFrame:
    """Three rows for each unit with a loop variable (unit, name): 0, 1 and the largest value."""
    bounds = unit_bounds("name", variable_type("name"))
    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), v.alias("value")) for s, v in (("LOOP_ZERO", F.lit(0.0)), ("LOOP_ONE", F.lit(1.0)), ("LOOP_MAX", F.get(bounds, F.lit(3))))])
    return units.select("unit", "name", F.inline(rows))


def switch_rows(cases: DataFrame, most: int = 6) -> DataFrame:
    """One row for each of the first switch cases of a unit (unit, ordinal, name, value)."""
    return cases.filter(F.col("ordinal") < most).select("unit", F.concat(F.lit("SWITCH_"), F.col("ordinal").cast("string")).alias("strategy"), "name", "value")


def global_rows(variables: DataFrame, most: int = 3) -> DataFrame:
    """One row for each of the first globals of a unit (unit, ordinal, name) at its least value."""
    bounds = unit_bounds("name", variable_type("name"))
    return variables.filter(F.col("ordinal") < most).select("unit", F.concat(F.lit("GLOBAL_"), F.col("ordinal").cast("string")).alias("strategy"), "name", F.get(bounds, F.lit(1)).alias("value"))


def toggled_conditions(flow: DataFrame, most: int = 6) -> DataFrame:
    """A base row with every condition true, and one for each of the first conditions made false: unit, strategy, name, value."""
    from pyspark.sql import Window

    cases = condition_cases(flow).dropDuplicates(["unit", "name", "op", "threshold"])
    placed = cases.withColumn("k", F.row_number().over(Window.partitionBy("unit").orderBy("name", "op", "threshold")) - 1)
    base = placed.select("unit", F.lit("MCDC_BASE").alias("strategy"), "name", F.col("true_value").alias("value"))
    each = placed.filter(F.col("k") < most).select("unit", F.concat(F.lit("MCDC_"), F.col("k").cast("string")).alias("strategy"), "name", F.col("false_value").alias("value"))
    return base.unionByName(each)


def sequences(parts: list[DataFrame], most: int) -> DataFrame:
    """Strategies' rows (unit, strategy, name, value) in the order of the list, the first `most` strategies of a unit numbered by seq."""
    from pyspark.sql import Window

    both = None
    for k, part in enumerate(parts):
        rows = part.select(F.lit(k).alias("part"), "unit", "strategy", "name", F.col("value").cast("double").alias("value"))
        both = rows if both is None else both.unionByName(rows)
    seq = F.dense_rank().over(Window.partitionBy("unit").orderBy("part", "strategy"))
    return both.withColumn("seq", seq).filter(F.col("seq") <= most).drop("part")


def test_cases(requirements: DataFrame, functions: DataFrame, flow: DataFrame, most: int = 5) -> DataFrame:
    """Test cases of requirements over their functions' branches: req_id, testcase, function, step.

    `functions` is (req_id, function), `flow` has the control statements (function, ordinal, type,
    condition). A case is made for each branch in order, `most` for a requirement, and one review
    case where a requirement has no branch. Ids read SwTC_<id>_<nn>.
    """
    from pyspark.sql import Window

    branches = functions.join(flow.filter(F.col("type").isin("if", "switch", "loop")), "function")
    step = F.concat(F.lit("Check "), F.col("type"), F.lit(" ["), F.col("condition"), F.lit("] of "), F.col("function"))
    w = Window.partitionBy("req_id").orderBy("function", "ordinal")
    cases = branches.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("req_id", "k", "function", step.alias("step"))
    review = requirements.select("req_id").distinct().join(cases, "req_id", "left_anti").select("req_id", F.lit(1).alias("k"), F.lit(None).cast("string").alias("function"), F.lit("Review the requirement").alias("step"))
    both = cases.unionByName(review)
    return both.select("req_id", F.concat(F.lit("SwTC_"), F.regexp_replace("req_id", "^Sw", ""), F.lit("_"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("testcase"), "function", "step")


def case_quality(cases: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row: test cases, requirements with one, mean cases a requirement (one decimal) and coverage percent."""
    per = requirements.select("req_id").distinct().join(cases.groupBy("req_id").agg(F.count_distinct("testcase").alias("n")), "req_id", "left")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.count("n").alias("covered"), F.bround(F.avg(F.coalesce("n", F.lit(0))), 1).alias("mean_cases"), F.bround(100.0 * F.count("n") / F.count(F.lit(1)), 1).alias("coverage_pct"))


def structure_issues(rows: DataFrame, sheets: list[str], expected: dict[str, tuple[int, int]]) -> DataFrame:
    """Issues of a workbook's cells (sheet, row, col, value): sheets that are missing, and sheets whose number of rows is outside its range."""
    spark = rows.sparkSession
    counted = rows.groupBy("sheet").agg(F.count_distinct("row").alias("n"))
    wanted = spark.createDataFrame([(s, *map(float, expected.get(s, (0, float("inf"))))) for s in sheets], "sheet string, least double, most double")
    issue = F.when(F.col("n").isNull(), F.lit("missing")).when(F.col("n") < F.col("least"), F.lit("too_few")).when(F.col("n") > F.col("most"), F.lit("too_many"))
    return wanted.join(counted, "sheet", "left").select("sheet", issue.alias("issue")).filter("issue is not null")
