"""Change records: diff classification, decisions, risk and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import numbers

TARGETS = ["uds", "suts", "sits", "sts", "sds"]
#: What a kind of change asks of each document.
DECISIONS = {
    "SIGNATURE": ["AUTO", "AUTO", "AUTO", "FLAG", "FLAG"],
    "NEW": ["AUTO", "AUTO", "AUTO", "FLAG", "FLAG"],
    "DELETE": ["AUTO", "AUTO", "AUTO", "FLAG", "FLAG"],
    "BODY": ["AUTO", "AUTO", "AUTO", "FLAG", "-"],
    "VARIABLE": ["AUTO", "AUTO", "AUTO", "FLAG", "-"],
    "HEADER": ["AUTO", "FLAG", "FLAG", "FLAG", "FLAG"],
}
STRONG = ["NEW", "DELETE", "SIGNATURE", "HEADER"]
#: Type words that begin a C declaration.
TYPE_WORDS = r"(?:void|int|uint\d+_t|int\d+_t|U\d+|S\d+|bool|float|double|char|unsigned|signed|CONSTP2VAR|P2FUNC)"


def classify_diffs(diffs: DataFrame) -> DataFrame:
    """function, kind from unified diffs (file, diff): NEW, DELETE, SIGNATURE, BODY, VARIABLE or HEADER.

    A function is named by a hunk header or by a changed declaration. Over the files in order of
    their names, the first strong kind (NEW, DELETE, SIGNATURE, HEADER) stays, else the last.
    """
    body = F.coalesce(F.col("diff"), F.lit(""))
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(body, F.lit(f"(?m){pattern}"), F.lit(1)))
    declared = found(rf"^[+-]\s*(?:static\s+)?{TYPE_WORDS}[\w\s\*]*\s+(\w+)\s*\(")
    prototypes = found(rf"^[+-]\s*(?:(?:extern|static|inline|volatile|const)\s+)*(?:{TYPE_WORDS}|FUNC)[\w\s\*\(\),]*?\b([A-Za-z_]\w*)\s*\([^;{{}}]*\)\s*;")
    variable = body.rlike(r"(?m)^[+-]\s*(?:static\s+)?(?:const\s+|volatile\s+|unsigned\s+|signed\s+)*(?:void|char|bool|float|double|int|long|short|u?int\d+(?:_t)?|U\d+|S\d+|[A-Za-z_]\w*_t)\b(?!.*\().*?\b[A-Za-z0-9_]+\b\s*(?:\[.*\])?\s*(?:=|;|,)")
    header = F.col("file").endswith(".h")
    rows = diffs.select("file", header.alias("header"), variable.alias("variable"), declared.alias("declared"), found(r"^\+\s*.*?\b(\w+)\s*\(").alias("added"), found(r"^-\s*.*?\b(\w+)\s*\(").alias("removed"), F.array_union(found(r"^@@.*@@\s*(?:.*?\s)?(\w+)\s*\("), F.array_union(declared, F.when(header, prototypes).otherwise(F.array().cast("array<string>")))).alias("names"))
    each = rows.withColumn("function", F.explode("names"))
    has = lambda c: F.array_contains(c, F.col("function"))
    kind = (
        F.when(F.col("header"), F.lit("HEADER"))
        .when(has("added") & has("removed") & has("declared"), F.lit("SIGNATURE"))
        .when(has("added") & has("declared"), F.lit("NEW"))
        .when(has("removed") & has("declared"), F.lit("DELETE"))
        .when(F.col("variable"), F.lit("VARIABLE"))
        .otherwise(F.lit("BODY"))
    )
    kinds = each.select("function", "file", kind.alias("kind"))
    strong = F.col("kind").isin(STRONG)
    out = kinds.groupBy("function").agg(F.min_by("kind", F.when(strong, F.col("file"))).alias("first_strong"), F.max_by("kind", "file").alias("last"))
    return out.select("function", F.coalesce("first_strong", "last").alias("kind"))


def fallback_kinds(files: DataFrame) -> DataFrame:
    """Changed files without readable functions: the file stem as function, HEADER for .h, else BODY."""
    stem = F.regexp_extract("file", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return files.select(stem.alias("function"), F.when(F.lower("file").endswith(".h"), F.lit("HEADER")).otherwise(F.lit("BODY")).alias("kind")).distinct()


def decisions(changes: DataFrame, keys: list[str], header_changed: str | None = None, auto_generate: bool = True) -> DataFrame:
    """target, decision for each key from its changes (kind): FLAG over AUTO over '-'.

    A changed header forces FLAG for sts and sds; AUTO becomes FLAG where documents are not
    generated automatically.
    """
    spark = changes.sparkSession
    matrix = spark.createDataFrame([(kind, target, 2 if d == "FLAG" else 1 if d == "AUTO" else 0) for kind, row in DECISIONS.items() for target, d in zip(TARGETS, row, strict=True)], "kind string, target string, rank int")
    kinds = changes.groupBy(*keys, "kind").agg(*([F.bool_or(header_changed).alias("header")] if header_changed else [F.lit(False).alias("header")]))
    force = F.col("header") & F.col("target").isin("sts", "sds")
    rank = F.max(F.when(force, F.lit(2)).otherwise(F.col("rank")))
    out = kinds.join(matrix, "kind").groupBy(*keys, "target").agg(rank.alias("rank"))
    auto = F.lit("AUTO") if auto_generate else F.lit("FLAG")
    return out.select(*keys, "target", F.when(F.col("rank") == 2, F.lit("FLAG")).when(F.col("rank") == 1, auto).otherwise(F.lit("-")).alias("decision"))


def risk(changes: DataFrame, keys: list[str], level: str, kind: str, direct: str) -> DataFrame:
    """score and grade of each key from its changed functions: their safety levels, kinds of change and number.

    A directly changed function of level B or higher escalates the grade.
    """
    rank, weight = numbers.mapped(level, numbers.LEVEL_RANK, 0), numbers.mapped(kind, numbers.CHANGE_WEIGHT, 1)
    out = changes.groupBy(*keys).agg(F.max(rank).alias("max_rank"), F.avg(weight).alias("mean_weight"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col(direct) & (rank >= 2)).alias("escalated"))
    score = numbers.risk_score(F.col("max_rank"), F.col("mean_weight"), F.col("n"))
    return out.withColumn("score", score).withColumn("grade", numbers.risk_grade(F.col("score"), F.col("max_rank"), F.col("escalated"))).select(*keys, "score", "grade")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (rel_path, mtime, md5) added, removed or changed; an empty old snapshot makes every file changed."""
    a = old.select("rel_path", F.struct("mtime", "md5").alias("a"))
    b = new.select("rel_path", F.struct("mtime", "md5").alias("b"))
    state = F.when(F.col("a").isNull(), F.lit("added")).when(F.col("b").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    if old.isEmpty():
        state = F.lit("changed")
    return a.join(b, "rel_path", "full_outer").filter("a is null or b is null or a <> b").select("rel_path", state.alias("state"))


def file_functions(changed: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions (name, file) of changed files (path): the path's end or its base name fits the function's file."""
    base = lambda c: F.regexp_extract(c, r"([^/\\]+)$", 1)
    a = changed.select("path", base("path").alias("base")).distinct()
    b = functions.select("name", "file", base("file").alias("base"))
    # Every fitting pair has the base name in common, so the suffix test is an equality join first.
    return b.join(a, "base", "left_semi").select("name", "file")


def work_type(paths: DataFrame, path: str) -> DataFrame:
    """Kind of work by the classes of changed paths: the most common class, ties in the order of the rules."""
    p = F.lower(path)
    rules = [("test", p.rlike(r"(^|/)tests?/|test_|_test\.")), ("docs", p.rlike(r"\.(md|rst|docx?|txt)$|(^|/)docs?/")), ("config", p.rlike(r"\.(ya?ml|toml|ini|cfg|json)$")), ("code", p.rlike(r"\.(c|h|cpp|py|js|jsx|ts)$"))]
    kind = reduce(lambda chain, r: chain.when(r[1], F.lit(r[0])), rules, F).otherwise(F.lit("other"))
    order = F.array_position(F.array(*[F.lit(k) for k, _ in rules], F.lit("other")), F.col("kind"))
    counted = paths.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), order))).select("kind", "n", "k")
