"""Requirement blocks of plain documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import asil, requirement_type

ID = r"Sw(?:TR|TSR|NTR|NTSR|CNF|EI|ST|STR|Fn|TK)_\d+"
#: Keys that end a description.
STOP_KEYS = ["Rationale", "Priority", "Status", "Risk", "Reuse", "Related ID", "Verification criteria", "ASIL", "System State", "Software State", "Type"]


def blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Requirement blocks of lines (keys, line_no, text): keys, block, id, name, description, related_ids, asil.

    A block starts at a line `ID ... <id>` or at a line that begins with an id. A description goes on
    until an empty line, a stop key or the next block. Lines before the first block are skipped.
    """
    t = F.trim("text")
    opens = (t.startswith("ID") & t.rlike(rf"\b{ID}\b")) | t.rlike(rf"^{ID}[:\s]")
    by_line = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(*keys, "line_no", t.alias("t"), opens.alias("opens")).withColumn("block", F.count_if("opens").over(by_line)).filter("block > 0")
    stop = F.col("t").rlike("^(" + "|".join(STOP_KEYS) + ")")
    switch = F.when(F.col("opens") | (F.col("t") == "") | stop | F.col("t").startswith("Name"), F.lit(False)).when(F.col("t").startswith("Description"), F.lit(True))
    in_block = Window.partitionBy(*keys, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    read = marked.withColumn("reading", F.coalesce(F.last(switch, ignorenulls=True).over(in_block), F.lit(False)))
    rest = lambda key: F.trim(F.regexp_replace("t", f"^{key}[:\\s]*", ""))
    line = F.when(F.col("reading"), F.when(F.col("t").startswith("Description"), rest("Description")).otherwise(F.col("t")))
    own = F.when(F.col("opens") & F.col("t").rlike(f"^{ID}:"), F.trim(F.regexp_replace("t", f"^{ID}:", "")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("line_no", line.alias("s"))))), lambda p: p["s"]), lambda s: s != "")
    out = read.groupBy(*keys, "block").agg(
        first(F.when(F.col("opens"), F.regexp_extract("t", f"({ID})", 1))).alias("id"),
        last(F.coalesce(F.when(F.col("t").startswith("Name"), rest("Name")), own)).alias("name"),
        F.array_join(parts, " ").alias("description"),
        last(F.when(F.col("t").startswith("Related ID"), rest("Related ID"))).alias("related_ids"),
        last(F.when(F.col("t").startswith("ASIL"), rest("ASIL"))).alias("level"),
    )
    return out.select(*keys, "block", "id", "name", "description", "related_ids", asil("level").alias("asil"))


#: What a requirement table calls the fields of its record.
TABLE_FIELDS = {"id": "ID", "name": "Name", "description": "Description", "asil": "ASIL", "related_id": "Related ID", "software_state": "Software State", "verification": "Verification criteria", "priority": "Priority"}


def from_tables(tables: DataFrame, rows: str, keys: list[str]) -> DataFrame:
    """Requirement records of two-column tables (array of array of cell texts): keys, the fields of TABLE_FIELDS, req_type.

    A table of under three rows, or whose ID is no requirement id, has none. The last value of a
    field counts, an absent one is empty; of tables with one id the first by keys stays.
    """
    pairs = F.filter(F.transform(rows, lambda r: F.struct(F.trim(F.get(r, F.lit(0))).alias("k"), F.trim(F.get(r, F.lit(1))).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    value = lambda name: F.try_element_at(F.filter("pairs", lambda p: p["k"] == name), F.lit(-1))["v"]
    read = tables.filter(F.size(rows) >= 3).select(*keys, pairs.alias("pairs")).select(*keys, *[value(n).alias(c) for c, n in TABLE_FIELDS.items()])
    read = read.fillna("", list(TABLE_FIELDS)).filter(F.col("id").rlike(f"^{ID}"))
    first = read.groupBy("id").agg(F.min(F.struct(*keys, *[c for c in TABLE_FIELDS if c != "id"])).alias("r"))
    return first.select(*[f"r.{k}" for k in keys], "id", *[f"r.{c}" for c in TABLE_FIELDS if c != "id"], requirement_type("id").alias("req_type"))


def components(found: DataFrame) -> DataFrame:
    """(requirement_id, kind, target): components and functions that requirement blocks of types TR and TSR name."""
    each = found.filter(F.col("id").rlike("^SwT(S)?R_")).select(F.col("id").alias("requirement_id"), F.explode(F.regexp_extract_all(F.coalesce("related_ids", F.lit("")), F.lit(r"\b(Sw(?:Com|Fn)_\d+)\b"), F.lit(1))).alias("target"))
    return each.select("requirement_id", F.when(F.col("target").startswith("SwCom"), F.lit("component")).otherwise(F.lit("function")).alias("kind"), "target").distinct()


def type_counts(found: DataFrame) -> DataFrame:
    """Distinct blocks of each id prefix."""
    return found.select("id", "name", "description").distinct().groupBy(F.regexp_extract("id", r"^(Sw[A-Za-z]+)_\d+", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
