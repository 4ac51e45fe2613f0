"""Test case data and execution results of unit test reports: nested rows become variables with their values."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks and headings of the reports.
CASE_MARK = "<!-- TestcaseSectionsHeader -->"
RESULT_MARK = "<!-- ExecutionResults/testcase_header -->"
INPUT, EXPECTED = "<h4>Input Test Data</h4>", "<h4>Expected Test Data</h4>"
ROW, CELL, DEPTH = (re.compile(p, re.I | re.S | re.A) for p in (r"<tr\b[^>]*>(.*?)</tr>", r"<td\b[^>]*>(.*?)</td>", r"(?-i:class)=[\"'](?-i:i)(\d+)"))
#: What is white space at a cell's ends, and the deepest level that is a depth.
BLANKS, MOST = " \t\n\x0b\f\r", 2**31 - 1
_ITEM = [pa.field("place", pa.int32()), *(pa.field(c, pa.string()) for c in ("variable", "value", "wanted"))]
ITEMS = "array<struct<place:int,variable:string,value:string,wanted:string>>"


def _sections(pages: DataFrame, keys: list[str], column: str, mark: str) -> DataFrame:
    parts = F.split(F.coalesce(F.col(column), F.lit("")), mark)
    each = pages.select(*keys, F.posexplode(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))).alias("section", "part"))
    after = lambda head, k: F.trim(F.regexp_extract("part", rf"(?is)<th>{head}</th>\s*<td[^>]*>(.*?)</td>(?:\s*<th>[^<]*</th>\s*<td[^>]*>(.*?)</td>)?", k))
    unit = F.when(after("Subprogram", 1) != "", after("Subprogram", 1)).otherwise(after("Unit Under Test", 2))
    named = each.select(*keys, "section", "part", after("Unit Under Test", 1).alias("component"), unit.alias("unit"), after("Test Case Name", 1).alias("testcase"))
    return named.filter("component <> '' and testcase <> ''")


def _rows(table: str) -> list[tuple[int, int, list[str], str]]:
    """(depth, at, cells, row) of the rows whose first cell has a depth; `at` is the depth's place among those of the table."""
    read = [(DEPTH.search(row), row) for row in ROW.findall(table)]
    deep = [(int(m[1]), row) for m, row in read if m and int(m[1]) <= MOST]
    known = {d: i for i, d in enumerate(sorted({d for d, _ in deep}))}
    return [(d, known[d], [c.strip(BLANKS) for c in CELL.findall(row)], row) for d, row in deep]


def _path(names: list[str | None], between: str) -> str:
    """The names in one; an index in brackets follows without a sign between."""
    path = ""
    for x in names:
        if x is not None:
            path += x if path == "" or "[" in x else between + x
    return path


def _cell(cells: list[str], k: int) -> str:
    return cells[k] if k < len(cells) else ""


def _bare(x: str) -> str:
    return x.replace("&lt;", "").replace("&gt;", "")


def _case_rows(table: str, unit: str) -> Iterator[tuple[str, str, None]]:
    """(variable, value, None) of a data table's rows in order; kept are the kind of rows and the names by depth."""
    rows = _rows(table)
    empty: list[str | None] = [None] * (max((at for _, at, _, _ in rows), default=-1) + 1)
    kind, own, names = "", [*empty], [*empty]
    for depth, at, cells, row in rows:
        name, value = _cell(cells, 0), _cell(cells, 2)
        behind = name[name.find(":") + 1 :].strip(" ")
        clean = ("" if "malloc " in value else _bare(value)) if "&lt;&lt;" in value else value
        if depth == 0:
            kind = "stubs" if "Stubbed Subprograms" in row else "unit" if "UUT" in row else kind
            own, names = [*empty], [*empty]
        elif depth == 1:
            if "Globals" in row or ("Subprogram" in row and behind == unit):
                kind = "globals"
            elif "Subprogram" in row:
                kind, own[at] = "parameters", behind
        elif kind == "parameters":
            own[at] = name
            if clean != "":
                yield _path(own[: at + 1], "() "), clean, None
        elif kind == "globals":
            names = [*empty] if depth == 2 else names
            names[at] = _bare(name)
            if clean != "":
                yield _path(names[: at + 1], "."), clean, None
        elif kind == "stubs":
            names[at] = behind if depth == 2 else name
            if value != "":
                yield _path(names[: at + 1], "() "), value, None


def _result_rows(table: str, unit: str) -> Iterator[tuple[str, str, str]]:
    """(variable, value, wanted) of a result's rows that have a mark."""
    rows = _rows(table)
    empty: list[str | None] = [None] * (max((at for _, at, _, _ in rows), default=-1) + 1)
    names = [*empty]
    for _, at, cells, row in rows:
        shown = lambda k: _cell(cells, k).replace("&lt;", "<").replace("&gt;", ">")  # noqa: B023, E731
        if ":" in shown(0):
            names = [*empty]
            continue
        names[at] = shown(0)
        if "success-marker" in row:
            yield _path(names[: at + 1], "."), shown(2), shown(2)
        elif "fail-marker" in row:
            yield _path(names[: at + 1], "."), shown(2), _cell(cells, 3).replace("[", "").replace("]", "").strip(" ")


def _last_values(found: Iterable[tuple]) -> list[tuple]:
    """(place, variable, value, wanted): of values of one variable the last, at the place of the first."""
    last: dict[str, tuple] = {}
    for place, (variable, value, wanted) in enumerate(found):
        last[variable] = (last[variable][0] if variable in last else place, variable, value, wanted)
    return list(last.values())


def _item_array(items: list[list[tuple]]) -> pa.Array:
    """Lists of items as one array, column by column: a dictionary an item takes longer than reading the tables."""
    flat = [i for found in items for i in found]
    each = pa.StructArray.from_arrays([pa.array([i[k] for i in flat], f.type) for k, f in enumerate(_ITEM)], fields=_ITEM)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, items))], pa.int32()), each)


def _read(tables: DataFrame, rows: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """The tables (table, unit and more columns) with their items in place of the text."""
    kept = [c for c in tables.columns if c != "table"]

    def run(batches):
        for batch in batches:
            items = [_last_values(rows(t or "", u)) for t, u in zip(batch.column("table").to_pylist(), batch.column("unit").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _item_array(items)], names=[*kept, "items"])

    return tables.mapInArrow(run, T.StructType([*tables.select(*kept).schema.fields, T.StructField("items", T.DataType.fromDDL(ITEMS))]))


def _case_tables(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row for each table of values of a section, input or expected, with its items."""
    each = _sections(pages, keys, column, CASE_MARK)
    cut = lambda head: F.regexp_extract(F.substring_index("part", head, -1), r"(?is)^(.*?)</table>", 1)
    half = lambda head: F.when(F.col("part").contains(head) & ~F.substring(F.substring_index("part", head, -1), 1, 60).contains("This test has no"), cut(head))
    parts = each.select(*keys, "section", "component", "unit", "testcase", F.explode(F.create_map(F.lit("input"), half(INPUT), F.lit("expected"), half(EXPECTED))).alias("part", "table"))
    return _read(parts.filter("table is not null"), _case_rows)


def case_items(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Input and expected values of test case data reports: keys, section, component, unit, testcase, part, variable, place, value.

    `part` is input or expected. Rows are read in order, as their depths nest: names of globals are
    joined with dots, parameters and stubs with `() `, indexes with nothing. Of values of one variable
    in a table the last counts, at the place of the first. A null page has none.
    """
    return _case_tables(pages, keys, column).select(*keys, "section", "component", "unit", "testcase", "part", F.inline("items")).select(*keys, "section", "component", "unit", "testcase", "part", "variable", "place", "value")


def case_bank(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """What test case data reports hold in all: keys, environment, component, cases, input_names, expected_names, most_inputs, most_expected.

    Names stand in the order in which they come first; `cases` counts different test cases, the maxima are
    those of one section. The component is the first section's; a page without sections has no row.
    """
    environment = F.trim(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"(?is)<th>Environment Name</th>\s*<td[^>]*>(.*?)</td>", 1))
    # The tables are read once for all figures.
    tables = _case_tables(pages.select(*keys, column, environment.alias("environment")), [*keys, "environment"], column).filter(F.size("items") > 0)
    of = lambda part, c: F.when(F.col("part") == part, c)
    names = lambda part: F.collect_list(of(part, F.struct("section", F.transform("items", lambda i: i["variable"]).alias("names"))))
    most = lambda part: F.coalesce(F.max(of(part, F.size("items").cast("long"))), F.lit(0)).alias(f"most_{part}")
    bank = tables.groupBy(*keys, "environment").agg(F.min_by("component", "section").alias("component"), F.size(F.collect_set("testcase")).cast("long").alias("cases"), names("input").alias("input"), names("expected").alias("expected"), most("input"), most("expected"))
    listed = lambda part: F.array_distinct(F.flatten(F.transform(F.array_sort(part), lambda x: x["names"]))).alias(f"{part}_names")
    return bank.select(*keys, "environment", "component", "cases", listed("input"), listed("expected"), F.col("most_input").alias("most_inputs"), "most_expected")


def result_items(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Actual and expected values of execution result reports: keys, section, component, unit, testcase, passed, variable, place, actual, expected."""
    each = _sections(pages, keys, column, RESULT_MARK).withColumn("passed", F.col("part").rlike(r"</a>Execution Results[^\n]*\(PASS\)"))
    read = _read(each.withColumnsRenamed({"part": "table"}), _result_rows)
    return read.select(*keys, "section", "component", "unit", "testcase", "passed", F.inline("items")).select(*keys, "section", "component", "unit", "testcase", "passed", "variable", "place", F.col("value").alias("actual"), F.col("wanted").alias("expected"))
