"""Cells of XLSX workbooks and text of DOCX documents, read in tasks from `binaryFile` rows."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelake.sources.files import binary

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _cells(data: bytes):
    """(sheet, row, col, value) of every filled cell; a formula without a value is `(formula)`."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(S + "t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(S + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(S + "sheet"):
            target = targets[sheet.get(R + "id")].lstrip("/")
            for cell in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(S + "c"):
                value, kind = cell.find(S + "v"), cell.get("t")
                text = value.text or "" if value is not None else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(S + "t"))
                elif value is None and cell.find(S + "f") is not None:
                    text = "(formula)"
                if text:
                    place = cell.get("r")
                    yield sheet.get("name"), int(re.search(r"\d+", place)[0]), _column(place), text


def _paragraphs(data: bytes):
    """(ordinal, kind, style, text): paragraphs, and table rows with their cells joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as document:
        body = ElementTree.fromstring(document.read("word/document.xml")).find(W + "body")
    text = lambda node: "".join(t.text or "" for t in node.iter(W + "t"))
    n = 0
    for part in body:
        if part.tag == W + "p":
            style = part.find(f"{W}pPr/{W}pStyle")
            yield n, "paragraph", style.get(W + "val") if style is not None else "", text(part)
            n += 1
        elif part.tag == W + "tbl":
            for row in part.iter(W + "tr"):
                yield n, "row", "", "\t".join(text(c) for c in row.iter(W + "tc"))
                n += 1


def _read(parse, names: list[str], types: list[pa.DataType]):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(path, *r) for r in parse(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):  # no such document: no rows
                    rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col (from 1), value of XLSX files; files that are none give no rows."""
    run = _read(_cells, ["path", "sheet", "row", "col", "value"], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()])
    return binary(spark, path, "*.xls[xm]").select("path", "content").mapInArrow(run, "path string, sheet string, row int, col int, value string")


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, kind, style, text of DOCX files; files that are none give no rows."""
    run = _read(_paragraphs, ["path", "ordinal", "kind", "style", "text"], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()])
    return binary(spark, path, "*.docx").select("path", "content").mapInArrow(run, "path string, ordinal int, kind string, style string, text string")
