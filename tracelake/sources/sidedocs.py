"""Documents beside the requirements: signal sheets, described functions, test strategies and design summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a signal sheet, from 1; headings that tell a strategy; words of a table of components.
SIGNAL_COLUMNS = {"id": 6, "signal_name": 7, "signal_type": 8, "direction": 12, "characteristics": 13, "sw_var_name": 20, "related_id": 21}
STRATEGY = ["test strategy", "test scope", "test approach", "test method", "test environment", "entry criteria", "exit criteria", "테스트 전략", "테스트 범위", "테스트 방법", "시험 환경", "시험 범위"]
COMPONENT_WORDS = ["component", "module", "sw", "function", "design", "description"]
NAME_WORDS, TEXT_WORDS = ["name", "function"], ["desc", "summary", "설명"]


def _has(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def signals(cells: DataFrame) -> DataFrame:
    """path, row and the columns above of the signal rows of workbooks (path, sheet, row, col, value).

    The sheet is the first by name that is called hsis or 2.; else the first. Signal rows come after the
    row that heads them (it has "signal", and "sw variable" or "variable name"), have an id HSI_<number>,
    and a signal's or a variable's name.
    """
    wanted = F.lower("sheet").contains("hsis") | F.col("sheet").contains("2.")
    sheet = cells.groupBy("path").agg(F.coalesce(F.min(F.when(wanted, F.col("sheet"))), F.min("sheet")).alias("sheet"))
    value = F.trim(F.coalesce("value", F.lit("")))
    own = cells.join(sheet, ["path", "sheet"])
    pick = [F.max(F.when(F.col("col") == k, value)).alias(c) for c, k in SIGNAL_COLUMNS.items()]
    rows = own.groupBy("path", "row").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))), lambda x: x["v"]), " ")).alias("text"), *pick)
    heads = rows.filter(F.col("text").contains("signal") & _has(F.col("text"), ["sw variable", "variable name"])).groupBy("path").agg(F.min("row").alias("head"))
    found = rows.join(heads, "path").filter((F.col("row") > F.col("head")) & F.col("id").rlike(r"(?i)^HSI_\d+"))
    told = found.select("path", "row", *[F.coalesce(c, F.lit("")).alias(c) for c in SIGNAL_COLUMNS])
    return told.filter("signal_name <> '' or sw_var_name <> ''")


def signal_names(found: DataFrame) -> DataFrame:
    """path, name, kind (variable, signal): identifiers that signals name, each once a kind; a cell may hold several variables."""
    variables = F.filter(F.transform(F.split("sw_var_name", r"[\n,\s]+"), lambda t: F.trim(t)), lambda t: t.rlike(r"^[A-Za-z_]\w+$"))
    pin = F.regexp_replace("signal_name", "[^A-Za-z0-9_]", "_")
    pins = F.when((F.length(pin) > 2) & pin.rlike("^[A-Za-z_]"), F.array(pin)).otherwise(F.array().cast("array<string>"))
    each = lambda kind, names: found.select("path", F.explode(names).alias("name"), F.lit(kind).alias("kind"))
    return each("variable", variables).unionByName(each("signal", pins)).distinct()


def _place(header: Column, words: list[str]) -> Column:
    hits = F.filter(F.transform(header, lambda h, i: F.when(_has(h, words), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def table_descriptions(rows: DataFrame) -> DataFrame:
    """path, name (lower case), description of tables (path, table, row from 0, cells) whose first row heads a name and a description; the last of a name counts."""
    header = F.transform("cells", lambda c: F.lower(F.trim(c)))
    heads = rows.filter("row = 0").select("path", "table", _place(header, NAME_WORDS).alias("n"), _place(header, TEXT_WORDS).alias("d")).filter("n is not null and d is not null")
    told = rows.filter("row > 0").join(heads, ["path", "table"]).select("path", "table", "row", F.trim(F.get("cells", F.col("n"))).alias("name"), F.trim(F.get("cells", F.col("d"))).alias("description"))
    return told.filter("name <> '' and description <> ''").groupBy("path", F.lower("name").alias("name")).agg(F.max_by("description", F.struct("table", "row")).alias("description"))


def _headed(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs that have text, with whether they head a part, its number, and its heading."""
    text = F.trim(F.coalesce("text", F.lit("")))
    heads = F.lower(F.coalesce("style", F.lit(""))).contains("heading") | F.coalesce("bold", F.lit(False))
    w = Window.partitionBy("path").orderBy("ordinal")
    rows = paragraphs.select("path", "ordinal", text.alias("text"), heads.alias("heads")).filter("text <> ''")
    return rows.withColumn("part", F.sum(F.col("heads").cast("int")).over(w)).withColumn("heading", F.last(F.when(F.col("heads"), F.col("text")), ignorenulls=True).over(w))


def heading_descriptions(paragraphs: DataFrame, most: int = 3) -> DataFrame:
    """path, name (lower case), description: the first `most` paragraphs below each heading (path, ordinal, style, bold, text); the last of a name counts."""
    below = _headed(paragraphs).filter("not heads and part > 0").withColumn("k", F.row_number().over(Window.partitionBy("path", "part").orderBy("ordinal"))).filter(F.col("k") <= most)
    parts = below.groupBy("path", "part", "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ").alias("description"))
    return parts.groupBy("path", F.lower("heading").alias("name")).agg(F.max_by("description", "part").alias("description"))


def strategy_lines(paragraphs: DataFrame, most: int = 40) -> DataFrame:
    """path, place, text: headings that tell a test strategy, in brackets, and what stands below them; the first `most` of a document."""
    rows = _headed(paragraphs).filter(_has(F.lower("heading"), STRATEGY))
    text = F.when(F.col("heads"), F.concat(F.lit("["), F.col("text"), F.lit("]"))).otherwise(F.col("text"))
    placed = rows.select("path", text.alias("text"), F.row_number().over(Window.partitionBy("path").orderBy("ordinal")).alias("place"))
    return placed.filter(F.col("place") <= most).select("path", "place", "text")


def summary_lines(paragraphs: DataFrame, tables: DataFrame, most: int = 80, most_paragraphs: int = 60) -> DataFrame:
    """path, place, text of a design's summary: headings and paragraphs of over 20 characters, then the first rows of its first eight tables that head components."""
    text = F.when(F.col("heads"), F.concat(F.lit("[Section] "), F.col("text"))).otherwise(F.col("text"))
    lines = _headed(paragraphs).filter("heads or length(text) > 20").select("path", text.alias("text"), F.row_number().over(Window.partitionBy("path").orderBy("ordinal")).alias("k")).filter(F.col("k") <= most_paragraphs)
    first = tables.filter("table < 8")
    heads = first.filter((F.col("row") == 0) & _has(F.lower(F.array_join("cells", " ")), COMPONENT_WORDS)).select("path", "table")
    cells = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "")
    rows = first.filter("row between 1 and 5").join(heads, ["path", "table"], "left_semi").select("path", F.array_join(F.slice(cells, 1, 4), " | ").alias("text"), (F.col("table") * 10 + F.col("row")).alias("k")).filter("text <> ''")
    both = lines.select("path", F.struct(F.lit(0).alias("part"), "k").alias("order"), "text").unionByName(rows.select("path", F.struct(F.lit(1).alias("part"), "k").alias("order"), "text"))
    return both.select("path", F.row_number().over(Window.partitionBy("path").orderBy("order")).alias("place"), "text").filter(F.col("place") <= most)


def longer_descriptions(functions: DataFrame, found: DataFrame) -> DataFrame:
    """`functions` (id, name, description, ...) with the description found under their name, else their id, where that is longer."""
    of = lambda c: found.groupBy(F.col("name").alias(f"_{c}")).agg(F.max("description").alias(f"_by_{c}"))
    met = functions.join(of("name"), F.lower("name") == F.col("_name"), "left").join(of("id"), F.lower("id") == F.col("_id"), "left")
    new = F.coalesce("_by_name", "_by_id")
    better = F.when(F.length(new) > F.coalesce(F.length("description"), F.lit(0)), new).otherwise(F.col("description"))
    return met.withColumn("description", better).select(*functions.columns)
