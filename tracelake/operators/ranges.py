"""Value ranges of variables: from comments, macros, parameters, types and first values, with what told each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import _col

#: Bounds of the short type names.
TYPE_BOUNDS = {"U8": (0, 255), "U16": (0, 65535), "U32": (0, 4294967295), "S8": (-128, 127), "S16": (-32768, 32767), "S32": (-2147483648, 2147483647)}
#: Bounds of an address, and the note on a divisor.
ADDRESS = "0x00000000 ~ 0xFFFFFFFF"
DIVISOR = "divisor: no 0"
END = r"(-?\s*(?:0[xX][0-9A-Fa-f]+|\d+)|[A-Za-z_]\w*)"
#: "a ~ b", "a .. b", "a to b", with or without brackets or a comma inside them.
SPAN = rf"[\[\(]?\s*{END}\s*(?:~|\.\.\.?|\bto\b|,)\s*{END}\s*[\]\)]?"
SOURCES = ["comment", "macro pair", "macro", "parameter", "type", "init", "declaration"]


def _number(text: Column) -> Column:
    digits = F.replace(text, F.lit(" "), F.lit(""))
    bare = F.regexp_replace(digits, "^-", "")
    size = F.when(F.lower(bare).startswith("0x"), F.conv(F.substring(bare, 3, 16), 16, 10)).otherwise(bare).try_cast("long")
    return F.when(digits.startswith("-"), -size).otherwise(size)


def range_comments(files: DataFrame) -> DataFrame:
    """path, name, text of the ranges that comments before declarations give ("Range: a ~ b", "Value Range: a ~ b")."""
    p = r"/\*((?:[^*]|\*(?!/))*)\*/\s*((?:[A-Za-z_]\w*[\s*]+)+)([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*(?:=[^;]*)?;|((?:[ \t]*//[^\n]*\n)+)\s*((?:[A-Za-z_]\w*[\s*]+)+)([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*(?:=[^;]*)?;"
    each = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))).alias("d"))
    block = F.regexp_extract("d", p, 3) != ""
    comment = F.when(block, F.regexp_extract("d", p, 1)).otherwise(F.regexp_extract("d", p, 4))
    text = F.trim(F.regexp_extract(comment, r"(?i)\bRange\b[: \t]+([^\n*]+)", 1))
    return each.select("path", F.when(block, F.regexp_extract("d", p, 3)).otherwise(F.regexp_extract("d", p, 6)).alias("name"), text.alias("text")).filter("text <> ''")


def bounds(text: Column | str) -> Column:
    """(low, high) of a range's text, each as it is written; null where the text holds none."""
    low, high = (F.trim(F.regexp_extract(_col(text), SPAN, k)) for k in (1, 2))
    return F.when(low != "", F.struct(low.alias("low"), high.alias("high")))


def value_ranges(variables: DataFrame, constants: DataFrame, comments: DataFrame, parameters: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """name, low, high (long), text, source of variables (name, type, init, declared; names are distinct).

    The first that holds: a comment's range (name, text); the pair X_MIN and X_MAX of the macro X_MIN or
    X_MAX that the first value names; that macro's value; a parameter's range (name, text); the type's
    bounds (type, low, high; the short names' where none are given); the first value; the range that the
    declaration holds. `constants` is (name, value). Ends that are numbers or known macros become low and
    high; a single value is both. Other text keeps its wording, with null ends. A range that goes beyond
    its type's bounds is told by `outside_type`.
    """
    spark = variables.sparkSession
    if types is None:
        types = spark.createDataFrame([(t, *b) for t, b in TYPE_BOUNDS.items()], "type string, low long, high long")
    value = constants.filter("value is not null").select("name", "value")
    base = F.regexp_extract("name", r"^(.+)_(?:MIN|MAX)$", 1)
    pairs = value.select(base.alias("base"), F.when(F.col("name").endswith("_MIN"), F.col("value")).alias("low"), F.when(F.col("name").endswith("_MAX"), F.col("value")).alias("high")).filter("base <> ''")
    pairs = pairs.groupBy("base").agg(F.max("low").alias("pair_low"), F.max("high").alias("pair_high")).filter("pair_low is not null and pair_high is not null")
    span = lambda low, high: F.concat(low.cast("string"), F.lit(" ~ "), high.cast("string"))
    v = variables.select("name", "type", F.trim("init").alias("init"), "declared")
    v = v.join(comments.groupBy("name").agg(F.min("text").alias("comment")), "name", "left")
    v = v.join(value.select(F.col("name").alias("init"), F.col("value").alias("init_value")), "init", "left")
    v = v.withColumn("base", F.regexp_replace("init", "_(?:MIN|MAX)", "")).join(pairs, "base", "left")
    v = v.join(parameters.groupBy("name").agg(F.min("text").alias("parameter")), "name", "left") if parameters is not None else v.withColumn("parameter", F.lit(None).cast("string"))
    v = v.join(types.select("type", F.col("low").alias("type_low"), F.col("high").alias("type_high")), "type", "left")
    known = F.col("init_value").isNotNull()
    told = {
        "comment": F.nullif("comment", F.lit("")), "macro pair": F.when(known, span(F.col("pair_low"), F.col("pair_high"))), "macro": F.when(known, F.col("init_value").cast("string")), "parameter": F.nullif("parameter", F.lit("")),
        "type": span(F.col("type_low"), F.col("type_high")), "init": F.nullif("init", F.lit("")), "declaration": F.nullif("declared", F.lit("")),
    }
    best = F.coalesce(*[F.when(told[s].isNotNull(), F.struct(told[s].alias("text"), F.lit(s).alias("source"))) for s in SOURCES])
    v = v.select("name", "type_low", "type_high", best["text"].alias("text"), best["source"].alias("source"))
    ends = v.withColumn("ends", F.coalesce(bounds("text"), F.when(F.col("text").rlike(rf"^\s*{END}\s*$"), F.struct(F.trim("text").alias("low"), F.trim("text").alias("high")))))
    ends = ends.withColumns({"low_text": F.col("ends.low"), "high_text": F.col("ends.high")})
    of = lambda c: value.select(F.col("name").alias(f"{c}_text"), F.col("value").alias(f"{c}_macro"))
    out = ends.join(of("low"), "low_text", "left").join(of("high"), "high_text", "left")
    low, high = (F.coalesce(_number(F.col(f"{c}_text")), F.col(f"{c}_macro")) for c in ("low", "high"))
    return out.select("name", low.alias("low"), high.alias("high"), "text", "source", F.coalesce((low < F.col("type_low")) | (high > F.col("type_high")), F.lit(False)).alias("outside_type"))


def function_ranges(usage: DataFrame, ranges: DataFrame, bodies: DataFrame, pointers: DataFrame | None = None) -> DataFrame:
    """function, name, low, high, source, note: ranges of the variables that functions use (function, name).

    The note tells a divisor and the indexes used, as `bodies` (name, body) show them, and the span of
    addresses for names of `pointers` (name). A variable without a known range has nulls.
    """
    uses = usage.select("function", "name").distinct()
    text = bodies.select(F.col("name").alias("function"), "body")
    met = uses.join(text, "function", "left")
    near = lambda before, after: F.concat(F.lit(before), F.col("name"), F.lit(after))
    divisor = F.regexp_like("body", near(r"[/%]\s*=?\s*\(?\s*", r"\b"))
    index = F.array_distinct(F.transform(F.regexp_extract_all("body", near(r"\b", r"\s*\[\s*([^\]]+?)\s*\]"), F.lit(1)), lambda i: F.regexp_replace(i, r"\s+", " ")))
    parts = F.array(F.when(F.size(index) > 0, F.concat(F.lit("idx: "), F.array_join(index, ", "))), F.when(F.col("is_pointer"), F.lit(f"range: {ADDRESS}")), F.when(divisor, F.lit(DIVISOR)))
    known = pointers.select("name", F.lit(True).alias("is_pointer")).distinct() if pointers is not None else uses.select("name").limit(0).withColumn("is_pointer", F.lit(True))
    noted = met.join(known, "name", "left").select("function", "name", F.nullif(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; "), F.lit("")).alias("note"))
    return noted.join(ranges.select("name", "low", "high", "source"), "name", "left").select("function", "name", "low", "high", "source", "note")
