"""Change logs: each run of a document against the run before it, entry by entry and field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators.graph import checkpointed


def normalised(value: Column, kind: T.DataType) -> Column:
    """A value as it is compared: texts trimmed, nulls as empty texts, lists and records in depth."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normalised(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[normalised(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows over `parts` by their keys; without a number as Spark deals them for what follows."""
    return rows if parts is None else rows.repartition(parts, *keys)


def previous_runs(runs: DataFrame, document: str, run: str, order: list[str], parts: int | None = None) -> DataFrame:
    """document, run, previous_run: the latest run of the same document before each, null for the first."""
    rows = _dealt(runs.select(document, run, *order), parts, document, run)
    one = _dealt(rows.groupBy(document, run).agg(*[F.min(c).alias(c) for c in order]), parts, document)
    return one.select(document, run, F.lag(run).over(Window.partitionBy(document).orderBy(*order, run)).alias("previous_run"))


def change_log(entries: DataFrame, document: str, run: str, order: list[str], name: str, fields: list[str], parts: int | None = None) -> DataFrame:
    """document, run, previous_run, name, change, fields_changed, before, after of the entries that a run changed.

    `entries` has a row for each entry of each run. Names meet without regard to case; an entry that only
    the run has is `created`, one that only the run before has is `removed`, and `changed` ones name the
    fields that differ, in the order of `fields`, which may hold lists and records. `before` and `after`
    sum an entry up: the length of a list, the text of anything else. A run that lists an entry twice
    counts with the first by its fields' texts. A task holds one of `parts` of the entries: give a number
    that follows theirs where they are many; without one there are as many as shuffle partitions.
    """
    kinds = {f: entries.schema[f].dataType for f in fields}
    lengths = [f for f in fields if isinstance(kinds[f], T.ArrayType)]
    key = F.lower(F.trim(F.col(name)))
    values = F.struct(*[normalised(F.col(f), kinds[f]).alias(f) for f in fields])
    summed = F.struct(*[(F.when(F.col(f).isNotNull(), F.size(f)).otherwise(0) if f in lengths else normalised(F.col(f), kinds[f])).alias(f"{f}_count" if f in lengths else f) for f in fields])
    told = entries.filter(key != "").select(document, run, key.alias("key"), F.trim(F.col(name)).alias("name"), F.to_json(values).alias("text"), values.alias("fields"), summed.alias("sum"))
    # Entries of a run are met twice, as new and as old ones.
    once = checkpointed(_dealt(told, parts, document, run, "key").groupBy(document, run, "key").agg(F.min_by(F.struct("name", "fields", "sum"), "text").alias("e")))
    links = _dealt(previous_runs(entries, document, run, order, parts), parts, document, run)
    after = once.select(document, run, "key", F.col("e").alias("new"))
    nexts = _dealt(links.filter("previous_run is not null").select(document, F.col(run).alias("next_run"), F.col("previous_run").alias(run)), parts, document, run)
    before = once.join(nexts, [document, run]).select(document, F.col("next_run").alias(run), "key", F.col("e").alias("old"))
    both = _dealt(after, parts, document, run, "key").join(before, [document, run, "key"], "full_outer").join(links, [document, run])
    differ = F.filter(F.array(*[F.when(~F.col(f"old.fields.{f}").eqNullSafe(F.col(f"new.fields.{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    change = F.when(F.col("old").isNull(), F.lit("created")).when(F.col("new").isNull(), F.lit("removed")).when(F.size(differ) > 0, F.lit("changed"))
    rows = both.select(document, run, "previous_run", F.coalesce("new.name", "old.name").alias("name"), change.alias("change"), differ.alias("differ"), F.col("old.sum").alias("before"), F.col("new.sum").alias("after"))
    listed = F.when(F.col("change") == "changed", F.col("differ")).otherwise(F.array("change"))
    return rows.filter("change is not null").select(document, run, "previous_run", "name", "change", listed.alias("fields_changed"), "before", "after")


def change_totals(log: DataFrame, entries: DataFrame, document: str, run: str, order: list[str], parts: int | None = None) -> DataFrame:
    """document, run, previous_run, status, created, removed, changed of every run: completed where it changed something, else unchanged."""
    kinds = ("created", "removed", "changed")
    per = _dealt(log.select(document, run, "change"), parts, document, run).groupBy(document, run).agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    every = _dealt(previous_runs(entries, document, run, order, parts), parts, document, run).join(per, [document, run], "left")
    counted = every.select(document, run, "previous_run", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
    some = F.col("created") + F.col("removed") + F.col("changed") > 0
    return counted.select(document, run, "previous_run", F.when(some, F.lit("completed")).otherwise(F.lit("unchanged")).alias("status"), *kinds)
