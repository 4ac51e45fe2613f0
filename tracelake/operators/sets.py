"""Distinct rows, ordered distinct and projections of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Function edges (src, dst) as distinct component edges without loops; `components` is (name, component)."""
    a = components.select(F.col("name").alias("src"), F.col("component").alias("from_component"))
    b = components.select(F.col("name").alias("dst"), F.col("component").alias("to_component"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").filter("from_component <> to_component").select("from_component", "to_component").distinct()


def longest_per_key(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Of each key the row's longest text, the first in order among equals."""
    best = rows.groupBy(key).agg(F.min(F.struct((-F.length(text)).alias("m"), F.col(text).alias("t"))).alias("b"))
    return best.select(key, F.col("b.t").alias(text))


def first_by_priority(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union of sources, best first: of each key the row of the first source that has it, of those the least by `order`."""
    from pyspark.sql import Window

    both = None
    for k, source in enumerate(sources):
        part = source.withColumn("priority", F.lit(k))
        both = part if both is None else both.unionByName(part)
    w = Window.partitionBy(key).orderBy("priority", order)
    return both.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")
