"""Call graphs as edge DataFrames: hops, closures, trees, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: A frontier of more nodes is not sent to the edges.
BROADCAST_NODES = 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's own folder below `spark.checkpoint.dir`; where no folder is named, a temporary one under a local master."""
    import tempfile

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracelake-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration in the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, read once; equal ones stay."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return edges.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))


def undirected(edges: DataFrame) -> DataFrame:
    return both_ways(edges).distinct()


def _settled(edges: DataFrame) -> DataFrame:
    """Edges written once, where they stand: no hop computes them again."""
    return checkpointed(edges.select("src", "dst"))


def hops(edges: DataFrame, seeds: DataFrame, most: int | None = None, stop_over: int | None = None, parts: int | None = None) -> DataFrame:
    """node, hop: the least number of edges from any seed (node), up to `most`; without it until no new node is reached.

    With `stop_over` the search ends after the hop that brings the nodes seen over that number.
    Each hop is one join of the last frontier with the edges and one anti-join with what is seen. A frontier of up to
    `BROADCAST_NODES` goes to the edges; a larger one meets them in `parts`: give a number that follows the edges'
    where they are many, as a task sorts one part.
    """
    return _hops(_settled(edges), seeds, most, stop_over, parts)


def _hops(edges: DataFrame, seeds: DataFrame, most: int | None = None, stop_over: int | None = None, parts: int | None = None) -> DataFrame:
    seen = frontier = checkpointed(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    k = 0
    while (most is None or k < most) and (reach := frontier.count()):
        k += 1
        last = frontier.select("node")
        last = F.broadcast(last) if reach <= BROADCAST_NODES else last if parts is None else last.repartition(parts, "node")
        reached = edges.join(last, edges["src"] == last["node"]).select(F.col("dst").alias("node")).distinct()
        # Every frontier is settled, so what is seen is their union and needs no copy of its own.
        frontier = checkpointed(reached.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(k)))
        seen = seen.union(frontier)
        if stop_over is not None and seen.count() > stop_over:
            break
    return seen


def impact_groups(edges: DataFrame, modules: DataFrame, seeds: DataFrame, same_module: bool = True, most_hops: int = 2, most_functions: int | None = None, parts: int | None = None) -> DataFrame:
    """node, group (direct, indirect_1hop, indirect_2hop) over lower-cased undirected edges, inside modules if asked.

    An edge between functions of different known modules is left out; a function without a module
    keeps its edges. With `most_functions` the search ends after the hop that brings the nodes over that
    number; without it all hops are whole. `parts` is as in `hops`.
    """
    low = edges.select(F.lower(F.trim("src")).alias("src"), F.lower(F.trim("dst")).alias("dst")).filter("src <> '' and dst <> ''")
    if same_module:
        of = lambda c: modules.select(F.lower("name").alias(c), F.nullif("module", F.lit("")).alias(f"{c}_module"))
        # A task holds one part of the modules, which the edges follow, not all modules.
        side = lambda c: of(c) if parts is None else of(c).repartition(parts, c).hint("shuffle_hash")
        low = low.join(side("src"), "src", "left").join(side("dst"), "dst", "left").filter("src_module is null or dst_module is null or src_module = dst_module")
    # Edges told twice change no hop, so they are not made distinct.
    found = hops(both_ways(low), seeds.select(F.lower("node").alias("node")), most_hops, most_functions, parts)
    group = F.when(F.col("hop") == 0, F.lit("direct")).otherwise(F.concat(F.lit("indirect_"), F.col("hop").cast("string"), F.lit("hop")))
    return found.select("node", group.alias("group"))


def directed_impact(edges: DataFrame, seeds: DataFrame, parts: int | None = None) -> DataFrame:
    """Seeds, everything that they call at any depth and everything that calls them. `parts` is as in `hops`."""
    calls = _settled(edges)
    down = _hops(calls, seeds, parts=parts)
    up = _hops(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, parts=parts)
    return down.select("node").union(up.select("node")).distinct()


def impacted_components(impacted: DataFrame, modules: DataFrame, seeds: DataFrame, unknown: str = "unknown") -> DataFrame:
    """component, n_nodes, n_seeds: the impacted nodes (node) and the seeds among them by module (name, module).

    Nodes without a module, or with an empty one, count as `unknown`; of a name with several
    modules the least counts.
    """
    of = modules.filter("module <> ''").groupBy(F.col("name").alias("node")).agg(F.min("module").alias("component"))
    first = seeds.select("node", F.lit(1).alias("seed")).distinct()
    rows = impacted.select("node").distinct().join(of, "node", "left").join(first, "node", "left")
    return rows.groupBy(F.coalesce("component", F.lit(unknown)).alias("component")).agg(F.count(F.lit(1)).alias("n_nodes"), F.count("seed").alias("n_seeds"))


def call_tree(edges: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """Paths from entries (node) in call order: entry, depth, node, path, cycle, truncated.

    A node that is on its own path is marked as a cycle and not followed; a node at the last depth
    that still calls others is marked truncated. Paths are bounded by `depth`.
    """
    start = entries.select(F.col("node").alias("entry"), F.lit(0).alias("depth"), "node", F.array(F.col("node").cast("string")).alias("path"), F.lit(False).alias("cycle"))
    level, tree = start, start
    for k in range(1, depth + 1):
        step = level.filter(~F.col("cycle")).join(edges.select(F.col("src").alias("node"), F.col("dst")), "node")
        name = F.col("dst").cast("string")
        level = checkpointed(step.select("entry", F.lit(k).alias("depth"), F.col("dst").alias("node"), F.concat("path", F.array(name)).alias("path"), F.array_contains("path", name).alias("cycle")))
        tree = tree.union(level)
    callers = edges.select(F.col("src").alias("node"), F.lit(True).alias("calls")).distinct()
    marked = tree.join(callers, "node", "left")
    return marked.select("entry", "depth", "node", F.array_join("path", ">").alias("path"), "cycle", (F.coalesce("calls", F.lit(False)) & (F.col("depth") == depth) & ~F.col("cycle")).alias("truncated"))


def missing_entries(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that no edge names."""
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return entries.join(names, "node", "left_anti")


def two_hop(edges: DataFrame, most: int = 20, mids: int = 2) -> DataFrame:
    """Callees of callees that are no direct callees: src, dst, in order of the calls, `most` for each src.

    Of one callee's own callees a caller needs the first `most` beyond itself and its direct
    callees, so no more of them than that meet the caller, however many there are. Callees are followed
    in order of their calls: the first `mids` of every caller, then eight times as many of those callers
    that have found fewer than `most` and have callees left, until there are none.
    """
    w = Window.partitionBy("src")
    calls = edges.groupBy("src", "dst").agg(F.min("ordinal").alias("ordinal"))
    # Callees called at once share a rank, so they are followed together.
    calls = checkpointed(calls.withColumns({"place": F.row_number().over(w.orderBy("ordinal", "dst")), "rank": F.rank().over(w.orderBy("ordinal")), "direct": F.count(F.lit(1)).over(w)}))
    last = calls.groupBy("src").agg(F.max("rank").alias("last"))
    b = calls.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("ordinal").alias("o2"), "place")
    open_calls, found = calls, []
    while True:
        a = open_calls.filter(F.col("rank") <= mids).select("src", F.col("dst").alias("mid"), F.col("ordinal").alias("o1"), (F.col("direct") + most + 1).alias("need"))
        met = a.join(b, (a["mid"] == b["mid"]) & (b["place"] <= a["need"])).filter("src <> far").select("src", "far", F.struct("o1", "o2").alias("first"))
        # Direct callees are among the rows, as those without a first way.
        rows = met.unionByName(open_calls.select("src", F.col("dst").alias("far"), F.lit(None).cast(met.schema["first"].dataType).alias("first")))
        far = rows.groupBy("src", "far").agg(F.min("first").alias("first"), F.count_if(F.col("first").isNull()).alias("n")).filter("n = 0")
        top = far.withColumn("k", F.row_number().over(w.orderBy("first", "far"))).filter(F.col("k") <= most)
        top = checkpointed(top.select("src", F.col("far").alias("dst"), "k"))
        few = last.filter(F.col("last") > mids).join(top.groupBy("src").agg(F.max("k").alias("k")), "src", "left").filter(F.coalesce("k", F.lit(0)) < most)
        few = checkpointed(few.select("src"))
        if few.isEmpty():
            found.append(top)
            break
        found.append(top.join(few, "src", "left_anti"))
        last, open_calls = last.join(few, "src", "left_semi"), calls.join(few, "src", "left_semi")
        mids *= 8
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def callers_of(edges: DataFrame) -> DataFrame:
    """The inverted map: callee, its callers sorted."""
    return edges.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("callers"))


def internal_external(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls (src, dst) as internal where the callee is known, else external."""
    names = known.select(F.col("name").alias("dst"), F.lit(True).alias("known")).distinct()
    return calls.join(names, "dst", "left").select("src", "dst", F.when(F.col("known"), F.lit("internal")).otherwise(F.lit("external")).alias("kind"))


def propagated(edges: DataFrame, modules: DataFrame, facts: DataFrame, hops: int | None = 2, most_bridge_calls: int | None = 5) -> DataFrame:
    """function, kind, variable, hop, via, origin: facts of functions and those that reach them along calls.

    `edges` is (src, dst, ordinal), `modules` (name, module), `facts` (function, kind, variable). A fact
    goes from a callee to its caller, each variable once with the least hop: over one edge if the caller's
    module is the callee's or the caller has none, over more only inside one known module and over
    bridges of at most `most_bridge_calls` callees. Names and variables meet without regard to case.
    `via` is the first callee in call order that brings it, `origin` the function that holds it directly
    (the first in order where several do). Each hop joins only what the last one added; without `hops`
    they go on until nothing is added.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    of = modules.select(low("name").alias("name"), F.nullif(F.trim("module"), F.lit("")).alias("module")).dropDuplicates(["name"])
    calls = edges.select(low("src").alias("src"), low("dst").alias("dst"), "ordinal").filter("src <> dst").groupBy("src", "dst").agg(F.min("ordinal").alias("ordinal"))
    side = lambda c: of.select(F.col("name").alias(c), F.col("module").alias(f"{c}_module"))
    width = calls.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("calls"))
    calls = calls.join(side("src"), "src", "left").join(side("dst"), "dst", "left").join(width, "dst", "left")
    calls = checkpointed(calls.filter("src_module is null or src_module = dst_module"))
    own = facts.select(low("function").alias("function"), "kind", low("variable").alias("key"), F.trim("variable").alias("variable")).filter("key <> ''")
    own = own.groupBy("function", "kind", "key").agg(F.min("variable").alias("variable"))
    seen = news = checkpointed(own.select("function", "kind", "key", "variable", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.col("function").alias("origin")))
    k = 0
    while hops is None or k < hops:
        k += 1
        ways = calls if k == 1 else calls.filter("src_module = dst_module" + (f" and calls <= {most_bridge_calls}" if most_bridge_calls is not None else ""))
        # The bridge got the fact inside its own module, so one module holds the whole way.
        met = ways.join((news if k == 1 else news.filter("inside")).withColumnRenamed("function", "dst"), "dst")
        best = met.groupBy(F.col("src").alias("function"), "kind", "key").agg(F.min(F.struct("ordinal", "dst", "origin", "variable", F.coalesce(F.col("src_module") == F.col("dst_module"), F.lit(False)).alias("inside"))).alias("b"))
        fresh = best.join(seen.select("function", "kind", "key"), ["function", "kind", "key"], "left_anti")
        news = checkpointed(fresh.select("function", "kind", "key", "b.variable", F.lit(k).alias("hop"), F.col("b.dst").alias("via"), "b.origin", "b.inside"))
        if news.isEmpty():
            break
        seen = seen.unionByName(news.drop("inside"))
    return seen.drop("key")
