import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import graph, relate
from tracelake.plans import catalog, registry


def test_closure_has_no_bound_on_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_ROUNDS", 3, raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert sorted(tuple(r) for r in graph.hops(edges, seeds).collect()) == [(i, i) for i in range(9)]
    assert {r["node"] for r in graph.directed_impact(edges, seeds).collect()} == set(range(9))


def test_components_of_nodes_without_a_module(spark):
    impacted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "node string")
    modules = spark.createDataFrame([("a", "M"), ("b", ""), ("c", None), ("d", "Z"), ("d", "M")], "name string, module string")
    seeds = spark.createDataFrame([("a",), ("x",)], "node string")
    assert sorted(tuple(r) for r in graph.impacted_components(impacted, modules, seeds).collect()) == [("M", 2, 1), ("unknown", 2, 0)]
    assert graph.impacted_components(impacted.limit(0), modules, seeds).count() == 0


def two_hop_slowly(edges, most):
    calls, out = {}, []
    for s, d, o in edges:
        calls.setdefault(s, {})
        calls[s][d] = min(o, calls[s].get(d, o))
    for s, direct in calls.items():
        first = {}
        for mid, o1 in direct.items():
            for far, o2 in calls.get(mid, {}).items():
                if far != s and far not in direct:
                    first[far] = min(first.get(far, (o1, o2)), (o1, o2))
        out += [(s, far, k + 1) for k, (_, far) in enumerate(sorted((f, far) for far, f in first.items())[:most])]
    return sorted(out)


@pytest.mark.parametrize("mids", [1, 2, 50])
def test_two_hops_follow_callees_until_there_are_enough(spark, mids):
    rnd = random.Random(7)
    edges = [(rnd.randrange(30), rnd.randrange(60), rnd.randrange(40)) for _ in range(500)]
    edges += [(100, k, k) for k in range(200, 240)] + [(k, 101, 1) for k in range(200, 240)] + [(239, k, 2) for k in range(300, 330)]  # all that matters stands behind the last callee
    got = graph.two_hop(spark.createDataFrame(edges, "src long, dst long, ordinal long"), 5, mids)
    assert sorted(map(tuple, got.collect())) == two_hop_slowly(edges, 5)


def test_two_hops_do_not_join_every_callee(spark):
    context = spark.sparkContext
    stages = lambda: context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    moved = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    many = spark.range(200).selectExpr("id as src", "explode(sequence(1000L, 1299L)) as dst")
    edges = many.union(many.filter("src = 0").selectExpr("dst as src", "explode(sequence(10000 + dst * 100, 10029 + dst * 100)) as dst")).withColumn("ordinal", F.col("dst"))
    before, limit = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert graph.two_hop(edges, 20).count() == 200 * 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved() - before < 1_200_000  # 69,000 calls, dealt some times a round; all ways are 1,800,000


def most_rows(plan):
    """The most rows that a node of an executed plan gave."""
    metric = plan.metrics().get("numOutputRows")
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    name = plan.getClass().getSimpleName()
    below += [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    return max([metric.get().value() if metric.isDefined() else 0, *map(most_rows, below)])


def test_a_function_meets_a_requirement_of_its_component_once(spark):
    requirements = spark.range(5).selectExpr("concat('SwTR_', id) as req_id")
    functions = spark.range(100).selectExpr("concat('f', id) as name", "'c' as component", "cast(null as string) as related")
    designs = spark.range(3000).selectExpr("'c' as component", "concat('SwTR_', id % 6) as req_id")
    found = relate.requirement_functions(requirements, functions, designs)
    assert len(found.collect()) == 500
    assert most_rows(found._jdf.queryExecution().executedPlan()) <= 3000


def test_edges_are_computed_once_for_all_hops(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.range(0, 8, 1, 1).selectExpr("id as src", "id + 1 as dst").mapInArrow(count, "src long, dst long")
    seeds = spark.createDataFrame([(4,)], "node long")
    assert sorted(r["node"] for r in graph.directed_impact(edges, seeds).collect()) == list(range(9))
    assert seen.value == 8


def test_edges_stand_in_as_many_parts_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_A_PART", 500)
    settled = []
    monkeypatch.setattr(graph, "checkpointed", lambda df: settled.append(df.checkpoint()) or settled[-1])
    for name in ("bfs_hops", "impact_groups", "directed_impact"):
        settled.clear()
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert settled[0].rdd.getNumPartitions() == 12, name  # 6,000 lines


def test_a_frontier_too_large_to_be_sent_meets_the_edges_in_parts(spark, monkeypatch):
    edges = spark.range(0, 300).selectExpr("id div 3 as src", "id + 1 as dst")
    seeds = spark.createDataFrame([(0,)], "node long")
    want = sorted(map(tuple, graph.hops(edges, seeds).collect()))
    sent = []
    broadcast = graph.F.broadcast
    monkeypatch.setattr(graph.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    assert sorted(map(tuple, graph.hops(edges, seeds, parts=9).collect())) == want and sent
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    sent.clear()
    assert sorted(map(tuple, graph.hops(edges, seeds, parts=9).collect())) == want and not sent


def test_groups_are_whole_however_many_functions_the_first_hop_brings(spark, tmp_path):
    import duckdb

    calls = [(k, 0, k) for k in range(1, 61)] + [(100 + k, k, 1000 + k) for k in range(1, 61)]  # order, caller, called
    rows = [(order, line, part, 1) for order, *pair in calls for line, part in enumerate(pair, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "b") for p in {r[2] for r in rows}], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    want = [("0", "direct"), *((str(k), "indirect_1hop") for k in range(1, 61)), *((str(1000 + k), "indirect_2hop") for k in range(1, 61))]
    assert sorted((r["node"], r["group"]) for r in catalog.QUERIES["impact_groups"](spark, str(tmp_path)).collect()) == sorted(want)
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(catalog.ORACLE_SQL["impact_groups"]).fetchall()) == sorted(want)
