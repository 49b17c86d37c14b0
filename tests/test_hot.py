"""Edges that nearly all lead to one node, on tables too large to be broadcast."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import components
from quillon.operators.graph import Graph

N = 20_000


@pytest.fixture
def hot(spark):
    """Uses of one declaration, all of one type; what is beyond 20,000 bytes isn't broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "20000")
    none = F.lit(None).cast("string")
    row = lambda df, head: df.select("id", none.alias("parent_id"), F.lit(1).cast("bigint").alias("ord"), F.lit(head).alias("head"), none.alias("atom"), none.alias("label"))
    uses = spark.range(N).select(F.concat(F.lit("u"), "id").alias("id"))
    one = lambda name: spark.range(1).select(F.lit(name).alias("id"))
    nodes = row(uses, "use").unionByName(row(one("d"), "def")).unionByName(row(one("t"), "type"))
    edges = uses.select(F.col("id").alias("src"), F.lit("d").alias("dst"), F.lit("refers").alias("kind"))
    edges = edges.unionByName(uses.select(F.col("id").alias("src"), F.lit("t").alias("dst"), F.lit("typed").alias("kind")))
    yield Graph(nodes, edges).index(holder=F.lit(False), statement=F.lit(False))
    spark.conf.set(key, was)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_send_no_hot_target_to_one_task(hot):
    every, few = hot.nodes.select("id"), hot.nodes.where("head <> 'use'").select("id")
    for roots, step, n in ((every, "typed<", N), (every, "refers<", N), (few, "refers<", N)):
        found = hot.follow(roots, step)
        assert "SortMergeJoin" not in plan(found) and found.count() == n
    found = hot.follow(every, "refers")  # by the uses, each of which has one
    assert plan(found).count("SortMergeJoin") == 1 and found.count() == N
    assert {r.node for r in found.select("node").distinct().collect()} == {"d"}


def test_dangling_sends_no_hot_target_to_one_task(spark, hot):
    gone = Graph(hot.nodes.where("head <> 'def'"), hot.edges.unionByName(spark.createDataFrame([("u1", None, "refers")], hot.edges.schema)))
    found = gone.dangling()
    assert "SortMergeJoin" not in plan(found) and found.count() == N + 1
    left = gone.fall_out(lambda graph, bad: bad.where("src <> 'u0' OR dst IS NOT NULL").select(F.col("src").alias("id")))
    assert left.nodes.count() == 1 and left.edges.isEmpty()


def test_content_hashes_send_no_hot_target_to_one_task(hot, monkeypatch):
    seen = []

    def materialise(df, what="table", write=components.materialise):
        seen.append((what, plan(df)))
        return write(df, what)

    monkeypatch.setattr(components, "materialise", materialise)
    got = components.content_hashes(hot).join(hot.nodes, "id").groupBy("head").agg(F.count("*"), F.count_distinct("hash")).collect()
    assert sorted(map(tuple, got)) == [("def", 1, 1), ("type", 1, 1), ("use", N, 1)]
    (deps,) = [p for what, p in seen if what == "deps"]
    bags = [p for what, p in seen if what == "bags"]
    assert "SortMergeJoin [dep" not in deps and len(bags) > 1 and all("BroadcastHashJoin" in p for p in bags)


@pytest.mark.parametrize("ring", [1, 3])
def test_only_what_is_on_cycles_or_between_is_hashed_as_units(spark, monkeypatch, ring):
    """Two rings with a node between them, and 40 nodes above: these are hashed as any others."""
    names = [f"{r}{k}" for r in "ab" for k in range(ring)]
    edges = [(f"{r}{k}", f"{r}{(k + 1) % ring}") for r in "ab" for k in range(ring)] + [("a0", "between"), ("between", "b0"), ("b0", "leaf")]
    edges += [(f"x{k}", "a0" if k < 20 else f"x{k - 20}") for k in range(40)] + [("x0", "leaf")]
    names += ["between", "leaf", *(f"x{k}" for k in range(40))]
    graph = Graph(spark.createDataFrame([(x, None, 1, "n", None, None) for x in names], "id string, parent_id string, ord bigint, head string, atom string, label string"), spark.createDataFrame([(a, b, "refers") for a, b in edges], "src string, dst string, kind string"))
    seen = []

    def units(open_, *rest, made=components._units):
        seen.append(open_.count())
        return made(open_, *rest)

    monkeypatch.setattr(components, "_units", units)
    got = {r.id: r.hash for r in components.content_hashes(graph).collect()}
    assert seen == [2 * ring + 1] and set(got) == set(names)
    assert len({got[f"x{k}"] for k in range(1, 20)}) == 1 and len({got[f"x{k}"] for k in range(21, 40)}) == 1
    assert len({got[x] for x in ("x0", "x1", "x20", "x21", "between", "leaf", "a0", "b0")}) == 8
