"""Trees by ranges, their updates, strong components and content hashes against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import quillon.graph_queries as queries
from quillon.operators import graph as g
from quillon.operators.components import content_hashes, strong_components
from quillon.operators.graph import Graph
from quillon.operators.ranges import around, below
from quillon.plans import tables
from quillon.sources.forms import read_forms

NODE = "id string, parent_id string, ord bigint, head string, atom string, label string"


def forest(seed: int, n: int = 120, wide: bool = False) -> list[tuple]:
    """Random trees, their ords with gaps, ties and nulls; with `wide` most nodes below one."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        parent = None if k == 0 or rng.random() < 0.08 else "n0" if wide and rng.random() < 0.7 else f"n{rng.randrange(k)}"
        out.append((f"n{k}", parent, rng.choice([None, 1, 2, 5, 9]), rng.choice(["f", "g", "stmt"]), None, f"L{k}"))
    return out


def walked(rows: list[tuple]) -> dict[str, dict]:
    """Preorder places, sizes, tops and statements by recursion."""
    kids: dict = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    out: dict = {}

    def go(r, depth, root, top, stmt, above):
        top, stmt = r[0] if r[3] == "f" else top, r[0] if r[3] == "stmt" else stmt
        mine = out[r[0]] = {"rank": len(out) + 1, "depth": depth, "root_id": root, "top_id": top, "stmt_id": stmt, "above": [*above, r[0]]}
        for k in order(r[0]):
            go(k, depth + 1, root, top, stmt, mine["above"])
        mine["size"] = len(out) - mine["rank"] + 1

    def order(parent):
        return sorted(kids.get(parent, []), key=lambda k: (k[2] is not None, k[2] or 0, k[0]))

    for r in order(None):
        go(r, 0, r[0], None, None, [])
    return out


def indexed(spark, rows, **how):
    edges = spark.createDataFrame([], "src string, dst string, kind string")
    return Graph(spark.createDataFrame(rows, NODE), edges).index(holder=F.col("head") == "f", statement=F.col("head") == "stmt", **how)


@pytest.mark.parametrize(("seed", "wide"), [(1, False), (2, True)])
def test_index_is_the_walk(spark, seed, wide):
    rows = forest(seed, wide=wide)
    want, graph = walked(rows), indexed(spark, rows)
    got = {r.id: r for r in graph.nodes.collect()}
    assert {k: {c: r[c] for c in ("rank", "depth", "root_id", "top_id", "stmt_id", "size")} for k, r in got.items()} == {k: {c: v for c, v in w.items() if c != "above"} for k, w in want.items()}
    tops = spark.createDataFrame([(f"n{k}",) for k in range(0, 120, 3)], "id string")
    pairs = {(r.anc, r.id) for r in below(graph.nodes, tops).collect()}
    assert pairs == {(a, k) for k, w in want.items() for a in w["above"][:-1] if int(a[1:]) % 3 == 0}
    up = around(graph.nodes, graph.nodes.select("id", "rank"), ["id", "depth"])
    assert sorted((r.id, r.node_depth, r.node_id) for r in up.collect()) == sorted((k, d, a) for k, w in want.items() for d, a in enumerate(w["above"]))
    root = max(want, key=lambda k: want[k]["size"])
    assert [r.id for r in graph.definition(root).collect()] == [k for k in sorted(want, key=lambda k: want[k]["rank"]) if root in want[k]["above"]]


def test_deep_and_empty(spark):
    rows = [(f"n{k:02d}", f"n{k - 1:02d}" if k else None, 0, "g", None, None) for k in range(20)]
    graph = indexed(spark, rows)
    assert [(r.rank, r.size) for r in graph.nodes.orderBy("id").collect()] == [(k + 1, 20 - k) for k in range(20)]
    assert indexed(spark, []).nodes.count() == 0
    with pytest.raises(ValueError, match="deeper"):
        Graph(spark.createDataFrame(rows, NODE), graph.edges).index(holder=F.lit(False), statement=F.lit(False), max_depth=5)


def plain(graph):
    """All columns of the index but the ranks, in their order."""
    rows = graph.nodes.select("id", "parent_id", "ord", "head", "depth", "root_id", "top_id", "stmt_id", "rep_id", "size", "in_call", "rank").collect()
    return [tuple(r)[:-1] for r in sorted(rows, key=lambda r: r["rank"])]


def test_updates_equal_a_full_index(spark):
    rows, rng = [(k, p, k_ord if k_ord is not None or p else 0, h, a, label) for k, p, k_ord, h, a, label in forest(5)], random.Random(6)
    graph = indexed(spark, rows, slack=2.0)
    sizes = {r.root_id: r.n for r in graph.nodes.groupBy("root_id").agg(F.count("*").alias("n")).collect()}
    where = {r.id: r.root_id for r in graph.nodes.collect()}
    leaf = next(k for k, p, *_ in rows if p and sizes[where[k]] < 60 and all(q != k for _, q, *_ in rows))
    deleted = graph.update(delete=spark.createDataFrame([(leaf,)], "id string"))
    assert deleted.written == sizes[where[leaf]] - 1 < len(rows) - 1
    assert plain(deleted) == plain(indexed(spark, [r for r in rows if r[0] != leaf]))
    far = next(r for r in graph.nodes.collect() if r.root_id == where[leaf])
    both = deleted.update(insert=spark.createDataFrame([("new", far.id, 1, "stmt", None, "x"), ("new2", "new", 1, "f", None, "y")], NODE), move=spark.createDataFrame([(rng.choice([r.id for r in deleted.nodes.where("depth > 1 AND size < 4").collect()]), far.id, 77)], "id string, new_parent string, new_ord bigint"))
    assert 0 < both.written < len(rows)
    base = both.nodes.select(both.columns)
    assert plain(both) == plain(Graph(base, both.edges).index(holder=F.col("head") == "f", statement=F.col("head") == "stmt"))
    kept = both.nodes.join(graph.nodes.select("id", F.col("rank").alias("was")), "id").where(~F.col("root_id").isin(where[leaf], both.nodes.where("id = 'new'").first().root_id)).where("rank <> was")
    assert kept.where(F.col("root_id").isin([k for k in sizes if k != where[leaf]])).count() <= both.written


def test_an_update_that_outgrows_its_room(spark):
    rows = [("a", None, 1, "f", None, None), ("b", None, 2, "g", None, None), ("c", "a", 1, "g", None, None)]
    graph = indexed(spark, rows)
    new = [(f"x{k}", "a", k, "g", None, None) for k in range(5)]
    grown = graph.update(insert=spark.createDataFrame(new, NODE))
    assert plain(grown) == plain(indexed(spark, [*rows[:2], ("c", "a", 6, "g", None, None), *new]))
    assert {r.id: r.size for r in grown.nodes.collect()}["a"] == 7
    last = graph.update(insert=spark.createDataFrame([("z", None, 9, "f", None, None), ("y", "z", 1, "g", None, None)], NODE))
    assert last.written == 2 and [r[0] for r in plain(last)] == ["a", "c", "b", "z", "y"]
    first = graph.update(insert=spark.createDataFrame([("z", None, 0, "f", None, None)], NODE))
    assert [r[0] for r in plain(first)] == ["z", "a", "c", "b"]
    with pytest.raises(ValueError, match="entities"):
        indexed(spark, rows, entity=F.col("head")).update(delete=spark.createDataFrame([("c",)], "id string"))


def reach(edges, n):
    out = {k: {k} for k in range(n)}
    for k in range(n):
        front = [k]
        while front:
            x = front.pop()
            for a, b in edges:
                if a == x and b not in out[k]:
                    out[k].add(b)
                    front.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng, n = random.Random(seed), 40
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(52)} | {(k, k + 1) for k in range(8)} | {(8, 0), (3, 3)})
    by = reach(edges, n)
    want = {k: max(x for x in by[k] if k in by[x]) for k in range(n) if (k, k) in edges or any(k in by[x] and x != k for x in by[k])}
    got = {r.id: r.component for r in strong_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == want
    assert strong_components(spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")).count() == 0


def hashes(spark, forms, names=()):
    """By name: the hash of each definition of the forms; `names` are the definitions that atoms @x name."""
    graph = read_forms(spark.createDataFrame(list(enumerate(forms)), "unit bigint, text string"))
    tops = graph.nodes.where("parent_id IS NULL").select("id", "label")
    return {r.label: r.hash for r in tops.join(content_hashes(graph), "id").collect()}, graph


CYCLE = ["(defn f (call @g 1))", "(defn g (call @f 2))", "(defn h (call @f))", "(defn alone (x))", "(defn self (call @self))", "(def t 5)"]


def test_a_change_moves_what_names_it(spark):
    was, graph = hashes(spark, CYCLE)
    inner, _ = hashes(spark, ["(defn f (call @g 7))", *CYCLE[1:]][::-1])  # neither order nor ids decide
    assert {k for k in was if was[k] != inner[k]} == {"f", "g", "h"}
    own, _ = hashes(spark, [*CYCLE[:4], "(defn self (call (call @self)))", "(def t 6)"])
    assert {k for k in was if was[k] != own[k]} == {"self", "t"}
    assert len(set(was.values())) == 6
    gone = Graph(graph.nodes.where("NOT (label <=> 'x')"), graph.edges)
    assert content_hashes(gone).count() == gone.nodes.count()


def test_equal_cycles_have_equal_hashes(spark):
    """Rings whose members say the same are one hash a place, whatever their ids; a gap of ords is none."""
    nodes, edges = [], []
    for ring in range(4):
        for k in range(5):
            nodes.append((f"{ring}.{k}", None, ring, "n", str(k if ring < 3 else k % 2), None))
            edges.append((f"{ring}.{k}", f"{ring}.{(k + 1) % 5}", "refers"))
    graph = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src string, dst string, kind string"))
    got = {r.id: r.hash for r in content_hashes(graph).collect()}
    assert all(got[f"0.{k}"] == got[f"1.{k}"] == got[f"2.{k}"] for k in range(5)) and len(set(got.values())) == 10
    tree = [("a", None, 1, "n", None, None), ("b", "a", 1, "n", "x", None), ("c", "a", 9, "n", "y", None), ("d", None, 2, "n", None, None), ("e", "d", 0, "n", "x", None), ("f", "d", 1, "n", "y", None), ("g", None, 2, "n", None, None), ("h", "g", 0, "n", "y", None), ("i", "g", 1, "n", "x", None)]
    got = {r.id: r.hash for r in content_hashes(Graph(spark.createDataFrame(tree, NODE), spark.createDataFrame([("a", "gone", "refers"), ("d", "lost", "refers"), ("g", "lost", "refers")], "src string, dst string, kind string"))).collect()}
    assert got["a"] == got["d"] != got["g"]
    named = content_hashes(graph, F.col("atom") == "0")
    assert named.count() == 20


def test_no_array_holds_a_subtree(spark):
    graph = indexed(spark, forest(3))
    found = graph.follow(graph.nodes.where("depth = 0").select("id"), "inside")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ancestors" not in graph.nodes.columns and "collect_list" not in plan and "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_shared_index_follows_its_tables(spark, sf_dir, tmp_path):
    names = ("region", "nation", "customer", "orders", "supplier", "lineitem")
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    query = queries.query.__globals__["QUERIES"]["graph_contains"]

    def total():
        return query(spark, str(tmp_path)).agg(F.sum("n")).first()[0]

    n = total()
    tables.release(tables.mark())
    assert total() == n
    since = tables.mark()
    del queries._INDEXED
    queries._INDEXED = {}
    assert total() == n
    tables.release(since)
    assert total() == n
    spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("c_custkey", F.col("c_custkey") + 1_000_000).write.mode("append").parquet(f"{tmp_path}/customer.parquet")
    assert total() == 2 * n


def test_reachability_over_updated_graphs(spark):
    graph = indexed(spark, forest(8), slack=1.0)
    cut = graph.update(delete=spark.createDataFrame([("n3",)], "id string"))
    assert g.collect(cut, cut.nodes.where("id = 'n0'").select("id")).nodes.count() == cut.nodes.where("root_id = 'n0'").count()
