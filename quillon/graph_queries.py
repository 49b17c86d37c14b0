"""Queries of the graph, text, store, job and stream operators, over graphs and buffers derived from
the relational tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import fixpoints
from quillon.operators import graph as g
from quillon.operators import text as tx
from quillon.operators import views
from quillon.operators.graph import Graph
from quillon.operators.seq import Seq
from quillon.plans.jobs import Phase, Plan
from quillon.plans.journal import Journal
from quillon.plans.ordering import number_rows
from quillon.plans.tables import materialise, new_path, released, stamps
from quillon.sources import forms
from quillon.sources.forms import read_edn, read_forms, write_forms
from quillon.sources.store import Conflict, UnitStore, new_units
from quillon.streaming.changes import Channel, Versions, apply_changes, current, maintain, running_state

from .queries import query

_NODE = ["id", "parent_id", "ord", "head", "atom", "label"]


def _rows(df: DataFrame, prefix: str, key: str, head: str, parent: tuple[str, str] | None = None, label: str | None = None) -> DataFrame:
    up = F.concat(F.lit(parent[0]), F.col(parent[1]).cast("string")) if parent else F.lit(None).cast("string")
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), up.alias("parent_id"), F.col(key).cast("bigint").alias("ord"), F.lit(head).alias("head"), F.lit(None).cast("string").alias("atom"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"))


def tables_graph(t, deep: bool = False) -> Graph:
    """region > nation > customer > orders (> lineitem, with deep); customers and orders refer to
    suppliers of their nation, and lineitems to part and supplier; all are typed by their table."""
    nodes = _rows(t("region"), "r", "r_regionkey", "region", None, "r_name")
    nodes = nodes.unionByName(_rows(t("nation"), "n", "n_nationkey", "nation", ("r", "n_regionkey"), "n_name"))
    nodes = nodes.unionByName(_rows(t("customer"), "c", "c_custkey", "customer", ("n", "c_nationkey"), "c_name"))
    nodes = nodes.unionByName(_rows(t("orders"), "o", "o_orderkey", "orders", ("c", "o_custkey")))
    nodes = nodes.unionByName(_rows(t("supplier"), "s", "s_suppkey", "supplier", None, "s_name"))
    types = nodes.select("head").distinct().select(F.concat(F.lit("t:"), "head").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("bigint").alias("ord"), F.lit("type").alias("head"), F.lit(None).cast("string").alias("atom"), F.col("head").alias("label"))
    edges = nodes.select(F.col("id").alias("src"), F.concat(F.lit("t:"), "head").alias("dst"), F.lit("typed").alias("kind"))
    uses = t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("s"), F.col("o_orderkey") % 10).alias("dst"), F.lit("refers").alias("kind"))
    if deep:
        lines = t("lineitem").withColumn("k", F.concat_ws(".", "l_orderkey", "l_linenumber"))
        nodes = nodes.unionByName(lines.select(F.concat(F.lit("l"), "k").alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_id"), F.col("l_linenumber").cast("bigint").alias("ord"), F.lit("lineitem").alias("head"), F.lit(None).cast("string").alias("atom"), F.lit(None).cast("string").alias("label")))
        uses = uses.unionByName(lines.select(F.concat(F.lit("l"), "k").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("refers").alias("kind")))
    return Graph(nodes.unionByName(types), edges.unionByName(uses))


#: Indexed graphs by session, the files of their tables, and kind: an index is built once and read by every
#: view, until release() removes it or a table changes.
_INDEXED: dict[tuple, Graph] = {}
_TABLES = ("region", "nation", "customer", "orders", "supplier", "lineitem")


def _once(t, kind: str, build) -> Graph:
    frames = [t(name) for name in _TABLES]
    key = (frames[0].sparkSession.sparkContext.applicationId, released(), stamps(frames), kind)
    if key not in _INDEXED:
        for old in [k for k in _INDEXED if k[:2] != key[:2]]:
            del _INDEXED[old]
        _INDEXED[key] = build(t)
    return _INDEXED[key]


def indexed(t, deep: bool = False) -> Graph:
    return _once(t, "deep" if deep else "flat", lambda t: _index(t, deep))


def _index(t, deep: bool) -> Graph:
    graph = tables_graph(t, deep)
    return graph.index(holder=F.col("head").isin("customer", "supplier"), statement=F.col("head") == "orders", call=(F.col("head") == "orders") & (F.col("ord") % 3 == 0))


@query("SELECT 'r' || n_regionkey AS root, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def graph_contains(t):
    graph = indexed(t)
    return graph.follow(graph.nodes.where("head = 'region'").select("id"), "contains contains").groupBy("root").agg(F.count("*").alias("n"))


@query("SELECT 'n' || c_nationkey AS root, count(DISTINCT c_custkey) + count(DISTINCT o_orderkey) + count(DISTINCT l_orderkey * 100 + l_linenumber) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def graph_inside(t):
    graph = indexed(t, deep=True)
    return graph.follow(graph.nodes.where("head = 'nation'").select("id"), "inside").groupBy("root").agg(F.count("*").alias("n"))


@query("SELECT 's' || o_orderkey % 10 AS root, 'c' || o_custkey AS node, count(*) AS uses FROM orders GROUP BY ALL")
def graph_refers_in(t):
    graph = indexed(t)
    found = graph.hits(graph.follow(graph.nodes.where("head = 'supplier'").select("id"), "refers< ^fn"))
    return found.select("root", "node", F.size("via").cast("bigint").alias("uses"))


@query("SELECT 'c' || o_custkey AS root, 's' || o_orderkey % 10 AS node, count(*) AS uses FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL")
def graph_callees(t):
    graph = indexed(t)
    rows = graph.callees(graph.nodes.where("head = 'customer'").select("id"), 2)
    return rows.select("root", "node", F.size("via").cast("bigint").alias("uses"))


@query("SELECT 's' || o_orderkey % 10 AS root, CASE WHEN o_orderkey % 3 = 0 THEN 'call' ELSE 'read' END AS access, count(*) AS n, count(DISTINCT o_custkey) AS forms FROM orders GROUP BY ALL")
def graph_uses_tally(t):
    graph = indexed(t)
    return graph.tally(graph.nodes.where("head = 'supplier'").select("id"), F.when(F.col("in_call"), "call").otherwise("read"))


@query("SELECT 't:' || h AS type, h AS head, n FROM (SELECT 'region' AS h, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier)")
def graph_type_view(t):
    graph = indexed(t)
    return graph.type_view(graph.nodes.where("head = 'type'").select("id"))


@query("SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS form FROM orders")
def graph_contexts(t):
    graph = indexed(t)
    return graph.contexts(graph.nodes.where("head = 'orders'").select("id"), "fn").select(F.explode("uses").alias("id"), "form")


@query("SELECT 1 AS depth, 's' || o_orderkey % 10 AS root, 'c' || o_custkey AS node, count(*) AS uses FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL")
def graph_callers_d2(t):
    graph = indexed(t)
    roots = graph.nodes.where("head = 'supplier'").select("id")
    return graph.callers(roots, 2).select("depth", "root", "node", F.size("via").cast("bigint").alias("uses"))


_STEPS = "SELECT s_suppkey AS a, (s_suppkey * 7 + s_nationkey) % (SELECT count(*) FROM supplier) AS b FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier) FROM supplier WHERE s_suppkey % 4 = 0"


def _steps(t) -> DataFrame:
    s = t("supplier").crossJoin(F.broadcast(t("supplier").agg(F.count("*").alias("n")))).select(F.col("s_suppkey").alias("k"), "s_nationkey", "n")
    rows = s.select(F.col("k").alias("src"), ((F.col("k") * 7 + F.col("s_nationkey")) % F.col("n")).alias("dst"))
    return rows.unionByName(s.where("k % 4 = 0").select(F.col("k").alias("src"), ((F.col("k") * 3 + 1) % F.col("n")).alias("dst")))


@query(f"WITH RECURSIVE e AS ({_STEPS}), r(seed, id) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT seed, b FROM r JOIN e ON a = id) SELECT seed, id FROM r")
def graph_closure(t):
    seeds = t("supplier").select(F.col("s_suppkey").alias("seed"), F.col("s_suppkey").alias("id"))
    return g.closure(seeds, _steps(t))


@query(f"WITH RECURSIVE e AS ({_STEPS}), r(id) AS (SELECT 0::BIGINT UNION SELECT b FROM r JOIN e ON a = id) SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM r)")
def graph_unreachable(t):
    nodes = t("supplier").select(F.col("s_suppkey").alias("id"))
    return g.unreachable(nodes, nodes.where("id = 0"), _steps(t))


@query("SELECT 'o' || o_orderkey AS src, 's' || o_orderkey % 10 AS dst FROM orders WHERE o_orderkey % 10 < 7")
def graph_dangling(t):
    return _without(t).dangling().where("kind = 'refers'").select("src", "dst")


def _without(t) -> Graph:
    graph = indexed(t)
    return graph.delete(graph.nodes.where("head = 'supplier' AND ord < 7").select("id"))


@query("SELECT count(*) AS orders FROM orders WHERE o_orderkey % 10 >= 7")
def graph_fall_out(t):
    left = _without(t).fall_out(lambda graph, bad: bad.select(F.col("src").alias("id")))
    return left.nodes.where("head = 'orders'").agg(F.count("*").alias("orders"))


@query("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM supplier) + 5 AS nodes, (SELECT count(*) FROM orders) AS refers, 0::BIGINT AS dangling")
def graph_census(t):
    return tables_graph(t).census().select("nodes", "refers", "dangling")


_V2 = "SELECT c_custkey AS id, c_name AS label, c_mktsegment || CASE WHEN c_custkey % 11 = 0 THEN '!' ELSE '' END AS h FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey + 1000000, 'new' || c_custkey, c_mktsegment FROM customer WHERE c_custkey % 13 = 0"


@query(f"SELECT CASE WHEN b.id IS NULL THEN 'removed' WHEN a.c_custkey IS NULL THEN 'added' WHEN c_mktsegment = h THEN 'kept' ELSE 'changed' END AS change, count(*) AS n FROM customer a FULL JOIN ({_V2}) b ON c_custkey = id AND c_name = label GROUP BY 1")
def graph_diff(t):
    c = t("customer")
    a = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("hash"), F.col("c_custkey").alias("ord"))
    b = a.where("id % 7 <> 0").withColumn("hash", F.concat("hash", F.when(F.col("id") % 11 == 0, "!").otherwise("")))
    b = b.unionByName(a.where("id % 13 = 0").select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("new"), "id").alias("label"), "hash", "ord"))
    return g.compare_units(a, b).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation, count(DISTINCT n) AS shapes FROM (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1")
def graph_hash(t):
    graph = indexed(t)
    plain = Graph(graph.nodes.withColumn("atom", F.lit(None).cast("string")), graph.edges, True)
    hashes = g.form_hashes(plain)
    rows = plain.nodes.where("head = 'customer'").join(hashes, "id")
    return rows.groupBy(F.substring("parent_id", 2, 10).cast("int").alias("nation")).agg(F.count_distinct("hash").alias("shapes"))


_HEADS = "SELECT 'r' || r_regionkey AS id, 'region' AS head, NULL AS up FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'orders', 'c' || o_custkey FROM orders UNION ALL SELECT 's' || s_suppkey, 'supplier', NULL FROM supplier"


@query(f"SELECT step, root, node FROM (SELECT 'typed' AS step, id AS root, 't:' || head AS node FROM ({_HEADS}) UNION ALL SELECT 'typed<', 't:' || head, id FROM ({_HEADS}) UNION ALL SELECT 'contains<', id, up FROM ({_HEADS}) WHERE up IS NOT NULL UNION ALL SELECT '^stmt', 'o' || o_orderkey, 'o' || o_orderkey FROM orders UNION ALL SELECT '^fn', 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'refers', 'o' || o_orderkey, 's' || o_orderkey % 10 FROM orders)")
def graph_steps(t):
    graph = indexed(t)
    nodes, orders = graph.nodes.select("id"), graph.nodes.where("head = 'orders'").select("id")
    roots = {"typed": nodes, "typed<": nodes, "contains<": nodes, "^stmt": orders, "^fn": orders, "refers": orders}
    rows = [graph.follow(r, step).select(F.lit(step).alias("step"), "root", "node") for step, r in roots.items()]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT 'n1' AS id, 1 + count(DISTINCT c_custkey) + count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 1 UNION ALL SELECT 'c' || c_custkey, 1 FROM customer WHERE c_name = (SELECT min(c_name) FROM customer) UNION ALL SELECT 'o' || min(o_orderkey), 1 FROM orders UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_name = (SELECT min(c_name) FROM customer)")
def graph_find(t):
    """definition() of a node, find() by label, by #id and by a member's path."""
    graph = indexed(t)
    least = graph.nodes.where("head = 'customer'").agg(F.min("label")).first()[0]
    inside = graph.nodes.where(F.col("label") == least).select(F.col("parent_id").alias("id")).join(graph.nodes, "id").first().label
    order = graph.nodes.where("head = 'orders'").agg(F.min("ord")).first()[0]
    rows = [graph.definition("n1").agg(F.lit("n1").alias("id"), F.count("*").alias("n"))]
    rows += [graph.find(what).select("id", F.lit(n).cast("bigint").alias("n")) for what, n in ((least, 1), (f"#o{order}", 1), (f"{inside}.{least}", 2))]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT 'r' || r_regionkey AS id, r_regionkey::BIGINT + 1 AS ord FROM region UNION ALL SELECT 'new', 0")
def graph_insert(t):
    graph = tables_graph(t)
    new = graph.nodes.sparkSession.createDataFrame([("new", None, 0, "region", None, "new")], "id string, parent_id string, ord bigint, head string, atom string, label string")
    return graph.insert(new).nodes.where("head = 'region'").select("id", "ord")


@query("SELECT c_mktsegment || '!' AS atom, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def graph_replace(t):
    graph = tables_graph(t)
    names = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    marked = Graph(graph.nodes.join(names, "id", "left"), graph.edges)
    done = marked.replace(marked.nodes.where("head = 'customer' AND ord % 2 = 0").select("id"), F.concat("segment", F.lit("!")))
    return done.nodes.where("atom IS NOT NULL").groupBy("atom").agg(F.count("*").alias("n"))


@query("SELECT 's' || CASE WHEN o_orderkey % 10 < 3 THEN 9 ELSE o_orderkey % 10 END AS dst, count(*) AS n FROM orders GROUP BY 1")
def graph_retarget(t):
    graph = tables_graph(t)
    moves = graph.nodes.sparkSession.createDataFrame([("s0", "s9"), ("s1", "s9"), ("s2", "s9")], "old string, new string")
    return graph.retarget(moves).edges.where("kind = 'refers'").groupBy("dst").agg(F.count("*").alias("n"))


@query("SELECT 'n' || CASE WHEN c_nationkey % 2 = 1 THEN 0 ELSE c_nationkey END AS parent_id, count(*) AS n, sum(CASE WHEN c_nationkey % 2 = 1 THEN c_custkey + 1000000 ELSE c_custkey END)::BIGINT AS ords FROM customer GROUP BY 1")
def graph_move(t):
    graph = tables_graph(t)
    odd = graph.nodes.where("head = 'customer' AND CAST(substring(parent_id, 2) AS INT) % 2 = 1")
    moved = graph.move(odd.select("id", F.lit("n0").alias("new_parent"), (F.col("ord") + 1_000_000).alias("new_ord")))
    return moved.nodes.where("head = 'customer'").groupBy("parent_id").agg(F.count("*").alias("n"), F.sum("ord").alias("ords"))


@query("WITH o AS (SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0) SELECT 'region' AS head, 1 AS n UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'supplier', count(DISTINCT o_orderkey % 10) FROM o UNION ALL SELECT 'type', 5")
def graph_collect(t):
    graph = indexed(t)
    return g.collect(graph, graph.nodes.where("id = 'r0'").select("id")).nodes.groupBy("head").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE e AS ({_STEPS}), bad(id) AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 = 5 UNION SELECT a FROM e JOIN bad ON b = id) SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM bad)")
def graph_greatest_fixpoint(t):
    """The largest set of suppliers, without every eleventh, whose steps all stay in it."""
    steps = _steps(t).select(F.col("src").alias("id"), "dst")
    candidates = t("supplier").where("s_suppkey % 11 <> 5").select(F.col("s_suppkey").alias("id"))
    return g.greatest_fixpoint(candidates, lambda now: steps.join(now, "id").join(now.select(F.col("id").alias("dst")), "dst", "left_anti"))


@query(f"WITH RECURSIVE e AS ({_STEPS}), r(id, d) AS (SELECT 0::BIGINT, 0 UNION SELECT b, d + 1 FROM r JOIN e ON a = id WHERE d < 200) SELECT id, min(d) AS depth FROM r GROUP BY 1")
def graph_reachable(t):
    return g.reachable(t("supplier").where("s_suppkey = 0").select(F.col("s_suppkey").alias("id")), _steps(t)).select("id", "depth")


@query("SELECT c_nationkey AS nation, count(DISTINCT n) AS shapes FROM (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1")
def graph_content_hashes(t):
    graph = indexed(t)
    rows = graph.nodes.where("head = 'customer'").join(g.content_hashes(graph), "id")
    return rows.groupBy(F.substring("parent_id", 2, 10).cast("int").alias("nation")).agg(F.count_distinct("hash").alias("shapes"))


@query("SELECT true AS same, true AS differs, (SELECT count(*) FROM orders)::BIGINT AS fresh")
def graph_same(t):
    graph = tables_graph(t)
    cut = Graph(graph.nodes.where("head <> 'region'"), graph.edges)
    most = graph.nodes.where("head = 'orders'").select(F.col("ord").alias("id"))
    numbered = Graph(most, graph.edges).fresh_ids(most.withColumnRenamed("id", "old"), ["old"])
    fresh = numbered.join(most, "id", "left_anti").select("id").distinct().count()
    return graph.nodes.sparkSession.createDataFrame([(graph.same(graph), not graph.same(cut), fresh)], "same boolean, differs boolean, fresh bigint")


_CALLS = "WITH e AS (SELECT p_partkey AS a, p_partkey * 7 % (SELECT count(*) FROM part) AS b FROM part), roots AS (SELECT p_partkey AS id FROM part WHERE p_size = 1), d1 AS (SELECT 1 AS depth, b AS root, a AS node FROM e WHERE b IN (SELECT id FROM roots)), d2 AS (SELECT 2, b, a FROM e WHERE b IN (SELECT node FROM d1) AND b NOT IN (SELECT id FROM roots)) "


@query(_CALLS + "SELECT depth, 'p' || root AS root, 'p' || node AS node FROM (FROM d1 UNION ALL FROM d2) WHERE root IN (SELECT p_partkey FROM part)")
def graph_callers_code(t):
    """Functions that call one another, read from their text: callers of the smallest parts to a depth
    of two."""
    p = t("part").crossJoin(F.broadcast(t("part").agg(F.count("*").alias("n"))))
    text = F.format_string("(defn p%d (body (call @p%d)))", "p_partkey", F.col("p_partkey") * 7 % F.col("n"))
    graph = read_forms(p.select(F.col("p_partkey").alias("unit"), text.alias("text")), places=True)
    code = replace(graph, nodes=graph.nodes.withColumn("is_call", F.col("atom").startswith("@"))).index(holder=F.col("parent_id").isNull(), statement=F.col("head") == "call", call=F.col("is_call"))
    small = t("part").where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("label"))
    rows = code.callers(code.nodes.where("parent_id IS NULL").join(small, "label").select("id"), 2)
    names = code.nodes.where("parent_id IS NULL").select("id", "label")
    rows = rows.select("depth", F.col("root").alias("id"), "node").join(names, "id").select("depth", F.col("label").alias("root"), F.col("node").alias("id"))
    return rows.join(names, "id").select("depth", "root", F.col("label").alias("node"))


# -- views of code -------------------------------------------------------------------------------

#: What the function of an order does with the object of its last digit, and what that is.
_USES = (
    ("(= {0} 1)", "write", "atom"), ("(= x {0})", "read", "atom"), ("(+= {0} 1)", "update", "atom"), ("(post++ {0})", "update", "atom"), ("(addr (paren {0}))", "addr", "atom"), ("(sizeof {0})", "unevaluated", "atom"),
    ("(= (paren {0}) 1)", "write", "atom"), ("(addr (-> p {0}))", "addr", "->"), ("(= (-> {0} m) 1)", "read", "atom"), ("(at {0} 3)", "init", "at"), ("(= (index {0} 1) 2)", "write", "atom"), ("(call {0} 1)", "call", "call"), ("(= (. {0} m) 2)", "write", "atom"),
)


def _cases(column: int) -> str:
    return " ".join(f"WHEN {k} THEN '{use[column]}'" for k, use in enumerate(_USES))


def _uses_graph(t) -> Graph:
    """A function for each order and ten objects, of which the first five are arrays."""
    order = F.col("o_orderkey")
    name = F.concat(F.lit("@s"), (order % 10).cast("string"))
    form = reduce(lambda acc, k: F.when(order % len(_USES) == k, F.concat(*(F.lit(x) if x else name for x in _USES[k][0].replace("{0}", "|{0}|").replace("{0}", "").split("|")))).otherwise(acc), range(len(_USES)), F.lit(None).cast("string"))
    functions = t("orders").select((order.cast("bigint") + 100).alias("unit"), F.concat(F.lit("(defn f"), order.cast("string"), F.lit(" "), form, F.lit(")")).alias("text"))
    spark = functions.sparkSession
    objects = spark.range(10).select(F.col("id").alias("unit"), F.format_string("(def s%d)", "id").alias("text"))
    graph = read_forms(functions.unionByName(objects).unionByName(objects.limit(1).select(F.lit(50).cast("bigint").alias("unit"), F.lit("(array 10)").alias("text"))), places=True)
    typed = spark.range(5).select(F.concat("id", F.lit(".0")).alias("src"), F.lit("50.0").alias("dst"), F.lit("typed").alias("kind"))
    called = (F.col("above") == "call") & (F.col("ord") == 1)
    code = replace(graph, nodes=graph.nodes.withColumn("called", called), edges=graph.edges.unionByName(typed))
    return code.index(holder=F.col("parent_id").isNull(), statement=F.col("parent_id").isNull(), call=F.col("called"))


@query(f"SELECT 's' || k % 10 AS root, CASE WHEN k % {len(_USES)} = 10 AND k % 10 >= 5 THEN 'read' ELSE CASE k % {len(_USES)} {_cases(1)} END END AS access, count(*) AS n, count(*) AS forms FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1, 2")
def graph_access(t):
    code = _once(t, "uses", _uses_graph)
    objects = code.nodes.where("head = 'def'").select("id", "label")
    rows = views.tally(code, objects.select("id")).withColumnRenamed("root", "id").join(objects, "id")
    return rows.select(F.col("label").alias("root"), "access", "n", "forms")


@query(f"SELECT CASE o_orderkey % {len(_USES)} {_cases(2)} END AS form, count(*) AS n FROM orders GROUP BY 1")
def graph_use_forms(t):
    code = _once(t, "uses", _uses_graph)
    found = views.use_forms(code, code.nodes.where("atom LIKE '@s%'"))
    return found.groupBy(F.coalesce("form_head", F.lit("atom")).alias("form")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT p_partkey AS k, count(*) OVER () AS n FROM part) SELECT k || '.0' AS type, 'members' AS section, k || '.0.2' AS node, 'write' AS access, 1 AS n FROM p UNION ALL SELECT k || '.0', 'members', k || '.0.3.0.1', NULL, 0 FROM p UNION ALL SELECT k || '.0', 'taking', (n + k) || '.0', NULL, 1 FROM p UNION ALL SELECT k * 7 % n || '.0', 'returning', (n + k) || '.0', NULL, 1 FROM p WHERE k * 7 % n IN (SELECT k FROM p) UNION ALL SELECT (k + 1) % n || '.0', 'held-in', k || '.0.3.0.1', NULL, 1 FROM p WHERE (k + 1) % n IN (SELECT k FROM p) UNION ALL SELECT k || '.0', 'objects', (3 * n + k) || '.0', NULL, 1 FROM p WHERE k % 2 = 0")
def graph_type_report(t):
    """Every part a struct with a member and one of an unnamed struct within; a function takes a pointer
    to it, returns another and writes the member; every second has an object."""
    p = t("part").crossJoin(F.broadcast(t("part").agg(F.count("*").alias("n")))).select(F.col("p_partkey").cast("bigint").alias("k"), "n")
    structs = p.select(F.col("k").alias("unit"), F.format_string("(struct p%d (member size) ((struct (member other))))", "k").alias("text"))
    functions = p.select((F.col("n") + F.col("k")).alias("unit"), F.format_string("(defn f%d (param a) (result r) (= (-> x size) 1))", "k").alias("text"))
    pointers = p.select((F.col("n") * 2 + F.col("k")).alias("unit"), F.lit("(pointer)").alias("text"))
    objects = p.where("k % 2 = 0").select((F.col("n") * 3 + F.col("k")).alias("unit"), F.format_string("(def d%d)", "k").alias("text"))
    graph = read_forms(reduce(DataFrame.unionByName, [structs, functions, pointers, objects]), places=True)

    def edge(kind: str, src: str, dst: str, where: str = "true") -> DataFrame:
        return p.where(where).select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(kind).alias("kind"))

    edges = [
        edge("refers", "concat(n + k, '.0.4.1.2')", "concat(k, '.0.2')"),
        edge("typed", "concat(n + k, '.0.2')", "concat(2 * n + k, '.0')"),
        edge("typed", "concat(2 * n + k, '.0')", "concat(k, '.0')"),
        edge("typed", "concat(n + k, '.0.3')", "concat(k * 7 % n, '.0')"),
        edge("typed", "concat(k, '.0.3.0.1')", "concat((k + 1) % n, '.0')"),
        edge("typed", "concat(3 * n + k, '.0')", "concat(k, '.0')", "k % 2 = 0"),
    ]
    code = replace(graph, edges=reduce(DataFrame.unionByName, edges)).index(holder=F.col("parent_id").isNull(), statement=F.lit(False))
    return views.type_report(code, code.nodes.where("head = 'struct' AND parent_id IS NULL"))


def _forms(t) -> DataFrame:
    p = t("part")
    text = F.format_string('(def p%d (size %d) (brand "%s") (next @p%d))', "p_partkey", "p_size", "p_brand", F.col("p_partkey") + 1)
    return p.select(F.col("p_partkey").alias("unit"), text.alias("text"))


@query("SELECT p_partkey AS unit, p_size::VARCHAR AS size FROM part WHERE p_size > 40")
def graph_pattern(t):
    graph = read_forms(_forms(t))
    found = g.match(graph, "(def _ (size ?x) _*)")
    atoms = graph.nodes.select(F.col("id").alias("x"), F.col("atom").alias("size"), "unit")
    return found.join(atoms, "x").where("try_cast(size AS int) > 40").select("unit", "size")


@query("SELECT p_partkey AS unit, '(def p' || p_partkey || ' (size ' || p_size || ') (brand \"' || p_brand || '\") (next @p' || (p_partkey + 1) || '))' AS text FROM part")
def graph_forms_round_trip(t):
    graph = read_forms(_forms(t), places=True)
    printed = write_forms(graph.index(holder=F.col("parent_id").isNull(), statement=F.lit(False)))
    return printed.where("parent_id IS NULL").select(F.split("id", "\\.")[0].cast("bigint").alias("unit"), "text")


@query("SELECT p_partkey, p_size, p_brand FROM part")
def edn_read(t):
    edn = F.format_string('{:size %d, :brand "%s" :tags #{:a :b}}', "p_size", "p_brand")
    rows = read_edn(t("part").select("p_partkey", edn.alias("edn")), "edn", "struct<size:int,brand:string,tags:array<string>>")
    return rows.select("p_partkey", F.col("value.size").alias("p_size"), F.col("value.brand").alias("p_brand"))


# -- text ------------------------------------------------------------------------------------


def _buffers(t) -> DataFrame:
    return tx.open_buffers(t("documents").where("text IS NOT NULL"), "doc_id", "text")


_LINES = "WITH parts AS (SELECT doc_id AS buf, string_split(text, chr(10)) AS p FROM documents), lines AS (SELECT buf, k AS ln, p[k] AS line FROM parts, unnest(range(1, len(p) + 1)) AS t(k)) "


@query(_LINES + "SELECT buf, ln, regexp_replace(line, 'the|and', 'X', 'g') AS line FROM lines")
def text_substitute(t):
    return tx.substitute(_buffers(t), r"the\|and", "X")


@query(_LINES + "SELECT buf, ln, CASE WHEN ln BETWEEN 2 AND 4 THEN regexp_replace(line, '([a-z]+) ([a-z]+)', '\\2-\\1') ELSE line END AS line FROM lines")
def text_substitute_first(t):
    return tx.substitute(_buffers(t), r"\([a-z]\+\) \([a-z]\+\)", r"\2-\1", (2, 4), every=False)


@query(_LINES + "SELECT buf, sum(len(regexp_extract_all(line, 'th')))::BIGINT AS matches, count(*) FILTER (contains(line, 'th')) AS lines FROM lines GROUP BY 1")
def text_count(t):
    return tx.count_matches(_buffers(t), "th")


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY ln) AS ln, line FROM lines WHERE NOT regexp_matches(line, '[ab]+c')")
def text_global_delete(t):
    return tx.global_(_buffers(t), r"[ab]\+c", tx.delete)


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY ln) AS ln, line FROM lines WHERE contains(line, 'the')")
def text_vglobal_delete(t):
    return tx.global_(_buffers(t), "the", tx.delete, invert=True)


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY CASE WHEN ln = 1 THEN 2.5 ELSE ln END) AS ln, line FROM lines")
def text_move(t):
    return tx.move(_buffers(t), 1, 1, 2)


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY k, ln) AS ln, line FROM (SELECT *, ln::DOUBLE AS k FROM lines UNION ALL SELECT *, 0.5 FROM lines WHERE ln BETWEEN 2 AND 3)")
def text_copy(t):
    return tx.copy(_buffers(t), 2, 3, 0)


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY ln) AS ln, line FROM (SELECT buf, min(ln) AS ln, string_agg(line, '' ORDER BY ln) AS line FROM lines WHERE ln <= 2 GROUP BY 1 UNION ALL SELECT * FROM lines WHERE ln > 2)")
def text_join(t):
    return tx.join(_buffers(t), 1, 2, spaces=False)


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY ln, k) AS ln, line FROM (SELECT *, -1 AS k FROM lines UNION ALL SELECT doc_id, 1, 'one', 0 FROM documents UNION ALL SELECT doc_id, 1, 'two', 1 FROM documents)")
def text_append(t):
    return tx.append(_buffers(t), 1, ["one", "two"])


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY ln, k, j) AS ln, line FROM (SELECT *, 0 AS k, 0 AS j FROM lines UNION ALL SELECT buf, 3, line, 1, ln FROM lines WHERE ln <= 2)")
def text_yank_put(t):
    buffer = _buffers(t)
    return tx.put(buffer, tx.yank(buffer, (1, 2)), 3)


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY ln, k) AS ln, line FROM (SELECT *, 1 AS k FROM lines WHERE ln <> 2 UNION ALL SELECT DISTINCT buf, 2, 'new', 0 FROM lines)")
def text_change(t):
    return tx.change(_buffers(t), 2, 2, ["new"])


@query(_LINES + "SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY ln, k) AS ln, line FROM (SELECT *, 1 AS k FROM lines UNION ALL SELECT DISTINCT buf, 1, 'top', 0 FROM lines)")
def text_insert(t):
    return tx.insert(_buffers(t), 1, ["top"])


@query(_LINES + "SELECT buf, ln, CASE WHEN ln > 3 THEN line WHEN line = '' THEN '' ELSE '    ' || line END AS right_, CASE WHEN ln > 3 THEN line WHEN line = '' THEN '' ELSE '  ' || line END AS left_, CASE WHEN ln > 3 THEN line ELSE upper(replace(line, 'ß', 'ss')) END AS up, CASE WHEN ln > 3 THEN line ELSE lower(line) END AS low FROM lines")
def text_shift(t):
    rows = tx.shift(_buffers(t), (1, 3), 4, into="right_")
    # One level back of what has been shifted.
    rows = tx.shift(rows, (1, 3), 2, left=True, line="right_", into="left_")
    return tx.lower(tx.upper(rows, (1, 3), into="up"), (1, 3), into="low").drop("line")


@query(_LINES + "SELECT buf, ln, lpad(ln::VARCHAR, greatest(3, length(ln::VARCHAR))::INT, ' ') || ' ' || line AS shown FROM lines WHERE ln <= 3")
def text_print(t):
    return tx.print_(_buffers(t), (1, 3), numbers=True)


@query(_LINES + "SELECT buf, max(ln) AS n, count(*) FILTER (contains(line, 'the')) AS hits FROM lines GROUP BY 1")
def text_last_line(t):
    b = _buffers(t)
    hits = tx.matching(b, "the").groupBy("buf").agg(F.count("*").alias("hits"))
    return tx.last_line(b).join(hits, "buf", "left").select("buf", "n", F.coalesce("hits", F.lit(0)).alias("hits"))


@query(_LINES + "SELECT step, buf, count(*) AS n FROM lines, (VALUES ('start', 0), ('undo', 0), ('redo', 1), ('put', 1)) v(step, least) WHERE ln > least OR step = 'put' AND ln = 1 GROUP BY ALL")
def text_history(t):
    """Lines of each buffer as opened, after deleting the first and undoing, redoing, and putting it
    back from a register at the end; marks and the list of versions are checked beside."""
    h = tx.History(_buffers(t))
    start = h.now
    h.yank("a", (1, 1))
    h.edit(lambda b: tx.delete(b, (1, 1)))
    undone, redone = h.undo(), h.redo()
    put = h.put("a", 1_000_000)
    h.mark("m", 3)
    h.delmarks("m")
    if h.marks or h.undolist() != [(0, False), (1, False), (2, True)]:
        raise AssertionError("the history isn't what was done")
    steps = {"start": start, "undo": undone, "redo": redone, "put": put}
    return reduce(DataFrame.unionByName, [d.select(F.lit(s).alias("step"), "buf") for s, d in steps.items()]).groupBy("step", "buf").agg(F.count("*").alias("n"))


@query(_LINES + "SELECT buf, ln, regexp_replace(line, '([a-z])([a-z])', '<\\0:\\2>1') AS line FROM lines")
def text_first_whole(t):
    """The first match of each line within brackets; a digit follows a group."""
    return tx.substitute(_buffers(t), r"\([a-z]\)\([a-z]\)", r"<&:\2>1", every=False)


@query(_LINES + ", i AS (SELECT buf, max(length(line) - length(ltrim(line, ' ' || chr(9)))) FILTER (ln = 2) AS w, max(length(line) - length(ltrim(line, ' ' || chr(9)))) FILTER (ln = 1) AS f FROM lines GROUP BY 1) SELECT buf, row_number() OVER (PARTITION BY buf ORDER BY ln, k) AS ln, line FROM (SELECT *, 0 AS k FROM lines UNION ALL SELECT buf, 2, CASE WHEN line = '' THEN '' WHEN coalesce(w, 0) >= f THEN repeat(' ', (coalesce(w, 0) - f)::INT) || line ELSE line[(f - coalesce(w, 0) + 1):] END, 1 FROM lines JOIN i USING (buf) WHERE ln = 1)")
def text_put_indented(t):
    h = tx.History(_buffers(t))
    h.yank("a", (1, 1))
    return h.put("a", 2, indented=True)


@query(_LINES + "SELECT buf, ln, lpad(ln::VARCHAR, greatest(3, length(ln::VARCHAR))::INT, ' ') || ' ' || line AS shown FROM lines WHERE ln BETWEEN 2 AND 6")
def text_window(t):
    return tx.window(_buffers(t), 4, 5, ".")


@query("WITH b AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_returnflag) AS ln, l_orderkey || ' ' || l_returnflag AS line FROM lineitem) SELECT row_number() OVER (ORDER BY ln) + 1 AS ln, line FROM b WHERE NOT contains(line, 'R') UNION ALL SELECT 1, 'top'")
def text_one_buffer(t):
    """All lines in one buffer: those with R go, and one comes before the rest."""
    rows = number_rows(t("lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], "ln")
    buffer = rows.select(F.lit(0).alias("buf"), F.col("ln").cast("bigint").alias("ln"), F.concat_ws(" ", "l_orderkey", "l_returnflag").alias("line"))
    return tx.insert(tx.global_(buffer, "R", tx.delete), 1, ["top"]).select("ln", "line")


@query("SELECT doc_id AS buf, text FROM documents WHERE text IS NOT NULL")
def text_round_trip(t):
    return tx.close_buffers(_buffers(t))


# -- store, jobs, streams --------------------------------------------------------------------


def _root(df: DataFrame, what: str) -> str:
    return new_path(df.sparkSession, what)


@query("SELECT sha256(text) AS hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def store_put_dedup(t):
    docs = t("documents").where("text IS NOT NULL").select("doc_id", "text")
    store = UnitStore(docs.sparkSession, _root(docs, "store"))
    store.put("all", docs, "text", ["doc_id"])
    store.put("again", docs, "text", ["doc_id"])
    return store.get("again").groupBy("hash").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1, 'drop', 0, (SELECT count(*) FROM customer WHERE c_acctbal <= 0), 0), (2, 'tag', 0, 0, (SELECT count(*) FROM customer WHERE c_acctbal > 0))) v(k, phase, added, removed, changed)")
def job_changes(t):
    return _plan(t).changes(["c_custkey"])


@query("SELECT sha256(c_mktsegment) AS hash, count(*) AS n, 2 AS version, 'b' AS value, true AS refused, true AS gone FROM customer GROUP BY c_mktsegment")
def store_references(t):
    """Units, a reference set twice by transactions, a refused third commit, and the store's removal."""
    rows = t("customer").select("c_custkey", "c_mktsegment")
    store = UnitStore(rows.sparkSession, _root(rows, "store"))
    store.put("all", rows, "c_mktsegment", ["c_custkey"])
    late, refused = store.transaction("head"), False
    store.transaction("head").commit("a")
    store.set_ref("head", "b", 1)
    store.transaction("head").abort()
    try:
        late.commit("c")
    except Conflict:
        refused = True
    version, value = store.ref("head")
    held = materialise(store.get("all").groupBy("hash").agg(F.count("*").alias("n")), "held")
    if store.size() != held.count() or not new_units(rows, store.units(), F.col("c_mktsegment")).isEmpty():
        raise AssertionError("the store has other units than the table")
    store.remove()
    return held.select("hash", "n", F.lit(version).alias("version"), F.lit(value).alias("value"), F.lit(refused).alias("refused"), F.lit(store.ref("head") == (0, None)).alias("gone"))


@query("SELECT c_custkey, c_mktsegment || '+' AS c_mktsegment FROM customer WHERE c_acctbal > 0")
def job_advance(t):
    return _plan(t).advance(2).select("c_custkey", "c_mktsegment")


@query("SELECT * FROM (VALUES (1, 'nulls', 0, 0, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'))) v(k, phase, added, removed, changed)")
def job_changes_null_values(t):
    """Values that become null are changes; so is that of a null key."""
    customers = t("customer").withColumn("c_custkey", F.nullif("c_custkey", F.lit(7)))
    nulls = Phase("nulls", (lambda df: df.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))),))
    plan = Plan(customers.sparkSession, _root(customers, "jobs"), [nulls])
    plan.seed(customers)
    plan.run()
    return plan.changes(["c_custkey"])


@query("WITH b AS (SELECT nullif(o_custkey % 7, 0) AS k, max(o_orderkey) AS v FROM orders GROUP BY 1), c AS (SELECT nullif(c_custkey % 7, 0) AS k, max(c_custkey) AS v FROM customer WHERE coalesce(nullif(c_custkey % 7, 0), 0) < 4 GROUP BY 1) SELECT b.k AS k, CASE WHEN coalesce(b.k, 0) < 4 THEN c.v ELSE b.v END AS v FROM b LEFT JOIN c ON b.k IS NOT DISTINCT FROM c.k WHERE coalesce(b.k, 0) <> 3")
def stream_changes_null_keys(t):
    base = t("orders").groupBy(F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k")).agg(F.max("o_orderkey").alias("v"))
    changes = t("customer").select(F.nullif(F.col("c_custkey") % 7, F.lit(0)).alias("k"), F.col("c_custkey").alias("v")).where("coalesce(k, 0) < 4")
    return apply_changes(base, changes.withColumn("op", F.when(F.col("k") == 3, "delete").otherwise("put")), ["k"], "v")


@query("SELECT user_id, round(sum(value), 2) AS state FROM events GROUP BY 1")
def stream_running_state(t):
    """A sum for each user, kept over the micro-batches of a channel that takes one batch more at a
    time."""
    events = t("events").select("user_id", "value", "event_id")
    spark, root = events.sparkSession, _root(events, "stream")
    channel = Channel(spark, f"{root}/channel", "user_id bigint, value double", size=3)
    for k in range(3):
        if not channel.offer(events.where(F.pmod("event_id", F.lit(3)) == k).select("user_id", "value")):
            raise AssertionError("the channel is full too soon")
    if channel.offer(events.select("user_id", "value")):
        raise AssertionError("the channel takes more than its size")
    channel.close()
    state = running_state(channel.take(), "user_id", "value", lambda now, values: now + values.sum(), 0.0)
    writer = state.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/state/batch={batch}")).start().awaitTermination()
    held = spark.read.schema("user_id bigint, state double, batch bigint").parquet(f"{root}/state")
    return held.groupBy("user_id").agg(F.round(F.max_by("state", "batch"), 2).alias("state"))


@query("SELECT * FROM (VALUES ('drop', true), ('tag', true), ('control', true)) v(phase, ok)")
def job_check(t):
    plan = _plan(t)
    rows = [(link.phase, link.ok) for link in plan.check()]
    rows.append(("control", plan.control(2, lambda df: df.where("c_custkey <> 7"))))
    return plan.spark.createDataFrame(rows, "phase string, ok boolean")


def _plan(t) -> Plan:
    customers = t("customer")
    drop = Phase("drop", (lambda df: df.where("c_acctbal > 0"),))
    tag = Phase("tag", (lambda df: df.withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("+"))),))
    plan = Plan(customers.sparkSession, _root(customers, "jobs"), [drop, tag])
    plan.seed(customers)
    plan.run()
    return plan


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'purchase'")
def stream_changes(t):
    """events as a change log, put or (purchases) delete, applied by micro-batches of a stream."""
    events = t("events").select("user_id", "event_type", "event_id").withColumn("op", F.when(F.col("event_type") == "purchase", "delete").otherwise("put"))
    spark, root = events.sparkSession, _root(events, "stream")
    events.repartition(3, "event_id").write.parquet(f"{root}/log")
    seen = Versions(spark, "seen")
    empty = spark.createDataFrame([], events.schema)

    def refresh(batch: DataFrame, version: int) -> None:
        base = seen.read(version - 1) if version else empty
        seen.write(apply_changes(base, batch, ["user_id"], "event_id", late=True), version)

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    maintain(stream, refresh, f"{root}/checkpoint").awaitTermination()
    return current(seen.read()).select("user_id", "event_type", "event_id")


# -- updates of an index, hashes of cycles ----------------------------------------------------------


@query("WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 2 THEN 0 ELSE n_regionkey END AS r FROM nation), under AS (SELECT c_nationkey AS n FROM customer WHERE c_nationkey <> 1 UNION ALL SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 1 UNION ALL SELECT s_nationkey FROM supplier) SELECT r AS region, (1 + count(DISTINCT n.k) + count(under.n))::BIGINT AS size FROM n LEFT JOIN under ON under.n = n.k GROUP BY r")
def graph_update(t):
    """Customers of nation 1 go, nation 2 moves to region 0, and each nation gets its suppliers' names:
    the sizes of the regions, of an index of which only touched trees were ranked again."""
    flat = tables_graph(t)
    graph = flat.index(holder=F.col("head").isin("customer", "supplier"), statement=F.col("head") == "orders", slack=0.5)
    new = t("supplier").select(F.concat(F.lit("new"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("bigint").alias("ord"), F.lit("name").alias("head"), F.lit(None).cast("string").alias("atom"), F.col("s_name").alias("label"))
    gone = graph.nodes.where("head = 'customer' AND parent_id = 'n1'").select("id")
    moved = graph.nodes.where("id = 'n2'").select("id", F.lit("r0").alias("new_parent"), F.lit(1_000).cast("bigint").alias("new_ord"))
    done = graph.update(insert=new, delete=gone, move=moved)
    return done.nodes.where("head = 'region'").select(F.substring("id", 2, 10).cast("int").alias("region"), "size")


_RINGS = "WITH s AS (SELECT s_suppkey AS k, s_suppkey // 5 AS ring, s_nationkey % 2 AS said, count(*) OVER (PARTITION BY s_suppkey // 5) AS n FROM supplier), w AS (SELECT a.k, string_agg(b.said::VARCHAR, '' ORDER BY (b.k - a.k + a.n) % a.n) AS word FROM s a JOIN s b USING (ring) GROUP BY a.k), "


@query(_RINGS + "u AS (SELECT o_orderkey AS k, word FROM orders JOIN w ON w.k = (o_orderkey * 7) % (SELECT count(*) FROM supplier)) SELECT 'supplier' AS head, k, count(*) OVER (PARTITION BY word) AS same FROM w UNION ALL SELECT 'orders', k, count(*) OVER (PARTITION BY word) FROM u")
def graph_cycle_hashes(t):
    """Suppliers name one another in rings of five, and orders name suppliers: how many say the same of
    the same. Of a ring, what its members say from one on decides."""
    s = t("supplier").crossJoin(F.broadcast(t("supplier").agg(F.count("*").alias("n"))))
    none = F.lit(None).cast("string")
    k = F.col("s_suppkey")
    nodes = s.select(F.concat(F.lit("s"), k).alias("id"), none.alias("parent_id"), k.alias("ord"), F.lit("supplier").alias("head"), (F.col("s_nationkey") % 2).cast("string").alias("atom"), none.alias("label"))
    ring = F.floor(k / 5) * 5
    edges = s.select(F.concat(F.lit("s"), k).alias("src"), F.concat(F.lit("s"), F.when(k == F.least(ring + 4, F.col("n") - 1), ring).otherwise(k + 1).cast("bigint")).alias("dst"), F.lit("refers").alias("kind"))
    o = t("orders").crossJoin(F.broadcast(t("supplier").agg(F.count("*").alias("n"))))
    nodes = nodes.unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), none.alias("parent_id"), F.col("o_orderkey").alias("ord"), F.lit("orders").alias("head"), none.alias("atom"), none.alias("label")))
    edges = edges.unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("s"), (F.col("o_orderkey") * 7 % F.col("n")).cast("bigint")).alias("dst"), F.lit("refers").alias("kind")))
    found = nodes.select("id", "head", F.col("ord").alias("k")).join(g.content_hashes(Graph(nodes, edges)), "id")
    same = found.groupBy("hash").agg(F.count("*").alias("same"))
    return found.join(same, "hash").select("head", "k", "same")


# -- scans, fixpoints, journals ----------------------------------------------------------------------


@query("WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS rn, p_partkey, p_size, p_brand, (p_size % 7 + 1)::BIGINT AS a, (p_partkey % 1009)::BIGINT AS b FROM part), r(rn, a, b) AS (SELECT rn, a, b FROM p WHERE rn = 1 UNION ALL SELECT p.rn, p.a * r.a % 1009, (p.a * r.b + p.b) % 1009 FROM r JOIN p ON p.rn = r.rn + 1) SELECT p_partkey, max(p_size) OVER (ORDER BY p.rn) AS most, right(string_agg(p_brand, '') OVER (ORDER BY p.rn), 12) AS said, r.a AS a, r.b AS b FROM p JOIN r USING (rn)")
def seq_scans(t):
    """Along all parts: the largest size so far, the last twelve characters of all brands so far, and the
    composition of a map x -> ax + b a part, modulo 1009."""
    p = t("part").select("p_partkey", "p_size", "p_brand")
    rows = Seq(p, ("p_partkey",)).scan(lambda x, y: F.greatest(x, y), F.col("p_size"), "most")
    rows = Seq(rows, ("p_partkey",)).scan(lambda x, y: F.right(F.concat(x, y), F.lit(12)), F.col("p_brand"), "said")
    one = F.struct((F.col("p_size") % 7 + 1).cast("bigint").alias("a"), (F.col("p_partkey") % 1009).cast("bigint").alias("b"))
    then = lambda x, y: F.struct((y["a"] * x["a"] % 1009).alias("a"), ((y["a"] * x["b"] + y["b"]) % 1009).alias("b"))
    rows = Seq(rows, ("p_partkey",)).scan(then, one, "m")
    return rows.select("p_partkey", "most", "said", F.col("m.a").alias("a"), F.col("m.b").alias("b"))


@query("SELECT user_id, event_id, string_agg(event_type[1], '') OVER (PARTITION BY user_id ORDER BY event_id) AS path FROM events")
def seq_scan_by(t):
    """Each user's events so far, by their first letters."""
    events = t("events").select("user_id", "event_id", "event_type")
    rows = Seq(events, ("event_id",), ("user_id",)).scan(lambda x, y: F.concat(x, y), F.substring("event_type", 1, 1), "path")
    return rows.select("user_id", "event_id", "path")


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey % 10 AS od, (o_orderkey // 7) % 10 AS nd, o_custkey % 10 AS cd, o_custkey % 50 = 0 AS c0 FROM orders), r(k, mask) AS (SELECT 0, 1::BIGINT UNION ALL SELECT k + 1, mask | (SELECT coalesce(bit_or(1::BIGINT << nd::INT), 0) FROM e WHERE (mask >> od::INT) & 1 = 1 AND (c0 OR (mask >> cd::INT) & 1 = 1)) FROM r WHERE k < 10), d AS (SELECT max(mask) AS m FROM r) SELECT 'supplier' AS head, (SELECT count(*) FROM range(10) t(x) WHERE (m >> x::INT) & 1 = 1) AS n FROM d UNION ALL SELECT 'customer', (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0 OR (m >> (c_custkey % 10)::INT) & 1 = 1) FROM d UNION ALL SELECT 'orders', (SELECT count(*) FROM orders WHERE (m >> (o_orderkey % 10)::INT) & 1 = 1 AND (o_custkey % 50 = 0 OR (m >> (o_custkey % 10)::INT) & 1 = 1)) FROM d")
def graph_derive(t):
    """Two rules that feed each other: an order is kept once its customer and its supplier are; an order
    keeps a further supplier, and a supplier the customers of its last digit."""
    o, c = t("orders"), t("customer")
    order, supplier = F.concat(F.lit("o"), "o_orderkey"), lambda x: F.concat(F.lit("s"), x)
    pairs = o.select(order.alias("id"), F.concat(F.lit("c"), "o_custkey").alias("first"), supplier(F.col("o_orderkey") % 10).alias("second"))
    further = o.select(order.alias("src"), supplier(F.floor(F.col("o_orderkey") / 7) % 10).alias("dst"))
    served = c.select(supplier(F.col("c_custkey") % 10).alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    roots = c.where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(c.limit(1).select(F.lit("s0").alias("id")))
    found = fixpoints.derive(roots, [fixpoints.both(pairs), fixpoints.follows(further), fixpoints.follows(served)])
    heads = F.create_map(*(F.lit(x) for x in ("o", "orders", "s", "supplier", "c", "customer")))
    return found.groupBy(F.element_at(heads, F.substring("id", 1, 1)).alias("head")).agg(F.count("*").alias("n"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 7 % (SELECT count(*) FROM part) AS b FROM part), r(id) AS (SELECT p_partkey FROM part WHERE p_size <= 2 UNION SELECT b FROM r JOIN e ON a = id), held AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 97 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) UNION SELECT c_custkey FROM customer WHERE (c_custkey - 1) % 97 = 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer)), said AS (SELECT 'F' AS kind, CASE WHEN p_size = 1 THEN 'external' WHEN p_size = 2 THEN 'asserted' WHEN p_partkey IN (SELECT id FROM r) THEN 'reachable' END AS class, 'unreachable' AS why FROM part UNION ALL SELECT 'M', CASE WHEN o_custkey IN (SELECT k FROM held) AND EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = (CASE WHEN o.o_custkey % 97 = 0 THEN o.o_custkey + 1 ELSE o.o_custkey - 1 END)) THEN 'held' END, CASE WHEN o_custkey % 10 = 0 AND o_orderkey % 5 < 3 THEN 'unreachable, but initialised by position' ELSE 'unreachable' END FROM orders o) SELECT kind, class, CASE WHEN class IS NULL THEN why END AS why, count(*) AS n FROM said GROUP BY ALL")
def graph_partition(t):
    """Parts that call one another, and orders as members of their customers, some of which are cast to
    the next: every entity in one class, and why the rest isn't reached."""
    none = F.lit(None)
    p = t("part").crossJoin(F.broadcast(t("part").agg(F.count("*").alias("n"))))
    part = lambda x: F.concat(F.lit("p"), x)
    customer = lambda x: F.concat(F.lit("c"), x)
    parts = t("part").select(part("p_partkey").alias("id"), F.lit("F").alias("kind"), none.cast("string").alias("owner"), none.cast("bigint").alias("ord"), none.cast("boolean").alias("explicit"))
    orders = t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("M").alias("kind"), customer("o_custkey").alias("owner"), (F.col("o_orderkey") % 5).cast("bigint").alias("ord"), none.cast("boolean").alias("explicit"))
    edges = p.select(part("p_partkey").alias("src"), part((F.col("p_partkey") * 7 % F.col("n")).cast("bigint")).alias("dst"))
    roots = [(name, t("part").where(where).select(part("p_partkey").alias("id"))) for name, where in (("external", "p_size = 1"), ("asserted", "p_size <= 2"))]
    casts = t("customer").where("c_custkey % 97 = 0").select(customer("c_custkey").alias("a"), customer(F.col("c_custkey") + 1).alias("b"))
    placed = t("customer").where("c_custkey % 10 = 0").select(customer("c_custkey").alias("owner"), F.lit(3).alias("n"))
    found = fixpoints.partition(parts.unionByName(orders), edges, roots, casts, placed)
    kinds = F.when(F.col("id").startswith("p"), "F").otherwise("M")
    return found.groupBy(kinds.alias("kind"), "class", "why").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE e AS ({_STEPS}), r(id, v) AS (SELECT s_suppkey, s_suppkey % 20 FROM supplier WHERE s_suppkey % 10 = 3 UNION SELECT b, v FROM r JOIN e ON a = id) SELECT id, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value, count(DISTINCT v) > 1 AS conflict FROM r GROUP BY 1")
def graph_constants(t):
    """Values of some suppliers along their steps, and where different ones meet."""
    values = t("supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 20).alias("value"))
    return fixpoints.spread_values(values, _steps(t))


@query("WITH v1 AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 1 THEN 'one' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 17 <> 1), v2 AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 2 THEN 'two' ELSE s END AS s FROM v1 WHERE c_custkey % 17 <> 2 UNION ALL SELECT c_custkey, 'two' FROM customer WHERE c_custkey % 17 = 1 AND c_custkey % 13 = 2), v3 AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 3 THEN 'three' ELSE s END AS s FROM v2) SELECT 0 AS version, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 1, s, count(*) FROM v1 GROUP BY 2 UNION ALL SELECT 2, s, count(*) FROM v2 GROUP BY 2 UNION ALL SELECT 3, s, count(*) FROM v3 GROUP BY 2 UNION ALL SELECT 4, s, count(*) FROM v2 GROUP BY 2")
def journal_versions(t):
    """Two commits of changed and deleted customers, a third, and its undoing: every version."""
    c = t("customer").select("c_custkey", "c_mktsegment")
    journal = Journal(c.sparkSession, _root(c, "journal"), ["c_custkey"])
    journal.open(c)
    for k, name in ((1, "one"), (2, "two")):
        journal.commit(c.where(F.col("c_custkey") % 13 == k).where(F.col("c_custkey") % 17 != k).withColumn("c_mktsegment", F.lit(name)), c.where(F.col("c_custkey") % 17 == k))
    now = journal.read()
    journal.commit(now.where("c_custkey % 13 = 3").withColumn("c_mktsegment", F.lit("three")))
    journal.undo()
    versions = [journal.read(v).select(F.lit(v).alias("version"), F.col("c_mktsegment").alias("segment")) for v in range(5)]
    return reduce(DataFrame.unionByName, versions).groupBy("version", "segment").agg(F.count("*").alias("n"))


# -- readers and writers of files --------------------------------------------------------------------


@query("SELECT kind, c_custkey AS k, CASE kind WHEN 'line' THEN c_custkey || ' ' || c_name WHEN 'slurp' THEN c_custkey || ' ' || c_name ELSE c_name END AS said FROM customer, (VALUES ('csv'), ('json'), ('xml'), ('line'), ('slurp')) v(kind)")
def file_readers(t):
    """Customers written as CSV, JSON, XML and lines of text, and read back as records, lines and whole files."""
    c = t("customer").select("c_custkey", "c_name")
    spark, root, kind = c.sparkSession, _root(c, "files"), "c_custkey bigint, c_name string"
    forms.csv_write(c, f"{root}/csv", separator=";", header=True)
    c.write.json(f"{root}/json")
    c.write.format("xml").option("rowTag", "customer").save(f"{root}/xml")
    lines = c.select(F.concat_ws(" ", "c_custkey", "c_name").alias("value"))
    forms.spit(lines.where("length(value) % 2 = 0"), f"{root}/text")
    forms.spit(lines.where("length(value) % 2 = 1"), f"{root}/text", append=True)
    records = {"csv": forms.csv_seq(spark, f"{root}/csv", kind, separator=";", header=True), "json": forms.json_seq(spark, f"{root}/json", kind), "xml": forms.xml_seq(spark, f"{root}/xml", "customer", kind)}
    out = [df.select(F.lit(k).alias("kind"), F.col("c_custkey").alias("k"), F.col("c_name").alias("said")) for k, df in records.items()]
    texts = {"line": forms.line_seq(spark, f"{root}/text").select("line"), "slurp": forms.slurp(spark, f"{root}/text").select(F.explode(F.split("value", "\n")).alias("line"))}
    out += [df.where("line <> ''").select(F.lit(k).alias("kind"), F.split("line", " ")[0].cast("bigint").alias("k"), F.col("line").alias("said")) for k, df in texts.items()]
    return reduce(DataFrame.unionByName, out)
