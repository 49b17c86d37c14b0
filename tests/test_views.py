"""Views of code on a small sample: two structs whose members share a name, functions and an object."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import views
from quillon.operators.graph import Graph
from quillon.sources.forms import read_forms

SAMPLE = [
    "(struct buf (member b_ml) (member next))",
    "(struct other (member owner) (member b_ml))",
    "(def opt)",
    "(defn get (param b) (= (-> b %b) n) (post++ (-> b %b)) (+= (-> b %b) 2) (if (-> b %n) (do (= @opt 0) (return 0))) (return (+ (-> b %b) @opt)))",
    "(defn mk (result r) (def one) (return (addr one)))",
    "(defn main (def b) (= (. o %o) 1) (def p (addr (. b %b))) (= @opt 1) (call @get (addr b)) (return (+ (. b %b) (sizeof (paren (. b %b))) (. o %o) (-> (call @mk) %b))))",
    "(pointer)",
]
MEMBERS = {"%b": "0.0.2", "%n": "0.0.3", "%o": "1.0.3"}
TYPED = [("3.0.2", "6.0"), ("4.0.2", "6.0"), ("6.0", "0.0"), ("1.0.2", "6.0"), ("4.0.3", "0.0"), ("5.0.2", "0.0")]


@pytest.fixture(scope="module")
def sample(spark):
    graph = read_forms(spark.createDataFrame(list(enumerate(SAMPLE)), "unit bigint, text string"))
    names = spark.createDataFrame(list(MEMBERS.items()), "atom string, dst string")
    edges = graph.nodes.join(names, "atom").select(F.col("id").alias("src"), "dst", F.lit("refers").alias("kind"))
    edges = edges.unionByName(spark.createDataFrame([(*e, "typed") for e in TYPED], "src string, dst string, kind string"))
    calls = graph.nodes.where("head = 'call'").select(F.concat("id", F.lit(".1")).alias("id"), F.lit(True).alias("called"))
    code = Graph(graph.nodes.join(calls, "id", "left"), graph.edges.unionByName(edges))
    return code.index(holder=F.col("parent_id").isNull(), statement=F.lit(False), call=F.col("called"))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_members_of_one_name_are_told_by_type(sample, spark):
    found = {(r.root, r.access): r.n for r in views.tally(sample, ids(spark, "0.0.2", "1.0.3")).collect()}
    assert {a: n for (root, a), n in found.items() if root == "0.0.2"} == {"read": 3, "write": 1, "update": 2, "addr": 1, "unevaluated": 1}
    assert {a: n for (root, a), n in found.items() if root == "1.0.3"} == {"write": 1, "read": 1}


def test_uses_of_an_object_and_a_function(sample, spark):
    rows = views.tally(sample, ids(spark, "2.0", "3.0")).orderBy("root", "place").collect()
    assert [(r.root, r.access, r.n, r.forms) for r in rows] == [("2.0", "read", 1, 1), ("2.0", "write", 2, 2), ("3.0", "call", 1, 1)]


def test_use_forms(sample, spark):
    uses = sample.nodes.where("atom IN ('@get', '@opt', '%n')").select("id")
    rows = views.use_forms(sample, uses).join(sample.nodes.select(F.col("id").alias("form"), "head", "atom"), "form")
    assert sorted((r.head or r.atom) for r in rows.collect()) == ["->", "@opt", "@opt", "@opt", "call"]


def test_type_report(sample, spark):
    rows = views.type_report(sample, ids(spark, "0.0")).collect()
    assert sorted((r.section, r.node, r.n) for r in rows if r.section != "members") == [("held-in", "1.0.2", 1), ("returning", "4.0", 1), ("taking", "3.0", 1)]
    assert sorted((r.node, r.access, r.n) for r in rows if r.section == "members") == [("0.0.2", "addr", 1), ("0.0.2", "read", 3), ("0.0.2", "unevaluated", 1), ("0.0.2", "update", 2), ("0.0.2", "write", 1), ("0.0.3", "read", 1)]


def test_no_uses_and_unknown_ids(sample, spark):
    assert views.access(sample, ids(spark, "nowhere")).count() == 0
    assert views.access(sample, ids(spark, "2.0").where("false")).count() == 0
    assert views.access(sample, ids(spark, "2.0", "2.0")).collect()[0].access == "read"


def test_size_of_a_view(sample, spark):
    levels = sample.callers(ids(spark, "3.0"), 2)
    contexts = sample.contexts(sample.nodes.where("atom = '@opt'").select("id"), "fn")
    assert tuple(views.size(levels, contexts).first()) == (1, 2)
    assert tuple(views.size(levels).first()) == (1, 0)
