"""Views of placed forms look up no more nodes than they tell of."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph as graph_module
from quillon.operators import views
from quillon.operators.graph import Graph
from quillon.sources import forms
from quillon.sources.forms import read_forms

CODE = ["(struct s (member m) (member n))", "(def o)", "(pointer)", "(defn f (param a) (= @o 1) (at @o 3) (call @f (addr (paren @o))) (= (-> x m) 1) (@o -> m))", "(defn g (param b) (result r) (call @f 1) (. @o k))"]
EDGES = [("3.0.6.1.2", "0.0.2", "refers"), ("3.0.2", "2.0", "typed"), ("2.0", "0.0", "typed"), ("4.0.3", "0.0", "typed"), ("1.0", "0.0", "typed"), ("0.0.3", "2.0", "typed")]


_BUILT = {}


def code(spark, places=True, fresh=False):
    if fresh or places not in _BUILT:
        _BUILT[places] = build(spark, places)
    return _BUILT[places]


def build(spark, places):
    graph = read_forms(spark.createDataFrame(list(enumerate(CODE)), "unit bigint, text string"), places=places)
    edges = graph.edges.unionByName(spark.createDataFrame(EDGES, graph.edges.schema))
    graph = Graph(graph.nodes.withColumn("called", F.col("atom") == "@f"), edges, placed=places)
    return graph.index(holder=F.col("parent_id").isNull(), statement=F.col("head") == "call", call=F.col("called"))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_use_forms_of_rows_look_up_no_node(spark, monkeypatch):
    graph = code(spark)
    uses = graph.nodes.where("atom LIKE '@%'")
    want = views.use_forms(graph, uses.select("id"))
    heads = want.join(graph.nodes.select(F.col("id").alias("form"), F.col("head").alias("__h")), "form")
    assert heads.count() == uses.count() and heads.where("NOT form_head <=> __h").isEmpty()
    written = []
    monkeypatch.setattr(views, "materialise", lambda df, what="table", _f=views.materialise: written.append(optimized(df)) or _f(df, what))
    got = views.use_forms(graph, uses)
    assert "LeftSemi" not in "".join(written) and rows(got) == rows(want) == rows(views.use_forms(code(spark, False), uses.select("id")))


def test_access_told_by_the_form_around_asks_no_other(spark, monkeypatch):
    graph = code(spark)
    want = rows(views.access(code(spark, False), graph.nodes.where("atom LIKE '@%' OR head = 'paren'").select("id")))
    assert rows(views.access(graph, graph.nodes.where("atom LIKE '@%' OR head = 'paren'").select("id"))) == want
    uses = graph.nodes.where("atom = '@o' AND above IN ('=', 'at')").select("id")
    monkeypatch.setattr(views, "within", None)
    assert sorted(r.access for r in views.access(graph, uses).collect()) == ["init", "write"]


def test_type_report_deals_out_only_what_it_tells_of(spark):
    types = spark.createDataFrame([("0.0",)], "id string")
    got = views.type_report(code(spark), types)
    assert re.search(r"head#\d+ IN \(param,result,member,def\)", optimized(got))
    assert rows(got) == rows(views.type_report(code(spark, False), types))
    assert sorted((r.section, r.node, r.access, r.n) for r in got.collect()) == [("members", "0.0.2", "write", 1), ("members", "0.0.3", None, 0), ("objects", "1.0", None, 1), ("returning", "4.0", None, 1), ("taking", "3.0", None, 1)]


def test_types_that_are_rows_and_held_roots_are_not_looked_up(spark, monkeypatch):
    graph = code(spark)
    types = graph.nodes.where("head = 'struct'")
    want = rows(views.type_report(graph, types.select("id")))
    monkeypatch.setattr(Graph, "_rep", None)
    assert rows(views.type_report(graph, types)) == want and len(want) == 5


def test_statements_within_trees_rewrite_no_nodes(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph_module, "materialise", lambda df, what="table", _f=graph_module.materialise: written.append(what) or _f(df, what))
    graph = code(spark, fresh=True)
    assert "nodes" not in written and "LeftOuter" not in optimized(graph.nodes.select("id", "top_id", "in_call"))
    assert rows(graph.nodes.select("id", "stmt_id")) == rows(code(spark, False).nodes.select("id", "stmt_id"))


@pytest.mark.parametrize("steps", ["refers< call ^fn", "refers< call ^stmt", "refers< call contains<", "refers< call", "call ^fn call"])
def test_calls_and_what_holds_them(spark, steps):
    graph, roots = code(spark), code(spark).nodes.select("id")
    cur = None
    for step in steps.split():
        cur = graph.follow(roots, step) if cur is None else graph._step(cur, step)
    assert rows(graph.follow(roots, steps)) == rows(cur)
    if "^fn" in steps and steps.startswith("refers"):
        assert optimized(graph.follow(roots, steps)).count("Join") < optimized(cur).count("Join")


def test_one_list_is_told_by_its_parentheses(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(list('()()ab"\\ \n') + ["é"]) for _ in range(rng.randrange(12))) for _ in range(3_000)]
    texts += [f"({t})" for t in texts]

    def tops(text):
        try:
            return list(forms._tops(1, text))
        except ValueError as e:
            return str(e)

    got = [tops(t) for t in texts]
    with monkeypatch.context() as m:
        m.setattr(forms, "_one_list", lambda text: False)
        assert got == [tops(t) for t in texts]
    monkeypatch.setattr(forms, "TOKEN", None)
    assert list(forms._tops(1, '(a "(" (b "\\")"))')) == ['(a "(" (b "\\")"))']
