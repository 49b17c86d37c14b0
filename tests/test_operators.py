"""Operators on small known answers: nulls as values, swaps, empties, order, edits, stores, jobs and
streams."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph as g
from quillon.operators import rel
from quillon.operators import text as tx
from quillon.operators.graph import Graph, parse_pattern, parse_steps
from quillon.operators.seq import Seq, cycle, iterate, merge, range_, repeat
from quillon.plans.ordering import number_rows, running_sum
from quillon.plans.tables import new_path
from quillon.sources import forms
from quillon.sources.store import Conflict, UnitStore
from quillon.streaming.changes import Channel, apply_changes, running_state


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- relations -------------------------------------------------------------------------------


def test_natural_join(spark):
    xs = spark.createDataFrame([(11, 1, 1, 4), (2, 12, 2, 6), (3, 3, 3, 8), (None, 0, 0, 0)], "a int, b int, c int, d int")
    ys = spark.createDataFrame([(11, 11, 11, 5), (12, 11, 12, 3), (3, 3, 3, 7), (None, 0, 0, 9)], "a int, b int, c int, e int")
    assert rows(rel.join(xs, ys)) == rows(spark.createDataFrame([(3, 3, 3, 8, 7), (None, 0, 0, 0, 9)], "a int, b int, c int, d int, e int"))
    assert rel.join(xs, ys.limit(0)).count() == 0
    keyed = rel.join_on(xs, rel.rename(ys, {"b": "yb", "c": "yc"}), {"a": "a"})
    assert sorted(r.a for r in keyed.collect() if r.a) == [3, 11]


def test_keyed_join_larger_side_wins(spark):
    small = spark.createDataFrame([(1, "small")], "k int, v string")
    large = spark.createDataFrame([(1, "large"), (2, "other")], "k int, v string")
    assert rows(rel.join_on(small, large, {"k": "k"})) == [(1, "large")]
    assert rows(rel.join_on(large, small, {"k": "k"})) == [(1, "large")]
    assert rows(rel.join_on(small, large.limit(1), {"k": "k"})) == [(1, "large")]


def test_sets(spark):
    f = lambda s: spark.createDataFrame([(x,) for x in s], "x string")
    assert [x for (x,) in rows(rel.union(f("abc"), f("cde"), f("e")))] == list("abcde")
    assert [x for (x,) in rows(rel.difference(f("aabc"), f("cde")))] == list("ab")
    assert [x for (x,) in rows(rel.intersection(f("abc"), f("cde")))] == ["c"]
    assert rel.is_subset(f("ab"), f("abc")) and not rel.is_superset(f("ab"), f("abc"))
    null = spark.createDataFrame([(None,), (None,)], "x string")
    assert rel.intersection(null, null).count() == 1


def test_rename_and_select(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert rel.rename(df, {"a": "b", "b": "a"}).first().asDict() == {"b": 1, "a": 2, "c": 3}
    assert rel.rename(df, {"a": "c"}).first().asDict() == {"c": 1, "b": 2}
    assert rel.select(df, F.lit(None).cast("boolean")).count() == 0
    m = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))
    assert df.select(rel.rename_keys(m, {"x": "y"}).alias("m")).first().m == {"y": 1}
    assert df.select(rel.map_invert(F.create_map(F.lit("p"), F.lit(1), F.lit("q"), F.lit(1))).alias("m")).first().m == {1: "q"}


# -- sequences -------------------------------------------------------------------------------


def test_global_numbers(spark):
    values = random.Random(1).sample(range(1000), 200) + [None]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    numbered = number_rows(df, ["v"])
    got = [r.v for r in sorted(numbered.collect(), key=lambda r: r.rn)]
    assert got == sorted(values, key=lambda v: (v is not None, v or 0))
    total = {r.v: r.t for r in running_sum(numbered, F.col("v"), "t").collect()}
    assert total[max(v for v in values if v is not None)] == sum(v for v in values if v)


def test_sequences(spark):
    s = Seq(spark.createDataFrame(list(enumerate("aabcca")), "i int, x string"), ("i",))
    ids = lambda q: sorted(r.i for r in q.df.collect())
    assert ids(s.take(2)) == [0, 1] and ids(s.drop(4)) == [4, 5] and ids(s.take_nth(2)) == [0, 2, 4]
    assert ids(s.take_last(2)) == [4, 5] and ids(s.butlast()) == [0, 1, 2, 3, 4] and ids(s.subvec(1, 3)) == [1, 2]
    assert ids(s.dedupe(F.col("x"))) == [0, 2, 3, 5] and ids(s.distinct("x")) == [0, 2, 3]
    assert ids(s.take_while(F.col("x") == "a")) == [0, 1] and ids(s.drop_while(F.col("x") == "a")) == [2, 3, 4, 5]
    assert ids(s.drop_while(F.lit(True))) == [] and ids(s.take_while(F.lit(None).cast("boolean"))) == []
    assert [r["items"] for r in s.partition_by(F.col("x"), F.col("i")).orderBy("run").collect()] == [[0, 1], [2], [3, 4], [5]]
    assert [r["items"] for r in s.partition(4, F.col("i"), 2).orderBy("window").collect()] == [[0, 1, 2, 3], [2, 3, 4, 5]]
    assert [r["items"] for r in s.partition_all(4, F.col("i")).orderBy("window").collect()] == [[0, 1, 2, 3], [4, 5]]
    padded = s.partition(4, F.col("i"), pad=F.array(F.lit(9))).orderBy("window").collect()
    assert [r["items"] for r in padded] == [[0, 1, 2, 3], [4, 5, 9]]
    assert ids(s.max_key(F.col("x"))) == [4] and ids(s.min_key(F.col("x"))) == [5]
    assert s.some(F.col("x") == "z").first().some is None and s.every(F.col("x") >= "a").first().every
    assert [r.i for r in s.sort_by("x").sorted().collect()] == [0, 1, 5, 2, 3, 4]
    assert [r.i for r in s.interleave(Seq(s.df.where("i > 3"), ("i",))).collect()] == [0, 4, 1, 5]
    assert [r.i for r in s.reverse().collect()] == [5, 4, 3, 2, 1, 0]
    assert s.concat(s).numbered().count() == 12 and s.bounded_count(3) == 3
    assert s.frequencies(F.col("x")).count() == 3


def test_skewed_sequences_give_the_same(spark):
    rng = random.Random(2)
    data = [(k, rng.choice([None, 1, 1, 1, 1, 1, 2, 3]), rng.choice("aab")) for k in range(300)]
    df = spark.createDataFrame(data, "i int, g int, x string").repartition(4)
    plain, skewed = Seq(df, ("i",), ("g",)), Seq(df, ("i",), ("g",), skewed=True)
    for f in (
        lambda s: s.numbered(),
        lambda s: s.take(3).df,
        lambda s: s.take_last(2).df,
        lambda s: s.take_while(F.col("x") == "a").df,
        lambda s: s.drop_while(F.col("x") == "a").df,
        lambda s: s.runs(F.col("x")),
        lambda s: s.dedupe(F.col("x")).df,
    ):
        a = f(plain)
        assert rows(a) == rows(f(skewed).select(a.columns))


@pytest.mark.parametrize("n", range(6))
@pytest.mark.parametrize(("size", "step"), [(2, 2), (3, 1), (3, 2), (4, 3), (2, 3)])
def test_padded_partitions(spark, n, size, step):
    df = spark.createDataFrame([(k,) for k in range(n)], "v int")
    got = Seq(df, ("v",)).partition(size, F.col("v"), step, pad=F.array(F.lit(9)))
    expected = []
    for a in range(0, n, step):
        part = list(range(n))[a : a + size]
        expected.append((part + [9])[:size] if len(part) < size else part)
        if len(part) < size:
            break
    assert [r["items"] for r in got.orderBy("window").collect()] == expected


def test_joins_of_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (None, 7)], "k int, w int")
    expected = [(1, "x", 5), (1, "x", 6), (None, "y", 7)]
    assert sorted(map(tuple, rel.join(a, b).collect()), key=str) == sorted(expected, key=str)
    assert rel.join(a, b.select("w")).count() == 6
    assert rel.join_on(a, b.withColumnRenamed("k", "j"), {"k": "j"}).count() == 3
    assert rel.join_on(a, b, {"k": "k"}, "x").count() == 3


def test_generators(spark):
    assert [r.value for r in iterate(spark, lambda x: x * 2, F.lit(1), 5).orderBy("place").collect()] == [1, 2, 4, 8, 16]
    assert [r.value for r in range_(spark, 1, 7, 2).collect()] == [1, 3, 5]
    assert repeat(spark, 3, F.lit("x")).count() == 3
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert [r.v for r in cycle(df, ["v"], 2).orderBy("__round", "v").collect()] == [1, 2, 1, 2]
    a = spark.createDataFrame([("k", 1)], "key string, value int")
    assert merge(a, a.withColumn("value", F.lit(None).cast("int"))).first().value is None


# -- graphs ----------------------------------------------------------------------------------

CODE = ["(defn fact (body (call @mul) (call @fact)))", "(defn mul (body))", "(defn main (body (call @fact) (read @opt) (call @even)))", "(def opt)", "(defn even (body (call @odd)))", "(defn odd (body (call @even)))"]


@pytest.fixture(scope="module")
def code(spark):
    graph = forms.read_forms(spark.createDataFrame(list(enumerate(CODE)), "unit bigint, text string"))
    calls = graph.nodes.where("head = 'call'").select(F.col("id").alias("parent_id")).join(graph.nodes, "parent_id").where("ord = 1").select("id", F.lit(True).alias("is_call"))
    marked = Graph(graph.nodes.join(calls, "id", "left"), graph.edges)
    return marked.index(holder=F.col("parent_id").isNull(), statement=F.col("head").isin("call", "read"), call=F.col("is_call"))


def named(code, spark, *names):
    return code.nodes.where(F.col("label").isin(*names) & F.col("parent_id").isNull()).select("id")


def labels(code, df, column="node"):
    return sorted(r.label for r in df.join(code.nodes.select(F.col("id").alias(column), "label"), column).select("label").collect())


def test_views(code, spark):
    assert labels(code, code.callers(named(code, spark, "fact"), 1)) == ["fact", "main"]
    assert labels(code, code.callees(named(code, spark, "main"), 1)) == ["even", "fact"]
    assert sorted({r.depth for r in code.callees(named(code, spark, "main"), 5).collect()}) == [1, 2, 3]
    assert labels(code, code.uses(named(code, spark, "opt"))) == ["main"]
    assert {(r.access, r.n) for r in code.tally(named(code, spark, "fact", "opt"), F.when(F.col("in_call"), "call").otherwise("read")).collect()} == {("call", 2), ("read", 1)}
    root = named(code, spark, "main").first().id
    tree = code.build(root, "inside call refers", 0)
    assert [k["link"] for k in tree["kids"]] == [False, False]
    assert any(k["link"] for kid in tree["kids"] for k in kid["kids"])
    assert [r.id for r in code.definition(root).collect()][0] == root
    assert code.find("fact").count() == 1 and code.find(f"#{root}").count() == 1


def test_steps_are_checked():
    assert parse_steps("refers< call ^fn") == ["refers<", "call", "^fn"]
    for bad in ("", "refers> x", "^fn<"):
        with pytest.raises(ValueError, match="step"):
            parse_steps(bad)


def test_collect_and_reach(code, spark):
    top = code.nodes.where("parent_id IS NULL").select("id", "label")
    left = g.collect(code, named(code, spark, "main"))
    assert sorted(r.label for r in left.nodes.where("parent_id IS NULL").collect()) == ["even", "fact", "main", "mul", "odd", "opt"]
    only = g.collect(code, named(code, spark, "odd"))
    assert sorted(r.label for r in only.nodes.where("parent_id IS NULL").collect()) == ["even", "odd"]
    steps = code.edges.join(code.nodes.select(F.col("id").alias("src"), "top_id"), "src").select(F.col("top_id").alias("src"), "dst")
    reach = g.reachable(named(code, spark, "fact"), steps)
    assert sorted((r.label, r.depth) for r in reach.join(top, "id").collect()) == [("fact", 0), ("mul", 1)]
    assert left.dangling().count() == 0 and code.same(code)


def test_hashes(code, spark):
    forms_ = g.form_hashes(code)
    assert forms_.count() == code.nodes.count()
    twice = {r.id: r.hash for r in g.content_hashes(code).collect()}
    again = {r.id: r.hash for r in g.content_hashes(code).collect()}
    assert twice == again
    changed = code.replace(code.nodes.where("atom = 'opt'").select("id"), F.lit("flag"))
    moved = {r.id: r.hash for r in g.content_hashes(Graph(changed.nodes, code.edges, True)).collect()}
    by = {r.label: r.id for r in code.nodes.where("parent_id IS NULL").collect()}
    assert moved[by["opt"]] != twice[by["opt"]] and moved[by["main"]] != twice[by["main"]] and moved[by["mul"]] == twice[by["mul"]]


def test_patterns(code, spark):
    assert parse_pattern("(a ?x (b _*))") == ["a", "?x", ["b", "_*"]]
    assert g.match(code, "(call ?f)").count() == 6
    assert g.match(code, "(defn ?n (body))").count() == 1
    assert g.match(code, "(defn ?n _*)").count() == 5
    pairs = forms.read_forms(spark.createDataFrame([(0, "(p (a 1) (a 1))"), (1, "(p (a 1) (a 2))")], "unit bigint, text string")).index(holder=F.lit(False), statement=F.lit(False))
    assert [r.id for r in g.match(pairs, "(p ?x ?x)", g.form_hashes(pairs)).collect()] == ["0.0"]
    assert [r.id for r in g.match(pairs, "(p ?x:(a 1) (a 2))").collect()] == ["1.0"]


def test_edits(code, spark):
    cut = code.delete(named(code, spark, "mul"))
    assert cut.dangling().count() == 1
    with pytest.raises(ValueError, match="unhandled"):
        cut.fall_out(lambda graph, bad: bad.limit(0).select(F.col("src").alias("id")))
    healed = code.retarget(spark.createDataFrame([(named(code, spark, "mul").first().id, named(code, spark, "opt").first().id)], "old string, new string"))
    assert Graph(healed.nodes, healed.edges).dangling().count() == 0
    root = named(code, spark, "opt").first().id
    new = spark.createDataFrame([("new", root, 1, None, "int", None)], "id string, parent_id string, ord bigint, head string, atom string, label string")
    grown = code.insert(new)
    assert [(r.ord, r.atom) for r in grown.nodes.where(F.col("parent_id") == root).orderBy("ord").collect()] == [(0, "def"), (1, "int"), (2, "opt")]


def test_forms_round_trip(spark):
    graph = forms.read_forms(spark.createDataFrame(list(enumerate(CODE)), "unit bigint, text string"))
    printed = forms.write_forms(graph.index(holder=F.lit(False), statement=F.lit(False))).where("parent_id IS NULL")
    assert sorted(r.text for r in printed.collect()) == sorted(CODE)
    assert forms.edn_to_json('{:a [1 2.5 nil] "b" #{:x} ; note\n :c \\newline}') == '{"a": [1, 2.5, null], "b": ["x"], "c": "\\n"}'


def test_fixpoints(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src bigint, dst bigint")
    got = rows(g.closure(spark.createDataFrame([(1, 1), (4, 4)], "seed bigint, id bigint"), edges))
    assert got == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)]
    need = edges.select(F.col("src").alias("id"), "dst")
    left = g.greatest_fixpoint(spark.range(1, 6), lambda now: need.join(now, "id").join(now.select(F.col("id").alias("dst")), "dst", "left_anti"))
    assert rows(left) == [(1,), (2,), (3,), (4,), (5,)]
    left = g.greatest_fixpoint(spark.range(1, 5), lambda now: need.join(now, "id").join(now.select(F.col("id").alias("dst")), "dst", "left_anti"))
    assert rows(left) == [(1,), (2,), (3,)]


def test_rounds_are_not_cut_silently(spark):
    chain = spark.range(40).selectExpr("id AS src", "id + 1 AS dst")
    seeds = spark.createDataFrame([(0, 0)], "seed bigint, id bigint")
    assert g.closure(seeds, chain).count() == 41
    with pytest.raises(ValueError, match="2 rounds"):
        g.closure(seeds, chain, 2)
    chain = chain.where("src < 6")
    nodes = spark.range(7).selectExpr("'n' || id AS id", "CAST(NULL AS string) AS parent_id", "id AS ord", "'x' AS head", "CAST(NULL AS string) AS atom", "CAST(NULL AS string) AS label")
    graph = Graph(nodes, chain.selectExpr("'n' || src AS src", "'n' || dst AS dst", "'refers' AS kind")).index(holder=F.lit(True), statement=F.lit(False))
    assert g.content_hashes(graph).select("hash").distinct().count() == 7


def test_types_over_long_chains(spark):
    nodes = spark.range(67).selectExpr("'n' || id AS id", "CAST(NULL AS string) AS parent_id", "id AS ord", "if(id = 0, 'type', if(id = 66, 'field', 'pointer')) AS head", "CAST(NULL AS string) AS atom", "CAST(NULL AS string) AS label")
    graph = Graph(nodes, spark.range(66).selectExpr("'n' || (id + 1) AS src", "'n' || id AS dst", "'typed' AS kind")).index(holder=F.lit(True), statement=F.lit(False))
    found = {r["head"]: r["n"] for r in graph.type_view(graph.nodes.where("head = 'type'").select("id")).collect()}
    assert found == {"pointer": 65, "field": 1}


def test_diff_pairs_by_label_order(spark):
    a = spark.createDataFrame([(1, "x", "h1", 0), (2, "x", "h2", 1), (3, "y", "h", 2)], "id bigint, label string, hash string, ord bigint")
    b = spark.createDataFrame([(9, "x", "h1", 0), (2, "x", "h9", 1), (8, "z", "h", 2)], "id bigint, label string, hash string, ord bigint")
    assert rows(g.compare_units(a, b)) == sorted([("kept", "x", 1, 9), ("changed", "x", 2, 2), ("removed", "y", 3, None), ("added", "z", None, 8)], key=repr)


# -- text ------------------------------------------------------------------------------------


def buffer(spark, *lines):
    return tx.open_buffers(spark.createDataFrame([(1, "\n".join(lines))], "id int, text string"), "id", "text")


def shown(df):
    return [r.line for r in df.orderBy("ln").collect()]


def test_text(spark):
    assert shown(tx.substitute(buffer(spark, "a-b-c", "a-b"), "-", "+")) == ["a+b+c", "a+b"]
    assert shown(tx.substitute(buffer(spark, "abc xbbc zzz abbc", "a c ac"), r"a\|c", "X")) == ["XbX xbbX zzz XbbX", "X X XX"]
    assert shown(tx.substitute(buffer(spark, "a-b-c"), "-", "+", every=False)) == ["a+b-c"]
    assert shown(tx.substitute(buffer(spark, "ab"), "b", "&&")) == ["abb"]
    assert shown(tx.substitute(buffer(spark, "a,b", "c"), ",", "\\r")) == ["a", "b", "c"]
    lines = buffer(spark, "keep 1", "drop 2", "keep 3", "drop 4")
    assert shown(tx.global_(lines, "drop", tx.delete)) == ["keep 1", "keep 3"]
    assert shown(tx.global_(lines, "keep", tx.delete, invert=True)) == ["keep 1", "keep 3"]
    numbers = buffer(spark, "1", "2", "3")
    assert shown(tx.move(numbers, 1, 1, 3)) == ["2", "3", "1"] and shown(tx.copy(numbers, 1, 1, 0)) == ["1", "1", "2", "3"]
    assert shown(tx.join(buffer(spark, "one", "  two", ")three"), 1, 3)) == ["one two)three"]
    assert shown(tx.join(buffer(spark, "one ", "two"), 1, 2)) == ["one two"]
    assert shown(tx.change(numbers, 2, 3, ["x"])) == ["1", "x"] and shown(tx.insert(numbers, 1, ["x"]))[0] == "x"
    assert shown(tx.shift(buffer(spark, "a", ""), None, 2)) == ["  a", ""] and shown(tx.shift(buffer(spark, "   a"), None, 2, left=True)) == [" a"]
    assert tx.last_line(numbers).first().n == 3 and tx.close_buffers(numbers).first().text == "1\n2\n3"
    with pytest.raises(ValueError, match="themselves"):
        tx.move(numbers, 1, 3, 2)


def test_history(spark):
    h = tx.History(buffer(spark, "1", "2", "3"))
    h.edit(lambda b: tx.delete(b, (1, 1)))
    h.yank("a", (1, 1))
    h.put("a", 2)
    assert shown(h.now) == ["2", "3", "2"]
    assert shown(h.undo()) == ["2", "3"] and shown(h.undo(5)) == ["1", "2", "3"] and shown(h.redo()) == ["2", "3"]
    assert h.undolist() == [(0, False), (1, True), (2, False)]


# -- stores and streams ----------------------------------------------------------------------


def test_store(spark):
    store = UnitStore(spark, new_path(spark, "store-test"))
    units = spark.createDataFrame([(1, "b"), (0, "a"), (2, "b")], "o int, t string")
    assert store.put("m", units, "t", ["o"]) == 2 and store.put("n", units.where("o < 2"), "t", ["o"]) == 0
    assert [r.data for r in store.get("m").orderBy("ord").collect()] == ["a", "b", "b"]
    assert store.ref("head") == (0, None)
    first, second = store.transaction("head"), store.transaction("head")
    assert first.commit("m") == 1 and store.ref("head") == (1, "m")
    with pytest.raises(Conflict):
        second.commit("n")
    with pytest.raises(Conflict, match="spent"):
        first.commit("n")


def test_store_with_two_writers(spark):
    root = new_path(spark, "store-test")
    one, two = UnitStore(spark, root), UnitStore(spark, root)
    units = spark.createDataFrame([(0, "a"), (1, "b")], "o int, t string")
    one.put("m", units, "t", ["o"])
    # A second writer that hasn't seen the first one's units adds the same again.
    units.selectExpr("sha2(CAST(t AS binary), 256) AS hash", "t AS data").write.mode("append").parquet(f"{root}/units")
    assert two.get("m").count() == 2 and two.size() == 2
    two.put("m", units.where("o = 1"), "t", ["o"])
    assert [r.data for r in one.get("m").collect()] == ["b"] and one.ref("manifests/m")[0] == 2
    one.remove()
    with pytest.raises(KeyError):
        two.get("m")


def test_shared_folder_off_this_machine(spark):
    from types import SimpleNamespace

    from quillon.plans import tables

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(unset)
    since = tables.mark()
    path = tables.new_path(spark, "released")
    spark.range(1).write.parquet(path)
    tables.release(since)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_insert_at_the_top(spark):
    kind = "id string, parent_id string, ord bigint, head string, atom string, label string"
    old = spark.createDataFrame([("p", None, 0, "x", None, None), ("q", None, 1, "x", None, None), ("k", "p", 0, "x", None, None)], kind)
    grown = Graph(old, spark.createDataFrame([], "src string, dst string, kind string")).insert(spark.createDataFrame([("new", None, 0, "x", None, None)], kind))
    assert {r.id: r.ord for r in grown.nodes.collect()} == {"new": 0, "p": 1, "q": 2, "k": 0}


def test_build_to_a_depth(code, spark):
    root = named(code, spark, "main").first().id
    tree = code.build(root, "inside call refers", 1, limit=2)
    assert len(tree["kids"]) == 2 and all(not k["kids"] for k in tree["kids"])


def test_csv_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n2,\n")
    assert rows(forms.csv_seq(spark, str(tmp_path / "a.csv"), "n int, s string")) == [(1, "x"), (2, None)]
    (tmp_path / "b.txt").write_text("one\r\ntwo\n")
    assert [(r.ln, r.line) for r in forms.line_seq(spark, str(tmp_path / "b.txt")).orderBy("ln").collect()] == [(1, "one"), (2, "two")]


def test_streams(spark, tmp_path):
    channel = Channel(spark, str(tmp_path / "ch"), "k string, v double", size=2)
    for k in range(2):
        assert channel.offer(spark.createDataFrame([("a", float(k)), ("b", 1.0)], "k string, v double").coalesce(1))
    assert not channel.offer(spark.createDataFrame([("a", 1.0)], "k string, v double"))
    state = running_state(channel.take(), "k", "v", lambda now, values: now + values.sum(), 0.0)
    query = state.writeStream.format("memory").queryName("sums").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.k: r.s for r in spark.sql("SELECT k, max(state) AS s FROM sums GROUP BY k").collect()} == {"a": 1.0, "b": 2.0}
    channel.close()
    with pytest.raises(ValueError, match="closed"):
        channel.put(spark.range(1))


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    log = spark.createDataFrame([(1, "x", "put", 1), (1, "y", "put", 2), (2, None, "delete", 3), (3, "c", "put", 4)], "k int, v string, op string, n int")
    assert rows(apply_changes(base, log, ["k"], "n")) == [(1, "y"), (3, "c")]
