"""What tables of many times the usual size bring: large keys, deep closures."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import quillon.function_queries  # noqa: F401
import quillon.graph_queries  # noqa: F401
from quillon.functions import codecs
from quillon.operators import fixpoints, graph, ranges, views
from quillon.operators.graph import Graph
from quillon.queries import ORACLE_SQL, QUERIES
from quillon.sources.forms import read_forms

from .oracle import compare


def test_times_of_large_keys(spark, tmp_path):
    """Hours of more than 2,562,047 don't fit 64 bits of nanoseconds."""
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    keys = [0, 59, 3_661, 2_562_047, 2_562_048, 6_000_000, 153_722_868, 2**32]
    rows = spark.createDataFrame([(k, at, 1, "view", 1.5, "{}") for k in keys], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    compare(spark, str(tmp_path), QUERIES["time_more"], ORACLE_SQL["time_more"])


def test_codecs_of_equal_texts(monkeypatch):
    """Equal values of a batch, and equal short messages, are worked on once; nulls stay nulls."""
    asked = []
    got = codecs._each(pd.Series(["a", None, "b", "a", "a"]), lambda x: asked.append(x) or x + x)
    assert got.tolist() == ["aa", None, "bb", "aa", "aa"] and asked == ["a", "b"]
    parsed = []
    monkeypatch.setattr(codecs.email, "message_from_string", lambda x, _f=codecs.email.message_from_string: parsed.append(x) or _f(x))
    short, long = "Content-Type: text/plain\n\nonly here", "Content-Type: text/plain\n\n" + "x" * codecs.SHORT
    for mail in (short, long):
        assert codecs._leaves(mail) == codecs._leaves(mail) and codecs._leaves(mail)[0]["text"] == mail.partition("\n\n")[2]
    assert parsed.count(short) == 1 and parsed.count(long) == 3


def test_edits_into_columns(spark, sf_dir):
    """Several edits of one buffer are columns of it: the plan has no join."""
    df = QUERIES["text_shift"](spark, sf_dir)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString() and df.columns == ["buf", "ln", "right_", "left_", "up", "low"]


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_places(spark, parts):
    """Sums over earlier kids, of parents whose kids are spread over partitions; they are dealt out once."""
    rng = random.Random(parts)
    rows = [(f"k{k:03}", rng.choice(["a", "b", "b", "b", f"c{k % 9}"]), rng.randrange(50), rng.randrange(5)) for k in range(200)]
    # Adaptive execution would make one of such small partitions.
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = ranges.places(spark.createDataFrame(rows, "id string, parent_id string, ord bigint, v bigint"), F.col("v"), "before")
        got = {r.id: r.before for r in df.collect()}
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    key = lambda r: (r[2], r[0])
    assert got == {r[0]: sum(x[3] for x in rows if x[1] == r[1] and key(x) < key(r)) for r in rows}


def walked(seeds, edges):
    """Pairs of a seed and what it reaches, and the least distances, by search."""
    out, to = {}, {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    for s in seeds:
        found, front, d = {s: 0}, {s}, 0
        while front:
            d += 1
            front = {b for a in front for b in to.get(a, ())} - found.keys()
            found |= dict.fromkeys(front, d)
        out[s] = found
    return out


@pytest.mark.parametrize("kind", ["cycles", "few", "chain"])
def test_closure_over_components(spark, kind, monkeypatch):
    """Pairs beyond so many times the edges come by components; with blocks of three members."""
    rng = random.Random(kind)
    edges = [(k, (k * 7 + 3) % 90) for k in range(90)] + [(k, (k * 3 + 1) % 90) for k in range(0, 90, 4)] if kind == "cycles" else [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] if kind == "few" else [(k, k + 1) for k in range(70)] + [(9, 3), (60, 60)]
    seeds = [(s, s) for s in range(0, 70, 2)] + [(0, 5), (None, 3), (7, None)]
    reach = walked({b for _, b in seeds}, edges)
    want = {(s, x) for s, b in seeds for x in reach[b]}
    monkeypatch.setattr(graph, "GROWTH", 1)
    monkeypatch.setattr(graph, "BLOCK", 3)
    used = []
    monkeypatch.setattr(graph, "_over_components", lambda *a, _f=graph._over_components: used.append(1) or _f(*a))
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(seeds, "seed int, id int"), spark.createDataFrame(edges, "src int, dst int")).collect()]
    assert used and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize(("kind", "joins"), [("ring", 8), ("wide", 60), ("few", 60)])
def test_distances(spark, kind, joins, monkeypatch):
    """Of a ring of 200 in eight joins, not 200 rounds; of hubs, whose walks are too many to table, by rounds."""
    rng = random.Random(kind)
    edges = [(k, (k + 1) % 200) for k in range(200)] if kind == "ring" else [(a, b) for k in range(12) for a in range(5 * k, 5 * k + 5) for b in range(5 * k + 5, 5 * k + 10)] if kind == "wide" else [(rng.randrange(150), rng.randrange(150)) for _ in range(200)]
    roots = [3] if kind == "ring" else [0, 1, 7]
    want = {}
    for found in walked(roots, edges).values():
        for x, d in found.items():
            want[x] = min(d, want.get(x, d))
    written = []
    monkeypatch.setattr(fixpoints, "materialise", lambda df, what, _f=fixpoints.materialise: written.append(what) or _f(df, what))
    got = fixpoints.distances(spark.createDataFrame([(r,) for r in roots], "id int"), spark.createDataFrame(edges, "src int, dst int")).collect()
    assert {r.id: r.round for r in got} == want and len(got) == len(want)
    assert written.count("now") <= joins


CODE = ["(defn f0 (= @o 1) (at @a 3)) (def more)", "(def o)", "(def a (array 4))", "x (defn f1 (= (index @a 1) 2) (call @o (-> (paren @o) m)))", "(defn f2 (-> @o) (. (index @o 1) m) ((nested (call @more 1)) ()) (@o -> m))", "", "()", "(defn f10 (struct t (label here)) (goto @here) (-> p @o))"]


@pytest.mark.parametrize("whole", [True, False])
def test_placed_forms(spark, whole, monkeypatch):
    """Forms placed as they are read are indexed and viewed as others are, and no level of their trees is joined."""
    holder = F.col("parent_id").isNull() & F.lit(True) if whole else F.col("head").isin("call", "nested", "defn")
    got = []
    for places in (True, False):
        code = read_forms(spark.createDataFrame([(k * 7 % 11, x) for k, x in enumerate(CODE)], "unit bigint, text string").repartition(3), places=places)
        kinds = code.nodes.where("label = 'a'").select(F.col("id").alias("src"), F.concat(F.split("id", "\\.")[0], F.lit(".0.2")).alias("dst"), F.lit("typed").alias("kind"))
        code = Graph(code.nodes.withColumn("called", F.col("atom") == "@o"), code.edges.unionByName(kinds), placed=places)
        with monkeypatch.context() as m:
            if places:
                m.setattr(graph, "tree_levels", None)
            code = code.index(holder=holder, statement=F.col("head") == "call", call=F.col("called"))
        uses = code.nodes.where("atom LIKE '@%' OR head = 'index'").select("id")
        roots = code.nodes.where("head = 'def'").select("id")
        columns = ["id", "parent_id", "depth", "root_id", "rank", "size", "room", "top_id", "stmt_id", "rep_id", "in_call"]
        views_ = [code.nodes.select(columns), code.edges, views.access(code, uses), views.use_forms(code, uses), views.tally(code, roots), code.callers(roots, 2)]
        got.append([sorted(map(str, df.select(sorted(df.columns)).collect())) for df in views_])
        new = spark.createDataFrame([("new", None, 9, "defn", None, "f")], "id string, parent_id string, ord bigint, head string, atom string, label string")
        got[-1].append(sorted(map(str, code.update(insert=new).nodes.select(columns).collect())))
    assert got[0] == got[1] and all(got[0])


@pytest.mark.parametrize("text", ["(a", "a)", "(a))", "(b) (a"])
def test_placed_forms_that_do_not_close(spark, text):
    with pytest.raises(Exception, match="missing|unexpected"):
        read_forms(spark.createDataFrame([(1, text)], "unit bigint, text string"), places=True)
