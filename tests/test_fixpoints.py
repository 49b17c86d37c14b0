"""Scans, picks, rules, classes, values and journals on small known answers and against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import fixpoints as fx
from quillon.operators.seq import TOP, Seq
from quillon.plans import jobs
from quillon.plans.jobs import differences
from quillon.plans.journal import Journal
from quillon.plans.tables import new_path
from quillon.sources.store import UnitStore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n: int = 20_000):
    """Rows of which nine in ten have one key; nulls among keys and values."""
    rng = random.Random(4)
    rows = [(k, "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.choice([None, *range(50)]), rng.choice("xyz")) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id int, key string, v int, c string").repartition(6)


def test_scans_over_several_blocks(spark):
    rows, df = hot(spark)
    got = Seq(df, ("id",)).scan(lambda a, b: F.right(F.concat(a, b), F.lit(5)), F.col("c"), "s").orderBy("id").collect()
    text = "".join(r[3] for r in rows)
    assert [r.s for r in got] == [text[max(0, k - 4) : k + 1] for k in range(len(rows))] and [r.id for r in got] == list(range(len(rows)))
    by = {}
    for r in Seq(df, ("id",), ("key",)).scan(lambda a, b: F.greatest(a, b), F.col("v"), "s").orderBy("id").collect():
        most = max([x for x in (by.get(r.key), r.v) if x is not None], default=None)
        assert r.s == most
        by[r.key] = most
    assert Seq(df.limit(0), ("id",)).scan(lambda a, b: a + b, F.col("v")).count() == 0


def test_picks_of_a_hot_key(spark):
    rows, df = hot(spark, 3000)
    keys = {r[1] for r in rows}
    for name, pick in (("max_key", max), ("min_key", min)):
        got = {r.key: r.id for r in getattr(Seq(df, ("id",), ("key",)), name)(F.col("v")).df.collect()}
        assert got == {k: max(r[0] for r in rows if r[1] == k and r[2] == pick(x[2] for x in rows if x[1] == k and x[2] is not None)) for k in keys}
        assert getattr(Seq(df, ("id",)), name)(F.col("v")).df.first().id == max(r[0] for r in rows if r[2] == pick(x[2] for x in rows if x[2] is not None))
    got = {(r.key, r.v): r.id for r in Seq(df, ("id",)).distinct("key", "v").df.collect()}
    first = {}
    for r in rows:
        first.setdefault((r[1], r[2]), r[0])
    assert got == first
    want = [r[0] for k, r in enumerate(rows) if not k or rows[k - 1][3] != r[3]]
    assert sorted(r.id for r in Seq(df, ("id",)).dedupe(F.col("c")).df.collect()) == want
    assert Seq(df.limit(0), ("id",), ("key",)).max_key(F.col("v")).df.count() == Seq(df.limit(0), ("id",)).min_key(F.col("v")).df.count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "id int, v int")
    assert [r.id for r in Seq(nulls, ("id",)).max_key(F.col("v")).df.collect()] == [2]


def test_many_rows_are_taken_by_place(spark):
    df = spark.range(TOP + 300).withColumn("k", -F.col("id")).repartition(3)
    taken = Seq(df, ("k",)).take(TOP + 1).df
    assert "TakeOrderedAndProject" not in plan(taken) and taken.agg(F.count("*"), F.min("id")).first()[:] == (TOP + 1, 299)
    assert "TakeOrderedAndProject" in plan(Seq(df, ("k",)).take(5).df)
    woven = Seq(df.limit(3), ("id",)).interleave(Seq(df, ("id",)))
    assert "TakeOrderedAndProject" not in plan(woven) and woven.count() == 6


def test_rules_that_feed_each_other(spark):
    rng = random.Random(2)
    pairs = [(f"m{k}", f"m{rng.randrange(40)}", f"m{rng.randrange(40)}") for k in range(40)]
    edges = [(f"m{rng.randrange(40)}", f"m{rng.randrange(40)}") for _ in range(20)]
    kept = {"m1", "m2", "m3"}
    while True:
        more = {b for a, b in edges if a in kept} | {k for k, a, b in pairs if a in kept and b in kept}
        if more <= kept:
            break
        kept |= more
    rules = [fx.both(spark.createDataFrame(pairs, "id string, first string, second string")), fx.follows(spark.createDataFrame(edges, "src string, dst string"))]
    roots = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("m1",)], "id string")
    got = [r.id for r in fx.derive(roots, rules).collect()]
    assert sorted(got) == sorted(kept) and len(kept) > 4
    with pytest.raises(ValueError, match="1 rounds"):
        fx.derive(roots, rules, 1)


def test_every_entity_has_one_class(spark):
    """A small program: dead functions that call each other, enumerators before live ones, members set by
    position, structs cast to one another, and a name that two classes claim."""
    members = [("pair.left", "pair", 0), ("pair.right", "pair", 1), ("req.kind", "req", 0), ("req.start", "req", 1), ("box.only", "box", 0), ("raw.a", "raw", 0), ("raw.b", "raw", 1), ("view.a", "view", 0), ("lone.x", "lone", 0)]
    enums = [("Z0", "e0", 0, False), ("Z1", "e0", 1, False), ("Z2", "e0", 2, False), ("RED", "colour", 0, True), ("BLUE", "colour", 1, False), ("K1", "own", 0, True), ("K2", "own", 1, True), ("MAX", "big", 0, True)]
    others = ["main", "callee", "dead_callee", "dead_caller", "size", "seen", "dead", "r0", "pair", "req", "box", "raw", "view", "lone"]
    rows = [(k, "M", o, n, None) for k, o, n in members] + [(k, "N", o, n, x) for k, o, n, x in enums] + [(k, "F", None, None, None) for k in others]
    entities = spark.createDataFrame(rows, "id string, kind string, owner string, ord int, explicit boolean")
    calls = {"main": ["callee", "pair.left", "box.only", "r0", "req.kind", "seen", "MAX", "BLUE", "K2"], "callee": ["Z2"], "dead_caller": ["dead_callee"], "r0": ["req"]} | {k: [o] for k, o, _ in members}
    edges = spark.createDataFrame([(a, b) for a, bs in calls.items() for b in bs], "src string, dst string")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    casts = spark.createDataFrame([("raw", "void"), ("void", "view"), ("lone", "lone")], "a string, b string")
    found = fx.partition(entities, edges, [("external", frame("main", "main")), ("asserted", frame("size", "main", "unheard of"))], casts, spark.createDataFrame([("req", 2), ("req", 1)], "owner string, n int"))
    got = {r.id: r["class"] or r.why for r in found.collect()}
    assert len(got) == len(rows) == found.count()
    assert got["main"] == "external" and got["size"] == "asserted"
    assert {k for k, v in got.items() if v == fx.HELD} == {"raw.a", "raw.b", "view.a"}
    assert {k for k, v in got.items() if v == fx.UNREACHED} == {"dead_callee", "dead_caller", "dead", "pair.right", "K1", "lone.x", "lone"}
    assert {k for k, v in got.items() if v == fx.POSITIONAL} == {"req.start"}
    assert {k for k, v in got.items() if v == fx.RENUMBERS} == {"Z0", "Z1", "RED"}
    assert {k for k, v in got.items() if v == fx.REACHED} == set(got) - {"main", "size", "raw.a", "raw.b", "view.a", "dead_callee", "dead_caller", "dead", "pair.right", "K1", "lone.x", "lone", "req.start", "Z0", "Z1", "RED"}


def test_values_spread_until_they_meet(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(36)]
    seeds = [(1, 5), (2, 5), (3, 7), (4, None), (9, 5), (9, 6), (11, 5)]
    sets: dict[int, set] = {}
    for k, v in seeds:
        sets.setdefault(k, set()).add(v)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = sets.get(a, set()) - sets.get(b, set())
            if new:
                sets.setdefault(b, set()).update(new)
                changed = True
    got = {r.id: (r.value, r.conflict) for r in fx.spread_values(spark.createDataFrame(seeds, "id int, value int"), spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {k: (next(iter(v)), False) if len(v) == 1 and None not in v else (None, True) for k, v in sets.items()}
    assert any(c for _, c in got.values()) and any(not c for _, c in got.values())


def test_a_journal_gives_every_version(spark):
    rng, start = random.Random(1), {k: f"v{k}" for k in [None, *range(60)]}
    frame = lambda d: spark.createDataFrame(list(d.items()), "k int, v string")
    journal, versions, changed = Journal(spark, new_path(spark, "journal"), ["k"]), [dict(start)], 0
    journal.open(frame(start))
    for edit in range(8):
        now = dict(versions[-1])
        puts = {rng.choice([None, *range(70)]): rng.choice([f"e{edit}", None]) for _ in range(3)}
        gone = [k for k in (rng.randrange(70), 5) if k not in puts]
        changed += sum(1 for k, v in puts.items() if k not in now or now[k] != v) + sum(1 for k in set(gone) if k in now)
        now |= puts
        for k in gone:
            now.pop(k, None)
        versions.append(now)
        journal.commit(frame(puts), spark.createDataFrame([(k,) for k in gone], "k int"))
    for v in (0, 3, 8):
        assert {r.k: r.v for r in journal.read(v).collect()} == versions[v]
    assert sum(journal.sizes) == changed and journal.written() <= 61 + changed
    journal.undo()
    assert {r.k: r.v for r in journal.read().collect()} == versions[7] and journal.version == 9
    for bad in (lambda: journal.read(99), lambda: journal.undo(0)):
        with pytest.raises(ValueError, match="no "):
            bad()


def test_a_journal_writes_whole_tables_seldom(spark):
    journal = Journal(spark, new_path(spark, "journal"), ["k"])
    journal.open(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    for edit in range(3):
        journal.commit(spark.createDataFrame([(1, f"x{edit}")], "k int, v string"))
    assert [v for v, _ in journal.bases] == [0, 3] and journal.written() == 7
    assert {r.k: r.v for r in journal.read(2).collect()} == {1: "x1", 2: "b"}
    with pytest.raises(ValueError, match="changed later"):
        journal.undo(2)


def test_a_put_reads_only_the_folders_it_hits(spark):
    store = UnitStore(spark, new_path(spark, "store"))
    many = spark.range(3000).selectExpr("id", "concat('unit ', id) AS data")
    assert store.put("many", many, "data", ["id"]) == 3000 and store.size() == 3000
    one = spark.createDataFrame([(0, "unit 7"), (1, "a new unit"), (2, "a new unit")], "id int, data string")
    buckets = store._buckets(one.select(F.sha2(F.col("data").cast("binary"), 256).alias("hash")))
    held = store._held(buckets).select("hash")
    assert len(buckets) <= 2 and "PartitionFilters: [bucket" in plan(held) and 0 < held.count() < 60
    assert store.put("one", one, "data", ["id"]) == 1 and store.size() == 3001
    assert [r.data for r in store.get("one").orderBy("ord").collect()] == ["unit 7", "a new unit", "a new unit"]
    assert store.get("many").where("data = concat('unit ', ord - 1)").count() == 3000


def test_differences_by_digests(spark, monkeypatch):
    kind = "a int, b string, c array<int>, d struct<x: int, y: int>, t timestamp_ntz"
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 5)
    rows = [(1, None, [None, 1], (None, 1), at), (None, "1", [1, None], (1, None), at), (1, None, [None, 1], (None, 1), at), (2, "", None, None, None), (3, "x", [], (1, 1), at)]
    df = lambda r: spark.createDataFrame(r, kind)
    for other, want in ((rows[::-1], (0, 0)), (rows[1:], (1, 0)), ([*rows, rows[3]], (0, 1)), ([(1, None, [1, None], (None, 1), at), *rows[1:]], (1, 1)), ([(1, None, [None, 1], (1, None), at), *rows[1:]], (1, 1)), ([*rows[:4], (3, "x", [], (1, 1), at.replace(microsecond=6))], (1, 1)), ([], (5, 0))):
        assert differences(df(rows), df(other)) == want
    many = spark.range(2000).selectExpr("id", "id % 7 AS v")
    seen = []
    monkeypatch.setattr(jobs, "_hashed", lambda x, f=jobs._hashed: seen.append(1) or f(x))
    assert differences(many, many.repartition(3)) == (0, 0) and len(seen) == 2
    assert differences(many, many.withColumn("v", F.when(F.col("id") == 9, 0).otherwise(F.col("v")))) == (1, 1)
