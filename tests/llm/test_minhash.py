"""Operator 7 against all pairs, its components against union-find, and the pipeline."""

import random
import re

import pytest

from quillon.llm import minhash as module
from quillon.llm.minhash import components, keep_first, near_duplicates

from .data import documents, empty, table


def truth(rows: list[tuple], n: int, percent: int = 80) -> dict:
    sets = {}
    for k, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[k] = frozenset(zip(*(w[j:] for j in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(seed: int) -> list[tuple]:
    """A hot group of near copies edited more and more, so that some link and some don't, with
    groups of exact copies in it, and other texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for k in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 16)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((k, " ".join(text)))
    out += [(1000 + k, out[k % 7][1]) for k in range(30)]
    return out + [(2000 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(60)]


@pytest.mark.parametrize(("seed", "n"), [(1, 2), (2, 5)])
def test_near_copies(spark, seed, n):
    rows = near_copies(seed)
    random.Random(seed).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), n).collect()}
    assert got == truth(rows, n)


def test_hostile(spark):
    df = table(spark)
    rows = {(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None}
    found = near_duplicates(df, 2).collect()
    assert len(found) == df.count()
    want = truth(sorted(rows, key=lambda x: x[0]), 2)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    left = keep_first(df, 2)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(r.doc_id for r in df.collect() if r.doc_id is not None and want[r.doc_id][1] == r.doc_id)
    assert near_duplicates(empty(spark)).count() == 0


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark), 5).collect()} == truth(rows, 5)


def test_all_pairs_of_a_thousand_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 2).collect()} == truth(rows, 2)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5), (500, 400), (500, 400)] + [(300, k) for k in range(301, 340)]
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {k: find(k) for k in parent if find(k) != k}
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


@pytest.mark.parametrize("small", [0, module.SMALL])
def test_small_sets_pass_the_gate(spark, monkeypatch, small):
    monkeypatch.setattr(module, "SMALL", small)
    # Pairs of four and five words of which four are shared: a similarity of 0.8.
    rows = [(2 * k + j, " ".join(f"w{k}x{i}" for i in range(4 + j))) for k in range(5_000) for j in (0, 1)]
    sizes = module._features(spark.createDataFrame(rows, "doc_id bigint, text string"), 1).selectExpr("doc_id AS id", "n", "sketch")
    pairs = spark.range(5_000).selectExpr("2 * id AS x", "2 * id + 1 AS y")
    assert module._plausible(pairs, sizes, 80).count() == 5_000


def test_percent_below_the_bands(spark):
    with pytest.raises(ValueError, match="percent"):
        near_duplicates(documents(spark), percent=70)
