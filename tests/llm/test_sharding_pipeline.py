"""Operator 9's round trip, commits and tiers; the pipeline against its stages done plainly."""

import collections
import re

import pytest

import corpus_pipeline
from quillon.llm._base import new_path
from quillon.llm.sharding import CommitConflict, Shard, ShardSet, shard_documents

from .data import documents, empty, table
from .test_minhash import truth
from .test_text_rules import deleted, leaks


def test_round_trip(spark):
    df = table(spark)
    shards = shard_documents(df, new_path(spark, "test"), target_bytes=1 << 16)
    same = shards.read()
    assert same.columns == df.columns
    assert collections.Counter(map(tuple, same.collect())) == collections.Counter(map(tuple, df.collect()))
    named = {s["path"] for s in shards.manifest()["shards"]}
    assert {r.shard for r in shards.read(shard_col="shard").select("shard").distinct().collect()} <= named
    before = shards.manifest()["version"]
    assert shards.vacuum() == 0 < shards.vacuum(0) and shards.versions() == [before]
    assert shards.read().count() == df.count()


def test_empty_table(spark):
    assert shard_documents(empty(spark), new_path(spark, "test")).read().count() == 0


def test_conflict_leaves_the_version(spark):
    shards = ShardSet(spark, new_path(spark, "test"))
    shards.append(spark.range(3))
    with pytest.raises(CommitConflict):
        shards._commit(1, spark.range(1).schema, [])
    assert shards.read(1).count() == 3
    with pytest.raises(ValueError, match="schema"):
        shards.append(spark.range(1).selectExpr("CAST(id AS string) AS id"))


def test_vacuum_beside_a_writer(spark):
    shards = ShardSet(spark, new_path(spark, "test"))
    shards.append(spark.range(3))
    new = shards._write(spark.range(5))  # a writer that hasn't committed yet
    now = shards.manifest()
    assert shards.vacuum() == 0
    held = [Shard(**s) for s in now["shards"]]
    shards._commit(2, spark.range(1).schema, [*held, *new], new)
    assert shards.read().count() == 8
    late = shards._write(spark.range(7))
    assert shards.vacuum(0) > 0
    with pytest.raises(CommitConflict, match="removed"):
        shards._commit(3, spark.range(1).schema, [*held, *late], late)
    assert shards.read().count() == 8


def test_tiers(spark):
    shards = ShardSet(spark, new_path(spark, "test"), target_bytes=64 << 20, fan_in=4)
    mb = 1 << 20
    small = [Shard(f"a{k}", 1000 + k) for k in range(5)]
    middle = [Shard(f"b{k}", 5 * mb) for k in range(3)]
    large = [Shard(f"c{k}", 60 * mb) for k in range(9)]
    assert shards.plan([*small, *middle, *large]) == [small]
    assert shards.plan([*middle, Shard("b3", 6 * mb)]) == [[*middle, Shard("b3", 6 * mb)]]


def test_merges_until_target(spark):
    shards = ShardSet(spark, new_path(spark, "test"), target_bytes=64 << 20)
    for _ in range(5):
        shards.append(spark.range(1000).repartition(2))
    shards.compact()
    assert len(shards.manifest()["shards"]) == 1 and shards.read().count() == 5000


def test_old_version_stays_readable(spark):
    shards = ShardSet(spark, new_path(spark, "test"))
    for k in range(4):
        shards.append(spark.range(k, k + 1))
    shards.compact()
    assert shards.read(2).count() == 2 and shards.read().count() == 4


def test_pipeline(spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {k: t for k, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    language = corpus_pipeline.language(spark, docs, sf_dir)
    assert {r.doc_id for r in language.collect()} == set(kept) and language.columns == docs.columns
    gone = deleted(list(kept.items()), 50)
    lines = {k: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(k, ())) for k, t in kept.items() if len(gone.get(k, ())) < len(t.split("\n"))}
    groups = truth(list(lines.items()), 5)
    first = {k: t for k, t in lines.items() if groups[k][1] == k}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {k for k, t in first.items() if not leaks(t, bench)[4]}
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == clean and got


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_hostile_rows(spark, sf_dir, stage):
    name, f = corpus_pipeline.STAGES[stage]
    for df in (table(spark), empty(spark)):
        out = f(spark, df, sf_dir)
        assert out.count() <= df.count(), name
        if stage < 4:
            assert out.columns == df.columns
