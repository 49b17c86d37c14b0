"""Queries handle all rows of their tables."""

import pytest
from pyspark.sql import functions as F

import quillon.graph_queries  # noqa: F401
from quillon.queries import QUERIES


@pytest.mark.parametrize(("name", "table", "key", "found"), [("graph_contexts", "orders", "o_orderkey", "substring(id, 2)"), ("graph_closure", "supplier", "s_suppkey", "seed")])
def test_all_rows_are_handled(spark, sf_dir, name, table, key, found):
    rows = QUERIES[name](spark, sf_dir).select(F.expr(found).cast("bigint").alias("k")).distinct()
    assert rows.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()


def test_all_roots_have_callers(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 0")
    wanted = orders.select(F.expr("concat('s', o_orderkey % 10)").alias("root")).distinct()
    assert QUERIES["graph_callers_d2"](spark, sf_dir).select("root").distinct().count() == wanted.count() > 5


def test_interleave_ends_with_the_shorter(spark, tmp_path):
    for name, key, n in (("supplier", "s_suppkey", 40), ("nation", "n_nationkey", 25)):
        spark.range(n).select(F.col("id").alias(key)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["seq_interleave"](spark, str(tmp_path)).count() == 50
