"""The contract queries that SQL can express, against their SQL."""

import pytest

from quillon.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_all_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
