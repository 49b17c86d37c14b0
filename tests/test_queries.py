"""Every registered query of the reference's operators against its SQL; and the mandatory control:
a spoiled result must be seen."""

import re

import pytest

import quillon.function_queries  # noqa: F401
import quillon.graph_queries  # noqa: F401
from quillon.queries import ORACLE_SQL, QUERIES

from .oracle import compare, duck, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["rel_select", "seq_frequencies", "graph_contains", "text_count"])
def test_control(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns, expected = duck(sf_dir, ORACLE_SQL[name])
    spoiled = df.exceptAll(df.limit(1))
    assert rows([tuple(r) for r in spoiled.collect()], df.columns) != rows(expected, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_nothing_imports_llm():
    from pathlib import Path

    for path in Path(quillon.graph_queries.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
