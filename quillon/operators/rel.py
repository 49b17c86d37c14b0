"""Relational algebra over sets of rows: every result is duplicate-free, and null is an ordinary
value that equals itself, in keys as elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truthy(value: Column, kind: str = "boolean") -> Column:
    """Neither null nor false; of other kinds than boolean every value but null counts."""
    return F.coalesce(value, F.lit(False)) if kind == "boolean" else value.isNotNull()


def select(rel: DataFrame, pred: Column) -> DataFrame:
    """The rows whose predicate is neither null nor false."""
    return rel.where(truthy(pred)).distinct()


def project(rel: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the given columns only; columns that rel lacks are left out."""
    return rel.select([k for k in keys if k in rel.columns]).distinct()


def rename(rel: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed at once, so names may be swapped; a renamed column replaces one that has
    its new name already."""
    new = [names.get(c, c) for c in rel.columns if c in names or c not in {v for k, v in names.items() if k in rel.columns}]
    old = [c for c in rel.columns if c in names or c not in {v for k, v in names.items() if k in rel.columns}]
    return rel.select([F.col(f"`{o}`").alias(n) for o, n in zip(old, new, strict=True)]).distinct()


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    """A map column with keys renamed at once; a renamed key replaces one of its new name."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    kept = F.map_filter(m, lambda k, v: F.map_contains_key(table, k) | ~F.exists(F.map_values(F.map_filter(table, lambda a, b: F.map_contains_key(m, a))), lambda b: b == k))
    return F.transform_keys(kept, lambda k, v: F.coalesce(F.try_element_at(table, k), k))


def index(rel: DataFrame, keys: list[str], name: str = "rows") -> DataFrame:
    """One row for each value of the keys, with the set of rows that have it. A key's rows are one
    array, so this is for results that are read by key; use a join where a key may be hot."""
    return rel.groupBy(*keys).agg(F.collect_set(F.struct(*rel.columns)).alias(name))


def map_invert(m: Column) -> Column:
    """Values to keys; of equal values the last entry's key stays."""
    entries = F.map_entries(m)
    last = F.filter(entries, lambda e: ~F.exists(F.slice(entries, F.array_position(entries, e) + 1, F.size(entries)), lambda o: o["value"].eqNullSafe(e["value"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))


def join(x: DataFrame, y: DataFrame) -> DataFrame:
    """The natural join: rows that agree in all shared columns, nulls with nulls. Without shared
    columns it is the product, as the algebra has it; either side empty gives an empty result. Rows are
    told apart before they are joined, as the result has all columns of both."""
    shared = [c for c in x.columns if c in y.columns]
    if not shared:
        return x.distinct().crossJoin(y.distinct())
    a, b = x.distinct().alias("x"), y.distinct().alias("y")
    on = reduce(Column.__and__, [F.col(f"x.`{c}`").eqNullSafe(F.col(f"y.`{c}`")) for c in shared])
    columns = [F.col(f"x.`{c}`") for c in x.columns] + [F.col(f"y.`{c}`") for c in y.columns if c not in shared]
    return a.join(b, on).select(columns)


def join_on(x: DataFrame, y: DataFrame, keys: dict[str, str], winner: str | None = None) -> DataFrame:
    """The join of x's columns `keys` with the y columns they map to, nulls with nulls.

    Of other columns that both have, the larger relation's values win (of equally large ones,
    y's). Sizes are counted only if there are such columns and `winner` ("x" or "y") is not given.
    """
    both = [c for c in x.columns if c in y.columns]
    if both and winner is None:
        winner = "x" if x.distinct().count() > y.distinct().count() else "y"
    a, b = (x, y) if both else (x.distinct(), y.distinct())
    a, b = a.alias("x"), b.alias("y")
    on = reduce(Column.__and__, [F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{v}`")) for k, v in keys.items()])
    columns = [F.col(f"{'y' if c in both and winner == 'y' else 'x'}.`{c}`").alias(c) for c in x.columns] + [F.col(f"y.`{c}`") for c in y.columns if c not in both]
    joined = a.join(b, on).select(columns)
    return joined.distinct() if both else joined


def union(*rels: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rels).distinct()


def intersection(*rels: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b.select(a.columns)), rels)


def difference(first: DataFrame, *rels: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.subtract(b.select(a.columns)), rels, first.distinct())


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).isEmpty()


def is_superset(a: DataFrame, b: DataFrame) -> bool:
    return is_subset(b, a)
