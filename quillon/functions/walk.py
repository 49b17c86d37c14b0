"""Walks over nested values. A value's depth is fixed by its type, so a walk is one expression, built
along the schema: structs, arrays and map values are entered, map keys are left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Visit = Callable[[Column, T.DataType], Column]


def walk(x: Column, kind: T.DataType, inner: Visit, outer: Visit) -> Column:
    """outer of the value whose direct parts are replaced by inner of them."""
    return outer(_parts(x, kind, inner), kind)


def postwalk(x: Column, kind: T.DataType, f: Visit) -> Column:
    """f of every value, parts first; f keeps each value's type."""
    return f(_parts(x, kind, lambda y, k: postwalk(y, k, f)), kind)


def prewalk(x: Column, kind: T.DataType, f: Visit) -> Column:
    """f of every value, the whole first; f keeps each value's type."""
    return _parts(f(x, kind), kind, lambda y, k: prewalk(y, k, f))


def _parts(x: Column, kind: T.DataType, f: Visit) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda y: f(y, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, y: f(y, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(f(x[c.name], c.dataType).alias(c.name) for c in kind)))
    return x


def replace(x: Column, kind: T.DataType, values: dict) -> Column:
    """Values that are keys of the dictionary, at any depth, by what it has for them."""

    def one(y: Column, k: T.DataType) -> Column:
        fits = {a: b for a, b in values.items() if (isinstance(a, str) and isinstance(k, T.StringType)) or (not isinstance(a, str) and isinstance(k, T.NumericType) and not isinstance(a, bool)) or (isinstance(a, bool) and isinstance(k, T.BooleanType))}
        out = y
        for a, b in fits.items():
            out = F.when(y == F.lit(a), F.lit(b).cast(k)).otherwise(out)
        return out

    return postwalk(x, kind, one)


def stringify_keys(x: Column, kind: T.DataType) -> Column:
    """Maps with their keys as texts, at any depth."""
    if isinstance(kind, T.MapType):
        inner = F.transform_values(x, lambda _, y: stringify_keys(y, kind.valueType))
        return F.transform_keys(inner, lambda k, _: k.cast("string"))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda y: stringify_keys(y, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(stringify_keys(x[c.name], c.dataType).alias(c.name) for c in kind)))
    return x


keywordize_keys = stringify_keys


def for_(sources: list[tuple[str, DataFrame | Column]], when: Column | None = None, let: dict[str, Column] | None = None) -> DataFrame:
    """A comprehension: the first source is a frame, each later one a frame (all its rows, for every
    row so far) or an array column over what is bound so far (its elements, under the name); then
    `let` binds expressions and `when` keeps the rows for which it is neither null nor false."""
    out = None
    for name, source in sources:
        if isinstance(source, DataFrame):
            out = source if out is None else out.crossJoin(source)
        else:
            out = out.withColumn(name, F.explode(source))
    for name, value in (let or {}).items():
        out = out.withColumn(name, value)
    return out if when is None else out.where(F.coalesce(when, F.lit(False)))


def print_table(df: DataFrame, keys: list[str] | None = None, limit: int = 1_000) -> str:
    """The rows, up to `limit`, as a table of text."""
    columns = keys or df.columns
    rows = [[("" if v is None else str(v)) for v in r] for r in df.select(columns).limit(limit).collect()]
    widths = [max(len(x) for x in [c, *(r[k] for r in rows)]) for k, c in enumerate(columns)]
    line = lambda cells: "| " + " | ".join(c.rjust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    return "\n".join([line(columns), "|" + "+".join("-" * (w + 2) for w in widths) + "|", *map(line, rows)])
