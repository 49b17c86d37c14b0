"""Array and map columns: positions from 0, absent keys told from null values, last key wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- arrays ----------------------------------------------------------------------------------


def first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def second(a: Column) -> Column:
    return F.try_element_at(a, F.lit(2))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


peek = last


def rest(a: Column, n: int = 1) -> Column:
    """All but the first n."""
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def butlast(a: Column, n: int = 1) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


pop = butlast


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def take_last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def take_while(a: Column, pred: Callable[[Column], Column]) -> Column:
    return F.slice(a, F.lit(1), _run(a, pred))


def drop_while(a: Column, pred: Callable[[Column], Column]) -> Column:
    return F.slice(a, _run(a, pred) + 1, F.greatest(F.size(a), F.lit(0)))


def _run(a: Column, pred: Callable[[Column], Column]) -> Column:
    stop = F.array_position(F.transform(a, lambda x: F.coalesce(pred(x), F.lit(False))), F.lit(False))
    return F.when(stop == 0, F.size(a)).otherwise(stop.cast("int") - 1)


def nth(a: Column, n: int, not_found: Column | None = None) -> Column:
    """The element at place n; out of range raises unless not_found is given."""
    return F.element_at(a, n + 1) if not_found is None else F.when(F.size(a) > n, F.get(a, F.lit(n))).otherwise(not_found)


def ffirst(a: Column) -> Column:
    """The first of the first; of arrays of arrays."""
    return first(first(a))


def next_(a: Column, n: int = 1) -> Column:
    """rest, but null where nothing is left."""
    return not_empty(rest(a, n))


def split_at(a: Column, n: int) -> Column:
    return F.array(take(a, n), rest(a, n))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def into(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def not_every(a: Column, pred: Callable[[Column], Column]) -> Column:
    return ~every(a, pred)


def partition_all(a: Column, n: int, step: int | None = None) -> Column:
    return partition(a, n, step, whole=False)


def subvec(a: Column, start: int, end: int) -> Column:
    return F.slice(a, start + 1, end - start)


def conj(a: Column, *xs: Column) -> Column:
    return reduce(F.array_append, xs, a)


def cons(x: Column, a: Column) -> Column:
    return F.array_prepend(a, x)


def filter_(a: Column, pred: Callable[[Column], Column]) -> Column:
    return F.filter(a, lambda x: F.coalesce(pred(x), F.lit(False)))


def remove(a: Column, pred: Callable[[Column], Column]) -> Column:
    return F.filter(a, lambda x: ~F.coalesce(pred(x), F.lit(False)))


def keep(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(a, f), lambda x: x.isNotNull())


def map_indexed(a: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.transform(a, lambda x, i: f(i, x))


def mapcat(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(a, f))


def every(a: Column, pred: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.forall(a, lambda x: F.coalesce(pred(x), F.lit(False))), F.lit(True))


def some(a: Column, pred: Callable[[Column], Column]) -> Column:
    return F.exists(a, lambda x: F.coalesce(pred(x), F.lit(False)))


def not_any(a: Column, pred: Callable[[Column], Column]) -> Column:
    return ~some(a, pred)


def distinct(a: Column) -> Column:
    return F.array_distinct(a)


def dedupe(a: Column) -> Column:
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["i"] == 0) | ~s["x"].eqNullSafe(F.get(a, s["i"] - 1))), lambda s: s["x"])


def partition(a: Column, n: int, step: int | None = None, whole: bool = True) -> Column:
    """Windows of n elements at every step-th place; short ones only if `whole` is false."""
    step = step or n
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: (i % step == 0) & (i < F.size(a)))
    out = F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(n)))
    return F.filter(out, lambda w: F.size(w) == n) if whole else out


def interleave(*arrays: Column) -> Column:
    size = F.least(*(F.size(a) for a in arrays))
    return F.flatten(F.transform(F.slice(F.sequence(F.lit(0), F.greatest(size, F.lit(1))), F.lit(1), size), lambda i: F.array(*(F.get(a, i) for a in arrays))))


def interpose(separator: Column, a: Column) -> Column:
    return F.flatten(F.transform(a, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(separator, x))))


def sort(a: Column) -> Column:
    """Ascending, null first."""
    return F.sort_array(a)


def sort_by(a: Column, key: Callable[[Column], Column]) -> Column:
    return F.transform(F.sort_array(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))), lambda s: s["x"])


def reduce_(a: Column, initial: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, initial, f)


def reductions(a: Column, initial: Column, f: Callable[[Column, Column], Column]) -> Column:
    """initial and each accumulator after it."""
    return F.aggregate(a, F.array(initial), lambda acc, x: F.array_append(acc, f(F.element_at(acc, -1), x)))


def frequencies(a: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(F.filter(a, lambda x: x.isNotNull())), lambda x: F.struct(x.alias("k"), F.size(F.filter(a, lambda y: y == x)).alias("n"))))


def replace(a: Column, smap: Column) -> Column:
    """Elements that are keys of the map, by their values."""
    return F.transform(a, lambda x: F.when(F.map_contains_key(smap, x), F.element_at(smap, x)).otherwise(x))


def not_empty(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def is_empty(a: Column) -> Column:
    return a.isNull() | (F.size(a) == 0)


def flatten(a: Column, depth: int) -> Column:
    return reduce(lambda x, _: F.flatten(x), range(depth), a)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def disj(a: Column, *xs: Column) -> Column:
    return reduce(F.array_remove, xs, a)


# -- maps ------------------------------------------------------------------------------------


def get(m: Column, key: Column, not_found: Column | None = None) -> Column:
    """The value, or not_found only where the key is absent (a null value stays)."""
    return F.try_element_at(m, key) if not_found is None else F.when(F.map_contains_key(m, key), F.try_element_at(m, key)).otherwise(not_found)


def contains(m: Column, key: Column) -> Column:
    return F.map_contains_key(m, key)


def assoc(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def dissoc(m: Column, *keys: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(F.array(*keys), k))


def find(m: Column, key: Column) -> Column:
    """The entry of the key; null where it is absent."""
    return F.try_element_at(F.filter(F.map_entries(m), lambda e: e["key"] == key), F.lit(1))


def select_keys(m: Column, *keys: Column) -> Column:
    return F.map_filter(m, lambda k, _: F.array_contains(F.array(*keys), k))


def update(m: Column, key: Column, f: Callable[[Column], Column]) -> Column:
    return assoc(m, key, f(F.try_element_at(m, key)))


def update_vals(m: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform_values(m, lambda _, v: f(v))


def update_keys(m: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform_keys(m, lambda k, _: f(k))


def merge(*maps: Column) -> Column:
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps)


def merge_with(f: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(a, k) & F.map_contains_key(b, k), f(x, y)).when(F.map_contains_key(a, k), x).otherwise(y))


def zipmap(keys: Column, values: Column) -> Column:
    """Keys to values up to the shorter; of equal keys the last wins."""
    n = F.least(F.size(keys), F.size(values))
    ks, vs = F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n)
    entries = F.transform(ks, lambda k, i: F.struct(k.alias("k"), F.get(vs, i).alias("v"), i.alias("i")))
    last_ = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last_, lambda e: F.struct(e["k"], e["v"])))


def reduce_kv(m: Column, initial: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    return F.aggregate(F.map_entries(m), initial, lambda a, e: f(a, e["key"], e["value"]))


def get_in(x: Column, *path: str) -> Column:
    return reduce(lambda a, k: a[k], path, x)


def assoc_in(x: Column, path: str, value: Column) -> Column:
    """A struct with the field at the dotted path replaced."""
    return x.withField(path, value)


def update_in(x: Column, path: str, f: Callable[[Column], Column]) -> Column:
    return x.withField(path, f(get_in(x, *path.split("."))))


def keys(m: Column) -> Column:
    return F.map_keys(m)


def vals(m: Column) -> Column:
    return F.map_values(m)
