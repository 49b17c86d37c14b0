"""Predicates, comparisons, arithmetic, conversions and conditionals as Column functions.

Null is a value: it equals itself, sorts first, and is falsy like false; all else is truthy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_nil(x: Column) -> Column:
    return x.isNull()


def is_some(x: Column) -> Column:
    return x.isNotNull()


def is_true(x: Column) -> Column:
    return x.eqNullSafe(F.lit(True))


def is_false(x: Column) -> Column:
    return x.eqNullSafe(F.lit(False))


def not_(x: Column) -> Column:
    """Of a boolean: true for null and false."""
    return ~F.coalesce(x, F.lit(False))


def and_(*xs: Column) -> Column:
    """The first falsy boolean, else the last one."""
    return reduce(lambda a, b: F.when(F.coalesce(a, F.lit(False)), b).otherwise(a), xs)


def or_(*xs: Column) -> Column:
    """The first truthy boolean, else the last one."""
    return reduce(lambda a, b: F.when(F.coalesce(a, F.lit(False)), a).otherwise(b), xs)


def equal(*xs: Column) -> Column:
    return reduce(Column.__and__, [a.eqNullSafe(b) for a, b in zip(xs, xs[1:], strict=False)], F.lit(True))


def not_equal(*xs: Column) -> Column:
    return ~equal(*xs)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null first."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1)


def _chain(test: Callable[[Column, Column], Column], xs: tuple[Column, ...]) -> Column:
    return reduce(Column.__and__, [test(a, b) for a, b in zip(xs, xs[1:], strict=False)], F.lit(True))


def lt(*xs: Column) -> Column:
    return _chain(Column.__lt__, xs)


def le(*xs: Column) -> Column:
    return _chain(Column.__le__, xs)


def gt(*xs: Column) -> Column:
    return _chain(Column.__gt__, xs)


def ge(*xs: Column) -> Column:
    return _chain(Column.__ge__, xs)


def num_equal(*xs: Column) -> Column:
    """Equality of numbers whatever their types."""
    return _chain(lambda a, b: a.cast("double") == b.cast("double"), xs)


def is_zero(x: Column) -> Column:
    return x == 0


def is_pos(x: Column) -> Column:
    return x > 0


def is_neg(x: Column) -> Column:
    return x < 0


def is_even(x: Column) -> Column:
    return F.pmod(x, F.lit(2)) == 0


def is_odd(x: Column) -> Column:
    return F.pmod(x, F.lit(2)) == 1


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def is_distinct(*xs: Column) -> Column:
    """Whether no two values are equal."""
    return F.size(F.array_distinct(F.array(*xs))) == len(xs)


def type_name(x: Column) -> Column:
    """The type that the static type predicates are decided from."""
    return F.typeof(x)


def is_int(kind: str) -> bool:
    """Of a column's type (as in DataFrame.dtypes), as the other predicates of types."""
    return kind in ("tinyint", "smallint", "int", "bigint")


def is_number(kind: str) -> bool:
    return is_int(kind) or kind in ("float", "double") or kind.startswith("decimal")


def is_double(kind: str) -> bool:
    return kind in ("float", "double")


def is_string(kind: str) -> bool:
    return kind.startswith(("string", "varchar", "char"))


def is_bool(kind: str) -> bool:
    return kind == "boolean"


def is_map(kind: str) -> bool:
    return kind.startswith(("map<", "struct<"))


def is_vector(kind: str) -> bool:
    return kind.startswith("array<")


def is_coll(kind: str) -> bool:
    return is_map(kind) or is_vector(kind)


def is_pos_int(x: Column) -> Column:
    return F.coalesce(x > 0, F.lit(False))


def is_neg_int(x: Column) -> Column:
    return F.coalesce(x < 0, F.lit(False))


def is_nat_int(x: Column) -> Column:
    return F.coalesce(x >= 0, F.lit(False))


def is_keyword(x: Column) -> Column:
    """Of a text: whether it is a keyword, as keyword() makes them."""
    return F.coalesce(x.startswith(":"), F.lit(False))


def is_qualified(x: Column) -> Column:
    """Whether an identifier has a namespace."""
    return F.coalesce(x.rlike(r"^:?[^/]+/[^/]+$"), F.lit(False))


def is_simple(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^:?[^/]+$"), F.lit(False))


# -- arithmetic ------------------------------------------------------------------------------


def plus(*xs: Column) -> Column:
    return reduce(Column.__add__, xs, F.lit(0).cast("bigint"))


def plus_exact(*xs: Column) -> Column:
    """Without overflow up to 38 digits."""
    return reduce(Column.__add__, [x.cast("decimal(38,0)") for x in xs])


def minus_exact(*xs: Column) -> Column:
    return reduce(Column.__sub__, [x.cast("decimal(38,0)") for x in xs]) if len(xs) > 1 else -xs[0].cast("decimal(38,0)")


def times_exact(*xs: Column) -> Column:
    """The product of decimals, null beyond 38 digits."""
    return reduce(lambda a, b: F.try_multiply(a, b).cast("decimal(38,0)"), [x.cast("decimal(38,0)") for x in xs])


def wrapping_plus(a: Column, b: Column) -> Column:
    """The 64-bit sum, wrapped at the ends of the range as machine integers do."""
    wide = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    span, half = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    return (F.pmod(wide + half, span) - half).cast("bigint")


def minus(*xs: Column) -> Column:
    return -xs[0] if len(xs) == 1 else reduce(Column.__sub__, xs)


def times(*xs: Column) -> Column:
    return reduce(Column.__mul__, xs, F.lit(1).cast("bigint"))


def inc(x: Column) -> Column:
    return x + 1


def dec(x: Column) -> Column:
    return x - 1


def quot(n: Column, d: Column) -> Column:
    """The quotient, truncated toward zero."""
    return F.call_function("div", n, d)


def rem(n: Column, d: Column) -> Column:
    """The remainder, with the sign of n."""
    return n % d


def mod(n: Column, d: Column) -> Column:
    """The modulus, with the sign of d."""
    return F.when((n % d != 0) & ((n % d < 0) != (d < 0)), n % d + d).otherwise(n % d)


def ratio(n: Column, d: Column) -> Column:
    """The exact ratio as struct num, den: in lowest terms, den above 0. Zero for d raises."""
    a, b = n.cast("bigint"), d.cast("bigint")
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])
    sign = F.when(b < 0, -1).otherwise(1)
    checked = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(gcd)
    return F.struct((sign * F.call_function("div", a, checked)).alias("num"), F.call_function("div", F.abs(b), checked).alias("den"))


def numerator(r: Column) -> Column:
    return r["num"]


def denominator(r: Column) -> Column:
    return r["den"]


def divide(n: Column, d: Column) -> Column:
    """The quotient as a double; zero for d raises."""
    return n.cast("double") / F.when(d == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(d.cast("double"))


def bit_and(*xs: Column) -> Column:
    return reduce(Column.bitwiseAND, xs)


def bit_or(*xs: Column) -> Column:
    return reduce(Column.bitwiseOR, xs)


def bit_xor(*xs: Column) -> Column:
    return reduce(Column.bitwiseXOR, xs)


def bit_not(x: Column) -> Column:
    return F.bitwise_not(x)


def rand(n: float = 1.0, seed: int | None = None) -> Column:
    return (F.rand() if seed is None else F.rand(seed)) * n


def rand_int(n: int, seed: int | None = None) -> Column:
    return F.floor(rand(n, seed)).cast("bigint")


def hash_(x: Column) -> Column:
    return F.xxhash64(x)


def bit_and_not(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def _bit(n: int) -> Column:
    return F.shiftleft(F.lit(1).cast("bigint"), n)


def bit_clear(x: Column, n: int) -> Column:
    return x.bitwiseAND(F.bitwise_not(_bit(n)))


def bit_set(x: Column, n: int) -> Column:
    return x.bitwiseOR(_bit(n))


def bit_flip(x: Column, n: int) -> Column:
    return x.bitwiseXOR(_bit(n))


def bit_test(x: Column, n: int) -> Column:
    return F.getbit(x, F.lit(n)) == 1


def bit_count(x: Column) -> Column:
    return F.bit_count(x)


def bit_shift_left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n)


def bit_shift_right(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def unsigned_bit_shift_right(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def maximum(*xs: Column) -> Column:
    """The greatest number; null among them is an error, as nil is no number."""
    return F.when(reduce(Column.__or__, [x.isNull() for x in xs]), F.raise_error(F.lit("null isn't a number"))).otherwise(F.greatest(*xs) if len(xs) > 1 else xs[0])


def minimum(*xs: Column) -> Column:
    return F.when(reduce(Column.__or__, [x.isNull() for x in xs]), F.raise_error(F.lit("null isn't a number"))).otherwise(F.least(*xs) if len(xs) > 1 else xs[0])


# -- conversion ------------------------------------------------------------------------------


def to_int(x: Column) -> Column:
    """Truncated toward zero."""
    return x.cast("bigint")


def to_double(x: Column) -> Column:
    return x.cast("double")


def to_boolean(x: Column, kind: str = "boolean") -> Column:
    return F.coalesce(x, F.lit(False)) if kind == "boolean" else x.isNotNull()


def to_bigint(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def to_char(x: Column) -> Column:
    """The character of a codepoint up to 255, as char() has it."""
    return F.char(x)


def parse_long(s: Column) -> Column:
    """Decimal digits with an optional sign; null for anything else."""
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def parse_double(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(Inf(inity)?|NaN)$"), F.regexp_replace(F.regexp_replace(s, "^[+]", ""), "Inf$", "Infinity").try_cast("double"))


def parse_boolean(s: Column) -> Column:
    return F.when(s == "true", True).when(s == "false", False)


# -- strings of the core ---------------------------------------------------------------------


def str_(*xs: Column) -> Column:
    """The values' texts in a row; null is an empty text."""
    return F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in xs)) if xs else F.lit("")


def subs(s: Column, start: int, end: int | None = None) -> Column:
    return F.substring(s, start + 1, 2**31 - 1 - start if end is None else end - start)


def name(keyword: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(keyword, "^:", ""), "/"), -1)


def namespace(keyword: Column) -> Column:
    """What stands before the slash; null without one."""
    return F.when(keyword.contains("/"), F.split_part(F.regexp_replace(keyword, "^:", ""), F.lit("/"), F.lit(1)))


def keyword(*parts: Column) -> Column:
    """:name, or :namespace/name."""
    return F.concat(F.lit(":"), F.concat_ws("/", *parts))


def symbol(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def format_(pattern: str, *xs: Column) -> Column:
    return F.format_string(pattern, *xs)


def re_seq(pattern: str, s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def re_find(pattern: str, s: Column) -> Column:
    """The leftmost match; null without one."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 0))


def re_matches(pattern: str, s: Column) -> Column:
    """The text if all of it matches; else null."""
    return F.when(s.rlike(rf"\A(?:{pattern})\z"), s)


# -- conditionals and composition ------------------------------------------------------------


def cond(*clauses: Column, default: Column | None = None) -> Column:
    """Pairs of test and value; the value of the first truthy test."""
    out = F.when(F.coalesce(clauses[0], F.lit(False)), clauses[1])
    for test, value in zip(clauses[2::2], clauses[3::2], strict=True):
        out = out.when(F.coalesce(test, F.lit(False)), value)
    return out if default is None else out.otherwise(default)


def condp(pred: Callable[[Column, Column], Column], x: Column, *clauses: Column, default: Column | None = None) -> Column:
    tests = [y for value, result in zip(clauses[::2], clauses[1::2], strict=True) for y in (pred(value, x), result)]
    return cond(*tests, default=default if default is not None else F.raise_error(F.lit("no clause matches")))


def case(x: Column, *clauses, default: Column | None = None) -> Column:
    return condp(lambda a, b: a.eqNullSafe(b), x, *clauses, default=default)


def if_some(x: Column, then: Callable[[Column], Column], otherwise: Column | None = None) -> Column:
    return F.when(x.isNotNull(), then(x)).otherwise(otherwise if otherwise is not None else F.lit(None))


def some_thread(x: Column, *fs: Callable[[Column], Column]) -> Column:
    """x through the functions while it isn't null."""
    return reduce(lambda a, f: F.when(a.isNotNull(), f(a)), fs, x)


def cond_thread(x: Column, *clauses) -> Column:
    """x through the functions whose tests are truthy: test, function, test, function ..."""
    return reduce(lambda a, c: F.when(F.coalesce(c[0], F.lit(False)), c[1](a)).otherwise(a), zip(clauses[::2], clauses[1::2], strict=True), x)


def comp(*fs: Callable) -> Callable:
    return lambda x: reduce(lambda a, f: f(a), reversed(fs), x)


def juxt(*fs: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(*(f(x).alias(f"f{k}") for k, f in enumerate(fs)))


def complement(f: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *xs: not_(f(*xs))


def every_pred(*fs: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: and_(*(f(x) for f in fs))


def some_fn(*fs: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: or_(*(f(x) for f in fs))


def fnil(f: Callable[..., Column], *defaults: Column) -> Callable[..., Column]:
    return lambda *xs: f(*(F.coalesce(x, d) for x, d in zip(xs, defaults, strict=False)), *xs[len(defaults) :])


class Multimethod:
    """A function by the value of a dispatch expression; `default` where no method is installed."""

    def __init__(self, dispatch: Callable[..., Column], default: Callable[..., Column] | None = None):
        self.dispatch, self.default, self.methods = dispatch, default, {}

    def method(self, value) -> Callable:
        return lambda f: self.methods.__setitem__(value, f) or f

    def remove(self, value) -> None:
        self.methods.pop(value, None)

    def __call__(self, *xs: Column) -> Column:
        key = self.dispatch(*xs)
        clauses = [c for value, f in self.methods.items() for c in (key.eqNullSafe(F.lit(value)), f(*xs))]
        last = self.default(*xs) if self.default else F.raise_error(F.concat(F.lit("no method for "), F.coalesce(key.cast("string"), F.lit("nil"))))
        return cond(*clauses, default=last) if clauses else last
