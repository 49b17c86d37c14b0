"""Floating-point functions with IEEE results: infinities and NaN where Spark's own give null."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF, NAN = float("inf"), float("nan")

#: Constants.
E, PI = math.e, math.pi
PHI = (1 + math.sqrt(5)) / 2
LN_OF_2, LN_OF_10 = math.log(2), math.log(10)
LOG_2_OF_E, LOG_10_OF_E = 1 / math.log(2), 1 / math.log(10)
SQRT_OF_2, SQRT_OF_E, SQRT_OF_PI, SQRT_OF_PHI = math.sqrt(2), math.sqrt(math.e), math.sqrt(math.pi), math.sqrt(PHI)
MAX_DOUBLE = math.nextafter(INF, 0)
SMALLEST_NONZERO_DOUBLE = math.nextafter(0, 1)


def _d(x: Column) -> Column:
    return x.cast("double")


def abs_(x: Column) -> Column:
    return F.abs(x)


def ceil(x: Column) -> Column:
    return -floor(-_d(x))


def floor(x: Column) -> Column:
    """As a double; what lies beyond 64-bit integers is whole already."""
    return F.when(F.isnan(x) | (F.abs(_d(x)) >= 2.0**53), _d(x)).otherwise(F.floor(_d(x)).cast("double"))


def trunc(x: Column) -> Column:
    return F.when(_d(x) < 0, ceil(x)).otherwise(floor(x))


def round_(x: Column) -> Column:
    """Half away from zero."""
    return F.when(_d(x) < 0, ceil(_d(x) - 0.5)).otherwise(floor(_d(x) + 0.5))


def round_to_even(x: Column) -> Column:
    return F.rint(_d(x))


def is_negative_zero(x: Column) -> Column:
    return (_d(x) == 0) & (_d(x).cast("string") == "-0.0")


def sign_bit(x: Column) -> Column:
    return (_d(x) < 0) | is_negative_zero(x)


def copy_sign(x: Column, y: Column) -> Column:
    return F.when(sign_bit(y), -F.abs(_d(x))).otherwise(F.abs(_d(x)))


def sqrt(x: Column) -> Column:
    return F.sqrt(_d(x))


def cube_root(x: Column) -> Column:
    return F.cbrt(x)


def exp(x: Column) -> Column:
    return F.exp(x)


def exp_2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def exp_minus_1(x: Column) -> Column:
    return F.expm1(x)


def _log(f, x: Column, zero: float = 0.0) -> Column:
    return F.when(F.isnan(_d(x)), F.lit(NAN)).when(_d(x) > zero, f(_d(x))).when(_d(x) == zero, F.lit(-INF)).when(_d(x) < zero, F.lit(NAN))


def log(x: Column) -> Column:
    return _log(F.ln, x)


def log_2(x: Column) -> Column:
    return _log(F.log2, x)


def log_10(x: Column) -> Column:
    return _log(F.log10, x)


def log_plus_1(x: Column) -> Column:
    return _log(F.log1p, x, -1.0)


def log_binary(x: Column) -> Column:
    """The binary exponent."""
    return F.when(_d(x) == 0, F.lit(-INF)).otherwise(floor(F.log2(F.abs(_d(x)))))


def sin(x: Column) -> Column:
    return F.sin(x)


def cos(x: Column) -> Column:
    return F.cos(x)


def hypot(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def pow_(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def pow_10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n)


def dim(x: Column, y: Column) -> Column:
    return F.greatest(_d(x) - _d(y), F.lit(0.0))


def modf(x: Column) -> Column:
    """Array of the whole and the fractional part."""
    return F.array(trunc(x), _d(x) - trunc(x))


def inf(sign: int) -> Column:
    return F.lit(INF if sign >= 0 else -INF)


def is_inf(x: Column, sign: int = 0) -> Column:
    """An infinity of that sign; of either for 0."""
    up, down = _d(x) == F.lit(INF), _d(x) == F.lit(-INF)
    return up if sign > 0 else down if sign < 0 else up | down


def nan() -> Column:
    return F.lit(NAN)


def is_nan(x: Column) -> Column:
    return F.isnan(x)


@F.pandas_udf(T.DoubleType())
def next_after(x: pd.Series, y: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series(np.nextafter(x.to_numpy(float), y.to_numpy(float)))
