"""Time functions. Durations are 64-bit nanoseconds, as numbers; times have microseconds."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NANOSECOND, MICROSECOND, MILLISECOND, SECOND = 1, 10**3, 10**6, 10**9
MINUTE, HOUR = 60 * SECOND, 3_600 * SECOND

#: Named layouts. The reference times that the layouts are written with.
ANSI_C = "Mon Jan _2 15:04:05 2006"
KITCHEN = "3:04PM"
RFC1123 = "Mon, 02 Jan 2006 15:04:05 MST"
RFC1123_Z = "Mon, 02 Jan 2006 15:04:05 -0700"
RFC3339 = "2006-01-02T15:04:05Z07:00"
RFC3339_NANO = "2006-01-02T15:04:05.999999999Z07:00"
RFC822 = "02 Jan 06 15:04 MST"
RFC822_Z = "02 Jan 06 15:04 -0700"
RFC850 = "Monday, 02-Jan-06 15:04:05 MST"
RUBY_DATE = "Mon Jan 02 15:04:05 -0700 2006"
STAMP = "Jan _2 15:04:05"
STAMP_MILLI = "Jan _2 15:04:05.000"
STAMP_MICRO = "Jan _2 15:04:05.000000"
STAMP_NANO = "Jan _2 15:04:05.000000000"
UNIX_DATE = "Mon Jan _2 15:04:05 MST 2006"

#: What each part of a layout is as a date pattern letter, longest first.
_PARTS = {
    "January": "MMMM", "Monday": "EEEE", "Z07:00": "XXX", "-07:00": "xxx", "Z0700": "XX", "-0700": "xx", "2006": "yyyy",
    "Jan": "MMM", "Mon": "EEE", "MST": "z", "_2": "ppd", "01": "MM", "02": "dd", "03": "hh", "04": "mm", "05": "ss", "06": "yy",
    "15": "HH", "PM": "a", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s",
}


def pattern(layout: str) -> str:
    """The date pattern of a layout. Fractions are kept up to microseconds; a padded day is
    written with a space by format()."""
    out, at = [], 0
    while at < len(layout):
        fraction = re.match(r"[.,](0+|9+)(?!\d)", layout[at:])
        part = next((p for p in _PARTS if layout.startswith(p, at)), None)
        if fraction:
            out.append(f"{fraction[0][0]}{'S' * min(9, len(fraction[1]))}")
            at += len(fraction[0])
        elif part:
            out.append("d" if part == "_2" else _PARTS[part])
            at += len(part)
        else:
            out.append(f"'{layout[at]}'" if layout[at].isalpha() else "''" if layout[at] == "'" else layout[at])
            at += 1
    return "".join(out)


def format_(t: Column, layout: str) -> Column:
    before, padded, after = layout.partition("_2")
    if not padded:
        return F.date_format(t, pattern(layout))
    parts = [F.date_format(t, pattern(p)) for p in (before, after) if p]
    day = F.lpad(F.dayofmonth(t).cast("string"), 2, " ")
    return F.concat(*([parts[0]] if before else []), day, *(parts[-1:] if after else []))


def parse(s: Column, layout: str) -> Column:
    """Null where the text doesn't fit the layout."""
    return F.try_to_timestamp(s, F.lit(pattern(layout)))


def parse_in_timezone(s: Column, layout: str, zone: str) -> Column:
    return F.to_utc_timestamp(parse(s, layout), zone)


def add(t: Column, d: Column) -> Column:
    """t + d nanoseconds, whole microseconds of them."""
    return F.timestamp_micros(F.unix_micros(t.cast("timestamp")) + F.call_function("div", d.cast("bigint"), F.lit(1000)))


def sub(t: Column, u: Column) -> Column:
    return (F.unix_micros(t.cast("timestamp")) - F.unix_micros(u.cast("timestamp"))) * 1000


def add_date(t: Column, years: Column, months: Column, days: Column) -> Column:
    """Calendar addition that carries over: January 31 and a month is early in March."""
    months_ = (F.year(t) + years) * 12 + F.month(t) - 1 + months
    first = F.make_date(F.floor(months_ / 12).cast("int"), (F.pmod(months_, F.lit(12)) + 1).cast("int"), F.lit(1))
    day = F.date_add(first, (F.dayofmonth(t) - 1 + days).cast("int"))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("day", t).cast("timestamp")))


def day_of_year(t: Column) -> Column:
    return F.dayofyear(t)


def from_unix(seconds: Column, nanos: Column | None = None) -> Column:
    micros = seconds.cast("bigint") * 1_000_000
    return F.timestamp_micros(micros if nanos is None else micros + F.call_function("div", nanos.cast("bigint"), F.lit(1000)))


def unix(t: Column) -> Column:
    return F.floor(F.unix_micros(t.cast("timestamp")) / 1_000_000).cast("bigint")


def in_timezone(t: Column, zone: str) -> Column:
    return F.from_utc_timestamp(t, zone)


def now() -> Column:
    return F.current_timestamp()


def since(t: Column) -> Column:
    return sub(now(), t)


def until(t: Column) -> Column:
    return sub(t, now())


def _in(d: Column, unit: int) -> Column:
    """A duration in units, the whole ones and the rest each as a double: whole units are exact."""
    return F.call_function("div", d, F.lit(unit)).cast("double") + (d % unit).cast("double") / F.lit(float(unit))


def hours(d: Column) -> Column:
    """Of a duration in nanoseconds; one beyond 292 years is a decimal, as 64 bits don't hold it."""
    return _in(d, HOUR)


def minutes(d: Column) -> Column:
    return _in(d, MINUTE)


def seconds(d: Column) -> Column:
    return _in(d, SECOND)


def truncate(d: Column, m: int) -> Column:
    """Toward zero to a multiple of m; unchanged for m <= 0."""
    return d if m <= 0 else d - d % m


def round_(d: Column, m: int) -> Column:
    """To the nearest multiple of m, half away from zero; unchanged for m <= 0."""
    if m <= 0:
        return d
    r = F.abs(d) % m
    up = F.when(r * 2 >= m, F.abs(d) - r + m).otherwise(F.abs(d) - r)
    return F.when(d < 0, -up).otherwise(up)


def truncate_time(t: Column, unit: str) -> Column:
    return F.date_trunc(unit, t)


_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def _parse_duration(text: str | None) -> int | None:
    if text is None or not (m := re.fullmatch(r"([+-]?)((?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))+|0)", text)):
        return None
    total = 0
    for whole, part, unit in re.findall(r"(\d*)\.?(\d*)(ns|us|µs|μs|ms|s|m|h)", m[2]):
        total += int(whole or 0) * _UNITS[unit] + int(part or 0) * _UNITS[unit] // 10 ** len(part)
    return -total if m[1] == "-" else total


def _duration_string(d: int | None) -> str | None:
    if d is None:
        return None
    sign, n = "-" if d < 0 else "", abs(int(d))
    if n == 0:
        return "0s"
    for unit, size in (("ns", 1), ("µs", 10**3), ("ms", 10**6)):
        if n < size * 1000 and n < SECOND:
            return sign + _decimal(n, size) + unit
    h, rest = divmod(n, HOUR)
    m, rest = divmod(rest, MINUTE)
    return sign + (f"{h}h" if h else "") + (f"{m}m" if h or m else "") + _decimal(rest, SECOND) + "s"


def _decimal(n: int, size: int) -> str:
    whole, part = divmod(n, size)
    digits = str(part).rjust(len(str(size)) - 1, "0").rstrip("0") if part else ""
    return f"{whole}.{digits}" if digits else str(whole)


@F.pandas_udf(T.LongType())
def parse_duration(s: pd.Series) -> pd.Series:
    """Nanoseconds of a duration like 1h15m30.5s; null where it isn't one."""
    return s.map(_parse_duration).astype("Int64")


@F.pandas_udf(T.StringType())
def duration_string(d: pd.Series) -> pd.Series:
    """The duration in the form 72h3m0.5s."""
    return d.astype("Int64").map(lambda x: None if pd.isna(x) else _duration_string(x))
