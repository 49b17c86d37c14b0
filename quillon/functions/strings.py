"""String functions: Unicode white space, character positions from 0, null for "absent"."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def is_blank(s: Column) -> Column:
    return s.isNull() | s.rlike(rf"\A{SPACE}*\z")


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1)))


def ends_with(s: Column, t: Column) -> Column:
    return F.endswith(s, t)


def starts_with(s: Column, t: Column) -> Column:
    return F.startswith(s, t)


def includes(s: Column, t: Column) -> Column:
    return F.contains(s, t)


def escape(s: Column, chars: dict[str, str]) -> Column:
    """Each character of the map replaced, all at once."""
    table = F.create_map(*(F.lit(x) for kv in chars.items() for x in kv))
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def index_of(s: Column, t: Column, start: int = 0) -> Column:
    return F.nullif(F.call_function("locate", t, s, F.lit(start + 1)), F.lit(0)) - 1


def last_index_of(s: Column, t: Column) -> Column:
    at = F.call_function("instr", F.reverse(s), F.reverse(t))
    return F.when(at > 0, F.length(s) - F.length(t) - at + 1)


def join(a: Column, separator: str = "") -> Column:
    """The elements' texts with the separator between them; a null element is an empty text."""
    return F.array_join(a.cast("array<string>"), separator, "")


def lower_case(s: Column) -> Column:
    return F.lower(s)


def upper_case(s: Column) -> Column:
    return F.upper(s)


def pad_left(s: Column, pad: str, n: int) -> Column:
    """Never cuts."""
    return F.lpad(s, F.greatest(F.lit(n), F.length(s)), F.lit(pad))


def pad_right(s: Column, pad: str, n: int) -> Column:
    return F.rpad(s, F.greatest(F.lit(n), F.length(s)), F.lit(pad))


def re_quote(s: str) -> str:
    """A pattern that matches s itself."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~\s-])", r"\\\1", s)


def replace(s: Column, match: str, by: str, regex: bool = False) -> Column:
    return F.regexp_replace(s, match, by) if regex else F.replace(s, F.lit(match), F.lit(by))


def replace_first(s: Column, match: str, by: str, regex: bool = False) -> Column:
    """The first match replaced; a literal `by` unless regex, where $1 is the first group."""
    pattern = match if regex else re_quote(match)
    by = by if regex else by.replace("\\", "\\\\").replace("$", "\\$")
    hit = F.regexp_extract(s, f"({pattern})", 0)
    at = F.regexp_instr(s, F.lit(f"({pattern})"))
    done = F.concat(F.substr(s, F.lit(1), at - 1), F.regexp_replace(hit, f"^(?:{pattern})$", by) if regex else F.lit(by.replace("\\$", "$").replace("\\\\", "\\")), F.substr(s, at + F.length(hit)))
    return F.when(at > 0, done).otherwise(s)


def reverse(s: Column) -> Column:
    return F.reverse(s)


def split(s: Column, separator: str, n: int = -1, regex: bool = False) -> Column:
    return F.split(s, separator if regex else re_quote(separator), n)


def split_lines(s: Column) -> Column:
    return F.split(s, "\r?\n")


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{SPACE}+|{SPACE}+\z", "")


def trim_left(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{SPACE}+", "")


def trim_right(s: Column) -> Column:
    return F.regexp_replace(s, rf"{SPACE}+\z", "")


def trim_newline(s: Column) -> Column:
    return F.regexp_replace(s, r"[\r\n]+\z", "")
