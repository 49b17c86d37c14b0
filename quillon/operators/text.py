"""Line-oriented text operators on buffers: frames of (buf, ln, line), ln from 1 in each buffer.

Many buffers are worked on at once, and one may hold most of the lines: no edit has a window over a
whole buffer. A range is a Column predicate over ln and line, or a pair of line numbers. An edit by
line numbers computes the new ones from the old; one by a predicate numbers blocks of lines and adds
the counts of the blocks before. Moves, copies and puts join one row a buffer to its lines, which
leaves a large buffer to a broadcast or AQE's skew join. Null is a buffer like any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Range = Column | tuple[int, int] | None


def open_buffers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One buffer for each row, its text cut at newlines; a null text has no lines."""
    rows = df.select(F.col(id_col).alias("buf"), F.posexplode(F.split(text_col, "\n", -1)).alias("ln", "line"))
    return rows.withColumn("ln", (F.col("ln") + 1).cast("bigint"))


def close_buffers(buffer: DataFrame) -> DataFrame:
    """buf and text, the lines joined."""
    rows = buffer.groupBy("buf").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("l"))
    return rows.select("buf", F.array_join("l.line", "\n", "").alias("text"))


def _in(range_: Range) -> Column:
    if range_ is None:
        return F.lit(True)
    return F.col("ln").between(*range_) if isinstance(range_, tuple) else F.coalesce(range_, F.lit(False))


#: Lines in a block, which is what one task numbers at most, besides what a line was cut into.
BLOCK = 1 << 16


def renumber(keyed: DataFrame, *keys: str) -> DataFrame:
    """The lines numbered by the keys, in each buffer. The first key is a line number, which only
    the cuts of one line share."""
    rows = keyed.withColumns({"__buf": F.struct("buf"), "__block": F.floor(F.col(keys[0]) / BLOCK)})
    counts = rows.groupBy("__buf", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__buf").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__buf", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    placed = rows.withColumn("__k0", F.row_number().over(Window.partitionBy("__buf", "__block").orderBy(*keys)))
    return placed.join(offsets, ["__buf", "__block"]).select("buf", (F.col("__o") + F.col("__k0")).alias("ln"), "line")


def _beside(rows: DataFrame, per_buffer: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns of a frame of one row a buffer (__buf and more)."""
    return rows.join(per_buffer, rows["buf"].eqNullSafe(per_buffer["__buf"]), how).drop("__buf")


def _ends(buffer: DataFrame) -> DataFrame:
    return buffer.groupBy(F.col("buf").alias("__buf")).agg(F.max("ln").alias("__last"))


def editor_pattern(pattern: str, magic: bool = True) -> str:
    r"""The Java pattern of an editor's one: \| \( \) \+ \= \? \{n,m} are operators there and plain
    without the backslash; \< \> are word ends, \v makes all operators plain, \V none."""
    out, at, very, none = [], 0, False, not magic
    if pattern.startswith((r"\v", r"\V", r"\m", r"\M")):
        very, none = pattern[1] == "v", pattern[1] in "VM"
        at = 2
    while at < len(pattern):
        c, two = pattern[at], pattern[at : at + 2]
        if very:
            out.append({"<": r"\b(?=\w)", ">": r"\b(?<=\w)", "=": "?"}.get(c, two if c == "\\" else c))
            at += 2 if c == "\\" else 1
            continue
        if c == "\\":
            plain = {"\\|": "|", "\\(": "(", "\\)": ")", "\\+": "+", "\\=": "?", "\\?": "?", "\\<": r"\b(?=\w)", "\\>": r"\b(?<=\w)", "\\a": "[A-Za-z]", "\\l": "[a-z]", "\\u": "[A-Z]", "\\x": "[0-9A-Fa-f]", "\\h": "[A-Za-z_]"}
            if two == "\\{":
                end = pattern.index("}", at)
                n = pattern[at + 2 : end].rstrip("\\")
                lazy = n.startswith("-")
                n = n.lstrip("-")
                out.append(("*" if not n else "{" + ("0" + n if n.startswith(",") else n) + "}") + ("?" if lazy else ""))
                at = end + 1
                continue
            if none and two in ("\\.", "\\*", "\\[", "\\~"):
                out.append(two[1])
            else:
                out.append(plain.get(two, two))
            at += 2
            continue
        if c == "[" and not none and "]" in pattern[at + 2 :]:
            end = pattern.index("]", at + 2)
            out.append(pattern[at : end + 1].replace("\\e", "\x1b"))
            at = end + 1
            continue
        out.append("\\" + c if c in "+?|(){}" or none and c in ".*[]~" else c)
        at += 1
    return "".join(out)


def editor_replacement(by: str) -> str:
    r"""The Java replacement: & and \0 are the match, \1 to \9 its groups, \& and \\ plain."""
    out = re.sub(r"\\([0-9&\\])|([&$])", lambda m: {"&": "&", "\\": r"\\"}.get(m[1], f"${m[1]}") if m[1] else ("$0" if m[2] == "&" else r"\$"), by)
    return out


def substitute(buffer: DataFrame, pattern: str, by: str, range_: Range = None, every: bool = True, editor: bool = True) -> DataFrame:
    """Matches in the range's lines replaced, all or the first of each line; lines split at \\r in
    `by` (an editor's newline)."""
    cuts = editor and "\\r" in by
    p, r = (editor_pattern(pattern), editor_replacement(by.replace("\\r", "\n"))) if editor else (pattern, by)
    if every:
        new = F.regexp_replace("line", p, r)
    else:
        n = _groups(p)
        before = rf"\A((?:(?!(?:{_backrefs(p, 1)}))[\s\S])*+)"
        new = F.regexp_replace("line", rf"{before}({_backrefs(p, n + 2)})", "$1" + _shifted(r, n + 2))
    rows = buffer.withColumn("line", F.when(_in(range_), new).otherwise(F.col("line")))
    if not cuts:  # no line has a newline of its own
        return rows
    parts = rows.select("buf", F.col("ln").alias("__ln"), F.posexplode(F.split("line", "\n", -1)).alias("__k", "line"))
    return renumber(parts, "__ln", "__k")


def _groups(pattern: str) -> int:
    """How many capturing groups a Java pattern has."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.DOTALL)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def _backrefs(pattern: str, up: int) -> str:
    """The pattern's back-references, for the pattern put behind `up` other groups."""
    return re.sub(r"\\(?:([1-9])|.)", lambda m: f"(?:\\{int(m[1]) + up})" if m[1] else m[0], pattern, flags=re.DOTALL)


def _shifted(replacement: str, up: int) -> str:
    """The replacement's groups `up` further on, the whole match as the group before them; a digit
    that follows one is plain."""
    out = re.sub(r"(\\.)|\$([0-9])([0-9]?)", lambda m: m[1] or f"${int(m[2]) + up}" + (f"\\{m[3]}" if m[3] else ""), replacement, flags=re.DOTALL)
    return "\\" + out if out[:1].isdigit() else out


def count_matches(buffer: DataFrame, pattern: str, range_: Range = None) -> DataFrame:
    """buf, matches and lines with any: what :s///n reports."""
    n = F.when(_in(range_), F.regexp_count("line", F.lit(editor_pattern(pattern)))).otherwise(0)
    return buffer.groupBy("buf").agg(F.sum(n).alias("matches"), F.count_if(n > 0).alias("lines"))


def matching(buffer: DataFrame, pattern: str, invert: bool = False) -> DataFrame:
    hit = F.col("line").rlike(editor_pattern(pattern))
    return buffer.where(~hit if invert else hit)


def global_(buffer: DataFrame, pattern: str, then: Callable[[DataFrame, Column], DataFrame], invert: bool = False) -> DataFrame:
    """Marks the matching lines first, then applies `then` to them (as a range): :g and :v."""
    hit = F.col("line").rlike(editor_pattern(pattern))
    return then(buffer, ~hit if invert else hit)


def delete(buffer: DataFrame, range_: Range) -> DataFrame:
    if not isinstance(range_, tuple):
        return renumber(buffer.where(~_in(range_)), "ln")
    first, last = max(range_[0], 1), range_[1]
    if last < first:
        return buffer
    left = buffer.where(~F.col("ln").between(first, last))
    return left.withColumn("ln", F.when(F.col("ln") > last, F.col("ln") - (last - first + 1)).otherwise(F.col("ln")))


def append(buffer: DataFrame, after: int, lines: list[str]) -> DataFrame:
    """Lines put after line `after` (0: first) of every buffer; after its end if that is before."""
    if not lines:
        return buffer
    after = max(after, 0)
    ends = _ends(buffer).select(F.col("__buf").alias("buf"), F.least("__last", F.lit(after)).alias("__a"), F.posexplode(F.array(*map(F.lit, lines))).alias("__k", "line"))
    new = ends.select("buf", (F.col("__a") + F.col("__k") + 1).cast("bigint").alias("ln"), "line")
    return buffer.withColumn("ln", F.when(F.col("ln") > after, F.col("ln") + len(lines)).otherwise(F.col("ln"))).unionByName(new)


def insert(buffer: DataFrame, before: int, lines: list[str]) -> DataFrame:
    return append(buffer, before - 1, lines)


def change(buffer: DataFrame, first: int, last: int, lines: list[str]) -> DataFrame:
    return append(delete(buffer, (first, last)), first - 1, lines)


def move(buffer: DataFrame, first: int, last: int, after: int) -> DataFrame:
    """:m - lines first to last after line `after`, which isn't among them."""
    if first <= after < last:
        raise ValueError("move lines into themselves")
    ln, end = F.col("ln"), F.col("__last")
    here = ln.between(first, last)
    if after >= last:
        key = F.when(here, ln + F.least(end, F.lit(after)) - F.least(end, F.lit(last))).when(ln.between(last + 1, after), ln - (last - first + 1)).otherwise(ln)
    else:
        n = F.greatest(F.least(end, F.lit(last)) - (first - 1), F.lit(0))
        key = F.when(here, ln - (first - 1 - after)).when(ln.between(after + 1, first - 1), ln + n).otherwise(ln)
    return _beside(buffer, _ends(buffer)).select("buf", key.cast("bigint").alias("ln"), "line")


def copy(buffer: DataFrame, first: int, last: int, after: int) -> DataFrame:
    """:t - a copy of the lines after line `after`."""
    first = max(first, 1)
    rows = _beside(buffer, _ends(buffer))
    ln, end = F.col("ln"), F.col("__last")
    n = F.greatest(F.least(end, F.lit(last)) - (first - 1), F.lit(0))
    new = rows.where(ln.between(first, last)).select("buf", (F.least(end, F.lit(after)) + ln - (first - 1)).cast("bigint").alias("ln"), "line")
    return rows.select("buf", F.when(ln > after, ln + n).otherwise(ln).cast("bigint").alias("ln"), "line").unionByName(new)


def join(buffer: DataFrame, first: int, last: int, spaces: bool = True) -> DataFrame:
    """:j - the lines as one; with spaces, leading white space goes and one space comes between, but
    none before a ) or after a line that ends in a space or tab, or next to an empty one."""
    here = F.col("ln").between(first, last)
    if not spaces:
        joined = buffer.where(here).groupBy("buf").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ln", "line")))["line"], "").alias("line"), F.min("ln").alias("ln"))
        return _closed(buffer, first, last).unionByName(joined.select("buf", "ln", "line"))
    rows = buffer.where(here).groupBy("buf").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("l"), F.min("ln").alias("ln"))

    def add(acc: Column, x: Column) -> Column:
        part = F.regexp_replace(x["line"], r"^[ \t]+", "")
        bare = (part == "") | part.startswith(")") | acc.rlike(r"[ \t]$") | (acc == "")
        return F.when(bare, F.concat(acc, part)).otherwise(F.concat(acc, F.lit(" "), part))

    joined = rows.select("buf", "ln", F.aggregate(F.slice("l", F.lit(2), F.size("l")), F.col("l")[0]["line"], add).alias("line"))
    return _closed(buffer, first, last).unionByName(joined)


def _closed(buffer: DataFrame, first: int, last: int) -> DataFrame:
    """The lines around a range that becomes one line."""
    ln, first = F.col("ln"), max(first, 1)
    return buffer.where(~ln.between(first, last)).withColumn("ln", F.when(ln > last, ln - (last - first)).otherwise(ln))


def shift(buffer: DataFrame, range_: Range, width: int = 8, left: bool = False, line: str = "line", into: str | None = None) -> DataFrame:
    """:> and :< - indents by `width`, with spaces; empty lines stay. Here and in upper() and lower()
    `line` names the column that is read, and `into` that which the result is put in, `line` itself
    if none is named: several edits of one buffer are several columns then, and nothing is joined."""
    old = F.col(line)
    new = F.regexp_replace(old, rf"^ {{1,{width}}}", "") if left else F.when(old == "", "").otherwise(F.concat(F.lit(" " * width), old))
    return buffer.withColumn(into or line, F.when(_in(range_), new).otherwise(old))


def upper(buffer: DataFrame, range_: Range, line: str = "line", into: str | None = None) -> DataFrame:
    return buffer.withColumn(into or line, F.when(_in(range_), F.upper(line)).otherwise(F.col(line)))


def lower(buffer: DataFrame, range_: Range, line: str = "line", into: str | None = None) -> DataFrame:
    return buffer.withColumn(into or line, F.when(_in(range_), F.lower(line)).otherwise(F.col(line)))


def yank(buffer: DataFrame, range_: Range) -> DataFrame:
    """A register: the range's lines, numbered anew."""
    rows = buffer.where(_in(range_))
    return rows.withColumn("ln", F.col("ln") - (max(range_[0], 1) - 1)) if isinstance(range_, tuple) else renumber(rows, "ln")


def put(buffer: DataFrame, register: DataFrame, after: int) -> DataFrame:
    """The register's lines after line `after` of the buffer of the same name; at its end if that
    is before. A buffer that only the register has begins with them."""
    after = max(after, 0)
    counts = register.groupBy(F.col("buf").alias("__buf")).agg(F.count("*").alias("__n"))
    ln = F.col("ln")
    old = _beside(buffer, counts).select("buf", F.when(ln > after, ln + F.coalesce("__n", F.lit(0))).otherwise(ln).alias("ln"), "line")
    new = _beside(register, _ends(buffer)).select("buf", (ln + F.least(F.coalesce("__last", F.lit(0)), F.lit(after))).cast("bigint").alias("ln"), "line")
    return old.unionByName(new)


def put_indented(buffer: DataFrame, register: DataFrame, after: int) -> DataFrame:
    """:iput - put(), each line indented by as many more spaces as line `after` has than the
    register's first line (fewer: as many of its own spaces go); white space counts a space each."""
    indent = F.length(F.regexp_extract("line", r"^[ \t]*", 0))
    here = buffer.where(F.col("ln") == after).select(F.col("buf").alias("__buf"), indent.alias("__to"))
    own = register.where("ln = 1").select(F.col("buf").alias("__buf"), indent.alias("__from"))
    more = F.coalesce("__to", F.lit(0)) - F.coalesce("__from", F.lit(0))
    text = F.when(F.col("line") == "", "").when(more >= 0, F.concat(F.repeat(F.lit(" "), more), "line")).otherwise(F.substring("line", F.least(-more, indent) + 1, F.length("line")))
    return put(buffer, _beside(_beside(register, here), own).withColumn("line", text).select("buf", "ln", "line"), after)


def window(buffer: DataFrame, line: int, count: int, kind: str = "+") -> DataFrame:
    """:z - buf, ln and what is shown of `count` lines: from the line on (+), up to it (-), around it
    (.), or the ones before those that - shows (^)."""
    first = {"+": line, "-": line - count + 1, ".": line - count // 2, "^": line - 2 * count + 1}[kind]
    return print_(buffer, (first, first + count - 1), numbers=True)


def print_(buffer: DataFrame, range_: Range, numbers: bool = False) -> DataFrame:
    """buf, ln and what is shown: the line, with its number if asked for."""
    shown = F.format_string("%3d %s", "ln", "line") if numbers else F.col("line")
    return buffer.where(_in(range_)).select("buf", "ln", shown.alias("shown"))


def last_line(buffer: DataFrame) -> DataFrame:
    """:= - the number of lines of each buffer."""
    return buffer.groupBy("buf").agg(F.max("ln").alias("n"))


class History:
    """Versions of a buffer: undo, redo, and reading any of them. Versions are plans; give
    `materialise` to write each."""

    def __init__(self, buffer: DataFrame, materialise: Callable[[DataFrame], DataFrame] | None = None):
        self._keep = materialise or (lambda df: df)
        self.versions, self.at = [self._keep(buffer)], 0
        self.said: list[str] = []
        self.registers: dict[str, DataFrame] = {}
        self.marks: dict[str, int] = {}

    @property
    def now(self) -> DataFrame:
        return self.versions[self.at]

    def edit(self, f: Callable[[DataFrame], DataFrame], said: str = "", join: bool = False) -> DataFrame:
        """f of the buffer as a new version, or, with join, as part of the one before, so that both
        are undone together; `said` is what history() tells of it."""
        new = self._keep(f(self.now))
        keep = max(self.at, 1) if join else self.at + 1
        self.versions = [*self.versions[:keep], new]
        self.at = keep
        self.said.append(said)
        return self.now

    def undo(self, n: int = 1) -> DataFrame:
        self.at = max(0, self.at - n)
        return self.now

    def redo(self, n: int = 1) -> DataFrame:
        self.at = min(len(self.versions) - 1, self.at + n)
        return self.now

    earlier, later = undo, redo

    def yank(self, name: str, range_: Range) -> None:
        self.registers[name] = yank(self.now, range_)

    def put(self, name: str, after: int, indented: bool = False) -> DataFrame:
        return self.edit(lambda b: (put_indented if indented else put)(b, self.registers[name], after), f"put {name}")

    def display(self) -> DataFrame | None:
        """The registers: name, buf, ln and line; None if there are none."""
        rows = [r.select(F.lit(name).alias("name"), "buf", "ln", "line") for name, r in sorted(self.registers.items())]
        return reduce(DataFrame.unionByName, rows) if rows else None

    def history(self) -> list[tuple[int, str]]:
        """Every edit, from 1, and what was said of it, undone ones too."""
        return list(enumerate(self.said, 1))

    def mark(self, name: str, line: int) -> None:
        self.marks[name] = line

    def delmarks(self, *names: str) -> None:
        for n in names:
            self.marks.pop(n, None)

    def undolist(self) -> list[tuple[int, bool]]:
        """Each version's number, and whether it is the current one."""
        return [(k, k == self.at) for k in range(len(self.versions))]
