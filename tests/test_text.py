"""Text edits against plain lists, on buffers of several sizes, one of which is null."""

import itertools

import pytest
from pyspark.sql import functions as F

from quillon.operators import text as tx

SIZES = {"a": 6, "b": 3, None: 1}


@pytest.fixture(scope="module")
def buffers(spark):
    rows = [(b, k, f"{b}{k}") for b, n in SIZES.items() for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "buf string, ln bigint, line string").cache()


def plain(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.buf or "", r.ln)):
        out.setdefault(r.buf, []).append((r.ln, r.line))
    for rows in out.values():
        assert [ln for ln, _ in rows] == list(range(1, len(rows) + 1))
    return {b: [line for _, line in rows] for b, rows in out.items()}


def lists():
    return {b: [f"{b}{k}" for k in range(1, n + 1)] for b, n in SIZES.items()}


def each(f):
    return {b: x for b, lines in lists().items() if (x := f(lines))}


@pytest.mark.parametrize(("first", "last", "after"), [(1, 1, 2), (1, 2, 5), (2, 3, 9), (4, 5, 1), (2, 9, 0), (5, 6, 2), (7, 8, 0), (2, 3, 1), (2, 3, 3)])
def test_move_and_copy(buffers, first, last, after):
    def moved(lines):
        part = lines[first - 1 : last]
        return [x for k, x in enumerate(lines, 1) if k <= after and not first <= k <= last] + part + [x for k, x in enumerate(lines, 1) if k > after and not first <= k <= last]

    assert plain(tx.move(buffers, first, last, after)) == each(moved)
    assert plain(tx.copy(buffers, first, last, after)) == each(lambda lines: lines[:after] + lines[first - 1 : last] + lines[after:])


def test_delete_append_change_join(buffers):
    for first, last in ((1, 1), (2, 4), (0, 2), (3, 2), (4, 99)):
        assert plain(tx.delete(buffers, (first, last))) == each(lambda x: x[: max(first, 1) - 1] + x[max(last, first - 1) :])  # noqa: B023
    for after in (0, 2, 9):
        assert plain(tx.append(buffers, after, ["x", "y"])) == each(lambda x: x[:after] + ["x", "y"] + x[after:])  # noqa: B023
    assert plain(tx.append(buffers, 1, [])) == lists()
    assert plain(tx.change(buffers, 2, 3, ["x"])) == each(lambda x: x[:1] + ["x"] + x[3:])
    assert plain(tx.join(buffers, 2, 4)) == each(lambda x: x[:1] + ([" ".join(x[1:4])] if x[1:4] else []) + x[4:])
    assert plain(tx.join(buffers, 2, 4, spaces=False)) == each(lambda x: x[:1] + (["".join(x[1:4])] if x[1:4] else []) + x[4:])


def test_put_and_yank(buffers):
    register = tx.yank(buffers, (2, 3))
    assert plain(register) == {"a": ["a2", "a3"], "b": ["b2", "b3"]}
    for after in (0, 2, 9):
        assert plain(tx.put(buffers, register, after)) == each(lambda x: x[:after] + x[1:3] + x[after:])  # noqa: B023
    assert plain(tx.put(buffers.where("buf = 'a'"), register, 4))["b"] == ["b2", "b3"]
    even = tx.yank(buffers, F.col("ln") % 2 == 0)
    assert plain(even) == each(lambda x: x[1::2])


def test_blocks(buffers, monkeypatch):
    monkeypatch.setattr(tx, "BLOCK", 2)
    assert plain(tx.delete(buffers, F.col("line").rlike("[25]"))) == each(lambda x: [s for s in x if s[-1] not in "25"])
    assert plain(tx.substitute(buffers, "[0-9]", r"&\\r-")) == each(lambda x: list(itertools.chain.from_iterable((s, "-") for s in x)))


@pytest.mark.parametrize(
    ("pattern", "by", "line", "expected"),
    [
        ("b", "[&]", "abcb", "a[b]cb"),
        (r"\(.\)\1", r"<\1>", "xabbcc", "xa<b>cc"),
        (r"\([a-z]\)\([a-z]\)", r"\2\10", "..ab cd", "..ba0 cd"),
        (r"\(a\|b\)\(x\)\?", r"(\1\2)", "cbax", "c(b)ax"),
        (r"\<b", "X", "ab b b", "ab X b"),
        ("c$", "&&", "cac", "cacc"),
        ("z", "&", "abc", "abc"),
        ("^", "1", "2", "12"),
    ],
)
def test_first_match_only(spark, pattern, by, line, expected):
    df = spark.createDataFrame([(1, 1, line)], "buf int, ln bigint, line string")
    assert tx.substitute(df, pattern, by, every=False).first().line == expected


def test_indented_put_and_window(spark):
    df = tx.open_buffers(spark.createDataFrame([(1, "  x\n    y\n\nz")], "id int, text string"), "id", "text")
    register = tx.yank(df, (1, 3))
    assert plain(tx.put_indented(df, register, 2))[1] == ["  x", "    y", "    x", "      y", "", "", "z"]
    assert plain(tx.put_indented(df, register, 4))[1] == ["  x", "    y", "", "z", "x", "  y", ""]
    assert [r.ln for r in tx.window(df, 2, 2).orderBy("ln").collect()] == [2, 3]
    assert [r.ln for r in tx.window(df, 3, 2, "-").orderBy("ln").collect()] == [2, 3]
    assert [r.ln for r in tx.window(df, 4, 2, "^").orderBy("ln").collect()] == [1, 2]


def test_history_of_commands(buffers):
    h = tx.History(buffers)
    assert h.display() is None
    h.yank("r", (1, 1))
    h.edit(lambda b: tx.delete(b, (1, 1)), "1d")
    h.edit(lambda b: tx.append(b, 0, ["x"]), "0a", join=True)
    assert plain(h.now)["a"][:2] == ["x", "a2"] and len(h.versions) == 2
    h.put("r", 0)
    assert plain(h.now)["a"][:3] == ["a1", "x", "a2"]
    assert plain(h.undo(2)) == lists()
    assert h.history() == [(1, "1d"), (2, "0a"), (3, "put r")]
    assert sorted((r.name, r.line) for r in h.display().where("buf IS NOT NULL").collect()) == [("r", "a1"), ("r", "b1")]
