"""Operator 12 against all pairs of words in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import variants
from quillon.llm.queries import QUERIES
from quillon.llm.variants import Shard, one_edit, roots, spelling_variants

from .data import documents, empty, table


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        new = [i + 1]
        for j, b in enumerate(y):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


LETTERS = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]]


def edits(w):
    """All strings of letters that are one edit from w."""
    out = {w[:k] + w[k + 1 :] for k in range(len(w))}
    out |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in LETTERS}
    out |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in LETTERS}
    return out - {w}


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: sorted(edits(w) & words.keys()) for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n, len(near[w]), words[form[w]] if form[w] else -1))
    return sorted(out)


def plain(rows):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in rows)


def hostile():
    """Words whose halves many share, doubled letters, accents, very long words, chains of forms."""
    rng = random.Random(3)
    words = {"letter": 700, "leter": 3, "lettter": 120, "letters": 130, "lettersx": 20, "betterà": 9, "bettera": 60, "ÀÉÎõüÿ": 8, "àéîõüÿ": 11, "aaaaaa": 30, "aaaaaaa": 200, "aaaaaaaa": 5, "ababab": 9, "bababa": 50, "STRASSE": 6, "straße": 40}
    words |= {"common" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))): rng.choice([5, 6, 30, 200]) for _ in range(250)}
    words |= {"".join(rng.choice("xyz") for _ in range(rng.randint(3, 4))) + "ending": rng.choice([5, 40]) for _ in range(60)}
    long = "".join(rng.choice("abcdefgh") for _ in range(400))
    for k in (0, 3, 199, 200, 201, 399):
        words |= {long[:k] + "z" + long[k + 1 :]: 6, long[:k] + long[k + 1 :]: 7, long[:k] + "q" + long[k:]: 5}
    words[long] = 99
    for n in (96, 97, 98, 99, 100):
        words |= {"ab" * 20 + "c" * (n - 40): n}
    return words


def test_hostile_words(spark):
    words = hostile()
    rng = random.Random(5)
    said = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(said)
    rows = [(k, " ".join(said[k::40]), *[None] * 7) for k in range(40)]
    rows += [(None, rows[0][1], *[None] * 7), rows[3]]
    df = table(spark, rows).unionByName(table(spark)).repartition(5)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    for shard in (variants.SHARD, 37):
        assert plain(spelling_variants(df, shard=shard).collect()) == want
    assert sum(1 for x in want if x[1] and x[1] != x[2]) > 0


def test_empty_table(spark):
    assert spelling_variants(empty(spark)).count() == 0


def test_one_edit():
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    for x in words:
        for y in words:
            assert one_edit(x, y) == (distance(x, y) == 1)


@pytest.mark.parametrize("long", [2, 48])
def test_each_near_word_is_found_once(monkeypatch, long):
    monkeypatch.setattr(variants, "LONG", long)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(300)})
    shard = Shard()
    for w in words:
        shard.add(0, w, 1)
        shard.add(1, w, 1)
    shard.close()
    for y in words:
        assert sorted(x for x, _ in shard.near(y)) == [x for x in words if distance(x, y) == 1]


def test_roots_of_long_chains(spark):
    rows = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(50)] + [("x", "w010")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {w: "w050" for w, _ in rows}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert plain(QUERIES["op12_spelling_variants"](spark, sf_dir).collect()) == brute(rows)
