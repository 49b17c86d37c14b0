"""Operators 3, 5, 8 and 10 against plain Python, on hostile rows and on the small tables."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate as decon
from quillon.llm.decontaminate import contamination, decontaminate
from quillon.llm._words import Rolling, mix, windows
from quillon.llm.bpe_codec import bpe_digests
from quillon.llm.language_id import Model, _letters, fit, held_out, identify, predict, reject_unknown
from quillon.llm.line_dedup import lcp_array, line_dedup, line_dedup_report
from quillon.llm.minhash import near_duplicates
from quillon.llm.quality_rules import quality_rules
from quillon.llm.token_counts import token_counts

from .data import SCHEMA, documents, empty, table


def key(x):
    return -1 if x is None else x


# -- 8 ---------------------------------------------------------------------------------------


def quality(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k in range(len(words) - 2) if counts[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_quality(spark):
    df = table(spark)
    got = sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(df).collect())
    assert got == sorted((key(r.doc_id), *quality(r.text or "")) for r in df.collect())
    assert not any(r.kept and r.base_failed for r in quality_rules(df).collect())
    assert quality_rules(empty(spark)).count() == 0


def doubled(n: int) -> str:
    out = "0"
    while len(out) < n:
        out += out.translate(str.maketrans("01", "10"))
    return out[:n]


def test_words_that_polynomials_confuse(spark):
    a, b = (doubled(2048).translate(str.maketrans("01", x)) for x in ("pq", "qp"))
    df = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a} x {b}"), (3, "y")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality_rules(df).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: r.n_shingles for r in near_duplicates(df, 1).collect()} == {1: 2, 2: 3, 3: 1}
    bench = [("i", a), ("j", b), ("k", "y")]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in contamination(df, spark.createDataFrame(bench, "item_id string, text string")).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (1, 1)}


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61C328FF20') AS string) AS text UNION ALL SELECT 2L, 'a b'")
    texts = {1: "a\ufffd(\ufffd ", 2: "a b"}
    assert {r.doc_id: r.n_bytes for r in token_counts(df).collect()} == {k: len(t.encode()) for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in bpe_digests(df).collect()} == {r.doc_id: r.n_tokens for r in bpe_digests(spark.createDataFrame(list(texts.items()), df.schema)).collect()}
    model = fit(table(spark))
    assert identify(df, model).count() == quality_rules(df).count() == near_duplicates(df).count() == reject_unknown(df, model).count() == line_dedup_report(df).count() == 2
    cut = decontaminate(df, spark.createDataFrame([(1, "a b")], "item_id int, text string"), mode="span").selectExpr("doc_id", "hex(text) AS h").collect()
    assert {r.doc_id: r.h for r in cut} == {1: "61C328FF20", 2: ""}


def test_operators_leave_the_session_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7777")
    quality_rules(table(spark)).count(), token_counts(table(spark)).count(), near_duplicates(table(spark)).count()
    assert spark.conf.get(key) == "7777"
    spark.conf.set(key, before)


def test_coverage_rejects_beyond_the_base_rule(spark):
    fresh = lambda a, n: [f"w{k:03}" for k in range(a, a + n)]
    twice = fresh(0, 30)
    # Pieces of five words, each again at another place, so that no ten words are found again.
    pieces = [fresh(5 * k, 5) for k in range(6)]
    apart = [w for k in range(6) for w in [*pieces[k], f"x{k}"]] + fresh(100, 65) + [w for k in (3, 0, 5, 2, 4, 1) for w in [*pieces[k], f"y{k}"]]
    texts = [" ".join(x) for x in (twice + fresh(100, 65) + twice, apart, twice + fresh(100, 95) + twice[:10])]
    rows = quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.base_failed for r in rows] == [False] * 3
    assert [r.kept for r in rows] == [False, False, True]
    assert rows[0].share_10 > 0.15 and rows[1].share_10 == 0 and rows[1].share_5 > 0.2


# -- 10 --------------------------------------------------------------------------------------


def norm(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def leaks(text: str, items: list[tuple]) -> tuple:
    words, hit, names = norm(text), set(), set()
    for item, body in items:
        w = norm(body or "")
        n = min(10, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def items(spark) -> list[tuple]:
    texts = [r.text for r in table(spark).collect() if r.text]
    return [(9, texts[8]), (10, "a B"), (11, None), (12, ""), (13, "..."), (100, " ".join(texts[12].split(" ")[2:14])), (7, "zzz yyy"), (7, "tail")]


@pytest.mark.parametrize("block", [1 << 22, 1])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decon, "BLOCK_BYTES", block)
    df, bench = table(spark), items(spark)
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = sorted((key(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(df, benchmark).collect())
    assert got == sorted((key(r.doc_id), *leaks(r.text or "", bench)) for r in df.collect())
    left = decontaminate(df, benchmark)
    assert sorted(key(r.doc_id) for r in left.collect()) == sorted(key(r.doc_id) for r in df.collect() if not leaks(r.text or "", bench)[4])
    assert left.columns == df.columns


def test_spans_do_not_depend_on_the_benchmarks_size(spark, monkeypatch):
    words = [f"w{k}" for k in range(15)]
    df = spark.createDataFrame([(1, " ".join(["pre", *words, "post"])), (2, "clean"), (3, None), (4, "a w3 w4 b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(words[:10])), (2, " ".join(words[5:])), (3, "a b")], "item_id bigint, text string")
    found = []
    for block in (1 << 22, 1):
        monkeypatch.setattr(decon, "BLOCK_BYTES", block)
        found.append({r.doc_id: r.text for r in decontaminate(df, bench, mode="span").collect()})
    assert found[0] == found[1] == {1: "pre  post", 2: "clean", 3: None, 4: "a w3 w4 b"}
    one, two = [], []
    for block, out in ((1 << 22, one), (1, two)):
        monkeypatch.setattr(decon, "BLOCK_BYTES", block)
        out += sorted(map(str, decontaminate(table(spark), spark.createDataFrame(items(spark), "item_id bigint, text string"), mode="span").collect()))
    assert one == two


def test_windows_of_a_benchmark_take_little_memory():
    rng = random.Random(3)
    texts = [(str(k), " ".join(f"{rng.randrange(10**6)}" for _ in range(500)).encode()) for k in range(1200)]
    assert sum(len(t) for _, t in texts) > 1 << 21
    assert len(pickle.dumps(decon.Grams(texts, 10))) < 40 << 20


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in contamination(table(spark), none).collect())
    assert contamination(empty(spark), none).count() == 0 and decontaminate(table(spark), none).count() == table(spark).count()


def test_span_removal(spark):
    df = spark.createDataFrame([(1, "Before. One two three, after.")], "doc_id bigint, text string")
    assert decontaminate(df, spark.createDataFrame([(1, "one TWO three")], "item_id bigint, text string"), mode="span").first().text == "Before. , after."


# -- 5 ---------------------------------------------------------------------------------------


def deleted(docs: list[tuple], least: int) -> dict:
    """Lines in later copies of runs of `least` words or more, by trying every run."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0]))
    seen, out = set(), collections.defaultdict(set)
    for k, (_, text) in enumerate(order):
        lines = text.split("\n") if text is not None else []
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = "\n".join(lines[a : b + 1]), b - a
                if sum(sizes[a : b + 1]) >= least:
                    if run in seen:
                        out[k] |= set(range(a, b + 1))
                    seen.add(run)
    return {order[k][0]: v for k, v in out.items()}


def test_line_dedup(spark):
    docs = []
    for seed in range(4):  # lines of each seed are its own
        rng = random.Random(seed)
        lines = [" ".join(rng.choice("abcd") + str(seed) for _ in range(rng.randint(0, 6))) for _ in range(9)]
        docs += [(100 * seed + k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for k in range(25)] + [(100 * seed + 42, "\n".join(lines * 4))]
    docs += [(940, None), (941, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = deleted(docs, 8)
    for r in line_dedup_report(df, min_words=8).collect():
        got = {k for part in filter(None, r.deleted.split(",")) for k in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)}
        assert got == want.get(r.doc_id, set()), r
        assert r.n_deleted == len(got)
    left = {r.doc_id: r.text for r in line_dedup(df, min_words=8).collect()}
    for k, text in docs:
        if k not in want:
            assert left[k] == text
        else:
            rest = [x for j, x in enumerate(text.split("\n")) if j not in want[k]]
            assert left.get(k) == ("\n".join(rest) if rest else None)


def test_line_dedup_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (1, text), (2, "x\n" + text), (None, text), (None, text)]
    got = sorted((key(r.doc_id), r.deleted) for r in line_dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == [(-1, "0-0"), (-1, "0-0"), (1, ""), (1, "0-0"), (1, "0-0"), (2, "1-1")]


def test_line_dedup_shuffled_join(spark, monkeypatch):
    from quillon.llm import line_dedup as module

    df = documents(spark)
    want = sorted(map(tuple, line_dedup_report(df).collect()))
    monkeypatch.setattr(module, "BROADCAST_DOCS", 0)
    assert sorted(map(tuple, line_dedup_report(df).collect())) == want


def test_line_dedup_hostile(spark):
    df = table(spark)
    assert line_dedup_report(df).count() == df.count()
    assert line_dedup(df).columns == df.columns
    assert line_dedup(empty(spark)).count() == line_dedup_report(empty(spark)).count() == 0


def test_suffix_and_lcp_arrays(spark, monkeypatch):
    from quillon.llm import line_dedup as module

    monkeypatch.setattr(module, "BLOCK", 4)
    monkeypatch.setattr(module, "FIRST", 2)
    rng = random.Random(6)
    ids = {k: [rng.randrange(3) for _ in range(rng.randint(1, 12))] for k in range(30)}
    ids |= {30: [1] * 20, 31: [1] * 13, 32: ids[4], 33: ids[5], 34: [2, *ids[5]]}
    segments = spark.createDataFrame(list(ids.items()), "seg bigint, ids array<bigint>").repartition(3)
    want = sorted((x[i:], k, i) for k, x in ids.items() for i in range(len(x)))
    got = {(r.seg, i): (r["at"][i], r.lcp[i]) for r in lcp_array(segments).collect() for i in range(len(r["at"]))}
    for at, (text, k, i) in enumerate(want, 1):
        before = want[at - 2][0] if at > 1 else []
        shared = next((j for j, (a, b) in enumerate(zip(text, before, strict=False)) if a != b), min(len(text), len(before)))
        assert got[k, i] == (at, shared)
    assert len(got) == len(want)


# -- 3 ---------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    df = documents(spark)
    model = fit(df.where(~held_out(F.col("doc_id"))))
    rows = identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_has_both_languages(spark):
    df = documents(spark)
    model = fit(df)
    by = {lang: " ".join(r.text for r in df.where((F.col("lang") == lang) & (F.length("text") > 600)).limit(3).collect())[:2500] for lang in ("en", "fr")}
    row = identify(spark.createDataFrame([(1, by["en"] + " " + by["fr"])], "doc_id bigint, text string"), model).first()
    assert set(row.languages) == {"en", "fr"} and 0.3 < min(row.proportions)


def test_mixtures_of_any_size(spark):
    # Words over an alphabet of each language's own; two of the six languages aren't in the text.
    model = fit(spark.createDataFrame([(k, " ".join(alphabet_words(k % 6, k, 60)), f"l{k % 6}") for k in range(60)], "doc_id bigint, text string, lang string"))
    texts = [[w for k in (0, 2, 3, 5) for w in alphabet_words(k, 9, 100)], alphabet_words(0, 8, 19_850) + alphabet_words(4, 7, 150), alphabet_words(1, 6, 200)]
    rows = identify(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert set(rows[0].languages) == {"l0", "l2", "l3", "l5"} and all(abs(p - 0.25) < 0.02 for p in rows[0].proportions) and abs(rows[0].score - 0.25) < 0.02
    assert rows[1].languages == ["l0", "l4"] and abs(rows[1].proportions[1] - 0.0075) < 0.001
    assert rows[2].languages == ["l1"]


def mixture(model: Model, text: str) -> tuple[set, list]:
    """The best set of languages of all there are, by EM in plain Python, and its shares."""
    h, begins, _ = _letters([text.encode()])
    ends = [*begins[1:], len(h)]
    words = [[math.exp(max(x - m, -60)) for x in row] for a, b in zip(begins, ends) for row in [model.log_p[h[a:b]].astype(float).sum(0)] for m in [max(row)]]
    best = None
    for size in range(1, len(model.languages) + 1):
        for some in itertools.combinations(range(len(model.languages)), size):
            p = {k: 1 / size for k in some}
            for _ in range(400):
                new = dict.fromkeys(some, 0.0)
                for w in words:
                    total = sum(p[k] * w[k] for k in some)
                    for k in some:
                        new[k] += p[k] * w[k] / total / len(words)
                p = new
            fits = sum(math.log(sum(p[k] * w[k] for k in some)) for w in words) - (size - 1) * math.log(len(words) + 1)
            if best is None or fits > best[0] + 1e-6:
                best = fits, {model.languages[k]: p[k] for k in some}
    return best[1]


def test_mixtures_against_all_sets(spark):
    df = documents(spark)
    model = fit(df)
    by = {lang: [w for r in df.where(F.col("lang") == lang).limit(4).collect() for w in r.text.split()][:60] for lang in model.languages}
    a, b, c, d = model.languages
    texts = [" ".join(x) for x in (by[a], by[a] + by[b], by[b][:40] + by[c][:12] + by[d][:25], by[a][:3] + by[d][:3], by[c][:30] + by[a][:2], by[d][:1])]
    for text, names, shares in zip(texts, *predict(model, [t.encode() for t in texts])[2:], strict=True):
        want = mixture(model, text)
        assert set(names) == set(want) and all(abs(want[n] - p) < 0.01 for n, p in zip(names, shares, strict=True)), (text[:40], names, shares, want)


def test_more_than_64_languages(spark):
    rows = [(k, " ".join(alphabet_words(k % 70, k, 30)), f"l{k % 70:02}") for k in range(210)]
    model = fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 70
    got = identify(spark.createDataFrame([(k, " ".join(alphabet_words(k, 500 + k, 40))) for k in range(70)], "doc_id bigint, text string"), model).collect()
    assert [r for r in got if r.lang_pred != f"l{r.doc_id:02}"] == []


def alphabet_words(language: int, seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    letters = [chr(0x4E00 + 10 * language + k) for k in range(10)]
    return ["".join(rng.choice(letters) for _ in range(5)) for _ in range(n)]


def test_language_hostile(spark):
    df = table(spark)
    model = fit(df)
    rows = identify(df, model).collect()
    assert len(rows) == df.count()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in rows:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[r.doc_id])), r
    assert reject_unknown(df, model).count() == sum(r.lang_pred != "und" for r in rows)
    assert reject_unknown(df, model).columns == df.columns
    assert identify(empty(spark), model).count() == 0
    none = fit(empty(spark))
    assert none.languages == () and {r.lang_pred for r in identify(df, none).collect()} == {"und"}
    assert isinstance(model, Model)
    assert {r.h for r in spark.createDataFrame([(None,), (5,)], "doc_id bigint").select(held_out(F.col("doc_id")).alias("h")).collect()} <= {True, False}
    assert SCHEMA


def test_rolling_hashes_tell_runs_apart():
    rng = np.random.default_rng(3)
    values = mix(rng.integers(0, 4, 5000).astype(np.uint64))
    counts = np.array([0, 3, 2990, 7, 0, 2000])
    rolled = Rolling(values)
    for n in (1, 2, 3, 5, 10):
        at, keys = rolled.windows(counts, n)
        assert np.array_equal(at, windows(values, counts, n)[0])
        runs = {}
        for place, key in zip(at.tolist(), keys.tolist(), strict=True):
            runs.setdefault(key, set()).add(tuple(values[place : place + n].tolist()))
        assert all(len(r) == 1 for r in runs.values()) and len(runs) == len({tuple(values[a : a + n].tolist()) for a in at.tolist()})
    assert len(Rolling(values[:0]).windows(np.zeros(2, np.int64), 3)[0]) == 0
