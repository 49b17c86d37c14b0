"""Operator 8, quality rules by repetition coverage: rolling hashes of several n-gram lengths in
numpy, and the share of characters inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._base import text_chunks
from ._words import Rolling, Texts, covered, mix, sums_by

#: Lengths of the n-grams beyond the base rule's three words, and the share of word characters
#: inside n-grams of that length which occur again earlier, above which a text fails. First copies
#: don't count, so limits bite below the base rule's half only if they are well under a quarter.
COVERAGE = {5: 0.2, 10: 0.15}
#: The share of word characters in repeated lines above which a text fails.
LINES = 0.3
MIN_WORDS, BASE_N, BASE_PERCENT = 50, 3, 50
SYMBOLS = b"#*$%&|<>"


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether its text has it twice or more, and whether it has it earlier."""
    keyed = mix(keys ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keyed, kind="stable")
    s = keyed[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, earlier = np.zeros(len(s), bool), np.zeros(len(s), bool)
    twice[order] = same[1:] | same[:-1]
    earlier[order] = same[:-1]
    return twice, earlier


def measure(texts: list[bytes], coverage: tuple[int, ...] = tuple(COVERAGE)) -> dict[str, np.ndarray]:
    """The counts of each text: words, word characters, symbols, repeated lines, words in
    repeated 3-word windows, and word characters in earlier-seen lines and n-grams."""
    t = Texts(texts, lower=False)
    starts, ends, counts = t.words("space")
    owner = np.repeat(np.arange(len(texts)), counts)
    points = np.append(0, np.cumsum((t.bytes & 0xC0) != 0x80))
    chars = points[ends] - points[starts]
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    sizes = np.diff(t.ends, prepend=0)
    out = {"n_words": counts, "word_chars": sums_by(chars, counts), "n_symbols": sums_by(symbols[t.bytes], sizes)}
    rolling = Rolling(t.hashes(starts, ends))
    at, keys = rolling.windows(counts, BASE_N)
    twice, _ = _repeats(keys, owner[at])
    out["n_repeat_words"] = sums_by(covered(at[twice], BASE_N, len(starts)), counts)
    first, last, per = t.lines()
    line_owner = np.repeat(np.arange(len(texts)), per)
    words_in = np.searchsorted(starts, last) - np.searchsorted(starts, first)
    real = words_in > 0
    _, earlier = _repeats(t.hashes(first[real], last[real]), line_owner[real])
    again = np.zeros(len(first), bool)
    again[real] = earlier
    out["n_dup_lines"] = sums_by(again, per)
    char_sums = np.append(0, np.cumsum(chars))
    a, b = np.searchsorted(starts, first), np.searchsorted(starts, last)
    out["line_chars"] = sums_by(np.where(again, char_sums[b] - char_sums[a], 0), per)
    for n in coverage:
        at, keys = rolling.windows(counts, n)
        _, earlier = _repeats(keys, owner[at])
        out[f"chars_{n}"] = sums_by(np.where(covered(at[earlier], n, len(starts)), chars, 0), counts)
    return out


def quality_rules(docs: DataFrame, coverage: dict[int, float] | None = None, lines: float = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the counts of the base rules (n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words), base_failed, kept, and the coverage shares behind kept.

    base_failed: fewer than 50 words, or over half of the words in 3-word windows found twice or
    more. kept is false if that is so, or if the share of word characters in lines or n-grams
    that occur again earlier in the text is over its limit. Null and empty texts have no words
    and shares of 0, and fail by the base rule. Repeated ids and rows stay; other columns aren't
    read; an empty table gives an empty table. One narrow pass without a shuffle.
    """
    limits = COVERAGE if coverage is None else coverage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            m = measure(texts, tuple(limits))
            total = np.maximum(m["word_chars"], 1)
            shares = {"line_share": m["line_chars"] / total} | {f"share_{n}": m[f"chars_{n}"] / total for n in limits}
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
            over = shares["line_share"] > lines
            for n, most in limits.items():
                over |= shares[f"share_{n}"] > most
            counts = [pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([rows.column(0), *counts, pa.array(failed), pa.array(~(failed | over)), *(pa.array(v, pa.float64()) for v in shares.values())], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_share", *(f"share_{n}" for n in limits)]
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kinds = [source.schema[0].dataType.simpleString(), *["bigint"] * 5, "boolean", "boolean", *["double"] * (1 + len(limits))]
    return source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
