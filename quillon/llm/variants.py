"""Operator 12, spelling variants: every word's two halves stand in Aho-Corasick automata, one a shard;
words are scanned for halves at the right place with a compatible length, and the rest is verified."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.tables import counted

from ._base import table, text_chunks

#: Fewest code points and fewest occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has at least so many times its variant's occurrences.
RATIO = 5
#: Of runs, one in so many loses a code point, by a hash of the document and the run.
EVERY = 199
#: Halves that one automaton holds, about; halves that more words share are dealt over several.
SHARD = 20_000
#: Words that a task counts before it passes their counts on.
HELD = 200_000
#: Code points of a rest beyond which its variants are told by hashes.
LONG = 48

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def runs(text: bytes, least: int) -> list[str]:
    """The maximal runs of letters of at least that length, A-Z lower-cased."""
    return re.findall(rf"[a-zÀ-ÿ]{{{least},}}", text.translate(_LOWER).decode())


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, its occurrences over all rows. Of the runs of letters whose hash with their document's
    id (null: nothing) 199 divides, a code point is left out. Counts of a task are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)
        for rows, texts in text_chunks(batches):
            for name, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                before = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in Counter(runs(text, least_length)).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % EVERY == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    total[word] += n
            if len(total) > HELD:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    parts = source.mapInArrow(run, "word string, n bigint").where(F.char_length("word") >= least_length)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(total: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def _whole(rest: str):
    """A key that tells rests of any length apart."""
    if len(rest) <= LONG:
        return rest
    h = 0
    for c in rest:
        h = (h * _BASE + ord(c)) % _PRIME
    return len(rest), h


def _without(rest: str) -> list:
    """The keys of the rest without each of its code points; linear in its length if it's long."""
    n = len(rest)
    if n <= LONG + 1:
        return [rest[:k] + rest[k + 1 :] for k in range(n)]
    prefix, powers = [0], [1]
    for c in rest:
        prefix.append((prefix[-1] * _BASE + ord(c)) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    return [(n - 1, (prefix[n] + (prefix[k] - prefix[k + 1]) * powers[n - 1 - k]) % _PRIME) for k in range(n)]


def one_edit(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes y of x."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    k = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    return x[k + (len(x) == len(y)) :] == y[k + 1 :]


class Shard:
    """An automaton over halves of words, and by each half what the words' other halves are."""

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.halves: dict[tuple[int, str], int] = {}
        self.same: dict = {}
        self.fewer: dict = defaultdict(list)
        self.automaton = None

    def add(self, side: int, word: str, n: int) -> None:
        cut, at = len(word) // 2, len(self.words)
        half, rest = (word[:cut], word[cut:]) if side == 0 else (word[cut:], word[:cut])
        key = self.halves.setdefault((side, half), len(self.halves))
        self.words.append((word, n))
        self.same[key, _whole(rest)] = at
        for k, less in enumerate(_without(rest)):
            self.fewer[key, less].append((k, at))

    def close(self) -> None:
        named: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for (side, half), key in self.halves.items():
            named[half].append((side, key))
        self.automaton = ahocorasick.Automaton()
        for half, found in named.items():
            self.automaton.add_word(half, (len(half), found))
        self.automaton.make_automaton()

    def near(self, y: str) -> list[tuple[str, int]]:
        """The words with one of their halves here that are one edit from y, each by one half: by the
        second only if y doesn't begin with the first."""
        found = set()
        for end, (n, named) in self.automaton.iter(y):
            for side, key in named:
                if side == 0 and end == n - 1:
                    rest = y[n:]
                elif side == 1 and end == len(y) - 1:
                    rest = y[:-n]
                else:
                    continue
                for _, at in self.fewer.get((key, _whole(rest)), ()):
                    found.add((side, at))
                for k, less in enumerate(_without(rest)):
                    at = self.same.get((key, less))
                    if at is not None:
                        found.add((side, at))
                    for k_, at in self.fewer.get((key, less), ()):
                        if k_ == k:
                            found.add((side, at))
        out = []
        for side, at in found:
            x, n = self.words[at]
            if (side == 0 or not y.startswith(x[: len(x) // 2])) and one_edit(x, y):
                out.append((x, n))
        return out


def _half(side: Column, word: Column, length: Column) -> Column:
    """What stands in `word` where a word of that length has its first or second half."""
    cut = (length / 2).cast("int")
    n = F.char_length(word)
    return F.when(side == 0, F.substring(word, F.lit(1), cut)).otherwise(F.substring(word, n - (length - cut) + 1, length - cut))


def near_words(words: DataFrame, n_words: int, shard: int = SHARD) -> DataFrame:
    """word, n_near, and form and form_n of its near word of largest n (ties: the smallest), for each of
    the words (word, n) that has any; `n_words` is their number.

    A word is in two shards as a pattern, by its length and each half, and is scanned in the at most six
    that may hold a near word's half at the right place. A half that more words of one length share than
    a shard holds is dealt over several by the words' hash, and words with that half are scanned in each
    of these. What is broadcast is such halves, 2 * n_words / shard of them at most.
    """
    n_shards, side = max(1, -(-2 * n_words // shard)), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    patterns = words.select("word", "n", side).withColumn("length", F.char_length("word"))
    patterns = patterns.withColumn("half", F.xxhash64("side", "length", _half(F.col("side"), F.col("word"), F.col("length"))))
    hot = patterns.groupBy("half").count().where(F.col("count") > shard).select("half", F.ceil(F.col("count") / shard).cast("int").alias("splits"))
    hot = F.broadcast(table(hot, "halves"))
    lengths = F.explode(F.array(F.char_length("word") - 1, F.char_length("word"), F.char_length("word") + 1)).alias("length")
    scans = words.select("word", side).select("word", "side", lengths)
    scans = scans.select("word", F.xxhash64("side", "length", _half(F.col("side"), F.col("word"), F.col("length"))).alias("half"))
    number = lambda split: F.pmod(F.xxhash64("half", split), F.lit(n_shards))
    split = F.coalesce(F.pmod(F.xxhash64("word"), F.col("splits")), F.lit(0)).cast("int")
    held = patterns.join(hot, "half", "left").select(number(split).alias("shard"), F.lit(0).alias("scan"), "word", "n", "side")
    each = scans.join(hot, "half", "left").select("word", "half", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits") - 1, F.lit(0)))).alias("split"))
    asked = each.select(number(F.col("split")).alias("shard"), F.lit(1).alias("scan"), "word", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("side")).distinct()
    rows = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "scan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, now = None, Shard()
        for batch in batches:
            found = []
            for at, scan, word, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != name:
                    name, now = at, Shard()
                if not scan:
                    now.add(s, word, n)
                    continue
                if now.automaton is None:
                    now.close()
                near = now.near(word) if now.words else []
                if near:
                    form, form_n = min(near, key=lambda x: (-x[1], x[0]))
                    found.append((word, len(near), form, form_n))
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "form", "form_n"])

    parts = rows.mapInArrow(run, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last of the forms that follow each other from it, for rows of word and form.
    Each round doubles the steps; a form has five times its word's occurrences, so chains are short."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        held = table(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = held.drop("moved")
        if held.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """One row a word: word, n (occurrences), n_near (words that are one edit away), form (its near word of
    largest n, ties: the smallest, if that n is at least `ratio` times the word's), form_n, and root (the
    last of the forms that follow from it, else the word).

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least 6 code points
    and 5 occurrences in all rows; null and empty texts have none, repeated rows and ids count each. Other
    columns of docs aren't read. An empty table gives an empty table. Words of any length are handled.
    """
    words, n_words = counted(word_counts(docs, id_col, text_col), "words")
    judged = words.join(near_words(words, n_words, shard), "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    judged = table(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "variants")
    found = judged.join(roots(judged.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
