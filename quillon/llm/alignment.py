"""Operator 11, cross-tokenizer alignment: ends of tokens by cumulative sums, common cuts by an
intersection, group labels by a search in them, links by repetition; the pairs' counts over the corpus
by a salted shuffle in two stages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._base import table, text_chunks
from ._pieces import Grown, Known, byte_vocabulary, cut, piece_vocabulary

#: Bits of an id within a pair.
BITS = 20
#: Bytes of text whose pairs are counted together before anything is shuffled.
CHUNK_BYTES = 2 << 20
#: Shares into which a pair's counts are dealt before they meet.
SALTS = 16
#: Links that one pass of numpy makes at most, but for one token's.
LINKS = 1 << 22


@dataclass(frozen=True)
class Groups:
    """Some texts' tokens in groups: ids in a row, each one's group, and how many groups each text has."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n: np.ndarray
    ok: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray


def grouped(words: pa.Array, first, second) -> Groups:
    """Encodes each text by both vocabularies and cuts both rows of tokens where tokens of both end.
    A text whose tokens' bytes aren't its own bytes isn't ok and has none."""
    (a, a_sizes), (b, b_sizes) = first.encode(words), second.encode(words)
    texts = words.to_pylist()
    ok = np.ones(len(texts), bool)
    for vocabulary, ids, sizes in ((first, a, a_sizes), (second, b, b_sizes)):
        ends, tokens = np.cumsum(sizes), vocabulary.tokens
        flat = ids.tolist()
        ok &= np.array([b"".join([tokens[i] for i in flat[s:e]]) == t for s, e, t in zip((ends - sizes).tolist(), ends.tolist(), texts, strict=True)], bool)
    if not ok.all():
        a, b = a[np.repeat(ok, a_sizes)], b[np.repeat(ok, b_sizes)]
        a_sizes, b_sizes = a_sizes * ok, b_sizes * ok
    a_ends, b_ends = np.cumsum(first.widths[a]), np.cumsum(second.widths[b])
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    text_ends = np.cumsum(np.array([len(t) for t in texts], np.int64) * ok)
    n = np.diff(np.searchsorted(cuts, text_ends, "right"), prepend=0)
    return Groups(a, b, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), n, ok, a_sizes, b_sizes)


def linked(g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of each text in a row (a << BITS | b), their numbers of links, and how many
    pairs each text has. Equal ids of a group are counted first; links of the rest come by repetition."""
    total = int(g.n.sum())
    a_key, a_times = np.unique(g.a_group << BITS | g.a, return_counts=True)
    b_key, b_times = np.unique(g.b_group << BITS | g.b, return_counts=True)
    a_of, b_of = a_key >> BITS, b_key >> BITS
    each = np.bincount(b_of, minlength=total)
    b_start, text_of = np.cumsum(each) - each, np.repeat(np.arange(len(g.n)), g.n)
    mask, keys, times, at = (1 << BITS) - 1, [], [], 0
    upto = np.cumsum(each[a_of])
    while at < len(a_of):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS, "right")))
        own, reps = a_of[at:to], each[a_of[at:to]]
        left = np.repeat(np.arange(at, to), reps)
        right = _bpe.ragged(np.arange(len(b_of)), b_start[own], reps)
        key = text_of[a_of[left]] << 2 * BITS | (a_key[left] & mask) << BITS | b_key[right] & mask
        found, place = np.unique(key, return_inverse=True)
        keys.append(found)
        times.append(_sums(place, a_times[left] * b_times[right], len(found)))
        at = to
    if len(keys) > 1:
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        keys, times = [found], [_sums(place, np.concatenate(times), len(found))]
    key = keys[0] if keys else np.zeros(0, np.int64)
    return key & (1 << 2 * BITS) - 1, times[0] if times else key, np.bincount(key >> 2 * BITS, minlength=len(g.n))


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, place, values)
    return out


class _Said:
    """The decimal digits of ids with what follows them in the form a1,a2|b1;a3|b2,b3; of groups."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        said = [b"%d%c" % (k, c) for k in range(n_a) for c in b",|"] + [b"%d%c" % (k, c) for k in range(n_b) for c in b",;"]
        self.table = pa.array(said, pa.large_binary())

    def groups(self, g: Groups) -> list[bytes]:
        """Each text's groups, the last semicolon left out."""
        total = int(g.n.sum())
        n_a, n_b = np.bincount(g.a_group, minlength=total), np.bincount(g.b_group, minlength=total)
        begin = np.cumsum(n_a + n_b) - n_a - n_b
        a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        a_in, b_in = np.arange(len(g.a)) - a_first[g.a_group], np.arange(len(g.b)) - b_first[g.b_group]
        entry = np.zeros(len(g.a) + len(g.b), np.int64)
        entry[begin[g.a_group] + a_in] = 2 * g.a + (a_in == n_a[g.a_group] - 1)
        entry[begin[g.b_group] + n_a[g.b_group] + b_in] = 2 * (self.n_a + g.b) + (b_in == n_b[g.b_group] - 1)
        got = pc.take(self.table, pa.array(entry))
        offsets = np.frombuffer(got.buffers()[1], np.int64)[: len(entry) + 1] if len(entry) else np.zeros(1, np.int64)
        data = memoryview(got.buffers()[2] or b"")
        ends = np.cumsum(g.a_sizes + g.b_sizes)
        return [bytes(data[s : max(s, e - 1)]) for s, e in zip(offsets[ends - g.a_sizes - g.b_sizes].tolist(), offsets[ends].tolist(), strict=True)]


class _Aligner(Known):
    """What a worker has learnt of each piece: counts, the digits of its groups, and its pairs."""

    def __init__(self, first: str, second: str):
        self.first, self.second = byte_vocabulary(first, special=False), piece_vocabulary(second)
        if max(len(self.first.tokens), len(self.second.tokens)) > 1 << BITS:
            raise ValueError(f"ids of {BITS} bits at most")
        self.said = _Said(len(self.first.tokens), len(self.second.tokens))
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.counts = {x: Grown(np.int64) for x in ("a", "b", "groups", "links")}
        self.ok, self.pairs, self.times, self.begin, self.sizes = Grown(bool), Grown(np.int64), Grown(np.int64), Grown(np.int64), Grown(np.int64)
        self.digits: list[bytes] = []

    def learn(self, words: pa.Array) -> None:
        g = grouped(words, self.first, self.second)
        pairs, times, sizes = linked(g)
        ends = np.cumsum(g.n)
        per_group = np.append(0, np.cumsum(np.bincount(g.a_group, minlength=int(g.n.sum())) * np.bincount(g.b_group, minlength=int(g.n.sum()))))
        for name, x in (("a", g.a_sizes), ("b", g.b_sizes), ("groups", g.n), ("links", per_group[ends] - per_group[ends - g.n])):
            self.counts[name].extend(x)
        self.begin.extend(self.pairs.n + np.cumsum(sizes) - sizes)
        for to, x in ((self.ok, g.ok), (self.pairs, pairs), (self.times, times), (self.sizes, sizes)):
            to.extend(x)
        new = self.said.groups(g)
        self.digits += new
        self.held += sum(map(len, new))

    def align(self, texts: list[bytes]) -> dict[str, np.ndarray | list]:
        """Counts and digests of each text, and its pairs as places among the distinct pairs of all."""
        spaced = [b" " + t if t else b"" for t in texts]
        joined, starts, counts = cut(spaced)
        if self.second.whole:
            sizes = np.array([len(t) for t in spaced], np.int64)
            starts, counts = (np.cumsum(sizes) - sizes)[sizes > 0], (sizes > 0).astype(np.int64)
        place = self.places(joined, starts)
        owner, ends = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts)
        ok = counts > 0
        ok[owner[~self.ok.view()[place]]] = False
        out = {}
        for name, x in self.counts.items():
            sums = np.append(0, np.cumsum(x.view()[place]))
            out[f"n_{name}"] = (sums[ends] - sums[ends - counts]) * ok
        listed, digits = place.tolist(), self.digits
        out["groups_sha256"] = [hashlib.sha256(b";".join([digits[p] for p in listed[e - n : e]])).hexdigest() if good else "" for e, n, good in zip(ends.tolist(), counts.tolist(), ok.tolist(), strict=True)]
        good = ok[owner]
        held, often = np.unique(owner[good] * len(self.place) + place[good], return_counts=True)
        owner, place = held // max(len(self.place), 1), held % max(len(self.place), 1)
        begin, sizes = self.begin.view()[place], self.sizes.view()[place]
        pairs, spot = np.unique(_bpe.ragged(self.pairs.view(), begin, sizes), return_inverse=True)
        key = np.repeat(owner, sizes) * max(len(pairs), 1) + spot
        order = np.argsort(key, kind="stable")
        key, times = key[order], (_bpe.ragged(self.times.view(), begin, sizes) * np.repeat(often, sizes))[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[first]
        out["pairs"], out["at"] = pairs, (key % max(len(pairs), 1)).astype(np.int32)
        out["times"] = np.add.reduceat(times, first) if len(first) else times
        out["sizes"] = np.bincount(key // max(len(pairs), 1), minlength=len(texts)).astype(np.int32)
        out["n_docs"] = np.bincount(out["at"], minlength=len(pairs))
        return out


_ALIGNERS: dict[tuple[str, str], _Aligner] = {}


def _aligner(first: str, second: str) -> _Aligner:
    return _ALIGNERS.get((first, second)) or _ALIGNERS.setdefault((first, second), _Aligner(first, second))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _paths(first: str | None, second: str | None) -> tuple[str, str]:
    return first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")


def align_chunks(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each chunk of about 2 MB of text, written to a table: its documents' counts and digests,
    the distinct pairs of the chunk with the number of its documents that hold each, and each document's
    pairs as places among those, with their numbers of links. One narrow pass."""
    first, second = _paths(first, second)
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = source.schema[0].dataType.simpleString()
    wide = [*_COUNTS, "times", "pairs", "n_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, texts in text_chunks(batches, CHUNK_BYTES):
            got = _aligner(first, second).align(texts)
            arrays = [rows.column(0), pa.array(got["groups_sha256"], pa.string()), *(pa.array(got[x], pa.int64()) for x in wide), *(pa.array(got[x], pa.int32()) for x in ("sizes", "at"))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x) for x in arrays)], ["chunk", "doc_ids", "groups_sha256", *wide, "sizes", "at"])
            number += 1

    schema = f"chunk bigint, doc_ids array<{kind}>, groups_sha256 array<string>, {', '.join(f'{x} array<bigint>' for x in wide)}, sizes array<int>, at array<int>"
    return table(source.mapInArrow(run, schema), "aligned")


def _asked(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("k", "x")).select("chunk", "k", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n"))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n_docs (documents of the corpus that hold the pair linked) and best (no pair of
    the A id has more).

    Counts are summed by chunk, by pair and salt, and by pair, so that a pair that every document holds
    is at most a row a chunk, spread over the salts. What is broadcast has a row for each id of the
    first vocabulary.
    """
    salted = _asked(chunks).groupBy("pair", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = table(salted.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a_id", F.shiftright("pair", BITS).cast("int")), "pairs")
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    judged = counts.join(F.broadcast(most), "a_id")
    return judged.select("pair", "a_id", F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("b_id"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of an A and a B token of one
    group), n_best (links whose pair is the commonest of its A id, ties included), count_sum (of the
    links' pairs' numbers of documents), groups_sha256.

    Null and empty texts, and texts whose tokens' bytes aren't a space and the text, have no tokens: zeros
    and ''. Every row is a document of its own, repeated rows and ids too. Other columns of docs aren't
    read. An empty table gives an empty table. A group of any length is aligned: its links are counted by
    distinct ids, never listed one by one.

    The corpus' counts go to the chunks that asked for them by a join on pairs, where a pair has a row a
    chunk at most, and meet the chunk's documents by a join on chunks.
    """
    chunks = align_chunks(docs, first, second, id_col, text_col)
    said = pair_counts(chunks).select("pair", F.col("n_docs").alias("count"), "best")
    answers = _asked(chunks).select("chunk", "k", "pair").join(said, "pair").groupBy("chunk").agg(F.collect_list(F.struct("k", "count", "best")).alias("answers"))
    held = chunks.select("chunk", "doc_ids", "groups_sha256", *_COUNTS, "sizes", "at", "times")
    source = held.join(answers, "chunk", "left").drop("chunk").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<k: int, count: bigint, best: boolean>>")))
    kind = source.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                flat = {name: x[k].values for name, x in columns.items()}
                k_, count, best = (flat["answers"].field(x).to_numpy(zero_copy_only=False) for x in ("k", "count", "best"))
                counts, bests = np.zeros(len(k_), np.int64), np.zeros(len(k_), np.int64)
                counts[k_], bests[k_] = count, best
                at, times, sizes = (flat[x].to_numpy() for x in ("at", "times", "sizes"))
                ends = np.cumsum(sizes)
                sums = [np.append(0, np.cumsum(times * x[at])) for x in (bests, counts)]
                n_best, count_sum = (pa.array(x[ends] - x[ends - sizes], pa.int64()) for x in sums)
                yield pa.RecordBatch.from_arrays([flat["doc_ids"], *(flat[x] for x in _COUNTS), n_best, count_sum, flat["groups_sha256"]], ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    return source.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{x} bigint' for x in (*_COUNTS, 'n_best', 'count_sum'))}, groups_sha256 string")


def aligned_tokens(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, a_ids, a_groups, b_ids, b_groups, the tokens of both vocabularies and the
    group, from 0, that each is in. Texts without tokens, as in alignment(), have empty arrays."""
    first, second = _paths(first, second)
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            aligner = _aligner(first, second)
            g = grouped(pa.array([b" " + t if t else b"" for t in texts], pa.binary()), aligner.first, aligner.second)
            before, columns = np.cumsum(g.n) - g.n, []
            for ids, group, sizes in ((g.a, g.a_group, g.a_sizes), (g.b, g.b_group, g.b_sizes)):
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, group - np.repeat(before, sizes))]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", "a_ids", "a_groups", "b_ids", "b_groups"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, a_ids array<int>, a_groups array<int>, b_ids array<int>, b_groups array<int>")
