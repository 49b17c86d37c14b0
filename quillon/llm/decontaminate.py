"""Operator 10, benchmark decontamination: a broadcast hash set of normalised test n-grams, a
scan of training token windows against it, verification of the hits, removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import apart, strings, table, text_chunks
from ._words import Texts, covered, mix, sums_by, windows

#: Words of a window.
WINDOW = 10
#: UTF-8 bytes of benchmark texts up to which their windows are one broadcast set (28 bytes for each
#: of two million windows at most); the windows of a larger benchmark stay in a table.
BLOCK_BYTES = 4 << 20
#: Bits of the filter of a larger benchmark's windows for each of them, and its 64-bit words at most.
BLOOM_BITS, BLOOM_WORDS = 16, 1 << 22
#: Rows of an Arrow batch of windows.
OUT_ROWS = 20_000


def _normal(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in lower case with one space after each, and where each begins and ends there."""
    edge = np.zeros(len(t.bytes) + 1, np.int8)
    edge[starts] = 1
    edge[ends] = -1
    inside = np.cumsum(edge[:-1]) > 0
    text = np.where(inside, t.lowered[: len(t.bytes)], 0x20).astype(np.uint8)
    kept = inside.copy()
    kept[ends] = True
    at = np.cumsum(kept) - 1
    return text[kept], at[starts], at[ends]


def _grams(texts: list[bytes], window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: each window's text, its hash and another one, its begin and end in the normalised
    words, and those. A text of fewer words than a window is one window."""
    t = Texts(texts, lower=True)
    starts, ends, counts = t.words("alnum")
    normal, begins, stops = _normal(t, starts, ends)
    values, owner = t.hashes(starts, ends), np.repeat(np.arange(len(texts)), counts)
    for n in np.unique(np.minimum(counts, window)).tolist():
        mine = np.minimum(counts, window) == n
        if not n or not mine.any():
            continue
        words = np.flatnonzero(np.repeat(mine, counts))
        at, keys = windows(values[words], counts[mine], n)
        _, other = windows(mix(values[words] + np.uint64(1)), counts[mine], n)
        yield n, owner[words[at]], keys, other, begins[words[at]], stops[words[at + n - 1]], normal


class Grams:
    """The windows of the items: by length, hash tables to normalised text and item ids. Windows with
    the same hash stand side by side."""

    BITS = 20

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.names)}
        item = np.array([place[i] for i, _ in items], np.int64)
        self.normal, self.by_length = b"", []
        for n, owner, keys, other, begin, end, normal in _grams([t for _, t in items], window):
            self.normal = normal.tobytes()
            order = np.lexsort((item[owner], other, keys))
            keys, other, named = keys[order], other[order], item[owner][order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])
            fresh = new.copy()
            fresh[1:] |= named[1:] != named[:-1]
            seen = np.zeros(1 << self.BITS, bool)
            seen[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            posts = np.append(np.flatnonzero(new[fresh]), fresh.sum()).astype(np.int32)
            self.by_length.append((n, keys[new], seen, begin[order][new].astype(np.int32), end[order][new].astype(np.int32), posts, named[fresh].astype(np.int32)))

    def scan(self, texts: list[bytes]) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """The texts, their words' starts, ends and numbers, which words are hit, and the items
        that occur in each text."""
        t = Texts(texts, lower=True)
        starts, ends, counts = t.words("alnum")
        hit, items = np.zeros(len(starts), bool), [set() for _ in texts]
        if not len(starts):
            return t, starts, ends, counts, hit, items
        values = t.hashes(starts, ends)
        owner = np.repeat(np.arange(len(texts)), counts)
        normal = None
        for n, keys, seen, begin, end, posts, named in self.by_length:
            at, hashes = windows(values, counts, n)
            near = seen[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)]
            at, hashes = at[near], hashes[near]
            first, last = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
            some = last > first
            if some.any() and normal is None:
                normal, begins, stops = _normal(t, starts, ends)
                normal = normal.tobytes()
            sure = []
            for k, a, b in zip(at[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                said = normal[begins[k] : stops[k + n - 1]]
                for g in range(a, b):
                    if self.normal[begin[g] : end[g]] == said:
                        sure.append(k)
                        items[owner[k]].update(self.names[i] for i in named[posts[g] : posts[g + 1]])
            if sure:
                hit |= covered(np.array(sure), n, len(starts))
        return t, starts, ends, counts, hit, items


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item and text of the items that have both."""
    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")


def _block(items: DataFrame, window: int) -> Broadcast | None:
    """The windows as one broadcast set; none if the benchmark is larger than a block."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
        return None
    held = [(r.item, bytes(r.text)) for r in items.select("item", F.col("text").cast("binary").alias("text")).collect()]
    held = [(i, t.decode(errors="replace").encode()) for i, t in held]
    return items.sparkSession.sparkContext.broadcast(Grams(held, window))


_GRAM = "n int, hash bigint, gram binary"


def _gram_rows(n: int, keys: np.ndarray, begin: np.ndarray, end: np.ndarray, normal: np.ndarray) -> list[pa.Array]:
    at = np.append(0, np.cumsum(end - begin))
    data = normal[np.repeat(begin - at[:-1], end - begin) + np.arange(at[-1])] if len(begin) else normal[:0]
    return [pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])]


def _hits(source: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """key (the text's digest), runs (of hit words: first and last) and items (sorted) of the texts
    that hold a window. source has text and key.

    One scan of the texts, whatever the benchmark's size: a filter of the windows' hashes, whose
    size follows their number, passes candidates; joins on hash and text tell which are windows.
    """
    spark = items.sparkSession

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            for n, owner, keys, _, begin, end, normal in _grams(texts, window):
                for a in range(0, len(keys), OUT_ROWS):
                    b = a + OUT_ROWS
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner[a:b])), *_gram_rows(n, keys[a:b], begin[a:b], end[a:b], normal)], ["item", "n", "hash", "gram"])

    wanted = table(items.mapInArrow(list_windows, f"item string, {_GRAM}").distinct(), "windows")
    lengths = wanted.groupBy("n").count().collect()  # `window` rows at most
    size = 1 << 10
    while size < BLOOM_WORDS and 64 * size < BLOOM_BITS * sum(r["count"] for r in lengths):
        size *= 2
    bits = wanted.select(F.pmod("hash", F.lit(size)).alias("word"), F.expr("shiftleft(1L, CAST(shiftrightunsigned(hash, 58) AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(hash, 52) & 63 AS INT))").alias("bits"))
    got = bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # `size` rows at most
    bloom = np.zeros(size, np.int64)
    bloom[got["word"].to_numpy()] = got["bits"].to_numpy()
    held, sizes = spark.sparkContext.broadcast(bloom), sorted(r.n for r in lengths)

    def list_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value.view(np.uint64)
        for rows, texts in text_chunks(batches):
            t = Texts(texts, lower=True)
            starts, ends, counts = t.words("alnum")
            values, owner = t.hashes(starts, ends), np.repeat(np.arange(len(texts)), counts)
            first = np.cumsum(counts) - counts
            normal, begins, stops = _normal(t, starts, ends)
            for n in sizes:
                at, u = windows(values, counts, n)
                word = words[(u.view(np.int64) % len(words)).astype(np.int64)]
                near = np.flatnonzero((word >> (u >> np.uint64(58))) & (word >> ((u >> np.uint64(52)) & np.uint64(63))) & np.uint64(1))
                for a in range(0, len(near), OUT_ROWS):
                    k = at[near[a : a + OUT_ROWS]]
                    keys = rows.column(1).take(pa.array(owner[k]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(k - first[owner[k]]), *_gram_rows(n, u[near[a : a + OUT_ROWS]], begins[k], stops[k + n - 1], normal)], ["key", "place", "n", "hash", "gram"])

    found = table(source.select("text", "key").mapInArrow(list_candidates, f"key binary, place bigint, {_GRAM}").distinct(), "candidates")
    gram = ["n", "hash", "gram"]
    true = wanted.select(gram).distinct()
    places = found.join(apart(true, *gram), gram, "left_semi").groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("at"))
    names = found.select("key", *gram).distinct().join(apart(wanted, *gram), gram).select("key", "item").distinct()
    names = names.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for x in batch.column(1):
                place, n = (x.values.field(k).to_numpy() for k in (0, 1))
                hit = np.zeros(int((place + n).max()) + 1, bool)
                for m in np.unique(n).tolist():
                    hit[:-1] |= covered(place[n == m], m, len(hit) - 1)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8)])))
                runs.append([{"a": a, "b": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["key", "runs"])

    return table(places.mapInArrow(unite, "key binary, runs array<struct<a:bigint,b:bigint>>").join(names, "key"), "hits")


def _key(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are A-Z lower-cased runs of digits, ASCII letters and non-ASCII characters. A window
    is `window` consecutive words of an item, or all words of a shorter one; a document word in
    any occurrence of a window is hit. Null or empty texts have no words; null or wordless
    items, and items without id, have no windows; equal item ids count as one item. Repeated
    document ids stay rows of their own. Bytes that aren't UTF-8 count as U+FFFD. An empty
    benchmark hits nothing; an empty table gives an empty table. The windows of a benchmark
    beyond BLOCK_BYTES stay in a table that is joined to what a filter of them passes.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, items = source.schema[0].dataType.simpleString(), _items(benchmark, item_col, item_text_col)
    block = _block(items, window)
    if block is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, texts in text_chunks(batches):
                _, _, _, counts, hit, items = block.value.scan(texts)
                n_hit = sums_by(hit, counts)
                sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), strings(sha), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return source.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            counts = Texts(texts, lower=True).words("alnum")[2]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(counts, pa.int64())], ["doc_id", "key", "n_words"])

    keyed = source.withColumn("key", _key("text"))
    counted = keyed.mapInArrow(count, f"doc_id {kind}, key binary, n_words bigint")
    joined = counted.join(_hits(keyed, items, window), "key", "left")
    n_hit = F.coalesce(F.expr("aggregate(runs, 0L, (s, r) -> s + r.b - r.a + 1)"), F.lit(0).cast("bigint"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without what contamination() finds, all columns kept: mode "document" removes the
    documents with a hit, "span" the hit words, from the first to the last of a run of them.

    Clean rows, null and empty texts among them, stay as they are. The hit words are those of the
    whole benchmark in the text as it came, so its size doesn't matter. Columns may have any names
    but __key and __runs.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    at, names, items = docs.columns.index(text_col), docs.columns, _items(benchmark, item_col, item_text_col)
    block = _block(items, window)
    if block is None:
        hits = _hits(docs.select(F.col(text_col).alias("text"), _key(text_col).alias("key")), items, window).select(F.col("key").alias("__key"), F.col("runs").alias("__runs"))
        joined = docs.withColumn("__key", _key(text_col)).join(hits, "__key", "left")
        if mode == "document":
            return joined.where("__runs IS NULL").select(names)
        docs = joined.select(*names, "__runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays([*b.columns, b.column(at)], [*(str(k) for k in range(b.num_columns)), "text"]) for b in batches)
        for rows, texts in text_chunks(named):
            columns = rows.columns[: len(names)]
            if block is None:
                t = Texts(texts, lower=True)
                starts, ends, counts = t.words("alnum")
                first = np.cumsum(counts) - counts
                hit = np.zeros(len(starts), bool)
                for k, runs in enumerate(rows.column(len(names)).to_pylist()):
                    for r in runs or ():
                        hit[first[k] + r["a"] : first[k] + r["b"] + 1] = True
            else:
                _, starts, ends, counts, hit, _ = block.value.scan(texts)
                first = np.cumsum(counts) - counts
            bad = sums_by(hit, counts) > 0
            if mode == "document":
                columns = [c.filter(pa.array(~bad)) for c in columns]
            elif bad.any():
                kept = columns[at].cast(pa.binary()).to_pylist()
                offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
                for k in np.flatnonzero(bad).tolist():
                    kept[k] = _without(texts[k], starts[first[k] :][: counts[k]] - offset[k], ends[first[k] :][: counts[k]] - offset[k], hit[first[k] :][: counts[k]])
                columns[at] = pc.cast(pa.array(kept, pa.binary()), options=pc.CastOptions(columns[at].type, allow_invalid_utf8=True))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.select(names).schema)


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> bytes:
    parts, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        parts.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*parts, text[at:]])
