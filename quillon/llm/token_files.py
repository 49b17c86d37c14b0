"""Operator 13, token-ID output: directly addressable codes. The ids of a segment are split into chunks
of a few bits, level by level; a bitmap says which ids go on, and a directory of its ranks says where,
so that any one id is found in its levels' chunks without decoding what stands before it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bpe
from ._base import text_chunks
from ._pieces import Grown, Known, byte_vocabulary, cut

#: Tokens after which a segment is closed, at the end of the document.
SEGMENT = 1 << 18
#: Bits of a bitmap that one entry of its rank directory counts.
BLOCK = 512
#: Bytes of text that are cut into pieces at once: the more, the fewer pieces are looked up again.
CUT_BYTES = 1 << 20
#: The id that ends each document.
END = 0
#: Bytes of a Parquet row group, so that reading one segment reads little else.
GROUP_BYTES = 4 << 20


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits (1 to 8), the first in the lowest bits: eight of them are `width` bytes."""
    rows = -(-len(values) // 8)
    grid = np.zeros(rows * 8, np.uint64)
    grid[: len(values)] = values
    words = np.bitwise_or.reduce(grid.reshape(rows, 8) << (np.arange(8, dtype=np.uint64) * np.uint64(width)), axis=1)
    return words.astype("<u8").view(np.uint8).reshape(rows, 8)[:, :width].reshape(-1)


def unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = -(-n // 8)
    words = np.zeros((rows, 8), np.uint8)
    words[:, :width] = data[: rows * width].reshape(rows, width)
    grid = words.reshape(-1).view("<u8")[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(width))
    return (grid & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(-1)[:n]


@dataclass(frozen=True)
class Level:
    """n chunks of `width` bits; `more` has a bit for each, set where the id goes on in the next level;
    ranks[k] is how many are set before bit BLOCK * k."""

    width: int
    n: int
    chunks: np.ndarray
    more: np.ndarray
    ranks: np.ndarray


def widths_for(lengths: np.ndarray) -> list[int]:
    """The widths of the levels (8 bits at most) whose chunks and bitmaps are smallest, for a histogram
    of the ids' bit lengths."""
    top = max(1, int(np.flatnonzero(lengths).max(initial=0)))
    reach = [int(lengths[p + 1 :].sum()) if p else int(lengths.sum()) for p in range(top)]  # ids with a chunk from bit p on
    best: dict[int, tuple[int, list[int]]] = {top: (0, [])}
    for p in range(top - 1, -1, -1):
        options = [(reach[p] * (w + (p + w < top)) + best[p + w][0], [w, *best[p + w][1]]) for w in range(1, min(8, top - p) + 1)]
        best[p] = min(options)
    return best[0][1]


def encode_levels(ids: np.ndarray) -> list[Level]:
    """The levels of a row of ids (unsigned, below 2^32)."""
    rest = ids.astype(np.uint32)
    bits = np.zeros(33, np.int64)
    counts = np.bincount(np.frexp(rest.astype(np.float64))[1], minlength=1)
    bits[: len(counts)] = counts
    out, left = [], widths_for(bits)
    while left:
        width, *left = left
        more = rest >> np.uint32(width) > 0
        marks = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        out.append(Level(width, len(rest), pack(rest & np.uint32((1 << width) - 1), width), marks, (np.cumsum(per_block) - per_block).astype("<u4")))
        rest = rest[more] >> np.uint32(width)
    return out


def decode_levels(levels: list[Level]) -> np.ndarray:
    """All ids of a segment."""
    rest = np.zeros(0, np.uint32)
    for level in reversed(levels):
        here = unpack(level.chunks, level.width, level.n)
        if len(rest):
            here[np.unpackbits(level.more, count=level.n, bitorder="little").view(bool)] |= rest << np.uint32(level.width)
        rest = here
    return rest


def get(levels: list[Level], at: np.ndarray) -> np.ndarray:
    """The ids at some places of a segment: of each level only the chunk and its bitmap's block are read."""
    out, live, place, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), np.asarray(at, np.int64), 0
    for level in levels:
        bit = place * level.width
        wide = np.append(level.chunks, np.uint8(0)).astype(np.uint32)
        pair = wide[bit >> 3] | wide[(bit >> 3) + 1] << np.uint32(8)
        out[live] |= (pair >> (bit & 7).astype(np.uint32) & np.uint32((1 << level.width) - 1)) << np.uint32(shift)
        on = (level.more[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        live, place, shift = live[on], place[on], shift + level.width
        if not len(live):
            break
        block = place // BLOCK
        byte = (block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)
        whole = np.where(byte < (place >> 3)[:, None], level.more[np.minimum(byte, len(level.more) - 1)], 0)
        part = level.more[place >> 3] & ((1 << (place & 7)) - 1).astype(np.uint8)
        place = level.ranks[block].astype(np.int64) + np.bitwise_count(whole).sum(axis=1, dtype=np.int64) + np.bitwise_count(part)
    return out


class _Encoder(Known):
    """A worker's ids of pieces; place 0 is the end of a document."""

    def __init__(self, path: str, end: int):
        self.vocabulary, self.end = byte_vocabulary(path, special=True), end
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.flat, self.begin, self.sizes = Grown(np.uint32), Grown(np.int64), Grown(np.int64)
        self._append(np.array([self.end]), np.array([1]))
        self.place[b""] = 0

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.begin.extend(self.flat.n + np.cumsum(sizes) - sizes)
        self.flat.extend(ids)
        self.sizes.extend(sizes)

    def learn(self, words: pa.Array) -> None:
        self._append(*self.vocabulary.encode(words))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, the end of each text among them, and each text's number of ids."""
        joined, starts, counts = cut(texts)
        place = np.insert(self.places(joined, starts), np.cumsum(counts), 0)
        sizes = self.sizes.view()[place]
        sums, ends = np.append(0, np.cumsum(sizes)), np.cumsum(counts + 1)
        return _bpe.ragged(self.flat.view(), self.begin.view()[place], sizes), sums[ends] - sums[ends - counts - 1]


_ENCODERS: dict[tuple[str, int], _Encoder] = {}

_NAMES = ("part", "segment", "first", "n", "doc_ids", "ends", "levels")
_LEVELS = "array<struct<width: int, n: bigint, chunks: binary, more: binary, ranks: binary>>"


def _row(part: int, segment: int, first: int, ids: list[np.ndarray], doc_ids: list[pa.Array], sizes: list[np.ndarray]) -> list[pa.Array]:
    """A segment's row, but for its names."""
    levels = [{"width": x.width, "n": x.n, "chunks": x.chunks.tobytes(), "more": x.more.tobytes(), "ranks": x.ranks.tobytes()} for x in encode_levels(np.concatenate(ids))]
    names, ends = pa.concat_arrays(doc_ids), np.cumsum(np.concatenate(sizes))
    one = np.array([0, len(names)], np.int32)
    kind = pa.list_(pa.struct([("width", pa.int32()), ("n", pa.int64()), ("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))
    return [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([int(ends[-1])], pa.int64()), pa.ListArray.from_arrays(one, names), pa.ListArray.from_arrays(one, pa.array(ends, pa.int64())), pa.array([levels], kind)]


def _levels(said: list[dict]) -> list[Level]:
    return [Level(x["width"], x["n"], np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in said]


class TokenFiles:
    """Token ids of documents under `root`, a folder that all executors share.

    segments/ holds a row for each segment: whole documents, of 2^18 ids or more together (the last of a
    partition may have fewer, one long text more), their ids as levels. parts/ holds a row for each
    partition: its documents, its ids, and how many come before. Both are Parquet files written by Spark's
    own committer, so a lost executor's tasks are written again, and once.

    Documents are in ascending order of doc_id (null first; those of one id by a hash of their text), and
    each ends in the id END. Repeated rows are documents of their own. A null or empty text has that id
    alone. An empty table has no segments.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, docs: DataFrame, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
        """Encodes and writes all rows of docs; other columns aren't read. One range shuffle of the texts:
        ids that many rows share are dealt by their texts' hash and their place in the input."""
        path = path or public_tokenizers.path("byte_bpe_50k.json")
        source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
        keyed = source.select("doc_id", "text", F.xxhash64("text").alias("__h"), F.monotonically_increasing_id().alias("__k"))
        keys = [F.col("doc_id").asc_nulls_first(), F.col("__h").asc(), F.col("__k").asc()]
        ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
        kind = source.schema[0].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _ENCODERS.get((path, end)) or _ENCODERS.setdefault((path, end), _Encoder(path, end))
            part, number, first, held = TaskContext.get().partitionId(), 0, 0, ([], [], [])
            for rows, texts in text_chunks(batches, CUT_BYTES):
                for x, new in zip(held, (*encoder.encode(texts), rows.column(0)), strict=True):
                    x.append(new)
                n = sum(map(len, held[0]))
                if n >= segment:
                    yield pa.RecordBatch.from_arrays(_row(part, number, first, held[0], held[2], held[1]), _NAMES)
                    number, first, held = number + 1, first + n, ([], [], [])
            if held[0]:
                yield pa.RecordBatch.from_arrays(_row(part, number, first, held[0], held[2], held[1]), _NAMES)

        coded = ordered.mapInArrow(run, f"part int, segment int, first bigint, n bigint, doc_ids array<{kind}>, ends array<bigint>, levels {_LEVELS}")
        coded.write.option("compression", "none").option("parquet.block.size", GROUP_BYTES).parquet(f"{self.root}/segments")
        parts = self.segments().groupBy("part").agg(F.sum("n").alias("n_tokens"), F.sum(F.size("doc_ids")).cast("bigint").alias("n_docs"))
        before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts.select("part", "n_docs", "n_tokens", before.alias("before")).coalesce(1).write.parquet(f"{self.root}/parts")

    def segments(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/segments")

    def parts(self) -> DataFrame:
        """A row a partition: part, n_docs, n_tokens, and `before`, the ids of all partitions before."""
        return self.spark.read.parquet(f"{self.root}/parts")

    def _placed(self) -> DataFrame:
        """The segments with `at`, the place of their first id among all. parts has a row a partition."""
        return self.segments().join(F.broadcast(self.parts().select("part", "before")), "part").withColumn("at", F.col("before") + F.col("first")).drop("before")

    def _read(self, each: str, arrays) -> DataFrame:
        """A row a document: doc_id, start, n_tokens and what `arrays` makes of the segment's ids and ends."""
        source = self._placed().select("at", "doc_ids", "ends", "levels")
        kind = source.schema["doc_ids"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    at, names, ends = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values.to_numpy()
                    ids = decode_levels(_levels(batch.column(3)[k].as_py())).astype("<u4")
                    starts = np.append(0, ends[:-1])
                    yield pa.RecordBatch.from_arrays([names, pa.array(at + starts, pa.int64()), pa.array(ends - starts, pa.int64()), arrays(ids, starts, ends)], ["doc_id", "start", "n_tokens", each.split()[0]])

        return source.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, {each}")

    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens (with the end) and ids, read back."""
        return self._read("ids array<bigint>", lambda ids, starts, ends: pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids, pa.int64())))

    def checksums(self) -> DataFrame:
        """doc_id, start, n_tokens, and ids_crc32, the CRC-32 of the ids as little-endian 32-bit integers."""

        def sums(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
            data = memoryview(ids).cast("B")
            return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())

        return self._read("ids_crc32 bigint", sums)

    def token(self, position: int) -> int | None:
        """The id at a place among all ids (None: no such place): reads one segment, decodes no block."""
        part = self.parts().where((F.col("before") <= position) & (position < F.col("before") + F.col("n_tokens"))).first()
        if part is None:
            return None
        k = position - part["before"]
        row = self.segments().where((F.col("part") == part["part"]) & (F.col("first") <= k) & (F.col("first") + F.col("n") > k)).select("first", "levels").first()
        return int(get(_levels([x.asDict() for x in row["levels"]]), np.array([k - row["first"]]))[0])

    def tokens(self, positions: DataFrame, col: str = "position") -> DataFrame:
        """position and id of the distinct places asked for, those beyond all ids and nulls left out.

        Places find their segment by an equality join on blocks of 2^16 ids, go to it as one array a
        segment (of its own size at most), and only those segments' levels are read.
        """
        index = self._placed().select("part", "segment", "at", "n")
        blocks = index.select("*", F.explode(F.sequence(F.shiftright("at", 16), F.shiftright(F.col("at") + F.col("n") - 1, 16))).alias("block"))
        asked = positions.select(F.col(col).cast("bigint").alias("position")).where("position >= 0").distinct().withColumn("block", F.shiftright("position", 16))
        found = asked.join(blocks, "block").where("position >= at AND position < at + n")
        wanted = found.groupBy("part", "segment", "at").agg(F.collect_list("position").alias("positions"))
        source = wanted.join(self.segments().select("part", "segment", "levels"), ["part", "segment"]).select("at", "positions", "levels")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    at, places = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(get(_levels(batch.column(2)[k].as_py()), places - at), pa.int64())], ["position", "id"])

        return source.mapInArrow(run, "position bigint, id bigint")
