"""Operator 4, byte-level BPE encoding and decoding: scanned pre-tokens, cached pair merging."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._base import text_chunks

#: Distinct pre-tokens that a worker's cache holds before it starts anew.
CACHE_WORDS = 100_000


class Codec:
    """Encoder and decoder of one vocabulary file, with the cache of merged pre-tokens."""

    def __init__(self, path: str):
        self.vocabulary = _bpe.vocabulary(path)
        self.tokens = pa.array(self.vocabulary.tokens, pa.large_binary())
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.begin, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _merged(self, words: pa.Array) -> np.ndarray:
        """Each word's place in the cache, after its misses are merged and kept."""
        if len(self.place) > CACHE_WORDS:
            self._clear()
        names = words.to_pylist()
        place = np.array([self.place.get(w, -1) for w in names], np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = words.take(pa.array(missing))
            flat, sizes = _bpe.merge(new, self.vocabulary.byte_ids, self.vocabulary.pairs)
            at = len(self.sizes)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            place[missing] = at + np.arange(len(missing))
            self.place.update(zip(new.to_pylist(), range(at, at + len(missing)), strict=True))
        return place

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, the ids' number by text, and the byte offset in its text at which
        each id's bytes begin."""
        joined, starts, counts = _bpe.pre_tokens(texts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
        slot, words = _bpe.distinct(joined, starts)
        place = self._merged(words)[slot]
        sizes = self.sizes[place]
        ids = _bpe.ragged(self.flat, self.begin[place], sizes)
        sums, ends = np.append(0, np.cumsum(sizes)), np.cumsum(counts)
        per_text = sums[ends] - sums[ends - counts]
        width = self.widths[ids]
        offset = np.cumsum(width) - width
        text_at = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
        return ids, per_text, offset - np.repeat(text_at, per_text)

    @property
    def widths(self) -> np.ndarray:
        if not hasattr(self, "_widths"):
            self._widths = np.array([len(t) for t in self.vocabulary.tokens], np.int64)
            self._decimal = pa.array([b"%d " % k for k in range(len(self._widths))], pa.large_binary())
        return self._widths

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """Where each id's bytes begin (and the end), and the bytes in a row."""
        return self._gather(self.tokens, ids)

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """The same for the ids' decimal digits, each with a space after it."""
        assert len(self.widths)
        return self._gather(self._decimal, ids)

    @staticmethod
    def _gather(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        got = pc.take(table, pa.array(ids))
        offsets = np.frombuffer(got.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        return offsets, memoryview(got.buffers()[2] or b"")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of the file, with its cache."""
    return _CODECS.setdefault(path, None) or _CODECS.__setitem__(path, Codec(path)) or _CODECS[path]


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, ids (array of int) and offsets (the byte offset in the UTF-8
    text at which each id's bytes begin).

    A null or empty text has no ids. Repeated ids and rows stay as they are; other columns of
    docs aren't read. An empty table gives an empty table. One narrow pass, no shuffle.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            ids, counts, offsets = codec(path).encode(texts)
            at = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(offsets, pa.int64()))], ["doc_id", "ids", "offsets"])

    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>, offsets array<bigint>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text (binary) of rows with doc_id and ids; null ids give an empty text."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets, data = codec(path).decode(ids)
            ends = np.cumsum(counts)
            texts = [bytes(data[a:b]) for a, b in zip(offsets[ends - counts].tolist(), offsets[ends].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, text binary")


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256 (of the decimal ids joined
    by one space), decoded_sha256 (of the decoded bytes). Null and empty texts have 0 tokens and
    the digests of nothing; all else as bpe_encode."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            ids, counts, _ = codec(path).encode(texts)
            ends = np.cumsum(counts)
            said, sums = [], []
            for (offsets, data), cut in ((codec(path).decimals(ids), 1), (codec(path).decode(ids), 0)):
                spans = zip(offsets[ends - counts].tolist(), offsets[ends].tolist(), strict=True)
                sums.append([hashlib.sha256(data[a : max(a, b - cut)]).hexdigest() for a, b in spans])
            said = [rows.column(0), pa.array(counts, pa.int64()), pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays(said, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
