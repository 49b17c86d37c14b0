"""Operator 1, token counts: rank-synchronous merging of batched pre-tokens, no cache, no ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _bpe
from ._base import text_chunks

#: Tokens above which a document is over the limit.
LIMIT = 512


def _split(texts: list[bytes], added: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts' parts around added tokens, each part's text, and added tokens by text."""
    hits = np.zeros(len(texts), np.int64)
    if len(added) > 1:
        raise ValueError("more than one added token: their order of precedence isn't defined here")
    special = next((t for t in added), None)
    if special is None or not any(special in t for t in texts):
        return texts, np.arange(len(texts)), hits
    parts, owner = [], []
    for k, t in enumerate(texts):
        here = t.split(special)
        hits[k] = len(here) - 1
        parts += here
        owner += [k] * len(here)
    return parts, np.array(owner), hits


def count_texts(texts: list[bytes], path: str) -> np.ndarray:
    """Tokens of each UTF-8 text under the vocabulary file, added tokens found in it included."""
    vocabulary = _bpe.vocabulary(path)
    parts, owner, total = _split(texts, getattr(vocabulary, "added", []))
    joined, starts, counts = _bpe.pre_tokens(parts)
    if len(starts):
        place, words = _bpe.distinct(joined, starts)
        _, sizes = _bpe.merge(words, vocabulary.byte_ids, vocabulary.pairs)
        sums = np.append(0, np.cumsum(sizes[place]))
        ends = np.cumsum(counts)
        np.add.at(total, owner, sums[ends] - sums[ends - counts])
    return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Ids may repeat or be null: rows are counted
    one by one, in one narrow pass without a shuffle. Other columns of docs aren't read, so
    names may clash. An empty table gives an empty table. A text of any length is one row's
    work; its memory is a few dozen bytes for each of its characters.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            n = count_texts(texts, path)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
