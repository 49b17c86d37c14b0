"""What the training-data operators share: shared-folder tables and batches for Arrow UDFs."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.tables import materialise as table
from quillon.plans.tables import new_path

__all__ = ["apart", "new_path", "small_batches", "strings", "table", "text_chunks"]

#: Bytes of text that one numpy pass holds at most, unless a single text is longer.
CHUNK_BYTES = 512 << 10
#: Rows of an Arrow batch for which the registered queries set the session, so that workers stay small
#: with texts of any usual length; spark.sql.execution.arrow.maxBytesPerBatch (64 MB) bounds the rest.
BATCH_ROWS = 1_000


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the UTF-8 bytes of their column `text` (null: empty; bytes that
    aren't UTF-8: each as U+FFFD, by the usual rule of longest beginnings)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
        ends, at = np.cumsum(sizes), 0
        while at < len(text):
            past = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, past + limit, "right")))
            yield batch.slice(at, to - at), _valid([x or b"" for x in text.slice(at, to - at).to_pylist()])
            at = to
        del text, batch
        _trim()


def _valid(texts: list[bytes]) -> list[bytes]:
    try:
        b"\n".join(texts).decode()
    except UnicodeDecodeError:
        return [t.decode(errors="replace").encode() for t in texts]
    return texts


def _trim() -> None:
    """Gives freed memory back, as workers idle beside the executor's other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS rows, if they aren't smaller yet. Operators
    leave the session alone; the registered queries and the pipeline's stages call this."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df, aggregated by the keys, dealt by another hash of them: a join on the keys then has an
    exchange of its own on either side, so that Spark can split the other side's hot keys."""
    return df.repartition(F.xxhash64(F.lit("apart"), *keys))


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())
