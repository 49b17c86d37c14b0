"""Streams: a change log applied to a keyed table batch by batch, keyed state, and channels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.plans.tables import new_path


def apply_changes(base: DataFrame, changes: DataFrame, key: list[str], order: str, op: str = "op", late: bool = False) -> DataFrame:
    """base with the last change of each key applied: op "put" replaces or adds, "delete" removes. A
    null key is a key.

    With `late`, changes may come after later ones: base has their columns, its rows compete with them
    by `order`, and a deleted key stays as a row that says so; current() leaves those out."""
    if late:
        changes = base.unionByName(changes.select(base.columns))
        return changes.groupBy(*key).agg(F.max_by(F.struct(*base.columns), order).alias("c")).select("c.*")
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*changes.columns), order).alias("c")).select("c.*")
    names = {k: f"__k{n}" for n, k in enumerate(key)}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    kept = base.join(last.select(*key).withColumnsRenamed(names), reduce(Column.__and__, on), "left_anti")
    return kept.unionByName(last.where(F.col(op) == "put").select(base.columns))


def current(base: DataFrame, op: str = "op") -> DataFrame:
    """What apply_changes(late=True) holds, without its deleted keys."""
    return base.where(F.col(op) == "put").drop(op)


def maintain(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs `refresh(changes, batch)` for every micro-batch, as for an index of which only touched
    keys are computed anew. A batch may come again after a failure: refresh must not mind."""
    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Versions:
    """A table of numbered versions, in a new place of the shared folder: each micro-batch writes its
    own, so a batch that comes again writes the same version again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.latest = spark, new_path(spark, name), None

    def write(self, df: DataFrame, version: int) -> DataFrame:
        path = f"{self.root}/v{version}"
        df.write.mode("overwrite").parquet(path)
        self.latest = version
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.latest if version is None else version}")


def running_state(stream: DataFrame, key: str, value: str, fold: Callable[[float, pd.Series], float], initial: float) -> DataFrame:
    """An atom for each key, swapped by `fold(state, values)` for every micro-batch that has rows of
    it: key and state, in update mode."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else initial
        for frame in frames:
            now = float(fold(now, frame[value]))
        state.update((now,))
        yield pd.DataFrame({key: [keys[0]], "state": [now]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state double", "state double", "update", GroupStateTimeout.NoTimeout)


class Channel:
    """A bounded FIFO of batches of rows between a writer and a stream: files in a folder.

    put() writes a batch (>!), offer() only if fewer than `size` batches wait, take() is the stream
    that reads them (<!), close() ends writing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, size: int | None = None):
        self.spark, self.path, self.schema, self.size = spark, path, schema, size
        self.written, self.taken, self.closed = 0, 0, False

    def put(self, df: DataFrame) -> None:
        if self.closed:
            raise ValueError("the channel is closed")
        df.write.mode("append").parquet(self.path)
        self.written += 1

    def offer(self, df: DataFrame) -> bool:
        if self.closed or self.size is not None and self.written - self.taken >= self.size:
            return False
        self.put(df)
        return True

    def take(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def done(self, n: int = 1) -> None:
        """Tells that n batches have been taken."""
        self.taken += n

    def close(self) -> None:
        self.closed = True
