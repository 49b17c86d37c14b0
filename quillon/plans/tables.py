"""Materialised intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset in a session on this machine alone (master local) a folder is made and
    set; elsewhere that raises, as executors would write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quillon-{what}-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    release(0)


_RELEASED = [0]


def released() -> int:
    """How often release() has removed places: what was kept before may be gone."""
    return _RELEASED[0]


def mark() -> int:
    """How many places there are, for release()."""
    return len(_OWN)


def release(since: int) -> None:
    """Removes the places made since mark(): for a long session, once what was read from them has
    been written elsewhere."""
    for spark, path in _OWN[since:]:
        with contextlib.suppress(Exception):  # the session has ended: the folder's owner clears it
            remove(spark, path)
    del _OWN[since:]
    _RELEASED[0] += 1


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and reread: lineage ends here, and a lost executor
    costs no recomputation of what led to it."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamps(frames: list[DataFrame]) -> tuple[str, ...]:
    """The files that the frames read, each with its size and time of change, as the driver sees them."""
    found = set()
    for df in frames:
        spark = df.sparkSession
        for name in df.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            found.add(f"{name} {status.getLen()} {status.getModificationTime()}")
    return tuple(sorted(found))


def counted(df: DataFrame, what: str = "table") -> tuple[DataFrame, int]:
    """materialise(), and the number of rows as the write saw them (after a lost task perhaps more,
    never 0 for some), which saves the job that would count them."""
    seen = Observation()
    held = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), what)
    return held, seen.get["n"]
