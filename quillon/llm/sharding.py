"""Operator 9, sharding by size-tiered compaction: arrivals are appended as small immutable
shards, runs of similar size are merged into target-sized files, and a versioned manifest is
committed atomically."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a merged file, about.
TARGET_BYTES = 64 << 20
#: Shards of a tier that are merged together at least; also the ratio of the tiers' sizes.
FAN_IN = 4
#: Sizes below this are of the lowest tier.
SMALLEST = 1 << 20
#: Seconds that vacuum() leaves a file alone: no writer may take longer from its first file to its commit.
GRACE = 24 * 3600


class CommitConflict(RuntimeError):
    """Another writer has committed the version first; nothing of this commit is visible."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardSet:
    """A table of immutable Parquet shards under `root`, a folder that all executors share.

    manifest/v<N>.json names version N's shards and schema. It is written aside and renamed into
    place, which fails if version N exists: a reader sees a whole version or none, and of two
    writers one gets CommitConflict. That needs a file system whose rename is atomic and doesn't
    overwrite, such as HDFS or a local one; object stores have none. Files of a commit that failed
    are never named, so never read. A commit whose files are no longer all there fails. Rows, repeated ones and nulls among them, are kept as they are, in any schema; an empty
    table has shards without rows.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _list(self, name: str) -> list[tuple[str, int]]:
        at = self._path(name)
        fs = at.getFileSystem(self._conf)
        if not fs.exists(at):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(at) if not s.isDirectory())

    def versions(self) -> list[int]:
        return [int(name[1:9]) for name, _ in self._list("manifest") if name.startswith("v")]

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and shards of a version, the newest by default; an empty version 0."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        at = self._path(f"manifest/v{version:08d}.json")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, schema: T.StructType, shards: list[Shard], new: list[Shard] = ()) -> int:
        for s in new:
            at = self._path(s.path)
            if not at.getFileSystem(self._conf).exists(at):
                raise CommitConflict(f"{s.path} was removed before its commit")
        said = json.dumps({"version": version, "schema": schema.json(), "shards": [asdict(s) for s in shards]})
        aside, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{version:08d}.json")
        stream = aside.getFileSystem(self._conf).create(aside, False)
        stream.write(bytearray(said.encode()))
        stream.close()
        try:
            options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._hadoop.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, final, options)
        except Exception as e:
            aside.getFileSystem(self._conf).delete(aside, False)
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    def _write(self, df: DataFrame) -> list[Shard]:
        name = f"shards/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return self._files(name)

    def _files(self, name: str) -> list[Shard]:
        return [Shard(f"{name}/{file}", size) for file, size in self._list(name) if file.endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        """Adds df's rows as new shards, one for each of its partitions, and returns the version."""
        now = self.manifest()
        self._check(now, df.schema)
        new = self._write(df)
        return self._commit(now["version"] + 1, df.schema, [*(Shard(**s) for s in now["shards"]), *new], new)

    def append_each(self, df: DataFrame, batch: Column, n: int) -> int:
        """Adds df's rows as n batches, one version after the other, by one pass over df; `batch` is
        each row's, from 0. Returns the last version."""
        now = self.manifest()
        self._check(now, df.schema)
        name, version, held = f"shards/{uuid.uuid4().hex}", now["version"], [Shard(**s) for s in now["shards"]]
        df.withColumn("__batch", batch).write.partitionBy("__batch").parquet(f"{self.root}/{name}")
        for k in range(n):
            new = self._files(f"{name}/__batch={k}")
            held += new
            version = self._commit(version + 1, df.schema, held, new)
        return version

    def _check(self, now: dict, schema: T.StructType) -> None:
        if now["schema"] and T.StructType.fromJson(json.loads(now["schema"])).simpleString() != schema.simpleString():
            raise ValueError("the rows have another schema than the shards")

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fan_in)) + 1) if size >= SMALLEST else 0

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The runs to merge: shards of one tier, below half the target, fan_in of them at least."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
            if 2 * s.bytes < self.target_bytes:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fan_in]

    def compact(self) -> int:
        """Merges tier by tier until no run is left, each merge its own version; returns it.

        A merge reads its shards in about as many tasks as files come out of it, and shuffles
        nothing; a lost executor's tasks run again, and only finished files are committed.
        """
        while True:
            now = self.manifest()
            shards = [Shard(**s) for s in now["shards"]]
            runs = self.plan(shards)
            if not runs:
                return now["version"]
            schema, merged, gone = T.StructType.fromJson(json.loads(now["schema"])), [], set()
            for run in runs:
                files = max(1, round(sum(s.bytes for s in run) / self.target_bytes))
                rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in run))
                merged += self._write(rows.coalesce(files))
                gone |= {s.path for s in run}
            self._commit(now["version"] + 1, schema, [*(s for s in shards if s.path not in gone), *merged], merged)

    def vacuum(self, grace: float = GRACE) -> int:
        """Deletes the shards that the newest version doesn't name and the older manifests;
        returns how many files went. Files younger than `grace` seconds stay, as a writer may be
        about to commit them: 0 is for sets without other writers. Readers of older versions must
        have ended."""
        now = self.manifest()
        named, n, before = {s["path"] for s in now["shards"]}, 0, 1000 * (time.time() - grace)
        at = self._path("shards")
        fs = at.getFileSystem(self._conf)
        files = fs.listFiles(at, True) if fs.exists(at) else None
        while files is not None and files.hasNext():
            file = files.next()
            name = file.getPath().toString().rpartition("/shards/")[2]
            if f"shards/{name}" not in named and (not grace or file.getModificationTime() < before):
                n += bool(fs.delete(file.getPath(), False))
        for v in self.versions():
            if v < now["version"]:
                fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        return n

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """A version's rows; with shard_col each row's shard, its path under the root."""
        said = self.manifest(version)
        if not said["schema"]:
            raise ValueError("no version has been committed")
        schema = T.StructType.fromJson(json.loads(said["schema"]))
        if not said["shards"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in said["shards"]))
        if shard_col is None:
            return rows
        return rows.withColumn(shard_col, F.regexp_extract("_metadata.file_path", r"(shards/.+)$", 1))


def shard_documents(docs: DataFrame, root: str, arrivals: int = 3, id_col: str = "doc_id", target_bytes: int = TARGET_BYTES) -> ShardSet:
    """docs as a compacted ShardSet: `arrivals` batches, by a hash of the id (null: the last),
    each half as large as the one before, are appended by one pass; then the tiers are merged.
    Columns may have any names but __batch.

    No key decides where a row goes but its batch, and files are cut by size, so a hot source
    spreads like any other rows.
    """
    shards = ShardSet(docs.sparkSession, root, target_bytes)
    slot = F.coalesce(F.pmod(F.xxhash64(F.lit("arrival"), F.col(id_col)), F.lit(1 << arrivals)), F.lit(0))
    batch = F.when(slot < 2, F.lit(arrivals - 1)).otherwise(arrivals - 1 - F.floor(F.log2(slot + F.lit(0.5))).cast("int"))
    shards.append_each(docs, batch.cast("int"), arrivals)
    shards.compact()
    return shards
