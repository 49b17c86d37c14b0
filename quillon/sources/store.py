"""A content-addressed store of units: equal texts are kept once, by their SHA-256; named manifests
list units in order; references are set by compare-and-set."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.plans.ordering import number_rows


#: Hexadecimal digits of a unit's hash that name its folder.
PREFIX = 2


class Conflict(RuntimeError):
    """A reference or transaction that isn't what it was when it was read."""


class UnitStore:
    """units/ has the texts by hash, in folders by its first digits, lists/ the manifests, refs/NAME/vN each reference's versions, of
    which refs/manifests/NAME say which list a manifest is.

    put() writes new units first and the manifest last, so a manifest never names a missing unit.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self, name: str = ""):
        at = self._hadoop.Path(f"{self.root}/{name}" if name else self.root)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, name: str) -> bool:
        fs, at = self._fs(name)
        return fs.exists(at)

    def _held(self, buckets: list[str] | None = None) -> DataFrame:
        """hash and data as written, of some buckets only; other buckets' files aren't opened. Two writers
        may have written one unit twice."""
        schema = "hash string, data string, bucket string"
        if not self._exists("units"):
            return self.spark.createDataFrame([], schema).drop("bucket")
        held = self.spark.read.schema(schema).parquet(f"{self.root}/units")
        return (held if buckets is None else held.where(F.col("bucket").isin(buckets))).drop("bucket")

    @staticmethod
    def _buckets(hashes: DataFrame) -> list[str]:
        """The buckets that the hashes fall in, 16 ** PREFIX of them at most."""
        return [r.b for r in hashes.select(F.substring("hash", 1, PREFIX).alias("b")).distinct().collect()]

    def units(self) -> DataFrame:
        """All units, each once: hash and data."""
        return self._held().dropDuplicates(["hash"])

    def put(self, name: str, units: DataFrame, data: str, order: list[str]) -> int:
        """Stores the units (column `data`) as manifest `name`; returns how many were new.

        Units lie in folders by the first digits of their hash, sorted by it within a file that has
        a Bloom filter of its hashes: what a put compares its units with is the hashes in the
        folders that they fall in. Two writers may add the same unit: readers take each hash once.
        A manifest is a new folder that its name is switched to last, by a rename that fails if the
        version exists, so readers see the old one or the new one.
        """
        rows = number_rows(units, order, "ord").select("ord", F.sha2(F.col(data).cast("binary"), 256).alias("hash"), F.col(data).alias("data"))
        new = rows.dropDuplicates(["hash"]).select("hash", "data").join(self._held(self._buckets(rows)).select("hash"), "hash", "left_anti")
        seen = Observation()
        new = new.withColumn("bucket", F.substring("hash", 1, PREFIX)).repartition("bucket").sortWithinPartitions("bucket", "hash")
        new.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("bucket").option("parquet.bloom.filter.enabled#hash", "true").mode("append").parquet(f"{self.root}/units")
        place = f"lists/{uuid.uuid4().hex}"
        rows.select("ord", "hash").write.parquet(f"{self.root}/{place}")
        while True:
            try:
                self.set_ref(f"manifests/{name}", place, self.ref(f"manifests/{name}")[0])
                return seen.get["n"]
            except Conflict:  # another writer was first: the later one stays
                continue

    def remove(self) -> None:
        """Removes the store and all it holds."""
        fs, at = self._fs()
        fs.delete(at, True)

    def get(self, name: str) -> DataFrame:
        """A manifest's units: ord, hash, data. A unit that isn't what its hash says raises."""
        place = self.ref(f"manifests/{name}")[1]
        if place is None:
            raise KeyError(name)
        listed = self.spark.read.parquet(f"{self.root}/{place}")
        held = self._held(self._buckets(listed)).join(listed.select("hash"), "hash", "left_semi").dropDuplicates(["hash"])
        rows = listed.join(held, "hash", "left")
        bad = F.col("data").isNull() | (F.sha2(F.col("data").cast("binary"), 256) != F.col("hash"))
        return rows.select("ord", "hash", F.when(bad, F.raise_error(F.concat(F.lit("damaged unit "), "hash"))).otherwise(F.col("data")).alias("data"))

    def size(self) -> int:
        return self.units().count()

    # -- references ------------------------------------------------------------------------

    def ref(self, name: str) -> tuple[int, str | None]:
        """The reference's version (0: unset) and value."""
        fs, at = self._fs(f"refs/{name}")
        versions = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        versions = [v for v in versions if v.startswith("v")]
        if not versions:
            return 0, None
        fs, at = self._fs(f"refs/{name}/{versions[-1]}")
        stream = fs.open(at)
        try:
            return int(versions[-1][1:]), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def set_ref(self, name: str, value: str, version: int) -> int:
        """Sets the reference if its version still is the given one; else Conflict."""
        if self.ref(name)[0] != version:
            raise Conflict(f"{name} has moved on from version {version}")
        fs, aside = self._fs(f"refs/{name}/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        _, final = self._fs(f"refs/{name}/v{version + 1:08d}")
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, options)
        except Exception as e:
            fs.delete(aside, False)
            raise Conflict(f"{name} has moved on from version {version}") from e
        return version + 1

    def transaction(self, name: str) -> Transaction:
        return Transaction(self, name)


class Transaction:
    """A value read from a reference, to be committed once if nobody else has set it since."""

    def __init__(self, store: UnitStore, name: str):
        self.store, self.name = store, name
        self.version, self.value = store.ref(name)
        self.spent = False

    def commit(self, value: str) -> int:
        if self.spent:
            raise Conflict("the transaction is spent")
        self.spent = True
        return self.store.set_ref(self.name, value, self.version)

    def abort(self) -> None:
        self.spent = True


def new_units(units: DataFrame, held: DataFrame, data: Column) -> DataFrame:
    """The distinct units whose hashes aren't held (column hash): hash and data."""
    rows = units.select(F.sha2(data.cast("binary"), 256).alias("hash"), data.alias("data")).dropDuplicates(["hash"])
    return rows.join(held.select("hash"), "hash", "left_anti")
