"""A table as a journal: an append-only log of changes with what was there before, from which any version
is read and any change undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



class Journal:
    """Versions of a table under `root`, a folder that all executors share, by its `keys`.

    Version 0 is the table that the journal opens with. A commit writes one row a changed key, with the
    row before and after it (null: none), and nothing else; a whole table is written again only once
    the changes since the last one are as many rows as it has, so what is written is in proportion to
    what was changed. A version is the last whole table before it and the changes since. One writer.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.bases: list[tuple[int, int]] = []
        self.sizes: list[int] = [0]

    def open(self, df: DataFrame) -> None:
        """Begins with df. Its keys, null among them, tell its rows apart."""
        self.schema = df.schema
        self.values = [c for c in df.columns if c not in self.keys]
        self._base(df, 0)

    def _base(self, df: DataFrame, version: int) -> None:
        df.write.parquet(f"{self.root}/base/{version}")
        self.bases.append((version, self.spark.read.parquet(f"{self.root}/base/{version}").count()))

    @property
    def version(self) -> int:
        return len(self.sizes) - 1

    def _row(self, there: str):
        """A row of one of the tables, or null."""
        return F.when(F.col(there), F.struct(*self.schema.names))

    def _same(self, a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        """a and b joined by their keys, nulls with nulls; b's keys go."""
        b = b.withColumnsRenamed({k: f"__k{n}" for n, k in enumerate(self.keys)})
        on = None
        for n, k in enumerate(self.keys):
            one = F.col(k).eqNullSafe(F.col(f"__k{n}"))
            on = one if on is None else on & one
        return a.join(b, on, how).drop(*(f"__k{n}" for n in range(len(self.keys))))

    def _since(self, low: int, high: int) -> DataFrame:
        """Each key's last row among the changes after version `low` up to `high`."""
        kind = self.schema.simpleString()
        log = self.spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.schema if f.name in self.keys)}, before {kind}, after {kind}, version int")
        log = log.parquet(*(f"{self.root}/log/{v}" for v in range(low + 1, high + 1)))
        return log.groupBy(*self.keys).agg(F.max_by(F.struct("after"), "version").alias("__a"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        version = self.version if version is None else version
        if not 0 <= version <= self.version:
            raise ValueError(f"no version {version}")
        low = max(v for v, _ in self.bases if v <= version)
        base = self.spark.read.schema(self.schema).parquet(f"{self.root}/base/{low}")
        if low == version:
            return base
        changed = self._since(low, version)
        kept = self._same(base, changed.select(*self.keys), "left_anti")
        return kept.unionByName(changed.where("__a.after IS NOT NULL").select("__a.after.*"))

    def commit(self, puts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """A new version: rows put (those of a key there replace it; one row a key) and keys deleted, if
        they aren't put too. Keys that aren't there and rows that stay the same are no changes."""
        none = self.spark.createDataFrame([], self.schema)
        new = (none if puts is None else puts.select(self.schema.names)).withColumn("__put", F.lit(True))
        if deletes is not None:
            gone = self._same(deletes.select(*self.keys).distinct(), new.select(*self.keys), "left_anti")
            new = new.unionByName(gone.withColumn("__put", F.lit(False)), allowMissingColumns=True)
        now = self.read().withColumn("__held", F.lit(True))
        old = self._same(new.select(*self.keys), now.select(*self.keys, F.struct(*self.schema.names).alias("before")), "left")
        rows = self._same(new.withColumn("after", self._row("__put")), old, "inner")
        rows = rows.where(~F.col("before").eqNullSafe(F.col("after"))).select(*self.keys, "before", "after")
        return self._append(rows)

    def _append(self, rows: DataFrame) -> int:
        version = self.version + 1
        rows.withColumn("version", F.lit(version)).write.parquet(f"{self.root}/log/{version}")
        self.sizes.append(self.spark.read.parquet(f"{self.root}/log/{version}").count())
        low, n = self.bases[-1]
        if sum(self.sizes[low + 1 :]) > max(n, 1):
            self._base(self.read(), version)
        return version

    def undo(self, version: int | None = None) -> int:
        """A new version without what a version changed, the newest by default: its rows, before and after
        changed over. Raises if a later version changed one of its keys."""
        version = self.version if version is None else version
        if not 1 <= version <= self.version:
            raise ValueError(f"no change {version}")
        log = self.spark.read.parquet(f"{self.root}/log/{version}")
        if version < self.version and not self._same(log.select(*self.keys), self._since(version, self.version).select(*self.keys), "left_semi").isEmpty():
            raise ValueError(f"what version {version} changed was changed later")
        return self._append(log.select(*self.keys, F.col("after").alias("before"), F.col("before").alias("after")))

    def written(self) -> int:
        """Rows written so far, those of whole tables included."""
        return sum(self.sizes) + sum(n for _, n in self.bases)
