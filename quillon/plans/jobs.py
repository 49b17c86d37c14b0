"""Ordered jobs with a snapshot at every boundary, checked link by link in parallel."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Phase:
    name: str
    steps: tuple[Step, ...]


@dataclass(frozen=True)
class Link:
    """What a check found of one phase: rows that only its new run, or only its snapshot, has."""

    phase: str
    extra: int
    missing: int
    error: str | None = None

    @property
    def ok(self) -> bool:
        return not self.error and not self.extra and not self.missing


#: Buckets of rows whose digests a comparison of two tables shuffles; rows of equal ones stay where they are.
BUCKETS = 4096


def _hashed(df: DataFrame) -> DataFrame:
    """df with __h and __i, two 64-bit hashes of the whole row, nulls and where they stand included."""
    said = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):  # hashes pass over nulls within
            options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
            said.append(F.to_json(F.struct(column.alias("v")), options))
        else:
            said += [column, column.isNull()]
    return df.withColumns({"__h": F.xxhash64(F.lit(1), *said), "__i": F.xxhash64(F.lit(2), *said)})


def digests(df: DataFrame) -> DataFrame:
    """bucket, n and two sums of the hashes of its rows: equal for equal multisets of rows. A task sends a
    row a bucket."""
    sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("__h", "__i")]
    return _hashed(df).groupBy(F.pmod("__h", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), *sums)


def differences(new: DataFrame, old: DataFrame) -> tuple[int, int]:
    """Rows of `new` that `old` lacks, and the other way round, as multisets. Digests of buckets of rows are
    compared first; only rows of buckets that differ are shuffled and compared themselves."""
    old = old.select(new.columns)
    both = digests(new).join(digests(old).withColumnsRenamed({"n": "m", "__h": "h", "__i": "i"}), "bucket", "full")
    same = F.col("n").eqNullSafe(F.col("m")) & F.col("__h").eqNullSafe(F.col("h")) & F.col("__i").eqNullSafe(F.col("i"))
    unlike = [r.bucket for r in both.where(~same).select("bucket").collect()]  # BUCKETS at most
    if not unlike:
        return 0, 0
    a, b = (_hashed(x).where(F.pmod("__h", F.lit(BUCKETS)).isin(unlike)).select(new.columns) for x in (new, old))
    return a.exceptAll(b).count(), b.exceptAll(a).count()


class Plan:
    """Phases over one table; boundary 0 is the seed, boundary k what phase k left."""

    def __init__(self, spark: SparkSession, root: str, phases: list[Phase]):
        self.spark, self.root, self.phases = spark, root.rstrip("/"), phases
        if len({p.name for p in phases}) != len(phases):
            raise ValueError("two phases have the same name")

    def _path(self, k: int) -> str:
        return f"{self.root}/{k:03d}-{self.phases[k - 1].name if k else 'seed'}"

    def snapshot(self, k: int) -> DataFrame:
        return self.spark.read.parquet(self._path(k))

    def seed(self, df: DataFrame, normalise: Step | None = None) -> None:
        (normalise(df) if normalise else df).write.mode("overwrite").parquet(self._path(0))

    def run_phase(self, k: int, df: DataFrame) -> DataFrame:
        for step in self.phases[k - 1].steps:
            df = step(df)
        return df

    def run(self, first: int = 1, last: int | None = None, keep_going: bool = False) -> list[str]:
        """Runs phases first to last, each from the snapshot before it; returns the errors, which
        raise unless keep_going (a failed phase then passes its input on)."""
        errors = []
        for k in range(first, (last or len(self.phases)) + 1):
            try:
                self.run_phase(k, self.snapshot(k - 1)).write.mode("overwrite").parquet(self._path(k))
            except Exception as e:
                if not keep_going:
                    raise
                errors.append(f"{self.phases[k - 1].name}: {str(e).splitlines()[0]}")
                self.snapshot(k - 1).write.mode("overwrite").parquet(self._path(k))
        return errors

    def advance(self, k: int) -> DataFrame:
        """Phase k from the snapshot before it, not written."""
        return self.run_phase(k, self.snapshot(k - 1))

    def check(self, threads: int = 4) -> list[Link]:
        """Runs every link again from its snapshot, several at a time, and compares it with the
        next snapshot as multisets of rows, by differences(); in the phases' order."""

        def one(k: int) -> Link:
            name = self.phases[k - 1].name
            try:
                new, old = self.advance(k), self.snapshot(k)
                return Link(name, *differences(new, old))
            except Exception as e:
                return Link(name, 0, 0, str(e).splitlines()[0])

        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(one, range(1, len(self.phases) + 1)))

    def control(self, k: int, spoil: Step) -> bool:
        """Whether check() would see a change planted in phase k's result, as it must."""
        new, old = spoil(self.advance(k)), self.snapshot(k)
        return differences(new, old) != (0, 0)

    def changes(self, key: list[str]) -> DataFrame:
        """phase, added, removed and changed: how many keys each phase changed."""
        out = None
        for k in range(1, len(self.phases) + 1):
            a = self.snapshot(k - 1)
            b = self.snapshot(k)
            # Structs, so that null values and null keys compare as values.
            names = sorted(a.columns)
            ha = a.select(F.struct(*key).alias("__key"), F.struct(*names).alias("__a"))
            hb = b.select(F.struct(*key).alias("__kb"), F.struct(*sorted(b.columns)).alias("__b"))
            both = ha.join(hb, F.col("__key").eqNullSafe(F.col("__kb")), "full")
            changed = ~F.col("__a").eqNullSafe(F.col("__b")) if names == sorted(b.columns) else F.lit(True)
            held = F.col("__a").isNotNull() & F.col("__b").isNotNull()
            row = both.agg(F.count_if(F.col("__a").isNull()).alias("added"), F.count_if(F.col("__b").isNull()).alias("removed"), F.count_if(held & changed).alias("changed")).select(F.lit(k).alias("k"), F.lit(self.phases[k - 1].name).alias("phase"), "added", "removed", "changed")
            out = row if out is None else out.unionByName(row)
        return out
