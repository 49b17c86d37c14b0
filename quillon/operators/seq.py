"""Ordered sequences of rows. Order is data: `order` names the sort keys (give a tie-breaker), and
nulls sort first. With `by` there is one sequence for each value of those columns; without it all
rows are one sequence, numbered over range partitions rather than in a single window. Where a value of
`by` may hold a large share of all rows, `skewed` numbers them that way too: no task then holds a
whole sequence for places, prefixes and runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.plans.ordering import ascending, number_rows, running_sum
from quillon.plans.tables import counted, materialise


#: Rows that a top-k over all rows may bring into one task.
TOP = 10_000
#: Rows that a scan folds at a time.
BLOCK = 128


@dataclass(frozen=True)
class Seq:
    df: DataFrame
    order: tuple[str, ...]
    by: tuple[str, ...] = ()
    skewed: bool = False

    # -- places ----------------------------------------------------------------------------

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*ascending(list(self.order)))

    def numbered(self, name: str = "rn") -> DataFrame:
        """The rows with their place, from 1."""
        if self.by and self.skewed:
            rows = number_rows(self.df, [*self.by, *self.order], "__g").drop("__part")
            rows = self._beside(rows, F.min("__g").alias("__first"))
            return rows.withColumn(name, F.col("__g") - F.col("__first") + 1).drop("__g", "__first")
        if self.by:
            return self.df.withColumn(name, F.row_number().over(self._window()).cast("bigint"))
        return number_rows(self.df, list(self.order), name).drop("__part")

    def _beside(self, rows: DataFrame, *aggregates: Column) -> DataFrame:
        """The rows with aggregates of their sequences, joined on `by`, nulls with nulls. The sums are
        dealt out anew, so that the join can split a large sequence's rows."""
        names = [f"__b{k}" for k in range(len(self.by))]
        sums = rows.groupBy(*(F.col(b).alias(n) for b, n in zip(self.by, names, strict=True))).agg(*aggregates)
        sums = sums.repartition(F.xxhash64(F.lit("beside"), *names))
        on = [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(self.by, names, strict=True)]
        return rows.join(sums, reduce(Column.__and__, on)).drop(*names)

    def _sized(self) -> DataFrame:
        """rn and the sequence's length __n."""
        rows = self.numbered()
        if self.by and self.skewed:
            return self._beside(rows, F.count("*").alias("__n"))
        if self.by:
            return rows.withColumn("__n", F.count("*").over(Window.partitionBy(*self.by)))
        return rows.join(F.broadcast(rows.agg(F.count("*").alias("__n"))))

    def _with(self, df: DataFrame) -> Seq:
        return replace(self, df=df)

    def _where(self, rows: DataFrame, keep: Column, *extra: str) -> Seq:
        return self._with(rows.where(keep).drop("rn", "__n", *extra))

    # -- position and limit ----------------------------------------------------------------

    def take(self, n: int) -> Seq:
        """The first n rows of each sequence; without `by` up to TOP of them by a top-k, more by place."""
        if not self.by and n <= TOP:
            return self._with(self.df.orderBy(*ascending(list(self.order))).limit(max(n, 0)))
        return self._where(self.numbered(), F.col("rn") <= n)

    def drop(self, n: int) -> Seq:
        return self._where(self.numbered(), F.col("rn") > n)

    def take_last(self, n: int) -> Seq:
        return self._where(self._sized(), F.col("rn") > F.col("__n") - n)

    def drop_last(self, n: int = 1) -> Seq:
        return self._where(self._sized(), F.col("rn") <= F.col("__n") - n)

    def first(self) -> Seq:
        return self.take(1)

    def second(self) -> Seq:
        return self.nth(1)

    def rest(self) -> Seq:
        return self.drop(1)

    def last(self) -> Seq:
        return self.take_last(1)

    def butlast(self) -> Seq:
        return self.drop_last(1)

    def nth(self, n: int) -> Seq:
        """The row at place n, from 0."""
        return self._where(self.numbered(), F.col("rn") == n + 1)

    def take_nth(self, n: int) -> Seq:
        return self._where(self.numbered(), F.pmod(F.col("rn") - 1, F.lit(n)) == 0)

    def nth_rest(self, n: int) -> Seq:
        return self.drop(n)

    def rand_nth(self, seed: int) -> Seq:
        """One row of each sequence, each with the same chance, by a hash of seed and place."""
        return self.min_key(F.xxhash64(F.lit(seed), *self.order))

    def split_at(self, n: int) -> tuple[Seq, Seq]:
        return self.take(n), self.drop(n)

    def reverse(self) -> DataFrame:
        return self.df.orderBy(*(F.col(o).desc_nulls_last() for o in (*self.by, *self.order)))

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*ascending([*self.by, *self.order]))

    def sort_by(self, *keys: str) -> Seq:
        """The rows in the order of the keys, then of their old places."""
        return replace(self, order=(*keys, *(o for o in self.order if o not in keys)))

    def subvec(self, start: int, end: int) -> Seq:
        return self._where(self.numbered(), F.col("rn").between(start + 1, end))

    def shuffle(self, seed: int) -> DataFrame:
        return self.df.orderBy(F.rand(seed))

    def random_sample(self, chance: float, seed: int) -> DataFrame:
        return self.df.sample(False, chance, seed)

    def bounded_count(self, n: int) -> int:
        return self.df.limit(n).count()

    # -- predicates over prefixes ----------------------------------------------------------

    def _first_failure(self, pred: Column) -> DataFrame:
        """rn and __stop, the place of the first row whose predicate is null or false."""
        bad = F.when(F.coalesce(pred, F.lit(False)), F.lit(None)).otherwise(F.col("rn"))
        rows = self.numbered()
        if self.by and self.skewed:
            return self._beside(rows, F.min(bad).alias("__stop"))
        if self.by:
            return rows.withColumn("__stop", F.min(bad).over(Window.partitionBy(*self.by)))
        return rows.join(F.broadcast(rows.agg(F.min(bad).alias("__stop"))))

    def take_while(self, pred: Column) -> Seq:
        return self._where(self._first_failure(pred), F.col("__stop").isNull() | (F.col("rn") < F.col("__stop")), "__stop")

    def drop_while(self, pred: Column) -> Seq:
        return self._where(self._first_failure(pred), F.col("rn") >= F.col("__stop"), "__stop")

    def split_with(self, pred: Column) -> tuple[Seq, Seq]:
        return self.take_while(pred), self.drop_while(pred)

    def filter(self, pred: Column) -> Seq:
        return self._with(self.df.where(F.coalesce(pred, F.lit(False))))

    def remove(self, pred: Column) -> Seq:
        """The rows whose predicate is null or false."""
        return self._with(self.df.where(~F.coalesce(pred, F.lit(False))))

    def some(self, value: Column, name: str = "some") -> DataFrame:
        """The first value that is neither null nor false, of each sequence; null if none is."""
        rows = self.numbered().withColumn(name, value)
        good = F.col(name).isNotNull() & (F.col(name) if dict(rows.dtypes)[name] == "boolean" else F.lit(True))
        return rows.groupBy(*self.by).agg(F.min_by(F.when(good, F.col(name)), F.when(good, F.col("rn"))).alias(name))

    def not_every(self, pred: Column, name: str = "not_every") -> DataFrame:
        return self.every(pred, name).withColumn(name, ~F.col(name))

    def every(self, pred: Column, name: str = "every") -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.coalesce(F.bool_and(F.coalesce(pred, F.lit(False))), F.lit(True)).alias(name))

    # -- frames ----------------------------------------------------------------------------

    def partition(self, n: int, value: Column, step: int | None = None, pad: Column | None = None, whole: bool = True, name: str = "items") -> DataFrame:
        """Count windows: each n values (an array) at every step-th place. Short tails go, unless
        `whole` is false (they stay) or `pad` (an array) completes the first of them, as far as
        it reaches, in which case that one stays and later ones go."""
        step = step or n
        rows = self.numbered().withColumn("__v", value)
        spread = -(-n // step)
        rows = rows.withColumn("__w", F.explode(F.expr(f"filter(transform(sequence(0, {spread - 1}), k -> (rn - 1) div {step} - k), w -> w >= 0 AND rn - 1 - w * {step} < {n})")))
        out = rows.groupBy(*self.by, "__w").agg(F.array_sort(F.collect_list(F.struct("rn", "__v"))).alias("__l"), F.min("rn").alias("__first"))
        out = out.where(F.col("__first") == F.col("__w") * step + 1).withColumn(name, F.col("__l.__v"))
        if pad is not None:
            # A short window ends with its sequence, so its size tells whether the one before is whole.
            out = out.where((F.size(name) >= n - step) | (F.col("__w") == 0))
            out = out.withColumn(name, F.slice(F.concat(name, pad), 1, n))
        elif whole:
            out = out.where(F.size(name) == n)
        return out.select(*self.by, F.col("__w").alias("window"), name)

    def partition_all(self, n: int, value: Column, step: int | None = None, name: str = "items") -> DataFrame:
        return self.partition(n, value, step, whole=False, name=name)

    def _changes(self, key: Column) -> DataFrame:
        """The rows with __change: 1 where a run of equal keys begins (null equals null), else 0; where
        rows are numbered over range partitions, with rn and __part."""
        if self.by and not self.skewed:
            here = F.struct(key.alias("k"))
            return self.df.withColumn("__change", F.when(F.lag(here).over(self._window()).eqNullSafe(here), 0).otherwise(1))
        rows = number_rows(self.df, [*self.by, *self.order]).withColumn("__k", F.struct(*self.by, key.alias("__key")))
        before = rows.select((F.col("rn") + 1).alias("rn"), F.col("__k").alias("__before"))
        return rows.join(before, "rn", "left").withColumn("__change", F.when(F.col("__before").eqNullSafe(F.col("__k")), 0).otherwise(1)).drop("__before", "__k")

    def runs(self, key: Column, name: str = "run") -> DataFrame:
        """The rows with the number, from 1, of the run of equal keys (null equals null)."""
        rows = self._changes(key)
        if self.by and not self.skewed:
            return rows.withColumn(name, F.sum("__change").over(self._window().rowsBetween(Window.unboundedPreceding, 0))).drop("__change")
        if not self.by:
            return running_sum(rows, F.col("__change"), name).drop("__change", "__part", "rn")
        rows = running_sum(rows, F.col("__change"), "__run").drop("__change", "__part", "rn")
        rows = self._beside(rows, F.min("__run").alias("__first"))
        return rows.withColumn(name, F.col("__run") - F.col("__first") + 1).drop("__run", "__first")

    def partition_by(self, key: Column, value: Column, name: str = "items") -> DataFrame:
        """Each run of equal keys as one row: run, key and the values in order."""
        rows = self.runs(key).withColumn("__o", F.struct(*self.order)).withColumn("__v", value).withColumn("key", key)
        out = rows.groupBy(*self.by, "run").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("__o", "__v"))).alias("__l"))
        return out.withColumn(name, F.col("__l.__v")).drop("__l")

    def dedupe(self, key: Column) -> Seq:
        """The first row of each run of equal keys."""
        return self._with(self._changes(key).where("__change = 1").drop("__change", "__part", "rn"))

    def scan(self, combine: Callable[[Column, Column], Column], value: Column, name: str = "scan") -> DataFrame:
        """The rows with the fold of all values up to theirs by an associative function of two values,
        which need not commute: running maxima, texts, compositions of maps.

        Rows are numbered over range partitions and folded BLOCK at a time; the blocks' totals are
        scanned the same way until one block holds them, and each block then takes in what comes
        before it. With `by` the fold begins anew with each sequence; none of them is held by one
        task, however long.
        """
        columns = self.df.columns
        rows = number_rows(self.df.withColumn("__v", value), [*self.by, *self.order], "__rn").drop("__part")
        start = F.col("__rn") == 1
        if self.by:
            rows = self._beside(rows, F.min("__rn").alias("__first"))
            start = F.col("__rn") == F.col("__first")
        rows = rows.withColumn("__s", start).drop("__first")
        done = _scanned(materialise(rows, "scan"), combine, columns)
        return done.select(*columns, F.col("__v").alias(name))

    def reductions(self, fold: Callable[[Column], Column], value: Column, name: str = "reduction") -> DataFrame:
        """Running folds by an aggregate function such as F.sum, F.min or F.max. Needs `by`."""
        if not self.by:
            if fold is not F.sum:
                raise ValueError("without `by` only sums run over range partitions")
            return running_sum(number_rows(self.df, list(self.order)), value, name).drop("__part", "rn")
        return self.df.withColumn(name, fold(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0)))

    def reduce(self, initial: Column, step: Callable[[Column, Column], Column], value: Column, name: str = "reduced") -> DataFrame:
        """An ordered fold by any function of accumulator and value; a sequence is one array, so
        use an aggregate function instead where the fold is one."""
        listed = self.df.groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct(*self.order, value.alias("__v")))).alias("__l"))
        return listed.select(*self.by, F.aggregate(F.col("__l"), initial, lambda a, x: step(a, x["__v"])).alias(name))

    def map_indexed(self, f: Callable[[Column, Column], Column], value: Column, name: str = "mapped") -> DataFrame:
        """f(place from 0, value) of each row."""
        return self.numbered().withColumn(name, f(F.col("rn") - 1, value)).drop("rn")

    def keep(self, value: Column, name: str = "kept") -> DataFrame:
        """The values that aren't null (false stays)."""
        return self.df.withColumn(name, value).where(F.col(name).isNotNull())

    def keep_indexed(self, f: Callable[[Column, Column], Column], value: Column, name: str = "kept") -> DataFrame:
        return self.map_indexed(f, value, name).where(F.col(name).isNotNull())

    def interleave(self, *others: Seq) -> DataFrame:
        """The first rows of all, then the second ones, up to the shortest; __seq and __place tell
        where a row comes from. Sequences without `by`, of the same columns."""
        every = [self, *others]
        shortest = min(s.df.count() for s in every)
        parts = [s.numbered("__place").where(F.col("__place") <= shortest).withColumn("__seq", F.lit(k)) for k, s in enumerate(every)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.orderBy("__place", "__seq")

    def interpose(self, value: Column, separator: Column, name: str = "items") -> DataFrame:
        """The values of each sequence as an array, with the separator between them."""
        listed = self.df.groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct(*self.order, value.alias("__v")))).alias("__l"))
        items = F.flatten(F.transform(F.col("__l.__v"), lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(separator, x))))
        return listed.select(*self.by, items.alias(name))

    def zip(self, *others: Seq) -> DataFrame:
        """Rows at the same places side by side, up to the shortest."""
        out = self.numbered()
        for s in others:
            names = {b: f"__z{k}" for k, b in enumerate(self.by)}
            other = s.numbered("__rn").withColumnsRenamed(names)
            on = [F.col(b).eqNullSafe(F.col(n)) for b, n in names.items()]
            out = out.join(other, reduce(Column.__and__, on, F.col("rn") == F.col("__rn"))).drop("__rn", *names.values())
        return out.drop("rn")

    def concat(self, *others: Seq) -> Seq:
        """All rows, those of self first: __seq sorts before the order."""
        parts = [s.df.withColumn("__seq", F.lit(k)) for k, s in enumerate([self, *others])]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return replace(self, df=out, order=("__seq", *self.order))

    # -- groups ----------------------------------------------------------------------------

    def distinct(self, *keys: str) -> Seq:
        """The first row of each value of the keys; null is a value. Rows of a value meet after each task
        has picked its own first."""
        row = F.min_by(F.struct(*self.df.columns), F.struct(*self.order)).alias("__r")
        return self._with(self.df.groupBy(*dict.fromkeys((*self.by, *keys))).agg(row).select("__r.*"))

    def group_by(self, key: Column, value: Column, name: str = "items") -> DataFrame:
        """One row for each key (null is one), with its values in order: an array, so grouped() where a
        key may have very many."""
        out = self.df.groupBy(*self.by, key.alias("key")).agg(F.array_sort(F.collect_list(F.struct(*self.order, value.alias("__v")))).alias("__l"))
        return out.select(*self.by, "key", F.col("__l.__v").alias(name))

    def grouped(self, key: Column, value: Column, name: str = "item") -> DataFrame:
        """group_by() in rows, for groups of any size: key, place (from 1 in its group) and the value."""
        rows = self.df.select("*", key.alias("key"), value.alias(name))
        return Seq(rows, self.order, (*self.by, "key"), True).numbered("place").select(*self.by, "key", "place", name)

    def frequencies(self, key: Column) -> DataFrame:
        return self.df.groupBy(*self.by, key.alias("key")).agg(F.count("*").alias("n"))

    def max_key(self, key: Column) -> Seq:
        """The row of the greatest key; of equal ones the last."""
        return self._pick(key, True)

    def min_key(self, key: Column) -> Seq:
        """The row of the least key; of equal ones the last."""
        return self._pick(key, False)

    def _pick(self, key: Column, greatest: bool) -> Seq:
        """The last row of the greatest or least key that isn't null, by aggregates: of the key, then
        of the place among rows that have it."""
        columns = self.df.columns
        rank = F.struct(key.isNotNull().alias("held"), key.alias("key")) if greatest else F.struct(key.isNull().alias("held"), key.alias("key"))
        rows = self.df.withColumn("__key", rank)
        best = (F.max if greatest else F.min)("__key").alias("__best")
        if self.by:
            rows = self._beside(rows, best)
        else:
            rows = rows.join(F.broadcast(rows.agg(best)))
        last = F.max_by(F.struct(*columns), F.struct(*self.order)).alias("__r")
        found = rows.where(F.col("__key").eqNullSafe(F.col("__best"))).groupBy(*self.by).agg(last).where("__r IS NOT NULL")
        return self._with(found.select("__r.*"))


def _scanned(rows: DataFrame, combine: Callable[[Column, Column], Column], keep: list[str]) -> DataFrame:
    """rows (__rn from 1, __s: a sequence begins, __v) with __v folded from the last beginning on."""
    kind = rows.schema["__v"].dataType.simpleString()

    def joined(first: Column, second: Column) -> Column:
        """Of two rows' (s, v), those of what stands from the first to the second."""
        value = F.when(second["s"], second["v"]).otherwise(combine(first["v"], second["v"]))
        return F.struct((first["s"] | second["s"]).alias("s"), value.cast(kind).alias("v"))

    row = F.struct(F.col("__rn").alias("rn"), F.struct(F.col("__s").alias("s"), F.col("__v").alias("v")).alias("x"), F.struct(*(keep or ["__rn"])).alias("row"))
    blocks = rows.groupBy(F.expr(f"(__rn - 1) div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["rn"] < b["rn"], -1).otherwise(1)).alias("l"))
    pair = f"struct<s:boolean,v:{kind}>"
    step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x["x"]).otherwise(joined(F.element_at(acc, -1), x["x"])).cast(pair)))
    blocks = blocks.withColumn("x", F.aggregate("l", F.array().cast(f"array<{pair}>"), step))
    blocks, n = counted(blocks, "blocks")
    if n > 1:
        totals = blocks.select((F.col("block") + 2).alias("__rn"), F.element_at("x", -1).alias("t"))  # a block's total is for the next one
        before = _scanned(materialise(totals.select((F.col("__rn") - 1).alias("__rn"), F.col("t.s").alias("__s"), F.col("t.v").alias("__v")), "scan"), combine, [])
        blocks = blocks.join(before.select(F.col("__rn").alias("block"), F.struct(F.lit(True).alias("s"), F.col("__v").alias("v")).alias("b")), "block", "left")
        blocks = blocks.withColumn("x", F.when(F.col("b").isNull(), F.col("x")).otherwise(F.transform("x", lambda x: joined(F.col("b"), x).cast(pair))))
    out = blocks.select(F.explode(F.arrays_zip("l", "x")).alias("z"))
    return out.select(F.col("z.l.rn").alias("__rn"), *(F.col(f"z.l.row.{c}").alias(c) for c in keep), F.col("z.x.v").alias("__v"))


def merge_with(agg: Callable[[Column], Column], *maps: DataFrame) -> DataFrame:
    """Frames of (key, value) merged, values of a shared key combined by an aggregate function."""
    out = maps[0].select("key", "value")
    for m in maps[1:]:
        out = out.unionByName(m.select("key", "value"))
    return out.groupBy("key").agg(agg(F.col("value")).alias("value"))


def merge(*maps: DataFrame) -> DataFrame:
    """Frames of (key, value) merged; the last frame that has a key wins, nulls included."""
    out = None
    for k, m in enumerate(maps):
        part = m.select("key", "value", F.lit(k).alias("__k"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("key").agg(F.max_by(F.struct("value"), "__k").alias("v")).select("key", F.col("v.value").alias("value"))


def tree_seq(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", order: str = "ord", max_depth: int = 1_000) -> DataFrame:
    """All nodes below the roots (column id), depth first: id, depth and path, the places on the
    way down, which sort in that order."""
    level = roots.select("id", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path"))
    steps = edges.select(F.col(parent).alias("__p"), F.col(child).alias("__c"), F.col(order).cast("bigint").alias("__o"))
    out = level
    for _ in range(max_depth):
        level, n = counted(level.join(steps, F.col("id") == F.col("__p")).select(F.col("__c").alias("id"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("__o")).alias("path")), "level")
        if not n:
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {max_depth}: are the edges a tree?")


def iterate(spark, f: Callable[[Column], Column], first: Column, n: int) -> DataFrame:
    """place and value of first, f(first), f(f(first)) ...: n rows."""
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(max(n, 1) - 1)) if n > 1 else F.array().cast("array<int>"), F.array(first), lambda acc, _: F.array_append(acc, f(F.element_at(acc, -1))))
    return spark.range(1).select(F.posexplode(folded).alias("place", "value")).limit(n)


def repeat(spark, n: int, value: Column) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("place"), value.alias("value"))


def range_(spark, start: int, end: int, step: int = 1) -> DataFrame:
    return spark.range(start, end, step).withColumnRenamed("id", "value")


def cycle(df: DataFrame, order: list[str], times: int) -> DataFrame:
    """The rows repeated: __round, then the order, sorts them."""
    return df.withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(times))))
