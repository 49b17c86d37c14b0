"""Trees by ranges: a node's subtree is the nodes whose rank lies from its own to rank + size - 1.

Ranks are places in preorder, with room left between the trees where that is asked for, so that an edit
of some trees leaves the others' ranks alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.plans.ordering import ascending, number_rows, running_sum
from quillon.plans.tables import counted, materialise, new_path

#: Ranges meet points in buckets of 2^shift ranks, by the least shift that holds the range; the longest
#: ranges cover several buckets, so that no bucket holds more ranks than the last of these says.
SHIFTS = (4, 8, 12, 16)
#: Rounds of joins after which what there is becomes a table.
ROUNDS = 8


def _shift(size: Column) -> Column:
    out = F.lit(SHIFTS[-1])
    for s in reversed(SHIFTS[:-1]):
        out = F.when(size <= (1 << s), F.lit(s)).otherwise(out)
    return out


def within(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of `ranges` (lo and hi, both in it) and of `points` (rank) where the rank lies in the range:
    an equality join on buckets, then the range itself. Points go to buckets of the sizes that ranges
    have; ranges are read twice, so give a table."""
    shifts = sorted(r[0] for r in ranges.select(_shift(F.col("hi") - F.col("lo") + 1)).distinct().collect()) or [SHIFTS[0]]
    wide = ranges.withColumn("__shift", _shift(F.col("hi") - F.col("lo") + 1))
    wide = wide.withColumn("__bucket", F.explode(F.expr("sequence(shiftright(lo, __shift), shiftright(hi, __shift))")))
    near = points.withColumn("__shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("__bucket", F.expr("shiftright(rank, __shift)"))
    return wide.join(near, ["__shift", "__bucket"]).where("rank BETWEEN lo AND hi").drop("__shift", "__bucket", "lo", "hi")


def below(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """anc and id of each of the tops (column id) and every node under it, the top itself left out."""
    ranges = nodes.join(tops.select("id").distinct(), "id", "left_semi").where("size > 1")
    ranges = ranges.select(F.col("id").alias("anc"), (F.col("rank") + 1).alias("lo"), (F.col("rank") + F.col("size") - 1).alias("hi"))
    ranges = materialise(ranges, "ranges")
    return within(ranges, nodes.select("id", "rank")).select("anc", "id")


def around(nodes: DataFrame, points: DataFrame, keep: list[str]) -> DataFrame:
    """Each of the points (id and rank) with every node at or above it: the point's id, and of that node
    the columns named by `keep` with `node_` before them."""
    ranges = nodes.select(*(F.col(c).alias(f"node_{c}") for c in keep), F.col("rank").alias("lo"), (F.col("rank") + F.col("size") - 1).alias("hi"))
    return within(ranges, points.select("id", "rank")).drop("rank")


def tree_levels(flat: DataFrame, max_depth: int) -> list[DataFrame]:
    """The nodes by depth, with depth, root_id, top_id and stmt_id (the nearest node at or above it that
    __h and __s hold for). One join a level."""
    level = flat.where("parent_id IS NULL").withColumns({"depth": F.lit(0), "root_id": F.col("id"), "top_id": F.when(F.col("__h"), F.col("id")), "stmt_id": F.when(F.col("__s"), F.col("id"))})
    out, every = [materialise(level, "level")], flat.count()
    met = out[0].count()
    inner = flat.where("parent_id IS NOT NULL")
    for _ in range(max_depth):
        if met == every:  # else some are under what isn't held, or on cycles; a last round finds none
            return out
        above = out[-1].select(F.col("id").alias("parent_id"), F.col("depth").alias("__d"), "root_id", F.col("top_id").alias("__top"), F.col("stmt_id").alias("__stmt"))
        kids = inner.join(above, "parent_id").withColumns({"depth": F.col("__d") + 1, "top_id": F.when(F.col("__h"), F.col("id")).otherwise(F.col("__top")), "stmt_id": F.when(F.col("__s"), F.col("id")).otherwise(F.col("__stmt"))})
        level, n = counted(kids.select(out[0].columns), "level")
        if not n:
            return out
        out.append(level)
        met += level.count()
    raise ValueError(f"deeper than {max_depth}: is the containment a tree?")


def _sizes(levels: list[DataFrame]) -> DataFrame:
    """id and size of the subtrees with more than one node, level by level from the leaves."""
    out = under = None
    for k, level in enumerate(reversed(levels[1:])):
        here = level.select("id", "parent_id") if under is None else level.select("id", "parent_id").join(under, "id", "left")
        size = F.lit(1).cast("bigint") if under is None else F.coalesce("size", F.lit(1).cast("bigint"))
        under = here.groupBy(F.col("parent_id").alias("id")).agg((F.sum(size) + 1).alias("size"))
        under = materialise(under, "sizes") if k % ROUNDS == ROUNDS - 1 else under
        out = under if out is None else out.unionByName(under)
    return levels[0].select("id", F.lit(1).cast("bigint").alias("size")).limit(0) if out is None else out


def places(kids: DataFrame, value: Column, name: str) -> DataFrame:
    """kids (id, parent_id, ord) with the sum of `value` over the earlier kids of the same parent, by ord
    and id: a running sum along ranges of all rows, less what it was where the parent's begin. No window
    holds a parent's kids; they are shuffled once. A row a partition says what a parent that goes on from
    the one before had."""
    order = ascending(["parent_id", "ord", "id"])
    rows = kids.withColumn("__v", value.cast("bigint")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("__before", "__first", "__group", "__part"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, first, group, last = TaskContext.get().partitionId(), 0, 0, 0, None
        for batch in batches:
            n, parents = batch.num_rows, batch.column("parent_id")
            if not n:
                continue
            v = batch.column("__v").to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.empty(n, bool)
            new[0] = not group or parents[0].as_py() != last
            new[1:] = pc.not_equal(parents.slice(1), parents.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            before = total + np.cumsum(v) - v
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            firsts, groups = np.where(at < 0, first, before[at]), group + np.cumsum(new)
            more = [pa.array(x, pa.int64()) for x in (before, firsts, groups, np.full(n, part))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)
            total, first, group, last = int(before[-1] + v[-1]), int(firsts[-1]), int(groups[-1]), parents[n - 1].as_py()

    held = materialise(rows.mapInArrow(run, schema), "ordered")
    parts = held.groupBy("__part").agg(F.max("__group").alias("n"), F.min("parent_id").alias("low"), F.max("parent_id").alias("high"), F.max(F.struct("__group", "__first"))["__first"].alias("first"), F.sum("__v").alias("total"))
    offsets, offset, begun, last = [], 0, 0, None
    for p in sorted(parts.collect(), key=lambda p: p["__part"]):
        goes_on = bool(offsets) and p.low == last
        offsets.append((p["__part"], offset, begun if goes_on else offset))
        begun = begun if goes_on and p.n == 1 else offset + p.first
        offset, last = offset + p.total, p.high
    at = kids.sparkSession.createDataFrame(offsets, "__part bigint, __offset bigint, __begun bigint")
    first = F.when(F.col("__group") == 1, F.col("__begun")).otherwise(F.col("__offset") + F.col("__first"))
    out = held.join(F.broadcast(at), "__part").withColumn("__sum", F.col("__offset") + F.col("__before") - first)
    return out.select(*kids.columns, F.col("__sum").alias(name))


def ranks(levels: list[DataFrame], starts: DataFrame | None = None, slack: float = 0.0) -> DataFrame:
    """id, rank and size of every node, and `room`, the ranks that a root's tree may take: those of its
    size and `slack` times that. With starts (id, rank, room) the roots keep what they have."""
    size = F.coalesce("size", F.lit(1).cast("bigint"))
    sizes = materialise(_sizes(levels), "sizes")
    roots = levels[0].select("id", "ord").join(sizes, "id", "left").withColumn("size", size)
    if starts is None:
        roots = roots.withColumn("room", F.ceil(F.col("size") * (1 + slack)))
        roots = running_sum(number_rows(roots, ["ord", "id"], "__rn"), F.col("room"), "__sum", "__rn")
        roots = roots.withColumn("rank", F.col("__sum") - F.col("room") + 1)
    else:
        roots = roots.join(starts, "id")
    now = materialise(roots.select("id", "rank", "size", "room"), "ranks")
    out = now
    if len(levels) == 1:
        return out
    kids = levels[1].select("id", "parent_id", "ord", "depth")
    for level in levels[2:]:
        kids = kids.unionByName(level.select("id", "parent_id", "ord", "depth"))
    held = places(kids.join(sizes, "id", "left").withColumn("size", size), F.col("size"), "__before").select("id", "parent_id", "size", "__before", "depth")
    if len(levels) > ROUNDS:  # a level is read alone then
        path = new_path(levels[0].sparkSession, "places")
        held.write.partitionBy("depth").parquet(path)
        held = levels[0].sparkSession.read.schema(held.schema).parquet(path)
    for d in range(1, len(levels)):
        above = now.select(F.col("id").alias("parent_id"), F.col("rank").alias("__r"))
        now = held.where(F.col("depth") == d).join(above, "parent_id").select("id", (F.col("__r") + 1 + F.col("__before")).alias("rank"), "size", F.lit(None).cast("bigint").alias("room"))
        now = materialise(now, "ranks") if d % ROUNDS == 0 else now
        out = out.unionByName(now)
    return out
