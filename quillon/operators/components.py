"""Strongly connected components, and content hashes over their condensation.

A node's hash says what it says and what it names: its head and atom, the hashes of its kids by their
places, and those of its edges' targets by kind. Where that closes a cycle, the component is hashed as
one unit: members are told apart by colour refinement, and a member's hash is its colour and the digest
of all colours of its component. Ids and the order of rows decide nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.tables import counted, materialise

from .ranges import ROUNDS, places

#: Hops that one round of colouring takes at most, and how many times the edges those may be, about.
HOPS, GROWTH = 8, 32


def several_hops(edges: DataFrame) -> DataFrame:
    """The edges (src, dst), and where nodes have few also those of up to HOPS hops, as a table."""
    steps, n = counted(edges.select("src", "dst").distinct(), "steps")
    hops, least = 1, n
    while hops < HOPS and 0 < n <= GROWTH * least // 4:
        further = steps.join(steps.select(F.col("src").alias("dst"), F.col("dst").alias("__d")), "dst").select("src", F.col("__d").alias("dst"))
        steps, n = counted(steps.unionByName(further).distinct(), "steps")
        hops *= 2
    return steps


def _trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges among nodes that have edges in and out, whose nodes have edges in and out among those
    that are left, and so on; and how many there are."""
    now, n = counted(edges, "trimmed")
    while n:
        # One end after the other, so that hot targets, which are few, are broadcast.
        m = n
        for end, other in (("src", "dst"), ("dst", "src")):
            ends = materialise(now.select(F.col(other).alias(end)).distinct(), "ends")
            now, n = counted(now.join(ends, end, "left_semi").select("src", "dst"), "trimmed")
        if m == n:
            break
    return now, n


def _spread(start: DataFrame, steps: DataFrame) -> DataFrame:
    """id and colour: the largest colour of start (id, colour) among nodes that steps (src, dst) lead from
    to a node, itself included. Only nodes whose colour has grown go on."""
    now = grown = materialise(start, "colours")
    while True:
        sent = grown.select(F.col("id").alias("src"), "colour").join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("__c"))
        better = sent.join(now, "id").where("__c > colour").select("id", F.col("__c").alias("colour"))
        grown, n = counted(better, "grown")
        if not n:
            return now
        now = materialise(now.join(grown.select("id", F.col("colour").alias("__c")), "id", "left").select("id", F.coalesce("__c", "colour").alias("colour")), "colours")


def strong_components(edges: DataFrame) -> DataFrame:
    """id and component (the largest of its ids) of the nodes that lie on a cycle of edges (src, dst),
    loops included; all others are components of their own.

    Forward-backward colouring: nodes that lie on no path between cycles are trimmed, each node takes the
    largest id that reaches it, and what the node of that id is reached from within its colour is a
    component; then the rest. Rounds are as many as paths are long, less where nodes have few edges,
    whose hops are joined first.
    """
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    left, n = _trim(edges.where("src <> dst"))
    out = None
    while n:
        steps = several_hops(left)
        ids = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()
        colours = _spread(ids.withColumn("colour", F.col("id")), steps)
        same = steps.join(colours.select(F.col("id").alias("src"), "colour"), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("__c")), "dst").where("colour = __c")
        back = materialise(same.select(F.col("dst").alias("id"), F.col("src").alias("before")), "back")
        found = front = materialise(colours.where("id = colour").select("id", F.col("colour").alias("component")), "component")
        while True:
            new = front.join(back, "id").select(F.col("before").alias("id"), "component").distinct().join(found.select("id"), "id", "left_anti")
            front, m = counted(new, "component")
            if not m:
                break
            found = materialise(found.unionByName(front), "component")
        out = found if out is None else materialise(out.unionByName(found), "components")
        rest = left.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        left, n = _trim(rest.select("src", "dst"))
    if out is None:
        return loops.withColumn("component", F.col("id"))
    sizes = out.groupBy("component").count().where("count > 1").select("component")
    cyclic = out.join(sizes, "component", "left_semi").select("id", "component")
    return materialise(cyclic.unionByName(loops.join(cyclic, "id", "left_anti").withColumn("component", F.col("id"))), "components")


def _sums(*said: Column) -> list[Column]:
    """Two sums of 64-bit hashes of what is said: a digest of a bag of rows that needs no order, is
    summed before any shuffle, and never holds the rows together."""
    return [F.sum(F.xxhash64(F.lit(seed), *said).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


def _bags(parts: DataFrame) -> DataFrame:
    """The sums of a node's bags: id, n, s1, s2."""
    return parts.groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(c).cast("decimal(30,0)").alias(c) for c in ("s1", "s2")))


def _plain() -> Column:
    """The hash of a node all of whose kids and targets have theirs."""
    return _sha(F.col("own"), *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "s1", "s2")))


def content_hashes(graph, nominal: Column | None = None) -> DataFrame:
    """id and hash of each node by what it says and names, as the module says. `nominal`, a condition on
    a node: an edge to such a node says its label, not its hash. Edges to nodes that aren't held say so.

    Nodes are hashed once all that they depend on is: each round joins the new hashes only. What is left
    then lies on cycles or above them; its components are found and hashed as units, round by round of
    the condensation.
    """
    nodes = graph.nodes
    own = nodes.select("id", _sha(F.coalesce("head", F.lit("\x00")), F.coalesce(F.col("atom").cast("string"), F.lit("\x00"))).alias("own"))
    kids = places(nodes.where("parent_id IS NOT NULL").select("id", "parent_id", "ord"), F.lit(1).cast("bigint"), "k").select(F.col("parent_id").alias("id"), F.concat(F.lit("kid"), "k").alias("role"), F.col("id").alias("dep"))
    edges = graph.edges.select(F.col("src").alias("id"), F.concat(F.lit("edge:"), F.coalesce("kind", F.lit(""))).alias("role"), F.col("dst").alias("dep")).distinct()
    edges = edges.join(nodes.select("id"), "id", "left_semi")
    said = nodes.select(F.col("id").alias("dep"), (F.coalesce(nominal, F.lit(False)) if nominal is not None else F.lit(False)).alias("__by"), "label")
    # Targets are looked up once each, as tables: hot ones, which are few, are broadcast.
    ends = materialise(graph.edges.select(F.col("dst").alias("dep")).distinct(), "ends")
    said = materialise(ends.join(said, "dep").withColumn("__held", F.lit(True)), "said")
    edges = edges.join(said, "dep", "left").select("id", F.when(F.col("__held").isNull(), F.concat("role", F.lit("?"))).when(F.col("__by"), F.concat("role", F.lit("="), F.coalesce("label", F.lit("")))).otherwise(F.col("role")).alias("role"), F.when(F.col("__held") & ~F.col("__by"), F.col("dep")).alias("dep"))
    deps = materialise(kids.unionByName(edges), "deps")
    fixed = deps.where("dep IS NULL").groupBy("id").agg(F.count("*").alias("n"), *_sums(F.col("role")))
    need = deps.groupBy("id").agg(F.count("*").alias("need"))
    base = materialise(own.join(need, "id", "left").join(fixed, "id", "left").select("id", "own", F.coalesce("need", F.lit(0)).alias("need"), "n", "s1", "s2"), "base")
    held, waiting = base.select("id", "own", "need"), base.where("need > 0 AND n IS NOT NULL").select("id", "n", "s1", "s2")
    deps = deps.where("dep IS NOT NULL")

    def gained(fresh: DataFrame, links: DataFrame) -> DataFrame:
        """What links add to the bags of nodes: a kid has one parent, targets that edges lead to may have
        any number, so those are joined by themselves."""
        fresh = fresh.select(F.col("id").alias("dep"), "hash")
        edge = F.col("role").startswith("edge:")
        rows = [part.select("id", "role", "dep").join(hashes, "dep") for part, hashes in ((links.where(~edge), fresh), (links.where(edge), materialise(fresh.join(ends, "dep", "left_semi"), "targets")))]
        return rows[0].unionByName(rows[1]).groupBy("id").agg(F.count("*").alias("n"), *_sums(F.col("role"), F.col("hash")))

    def rounds(held: DataFrame, fresh: DataFrame, n: int, waiting: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Those of `held` that can be hashed, a round for each time that hashes are new: done, what is
        waiting, and how many were hashed."""
        k = m = 0
        while n:
            bags = _bags(waiting.unionByName(gained(fresh, deps))).join(held, "id")
            bags = materialise(bags, "bags")
            fresh, n = counted(bags.where("n = need").select("id", _plain().alias("hash")), "hashes")
            waiting = bags.where("n < need").select("id", "n", "s1", "s2")
            k, m = k + 1, m + n
            done = done.unionByName(fresh) if k % ROUNDS else materialise(done.unionByName(fresh), "hashes")
        return done, waiting, m

    ready = base.where("need = coalesce(n, 0)")
    fresh, first = counted(ready.select("id", _plain().alias("hash")), "hashes")
    waiting = materialise(waiting.join(fresh.select("id"), "id", "left_anti"), "waiting")
    done, waiting, m = rounds(held, fresh, first, waiting, fresh)
    open_, n = counted(held.join(done, "id", "left_anti"), "open")
    if not n:
        return done.select("id", "hash")
    # What waits for something open is open; either side may be the small one.
    if n < first + m:
        links = deps.join(open_.select(F.col("id").alias("dep")), "dep", "left_semi")
    else:
        links = deps.join(done.select(F.col("id").alias("dep")), "dep", "left_anti")
    core, _ = _trim(links.select(F.col("id").alias("src"), F.col("dep").alias("dst")))
    core = materialise(core.select(F.col("src").alias("id")).distinct(), "core")
    fresh = _units(open_.join(core, "id", "left_semi"), links.join(core, "id", "left_semi"), waiting.join(core, "id", "left_semi"), gained)
    # No cycle leads to the others: they are above those that do.
    rest = materialise(open_.join(core, "id", "left_anti"), "open")
    done, _, _ = rounds(rest, fresh, n, waiting, done.unionByName(fresh))
    return done.select("id", "hash")


def _units(open_: DataFrame, links: DataFrame, waiting: DataFrame, gained) -> DataFrame:
    """id and hash of the nodes `open_`, which wait for one another along `links` (id, role, dep) alone:
    they lie on cycles or between them."""
    links = materialise(links.select("id", "role", "dep"), "links")
    found = strong_components(links.select(F.col("id").alias("src"), F.col("dep").alias("dst")))
    units = materialise(open_.join(found, "id", "left").withColumn("unit", F.coalesce("component", "id")).drop("component"), "units")
    ends = units.select("id", "unit")
    links = links.join(ends, "id").join(ends.select(F.col("id").alias("dep"), F.col("unit").alias("to")), "dep")
    inner = materialise(links.where("unit = to").select("id", "role", "dep", "unit"), "inner")
    outer = materialise(links.where("unit <> to").select("id", "role", "dep", "unit"), "outer")
    loose, left = outer, units.select("unit").distinct()
    bags, done = waiting, None
    while True:
        ready, n = counted(left.join(loose.select("unit").distinct(), "unit", "left_anti"), "ready")
        if not n:
            break
        members = units.join(ready, "unit", "left_semi").select("id", "unit", "own")
        now = materialise(members.join(bags, "id", "left").select("id", "unit", _plain().alias("colour")), "colours")
        cyclic = inner.join(ready, "unit", "left_semi").select("id", "role", "dep")
        now = _refined(now, materialise(cyclic, "inner"))
        fresh = materialise(now, "hashes")
        done = fresh if done is None else done.unionByName(fresh)
        left = materialise(left.join(ready, "unit", "left_anti"), "left")
        bags = materialise(_bags(bags.unionByName(gained(fresh, outer))), "bags")
        loose = materialise(loose.join(fresh.select(F.col("id").alias("dep")), "dep", "left_anti").select("id", "role", "dep", "unit"), "loose")
    return materialise(done.select("id", "hash"), "hashes")


def _refined(now: DataFrame, inner: DataFrame) -> DataFrame:
    """id and hash of the nodes (id, unit, colour) whose links among themselves are `inner`: a node
    without any keeps its colour; the others' colours are refined by their links' colours until a
    round tells no more of their unit apart, whatever other units need."""
    alone = now.join(inner.select("id"), "id", "left_anti").select("id", F.col("colour").alias("hash"))
    now = now.join(inner.select("id").distinct(), "id", "left_semi")
    count = lambda colours: colours.groupBy("unit").agg(F.count_distinct("colour").alias("classes"))
    now, n = counted(now.join(count(now), "unit"), "colours")
    held = None
    while n:
        seen = inner.join(now.select(F.col("id").alias("dep"), "colour"), "dep").groupBy("id").agg(F.count("*").alias("n"), *_sums(F.col("role"), F.col("colour")))
        new = materialise(now.join(seen, "id").select("id", "unit", _sha(F.col("colour"), *(F.col(c).cast("string") for c in ("n", "s1", "s2"))).alias("colour"), F.col("classes").alias("was")), "colours")
        new = new.join(count(new), "unit")
        still = new.where("classes = was").select("id", "unit", "colour")
        held = still if held is None else held.unionByName(still)
        now, n = counted(new.where("classes <> was").select("id", "unit", "colour", "classes"), "colours")
    if held is None:
        return alone
    now = materialise(held, "colours")
    digest = now.select("unit", "colour").distinct().groupBy("unit").agg(F.count("*").alias("n"), *_sums(F.col("colour")))
    whole = digest.select("unit", _sha(*(F.col(c).cast("string") for c in ("n", "s1", "s2"))).alias("__u"))
    return alone.unionByName(now.join(whole, "unit").select("id", _sha(F.col("__u"), F.col("colour")).alias("hash")))
