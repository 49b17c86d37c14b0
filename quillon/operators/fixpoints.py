"""Fixpoints on what is new: rules that feed one another, classes of reachability, values that spread
until they meet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.plans.ordering import number_rows, running_sum
from quillon.plans.tables import counted, materialise

from .components import several_hops
from .ranges import ROUNDS

Rule = Callable[[DataFrame, DataFrame], DataFrame]


def follows(edges: DataFrame) -> Rule:
    """The rule that what an edge (src, dst) leads to is kept with its source."""
    steps = edges.select(F.col("src").alias("id"), "dst")
    return lambda new, kept: new.join(steps, "id").select(F.col("dst").alias("id"))


def both(pairs: DataFrame) -> Rule:
    """The rule that `id` is kept once `first` and `second` (columns of pairs) both are: a member whose
    struct lives and that a live use names, say. Each round asks for the pairs of which one is new."""

    def half(new: DataFrame, kept: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.join(new.select(F.col("id").alias(a)), a, "left_semi").join(kept.select(F.col("id").alias(b)), b, "left_semi").select("id")

    def rule(new: DataFrame, kept: DataFrame) -> DataFrame:
        return half(new, kept, "first", "second").unionByName(half(new, kept, "second", "first"))

    return rule


def derive(roots: DataFrame, rules: list[Rule], most: int = 1_000_000) -> DataFrame:
    """id and round of all that the rules keep, from the roots (column id) on. A rule gets the ids that
    the last round added and all that are kept by then, and must name what those new ones add; so
    each round's joins start from the new ids alone. Raises if `most` rounds don't suffice."""
    kept, n = counted(roots.select("id").distinct().withColumn("round", F.lit(0)), "kept")
    new = kept
    for k in range(1, most + 1):
        if not n:
            return kept
        named = reduce(DataFrame.unionByName, [rule(new.select("id"), kept.select("id")).select("id") for rule in rules]).distinct()
        new, n = counted(named.join(kept.select("id"), "id", "left_anti").withColumn("round", F.lit(k)), "new")
        kept = kept.unionByName(new) if k % ROUNDS else materialise(kept.unionByName(new), "kept")
    raise ValueError(f"ids are still found after {most} rounds")


#: How many times the edges that lead on, about, the paths of a table of twice as many hops may be.
WIDER = 4


def distances(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """id and round of all that edges (src, dst) lead to from the roots (column id), round being the least
    number of hops: what derive() finds by follows() alone.

    Walks of 1, 2, 4 ... hops are tabled as long as those tables stay about as long as the edges, which
    is counted before they are joined; going along each once, in this order, finds all that lies within
    the sum of their hops, at its least distance. Rounds are so many tables each and begin at the
    farthest nodes of the last; where nodes have one edge each, there is one, of as many joins as the
    longest distance has binary digits."""
    steps, least = counted(edges.where("src <> dst").select("src", "dst").distinct(), "steps")
    walks, wider = [steps], least > 0
    kept = now = materialise(roots.select("id").distinct().withColumn("round", F.lit(0)), "kept")
    base = 0
    while True:
        k = 0
        while k < len(walks):
            sent = now.join(walks[k].select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id"), (F.col("round") + (1 << k)).alias("round"))
            sent = sent.join(kept.select("id"), "id", "left_anti")
            seen = Observation()
            now = materialise(now.unionByName(sent).groupBy("id").agg(F.min("round").alias("round")).observe(seen, F.max("round").alias("far")), "now")
            k += 1
            far = base + (1 << k) - 1
            if (seen.get["far"] or 0) < far:
                return kept.unionByName(now.where(F.col("round") > base))
            if k == len(walks) and wider:
                ins, outs = (walks[-1].groupBy(F.col(c).alias("id")).agg(F.count("*").alias(c)) for c in ("dst", "src"))
                n = ins.join(outs, "id").agg(F.sum(F.col("dst") * F.col("src"))).first()[0] or 0
                wider = n <= WIDER * least
                if wider:
                    walks.append(materialise(walks[-1].join(walks[-1].select(F.col("src").alias("dst"), F.col("dst").alias("__d")), "dst").select("src", F.col("__d").alias("dst")).distinct(), "walks"))
        kept = materialise(kept.unionByName(now.where(F.col("round") > base)), "kept")
        base = far
        now = materialise(now.where(F.col("round") == base), "now")


def classes_of(pairs: DataFrame) -> DataFrame:
    """id and member_of, the least id of those that pairs (a, b) join it with, directly or not: labels
    go over several hops at once, and only those that fall go on."""
    rows = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    steps = several_hops(rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    now = grown = materialise(steps.select(F.col("src").alias("id")).distinct().withColumn("member_of", F.col("id")), "labels")
    while True:
        sent = grown.select(F.col("id").alias("src"), "member_of").join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.min("member_of").alias("__m"))
        grown, n = counted(sent.join(now, "id").where("__m < member_of").select("id", F.col("__m").alias("member_of")), "labels")
        if not n:
            return now
        fallen = grown.select("id", F.col("member_of").alias("__m"))
        now = materialise(now.join(fallen, "id", "left").select("id", F.coalesce("__m", "member_of").alias("member_of")), "labels")


#: Classes of partition() after those of the caller, and what an entity that none reaches is said to be.
HELD, REACHED = "held", "reachable"
UNREACHED, POSITIONAL, RENUMBERS = "unreachable", "unreachable, but initialised by position", "unreachable, but renumbers a live enumerator"


def partition(entities: DataFrame, edges: DataFrame, roots: list[tuple[str, DataFrame]], casts: DataFrame | None = None, placed: DataFrame | None = None, rules: tuple[Rule, ...] = ()) -> DataFrame:
    """One row an entity: id, class, round, why.

    entities: id, kind ("M" a member, "N" an enumerator, or any other), owner (a member's struct, an
    enumerator's enum), ord (its place there) and explicit (an enumerator that says its value).
    The class is the first of `roots` (name and ids, in order of priority) that names it; HELD for
    members of structs that casts (a, b: structs, or whatever stands between them) join with
    another struct, as one is read as the other; REACHED if any of these reaches it over edges or
    rules; else null. An entity of several root classes has the first.

    why is of what isn't reached: POSITIONAL where an initialiser of its struct (placed: owner, n
    values from place 0 on) has a value at its place or after it; RENUMBERS where the next
    enumerator that says no value itself, before one that does, is live; else UNREACHED.
    """
    named = [ids.select("id").distinct().withColumn("p", F.lit(k)) for k, (_, ids) in enumerate(roots)]
    if casts is not None:
        joined = classes_of(casts)
        owners = entities.where("kind = 'M'").select(F.col("owner").alias("id")).distinct()
        structs = joined.join(owners, "id", "left_semi")
        punned = structs.join(structs.groupBy("member_of").count().where("count > 1"), "member_of", "left_semi").select(F.col("id").alias("owner"))
        named.append(entities.where("kind = 'M'").join(punned, "owner", "left_semi").select("id").withColumn("p", F.lit(len(roots))))
    first = reduce(DataFrame.unionByName, named).groupBy("id").agg(F.min("p").alias("p"))
    first = materialise(first.join(entities.select("id"), "id", "left_semi"), "roots")
    live = derive(first, [follows(edges), *rules]) if rules else distances(first, edges)
    names = F.array(*(F.lit(n) for n, _ in roots), F.lit(HELD))
    rows = entities.join(first, "id", "left").join(live, "id", "left")
    rows = rows.withColumn("class", F.when(F.col("p").isNotNull(), F.get(names, F.col("p"))).when(F.col("round").isNotNull(), F.lit(REACHED)))
    dead, why = F.col("class").isNull(), F.lit(UNREACHED)
    if placed is not None:
        longest = placed.groupBy("owner").agg(F.max("n").alias("__n"))
        rows = rows.join(longest, "owner", "left")
        why = F.when((F.col("kind") == "M") & (F.col("ord") < F.col("__n")), POSITIONAL).otherwise(why)
    # Enumerators in runs: each that says its value begins one, and each enum (runs are told by both).
    enums = rows.where("kind = 'N'").select("id", "owner", "ord", F.coalesce("explicit", F.lit(False)).alias("__x"), (~dead).alias("__live"))
    enums = running_sum(number_rows(enums, ["owner", "ord", "id"], "__rn"), F.col("__x").cast("bigint"), "__run", "__rn")
    last = enums.where("__live AND NOT __x").groupBy(F.col("owner").alias("__o"), F.col("__run").alias("__r")).agg(F.max("ord").alias("__last"))
    moves = enums.join(last, F.col("owner").eqNullSafe(F.col("__o")) & (F.col("__run") == F.col("__r"))).where("__last > ord").select("id", F.lit(True).alias("__moves"))
    rows = rows.join(moves, "id", "left")
    why = F.when((F.col("kind") == "N") & F.col("__moves"), RENUMBERS).otherwise(why)
    return rows.select("id", "class", "round", F.when(dead, why).alias("why"))


def spread_values(values: DataFrame, edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """id, value and conflict of every node that a value comes to: the values (id, value) go along edges
    (src, dst), and where different ones meet, or one that is known to be of none (a null), there is
    a conflict (value null), which goes on as one.

    A node is nothing, a value, or a conflict, and only ever goes up; each round sends the nodes that
    went up in the last one, so a node sends twice at most.
    """
    said = [F.min("value").alias("value"), F.max("value").alias("__max"), F.bool_or("conflict").alias("conflict")]

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("id").agg(*said)
        conflict = F.col("conflict") | (F.col("value") != F.col("__max"))
        return rows.select("id", F.when(~conflict, F.col("value")).alias("value"), conflict.alias("conflict"))

    steps = materialise(edges.select(F.col("src").alias("id"), "dst").distinct(), "steps")
    now, n = counted(met(values.select("id", "value", F.col("value").isNull().alias("conflict"))), "values")
    new = now
    for _ in range(most):
        if not n:
            return now
        sent = met(new.join(steps, "id").select(F.col("dst").alias("id"), "value", "conflict"))
        old = now.select("id", F.col("value").alias("__v"), F.col("conflict").alias("__c"))
        clash = F.col("conflict") | (F.col("__v") != F.col("value"))
        up = sent.join(old, "id", "left").where("__c IS NULL OR NOT __c AND (conflict OR __v <> value)")
        up = up.select("id", F.when(F.col("__c").isNull(), F.col("conflict")).otherwise(clash).alias("conflict"), "value")
        new, n = counted(up.select("id", F.when(~F.col("conflict"), F.col("value")).alias("value"), "conflict"), "values")
        now = materialise(now.join(new.select("id"), "id", "left_anti").unionByName(new), "values")
    raise ValueError(f"values still spread after {most} rounds")
