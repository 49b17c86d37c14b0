"""A property graph as two frames, with the path-step language, views, closures, diffs and edits.

nodes: id, parent_id, ord (place in the parent), head, atom (null for lists) and label; edges: src,
dst, kind ("refers" from a use to a declaration, "typed" from a node to its type). index() adds
what the steps need. All results carry `rank`, a node's place in the source's order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.ordering import number_rows
from quillon.plans.tables import counted, materialise

from .components import GROWTH, HOPS, content_hashes, several_hops, strong_components  # noqa: F401
from .ranges import ROUNDS, below, ranks, tree_levels, within

KINDS = ("refers", "typed", "contains", "inside")
#: Steps to what holds a node, and the column that names it.
_HOLDERS = {"contains<": "parent_id", "^fn": "top_id", "^stmt": "stmt_id"}


@dataclass(frozen=True)
class How:
    """What a graph was indexed by, for the trees that an edit touches."""

    columns: list[str]
    holder: Column
    statement: Column
    call: Column | None
    entity: Column | None
    max_depth: int
    slack: float


#: Updates of an index after which its nodes are written as one table.
LAYERS = 16


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    indexed: bool = field(default=False)
    how: How | None = field(default=None)
    #: Rows that the last update() wrote, and updates since all nodes were.
    written: int = field(default=0)
    layers: int = field(default=0)
    #: Whether the nodes are as read_forms(places=True) gives them, perhaps with further columns.
    placed: bool = field(default=False)

    def index(self, holder: Column, statement: Column, call: Column | None = None, entity: Column | None = None, max_depth: int = 1_000, slack: float = 0.0) -> Graph:
        """The graph with, for each node: depth, root_id, rank (its place in the source's order), size
        (of its subtree, whose ranks are rank to rank + size - 1), top_id and stmt_id (the nearest
        node at or above it that `holder` and `statement` hold for), rep_id (the first node of its
        `entity`; itself without one) and in_call. Ranks are 1, 2, 3 ... or, with `slack`, leave
        each tree room to grow by that share, which update() uses. What read_forms(places=True)
        placed isn't ranked again, unless `slack` asks for room."""
        how = How([c for c in self.columns if c not in _PLACED], holder, statement, call, entity, max_depth, slack)
        if self.placed and not slack:
            nodes = _from_places(self.nodes, how)
            if entity is None:
                return replace(self, nodes=nodes.withColumn("rep_id", F.col("id")).drop("__e"), edges=materialise(self.edges, "edges"), indexed=True, how=how, placed=False)
        else:
            nodes = _ranked(self.nodes.select(how.columns), how)
        if entity is None:
            nodes = nodes.withColumn("rep_id", F.col("id"))
        else:
            firsts = nodes.where("__e IS NOT NULL").groupBy("__e").agg(F.min_by("id", "rank").alias("__rep"))
            nodes = nodes.join(firsts, "__e", "left").withColumn("rep_id", F.coalesce("__rep", "id")).drop("__rep")
        return replace(self, nodes=materialise(nodes.drop("__e"), "nodes"), edges=materialise(self.edges, "edges"), indexed=True, how=how, placed=False)

    @property
    def columns(self) -> list[str]:
        """The nodes' columns without those of the index."""
        return self.how.columns if self.how else self.nodes.columns

    def update(self, insert: DataFrame | None = None, delete: DataFrame | None = None, move: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        """The indexed graph after delete(), move() and insert(), in that order, indexed again: only the
        trees that these touch are read, ranked and written (`written` rows), the others' rows stay.

        All is indexed anew where a tree outgrows the room that index(slack=...) left it, or a new
        tree doesn't come after all others. Graphs with entities can't be updated: index() them.
        """
        if not self.indexed or self.how is None or self.how.entity is not None:
            raise ValueError("index() the graph first, without entities")
        self = replace(self, nodes=self.nodes.drop("above"))
        of = self.nodes.select(F.col("id").alias("__i"), "root_id")
        asked = [d.select(F.col(c).alias("__i")) for d, cs in ((insert, ["parent_id"]), (delete, ["id"]), (move, ["id", "new_parent"])) if d is not None for c in cs]
        touched = materialise(reduce(DataFrame.unionByName, asked).distinct().join(of, "__i").select("root_id").distinct(), "touched")
        part = replace(self, nodes=self.nodes.join(touched, "root_id", "left_semi").select(self.nodes.columns))
        for edit, rows in ((Graph.delete, delete), (Graph.move, move)):
            part = part if rows is None else edit(part, rows)
        part = part if insert is None else part.insert(insert, edges)
        flat = materialise(part.nodes.select(self.how.columns), "touched")
        whole = lambda: Graph(self.nodes.join(touched, "root_id", "left_anti").select(self.how.columns).unionByName(flat), part.edges).index(self.how.holder, self.how.statement, self.how.call, None, self.how.max_depth, self.how.slack)
        roots = flat.where("parent_id IS NULL").select("id", "ord")
        old = self.nodes.where("parent_id IS NULL")
        new, n = counted(roots.join(old.select("id"), "id", "left_anti"), "roots")
        last = old.agg(F.max(F.struct("ord", "id")).alias("o"), F.max(F.col("rank") + F.col("room") - 1).alias("end")).first()
        moved_up = roots.join(old.select("id", F.col("ord").alias("__o")), "id").where("ord <> __o")
        if n and (last["o"] is None or not new.where(F.struct("ord", "id") <= F.struct(F.lit(last["o"]["ord"]).cast("bigint"), F.lit(last["o"]["id"]))).isEmpty()) or not moved_up.isEmpty():
            return whole()
        starts = old.join(touched.select(F.col("root_id").alias("id")), "id", "left_semi").select("id", "rank", "room")
        if n:
            slots = number_rows(new.select("id", "ord"), ["ord", "id"], "__k")
            room = 1 << 20
            starts = starts.unionByName(slots.select("id", (F.lit(last["end"] + 1) + (F.col("__k") - 1) * room).alias("rank"), F.lit(room).cast("bigint").alias("room")))
        ranked, written = counted(_ranked(flat, self.how, materialise(starts, "starts")).drop("__e").withColumn("rep_id", F.col("id")), "nodes")
        if not ranked.where("parent_id IS NULL AND size > room").isEmpty():
            return whole()
        nodes = self.nodes.join(touched, "root_id", "left_anti").select(self.nodes.columns).unionByName(ranked)
        layers = self.layers + 1
        if layers >= LAYERS:
            nodes, layers = materialise(nodes, "nodes"), 0
        return replace(self, nodes=nodes, edges=materialise(part.edges, "edges"), written=written, layers=layers)

    # -- integrity and counts --------------------------------------------------------------

    def dangling(self) -> DataFrame:
        """The edges whose target isn't held. Targets are looked up once each, so that hot ones aren't
        dealt out to one task with all their edges."""
        gone = materialise(targets(self.edges).join(self.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("__d")), "gone")
        return self.edges.join(gone, F.col("dst").eqNullSafe(F.col("__d")), "left_semi").select(self.edges.columns)

    def census(self) -> DataFrame:
        """One row of counts: nodes, lists, atoms, edges by kind, dangling edges."""
        n = self.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("atom").isNull()).alias("lists"), F.count("atom").alias("atoms"))
        e = self.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "refers").alias("refers"), F.count_if(F.col("kind") == "typed").alias("typed"))
        return n.join(e).join(self.dangling().agg(F.count("*").alias("dangling")))

    def same(self, other: Graph) -> bool:
        """Whether both hold the same nodes and edges, by all their columns."""
        pairs = ((self.nodes, other.nodes), (self.edges, other.edges))
        return all(a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty() for a, b in pairs)

    # -- the step language -----------------------------------------------------------------

    def follow(self, roots: DataFrame, steps: str, held: bool = False) -> DataFrame:
        """What the steps reach from each root (column id): root, node, via. via is the use that
        was crossed last; each step is a join, and sets stay sets at every step. With `held` the
        roots are known to be nodes, and aren't looked up to see it."""
        cur = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.col("id").alias("via").try_cast(dict(self.nodes.dtypes)["id"]))
        # As a table: its size is known then, and a small one is broadcast.
        cur = materialise(cur.withColumn("via", F.when(F.lit(False), F.col("via"))), "roots")
        asked = parse_steps(steps)
        for k, step in enumerate(asked):
            if step != "call" or asked[k + 1 : k + 2] not in ([s] for s in _HOLDERS):
                cur = self._step(cur, step, asked[k - 1 : k] == ["call"], held and not k)
        return cur

    def _step(self, cur: DataFrame, step: str, called: bool = False, held: bool = False) -> DataFrame:
        """One step; with `called` only from nodes in calls, which a step to what holds them looks up
        by the same join."""
        n = self.nodes
        if step in ("refers", "typed"):
            e = self.edges.where(F.col("kind") == step).select(F.col("src").alias("node"), "dst")
            if step == "refers":
                # Targets' entities as a table: hot ones, which are few, are broadcast.
                e = e.join(materialise(targets(e).join(n.select(F.col("id").alias("dst"), "rep_id"), "dst"), "targets"), "dst").select("node", F.col("rep_id").alias("dst"))
            out = cur.join(e, "node").select("root", F.col("dst").alias("node"), F.col("node").alias("via"))
        elif step == "refers<":
            uses = self.edges.where("kind = 'refers'").select("dst", "src")
            if self._alone:
                decls = (cur if held else self._rep(cur)).select("root", F.col("node").alias("dst"))
            else:
                decls = self._rep(cur).join(n.select(F.col("rep_id").alias("node"), F.col("id").alias("dst")), "node")
            out = _at(decls, uses).join(uses, "dst").select("root", F.col("src").alias("node"), F.col("src").alias("via"))
        elif step == "typed<":
            e = self.edges.where("kind = 'typed'").select("dst", "src")
            out = _at(cur.select("root", F.col("node").alias("dst")), e).join(e, "dst").select("root", F.col("src").alias("node"), F.col("src").alias("via"))
        elif step == "contains":
            out = cur.join(n.select(F.col("parent_id").alias("node"), F.col("id").alias("k")), "node").select("root", F.col("k").alias("node"), "via")
        elif step == "inside":
            pairs = below(n, cur.select(F.col("node").alias("id")))
            out = cur.join(pairs.select(F.col("anc").alias("node"), F.col("id").alias("k")), "node").select("root", F.col("k").alias("node"), "via")
        elif step == "call":
            out = cur.join(n.where("in_call").select(F.col("id").alias("node")), "node").select("root", "node", "via")
        else:
            column = _HOLDERS[step]
            out = cur.join((n.where("in_call") if called else n).select(F.col("id").alias("node"), F.col(column).alias("k")), "node").where("k IS NOT NULL").select("root", F.col("k").alias("node"), "via")
            if step == "^fn" and not self._alone:
                out = self._rep(out)
        return out.distinct()

    @property
    def _alone(self) -> bool:
        """Whether every node is the first of its entity."""
        return self.how is not None and self.how.entity is None

    def _rep(self, cur: DataFrame) -> DataFrame:
        return cur.join(self.nodes.select(F.col("id").alias("node"), "rep_id"), "node").select("root", F.col("rep_id").alias("node"), "via")

    def hits(self, found: DataFrame) -> DataFrame:
        """follow()'s rows by root and node, in the source's order: rank, and via, the uses in
        that order."""
        ranks = self.nodes.select(F.col("id").alias("via"), F.col("rank").alias("__v"))
        rows = found.join(ranks, "via", "left").groupBy("root", "node").agg(F.array_sort(F.collect_set(F.when(F.col("via").isNotNull(), F.struct("__v", "via")))).alias("__l"))
        rows = rows.withColumn("via", F.col("__l.via")).drop("__l")
        return rows.join(self.nodes.select(F.col("id").alias("node"), "rank"), "node").select("root", "node", "rank", "via")

    def levels(self, roots: DataFrame, steps: str, depth: int, stop: tuple[str, ...] = ()) -> DataFrame:
        """The relation's edges from the roots to a depth: depth, root, node, rank, via. A node is
        expanded at the first depth that reaches it; heads in `stop` aren't expanded."""
        frontier = self._rep(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("via"))).select(F.col("node").alias("id")).distinct()
        seen, out, d = materialise(frontier, "frontier"), None, 0
        frontier = seen
        while d < depth or not depth:
            d += 1
            rows = materialise(self.hits(self.follow(frontier, steps)).withColumn("depth", F.lit(d)), "hits")
            out = rows if out is None else out.unionByName(rows)
            new = rows.select(F.col("node").alias("id")).distinct().join(seen, "id", "left_anti")
            if stop:
                new = new.join(self.nodes.where(F.col("head").isin(*stop)).select("id"), "id", "left_anti")
            frontier, n = counted(new, "frontier")
            if not n:
                break
            seen = seen.unionByName(frontier)
        return out.select("depth", "root", "node", "rank", "via")

    def build(self, root, steps: str, depth: int = 0, stop: tuple[str, ...] = (), limit: int = 100_000) -> dict:
        """The view's tree of one root, for display: node, kids, via, link (a node that the tree
        holds already, depth first). Raises if the relation has over `limit` edges to the depth."""
        spark = self.nodes.sparkSession
        rows = self.levels(spark.createDataFrame([(root,)], f"id {dict(self.nodes.dtypes)['id']}"), steps, depth, stop).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"over {limit} edges: use levels()")
        kids: dict = {}
        for r in sorted(rows, key=lambda r: r.rank):
            kids.setdefault(r.root, []).append(r)
        top = self._rep(spark.createDataFrame([(root, root, 0)], f"root {dict(self.nodes.dtypes)['id']}, node {dict(self.nodes.dtypes)['id']}, via int")).first().node
        held = {top}

        def expand(node, d: int) -> list[dict]:
            out = []
            for r in kids.get(node, []):
                link = r.node in held
                held.add(r.node)
                out.append({"node": r.node, "via": list(r.via), "link": link, "kids": [] if link or depth and d >= depth else expand(r.node, d + 1)})
            return out

        return {"node": top, "kids": expand(top, 1)}

    def contexts(self, uses: DataFrame, show: str = "stmt") -> DataFrame:
        """The forms around uses (column id): form, rank, and its uses in order. show: "stmt", "fn"
        or "node" (the use itself)."""
        column = {"stmt": "stmt_id", "fn": "top_id", "node": "id"}[show]
        rows = uses.join(self.nodes.select("id", F.col(column).alias("form"), F.col("rank").alias("__u")), "id")
        out = rows.groupBy("form").agg(F.array_sort(F.collect_set(F.struct("__u", "id"))).alias("__l")).withColumn("uses", F.col("__l.id")).drop("__l")
        return out.join(self.nodes.select(F.col("id").alias("form"), "rank"), "form").select("form", "rank", "uses")

    # -- named views -----------------------------------------------------------------------

    def callers(self, roots: DataFrame, depth: int = 2) -> DataFrame:
        return self.levels(roots, "refers< call ^fn", depth)

    def callees(self, roots: DataFrame, depth: int = 2) -> DataFrame:
        return self.levels(roots, "inside call refers", depth)

    def uses(self, roots: DataFrame, depth: int = 1) -> DataFrame:
        return self.levels(roots, "refers< ^fn", depth)

    def tally(self, roots: DataFrame, access: Column) -> DataFrame:
        """Uses of each root by access (a column over the use's node): root, access, n, forms."""
        found = self.follow(roots, "refers<").join(self.nodes.withColumn("access", access).select(F.col("id").alias("node"), "access", "top_id"), "node")
        return found.groupBy("root", "access").agg(F.count("*").alias("n"), F.count_distinct("top_id").alias("forms"))

    def definition(self, root) -> DataFrame:
        """The root and all it contains, in the source's order."""
        at = self.nodes.where(F.col("id") == F.lit(root)).select("rank", "size").first()
        return self.nodes.where(F.lit(False) if at is None else F.col("rank").between(at["rank"], at["rank"] + at["size"] - 1)).orderBy("rank")

    def type_view(self, types: DataFrame) -> DataFrame:
        """For each type (column id): how many nodes have it, directly or through pointers and
        arrays, by head: type, head, n."""
        through = self.nodes.where(F.col("head").isin("pointer", "array")).select("id").join(self.edges.where("kind = 'typed'").select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("src"), F.col("id").alias("dst"))
        reach = closure(types.select(F.col("id").alias("seed"), "id"), through) if not through.isEmpty() else types.select(F.col("id").alias("seed"), "id")
        typed = self.edges.where("kind = 'typed'").select(F.col("src").alias("node"), F.col("dst").alias("id"))
        rows = reach.join(typed, "id").join(self.nodes.select(F.col("id").alias("node"), "head"), "node")
        return rows.groupBy(F.col("seed").alias("type"), "head").agg(F.count("*").alias("n"))

    def find(self, text: str) -> DataFrame:
        """Nodes by user text: #ID, or a label; S.M is the node labelled M below one labelled S."""
        if text.startswith("#"):
            return self.nodes.where(F.col("id").cast("string") == text[1:])
        exact = self.nodes.where(F.col("label") == text)
        if "." not in text:
            return exact
        outer, inner = text.rsplit(".", 1)
        above = self.nodes.where(F.col("label") == outer).where("size > 1").select((F.col("rank") + 1).alias("lo"), (F.col("rank") + F.col("size") - 1).alias("hi"))
        member = self.nodes.where(F.col("label") == inner)
        member = member.join(within(above, member.select("id", "rank")).select("id"), "id", "left_semi")
        return exact.unionByName(member.join(exact.select("label").distinct(), "label", "left_anti").select(exact.columns))

    # -- edits -----------------------------------------------------------------------------

    def _subtree(self, ids: DataFrame) -> DataFrame:
        """The ids with all they contain."""
        return ids.select("id").unionByName(below(self.nodes, ids).select("id")).distinct()

    def delete(self, ids: DataFrame) -> Graph:
        """Without the nodes (column id) and what they contain; edges out of them go, edges into
        them dangle until retargeted or discharged."""
        gone = materialise(self._subtree(ids), "gone")
        return replace(self, nodes=self.nodes.join(gone, "id", "left_anti").select(self.nodes.columns), edges=self.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").select(self.edges.columns), indexed=False, placed=False)

    def insert(self, nodes: DataFrame, edges: DataFrame | None = None) -> Graph:
        """With the nodes added, each at its parent_id and ord: those at or after an ord that new
        nodes take move up. New nodes of a parent have ords of the result."""
        columns = self.columns
        taken = nodes.groupBy(F.col("parent_id").alias("__p")).agg(F.array_sort(F.collect_list(F.col("ord").cast("bigint"))).alias("__new"))
        old = self.nodes.select(columns).join(taken, F.col("parent_id").eqNullSafe(F.col("__p")), "left")
        moved = F.aggregate("__new", F.col("ord").cast("bigint"), lambda at, n: F.when(n <= at, at + 1).otherwise(at))
        old = old.withColumn("ord", F.coalesce(moved, F.col("ord").cast("bigint"))).select(columns)
        return Graph(old.unionByName(nodes.select([c for c in columns if c in nodes.columns]).withColumn("ord", F.col("ord").cast("bigint")), allowMissingColumns=True), self.edges if edges is None else self.edges.unionByName(edges.select(self.edges.columns)))

    def replace(self, ids: DataFrame, atom: Column) -> Graph:
        """Atoms (column id) with a new text, an expression over the node."""
        mark = ids.select("id").distinct().withColumn("__r", F.lit(True))
        rows = self.nodes.join(mark, "id", "left").withColumn("atom", F.when(F.col("__r"), atom).otherwise(F.col("atom")))
        return replace(self, nodes=rows.select(self.nodes.columns))

    def retarget(self, moves: DataFrame) -> Graph:
        """Edges into `old` go to `new` (columns of moves)."""
        rows = self.edges.join(moves.select(F.col("old").alias("dst"), F.col("new").alias("__n")), "dst", "left")
        return replace(self, edges=rows.withColumn("dst", F.coalesce("__n", "dst")).select(self.edges.columns).distinct())

    def move(self, moves: DataFrame) -> Graph:
        """Nodes (column id) put below another parent (new_parent, new_ord)."""
        rows = self.nodes.join(moves.select("id", "new_parent", "new_ord"), "id", "left")
        rows = rows.withColumns({"parent_id": F.when(F.col("new_ord").isNotNull(), F.col("new_parent")).otherwise(F.col("parent_id")), "ord": F.coalesce(F.col("new_ord").cast("bigint"), F.col("ord").cast("bigint"))})
        return Graph(rows.select(self.columns), self.edges)

    def fresh_ids(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """rows with new ids above all that are held, in the given order (integer ids)."""
        most = self.nodes.agg(F.max("id").alias("__m"))
        return number_rows(rows, order, "__rn").join(F.broadcast(most)).withColumn("id", F.col("__m") + F.col("__rn")).drop("__m", "__rn", "__part")

    def fall_out(self, rule: Callable[[Graph, DataFrame], DataFrame], most: int = 100) -> Graph:
        """Deletes what `rule` names (ids, from the graph and its dangling edges) until no edge
        dangles; raises where a round names nothing, and the rest is unhandled."""
        now = self
        for _ in range(most):
            bad, n = counted(now.dangling(), "dangling")
            if not n:
                return now
            ids, n = counted(rule(now, bad).select("id").distinct(), "rule")
            if not n:
                raise ValueError(f"unhandled dangling edges, such as {bad.first()}")
            now = now.delete(ids)
            now = replace(now, nodes=materialise(now.nodes, "nodes"), edges=materialise(now.edges, "edges"))
        raise ValueError(f"edges still dangle after {most} rounds")


def targets(edges: DataFrame) -> DataFrame:
    """The edges' different targets (dst), as a table."""
    return materialise(edges.select("dst").distinct(), "targets")


def _at(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows (dst) that edges lead to, as a table: where all edges lead to few nodes, these are
    broadcast, and no task sorts all edges of one."""
    return materialise(rows.join(targets(edges), "dst", "left_semi"), "ends")


def _ranked(nodes: DataFrame, how: How, starts: DataFrame | None = None) -> DataFrame:
    """The nodes with all columns of the index but rep_id, and __e, the entity."""
    call = F.lit(False) if how.call is None else F.coalesce(how.call, F.lit(False))
    entity = F.lit(None).cast("string") if how.entity is None else how.entity
    levels = tree_levels(nodes.withColumns({"__h": F.coalesce(how.holder, F.lit(False)), "__s": F.coalesce(how.statement, F.lit(False)), "in_call": call, "__e": entity}), how.max_depth)
    return reduce(DataFrame.unionByName, levels).join(ranks(levels, starts, how.slack), "id").drop("__h", "__s")


#: The columns of read_forms(places=True); edits, which may change them, keep none.
_PLACED = ("above", "__depth", "__size", "__root", "__local", "__part")


def _from_places(nodes: DataFrame, how: How) -> DataFrame:
    """As _ranked(), of placed nodes, without a shuffle: ranks are places in a partition behind the
    nodes of those before it. Only holders and statements within trees are looked up, by ranges."""
    deepest = nodes.agg(F.max("__depth")).first()[0]
    if deepest is not None and deepest >= how.max_depth:
        raise ValueError(f"deeper than {how.max_depth}: is the containment a tree?")
    parts = nodes.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = materialise(parts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset")), "offsets")
    call = F.lit(False) if how.call is None else F.coalesce(how.call, F.lit(False))
    entity = F.lit(None).cast("string") if how.entity is None else how.entity
    flags = {"__h": F.coalesce(how.holder, F.lit(False)), "__s": F.coalesce(how.statement, F.lit(False))}
    size = F.col("__size")
    out = nodes.join(F.broadcast(offsets), "__part").withColumns(flags | {"in_call": call, "__e": entity})
    top = F.col("parent_id").isNull()
    said = out.agg(*(F.count_if(F.col(c) & ~top).alias(f"{c}in") for c in flags), *(F.count_if(F.col(c) & top).alias(f"{c}top") for c in flags), F.count_if(top).alias("tops")).first()
    out = out.select(*how.columns, "above", "__h", "__s", "in_call", "__e", F.col("__depth").alias("depth"), F.col("__root").alias("root_id"), (F.col("__offset") + F.col("__local") + 1).alias("rank"), size.alias("size"), F.when(top, size).alias("room"))
    ranked = out.select("id", "rank")
    for flag, name in (("__h", "top_id"), ("__s", "stmt_id")):
        if not said[f"{flag}in"] and said[f"{flag}top"] in (0, said["tops"]):
            out = out.withColumn(name, F.col("root_id") if said[f"{flag}top"] else F.lit(None).cast("string"))
            continue
        ranges = materialise(out.where(flag).select(F.col("id").alias(name), F.col("depth").alias("__d"), F.col("rank").alias("lo"), (F.col("rank") + F.col("size") - 1).alias("hi")), "ranges")
        # A table of what is found, not of all nodes: as each id is grouped once, Spark leaves the join
        # out where nobody reads the column.
        found = materialise(within(ranges, ranked).groupBy("id").agg(F.max_by(name, "__d").alias(name)), "holders")
        out = out.join(found.groupBy("id").agg(F.first(name).alias(name)), "id", "left")
    return out.drop("__h", "__s")


def parse_steps(steps: str) -> list[str]:
    """The steps of a path: refers, typed and contains (each with < for the way back), inside,
    ^fn, ^stmt and call."""
    out = steps.split()
    for s in out:
        if s not in ("refers", "refers<", "typed", "typed<", "contains", "contains<", "inside", "^fn", "^stmt", "call"):
            raise ValueError(f"unknown step {s!r}")
    if not out:
        raise ValueError("no steps")
    return out


# -- closures and fixpoints ----------------------------------------------------------------------


#: Members of a component that one task joins to the seeds that reach it, about.
BLOCK = 256


def closure(seeds: DataFrame, edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """seeds (seed, id) with all that edges (src, dst) reach from them: seed, id. One join and one
    anti-join a round, on the new pairs only, until a round finds none; raises if `most` rounds
    don't suffice. Where nodes have few edges, the edges of several hops are tabled first, and a
    round goes as far.

    Where pairs become many times the edges and seeds, they are closed over components instead, as
    nodes on common cycles reach the same: see _over_components()."""
    edges, n = counted(edges.select("src", "dst").distinct(), "edges")
    begun, m = counted(seeds.select("seed", "id").distinct(), "reach")
    seen, whole = _closed(begun, edges, most, GROWTH * (n + m))
    return seen if whole else _over_components(begun, edges, most)


def _closed(begun: DataFrame, edges: DataFrame, most: int, pairs: int | None = None) -> tuple[DataFrame, bool]:
    """The closure round by round, and whether it is whole: it ends early once it has over `pairs` rows."""
    steps = several_hops(edges).select(F.col("src").alias("id"), "dst")
    frontier, total = begun, 0
    seen = frontier
    for k in range(1, most + 1):
        new = frontier.join(steps, "id").select("seed", F.col("dst").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti")
        frontier, n = counted(new, "frontier")
        if not n:
            return seen, True
        total += n
        if pairs is not None and total > pairs:
            return seen, False
        seen = seen.unionByName(frontier)
        if k % ROUNDS == 0:
            seen = materialise(seen, "reach")
    raise ValueError(f"pairs are still found after {most} rounds")


def _over_components(begun: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The closure of begun (seed, id) over edges: which component reaches which, round by round, then
    the seeds of the first and the members of the second. These pairs, which may be as many as the
    nodes' square, come from a join in blocks of members, so that no task has all of a component, and
    are neither written nor compared: components have no members in common."""
    unit = strong_components(edges).select("id", F.col("component").alias("unit"))
    at = lambda df, c: df.join(unit.select(F.col("id").alias(c), "unit"), c, "left").withColumn(c, F.coalesce("unit", c)).drop("unit")
    among = at(at(edges, "src"), "dst").where("src <> dst").select("src", "dst")
    begun = materialise(begun.join(unit, "id", "left").select("seed", F.coalesce("unit", "id").alias("unit")).distinct(), "begun")
    first = materialise(begun.select(F.col("unit").alias("seed"), F.col("unit").alias("id")).distinct(), "reach")
    reach, _ = _closed(first, among, most)
    pairs = begun.where("unit IS NOT NULL").join(reach.select(F.col("seed").alias("unit"), "id"), "unit").select("seed", F.col("id").alias("unit")).distinct()
    pairs = materialise(pairs.unionByName(begun.where("unit IS NULL")), "pairs")
    blocks = materialise(unit.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    members = unit.join(blocks, "unit").select("unit", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id")
    asked = pairs.join(blocks, "unit", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1)))
    # A block may have no member; a node on no cycle has no block.
    return asked.join(members, ["unit", "block"], "left").where("id IS NOT NULL OR blocks IS NULL").select("seed", F.coalesce("id", "unit").alias("id"))


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node that any root (column id) reaches, with its distance: id, depth, and `why`, the
    node it was first reached from (the smallest of a round's)."""
    steps = materialise(edges.select(F.col("src").alias("why"), F.col("dst").alias("__d")).distinct(), "steps")
    frontier, n = counted(roots.select("id").distinct().withColumns({"depth": F.lit(0), "why": F.lit(None).cast(dict(edges.dtypes)["src"])}), "reach")
    seen, d = frontier, 0
    while n:
        d += 1
        new = frontier.select(F.col("id").alias("why")).join(steps, "why").groupBy(F.col("__d").alias("id")).agg(F.min("why").alias("why"))
        frontier, n = counted(new.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "why"), "frontier")
        seen = seen.unionByName(frontier) if d % ROUNDS else materialise(seen.unionByName(frontier), "reach")
    return seen


def unreachable(nodes: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(reachable(roots, edges).select("id"), "id", "left_anti")


def collect(graph: Graph, roots: DataFrame, guards: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> Graph:
    """The graph without what the roots don't reach over edges and containment, upward to holders
    too; guards add ids to keep, from those kept so far, until nothing is added."""
    up = graph.nodes.where("parent_id IS NOT NULL").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = graph.edges.select("src", "dst").unionByName(down).unionByName(up)
    kept = roots.select("id").distinct()
    while True:
        kept = materialise(reachable(kept, steps).select("id"), "kept")
        more = None
        for g in guards:
            new = g(kept).select("id").join(kept, "id", "left_anti")
            more = new if more is None else more.unionByName(new)
        if more is None or more.isEmpty():
            break
        kept = kept.unionByName(more.distinct())
    nodes = graph.nodes.join(kept, "id", "left_semi").select(graph.nodes.columns)
    return Graph(nodes, graph.edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").select(graph.edges.columns), graph.indexed)


def greatest_fixpoint(candidates: DataFrame, violators: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The largest subset of candidates (column id) without violators of itself."""
    now = materialise(candidates.select("id").distinct(), "candidates")
    while True:
        bad, n = counted(violators(now).select("id").distinct().join(now, "id", "left_semi"), "violators")
        if not n:
            return now
        now = materialise(now.join(bad, "id", "left_anti"), "candidates")


# -- hashes and diffs ----------------------------------------------------------------------------


def form_hashes(graph: Graph) -> DataFrame:
    """id and hash of each node's containment subtree, ids aside: equal hashes are equal forms.
    Level by level from the leaves, so the joins are as many as the tree is deep."""
    deepest = graph.nodes.agg(F.max("depth")).first()[0]
    done = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        here = graph.nodes.where(F.col("depth") == d).select("id", "parent_id", "ord", "head", "atom")
        own = F.concat_ws("\x1f", F.coalesce("head", F.lit("\x00")), F.coalesce("atom", F.lit("\x00")))
        if done is None:
            level = here.withColumn("hash", F.sha2(own.cast("binary"), 256))
        else:
            kids = below.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "hash"))).alias("__k"))  # noqa: F821
            level = here.join(kids, "id", "left").withColumn("hash", F.sha2(F.concat_ws("\x1e", own, F.array_join(F.coalesce(F.col("__k.hash"), F.array().cast("array<string>")), "\x1d")).cast("binary"), 256))
        below = materialise(level.select("id", "parent_id", "ord", "hash"), "hashes")
        done = below if done is None else done.unionByName(below)
    return done.select("id", "hash") if done is not None else graph.nodes.select("id", F.lit("").alias("hash"))


def compare_units(a: DataFrame, b: DataFrame) -> DataFrame:
    """What changed from units a to units b (id, label, hash, ord): change (added, removed, changed
    or kept), label, before and after (ids). A unit is the same if id and label are; of those
    left, units with the same label pair in their order."""
    a = a.select(F.col("id").alias("before"), F.col("label").alias("la"), F.col("hash").alias("ha"), F.col("ord").alias("oa"))
    b = b.select(F.col("id").alias("after"), F.col("label").alias("lb"), F.col("hash").alias("hb"), F.col("ord").alias("ob"))
    first = materialise(a.join(b, (a["before"] == b["after"]) & a["la"].eqNullSafe(b["lb"])), "paired")
    rest_a = a.join(first.select("before", "oa"), ["before", "oa"], "left_anti").withColumn("ka", F.row_number().over(Window.partitionBy("la").orderBy("oa")))
    rest_b = b.join(first.select("after", "ob"), ["after", "ob"], "left_anti").withColumn("kb", F.row_number().over(Window.partitionBy("lb").orderBy("ob")))
    second = rest_a.join(rest_b, F.col("la").eqNullSafe(F.col("lb")) & (F.col("ka") == F.col("kb")), "full").drop("ka", "kb")
    every = first.unionByName(second.select(first.columns))
    change = F.when(F.col("ob").isNull(), "removed").when(F.col("oa").isNull(), "added").when(F.col("ha").eqNullSafe(F.col("hb")), "kept").otherwise("changed")
    return every.select(change.alias("change"), F.coalesce("lb", "la").alias("label"), "before", "after")


# -- patterns ------------------------------------------------------------------------------------


def parse_pattern(text: str) -> object:
    """Nested lists and atoms of an S-expression pattern."""
    tokens = re.findall(r"\(|\)|[^\s()]+", text)
    at = 0

    def read():
        nonlocal at
        token = tokens[at]
        at += 1
        if token == ")":
            raise ValueError("unexpected )")
        name = None
        if token.startswith("?") and token.endswith(":") and at < len(tokens) and tokens[at] == "(":
            name, token = token[:-1], tokens[at]
            at += 1
        if token != "(":
            return token
        out = []
        while at < len(tokens) and tokens[at] != ")":
            out.append(read())
        if at == len(tokens):
            raise ValueError("missing )")
        at += 1
        return out if name is None else (name, out)

    found = read()
    if at != len(tokens):
        raise ValueError("more than one form")
    return found


def match(graph: Graph, pattern: str, forms: DataFrame | None = None) -> DataFrame:
    """The nodes that match, with a column for each binding.

    _ is any node, _* (last) the rest of a list, ?x any node, bound, ?x:P one that P matches; a
    name bound twice is the same form twice, which `forms` (form_hashes()) decides. Each element
    of the pattern is one join on (parent_id, ord). An atom in first place is the list's head.
    """
    rows = graph.nodes.select(F.col("id").alias("n0"))
    held = graph.nodes.select("id", "parent_id", "ord", "atom", "head", F.col("atom").isNull().alias("is_list"))
    bound: dict[str, str] = {}
    count = 0

    def one(rows: DataFrame, p: object, column: str) -> DataFrame:
        nonlocal count
        name = None
        if isinstance(p, tuple):
            name, p = p
        if isinstance(p, str):
            if p == "_":
                return rows
            if p.startswith("?"):
                name = p.split(":")[0]
                p = p.partition(":")[2] or "_"
                if p != "_":
                    rows = one(rows, p, column)
            else:
                return rows.join(held.where(F.col("atom") == p).select(F.col("id").alias(column)), column)
        else:
            open_end = bool(p) and p[-1] == "_*"
            parts = p[:-1] if open_end else p
            kids = held.groupBy(F.col("parent_id").alias(column)).agg(F.count("*").alias("__n"))
            lists = held.where("is_list").select(F.col("id").alias(column)).join(kids, column, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
            rows = rows.join(lists.where((F.col("__n") >= len(parts)) if open_end else (F.col("__n") == len(parts))).select(column), column)
            for k, part in enumerate(parts):
                count += 1
                kid = f"n{count}"
                rows = rows.join(held.where(F.col("ord") == k).select(F.col("parent_id").alias(column), F.col("id").alias(kid)), column)
                rows = one(rows, part, kid)
        if name:
            if name in bound:
                if forms is None:
                    raise ValueError(f"{name} is bound twice: give forms")
                a = forms.select(F.col("id").alias(bound[name]), F.col("hash").alias("__a"))
                b = forms.select(F.col("id").alias(column), F.col("hash").alias("__b"))
                rows = rows.join(a, bound[name]).join(b, column).where("__a = __b").drop("__a", "__b")
            else:
                bound[name] = column
        return rows

    rows = one(rows, parse_pattern(pattern), "n0")
    return rows.select(F.col("n0").alias("id"), *(F.col(c).alias(b[1:]) for b, c in bound.items()))


def text_query(forms: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """The matches of a regular expression in printed forms: the rows that have any, with
    `matches` and `n`."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    return forms.withColumn("matches", found).withColumn("n", F.size("matches").cast("bigint")).where("n > 0")


def expect_count(df: DataFrame, n: int, what: str) -> DataFrame:
    """df, whose rows must be n: otherwise reading it raises."""
    right = df.agg(F.assert_true(F.count("*") == n, f"{what}: expected {n}").isNull().alias("__ok"))
    return df.join(F.broadcast(right.where("__ok").select(F.lit(1).alias("__one"))))[df.columns] if df.columns else df
