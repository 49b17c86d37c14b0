"""Views of code graphs: what a use does with what it names, and all that has to do with a type.

Nodes are forms as operators/graph.py holds them: a list's kid at ord 0 is its head, so operands
start at ord 1. The graphs are indexed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.tables import materialise

from .graph import Graph, closure
from .ranges import within

# The labels of an access in the order they are told, and the heads that decide one.
LABELS = ("call", "read", "write", "update", "addr", "init", "type", "unevaluated", "label")
COMPOUND = ("+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "^=", "|=")
BY_ONE = ("pre++", "pre--", "post++", "post--")
UNEVALUATED = ("sizeof", "sizeof-bare", "alignof", "alignof-bare", "typeof", "typeof_unqual", "__typeof__", "__typeof")
AGGREGATES = ("struct", "union", "enum", "extern-struct", "extern-union", "extern-enum")
TYPES = ("typedef", "extern-typedef", *AGGREGATES)


def _edges(graph: Graph, kind: str) -> DataFrame:
    return graph.edges.where(F.col("kind") == kind).select("src", "dst")


def _above(graph: Graph, rows: DataFrame) -> DataFrame:
    """rows (parent_id) with `above`, the head of the form around: placed forms have it."""
    if "above" in rows.columns:
        return rows
    return rows.join(graph.nodes.where("head IS NOT NULL").select(F.col("id").alias("parent_id"), F.col("head").alias("above")), "parent_id", "left")


def _with_above(graph: Graph, *columns: str) -> list[str]:
    """The columns, and `above` where the nodes have it."""
    return [*columns, *(["above"] if "above" in graph.nodes.columns else [])]


def _lasts(graph: Graph, uses: DataFrame) -> DataFrame:
    """Of the parents of uses that select a member: parent_id and the ord of the last kid."""
    if "above" in graph.nodes.columns:
        kids = graph.nodes.where(F.col("above").isin("->", "."))
    else:
        selections = graph.nodes.where(F.col("head").isin("->", ".")).select(F.col("id").alias("parent_id"))
        kids = graph.nodes.join(uses.select("parent_id").distinct().join(selections, "parent_id", "left_semi"), "parent_id", "left_semi")
    return kids.groupBy("parent_id").agg(F.max("ord").alias("last"))


def _around(head: Column, first: Column, array: Column) -> Column:
    """What the form around an expression does with it; null if that is for the next form to say."""
    through = (head == "paren") | (head == ".") & first | (head == "index") & first & array
    return (
        F.when(through, F.lit(None).cast("string"))
        .when((head == "=") & first, "write")
        .when(head.isin(*COMPOUND) & first | head.isin(*BY_ONE), "update")
        .when(head == "addr", "addr")
        .when(head.isin(*UNEVALUATED), "unevaluated")
        .otherwise("read")
    )


def access(graph: Graph, uses: DataFrame) -> DataFrame:
    """id and access, one of LABELS, of each use (column id; repeated ids give one row, ids that the
    graph doesn't hold none).

    A use of a type or a label says so itself, one that a call calls is a call, one below a
    designator ("at") an init. Otherwise the nearest form decides that isn't a parenthesis, the
    selection of a member, or an array's index: all forms above the undecided uses are looked up
    by one join, whatever their depth. A use without a parent is read.
    """
    return _access(graph, uses).select("id", "access")


def _access(graph: Graph, uses: DataFrame) -> DataFrame:
    """access(), with the uses' top_id."""
    nodes = graph.nodes
    mine = nodes.select(*_with_above(graph, "id", "parent_id", "ord", "depth", "rank", "in_call", "top_id"))
    if "above" in mine.columns:  # only of selections the kids are asked for then
        mine = mine.withColumn("parent_id", F.when(F.col("above") == "->", F.col("parent_id")))
    mine = mine.join(uses.select("id").distinct(), "id", "left_semi")
    # Tables of what few nodes are: they are broadcast, and hot targets aren't dealt out.
    said = materialise(nodes.where(F.col("head").isin(*TYPES, "label")).select(F.col("id").alias("dst"), "head"), "heads")
    named = _edges(graph, "refers").join(said, "dst").groupBy(F.col("src").alias("id")).agg(F.bool_or(F.col("head").isin(*TYPES)).alias("__type"), F.bool_or(F.col("head") == "label").alias("__label"))
    plain = F.when(F.col("__type"), "type").when(F.col("__label"), "label").when(F.col("in_call"), "call")
    rows = materialise(mine.join(named, "id", "left").withColumn("__plain", plain).drop("__type", "__label", "in_call"), "uses")
    open_ = rows.where("__plain IS NULL")

    head, first = F.col("above"), F.col("ord") == 1
    asks = F.coalesce((head == "index") & first, F.lit(False))

    def told(rows: DataFrame, said: Column, *more: str) -> DataFrame:
        """What a form says of a use, k forms up; or the child of an index, that may be an array."""
        return rows.select("id", "k", F.when(~asks, said).alias("said"), F.when(asks, F.col("child")).alias("child"), *more)

    beyond = _around(head, first, F.lit(False))
    placed = "above" in nodes.columns
    here = _above(graph, open_).withColumns({"k": F.lit(0), "child": F.col("id")})
    at_use = F.when(head == "at", "init").when(head.isin("->", "."), F.lit(None).cast("string")).otherwise(beyond)
    pointed = here.where(head == "->").join(_lasts(graph, open_), "parent_id", "left")
    told_by = told(here.where(~F.coalesce(head == "->", F.lit(False))), at_use, "rank", "depth")
    told_by = materialise(told_by.unionByName(told(pointed, F.when(F.col("ord") < F.col("last"), "read"), "rank", "depth")), "told")
    # Only uses of which the form around them says nothing ask those above it.
    points = told_by.where("said IS NULL").select("id", "rank", "depth")
    told_by = told_by.drop("rank", "depth")
    if not points.isEmpty():
        child = F.when(asks, F.col("id")) if placed else F.col("id")
        ranges = nodes.where("size > 1").select(child.alias("child"), "above" if placed else "parent_id", "ord", F.col("depth").alias("node_depth"), F.col("rank").alias("lo"), (F.col("rank") + F.col("size") - 1).alias("hi"))
        chain = within(ranges, points).where("node_depth < depth").withColumn("k", F.col("depth") - F.col("node_depth"))
        told_by = told_by.unionByName(told(_above(graph, chain), beyond))

    nearest = told_by.groupBy("id").agg(F.min_by("said", F.when(F.col("said").isNotNull(), F.col("k"))).alias("said"), F.min(F.when(F.col("said").isNotNull(), F.col("k"))).alias("k"), F.collect_list(F.when(F.col("child").isNotNull(), F.struct("k", "child"))).alias("asked"))
    arrays = materialise(_edges(graph, "typed").join(materialise(nodes.where("head = 'array'").select(F.col("id").alias("dst")), "heads"), "dst", "left_semi").select(F.col("src").alias("child")).distinct(), "arrays")
    through = _edges(graph, "refers").join(arrays.select(F.col("child").alias("dst")), "dst", "left_semi").select(F.col("src").alias("child"))
    asked = nearest.where("size(asked) > 0").select("id", F.explode("asked").alias("a")).select("id", F.col("a.k").alias("__k"), F.col("a.child").alias("child"))
    # Of what isn't an array the index reads.
    plain = asked.join(arrays.unionByName(through), "child", "left_anti").groupBy("id").agg(F.min("__k").alias("__k"))
    decided = nearest.drop("asked").join(plain, "id", "left").select("id", F.when(F.col("__k") < F.coalesce("k", F.lit(1 << 30)), "read").otherwise(F.col("said")).alias("__said"))
    return rows.join(decided, "id", "left").select("id", "top_id", F.coalesce("__plain", "__said").alias("access"))


def use_forms(graph: Graph, uses: DataFrame) -> DataFrame:
    """id, form and form_head: of each use (column id) the least around it that says what it is: the
    call that it calls, the selection that selects it, the designator that it is in; else itself;
    and that form's head. Uses that are rows of the graph's nodes, with their columns, are taken as
    they are, and no node is looked up; of ids alone, repeated ones give one row."""
    columns = _with_above(graph, "id", "parent_id", "ord", "head", "in_call")
    if set(columns) <= set(uses.columns):
        mine = uses.select(columns)
    else:
        mine = graph.nodes.select(columns).join(uses.select("id").distinct(), "id", "left_semi")
    rows = materialise(_above(graph, mine), "uses")
    # A kid at ord 2 or later says itself that there is one; only of a head others are asked.
    asks = F.coalesce(F.col("above").isin("->", ".") & (F.col("ord") < 1), F.lit(False))
    heads = materialise(rows.where(asks), "heads")
    if heads.isEmpty():
        rows = rows.withColumn("last", F.col("ord"))
    else:
        rows = rows.where(~asks).withColumn("last", F.col("ord")).unionByName(heads.join(_lasts(graph, heads), "parent_id", "left").select(*rows.columns, "last"))
    selected = F.col("above").isin("->", ".") & (F.col("last") > 1) & (F.col("ord") != 1)
    outer = F.col("parent_id").isNotNull() & (F.col("in_call") | selected | (F.col("above") == "at"))
    return rows.select("id", F.when(outer, F.col("parent_id")).otherwise(F.col("id")).alias("form"), F.when(outer, F.col("above")).otherwise(F.col("head")).alias("form_head"))


def tally(graph: Graph, roots: DataFrame, held: bool = False) -> DataFrame:
    """Uses of each root (column id) by what they do: root, access, place (of the access in LABELS),
    n and forms, the holders that they are in. `held` as follow() has it."""
    found = materialise(graph.follow(roots, "refers<", held).select("root", "node"), "found")
    rows = found.join(_access(graph, found.select(F.col("node").alias("id"))).withColumnRenamed("id", "node"), "node")
    rows = rows.groupBy("root", "access").agg(F.count("*").alias("n"), F.count_distinct("top_id").alias("forms"))
    return rows.withColumn("place", F.array_position(F.array(*map(F.lit, LABELS)), F.col("access")))


def members(graph: Graph, types: DataFrame, most: int = 1_000) -> DataFrame:
    """type and member: the lists within each type (column id), those of an aggregate without a
    name (a list that begins with an aggregate) as its own; static assertions aren't members."""
    lists = graph.nodes.where("atom IS NULL AND parent_id IS NOT NULL AND (head IS NULL OR head <> 'static_assert')").select(F.col("parent_id").alias("within"), F.col("id").alias("member"), "ord")
    inner = graph.nodes.where(F.col("head").isin(*AGGREGATES) & (F.col("ord") == 0)).select(F.col("parent_id").alias("member"), F.col("id").alias("inner"))
    here, out = types.select(F.col("id").alias("type"), F.col("id").alias("within")).distinct(), None
    for _ in range(most):
        found = materialise(here.join(lists, "within").join(inner, "member", "left").select("type", "member", "inner"), "members")
        named = found.where("inner IS NULL").select("type", "member")
        out = named if out is None else out.unionByName(named)
        here = found.where("inner IS NOT NULL").select("type", F.col("inner").alias("within"))
        if here.isEmpty():
            return out
    raise ValueError(f"aggregates within aggregates, over {most} deep")


def type_report(graph: Graph, types: DataFrame) -> DataFrame:
    """All that has to do with each type (column id), a row a node and access: type, section, node,
    access and n.

    Sections: members (enumerators of an enum) with their uses by access (null and 0 where there
    are none); and, of the type or pointers to or arrays of it at any depth: taking and returning,
    functions with n such params or results; held-in, members of other aggregates; objects, the
    first definitions at the top. Types that are rows of the graph's nodes, with their heads, aren't
    looked up.
    """
    nodes = graph.nodes
    kinds = types.select("id", "head").distinct() if "head" in types.columns else nodes.select("id", "head")
    lists = members(graph, types).join(kinds.withColumnRenamed("id", "type"), "type")
    section = F.when(F.col("head").isin("enum", "extern-enum"), "enumerators").otherwise("members")
    own = lists.select("type", section.alias("section"), F.col("member").alias("node"))
    found = tally(graph, own.select(F.col("node").alias("id")).distinct(), held=True).select(F.col("root").alias("node"), "access", "n")
    used = own.join(found, "node", "left").select("type", "section", "node", "access", F.coalesce("n", F.lit(0)).alias("n"))

    typed = _edges(graph, "typed")
    steps = nodes.where(F.col("head").isin("pointer", "array")).select(F.col("id").alias("src")).join(typed, "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = types.select(F.col("id").alias("seed"), "id")
    reach = closure(seeds, steps).select(F.col("seed").alias("type"), F.col("id").alias("dst"))
    # Nodes that no section tells of aren't dealt out.
    told = nodes.where(F.col("head").isin("param", "result", "member", "def")).select(*_with_above(graph, "id", "parent_id", "head", "top_id", "rep_id"))
    rows = reach.join(typed, "dst").select("type", F.col("src").alias("id")).distinct().join(told, "id")
    if "above" not in rows.columns:
        above = nodes.where(F.col("head").isin("struct", "union")).select(F.col("id").alias("parent_id"), F.col("head").alias("above"))
        rows = rows.join(above, "parent_id", "left")
    functions = F.when(F.col("head") == "param", "taking").when(F.col("head") == "result", "returning")
    held = F.when((F.col("head") == "member") & F.col("above").isin("struct", "union") & (F.col("parent_id") != F.col("type")), "held-in")
    objects = F.when((F.col("head") == "def") & F.col("parent_id").isNull() & (F.col("rep_id") == F.col("id")), "objects")
    rows = rows.withColumn("section", F.coalesce(functions, held, objects)).where("section IS NOT NULL")
    rows = rows.withColumn("node", F.when(functions.isNotNull(), F.col("top_id")).otherwise(F.col("id"))).groupBy("type", "section", "node").agg(F.count("*").alias("n"))
    return used.unionByName(rows.select("type", "section", "node", F.lit(None).cast("string").alias("access"), "n"))


def size(levels: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """One row of counts over a view's levels(): kids, links included, and its contexts()."""
    kids = levels.agg(F.count("*").alias("kids"))
    if contexts is None:
        return kids.withColumn("contexts", F.lit(0).cast("bigint"))
    return kids.join(contexts.agg(F.count("*").alias("contexts")))
