"""Readers and writers of forms: S-expressions and EDN as rows of nodes, CSV, JSON and text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.graph import Graph
from quillon.plans.tables import materialise

NODES = "unit bigint, id string, parent_id string, ord bigint, head string, atom string, label string"
#: What index() needs of a form's place, for read_forms(places=True).
PLACED = "above string, __depth int, __size bigint, __root string, __local bigint, __part int"
EDGES = "src string, dst string, kind string"
TOKEN = re.compile(r'\(|\)|"(?:[^"\\]|\\.)*"|[^\s()"]+')
STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
#: All bytes but parentheses.
OTHERS = bytes(b for b in range(256) if b not in b"()")


def read_forms(units: DataFrame, unit: str = "unit", text: str = "text", places: bool = False) -> Graph:
    """The graph of S-expressions, one top form a row. Nodes are named by unit and place; an atom
    @NAME refers to the form (head NAME ...) of that name, in any unit.

    With `places`, top forms are dealt out in the source's order before they are read, so that nodes
    are written with their place in it, and index() has no trees to join. Nodes have `above` then, the
    head of the form around them. A unit's number may not stand in two rows."""
    names = [c.split()[0] for c in f"{NODES}, {PLACED}".split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in f"{NODES}, {PLACED}".split(", ")]
    own = len(NODES.split(", "))

    def batch_of(columns: list[list], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(own + 4)]
            for u, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _read(int(u), t or "", out)
            yield batch_of(out[:own], names[:own])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for u, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, form in enumerate(_tops(int(u), t or "")):
                    for column, value in zip(out, (u, k, f"{u}.{k}", form), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["unit", "ord", "id", "text"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            out = [[] for _ in range(own + 4)]
            for u, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _read(int(u), t, out, k)
            n = len(out[0])
            yield batch_of([*out, range(local, local + n), [part] * n], names)
            local += n

    texts = units.select(F.col(unit).cast("bigint").alias("unit"), F.col(text).alias("text"))
    if places:
        texts = texts.mapInArrow(split, "unit bigint, ord bigint, id string, text string")
        texts = texts.repartitionByRange("ord", "id").sortWithinPartitions("ord", "id").select("unit", "ord", "text")
        nodes = materialise(texts.mapInArrow(placed, f"{NODES}, {PLACED}"), "forms")
    else:
        nodes = materialise(texts.mapInArrow(run, NODES), "forms")
    uses = nodes.where("atom LIKE '@%'").select(F.col("id").alias("src"), F.substring("atom", 2, 1 << 30).alias("label"))
    # As tables: where few names are used, however often, they are broadcast.
    asked = materialise(uses.select("label").distinct(), "names")
    names = nodes.where("label IS NOT NULL AND parent_id IS NULL").join(asked, "label", "left_semi")
    names = materialise(names.groupBy("label").agg(F.min_by("id", F.struct("unit", "id")).alias("dst")), "names")
    return Graph(nodes, uses.join(names, "label").select("src", "dst", F.lit("refers").alias("kind")), placed=places)


def _tops(unit: int, text: str) -> Iterator[str]:
    """The top forms of a unit's text."""
    if _one_list(text):
        yield text
        return
    depth = begin = 0
    for token in TOKEN.finditer(text):
        begin = begin if depth else token.start()
        depth += (token[0] == "(") - (token[0] == ")")
        if depth < 0:
            raise ValueError(f"unit {unit}: unexpected )")
        if not depth:
            yield text[begin : token.end()]
    if depth:
        raise ValueError(f"unit {unit}: missing )")


def _one_list(text: str) -> bool:
    """Whether the text is one list from its first character to its last: by its parentheses alone."""
    if text[:1] != "(" or text[-1:] != ")":
        return False
    depth, marks = 0, (STRING.sub("", text) if '"' in text else text).encode("utf-8", "surrogatepass").translate(None, OTHERS)
    for n, mark in enumerate(marks, 1):
        depth += 1 if mark == 40 else -1
        if depth <= 0:
            return not depth and n == len(marks)
    return False


def _read(unit: int, text: str, out: list[list], roots: int = 0) -> None:
    """Appends the nodes of one unit's forms, of which the first is its top form `roots`, to the columns
    of NODES, above, depth, size and root; a list's head is its first atom, its label the second."""
    units, ids, parents, ords, heads, atoms, labels, aboves, depths, sizes, tops = out
    stack, kids = [], []
    for token in TOKEN.findall(text):
        if token == ")":
            if not stack:
                raise ValueError(f"unit {unit}: unexpected )")
            at = stack.pop()
            kids.pop()
            sizes[at] = len(ids) - at
            continue
        depths.append(len(stack))
        if stack:
            at, place = stack[-1], kids[-1]
            kids[-1] += 1
            if token != "(":
                if place == 0:
                    heads[at] = token
                elif place == 1:
                    labels[at] = token
            name, parent, above, top = f"{ids[at]}.{place}", ids[at], heads[at], tops[at]
        else:
            name, parent, above, place = f"{unit}.{roots}", None, None, roots
            top = name
            roots += 1
        if token == "(":
            stack.append(len(ids))
            kids.append(0)
            atoms.append(None)
        else:
            atoms.append(token)
        units.append(unit)
        ids.append(name)
        parents.append(parent)
        ords.append(place)
        heads.append(None)
        labels.append(None)
        aboves.append(above)
        sizes.append(1)
        tops.append(top)
    if stack:
        raise ValueError(f"unit {unit}: missing )")


def write_forms(graph: Graph) -> DataFrame:
    """id and text of every node, printed; top forms are those without a parent. Level by level
    from the leaves; needs an indexed graph."""
    deepest = graph.nodes.agg(F.max("depth")).first()[0]
    out = below = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        here = graph.nodes.where(F.col("depth") == d).select("id", "parent_id", "ord", "atom")
        if below is None:
            level = here.withColumn("text", F.coalesce("atom", F.lit("()")))
        else:
            kids = below.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("k"))
            joined = F.concat(F.lit("("), F.array_join(F.coalesce(F.col("k.text"), F.array().cast("array<string>")), " "), F.lit(")"))
            level = here.join(kids, "id", "left").withColumn("text", F.coalesce("atom", joined))
        below = materialise(level.select("id", "parent_id", "ord", "text"), "text")
        out = below if out is None else out.unionByName(below)
    return out.select("id", "parent_id", "text")


def edn_to_json(text: str) -> str:
    """JSON of one EDN value: keywords and symbols are strings (:k with its colon cut), sets and
    lists are arrays, map keys are strings; tagged values are their value."""
    import json

    tokens = re.findall(r'#\{|[\[\](){}]|"(?:[^"\\]|\\.)*"|#[^\s\[\](){}"]+|\\(?:\w+|\S)|[^\s,\[\](){}"]+', re.sub(r'("(?:[^"\\]|\\.)*")|;[^\n]*', r"\1", text))
    at = 0

    def read():
        nonlocal at
        t = tokens[at]
        at += 1
        if t in ("(", "[", "{", "#{"):
            end = {"(": ")", "[": "]", "{": "}", "#{": "}"}[t]
            items = []
            while tokens[at] != end:
                items.append(read())
            at += 1
            return {str(k): v for k, v in zip(items[::2], items[1::2], strict=True)} if t == "{" else items
        if t[0] == '"':
            return json.loads(t)
        if t[0] == "#":
            return read()
        if t[0] == "\\":
            return {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}.get(t[1:], t[1:])
        if t in ("nil", "true", "false"):
            return {"nil": None, "true": True, "false": False}[t]
        if re.fullmatch(r"[+-]?\d+[NM]?", t):
            return int(t.rstrip("NM"))
        if re.fullmatch(r"[+-]?\d+\.?\d*([eE][+-]?\d+)?M?", t):
            return float(t.rstrip("M"))
        return t[1:] if t[0] == ":" else t

    value = read()
    if at != len(tokens):
        raise ValueError("more than one value")
    return json.dumps(value)


def read_edn(df: DataFrame, text: str, schema: str | None = None) -> DataFrame:
    """df with `value`: the EDN text as VARIANT, or by a schema."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else edn_to_json(x))

    json_ = run(F.col(text))
    return df.withColumn("value", F.parse_json(json_) if schema is None else F.from_json(json_, schema))


def line_seq(spark: SparkSession, path: str) -> DataFrame:
    """path, ln and line of text files, in the files' order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\r?\n", -1)).alias("ln", "line"))
    return lines.withColumn("ln", (F.col("ln") + 1).cast("bigint"))


def slurp(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def spit(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").text(path)


def csv_seq(spark: SparkSession, path: str, schema: str, separator: str = ",", comment: str | None = None, header: bool = False, trim: bool = False) -> DataFrame:
    """Records of CSV files; a malformed one raises."""
    options = {"sep": separator, "header": header, "mode": "FAILFAST", "ignoreLeadingWhiteSpace": trim}
    return spark.read.schema(schema).options(**options | ({"comment": comment} if comment else {})).csv(path)


def csv_write(df: DataFrame, path: str, separator: str = ",", header: bool = False) -> None:
    df.write.mode("overwrite").options(sep=separator, header=header).csv(path)


def json_seq(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def xml_seq(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)
