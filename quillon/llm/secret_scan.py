"""Operator 2, secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidate values are hashed and counted by distinct repositories and owners: values that many of
either have are widely copied examples, values of few are live-looking credentials.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import apart, table

#: Kinds in their order, with pattern, the group that is the value, and its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What the method adds: long mixed-case runs with a digit, kept where they look live.
ADDED = ("key", r"[A-Za-z0-9_-]+", 32)
#: Distinct owners, and distinct repositories, above which a value is a widely copied example.
MAX_OWNERS, MAX_REPOS = 3, 100


def _matches(text: Column, kind: int, pattern: str, value_of: int, prefilter: str) -> Column:
    """The leftmost non-overlapping matches in order: kind, k (from 0), the characters between the
    match before and this one, its own, and its value. `prefilter` matches every text that can have
    a match that counts; others skip the rest."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_of))
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    each = F.transform(zipped, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), x["value"].alias("value")))
    return F.when(F.rlike(text, F.lit(prefilter)), each).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,value:string>>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source") -> DataFrame:
    """doc_id, repo, owner and matches (kind, k, gap, size, value) of every document."""
    least = {name: n for name, _, _, n in KINDS}
    fast = {
        "assign": r"(?i:password|passwd|secret|token|api_?key)",
        "access": rf"AKIA[A-Z0-9]{{{least['access'] - 4},}}",
        "hex": rf"[0-9a-f]{{{least['hex']},}}",
    }
    # A run at least as long as its kind's least length is found alike by the shortened pattern.
    pattern = {"access": fast["access"], "hex": fast["hex"]}
    parts = [_matches(F.col("text"), k, pattern.get(name, p), group, fast[name]) for k, (name, p, group, _) in enumerate(KINDS)]
    _, p, n = ADDED
    long = p.removesuffix("+") + f"{{{n},}}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.col(repo_col).cast("string") if repo_col else F.hex(F.xxhash64(F.lit("repo"), text))
    rows = docs.select(F.col(id_col).alias("doc_id"), repo.alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    return rows.select("doc_id", "repo", "owner", F.concat(*parts, _matches(F.col("text"), len(KINDS), long, 0, long)).alias("matches"))


def _counts(m: Column) -> Column:
    """Whether a match is a candidate: long enough for its kind, and mixed if of the added one."""
    long = reduce(Column.__or__, [(m["kind"] == k) & (F.length(m["value"]) >= n) for k, (*_, n) in enumerate(KINDS)])
    return long | (m["kind"] == len(KINDS)) & m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]") & m["value"].rlike("[0-9]")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos and n_owners of every candidate value: distinct repositories and owners.

    Null repositories or owners count as one unknown one. The distinct pairs are aggregated
    before each shuffle, so a value that a third of all rows hold is a few rows by then.
    """
    each = found.select("repo", "owner", F.explode("matches").alias("m")).where(_counts(F.col("m")))
    each = each.select(F.xxhash64("m.value", F.lit(7)).alias("hash"), F.coalesce("repo", F.lit("\x00")).alias("repo"), F.coalesce("owner", F.lit("\x00")).alias("owner"))
    pairs = each.groupBy("hash", "repo", "owner").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = pairs.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "hash")


def spans(found: DataFrame) -> DataFrame:
    """row, kind, start, stop (code points, end exclusive) and value of every candidate of the rows:
    a running sum over each row's matches of a kind, those that don't count included."""
    each = found.where(F.size("matches") > 0).select("row", F.explode("matches").alias("m"))
    before = Window.partitionBy("row", "m.kind").orderBy("m.k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("stop", F.sum(F.col("m.gap").cast("bigint") + F.col("m.size")).over(before))
    return each.where(_counts(F.col("m"))).select("row", "m.kind", (F.col("stop") - F.col("m.size")).alias("start"), "stop", "m.value")


def secret_scan(docs: DataFrame, max_owners: int = MAX_OWNERS, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", max_repos: int = MAX_REPOS) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example.

    spans joins kind:start:end (code points, end exclusive) of all spans by start, then kind;
    base_sha256 is the SHA-256 of the same of the base kinds. A value is a widely copied example
    if more than `max_owners` owners or more than `max_repos` repositories have it (without
    repo_col every different text is a repository, so copies of a text are one), else it looks
    live. Spans of the added kind are those of live-looking values. n_live counts the spans, base
    and added, of such values, n_example the base spans of other values. A null text is empty.
    Repeated ids and rows stay rows of their own; an empty table gives an empty table; other
    columns aren't read, so their names may clash. The time is linear in a text's matches.
    """
    found = table(candidates(docs, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "secrets")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    counts = ownership(found).select("hash", live.alias("live"))
    each = spans(found).withColumn("hash", F.xxhash64("value", F.lit(7)))
    judged = each.join(apart(counts, "hash"), "hash").where((F.col("kind") < len(KINDS)) | F.col("live"))
    said = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "live"))).alias("all"))
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit(ADDED[0]))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    rows = found.select("doc_id", "row").join(said, "row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,live:boolean>>"))
    rows = rows.select("doc_id", every.alias("all"))
    base = F.filter("all", lambda s: s["kind"] < len(KINDS))
    count = lambda test: F.size(F.filter("all", test)).cast("bigint")
    return rows.select(
        "doc_id",
        *(count(_is_kind(k)).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )


def _is_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k
