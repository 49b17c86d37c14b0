"""The registered queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import codecs, collections, core, maths, strings, times
from quillon.functions.walk import for_
from quillon.operators import rel
from quillon.operators.seq import Seq, cycle, iterate, merge, merge_with, range_, repeat, tree_seq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of a table reader; its name is the query's."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- relational algebra ----------------------------------------------------------------------


@query("SELECT DISTINCT * FROM customer WHERE c_acctbal > 5000")
def rel_select(t):
    return rel.select(t("customer"), F.col("c_acctbal") > 5000)


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def rel_project(t):
    return rel.project(t("customer"), ["c_nationkey", "c_mktsegment", "absent"])


@query("SELECT DISTINCT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation")
def rel_rename(t):
    return rel.rename(t("nation"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"})


@query("SELECT DISTINCT c_custkey, c_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey IS NOT DISTINCT FROM n_nationkey")
def rel_join_natural(t):
    return rel.join(rel.project(t("customer"), ["c_custkey", "c_nationkey"]), rel.rename(t("nation"), {"n_nationkey": "c_nationkey"}))


@query("SELECT DISTINCT r_regionkey, r_name, s FROM region, (SELECT DISTINCT c_mktsegment AS s FROM customer)")
def rel_join_no_common(t):
    return rel.join(t("region"), rel.rename(rel.project(t("customer"), ["c_mktsegment"]), {"c_mktsegment": "s"}))


@query("SELECT DISTINCT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def rel_join_keymap(t):
    return rel.join_on(rel.project(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"]), t("customer"), {"o_custkey": "c_custkey"})


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation")
def rel_union(t):
    return rel.union(*_keys(t))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer INTERSECT SELECT n_nationkey FROM nation")
def rel_intersection(t):
    return rel.intersection(*_keys(t))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def rel_difference(t):
    return rel.difference(_keys(t)[2], t("supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k")))


@query("SELECT (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation)) = 0 AS is_subset")
def rel_subset(t):
    supplier, _, nation = _keys(t)
    return rel.difference(supplier, nation).agg((F.count("*") == 0).alias("is_subset"))


def _keys(t):
    return [t(n).select(F.col(c).alias("k")) for n, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"))]


@query("SELECT p_brand, count(DISTINCT (p_partkey, p_size)) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def rel_index(t):
    rows = rel.index(t("part").select("p_brand", "p_partkey", "p_size"), ["p_brand"])
    return rows.select("p_brand", F.size("rows").cast("bigint").alias("n"), F.array_min("rows.p_partkey").alias("first"))


@query("SELECT n_nationkey, n_name AS nation, n_regionkey AS region FROM nation")
def rel_rename_keys(t):
    m = F.create_map(F.lit("n_name"), F.col("n_name"), F.lit("key"), F.col("n_regionkey").cast("string"))
    out = t("nation").select("n_nationkey", rel.rename_keys(m, {"n_name": "nation", "key": "region"}).alias("m"))
    return out.select("n_nationkey", F.col("m.nation").alias("nation"), F.col("m.region").cast("int").alias("region"))


@query("SELECT n_nationkey, n_name AS name FROM nation")
def rel_map_invert(t):
    m = rel.map_invert(F.create_map(F.lit("name"), F.col("n_name")))
    return t("nation").select("n_nationkey", F.map_keys(m)[0].alias("name"))


# -- sequences -------------------------------------------------------------------------------


def _events(t, by: bool = True) -> Seq:
    return Seq(t("events").select("event_id", "ts", "user_id", "event_type", "value"), ("ts", "event_id"), ("user_id",) if by else ())


@query("SELECT event_type AS key, list(event_id ORDER BY ts, event_id)::VARCHAR AS ids, count(*) AS n FROM events GROUP BY 1")
def seq_group_by(t):
    out = _events(t, False).group_by(F.col("event_type"), F.col("event_id"))
    return out.select("key", F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]")).alias("ids"), F.size("items").cast("bigint").alias("n"))


@query("SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place, value AS item FROM events")
def seq_grouped(t):
    return _events(t, False).grouped(F.col("event_type"), F.col("value"))


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def seq_frequencies(t):
    return _events(t, False).frequencies(F.col("event_type"))


@query("SELECT key, sum(value)::BIGINT AS value FROM (SELECT l_suppkey AS key, l_quantity::BIGINT AS value FROM lineitem UNION ALL SELECT s_suppkey, s_nationkey FROM supplier) GROUP BY 1")
def seq_merge_with(t):
    a = t("lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("bigint").alias("value"))
    return merge_with(F.sum, a, t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("bigint").alias("value")))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders")
def seq_reductions(t):
    out = Seq(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ("o_orderdate", "o_orderkey"), ("o_custkey",)).reductions(F.sum, F.col("o_totalprice"), "total")
    return out.select("o_orderkey", F.round("total", 2).alias("total"))


@query("SELECT event_id, sum(event_id) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM events")
def seq_reductions_global(t):
    return _events(t, False).reductions(F.sum, F.col("event_id"), "total").select("event_id", "total")


_PARTITION = """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
w AS (SELECT user_id, rn AS start FROM n WHERE rn % {step} = 0)
SELECT w.user_id, start // {step} AS "window", '[' || string_agg(event_id, ',' ORDER BY rn) || ']' AS items
FROM w JOIN n ON n.user_id = w.user_id AND rn BETWEEN start AND start + {size} - 1 GROUP BY ALL {having}
"""


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")).alias("items"))


@query(_PARTITION.format(size=3, step=2, having="HAVING count(*) = 3"))
def seq_partition(t):
    return _listed(_events(t).partition(3, F.col("event_id"), 2), "user_id", "window")


@query(_PARTITION.format(size=4, step=4, having=""))
def seq_partition_all(t):
    return _listed(_events(t).partition_all(4, F.col("event_id")), "user_id", "window")


_RUNS = """
WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS change FROM events WINDOW w AS ({by} ORDER BY ts, event_id)),
r AS (SELECT *, (sum(change) OVER ({by} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM c)
"""


@query(_RUNS.format(by="PARTITION BY user_id") + "SELECT user_id, run, event_type AS key, '[' || string_agg(event_id, ',' ORDER BY ts, event_id) || ']' AS items FROM r GROUP BY ALL")
def seq_partition_by(t):
    return _listed(_events(t).partition_by(F.col("event_type"), F.col("event_id")), "user_id", "run", "key")


@query(_RUNS.format(by="") + "SELECT event_id, run FROM r")
def seq_runs_global(t):
    return _events(t, False).runs(F.col("event_type")).select("event_id", "run")


@query(_RUNS.format(by="PARTITION BY user_id") + "SELECT user_id, event_id, event_type FROM r WHERE change = 1")
def seq_dedupe(t):
    return _events(t).dedupe(F.col("event_type")).df.select("user_id", "event_id", "event_type")


_NUMBERED = "WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events), s AS (SELECT coalesce(min(rn), 1000000000) AS stop FROM n WHERE NOT value < {most}) "


@query(_NUMBERED.format(most=95) + "SELECT event_id FROM n, s WHERE rn < stop")
def seq_take_while(t):
    return _events(t, False).take_while(F.col("value") < 95).df.select("event_id")


@query(_NUMBERED.format(most=95) + "SELECT event_id FROM n, s WHERE rn >= stop")
def seq_drop_while(t):
    return _events(t, False).drop_while(F.col("value") < 95).df.select("event_id")


@query("WITH n AS (SELECT *, row_number() OVER w AS rn, bool_and(value < 50) OVER (w ROWS UNBOUNDED PRECEDING) AS good FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) FILTER (good) AS taken, count(*) FILTER (NOT good) AS dropped FROM n GROUP BY 1")
def seq_split_with(t):
    a, b = _events(t).split_with(F.col("value") < 50)
    rows = a.df.withColumn("side", F.lit(0)).unionByName(b.df.withColumn("side", F.lit(1)))
    return rows.groupBy("user_id").agg(F.count_if(F.col("side") == 0).alias("taken"), F.count_if(F.col("side") == 1).alias("dropped"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) WHERE (rn - 1) % 7 = 0")
def seq_take_nth(t):
    return _events(t, False).take_nth(7).df.select("event_id")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 25")
def seq_take(t):
    return _events(t, False).take(25).df.select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 100")
def seq_drop(t):
    return _events(t, False).drop(100).df.select("event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def seq_take_last(t):
    return _events(t, False).take_last(10).df.select("event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= n - 2")
def seq_drop_last(t):
    return _events(t).drop_last(2).df.select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 3")
def seq_nth(t):
    return _events(t).nth(2).df.select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def seq_sort_by(t):
    return Seq(t("orders"), ("o_orderkey",), ("o_custkey",)).sort_by("o_orderpriority").take(1).df.select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def seq_max_key(t):
    return Seq(t("orders"), ("o_orderkey",), ("o_custkey",)).max_key(F.col("o_orderpriority")).df.select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders o WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY 1")
def seq_min_key(t):
    return Seq(t("orders"), ("o_orderkey",), ("o_custkey",)).min_key(F.col("o_orderpriority")).df.select("o_custkey", "o_orderkey")


@query("SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def seq_distinct(t):
    return _events(t, False).distinct("event_type").df.select("event_type", "event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 + event_id AS mapped FROM events")
def seq_map_indexed(t):
    return _events(t).map_indexed(lambda i, v: i + v, F.col("event_id")).select("event_id", "mapped")


@query("WITH s AS (SELECT s_suppkey AS k, 0 AS q, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier), n AS (SELECT n_nationkey AS k, 1 AS q, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) SELECT k::BIGINT AS k, q AS __seq, p AS __place FROM (FROM s UNION ALL FROM n) WHERE p <= least((SELECT count(*) FROM supplier), (SELECT count(*) FROM nation))")
def seq_interleave(t):
    a = Seq(t("supplier").select(F.col("s_suppkey").alias("k")), ("k",))
    b = Seq(t("nation").select(F.col("n_nationkey").cast("bigint").alias("k")), ("k",))
    return a.interleave(b).select("k", "__seq", "__place")


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS items FROM events GROUP BY 1")
def seq_interpose(t):
    return _events(t).interpose(F.col("event_type"), F.lit("|")).select("user_id", F.array_join("items", "").alias("items"))


@query("WITH a AS (SELECT event_id AS a, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events), b AS (SELECT o_orderkey AS b, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) SELECT a, b FROM a JOIN b USING (rn)")
def seq_zip(t):
    a = Seq(t("events").select(F.col("event_id").alias("a"), "ts"), ("ts", "a"))
    return a.zip(Seq(t("orders").select(F.col("o_orderkey").alias("b"), "o_orderdate"), ("o_orderdate", "b"))).select("a", "b")


@query("SELECT user_id, list_reduce([0] || list(event_id ORDER BY ts, event_id), lambda a, x: (a * 31 + x) % 1000003)::BIGINT AS reduced FROM events GROUP BY 1")
def seq_reduce(t):
    return _events(t).reduce(F.lit(0).cast("bigint"), lambda a, x: (a * 31 + x) % 1000003, F.col("event_id"))


_PLACES = "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) "


@query(_PLACES + "SELECT what, user_id, event_id FROM n, (VALUES ('first'), ('second'), ('rest'), ('last'), ('butlast'), ('subvec'), ('nth_rest'), ('left'), ('right')) v(what) WHERE CASE what WHEN 'first' THEN rn = 1 WHEN 'second' THEN rn = 2 WHEN 'rest' THEN rn > 1 WHEN 'last' THEN rn = n WHEN 'butlast' THEN rn < n WHEN 'subvec' THEN rn IN (2, 3) WHEN 'nth_rest' THEN rn > 3 WHEN 'left' THEN rn <= 4 ELSE rn > 4 END")
def seq_positions(t):
    s = _events(t)
    left, right = s.split_at(4)
    parts = {"first": s.first(), "second": s.second(), "rest": s.rest(), "last": s.last(), "butlast": s.butlast(), "subvec": s.subvec(1, 3), "nth_rest": s.nth_rest(3), "left": left, "right": right}
    rows = [p.df.select(F.lit(what).alias("what"), "user_id", "event_id") for what, p in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT event_id, 'keep' AS what, nullif(event_type, 'click') AS kept FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, 'indexed', (rn * 2)::VARCHAR FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) WHERE rn % 2 = 1 UNION ALL SELECT event_id, 'filter', event_type FROM events WHERE value > 50")
def seq_keep(t):
    s = _events(t)
    rows = [s.keep(F.nullif(F.col("event_type"), F.lit("click"))), s.keep_indexed(lambda i, _: F.when(i % 2 == 1, (i * 2).cast("string")), F.col("event_type")), s.filter(F.col("value") > 50).df.withColumn("kept", F.col("event_type"))]
    return reduce(DataFrame.unionByName, [r.select("event_id", F.lit(what).alias("what"), "kept") for r, what in zip(rows, ("keep", "indexed", "filter"), strict=True)])


@query("WITH c AS (SELECT 0 AS q, s_suppkey AS k FROM supplier UNION ALL SELECT 1, n_nationkey FROM nation) SELECT q AS __seq, k, row_number() OVER (ORDER BY q, k) AS rn FROM c")
def seq_concat(t):
    a = Seq(t("supplier").select(F.col("s_suppkey").alias("k")), ("k",))
    return a.concat(Seq(t("nation").select(F.col("n_nationkey").cast("bigint").alias("k")), ("k",))).numbered()


@query("SELECT n_nationkey AS k, r AS __round FROM nation, range(1, 4) t(r)")
def seq_cycle(t):
    return cycle(t("nation").select(F.col("n_nationkey").alias("k")), ["k"], 3)


@query("SELECT 'iterate' AS what, i AS place, (3 ** i)::BIGINT AS value FROM range(12) t(i) UNION ALL SELECT 'repeat', i, 7 FROM range(5) t(i) UNION ALL SELECT 'range', NULL, i FROM range(2, 40, 5) t(i)")
def seq_generators(t):
    spark = t("region").sparkSession
    rows = iterate(spark, lambda x: x * 3, F.lit(1).cast("bigint"), 12).select(F.lit("iterate").alias("what"), F.col("place").cast("bigint").alias("place"), "value")
    rows = rows.unionByName(repeat(spark, 5, F.lit(7).cast("bigint")).select(F.lit("repeat").alias("what"), "place", "value"))
    return rows.unionByName(range_(spark, 2, 40, 5).select(F.lit("range").alias("what"), F.lit(None).cast("bigint").alias("place"), "value"))


@query("SELECT coalesce(s_suppkey, c_custkey) AS key, CASE WHEN c_custkey IS NOT NULL THEN nullif(c_nationkey, 3) ELSE s_nationkey END AS value FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def seq_merge(t):
    return merge(t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("value")), t("customer").select(F.col("c_custkey").alias("key"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("value")))


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events), w AS (SELECT user_id, rn // 4 AS w, list(event_id ORDER BY rn) AS l FROM n GROUP BY ALL) SELECT user_id, w AS \"window\", '[' || array_to_string((l || [-1, -2])[:4], ',') || ']' AS items FROM w")
def seq_partition_pad(t):
    return _listed(_events(t).partition(4, F.col("event_id"), pad=F.array(F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint"))), "user_id", "window")


@query("SELECT user_id, NOT bool_and(value < 90) AS not_every FROM events GROUP BY 1")
def seq_not_every(t):
    return _events(t).not_every(F.col("value") < 90)


@query("SELECT count(DISTINCT user_id) AS n, true AS held FROM events")
def seq_random(t):
    """Samples are checked by what they can't be: no row twice, one row a sequence."""
    s = _events(t)
    one = s.rand_nth(3).df
    some = s.random_sample(0.5, 1)
    held = (some.distinct().count() <= s.df.count()) & (s.shuffle(2).count() == s.df.count()) & (s.bounded_count(7) == 7)
    return one.agg(F.count_distinct("user_id").alias("n"), (F.count("*") == F.count_distinct("user_id")).alias("h")).select("n", (F.col("h") & F.lit(bool(held))).alias("held"))


_NULL_KEYS = "WITH a AS (SELECT nullif(o_custkey % 5, 0) AS k, o_orderkey AS v, row_number() OVER (PARTITION BY nullif(o_custkey % 5, 0) ORDER BY o_orderkey) AS rn FROM orders), b AS (SELECT nullif(c_custkey % 5, 0) AS k, c_custkey AS w, row_number() OVER (PARTITION BY nullif(c_custkey % 5, 0) ORDER BY c_custkey) AS rn FROM customer) "


@query(_NULL_KEYS + "SELECT a.k AS k, v, w FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.rn = b.rn")
def seq_zip_null_keys(t):
    a = Seq(t("orders").select(F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("k"), F.col("o_orderkey").alias("v")), ("v",), ("k",))
    return a.zip(Seq(t("customer").select(F.nullif(F.col("c_custkey") % 5, F.lit(0)).alias("k"), F.col("c_custkey").alias("w")), ("w",), ("k",))).select("k", "v", "w")


@query("SELECT (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation)) = 0 AS superset, (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)) = 0 AS subset")
def rel_superset(t):
    supplier, _, nation = _keys(t)
    return supplier.sparkSession.createDataFrame([(rel.is_superset(nation, supplier), rel.is_subset(nation, supplier))], "superset boolean, subset boolean")


@query("SELECT n_nationkey AS x, y, x * 100 + y AS z FROM nation, unnest(range(0, n_nationkey)) t(y) WHERE y % 2 = 1".replace("x * 100", "n_nationkey * 100"))
def core_for(t):
    source = t("nation").select(F.col("n_nationkey").cast("bigint").alias("x"))
    return for_([("x", source), ("y", F.when(F.col("x") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("x") - 1)))], when=F.col("y") % 2 == 1, let={"z": F.col("x") * 100 + F.col("y")})


@query("SELECT user_id, bool_and(value < 90) AS every FROM events GROUP BY 1")
def seq_every(t):
    return _events(t).every(F.col("value") < 90)


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (value > 90) AS some FROM events GROUP BY 1")
def seq_some(t):
    return _events(t).some(F.when(F.col("value") > 90, F.col("event_id")))


@query("SELECT event_id FROM events WHERE NOT coalesce(nullif(event_type, 'click') > 'm', false)")
def seq_remove(t):
    return _events(t).remove(F.nullif(F.col("event_type"), F.lit("click")) > "m").df.select("event_id")


@query("SELECT 'n' || n_nationkey AS id, 1 AS depth FROM nation UNION ALL SELECT 'r' || r_regionkey, 0 FROM region UNION ALL SELECT 'c' || c_custkey, 2 FROM customer")
def seq_tree_seq(t):
    edges = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.col("n_nationkey").alias("ord"))
    edges = edges.unionByName(t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"), F.col("c_custkey").alias("ord")))
    return tree_seq(edges, t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))).select("id", "depth")


# -- scalars ---------------------------------------------------------------------------------


@query("SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS cap, nullif(instr(c_name, '#'), 0) - 1 AS at, lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INT, '0') AS pad, reverse(c_name) AS rev, replace(c_name, '#', '$1') AS rep, regexp_replace(c_name, '[0-9]', 'x') AS one, string_split(c_name, '#')[1] AS part, trim(c_name) AS trimmed FROM customer")
def str_functions(t):
    n = F.col("c_name")
    return t("customer").select(
        "c_custkey", strings.capitalize(F.col("c_mktsegment")).alias("cap"), strings.index_of(n, F.lit("#")).cast("bigint").alias("at"),
        strings.pad_left(F.col("c_custkey").cast("string"), "0", 6).alias("pad"), strings.reverse(n).alias("rev"), F.expr("replace(c_name, '#', '$1')").alias("rep"),
        strings.replace_first(n, "[0-9]", "x", regex=True).alias("one"), strings.split(n, "#")[0].alias("part"), strings.trim(n).alias("trimmed"),
    )


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]+')::VARCHAR AS nums, nullif(regexp_extract(text, '[A-Z][a-z]+'), '') AS word, substr(text, 3, 5) AS cut, text IS NULL OR regexp_full_match(text, '\\s*') AS blank FROM documents")
def str_regex(t):
    x = F.col("text")
    nums = core.re_seq("[0-9]+", x)
    return t("documents").select("doc_id", F.concat(F.lit("["), F.array_join(nums, ", "), F.lit("]")).alias("nums"), core.re_find("[A-Z][a-z]+", x).alias("word"), core.subs(x, 2, 7).alias("cut"), strings.is_blank(x).alias("blank"))


@query("SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(log10(p_retailprice), 6) AS lg, round(cbrt(p_retailprice), 6) AS cube, floor(p_retailprice / 7) AS fl, ceil(p_retailprice / 7) AS ce, round(sqrt(p_size * p_size + 16.0), 6) AS hyp, greatest(p_size - 25, 0)::DOUBLE AS d, (p_size // 7)::BIGINT AS q, (p_size % 7)::BIGINT AS r, ((((p_size - 20) % 7) + 7) % 7)::BIGINT AS m FROM part")
def math_functions(t):
    p, s = F.col("p_retailprice"), F.col("p_size").cast("bigint")
    r6 = lambda x: F.round(x, 6)
    return t("part").select(
        "p_partkey", r6(maths.log(p)).alias("ln"), r6(maths.log_10(p)).alias("lg"), r6(maths.cube_root(p)).alias("cube"), maths.floor(p / 7).alias("fl"), maths.ceil(p / 7).alias("ce"),
        r6(maths.hypot(s.cast("double"), F.lit(4.0))).alias("hyp"), maths.dim(s, F.lit(25)).alias("d"), core.quot(s, F.lit(7)).alias("q"), core.rem(s, F.lit(7)).alias("r"), core.mod(s - 20, F.lit(7)).alias("m"),
    )


@query("SELECT p_partkey, p_size / gcd(p_size, 12) AS num, 12 / gcd(p_size, 12) AS den FROM part".replace(" / ", " // "))
def math_ratio(t):
    r = core.ratio(F.col("p_size"), F.lit(12))
    return t("part").select("p_partkey", core.numerator(r).alias("num"), core.denominator(r).alias("den"))


@query("SELECT o_orderkey, bit_count(o_orderkey)::INT AS n, (o_orderkey & 12) AS a, (o_orderkey | 8) AS s, xor(o_orderkey, 4) AS f, (o_orderkey >> 2) AS r, (o_orderkey & 2) > 0 AS t FROM orders")
def math_bits(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", core.bit_count(k).alias("n"), k.bitwiseAND(12).alias("a"), core.bit_set(k, 3).alias("s"), core.bit_flip(k, 2).alias("f"), core.bit_shift_right(k, 2).alias("r"), core.bit_test(k, 1).alias("t"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def time_truncate(t):
    return t("events").groupBy(times.truncate_time(F.col("ts"), "hour").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, epoch(o_orderdate)::BIGINT AS unix, dayofyear(o_orderdate)::INT AS day, (o_orderdate + INTERVAL 90 SECOND)::VARCHAR AS later, (make_date(year(o_orderdate), month(o_orderdate), 1) + INTERVAL 1 MONTH + to_days((day(o_orderdate) - 1)::INT))::DATE::VARCHAR AS month FROM orders")
def time_functions(t):
    d = F.col("o_orderdate").cast("timestamp")
    return t("orders").select(
        "o_orderkey", times.format_(d, "2006-01-02T15:04:05").alias("iso"), times.unix(d).alias("unix"), times.day_of_year(d).alias("day"),
        F.date_format(times.add(d, F.lit(90 * times.SECOND)), "yyyy-MM-dd HH:mm:ss").alias("later"), times.add_date(d, F.lit(0), F.lit(1), F.lit(0)).cast("date").cast("string").alias("month"),
    )


@query("SELECT c_custkey, sha256(c_name) AS sha, md5(c_name) AS md, base64(c_name::BLOB) AS b64, lower(hex(c_name)) AS hx, c_name AS back FROM customer")
def crypto_functions(t):
    n = F.col("c_name")
    return t("customer").select("c_custkey", F.lower(F.hex(codecs.sha2(n, 256))).alias("sha"), F.lower(F.hex(codecs.md5(n))).alias("md"), codecs.base64_encode(n).alias("b64"), codecs.hex_encode(n).alias("hx"), codecs.hex_decode(codecs.hex_encode(n)).alias("back"))


@query("SELECT page_id, url_encode(url) AS escaped, url AS back, replace(replace(url, '&', '&amp;'), '<', '&lt;') AS html FROM pages")
def url_functions(t):
    u = F.col("url")
    return t("pages").select("page_id", codecs.query_escape(u).alias("escaped"), codecs.query_unescape(codecs.query_escape(u)).alias("back"), codecs.html_escape(u).alias("html"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, json_object('k', (props->>'k')::BIGINT)::VARCHAR AS out FROM events")
def json_functions(t):
    x = codecs.json_read(F.col("props"), "struct<k:bigint>")
    return t("events").select("event_id", x["k"].alias("k"), codecs.json_write(x).alias("out"))


@query("SELECT n_nationkey, to_base(n_nationkey * 1000, 16) AS hx, n_nationkey * 1000 AS back FROM nation".replace("to_base(n_nationkey * 1000, 16)", "lower(to_base(n_nationkey * 1000, 16))").replace("n_nationkey * 1000 AS back", "(n_nationkey * 1000)::BIGINT AS back"))
def strconv_functions(t):
    k = (F.col("n_nationkey") * 1000).cast("bigint")
    return t("nation").select("n_nationkey", codecs.format_int(k, 16).alias("hx"), codecs.parse_int(codecs.format_int(k, 16), 16).alias("back"))


@query("SELECT user_id, list_sort(list(event_id))[1:3]::VARCHAR AS head, list_sort(list(event_id))[-1] AS last, len(list_filter(list(value), lambda x: x > 50))::INT AS big FROM events GROUP BY 1")
def array_functions(t):
    rows = t("events").groupBy("user_id").agg(F.collect_list("event_id").alias("ids"), F.collect_list("value").alias("vs"))
    head = collections.take(collections.sort(F.col("ids")), 3)
    return rows.select("user_id", F.concat(F.lit("["), F.array_join(head, ", "), F.lit("]")).alias("head"), collections.last(collections.sort(F.col("ids"))).alias("last"), F.size(collections.filter_(F.col("vs"), lambda x: x > 50)).alias("big"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, (props->>'k')::BIGINT + 1 AS up, -1::BIGINT AS missing, 2::INT AS n FROM events")
def map_functions(t):
    m = F.from_json("props", "map<string,bigint>")
    more = collections.assoc(collections.update(m, F.lit("k"), lambda v: v + 1), F.lit("z"), F.lit(0).cast("bigint"))
    return t("events").select("event_id", collections.get(m, F.lit("k")).alias("k"), collections.get(more, F.lit("k")).alias("up"), collections.get(m, F.lit("none"), F.lit(-1).cast("bigint")).alias("missing"), F.size(more).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS level, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code, CASE WHEN c_nationkey < 3 THEN -1 WHEN c_nationkey = 3 THEN 0 ELSE 1 END AS cmp FROM customer")
def core_conditionals(t):
    b = F.col("c_acctbal")
    return t("customer").select("c_custkey", core.cond(b < 0, F.lit("debt"), b < 5000, F.lit("low"), default=F.lit("high")).alias("level"), core.case(F.col("c_mktsegment"), F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2), default=F.lit(0)).alias("code"), core.compare(F.col("c_nationkey"), F.lit(3)).alias("cmp"))
