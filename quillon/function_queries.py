"""Queries of the scalar functions by family, a column for each function, over whole tables: with `n`
and `b` null in part, and arrays and maps made of numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import codecs, core, maths, strings, times, walk
from quillon.functions import collections as coll

from .queries import ORACLE_SQL, QUERIES

_PART = """(SELECT p_partkey AS k, p_size::BIGINT AS a, nullif(p_size % 4, 0)::BIGINT AS n, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b,
 p_retailprice AS x, p_brand AS s, [p_size % 3, p_size % 5, p_size % 3, p_size % 2, p_size % 2] AS v FROM part)"""


def _part(t):
    a = F.col("p_size").cast("bigint")
    rows = t("part").select(F.col("p_partkey").alias("k"), a.alias("a"), F.nullif(a % 4, F.lit(0)).alias("n"), F.when(a % 3 == 0, True).when(a % 3 == 1, False).alias("b"), F.col("p_retailprice").alias("x"), F.col("p_brand").alias("s"))
    return rows.withColumn("v", F.array(*(F.col("a") % m for m in (3, 5, 3, 2, 2)))).withColumn("m", F.create_map(F.lit("a"), F.col("a"), F.lit("n"), F.col("n")))


def family(name: str, columns: Callable[[], list[tuple[str, Column]]], sql: list[str], rows: Callable = _part, table: str = _PART) -> None:
    """Registers a query of k and the columns, against their SQL in the same order."""

    def run(spark, sf_dir):
        df = rows(lambda what: spark.read.parquet(f"{sf_dir}/{what}.parquet"))
        made = columns()
        return df.select("k", *(c.alias(n) for n, c in made))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT k, {', '.join(sql)} FROM {table}"


def said(a: Column) -> Column:
    """An array as text, nulls as -."""
    return F.array_join(a.cast("array<string>"), ",", "-")


A, N, B, X, S, V = (lambda c: lambda: F.col(c))("a"), *((lambda c: lambda: F.col(c))(c) for c in "nbxsv")
L = lambda x: F.lit(x)
N1 = lambda: F.coalesce(N(), F.lit(0).cast("bigint"))

family(
    "core_predicates",
    lambda: [
        ("is_nil", core.is_nil(N())), ("is_some", core.is_some(N())), ("is_true", core.is_true(B())), ("is_false", core.is_false(B())), ("not_", core.not_(B())),
        ("and_", core.and_(B(), N() > 1)), ("or_", core.or_(B(), N() > 1)), ("eq", core.equal(N(), L(2))), ("ne", core.not_equal(N(), L(2))), ("lt", core.lt(L(1), A(), L(40))), ("le", core.le(L(1), A(), L(40))),
        ("gt", core.gt(L(40), A(), L(2))), ("ge", core.ge(L(40), A(), L(2))), ("num_eq", core.num_equal(A(), A().cast("double"))), ("zero", core.is_zero(A() % 5)), ("pos", core.is_pos(A() - 25)), ("neg", core.is_neg(A() - 25)),
        ("even", core.is_even(A() - 25)), ("odd", core.is_odd(A() - 25)), ("nan", core.is_nan(F.when(A() > 9, maths.nan()).otherwise(X()))), ("inf", core.is_infinite(F.when(A() > 9, maths.inf(-1)).otherwise(X()))),
        ("dist", core.is_distinct(A() % 3, A() % 4)), ("cmp", core.compare(N(), L(2))), ("posi", core.is_pos_int(N() - 1)), ("negi", core.is_neg_int(N() - 2)), ("nati", core.is_nat_int(N() - 2)),
        ("kw", core.is_keyword(S())), ("qual", core.is_qualified(F.concat(S(), L("/x")))), ("simple", core.is_simple(S())), ("type", core.type_name(X())),
    ],
    ["n IS NULL AS is_nil", "n IS NOT NULL AS is_some", "b IS NOT DISTINCT FROM true AS is_true", "b IS NOT DISTINCT FROM false AS is_false", "NOT coalesce(b, false) AS not_",
     "CASE WHEN coalesce(b, false) THEN n > 1 ELSE b END AS and_", "CASE WHEN coalesce(b, false) THEN b ELSE n > 1 END AS or_", "n IS NOT DISTINCT FROM 2 AS eq", "n IS DISTINCT FROM 2 AS ne", "1 < a AND a < 40 AS lt", "1 <= a AND a <= 40 AS le",
     "40 > a AND a > 2 AS gt", "40 >= a AND a >= 2 AS ge", "true AS num_eq", "a % 5 = 0 AS zero", "a > 25 AS pos", "a < 25 AS neg", "(a - 25) % 2 = 0 AS even", "(a - 25) % 2 <> 0 AS odd", "a > 9 AS nan", "a > 9 AS inf",
     "a % 3 <> a % 4 AS dist", "CASE WHEN n IS NULL OR n < 2 THEN -1 WHEN n = 2 THEN 0 ELSE 1 END AS cmp", "coalesce(n > 1, false) AS posi", "coalesce(n < 2, false) AS negi", "coalesce(n >= 2, false) AS nati", "false AS kw", "true AS qual", "true AS simple", "'double' AS type"],
)

family(
    "core_arithmetic",
    lambda: [
        ("plus", core.plus(A(), L(1), L(2))), ("plusx", core.plus_exact(A(), L(3)).cast("string")), ("minusx", core.minus_exact(A(), L(3)).cast("string")), ("negx", core.minus_exact(A()).cast("string")), ("timesx", core.times_exact(A(), L(10**15), L(10**15)).cast("string")),
        ("wrap", core.wrapping_plus(L(2**63 - 1), A())), ("neg", core.minus(A())), ("minus", core.minus(A(), L(3), L(2))), ("times", core.times(A(), L(3))), ("inc", core.inc(A())), ("dec", core.dec(A())), ("div", core.divide(A(), L(4))),
        ("quot", core.quot(A() - 25, L(4))), ("rem", core.rem(A() - 25, L(4))), ("mod", core.mod(A() - 25, L(4))), ("modn", core.mod(A() - 25, L(-4))), ("max", core.maximum(A(), L(25))), ("min", core.minimum(A(), L(25))),
        ("int", core.to_int(X() - 1000)), ("dbl", core.to_double(A())), ("bool", core.to_boolean(B())), ("big", core.to_bigint(A()).cast("string")), ("chr", core.to_char((A() % 26 + 65))), ("abs", maths.abs_(A() - 25)),
        ("plong", core.parse_long(F.concat(A().cast("string"), F.when(A() > 30, "x").otherwise("")))), ("pdbl", core.parse_double(F.concat(A().cast("string"), L(".5e1")))), ("pbool", core.parse_boolean(F.when(A() > 20, "true").when(A() > 10, "false").otherwise("yes"))),
    ],
    ["a + 3 AS plus", "(a + 3)::VARCHAR AS plusx", "(a - 3)::VARCHAR AS minusx", "(-a)::VARCHAR AS negx", "(a::HUGEINT * 1000000000000000 * 1000000000000000)::VARCHAR AS timesx",
     "CASE WHEN a > 0 THEN -9223372036854775807 - 1 + (a - 1) ELSE 9223372036854775807 END AS wrap", "-a AS neg", "a - 5 AS minus", "a * 3 AS times", "a + 1 AS inc", "a - 1 AS dec", "a / 4.0::DOUBLE AS div",
     "trunc((a - 25) / 4)::BIGINT AS quot", "(a - 25) % 4 AS rem", "(((a - 25) % 4) + 4) % 4 AS mod", "-(((25 - a) % 4 + 4) % 4) AS modn", "greatest(a, 25) AS max", "least(a, 25) AS min",
     "trunc(x - 1000)::BIGINT AS int", "a::DOUBLE AS dbl", "coalesce(b, false) AS bool", "a::VARCHAR AS big", "chr((a % 26 + 65)::INT) AS chr", "abs(a - 25) AS abs",
     "CASE WHEN a <= 30 THEN a END AS plong", "(a + 0.5)::DOUBLE * 10 AS pdbl", "CASE WHEN a > 20 THEN true WHEN a > 10 THEN false END AS pbool"],
)

family(
    "core_bits",
    lambda: [
        ("and_", core.bit_and(A(), L(12), L(8))), ("or_", core.bit_or(A(), L(12))), ("xor_", core.bit_xor(A(), L(5))), ("not_", core.bit_not(A())), ("andnot", core.bit_and_not(A(), L(12).cast("bigint"))), ("clear", core.bit_clear(A(), 1)), ("set", core.bit_set(A(), 6)), ("flip", core.bit_flip(A(), 0)),
        ("test", core.bit_test(A(), 2)), ("count", core.bit_count(A())), ("left", core.bit_shift_left(A(), 3)), ("right", core.bit_shift_right(A() - 25, 2)), ("uright", core.unsigned_bit_shift_right(A() - 25, 60)),
        ("rand", core.rand_int(7, 1).between(0, 6)), ("randd", core.rand(2.0, 1).between(0.0, 2.0)), ("hash", core.hash_(A()) == core.hash_(A())),
    ],
    ["a & 8 AS and_", "a | 12 AS or_", "xor(a, 5) AS xor_", "~a AS not_", "a & ~12 AS andnot", "a & ~2 AS clear", "a | 64 AS set", "xor(a, 1) AS flip", "(a & 4) > 0 AS test", "bit_count(a)::INT AS count", "a * 8 AS left", "floor((a - 25) / 4)::BIGINT AS right",
     "CASE WHEN a < 25 THEN 15 ELSE 0 END AS uright", "true AS rand", "true AS randd", "true AS hash"],
)


def _area() -> core.Multimethod:
    area = core.Multimethod(lambda kind, x: kind, default=lambda kind, x: L(-1).cast("bigint"))
    area.method(0)(lambda kind, x: x * x)
    area.method(1)(lambda kind, x: x)
    area.method(2)(lambda kind, x: x + 7)
    area.remove(2)
    return area


family(
    "core_composition",
    lambda: [
        ("condp", core.condp(lambda v, x: x > v, A(), L(40), L("high"), L(20), L("mid"), default=L("low"))), ("if_some", core.if_some(N(), lambda x: x * 10, L(-1).cast("bigint"))), ("some_thread", core.some_thread(N(), lambda x: x + 1, lambda x: F.nullif(x, L(3)), lambda x: x * 2)),
        ("cond_thread", core.cond_thread(A(), A() > 20, lambda x: x - 20, B(), lambda x: x * 2)), ("comp", core.comp(core.inc, lambda x: x * 2)(A())), ("juxt", core.juxt(core.inc, core.dec)(A())["f1"]), ("complement", core.complement(core.is_pos)(N() - 2)),
        ("every_pred", core.every_pred(core.is_pos, core.is_even)(A())), ("some_fn", core.some_fn(core.is_zero, core.is_odd)(A())), ("fnil", core.fnil(lambda x, y: x + y, L(100))(N(), A())), ("multi", _area()(A() % 3, A())),
        ("str", core.str_(A(), N(), S())), ("name", core.name(F.concat(L(":x/"), S()))), ("namespace", core.namespace(F.concat(L(":x/"), S()))), ("no_namespace", core.namespace(S())), ("subs", core.subs(S(), 3)), ("keyword", core.keyword(L("x"), S())), ("symbol", core.symbol(L("x"), S())),
        ("format", core.format_("%s has %d", S(), A())), ("matches", core.re_matches("[A-Z][a-z]+#[0-9]", S())),
    ],
    ["CASE WHEN a > 40 THEN 'high' WHEN a > 20 THEN 'mid' ELSE 'low' END AS condp", "coalesce(n * 10, -1) AS if_some", "nullif(n + 1, 3) * 2 AS some_thread", "(CASE WHEN a > 20 THEN a - 20 ELSE a END) * (CASE WHEN coalesce(b, false) THEN 2 ELSE 1 END) AS cond_thread", "a * 2 + 1 AS comp", "a - 1 AS juxt",
     "NOT coalesce(n > 2, false) AS complement", "a > 0 AND a % 2 = 0 AS every_pred", "a = 0 OR a % 2 = 1 AS some_fn", "coalesce(n, 100) + a AS fnil", "CASE a % 3 WHEN 0 THEN a * a WHEN 1 THEN a ELSE -1 END AS multi",
     "a::VARCHAR || coalesce(n::VARCHAR, '') || s AS str", "s AS name", "'x' AS namespace", "NULL::VARCHAR AS no_namespace", "substr(s, 4) AS subs", "':x/' || s AS keyword", "'x/' || s AS symbol", "s || ' has ' || a AS format", "CASE WHEN regexp_full_match(s, '[A-Z][a-z]+#[0-9]') THEN s END AS matches"],
)

family(
    "collection_arrays",
    lambda: [
        ("first", coll.first(V())), ("second", coll.second(V())), ("last", coll.last(V())), ("peek", coll.peek(V())), ("rest", said(coll.rest(V()))), ("butlast", said(coll.butlast(V()))), ("pop", said(coll.pop(V()))), ("nthrest", said(coll.rest(V(), 2))), ("nexts", said(coll.next_(V(), 4))), ("nothing", coll.next_(V(), 5).isNull()),
        ("take", said(coll.take(V(), 2))), ("take_last", said(coll.take_last(V(), 2))), ("take_while", said(coll.take_while(V(), lambda x: x > 0))), ("drop_while", said(coll.drop_while(V(), lambda x: x > 0))), ("nth", coll.nth(V(), 1)), ("nth_default", coll.nth(V(), 9, L(-1).cast("bigint"))),
        ("subvec", said(coll.subvec(V(), 1, 3))), ("conj", said(coll.conj(V(), L(8).cast("bigint"), L(9).cast("bigint")))), ("cons", said(coll.cons(L(9).cast("bigint"), V()))), ("filter_", said(coll.filter_(V(), lambda x: x > 1))), ("remove", said(coll.remove(V(), lambda x: x > 1))),
        ("keep", said(coll.keep(V(), lambda x: F.nullif(x, L(1))))), ("map_indexed", said(coll.map_indexed(V(), lambda i, x: x * 10 + i))), ("mapcat", said(coll.mapcat(V(), lambda x: F.array(x, x)))), ("every", coll.every(V(), lambda x: x < 4)), ("some", coll.some(V(), lambda x: x == 4)), ("not_any", coll.not_any(V(), lambda x: x == 4)), ("not_every", coll.not_every(V(), lambda x: x < 4)),
        ("distinct", F.size(coll.distinct(V()))), ("dedupe", said(coll.dedupe(F.slice(V(), 4, 2)))), ("partition", F.array_join(F.transform(coll.partition(V(), 2), said), "|")), ("partition_all", F.array_join(F.transform(coll.partition_all(V(), 2), said), "|")), ("split_at", F.array_join(F.transform(coll.split_at(V(), 2), said), "|")), ("interleave", said(coll.interleave(V(), F.array(L(7).cast("bigint"), L(8).cast("bigint"))))),
        ("interpose", said(coll.interpose(L(9).cast("bigint"), F.slice(V(), 1, 2)))), ("sort", said(coll.sort(V()))), ("sort_by", said(coll.sort_by(V(), lambda x: -x))), ("reverse", said(coll.reverse(V()))), ("into", said(coll.into(V(), V()))), ("reduce_", coll.reduce_(V(), L(1).cast("bigint"), lambda a, x: a * 3 - x)), ("reductions", said(coll.reductions(F.slice(V(), 1, 3), L(0).cast("bigint"), lambda a, x: a + x))),
        ("freq", F.try_element_at(coll.frequencies(V()), A() % 3)), ("replace", said(coll.replace(V(), F.create_map(L(1).cast("bigint"), L(5).cast("bigint"))))), ("not_empty", coll.not_empty(coll.filter_(V(), lambda x: x > 3)).isNull()), ("is_empty", coll.is_empty(coll.filter_(V(), lambda x: x > 3))), ("ffirst", coll.ffirst(F.array(V()))),
        ("flatten", said(coll.flatten(F.array(F.array(V()), F.array(V())), 2))), ("subset", coll.is_subset(F.slice(V(), 1, 1), F.slice(V(), 2, 4))), ("disj", said(coll.disj(V(), L(0), L(1)))),
    ],
    ["v[1]::BIGINT AS first", "v[2]::BIGINT AS second", "v[5]::BIGINT AS last", "v[5]::BIGINT AS peek", "array_to_string(v[2:], ',') AS rest", "array_to_string(v[:4], ',') AS butlast", "array_to_string(v[:4], ',') AS pop", "array_to_string(v[3:], ',') AS nthrest", "array_to_string(v[5:], ',') AS nexts", "true AS nothing",
     "array_to_string(v[:2], ',') AS take", "array_to_string(v[4:], ',') AS take_last", "CASE WHEN list_position(list_transform(v, lambda q: q > 0), false) IS NULL THEN array_to_string(v, ',') ELSE array_to_string(v[:list_position(list_transform(v, lambda q: q > 0), false) - 1], ',') END AS take_while",
     "CASE WHEN list_position(list_transform(v, lambda q: q > 0), false) IS NULL THEN '' ELSE array_to_string(v[list_position(list_transform(v, lambda q: q > 0), false):], ',') END AS drop_while", "v[2]::BIGINT AS nth", "-1 AS nth_default", "array_to_string(v[2:3], ',') AS subvec", "array_to_string(v || [8, 9], ',') AS conj", "array_to_string([9] || v, ',') AS cons",
     "coalesce(array_to_string(list_filter(v, lambda q: q > 1), ','), '') AS filter_", "coalesce(array_to_string(list_filter(v, lambda q: q <= 1), ','), '') AS remove", "coalesce(array_to_string(list_filter(v, lambda q: q <> 1), ','), '') AS keep", "array_to_string(list_transform(v, lambda q, i: q * 10 + i - 1), ',') AS map_indexed", "array_to_string(flatten(list_transform(v, lambda q: [q, q])), ',') AS mapcat",
     "len(list_filter(v, lambda q: q >= 4)) = 0 AS every", "list_contains(v, 4) AS some", "NOT list_contains(v, 4) AS not_any", "len(list_filter(v, lambda q: q >= 4)) > 0 AS not_every", "len(list_distinct(v))::INT AS distinct", "v[4]::VARCHAR AS dedupe", "v[1] || ',' || v[2] || '|' || v[3] || ',' || v[4] AS partition", "v[1] || ',' || v[2] || '|' || v[3] || ',' || v[4] || '|' || v[5] AS partition_all",
     "v[1] || ',' || v[2] || '|' || v[3] || ',' || v[4] || ',' || v[5] AS split_at", "v[1] || ',7,' || v[2] || ',8' AS interleave", "v[1] || ',9,' || v[2] AS interpose", "array_to_string(list_sort(v), ',') AS sort", "array_to_string(list_reverse_sort(v), ',') AS sort_by", "array_to_string(list_reverse(v), ',') AS reverse", "array_to_string(v || v, ',') AS into",
     "list_reduce([1] || v, lambda p, q: p * 3 - q)::BIGINT AS reduce_", "'0,' || v[1] || ',' || (v[1] + v[2]) || ',' || (v[1] + v[2] + v[3]) AS reductions", "len(list_filter(v, lambda q: q = a % 3))::INT AS freq", "array_to_string(list_transform(v, lambda q: CASE WHEN q = 1 THEN 5 ELSE q END), ',') AS replace", "len(list_filter(v, lambda q: q > 3)) = 0 AS not_empty", "len(list_filter(v, lambda q: q > 3)) = 0 AS is_empty", "v[1]::BIGINT AS ffirst",
     "array_to_string(v || v, ',') AS flatten", "list_contains(v[2:], v[1]) AS subset", "coalesce(array_to_string(list_filter(v, lambda q: q > 1), ','), '') AS disj"],
)


def _map() -> Column:
    return F.col("m")


_BOX = "named_struct('p', named_struct('q', a, 'r', s))"
_OTHER = lambda: F.create_map(L("a"), L(100).cast("bigint"), L("z"), A())

family(
    "collection_maps",
    lambda: [
        ("has", coll.contains(_map(), L("n"))), ("hasnt", coll.contains(_map(), L("z"))), ("got_null", coll.get(_map(), L("n"), L(-5).cast("bigint"))), ("dissoc", said(coll.keys(coll.dissoc(_map(), L("a"))))), ("found", coll.find(_map(), L("a"))["value"]), ("lost", coll.find(_map(), L("z")).isNull()), ("selected", said(coll.vals(coll.select_keys(_map(), L("a"), L("z"))))),
        ("vals", said(coll.vals(coll.update_vals(_map(), lambda v: v + 1)))), ("keys", said(coll.keys(coll.update_keys(_map(), lambda k: F.upper(k))))), ("merged", coll.get(coll.merge(_map(), _OTHER()), L("a"))), ("with_", coll.get(coll.merge_with(lambda p, q: p + q, _map(), _OTHER()), L("a"))), ("alone", coll.get(coll.merge_with(lambda p, q: p + q, _map(), _OTHER()), L("z"))),
        ("zipmap", coll.get(coll.zipmap(F.array(L("p"), L("q"), L("p")), V()), L("p"))), ("kv", coll.reduce_kv(_map(), L(0).cast("bigint"), lambda acc, k, v: acc + F.length(k) * F.coalesce(v, L(7).cast("bigint")))), ("get_in", coll.get_in(F.expr(_BOX), "p", "q")), ("assoc_in", coll.get_in(coll.assoc_in(F.expr(_BOX), "p.q", L(5)), "p", "q")), ("update_in", coll.get_in(coll.update_in(F.expr(_BOX), "p.q", lambda x: x * 2), "p", "q")),
        ("renamed", F.element_at(coll.keys(walk.stringify_keys(F.create_map(A(), S()), T.MapType(T.LongType(), T.StringType()))), 1)), ("keywords", F.element_at(coll.keys(walk.keywordize_keys(F.create_map(A(), S()), T.MapType(T.LongType(), T.StringType()))), 1)),
        ("post", said(walk.postwalk(V(), T.ArrayType(T.LongType()), lambda y, k: y * 2 if isinstance(k, T.LongType) else F.reverse(y)))), ("pre", said(walk.prewalk(V(), T.ArrayType(T.LongType()), lambda y, k: y * 2 if isinstance(k, T.LongType) else F.reverse(y)))), ("walk", said(walk.walk(V(), T.ArrayType(T.LongType()), lambda y, k: y + 1, lambda y, k: F.sort_array(y)))), ("replaced", said(walk.replace(V(), T.ArrayType(T.LongType()), {1: 5}))),
    ],
    ["true AS has", "false AS hasnt", "n AS got_null", "'n' AS dissoc", "a AS found", "true AS lost", "a::VARCHAR AS selected", "(a + 1) || ',' || coalesce((n + 1)::VARCHAR, '-') AS vals", "'A,N' AS keys", "100 AS merged", "a + 100 AS with_", "a AS alone",
     "v[3]::BIGINT AS zipmap", "a + coalesce(n, 7) AS kv", "a AS get_in", "5 AS assoc_in", "a * 2 AS update_in", "a::VARCHAR AS renamed", "a::VARCHAR AS keywords", "array_to_string(list_reverse(list_transform(v, lambda q: q * 2)), ',') AS post", "array_to_string(list_reverse(list_transform(v, lambda q: q * 2)), ',') AS pre", "array_to_string(list_sort(list_transform(v, lambda q: q + 1)), ',') AS walk",
     "array_to_string(list_transform(v, lambda q: CASE WHEN q = 1 THEN 5 ELSE q END), ',') AS replaced"],
)

_PAD = lambda: F.concat(L(" \t"), S(), L(" \r\n"))
family(
    "str_more",
    lambda: [
        ("ends", strings.ends_with(S(), L("3"))), ("starts", strings.starts_with(S(), L("Brand"))), ("has", strings.includes(S(), L("d#"))), ("escape", strings.escape(S(), {"#": "<#>", "B": "b"})), ("last_at", strings.last_index_of(F.concat(S(), S()), L("#"))), ("low", strings.lower_case(S())), ("up", strings.upper_case(S())),
        ("padr", strings.pad_right(S(), "*", 10)), ("quoted", F.regexp_count(F.concat(S(), L("a.c abc")), L(strings.re_quote("a.c")))), ("rep", strings.replace(S(), "#", ".")), ("rex", strings.replace(S(), "[0-9]", "<$0>", regex=True)), ("lines", F.size(strings.split_lines(F.concat(S(), L("\r\n"), S(), L("\n"), S())))),
        ("trim", strings.trim(_PAD())), ("triml", strings.trim_left(_PAD())), ("trimr", strings.trim_right(_PAD())), ("newline", strings.trim_newline(_PAD())), ("join", strings.join(V(), "+")), ("blank", strings.is_blank(L(" \u3000"))),
    ],
    ["ends_with(s, '3') AS ends", "starts_with(s, 'Brand') AS starts", "contains(s, 'd#') AS has", "replace(replace(s, '#', '<#>'), 'B', 'b') AS escape", "(length(s) + instr(s, '#') - 1)::INT AS last_at", "lower(s) AS low", "upper(s) AS up", "rpad(s, 10, '*') AS padr", "1 AS quoted", "replace(s, '#', '.') AS rep", "regexp_replace(s, '([0-9])', '<\\1>', 'g') AS rex", "3 AS lines",
     "s AS trim", "s || ' ' || chr(13) || chr(10) AS triml", "' ' || chr(9) || s AS trimr", "' ' || chr(9) || s || ' ' AS newline", "array_to_string(v, '+') AS join", "true AS blank"],
)

_R = lambda x: F.round(x, 6)
_CONSTANTS = ("E", "exp(1)"), ("PI", "pi()"), ("PHI", "(1 + sqrt(5)) / 2"), ("LN_OF_2", "ln(2)"), ("LN_OF_10", "ln(10)"), ("LOG_2_OF_E", "1 / ln(2)"), ("LOG_10_OF_E", "1 / ln(10)"), ("SQRT_OF_2", "sqrt(2)"), ("SQRT_OF_E", "sqrt(exp(1))"), ("SQRT_OF_PI", "sqrt(pi())"), ("SQRT_OF_PHI", "sqrt((1 + sqrt(5)) / 2)")
_D = lambda: (A() - 25) / 4.0
family(
    "math_more",
    lambda: [
        *((n.lower(), _R(A() * getattr(maths, n))) for n, _ in _CONSTANTS), ("max_double", L(maths.MAX_DOUBLE) > 1e308), ("tiny", L(maths.SMALLEST_NONZERO_DOUBLE) > 0),
        ("cos", _R(maths.cos(A()))), ("sin", _R(maths.sin(A()))), ("exp", _R(maths.exp(A() / 10.0))), ("exp_2", maths.exp_2(A().cast("double"))), ("expm1", _R(maths.exp_minus_1(A() / 10.0))), ("log_2", _R(maths.log_2(X()))), ("logb", maths.log_binary(X())), ("log1p", _R(maths.log_plus_1(X()))), ("nan", maths.is_nan(F.when(A() > 9, maths.nan()).otherwise(X()))),
        ("pow", maths.pow_(A().cast("double"), L(3.0))), ("pow10", maths.pow_10(A() % 5)), ("sign", maths.sign_bit(_D())), ("copy", maths.copy_sign(X(), _D())), ("inf", maths.is_inf(F.when(A() > 9, maths.inf(1)).otherwise(X()), 1)), ("minf", maths.is_inf(F.when(A() > 9, maths.inf(1)).otherwise(X()), -1)), ("whole", maths.modf(_D())[0] + 0.0), ("part", maths.modf(_D())[1]),
        ("next", maths.next_after(X(), L(1e9)) > X()), ("round", maths.round_(_D()) + 0.0), ("even", maths.round_to_even(_D()) + 0.0), ("trunc", maths.trunc(_D()) + 0.0), ("floor", maths.floor(_D()) + 0.0), ("ceil", maths.ceil(_D()) + 0.0),
    ],
    [*(f"round(a * ({sql}), 6) AS {n.lower()}" for n, sql in _CONSTANTS), "true AS max_double", "true AS tiny", "round(cos(a), 6) AS cos", "round(sin(a), 6) AS sin", "round(exp(a / 10.0), 6) AS exp", "pow(2.0, a) AS exp_2", "round(exp(a / 10.0) - 1, 6) AS expm1", "round(log2(x), 6) AS log_2", "floor(log2(x)) AS logb", "round(ln(x + 1), 6) AS log1p", "a > 9 AS nan",
     "pow(a::DOUBLE, 3) AS pow", "pow(10.0, a % 5) AS pow10", "a < 25 AS sign", "CASE WHEN a < 25 THEN -x ELSE x END AS copy", "a > 9 AS inf", "false AS minf", "trunc((a - 25) / 4.0) + 0.0::DOUBLE AS whole", "((a - 25) / 4.0 - trunc((a - 25) / 4.0))::DOUBLE AS part", "true AS next",
     "round((a - 25) / 4.0::DOUBLE) + 0.0 AS round", "round_even((a - 25) / 4.0::DOUBLE, 0) + 0.0 AS even", "trunc((a - 25) / 4.0::DOUBLE) + 0.0 AS trunc", "floor((a - 25) / 4.0::DOUBLE) + 0.0 AS floor", "ceil((a - 25) / 4.0::DOUBLE) + 0.0 AS ceil"],
)


def _events(t):
    return t("events").select(F.col("event_id").alias("k"), F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("s"), F.col("value").alias("x"))


_EVENTS = "(SELECT event_id AS k, ts AS t, event_type AS s, value AS x FROM events)"
_TIME = lambda: F.col("t")
_DAY2 = "lpad(day(t)::VARCHAR, 2, ' ')"
_LAYOUTS = {
    "ANSI_C": f"strftime(t, '%a %b ') || {_DAY2} || strftime(t, ' %H:%M:%S %Y')", "KITCHEN": "strftime(t, '%-I:%M%p')", "RFC1123": "strftime(t, '%a, %d %b %Y %H:%M:%S UTC')", "RFC1123_Z": "strftime(t, '%a, %d %b %Y %H:%M:%S +0000')", "RFC3339": "strftime(t, '%Y-%m-%dT%H:%M:%SZ')",
    "RFC3339_NANO": "strftime(t, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'", "RFC822": "strftime(t, '%d %b %y %H:%M UTC')", "RFC822_Z": "strftime(t, '%d %b %y %H:%M +0000')", "RFC850": "strftime(t, '%A, %d-%b-%y %H:%M:%S UTC')", "RUBY_DATE": "strftime(t, '%a %b %d %H:%M:%S +0000 %Y')", "STAMP": f"strftime(t, '%b ') || {_DAY2} || strftime(t, ' %H:%M:%S')",
    "STAMP_MILLI": f"strftime(t, '%b ') || {_DAY2} || strftime(t, ' %H:%M:%S.') || left(strftime(t, '%f'), 3)", "STAMP_MICRO": f"strftime(t, '%b ') || {_DAY2} || strftime(t, ' %H:%M:%S.%f')", "STAMP_NANO": f"strftime(t, '%b ') || {_DAY2} || strftime(t, ' %H:%M:%S.%f') || '000'", "UNIX_DATE": f"strftime(t, '%a %b ') || {_DAY2} || strftime(t, ' %H:%M:%S UTC %Y')",
}
family("time_layouts", lambda: [(n.lower(), times.format_(_TIME(), getattr(times, n))) for n in _LAYOUTS], [f"{sql} AS {n.lower()}" for n, sql in _LAYOUTS.items()], _events, _EVENTS)

_STAMP = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
_NANOS = lambda: F.col("k") * 1_234_567_890
_WIDE = lambda: F.col("k").cast("decimal(19,0)")  # noqa: E731  (hours of a large k are more than 64 bits of nanoseconds)
family(
    "time_more",
    lambda: [
        ("parsed", _STAMP(times.parse(times.format_(_TIME(), times.RFC3339), times.RFC3339))), ("unparsed", times.parse(L("x"), times.RFC3339).isNull()), ("in_zone", _STAMP(times.parse_in_timezone(_STAMP(_TIME()), "2006-01-02 15:04:05", "+02:00"))), ("zoned", _STAMP(times.in_timezone(_TIME(), "+05:30"))),
        ("unix", times.unix(times.from_unix(times.unix(_TIME())))), ("nanos", times.sub(times.from_unix(F.col("k"), L(5_000)), times.from_unix(F.col("k")))), ("sub", times.sub(_TIME(), times.add(_TIME(), L(-3 * times.SECOND)))), ("hours", times.hours(_WIDE() * times.HOUR)), ("minutes", times.minutes(_WIDE() * times.MINUTE)), ("seconds", times.seconds(_WIDE() * times.SECOND)),
        ("millis", F.col("k") * (times.MILLISECOND // times.MICROSECOND // times.NANOSECOND)), ("rounded", times.round_(_NANOS(), times.SECOND)), ("cut", times.truncate(_NANOS(), times.SECOND)), ("duration", times.duration_string(F.col("k") * times.SECOND)), ("back", times.parse_duration(times.duration_string(_NANOS())) == _NANOS()),
        ("past", times.since(_TIME()) > 0), ("future", times.until(_TIME()) < 0), ("now", times.now() > _TIME()), ("day", times.day_of_year(_TIME())), ("shown", _STAMP(times.truncate_time(_TIME(), "day"))),
    ],
    ["strftime(t, '%Y-%m-%d %H:%M:%S') AS parsed", "true AS unparsed", "strftime(t - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS in_zone", "strftime(t + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS zoned", "floor(epoch(t))::BIGINT AS unix", "5000 AS nanos", "3000000000 AS sub", "k::DOUBLE AS hours", "k::DOUBLE AS minutes", "k::DOUBLE AS seconds",
     "k * 1000 AS millis", "(k * 1234567890 + 500000000) // 1000000000 * 1000000000 AS rounded", "k * 1234567890 // 1000000000 * 1000000000 AS cut", "CASE WHEN k >= 3600 THEN (k // 3600) || 'h' ELSE '' END || CASE WHEN k >= 60 THEN (k % 3600 // 60) || 'm' ELSE '' END || (k % 60) || 's' AS duration", "true AS back",
     "true AS past", "true AS future", "true AS now", "dayofyear(t)::INT AS day", "strftime(date_trunc('day', t), '%Y-%m-%d %H:%M:%S') AS shown"],
    _events, _EVENTS,
)

family(
    "strconv_more",
    lambda: [
        ("atoi", codecs.atoi(A().cast("string"))), ("itoa", codecs.itoa(A())), ("fbool", codecs.format_bool(B())), ("pbool", codecs.parse_bool(F.when(B(), "T").otherwise("0"))), ("pdbl", codecs.parse_double(X().cast("string"))), ("fdbl", codecs.format_double(A() / 4, 3)), ("fexp", codecs.format_double(A() + 10, 1, "e")),
        ("graphic", codecs.is_graphic(L("\u00a0"))), ("printable", codecs.is_printable(L("\u00a0"))), ("printable_s", codecs.is_printable(F.substring(S(), 1, 1))), ("backquote", codecs.can_backquote(F.when(A() > 25, "a`b").otherwise(S()))), ("quote", codecs.quote(F.concat(S(), L('"\n\u00e9')))), ("ascii", codecs.quote(F.concat(S(), L("\u00e9")), ascii_only=True)), ("graph", codecs.quote(L("\u00a0"), graphic=True)), ("plain", codecs.quote(L("\u00a0"))),
        ("qchar", codecs.quote_char(L("'"))), ("qascii", codecs.quote_char(L("\u00e9"), ascii_only=True)), ("qgraph", codecs.quote_char(L("\u00a0"), graphic=True)), ("unquoted", codecs.unquote(codecs.quote(S()))), ("raw", codecs.unquote(F.concat(L("`"), S(), L("`")))), ("base2", codecs.format_int(A() - 25, 2)), ("from2", codecs.parse_int(codecs.format_int(A() - 25, 2), 2)),
    ],
    ["a AS atoi", "a::VARCHAR AS itoa", "b::VARCHAR AS fbool", "coalesce(b, false) AS pbool", "x AS pdbl", "printf('%.3f', a / 4.0::DOUBLE) AS fdbl", "printf('%.1e', a + 10.0::DOUBLE) AS fexp", "true AS graphic", "false AS printable", "true AS printable_s", "a <= 25 AS backquote", "'\"' || s || '\\\"\\n\u00e9\"' AS quote", "'\"' || s || '\\u00e9\"' AS ascii", "'\"\u00a0\"' AS graph", "'\"\\u00a0\"' AS plain",
     "'''\\'''''  AS qchar", "'''\\u00e9''' AS qascii", "'''\u00a0''' AS qgraph", "s AS unquoted", "s AS raw", "CASE WHEN a < 25 THEN '-' ELSE '' END || to_base(abs(a - 25), 2) AS base2", "a - 25 AS from2"],
)

_MAIL = "concat('Content-Type: multipart/mixed; boundary=x\\n\\n--x\\nContent-Type: text/plain\\n\\n', s, '\\n--x\\nContent-Type: text/csv\\nContent-Disposition: attachment; filename=a.csv\\n\\n1,2\\n--x--\\n')"
family(
    "codecs_more",
    lambda: [
        ("sha1", codecs.hex_encode(codecs.sha1(S()))), ("md5", codecs.hex_encode(codecs.md5(S()))), ("n384", F.length(codecs.sha2(S(), 384))), ("n512", F.length(codecs.sha2(S(), 512))), ("n224", F.length(codecs.sha2(S(), 224))), ("n512_256", F.length(codecs.sha512_truncated(S(), 256))), ("hmac", F.length(codecs.hmac(S(), "key"))), ("b64", codecs.base64_decode(codecs.base64_encode(S()))), ("hex", codecs.hex_decode(codecs.hex_encode(S()))), ("uuid", F.length(codecs.uuid_new())),
        ("path", codecs.path_escape(F.concat(S(), L(" &/")))), ("unpath", codecs.path_unescape(codecs.path_escape(F.concat(S(), L(" +/"))))), ("query", said(codecs.parse_query(F.concat(L("a=1&b=x+y&a="), A().cast("string")))["a"])), ("html", codecs.html_unescape(codecs.html_escape(F.concat(S(), L("<'\"&"))))), ("hiccup", codecs.hiccup_json(F.format_string('["p#i.c", {"t": "%s"}, "1<2", ["br"]]', S()))),
        ("csv", codecs.csv_write(F.struct(A(), S()))), ("csvr", codecs.csv_read(codecs.csv_write(F.struct(A(), S())), "a BIGINT, s STRING")["s"]), ("json", codecs.json_read(F.format_string('{"a": [%d]}', A())).cast("string")), ("media", codecs.parse_media_type(F.concat(L("Text/HTML; charset="), S()))["type"]), ("charset", codecs.parse_media_type(L("text/html; charset=utf-8"))["params"]["charset"]),
        ("body", codecs.mime_body(F.expr(_MAIL))), ("attached", codecs.mime_attachments(F.expr(_MAIL))[0]["filename"]), ("parts", F.size(codecs.read_entity(F.expr(_MAIL)))), ("decoded", codecs.decode_transfer_encoding("base64", codecs.base64_encode(S())).cast("string")), ("printed", codecs.decode_transfer_encoding("quoted-printable", L("a=3Db")).cast("string")),
    ],
    ["sha1(s) AS sha1", "md5(s) AS md5", "48 AS n384", "64 AS n512", "28 AS n224", "32 AS n512_256", "32 AS hmac", "s AS b64", "s AS hex", "36 AS uuid", "replace(url_encode(s), '%20', ' ') || '%20&%2F' AS path", "s || ' +/' AS unpath", "'1,' || a AS query", "s || '<''\"&' AS html", "'<p class=\"c\" id=\"i\" t=\"' || s || '\">1&lt;2<br /></p>' AS hiccup",
     "a || ',' || s AS csv", "s AS csvr", "'{\"a\":[' || a || ']}' AS json", "'text/html' AS media", "'utf-8' AS charset", "s AS body", "'a.csv' AS attached", "2 AS parts", "s AS decoded", "'a=b' AS printed"],
)
