"""Scalar functions on known answers."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import codecs, collections, core, maths, strings, times


@pytest.fixture
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first().x


def test_core(value):
    assert value(core.mod(F.lit(7), F.lit(-3))) == -2
    assert value(core.mod(F.lit(-7), F.lit(3))) == 2
    assert value(core.quot(F.lit(-7), F.lit(2))) == -3
    assert value(core.wrapping_plus(F.lit(2**63 - 1), F.lit(1))) == -(2**63)
    assert tuple(value(core.ratio(F.lit(6), F.lit(-4)))) == (-3, 2)
    assert value(core.parse_long(F.lit("12x"))) is None and value(core.parse_long(F.lit("-12"))) == -12
    assert value(core.parse_boolean(F.lit("yes"))) is None
    assert value(core.str_(F.lit("a"), F.lit(None), F.lit(1))) == "a1"
    assert value(core.or_(F.lit(False), F.lit(None).cast("boolean"), F.lit(True))) is True
    assert value(core.equal(F.lit(None), F.lit(None))) is True
    assert value(core.re_find("b+", F.lit("abbc"))) == "bb" and value(core.re_find("z", F.lit("abbc"))) is None
    assert value(core.re_matches("a.*", F.lit("abc"))) == "abc" and value(core.re_matches("b", F.lit("abc"))) is None
    assert value(core.times_exact(F.lit(10**15), F.lit(10**15))) == 10**30
    with pytest.raises(Exception, match="null"):
        value(core.maximum(F.lit(1), F.lit(None).cast("int")))


def test_multimethod(value):
    area = core.Multimethod(lambda kind, x: kind, default=lambda kind, x: F.lit(0))
    area.method("square")(lambda kind, x: x * x)
    assert value(area(F.lit("square"), F.lit(3))) == 9
    assert value(area(F.lit("line"), F.lit(3))) == 0


def test_strings(value):
    assert value(strings.trim(F.lit("\u2003\t a b\u00a0"))) == "a b"
    assert value(strings.pad_left(F.lit("abc"), "0", 2)) == "abc"
    assert value(strings.index_of(F.lit("añb"), F.lit("b"))) == 2
    assert value(strings.index_of(F.lit("abc"), F.lit("z"))) is None
    assert value(strings.last_index_of(F.lit("abab"), F.lit("ab"))) == 2
    assert value(strings.capitalize(F.lit("hELLO wORLD"))) == "Hello world"
    assert value(strings.replace_first(F.lit("a.b.c"), ".", "$1")) == "a$1b.c"
    assert value(strings.escape(F.lit("a<b&"), {"<": "&lt;", "&": "&amp;"})) == "a&lt;b&amp;"
    assert value(strings.split(F.lit("a.b"), ".")) == ["a", "b"]
    assert value(strings.is_blank(F.lit("\u3000\n"))) is True
    assert value(strings.trim_newline(F.lit("a\r\n\n"))) == "a"


def test_maths(value):
    assert value(maths.log(F.lit(0.0))) == -math.inf and math.isnan(value(maths.log(F.lit(-1.0))))
    assert value(maths.round_(F.lit(-2.5))) == -3.0 and value(maths.round_to_even(F.lit(2.5))) == 2.0
    assert value(maths.trunc(F.lit(-2.7))) == -2.0
    assert math.copysign(1, value(maths.copy_sign(F.lit(3.0), F.lit(-0.0)))) == -1
    assert value(maths.modf(F.lit(2.25))) == [2.0, 0.25]
    assert value(maths.next_after(F.lit(1.0), F.lit(2.0))) == math.nextafter(1, 2)
    assert value(maths.is_inf(F.lit(math.inf), -1)) is False


def test_times(value):
    t = F.lit("2024-01-31 10:20:30").cast("timestamp")
    assert str(value(times.add_date(t, F.lit(0), F.lit(1), F.lit(0)))) == "2024-03-02 10:20:30"
    assert value(times.format_(t, times.RFC3339)) == "2024-01-31T10:20:30Z"
    assert value(times.format_(t, times.ANSI_C)) == "Wed Jan 31 10:20:30 2024"
    assert str(value(times.parse(F.lit("2024-01-31"), "2006-01-02"))) == "2024-01-31 00:00:00"
    assert value(times.parse_duration(F.lit("1h15m30.5s"))) == 4_530_500_000_000
    assert value(times.parse_duration(F.lit("1x"))) is None
    assert value(times.duration_string(F.lit(259_380_500_000_000))) == "72h3m0.5s"
    assert value(times.duration_string(F.lit(1_500_000))) == "1.5ms"
    assert value(times.round_(F.lit(-15), 10)) == -20 and value(times.truncate(F.lit(-15), 10)) == -10
    assert value(times.unix(t)) == 1706696430
    assert value(times.sub(times.add(t, F.lit(5000)), t)) == 5000


def test_codecs(value):
    assert value(codecs.format_int(F.lit(-255), 16)) == "-ff" and value(codecs.parse_int(F.lit("-ff"), 16)) == -255
    assert value(codecs.quote(F.lit('a"\n\u00e9'))) == '"a\\"\\n\u00e9"'
    assert value(codecs.quote(F.lit("\u00e9"), ascii_only=True)) == '"\\u00e9"'
    assert value(codecs.unquote(F.lit('"a\\tb\\x41"'))) == "a\tbA"
    assert value(codecs.hex_encode(codecs.hmac(F.lit("m"), "k"))) is not None
    assert value(codecs.path_escape(F.lit("a b/c"))) == "a%20b%2Fc" and value(codecs.query_escape(F.lit("a b~*"))) == "a+b~%2A"
    assert value(codecs.parse_query(F.lit("a=1&b=x+y&a=2&c"))) == {"a": ["1", "2"], "b": ["x y"], "c": [""]}
    assert value(codecs.html_escape(F.lit("<a href='x'>"))) == "&lt;a href=&#39;x&#39;&gt;"
    assert value(codecs.html_unescape(F.lit("&lt;&eacute;"))) == "<\u00e9"
    assert codecs.hiccup(["div#a.b", {"title": "x"}, "1<2", ["br"]]) == '<div class="b" id="a" title="x">1&lt;2<br /></div>'
    mail = "Content-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain\n\nhello\n--x\nContent-Type: text/csv\nContent-Disposition: attachment; filename=a.csv\n\n1,2\n--x--\n"
    assert value(codecs.mime_body(F.lit(mail))) == "hello"
    assert value(codecs.mime_attachments(F.lit(mail)))[0].filename == "a.csv"
    assert value(codecs.parse_media_type(F.lit("text/html; charset=utf-8"))).params == {"charset": "utf-8"}
    assert bytes(value(codecs.decode_transfer_encoding("base64", F.lit("aGk=")))) == b"hi"
    with pytest.raises(Exception, match="invalid syntax"):
        value(codecs.atoi(F.lit("1x")))


def test_collections(value):
    a = F.array(*map(F.lit, [1, 1, 2, 3, 3, 1]))
    assert value(collections.dedupe(a)) == [1, 2, 3, 1]
    assert value(collections.partition(a, 4, 2)) == [[1, 1, 2, 3], [2, 3, 3, 1]]
    assert value(collections.partition(a, 4, whole=False)) == [[1, 1, 2, 3], [3, 1]]
    assert value(collections.take_while(a, lambda x: x < 3)) == [1, 1, 2]
    assert value(collections.drop_while(a, lambda x: x < 3)) == [3, 3, 1]
    assert value(collections.interleave(a, F.array(F.lit(9), F.lit(8)))) == [1, 9, 1, 8]
    assert value(collections.interpose(F.lit(0), F.slice(a, 1, 2))) == [1, 0, 1]
    assert value(collections.reductions(F.slice(a, 1, 3), F.lit(0), lambda x, y: x + y)) == [0, 1, 2, 4]
    assert value(collections.frequencies(a)) == {1: 3, 2: 1, 3: 2}
    assert value(collections.zipmap(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.slice(a, 3, 3))) == {"b": 3, "a": 3}
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None).cast("int"))
    assert value(collections.get(m, F.lit("b"), F.lit(7))) is None and value(collections.get(m, F.lit("c"), F.lit(7))) == 7
    assert value(collections.merge(m, F.create_map(F.lit("a"), F.lit(5)))) == {"a": 5, "b": None}
    assert value(collections.merge_with(lambda x, y: x + y, m, F.create_map(F.lit("a"), F.lit(5)))) == {"a": 6, "b": None}
    assert value(collections.dissoc(m, F.lit("a"))) == {"b": None}
    assert value(collections.nth(a, 9, F.lit(0))) == 0


def test_walk(spark):
    from pyspark.sql import types as T

    from quillon.functions import walk

    df = spark.sql("SELECT named_struct('a', array(1, 2), 'm', map(7, 'x', 8, 'y'), 's', 'x') AS v")
    kind = df.schema["v"].dataType
    up = lambda x, k: x + 1 if isinstance(k, T.IntegerType) else x
    for f in (walk.postwalk, walk.prewalk):
        assert df.select(f(F.col("v"), kind, up).alias("v")).first().v.a == [2, 3]
    got = df.select(walk.replace(F.col("v"), kind, {"x": "z", 2: 9}).alias("v")).first().v
    assert got.a == [1, 9] and got.m == {7: "z", 8: "y"} and got.s == "z"
    assert df.select(walk.stringify_keys(F.col("v"), kind).alias("v")).first().v.m == {"7": "x", "8": "y"}
    pairs = walk.for_([("x", spark.range(3).select(F.col("id").alias("x"))), ("y", F.sequence(F.lit(0), F.col("x")))], when=F.col("y") > 0, let={"z": F.col("x") * 10 + F.col("y")})
    assert sorted(r.z for r in pairs.collect()) == [11, 21, 22]
    assert walk.print_table(spark.range(1)).splitlines()[2] == "|  0 |"
