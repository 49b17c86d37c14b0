"""Operators 2 and 6 against plain Python."""

import hashlib
import random
import re
import time

import pytest

from quillon.llm.secret_scan import secret_scan
from quillon.llm.url_filters import PATTERNS, RULES, Pattern, Rule, literals, url_filter

from .data import SCHEMA, empty, table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark):
    df = table(spark)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan(df).collect())
    want = []
    for r in df.collect():
        spans = base_spans(r.text or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((r.doc_id if r.doc_id is not None else -1, *(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)
    assert secret_scan(empty(spark)).count() == 0


def test_ownership_tells_examples_from_live_values(spark):
    key = "AbCdEfGhIjKlMnOpQrStUvWxYz0123456789"
    copied, live = f"see {key} here", f"use {key[::-1]} here"
    rows = [(k, copied, None, f"owner{k}", 0, *"abcd") for k in range(6)] + [(10 + k, live, None, "owner1", 0, *"abcd") for k in range(6)]
    got = {r.doc_id: r for r in secret_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].spans == "" and got[0].n_live == 0
    assert got[10].spans == "key:4:40" and got[10].n_live == 1


def test_many_matches_in_one_text(spark):
    text = "token=abcdef token=ab " * 20_000
    began = time.time()
    row = secret_scan(spark.createDataFrame([(1, text, None, None, 0, *"abcd")], SCHEMA)).first()
    assert row.n_assign == 20_000 and row.spans.endswith(f",assign:{22 * 19_999}:{22 * 19_999 + 12}")
    assert time.time() - began < 15


def judge(url: str | None) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    low = rest.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    other = next((p.action for p in PATTERNS if host and re.search(p.regex, low)), "allow")
    return host, path, best.name if best else None, best.action if best else other


URLS = [
    None, "", "no scheme.org/es/", "http://", "http://example.org", "http://EXAMPLE.ORG/es/x", "https://a.b.example.org/en/15?x#y", "https://example.org/en/2", "https://notexample.org/es/",
    "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://x.com/DE/", "http://cheap-pills.example.net/x", "http://spamfarm.net/", "http://x.net#://b.org/", "http://ünï.org/es/", "://org/a", "http://a.org?q=/es/", "http://spam.org/", "http://x.net/robots.txt", "http://spam.net/robots.txt", "http://1.2.3.4/x", "http://a-b-c-d-e.example.net/", "http://x.net/Login?next=1", "http://x.net/logins", "http://x.net/tag/y/page/2",
    "http://x.net/a.exe#b", "http://x.net/a?PHPSESSID=3", "http://x.net/wp-login.php", "http://x.net/wp-login.phpx", "http://x.net/a.exe.html",
]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(3, "http://x.com/fr/1"), (None, "http://x.com/fr/1")], "page_id bigint, url string")
    for inline in (256, 0):
        got = sorted(((r.page_id if r.page_id is not None else -1), *map(str, (r.host, r.path, r.rule, r.verdict))) for r in url_filter(df, inline_rules=inline).collect())
        assert got == sorted(((r.page_id if r.page_id is not None else -1), *map(str, judge(r.url))) for r in df.collect())
    assert url_filter(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter(df, rules=(), patterns=()).collect()} == {"allow"}


def test_rule_without_tokens(spark):
    df = spark.createDataFrame([(1, "http://例え.例/x"), (2, "http://例/y")], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter(df, rules=(Rule("block", "例", "/x"),)).collect()}
    assert got == {1: "block", 2: "allow"}


def test_literals_are_what_fitting_urls_have():
    said = {r: [set(x) for x in literals(r)] for r in (r"foo", r"^foo$", r"/a[bc]d/", r"/x(1|22)y-", r"/(x-)?b/", r"/(ab|c-d)/", r"a|/b/", r"/a+/", r"/(A|b)c/", r"\bz9\b", r"/(a|b)(c|d)/e", r"^[^/]*/.*$")}
    assert said == {"foo": [], "^foo$": [{"foo"}], "/a[bc]d/": [{"abd", "acd"}], "/x(1|22)y-": [{"x1y", "x22y"}], "/(x-)?b/": [{"b"}], "/(ab|c-d)/": [{"ab", "d"}], "a|/b/": [], "/a+/": [], "/(A|b)c/": [], r"\bz9\b": [{"z9"}], "/(a|b)(c|d)/e": [{"ac", "ad", "bc", "bd"}], "^[^/]*/.*$": []}
    assert sum(not p.tokens() for p in PATTERNS) == 2  # some rules have none


def test_many_rules_by_both_ways(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc1") for _ in range(rng.randint(1, 3)))
    shapes = ["/{}/", "^{}\\.", "/({}|{}-{})($|/)", "[?&]{}=", "-{}[.]{}", "{}-.*/{}", "\\.{}$", "^([a-z]+\\.)?{}-{}", "/{}[0-9]*/{}"]
    rules = tuple(Pattern(f"rule {k}", re.sub(r"\{\}", lambda _: word(), rng.choice(shapes))) for k in range(400))
    urls = [f"http://{word()}{rng.choice('.-')}{word()}.{word()}/{word()}{rng.choice('/-.1')}{word()}/{word()}{rng.choice(['', '?' + word() + '=1', '.' + word()])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    want = {k: next((p.action for p in rules if re.search(p.regex, u[7:])), "none") for k, u in enumerate(urls)}
    assert len(set(want.values())) > 40 and "none" in want.values()
    for inline in (1_000, 0):
        got = {r.page_id: r.verdict for r in url_filter(df, rules=(), patterns=rules, default="none", inline_rules=inline).collect()}
        assert got == want


def test_repositories_decide(spark):
    value = "AbCdEfGhIjKlMnOpQrStUvWxYz0123456789"
    df = spark.createDataFrame([(k, value, "one") for k in range(9)] + [(9, value[::-1], "one")], "doc_id bigint, text string, source string")
    live = lambda docs, **how: [r.doc_id for r in secret_scan(docs, **how).where("n_live > 0").orderBy("doc_id").collect()]
    assert live(df, repo_col="doc_id", max_repos=9) == list(range(10)) and live(df, repo_col="doc_id", max_repos=8) == [9]
    # Without a column for it, copies of a text are one repository and other texts are others.
    assert live(df, max_repos=1) == list(range(10))
    other = spark.createDataFrame([(k, f"{value} in {k}", "one") for k in range(101)], df.schema)
    assert live(other) == [] and live(other.where("doc_id > 0")) == list(range(1, 101))


LONG_URLS = ["a-" * 100_000 + "a.com/x", "a-" * 100_000 + "a/x", "a." + "b-" * 500_000 + "c.org/", "-" * 1_000_000, "." * 1_000_000, "a" * 1_000_000 + ".com/", "a.com/" + "tag/x/page/" * 90_000, "a.com/?" + "sid&" * 250_000, "1." * 500_000, "a.com" + "/login.x" * 120_000, "x_" * 500_000 + "spam", "a.com/" + ".exe?" * 200_000, "a.com" + "/wp-admin1" * 100_000, "é-" * 300_000]


@pytest.mark.parametrize("inline", [256, 0])
def test_very_long_urls(spark, inline):
    df = spark.createDataFrame([(k, "http://" + u) for k, u in enumerate(LONG_URLS)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter(df, inline_rules=inline).select("page_id", "verdict").collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block", 11: "block", 12: "allow", 13: "allow"}


def test_hyphens_as_before(spark):
    hosts = ["a-b-c-d-e.com", "w.a-b-c-d-e.com", "a-b-c-d.com", "a-b--c-d-e-f.com", "-a-b-c-d-e.com", "a-b-c-d-e-.com", "v.w.a-b-c-d-e.com", "a-b-c-d-e-f-g.h"]
    df = spark.createDataFrame([(k, f"https://{h}/") for k, h in enumerate(hosts)], "page_id bigint, url string")
    want = {k: "block" if re.search(r"^([a-z0-9]+\.)?([a-z0-9]+-){4,}[a-z0-9]+\.", h) else "allow" for k, h in enumerate(hosts)}
    assert {r.page_id: r.verdict for r in url_filter(df).collect()} == want


def test_groups_arent_repeated():
    for bad in ("(a-){4,}b", "((x|y)z)*", "(?:ab)+?", "a(b(cd)+)?", "(?=(ab)*)"):
        with pytest.raises(ValueError, match="possessively"):
            Pattern("block", bad)
    for good in ("(ab){2}", "[ab]{4,}x*", "(a-){4,}+b", "(a|b)?"):
        assert Pattern("block", good).regex == good
