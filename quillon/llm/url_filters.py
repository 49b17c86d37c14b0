"""Operator 6, URL filters, in DataFrame functions only: pattern rules indexed by their rarest
literal token; a URL's tokens fetch candidate rules, and only those run regular expressions."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are kept in the plan as a literal index; more go through joins.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains if the path starts with `path`; the longest rule wins."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"(?s)^(?:[^/?#]*\.)?\Q{self.host}\E(?![^/?#])\Q{self.path}\E"

    def tokens(self) -> list[frozenset[str]]:
        """Literal tokens that every fitting URL has whole; the path's last piece may go on."""
        return [frozenset([t]) for t in _tokens(self.host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", _lower(self.path))]


@dataclass(frozen=True)
class Pattern:
    """A regular expression over the lower-cased host, path, query and fragment."""

    action: str
    regex: str

    def __post_init__(self):
        """Java's matcher calls itself once a repetition of a group, so that one long URL would end the
        JVM; a possessive repetition, as {4,}+, is a loop."""
        if _repeats_group(_parser.parse(self.regex)):
            raise ValueError(f"{self.regex}: repeat characters or sets, or a group possessively")

    def tokens(self) -> list[frozenset[str]]:
        """Sets of literal tokens, derived from the expression, of each of which every fitting URL has
        at least one whole. None for an expression that implies none."""
        return literals(self.regex)


def _repeats_group(parsed: list) -> bool:
    """Whether more than a character is repeated, over MOST times, other than possessively."""
    for op, arg in parsed:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            inner = list(arg[2])
            one = len(inner) == 1 and inner[0][0] in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY)
            if op is not C.POSSESSIVE_REPEAT and arg[1] > MOST and not one or _repeats_group(inner):
                return True
        elif op is C.SUBPATTERN and _repeats_group(arg[3]) or op is C.ATOMIC_GROUP and _repeats_group(arg) or op is C.BRANCH and any(map(_repeats_group, arg[1])) or op in (C.ASSERT, C.ASSERT_NOT) and _repeats_group(arg[1]):
            return True
    return False


#: Repetitions of a group that an expression may ask for without a possessive quantifier.
MOST = 100
#: Ways of an expression, and expansions of a stretch of literals, beyond which they aren't used.
EXPANSIONS = 64
_TOKEN = re.compile(r"[a-z0-9]+\Z")
#: What a part of an expression is: an edge between tokens, one if it follows one, or something that
#: tells nothing.
EDGE, SOFT, GAP = "edge", "soft", "gap"


def literals(regex: str) -> list[frozenset[str]]:
    """The alternatives of each stretch of [a-z0-9] that an expression requires between edges of
    tokens: its ends as anchors, characters of no token, or assertions that say so. Of an
    expression of several ways, the longest stretch of each, together."""
    ways = [_stretches(row) for row in _rows(_parser.parse(regex))]
    if len(ways) == 1:
        return ways[0]
    if not all(ways):
        return []
    return [frozenset(t for way in ways for t in max(way, key=lambda ts: (min(map(len, ts)), sorted(ts))))]


def _stretches(row: list) -> list[frozenset[str]]:
    out, run, open_ = [], [[""]], False
    for part in [*row, GAP]:
        if isinstance(part, list):
            run.append(part)
            continue
        edge = part == EDGE or part == SOFT and open_ and len(run) == 1
        said = {"".join(x) for x in itertools.islice(itertools.product(*run), EXPANSIONS + 1)}
        if open_ and edge and len(said) <= EXPANSIONS and all(_TOKEN.match(x) for x in said):
            out.append(frozenset(said))
        run, open_ = [[""]], edge
    return out


def _rows(parsed: list) -> list[list]:
    """The ways of an expression, each in a row: lists of alternative strings of token characters,
    EDGE, SOFT and GAP."""
    rows = [[]]
    for op, arg in parsed:
        ways = [[GAP]]
        if op is C.LITERAL:
            ways = [[_set([(op, arg)])]]
        elif op is C.IN:
            ways = [[_set(arg)]]
        elif op is C.AT and arg in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING, C.AT_BOUNDARY):
            ways = [[EDGE]]
        elif op is C.SUBPATTERN:
            ways = _rows(arg[3])
        elif op is C.BRANCH:
            ways = [w for x in arg[1] for w in _rows(x)]
            if all(w and all(p == EDGE for p in w) for w in ways):
                ways = [[EDGE]]
            elif all(all(isinstance(p, list) for p in w) for w in ways):
                ways = [[["".join(x) for w in ways for x in itertools.islice(itertools.product(*w), EXPANSIONS + 1)]]]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            inner = _rows(arg[2])
            if arg[:2] == (1, 1):
                ways = inner
            elif all(w and w[-1] == EDGE for w in inner):
                ways = [[SOFT if not arg[0] else EDGE if all(p == EDGE for w in inner for p in w) else GAP]]
                ways = [[GAP, EDGE]] if ways == [[GAP]] else ways
        rows = [r + w for r in rows for w in (ways if len(rows) * len(ways) <= EXPANSIONS else [[GAP]])]
    return rows


def _set(items: list) -> object:
    """A set of characters: its few token characters, EDGE if it has none of a token, else GAP."""
    held = set()
    for op, arg in items:
        if op is C.NEGATE:
            out = {chr(c) for o, x in items if o in (C.LITERAL, C.RANGE) for c in ([x] if o is C.LITERAL else range(x[0], x[1] + 1))}
            return EDGE if out.issuperset("abcdefghijklmnopqrstuvwxyz0123456789") else GAP
        if op is C.LITERAL:
            held.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            held |= set(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return GAP
    if all(_TOKEN.match(c) for c in held):
        return sorted(held)
    return GAP if any(c.isalnum() for c in held) else EDGE  # letters of other cases may fold


#: The contract's rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: What judges the URLs that no rule fits, the first that fits: what crawlers are meant to read; words
#: of spam in a host; numbers for a host; hosts of many hyphens; pages for members, shops and
#: administration; files that aren't text; sessions in queries.
PATTERNS = (
    Pattern("allow", r"^[^/?#]*/(robots\.txt|sitemap\.xml|humans\.txt)$"),
    Pattern("block", r"^([^/?#]*[^a-z0-9/?#])?(spam|pills|casino|poker|porn|xxx|viagra|warez|torrent|malware)($|[^a-z0-9])"),
    Pattern("block", r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}($|[:/?#])"),
    Pattern("block", r"^([a-z0-9]+\.)?([a-z0-9]+-){4,}+[a-z0-9]+\."),
    Pattern("block", r"/(wp-admin|wp-login\.php|xmlrpc\.php|cgi-bin)($|[/?#])"),
    Pattern("block", r"/(login|signin|signup|register|logout|cart|checkout)($|[/?#.])"),
    Pattern("block", r"/tag/[^/?#]+/page/[0-9]+"),
    Pattern("block", r"\.(exe|apk|msi|dmg|iso|zip|rar)($|[?#])"),
    Pattern("block", r"[?&](sessionid|phpsessid|jsessionid|sid)="),
)


def _lower(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def _tokens(s: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", _lower(s))


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")


def _url_tokens() -> Column:
    return F.array_distinct(F.split("rest", "[^a-z0-9]+"))


def token_index(parsed: DataFrame, rules: list[Rule | Pattern]) -> dict[str, list[int]]:
    """Each rule's place under the rarest of its literal tokens (under every alternative of it);
    rules without any under "".

    Rarity is the number of rows of `parsed` (column rest) whose URL has the token, counted for
    the rules' tokens only, so what comes to the driver is as large as the rules.
    """
    wanted = sorted({t for r in rules for ts in r.tokens() for t in ts})
    counts = {}
    if wanted:
        rows = parsed.select(F.explode(_url_tokens()).alias("token"))
        names = F.broadcast(parsed.sparkSession.createDataFrame([(t,) for t in wanted], "token string"))
        counts = {r.token: r["count"] for r in rows.join(names, "token").groupBy("token").count().collect()}
    out: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        rarest = min(r.tokens(), key=lambda ts: (sum(counts.get(t, 0) for t in ts), sorted(ts)), default=("",))
        for token in sorted(rarest):
            out.setdefault(token, []).append(k)
    return out


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, patterns: tuple[Pattern, ...] = PATTERNS, default: str = "allow", id_col: str = "page_id", url_col: str = "url", inline_rules: int = INLINE_RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule (the longest fitting one, or null), verdict (the
    rule's, else that of the first fitting pattern, else `default`).

    A null url or one without :// has an empty host and path, and no rule or pattern; nor has one
    with an empty host. Of rules of the same length the later in `rules` wins. Patterns see what
    follows ://, A-Z lower-cased. Repeated ids, urls and rows stay; other columns aren't
    read; an empty table gives an empty table. Up to `inline_rules` rules need no shuffle but
    the token count; more are joined by token, each distinct URL once.
    """
    every = [*rules, *patterns]
    parsed = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.translate(_rest(F.col(url_col)), UPPER, LOWER).alias("rest"))
    index = token_index(parsed, every)
    if len(every) <= inline_rules:
        return _inline(parsed, every, len(rules), index, default)
    return _joined(parsed, every, len(rules), index, default)


def _key(k: int, rule: Rule | Pattern, n_rules: int) -> tuple[int, int]:
    """Sorts rules by precedence, patterns below all rules and the first of them on top."""
    return (len(rule.name), k) if k < n_rules else (-1, -k)


def _inline(parsed: DataFrame, every: list, n_rules: int, index: dict[str, list[int]], default: str) -> DataFrame:
    def entry(k: int) -> Column:
        size, at = _key(k, every[k], n_rules)
        name = F.lit(every[k].name if k < n_rules else None).cast("string")
        return F.struct(F.lit(size).alias("size"), F.lit(at).alias("at"), name.alias("name"), F.lit(every[k].action).alias("action"), F.lit(k < n_rules).alias("rule"), F.lit(every[k].regex).alias("regex"))

    if not every:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    literal = F.create_map(*(x for token, ks in index.items() for x in (F.lit(token), F.array(*map(entry, ks)))))
    keys = F.array(*map(F.lit, index))
    tokens = F.array_union(F.array_intersect(_url_tokens(), keys), F.array_intersect(F.array(F.lit("")), keys))
    candidates = F.flatten(F.transform(tokens, lambda t: F.element_at(literal, t)))
    fits = F.filter(candidates, lambda r: F.rlike(F.when(r["rule"], F.concat("host", "path")).otherwise(F.col("rest")), r["regex"]) & (F.col("host") != ""))
    best = parsed.withColumn("best", F.array_max(fits))
    return best.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def _joined(parsed: DataFrame, every: list, n_rules: int, index: dict[str, list[int]], default: str) -> DataFrame:
    spark = parsed.sparkSession
    rows = [(token, *_key(k, every[k], n_rules), every[k].name if k < n_rules else None, every[k].action, k < n_rules, every[k].regex) for token, ks in index.items() for k in ks]
    table = spark.createDataFrame(rows, "token string, size int, at int, name string, action string, is_rule boolean, regex string")
    urls = parsed.select("host", "path", "rest").where("host <> ''").distinct()
    tokens = urls.withColumn("token", F.explode(F.array_union(_url_tokens(), F.array(F.lit("")))))
    fits = tokens.join(table, "token").where(F.rlike(F.when(F.col("is_rule"), F.concat("host", "path")).otherwise(F.col("rest")), F.col("regex")))
    best = fits.groupBy("host", "path", "rest").agg(F.max(F.struct("size", "at", "name", "action")).alias("best"))
    return parsed.join(best, ["host", "path", "rest"], "left").select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
