"""Number and text conversions, digests, encodings, URLs, HTML, MIME, CSV and JSON."""

from __future__ import annotations

import email
import functools
import hashlib
import hmac as _hmac
import html as _html
from email.message import Message

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# -- numbers as texts ------------------------------------------------------------------------


def atoi(s: Column) -> Column:
    """Raises where the text isn't an integer."""
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.cast("bigint")).when(s.isNotNull(), F.raise_error(F.concat(F.lit("invalid syntax: "), s)).cast("bigint"))


def itoa(n: Column) -> Column:
    return n.cast("string")


def format_int(n: Column, base: int) -> Column:
    return F.when(n < 0, F.concat(F.lit("-"), F.lower(F.conv((-n).cast("string"), 10, base)))).otherwise(F.lower(F.conv(n.cast("string"), 10, base)))


def parse_int(s: Column, base: int = 10) -> Column:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    body = F.regexp_replace(F.lower(s), "^[+-]", "")
    good = F.lower(s).rlike(rf"^[+-]?[{digits}]+$")
    value = F.conv(body, base, 10).cast("decimal(20,0)") * F.when(s.startswith("-"), -1).otherwise(1)
    return F.when(good, value.cast("bigint")).when(s.isNotNull(), F.raise_error(F.concat(F.lit("invalid syntax: "), s)).cast("bigint"))


def format_bool(b: Column) -> Column:
    return b.cast("string")


def parse_bool(s: Column) -> Column:
    """By the spellings 1 t T TRUE true True and 0 f F FALSE false False; others raise."""
    wrong = F.when(s.isNotNull(), F.raise_error(F.concat(F.lit("invalid syntax: "), s)).cast("boolean"))
    return F.when(s.isin("1", "t", "T", "TRUE", "true", "True"), True).when(s.isin("0", "f", "F", "FALSE", "false", "False"), False).otherwise(wrong)


def parse_double(s: Column) -> Column:
    return s.cast("double")


def format_double(x: Column, precision: int, kind: str = "f") -> Column:
    """Kinds f and e, with that many digits."""
    text = F.format_string(f"%.{precision}{kind}", x.cast("double"))
    return text


def is_graphic(c: Column) -> Column:
    """Letters, marks, numbers, punctuation, symbols and spaces."""
    return c.rlike(r"\A[\p{L}\p{M}\p{N}\p{P}\p{S}\p{Zs}]\z")


def is_printable(c: Column) -> Column:
    """The same, of the spaces only U+0020."""
    return c.rlike(r"\A[\p{L}\p{M}\p{N}\p{P}\p{S} ]\z")


def can_backquote(s: Column) -> Column:
    return ~s.rlike(r"[`\x00-\x08\x0A-\x1F\x7F\x{FEFF}]")


#: Escapes of quoted literals.
_ESCAPES = {"\a": r"\a", "\b": r"\b", "\f": r"\f", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\v": r"\v", "\\": r"\\"}


def _quote(s: str, mark: str, ascii_only: bool, graphic: bool) -> str:
    import unicodedata

    out = []
    for c in s:
        kind = unicodedata.category(c)
        if c == mark:
            out.append("\\" + c)
        elif c in _ESCAPES:
            out.append(_ESCAPES[c])
        elif " " <= c <= "~" or not ascii_only and ord(c) > 0x7E and (kind[0] in "LMNPS" or graphic and kind == "Zs"):
            out.append(c)
        elif ord(c) < 0x80:
            out.append(f"\\x{ord(c):02x}")
        else:
            out.append(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}")
    return mark + "".join(out) + mark


def _unquote(s: str) -> str:
    if len(s) >= 2 and s[0] == s[-1] == "`" and "`" not in s[1:-1]:
        return s[1:-1].replace("\r", "")
    if len(s) < 2 or s[0] != s[-1] or s[0] not in "\"'":
        raise ValueError(f"invalid syntax: {s}")
    import re

    plain = {v[1]: k for k, v in _ESCAPES.items()} | {'"': '"', "'": "'"}

    def one(m: re.Match) -> str:
        x = m[1]
        return plain[x] if x in plain else chr(int(x[1:], 16)) if x[0] in "xuU" else chr(int(x, 8))

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", one, s[1:-1])



def quote(s: Column, ascii_only: bool = False, graphic: bool = False) -> Column:
    return _series(lambda x: _quote(x, '"', ascii_only, graphic))(s)


def quote_char(c: Column, ascii_only: bool = False, graphic: bool = False) -> Column:
    return _series(lambda x: _quote(x, "'", ascii_only, graphic))(c)


def unquote(s: Column) -> Column:
    return _series(_unquote)(s)


def _each(s: pd.Series, f) -> pd.Series:
    """f of each value but nulls; equal values of a batch are given to it once."""
    known: dict = {}
    return s.map(lambda x: None if x is None else known[x] if x in known else known.setdefault(x, f(x)))


def _series(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, f)

    return run


#: Texts of at most so many characters are parsed once, of the last so many: a worker holds some 10 MB.
SHORT, LAST = 2_048, 1_024


def _remembered(f):
    """f of a text, its result held for a while; results aren't to be changed."""
    held = functools.lru_cache(LAST)(f)
    return functools.wraps(f)(lambda x: held(x) if len(x) <= SHORT else f(x))


# -- digests and encodings -------------------------------------------------------------------


def md5(s: Column) -> Column:
    """The digests are raw bytes."""
    return F.unhex(F.md5(s.cast("binary")))


def sha1(s: Column) -> Column:
    return F.unhex(F.sha1(s.cast("binary")))


def sha2(s: Column, bits: int) -> Column:
    """224, 256, 384 or 512 bits."""
    return F.unhex(F.sha2(s.cast("binary"), bits))


def sha512_truncated(s: Column, bits: int) -> Column:
    """SHA-512/224 and SHA-512/256."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda x: hashlib.new(f"sha512_{bits}", bytes(x)).digest())

    return run(s.cast("binary"))


def hmac(message: Column, key: str, algorithm: str = "sha256") -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda x: _hmac.new(key.encode(), bytes(x), algorithm).digest())

    return run(message.cast("binary"))


def base64_encode(s: Column) -> Column:
    return F.base64(s.cast("binary"))


def base64_decode(s: Column) -> Column:
    return F.unbase64(s).cast("string")


def hex_encode(s: Column) -> Column:
    return F.lower(F.hex(s.cast("binary")))


def hex_decode(s: Column) -> Column:
    return F.unhex(s).cast("string")


def uuid_new() -> Column:
    return F.uuid()


# -- URLs and HTML ---------------------------------------------------------------------------


def query_escape(s: Column) -> Column:
    """All but letters, digits and - _ . ~ escaped; a space is +."""
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_unescape(s: Column) -> Column:
    return F.url_decode(s)


def path_escape(s: Column) -> Column:
    """For one path segment: a space is %20, and $ & + = : @ stay."""
    out = F.replace(query_escape(s), F.lit("+"), F.lit("%20"))
    for code, char in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def path_unescape(s: Column) -> Column:
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def parse_query(s: Column) -> Column:
    """A map from each key to its values, in order."""
    pairs = F.filter(F.split(s, "&"), lambda p: p != "")
    cut = F.transform(pairs, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), F.url_decode(F.substr(p, F.instr(p, "=") + F.lit(1)))).otherwise("").alias("v")))
    keys = F.array_distinct(F.transform(cut, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.transform(F.filter(cut, lambda e: e["k"] == k), lambda e: e["v"]).alias("v"))))


def html_escape(s: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def html_unescape(s: Column) -> Column:
    return _series(_html.unescape)(s)


#: Elements without a closing tag.
_VOID = "area base br col embed hr img input link meta param source track wbr".split()


def hiccup(tree: object) -> str:
    """HTML of nested lists [tag, {attributes}, content ...]; tag may be like div#id.class. Text is
    escaped unless it is a RawHtml."""
    if isinstance(tree, RawHtml):
        return str(tree)
    if not isinstance(tree, list | tuple):
        return "" if tree is None else _html.escape(str(tree)).replace("&#x27;", "&#39;").replace("&quot;", "&#34;")
    if not tree or not isinstance(tree[0], str) or isinstance(tree[0], RawHtml):
        return "".join(map(hiccup, tree))
    import re

    tag, ident, classes = re.fullmatch(r"([^.#]*)(?:#([^.]*))?((?:\.[^.]+)*)", tree[0]).groups()
    attributes = dict(tree[1]) if len(tree) > 1 and isinstance(tree[1], dict) else {}
    content = tree[2:] if len(tree) > 1 and isinstance(tree[1], dict) else tree[1:]
    if ident:
        attributes.setdefault("id", ident)
    if classes:
        attributes["class"] = " ".join(filter(None, [classes[1:].replace(".", " "), attributes.get("class")]))
    said = "".join(f' {k}="{hiccup(k if v is True else v)}"' for k, v in sorted(attributes.items()) if v not in (None, False))
    return f"<{tag}{said} />" if tag in _VOID else f"<{tag}{said}>{''.join(map(hiccup, content))}</{tag}>"


class RawHtml(str):
    """HTML that hiccup() takes as it is."""


def hiccup_json(s: Column) -> Column:
    """hiccup() of a column of JSON texts."""
    import json

    return _series(lambda x: hiccup(json.loads(x)))(s)


# -- MIME ------------------------------------------------------------------------------------

MIME_TYPE = "struct<type:string,params:map<string,string>>"
MIME_PARTS = "array<struct<content_type:string,filename:string,size:int,text:string>>"


@_remembered
def _media_type(s: str) -> dict:
    m = Message()
    m["content-type"] = s
    params = m.get_params(failobj=[], header="content-type")
    return {"type": params[0][0].lower() if params else None, "params": {k.lower(): v for k, v in params[1:]}}


def parse_media_type(s: Column) -> Column:
    @F.udf(MIME_TYPE, useArrow=True)
    def run(x):
        return None if x is None else _media_type(x)

    return run(s)


@_remembered
def _leaves(raw: str) -> list[dict]:
    out = []
    for part in email.message_from_string(raw).walk():
        if not part.is_multipart():
            data = part.get_payload(decode=True) or b""
            text = data.decode(part.get_content_charset() or "utf-8", "replace") if part.get_content_maintype() == "text" else None
            out.append({"content_type": part.get_content_type(), "filename": part.get_filename(), "size": len(data), "text": text, "_attachment": part.get_content_disposition() == "attachment"})
    return out


def read_entity(raw: Column) -> Column:
    """The leaf parts of a MIME message."""

    @F.udf(MIME_PARTS, useArrow=True)
    def run(x):
        return None if x is None else [{k: v for k, v in p.items() if k[0] != "_"} for p in _leaves(x)]

    return run(raw)


def mime_attachments(raw: Column) -> Column:
    @F.udf(MIME_PARTS, useArrow=True)
    def run(x):
        return None if x is None else [{k: v for k, v in p.items() if k[0] != "_"} for p in _leaves(x) if p["_attachment"] or p["filename"]]

    return run(raw)


def mime_body(raw: Column) -> Column:
    """The first plain text that is no attachment, else the first HTML."""

    def body(x: str) -> str | None:
        parts = [p for p in _leaves(x) if not p["_attachment"]]
        return next((p["text"] for kind in ("text/plain", "text/html") for p in parts if p["content_type"] == kind), None)

    return _series(body)(raw)


def decode_transfer_encoding(encoding: str, content: Column) -> Column:
    """base64 and quoted-printable content as bytes; other encodings leave it."""
    import base64
    import quopri

    decode = {"base64": lambda x: base64.b64decode(x), "quoted-printable": lambda x: quopri.decodestring(x)}.get(encoding.lower(), lambda x: x)

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda x: decode(bytes(x)))

    return run(content.cast("binary"))


# -- CSV and JSON ----------------------------------------------------------------------------


def json_read(s: Column, schema: str | None = None) -> Column:
    """A VARIANT, or a value of the given schema."""
    return F.parse_json(s) if schema is None else F.from_json(s, schema)


def json_write(x: Column) -> Column:
    return F.to_json(x)


def csv_read(s: Column, schema: str, separator: str = ",") -> Column:
    return F.from_csv(s, schema, {"sep": separator})


def csv_write(x: Column, separator: str = ",") -> Column:
    return F.to_csv(x, {"sep": separator})
