"""Operator 13 against the library, with exact round trips and single ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import _pieces, token_files
from quillon.llm._base import new_path
from quillon.llm.queries import QUERIES
from quillon.llm.token_files import TokenFiles, decode_levels, encode_levels, get, widths_for

from .data import documents, empty, table
from .test_tokens import fuzz

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def library(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**32 - 1)), max_size=1500))
def test_levels_give_every_id_back(values):
    ids = np.array(values, np.uint32)
    levels = encode_levels(ids)
    assert decode_levels(levels).tolist() == values
    assert get(levels, np.arange(len(ids))).tolist() == values
    assert get(levels, np.arange(len(ids))[::-1][:7]).tolist() == values[::-1][:7]


def test_widths_are_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(0, 50, 12)
        lengths[11] += 1

        def cost(widths, lengths=lengths):
            at, total = 0, 0
            for w in widths:
                n = lengths.sum() if at == 0 else lengths[at + 1 :].sum()
                total += n * (w + (at + w < 11))
                at += w
            return total

        def splits(bits):
            return [[]] if bits == 0 else [[w, *rest] for w in range(1, min(8, bits) + 1) for rest in splits(bits - w)]

        assert cost(widths_for(lengths)) == min(map(cost, splits(11)))


@pytest.mark.parametrize("special", [True, False])
def test_pieces_have_the_library_s_ids(special):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = not special
    texts = [*fuzz(4000), "a\t  b", "a  b", "x\n\n\ny z\n", " a", "\n", "a b", "".join(map(chr, range(0x20, 0x2100))), "".join(f"a{chr(c)} b" for c in range(1, 0x3002) if not 0xD800 <= c < 0xE000)]

    class Ids(token_files._Encoder):
        def __init__(self):
            self.vocabulary, self.end = _pieces.byte_vocabulary(PATH, special=special), 0
            _pieces.Known.__init__(self)

    ids, counts = Ids().encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    got = [ids[a : b - 1].tolist() for a, b in zip(ends - counts, ends, strict=True)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(_pieces, "CACHE_PIECES", 50)
    encoder = token_files._Encoder(PATH, 7)
    for t in fuzz(300):
        ids, counts = encoder.encode([t.encode(), b""])
        assert ids.tolist() == [*library(t), 7, 7] and counts.tolist() == [len(ids) - 1, 1]


def expected(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


@pytest.mark.parametrize("segment", [1, 3000, token_files.SEGMENT])
def test_hostile_rows(spark, segment):
    df = table(spark).repartition(3)
    files = TokenFiles(spark, new_path(spark, "tokens"))
    files.write(df, segment=segment)
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    ordered = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want, total = expected([(r.doc_id, r.text) for r in ordered])
    got = [tuple(r) for r in files.checksums().collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    ids = [i for r in sorted(files.documents().collect(), key=lambda r: r.start) for i in r.ids]
    assert len(ids) == total == files.parts().agg(F.sum("n_tokens")).first()[0]
    places = [0, 1, total // 2, total - 1]
    assert [files.token(k) for k in (places[0], places[2], places[3])] == [ids[0], ids[total // 2], ids[-1]]
    assert files.token(total) is None and files.token(-1) is None
    asked = spark.createDataFrame([(k,) for k in [*range(0, total, 37), *places, 5, 5, total, -1, None]], "position bigint")
    assert {r.position: r.id for r in files.tokens(asked).collect()} == {k: ids[k] for k in {*range(0, total, 37), *places, 5}}


def test_empty_table(spark):
    files = TokenFiles(spark, new_path(spark, "tokens"))
    files.write(empty(spark))
    assert files.checksums().count() == files.documents().count() == 0 and files.token(0) is None


def test_one_id_for_many_rows_is_dealt_out(spark):
    df = spark.range(4000).selectExpr("1L AS doc_id", "'same text ' AS text").repartition(4)
    files = TokenFiles(spark, new_path(spark, "tokens"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [r.n_docs for r in files.parts().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in documents(spark).collect())
    got = [tuple(r) for r in QUERIES["op13_token_files"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == expected(rows)[0]
