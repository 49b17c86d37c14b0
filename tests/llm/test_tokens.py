"""Operators 1 and 4 against the libraries whose tokens they give."""

import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from quillon.llm import _bpe
from quillon.llm.bpe_codec import bpe_decode, bpe_digests, bpe_encode
from quillon.llm.token_counts import count_texts, token_counts

from .data import documents, empty, table

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def fuzz(n: int) -> list[str]:
    rng = random.Random(4)
    alphabet = list("  \n\t'stmdrevll aZ9!.#é 　中\U0001f600½\x1c\x85_=") + ["<|endoftext|>", "'ll", "'re"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_monoid_scan_is_associative():
    _, table_, action, _ = _bpe._monoid()
    n = len(action)
    for a in range(n):
        for b in range(n):
            for c in range(n):
                assert table_[table_[a * n + b] * n + c] == table_[a * n + table_[b * n + c]]


def test_counts_match_library():
    texts = [*fuzz(3000), "=" * 5000, "a" * 5000, " " * 5000]
    got = count_texts([t.encode() for t in texts], public_tokenizers.path("byte_bpe_50k.json"))
    assert got.tolist() == [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_encode_matches_library(spark):
    texts = [t for t in fuzz(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    encoded = bpe_encode(df)
    got = {r.doc_id: r for r in encoded.collect()}
    for k, t in enumerate(texts):
        assert got[k].ids == ENCODING.encode_ordinary(t)
        at = 0
        for i, offset in zip(got[k].ids, got[k].offsets, strict=True):
            assert offset == at
            at += len(ENCODING.decode_single_token_bytes(i))
    assert {r.doc_id: bytes(r.text).decode() for r in bpe_decode(encoded).collect()} == dict(enumerate(texts))


def test_hostile_rows(spark):
    df = table(spark)
    want = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
    counts = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df).collect())
    assert counts == sorted((k, len(t.encode()), n := len(TOKENIZER.encode(t, add_special_tokens=False).ids), n > 512) for k, t in want)
    digests = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(df).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == sorted((k, len(ids := ENCODING.encode_ordinary(t)), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for k, t in want)
    assert token_counts(empty(spark)).count() == bpe_digests(empty(spark)).count() == bpe_encode(empty(spark)).count() == 0


def test_sf_documents(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(documents(spark)).collect()} == {k: len(TOKENIZER.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
