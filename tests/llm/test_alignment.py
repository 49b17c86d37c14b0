"""Operator 11 against plain Python over both libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import _bpe, alignment
from quillon.llm.alignment import BITS, align_chunks, aligned_tokens, grouped, linked, pair_counts
from quillon.llm.queries import QUERIES

from .data import documents, empty, table
from .test_tokens import fuzz

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ALPHABET = _bpe._byte_alphabet()
A_BYTES = {i: bytes(ALPHABET.get(c, 0) for c in t) for t, i in A.get_vocab(with_added_tokens=False).items()}


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def groups(text):
    """The groups of a text as pairs of id lists, by walking along both rows of tokens."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    said = (" " + text).encode()
    if b"".join(A_BYTES[i] for i in a) != said or b"".join(map(b_bytes, b)) != said:
        return []
    ends = []
    for ids, width in ((a, A_BYTES.__getitem__), (b, b_bytes)):
        at = 0
        ends.append([at := at + len(width(i)) for i in ids])
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for c in cuts:
        x, y = [], []
        while i < len(a) and ends[0][i] <= c:
            x.append(a[i])
            i += 1
        while j < len(b) and ends[1][j] <= c:
            y.append(b[j])
            j += 1
        out.append((x, y))
    return out


def brute(rows):
    held = [(k, groups(t)) for k, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in held]
    counts = Counter(p for c in links for p in c)
    most: dict = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (k, g), c in zip(held, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out, counts


def plain(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


HARD = [*fuzz(1500), "▁a b", "a▁ b", "中文 字 \U0001f600", "a\n\n\nb  c\t d", " ", "  ", "\n", "\x00 a", "<0x41> <s> </s> <|endoftext|>", "xy" * 700, "q" * 900, "é" * 300 + " ü"]


def test_hostile_rows_equal_brute_force(spark):
    df = table(spark, [(k, t, *[None] * 7) for k, t in enumerate(HARD)]).unionByName(table(spark)).repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, counts = brute(rows)
    assert plain(alignment.alignment(df).collect()) == plain(want)
    got = {(r.a_id, r.b_id): r.n_docs for r in pair_counts(align_chunks(df)).collect()}
    assert got == counts


def test_small_passes_and_caches_change_nothing(spark, monkeypatch):
    texts = [(k, t) for k, t in enumerate(HARD)]
    words = pa.array([b" " + t.encode() for _, t in texts if t], pa.binary())
    aligner = alignment._Aligner(*alignment._paths(None, None))
    g = grouped(words, aligner.first, aligner.second)
    whole = linked(g)
    monkeypatch.setattr(alignment, "LINKS", 7)
    for x, y in zip(linked(g), whole, strict=True):
        assert np.array_equal(x, y)
    assert whole[2].sum() == len(whole[0]) == len({(k, p) for k, p in zip(np.repeat(np.arange(len(g.n)), whole[2]).tolist(), whole[0].tolist(), strict=True)})
    assert all(p >> BITS < 50257 for p in whole[0].tolist())


def test_aligned_tokens(spark):
    df = table(spark).repartition(2)
    for r, want in ((r, groups(r.text)) for r in aligned_tokens(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect()):
        got = [([], []) for _ in want]
        for side, (ids, of) in enumerate(((r.a_ids, r.a_groups), (r.b_ids, r.b_groups))):
            for i, k in zip(ids, of, strict=True):
                got[k][side].append(i)
        assert got == want


def test_empty_table(spark):
    assert alignment.alignment(empty(spark)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = QUERIES["op11_alignment"](spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert plain(got) == plain(brute(rows)[0])
