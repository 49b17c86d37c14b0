"""Byte-level BPE on arrays: pre-tokens by a transition-function scan, merges on ragged arrays.

The pre-token rule is the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
read as a finite automaton over codepoint classes. Each character is a function from states to
states; the functions of that automaton form a small monoid, so their composition is a table
lookup, and the state before every character is an associative prefix scan over uint8 arrays.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json

import numpy as np
import pyarrow as pa
import tiktoken

SEPARATOR = 0x110000
#: Input symbols. MARK is an apostrophe that may open a contraction, MIDDLE and LAST are the
#: letters that would close it; the "last" white space comes before something else.
L, N, O, MARK, MIDDLE, LAST, SPACE_LAST, WHITE_LAST, WHITE, RESET = range(10)
#: States: what the automaton has just read; START also after a whole contraction and after the
#: last white space, HELD after a last space, which the next character joins.
START, IN_L, IN_N, IN_O, HELD, IN_W, CONTRACTION = range(7)
_READS = {L: IN_L, MIDDLE: IN_L, LAST: IN_L, N: IN_N, O: IN_O, SPACE_LAST: HELD, WHITE_LAST: START, WHITE: IN_W}


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the character opens a pre-token."""
    if symbol == RESET:
        return START, True
    if state == CONTRACTION and symbol in (MIDDLE, LAST):
        return (CONTRACTION if symbol == MIDDLE else START), False
    if symbol == MARK:
        return (IN_O, False) if state in (IN_O, HELD) else (CONTRACTION, True)
    to = _READS[symbol]
    return to, symbol in (SPACE_LAST, WHITE_LAST) or state not in (to, HELD)


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Generators by symbol, the composition table (flat), each element's action, openings."""
    generators = [tuple(_step(s, x)[0] for s in range(7)) for x in range(10)]
    elements = list(dict.fromkeys([tuple(range(7)), *generators]))
    for a in elements:  # grows while it is read
        for g in generators:
            c = tuple(g[x] for x in a)
            if c not in elements:
                elements.append(c)
    index, n = {e: i for i, e in enumerate(elements)}, len(elements)
    assert n <= 256
    table = np.array([[index[tuple(b[x] for x in a)] for b in elements] for a in elements], np.uint8)
    opens = np.array([[_step(s, x)[1] for x in range(10)] for s in range(7)], bool)
    return np.array([index[g] for g in generators], np.uint8), table.ravel(), np.array(elements, np.uint8), opens.ravel()


def _prefix(x: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix compositions of the elements x, left to right."""
    _, table, action, _ = _monoid()
    size = len(action)
    if len(x) <= 4 * width:
        out = list(itertools.accumulate(x.tolist(), lambda a, b: table[a * size + b]))
        return np.array(out, np.uint8)
    blocks = -(-len(x) // width)
    grid = np.zeros(blocks * width, np.uint8)
    grid[: len(x)] = x
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    for j in range(1, width):
        grid[j] = table[grid[j - 1].astype(np.int32) * size + grid[j]]
    carry = np.zeros(blocks, np.int32)
    carry[1:] = _prefix(grid[-1], width)[:-1]
    grid = table[(carry * size)[None, :] + grid]
    return grid.T.reshape(-1)[: len(x)]


@functools.cache
def _classes() -> np.ndarray:
    """L, N, O or white space of every codepoint, SEPARATOR included."""
    every = "".join(chr(c) for c in range(SEPARATOR) if not 0xD800 <= c < 0xE000)
    out = np.full(SEPARATOR + 1, O, np.uint8)
    for kind, name in ((L, "L"), (N, "N")):  # by the Unicode version of the library to match
        found = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(found.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[SEPARATOR] = RESET
    return out


def pre_tokens(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes in a row, where each pre-token begins in them, and how many each has."""
    joined = b"".join(texts)
    generator, _, action, opens = _monoid()
    points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    ascii_only = len(points) == len(joined)
    lengths = np.array([len(t) for t in texts] if ascii_only else [len(t.decode()) for t in texts], np.int64)
    ends = np.cumsum(lengths) + np.arange(1, len(texts) + 1)
    cp = np.empty(len(points) + len(texts), np.uint32)
    at = 0
    for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
        cp[end - 1 - n : end - 1] = points[at : at + n]
        cp[end - 1] = SEPARATOR
        at += n
    symbol = _classes()[cp]
    white = symbol == WHITE
    last = white.copy()
    last[:-1] &= ~white[1:] & (symbol[1:] != RESET)  # every text ends in a separator
    symbol[last] = WHITE_LAST
    symbol[last & (cp == 0x20)] = SPACE_LAST
    quote = np.flatnonzero(cp == 0x27)
    if len(quote):
        one, two = cp[np.minimum(quote + 1, len(cp) - 1)], cp[np.minimum(quote + 2, len(cp) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[quote[short | long]] = MARK
        symbol[quote[short] + 1] = LAST
        symbol[quote[long] + 1], symbol[quote[long] + 2] = MIDDLE, LAST
    state = np.empty(len(cp), np.uint8)
    state[:1] = START
    state[1:] = action[:, START][_prefix(generator[symbol])[:-1]]
    begins = opens[state.astype(np.int32) * 10 + symbol] & (symbol != RESET)
    where = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(where, ends), prepend=0)
    if ascii_only:
        return joined, where - np.repeat(np.arange(len(texts)), counts), counts
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    width[cp == SEPARATOR] = 0
    return joined, (np.cumsum(width) - width)[where], counts


def distinct(joined: bytes, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each slice's place among the distinct slices, and those."""
    offsets = np.append(starts, len(joined)).astype(np.int32)
    slices = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    coded = slices.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Pairs:
    """rank and merged id of a pair of ids, by a hash table with one probe and sorted rest."""

    BITS = 19

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        first = np.ones(len(keys), bool)
        first[1:] = slot[order][1:] != slot[order][:-1]
        here, rest = order[first], order[~first]
        rest = rest[np.argsort(keys[rest])]
        self.key = np.full(1 << self.BITS, 2**64 - 1, np.uint64)
        self.at = np.zeros(1 << self.BITS, np.int32)
        self.more = np.zeros(1 << self.BITS, bool)
        self.key[slot[here]], self.at[slot[here]], self.more[slot[rest]] = keys[here], here, True
        self.rest_key, self.rest_at = keys[rest], rest
        self.rank, self.merged = np.append(rank, NEVER).astype(np.int32), np.append(merged, 0).astype(np.int32)
        least = np.full(int(max(left.max(), right.max(), merged.max())) + 1, NEVER, np.int64)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        #: Whether the merged id may at once merge on with a lower rank than its own.
        self.hasty = np.append(least[merged] < rank, False)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's place in rank and merged; the last place, of rank NEVER, for no pair."""
        keys = left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)
        slot = self._slot(keys)
        hit = self.key[slot] == keys
        out = np.where(hit, self.at[slot], len(self.rank) - 1)
        other = np.flatnonzero(~hit & self.more[slot])
        if len(other) and len(self.rest_key):
            k = np.minimum(np.searchsorted(self.rest_key, keys[other]), len(self.rest_key) - 1)
            good = self.rest_key[k] == keys[other]
            out[other[good]] = self.rest_at[k[good]]
        return out


NEVER = 2**31 - 1


def merge(words: pa.Array, byte_ids: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids in a row, and each word's number of ids.

    Rank-synchronous: in every round each word merges its own lowest-ranked pair, all words at
    once. The same pair's further places in a word come next in any case, and merge in that
    round too, from the left, unless the merged id has a pair of a lower rank. Words without a
    pair left leave the arrays.
    """
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    ids, sizes = byte_ids[data], np.diff(offsets).astype(np.int64)
    word = np.arange(len(words))
    kept, kept_words = [], []
    counts = sizes.copy()
    while len(ids):
        starts = np.cumsum(sizes) - sizes
        at = np.full(len(ids), len(pairs.rank) - 1)
        at[:-1] = pairs.find(ids[:-1], ids[1:])
        at[starts + sizes - 1] = len(pairs.rank) - 1
        rank = pairs.rank[at]
        lowest = np.minimum.reduceat(rank, starts)
        live = lowest < NEVER
        if not live.all():
            symbols = np.repeat(live, sizes)
            kept.append(ids[~symbols])
            kept_words.append((word[~live], sizes[~live]))
            ids, at, rank = ids[symbols], at[symbols], rank[symbols]
            word, sizes, lowest = word[live], sizes[live], lowest[live]
            if not len(ids):
                break
        hit = rank == np.repeat(lowest, sizes)
        where = np.flatnonzero(hit)
        near = np.flatnonzero(np.diff(where) == 1)
        if len(near):  # x x x: of adjacent places every second one, from the left
            run = np.ones(len(where), bool)
            run[1:] = np.diff(where) != 1
            first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - first) % 2 == 0]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        hasty = pairs.hasty[at[where]]
        if hasty.any():
            again = np.zeros(len(where), bool)
            again[1:] = owner[where][1:] == owner[where][:-1]
            where = where[~(hasty & again)]
        ids[where] = pairs.merged[at[where]]
        stay = np.ones(len(ids), bool)
        stay[where + 1] = False
        sizes = sizes - np.bincount(owner[where], minlength=len(sizes))
        ids = ids[stay]
    flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
    names = np.concatenate([w for w, _ in kept_words]) if kept_words else np.zeros(0, np.int64)
    got = np.concatenate([s for _, s in kept_words]) if kept_words else np.zeros(0, np.int64)
    counts[names] = got
    begin = np.zeros(len(words), np.int64)
    begin[names] = np.cumsum(got) - got
    return ragged(flat, begin, counts), counts


def ragged(flat: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[begin : begin + count] of each row, in a row."""
    total = int(counts.sum())
    return flat[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(total)] if total else flat[:0]


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in .json vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class JsonVocabulary:
    """byte-level BPE of a tokenizers .json file: its merge list, and its added tokens."""

    def __init__(self, path: str):
        said = json.load(open(path, encoding="utf-8"))
        model = said["model"]
        if model["type"] != "BPE" or said["pre_tokenizer"]["type"] != "ByteLevel" or said["normalizer"]:
            raise ValueError(f"{path}: not a byte-level BPE without normalizer")
        vocab, alphabet = model["vocab"], _byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocab[char]
        a, b, c = (np.array([vocab[x] for x in xs]) for xs in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        self.pairs = Pairs(a, b, np.arange(len(merges)), c)
        self.added = [t["content"].encode() for t in said["added_tokens"]]
        self.added_ids = [t["id"] for t in said["added_tokens"]]
        named = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t.encode() not in self.added}
        named |= dict(zip(self.added_ids, self.added, strict=True))
        self.tokens = [named.get(i, b"") for i in range(max(named) + 1)]


class RankVocabulary:
    """byte-level BPE of a rank file: a pair merges if its bytes are a token, lowest rank first."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a, b, r = (np.array(x) for x in zip(*found, strict=True))
        self.pairs = Pairs(a, b, r, r)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> JsonVocabulary | RankVocabulary:
    return JsonVocabulary(path) if path.endswith(".json") else RankVocabulary(path)
