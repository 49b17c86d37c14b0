"""Texts cut into pieces whose tokens don't depend on what stands around them, and what a worker has
learnt of each piece.

A piece begins at a space or newline after something that isn't white space. The pre-token rule of
byte-level vocabularies looks at nothing before a token's beginning, and no token of it goes on from
something else into white space, so cutting there changes nothing. A piece vocabulary is asked whether
one of its own pieces does (PieceVocabulary.whole).
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import sentencepiece

from . import _bpe

#: Pieces, and bytes of them, that a worker holds before it starts anew.
CACHE_PIECES, CACHE_BYTES = 700_000, 16 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), 0x20]] = True
#: Last bytes of white space beyond ASCII, with what stands before them.
_WIDE = [(0x85, (0xC2,)), (0xA0, (0xC2,)), (0x80, (0xE1, 0x9A)), *((x, (0xE2, 0x80)) for x in [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), (0x9F, (0xE2, 0x81)), (0x80, (0xE3, 0x80))]


def cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes in a row, where each piece begins in them, and how many pieces each has."""
    joined = b"".join(texts)
    b = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    white = _WHITE[b]
    if len(b) and b.max() > 0x7F:
        at = np.flatnonzero((b >= 0x80) & (b < 0xC0))
        for last, before in _WIDE:
            hit = at[b[at] == last]
            for k, x in enumerate(reversed(before)):
                hit = hit[b[np.maximum(hit - k - 1, 0)] == x]
            white[hit] = True
    begins = (b == 0x20) | (b == 0x0A)
    begins[1:] &= ~white[:-1]
    begins[(ends - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(begins)
    return joined, starts, np.diff(np.searchsorted(starts, ends), prepend=0)


class Grown:
    """An array that is appended to."""

    def __init__(self, dtype: type):
        self.data, self.n = np.zeros(1024, dtype), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            wider = np.zeros(max(2 * len(self.data), self.n + len(x)), self.data.dtype)
            wider[: self.n] = self.data[: self.n]
            self.data = wider
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)

    def view(self) -> np.ndarray:
        return self.data[: self.n]


class Known:
    """Places of the pieces that a worker has met; a subclass learns what each piece gives."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0

    def learn(self, words: pa.Array) -> None:
        """Appends what each of the new pieces gives, in their order."""
        raise NotImplementedError

    def places(self, joined: bytes, starts: np.ndarray) -> np.ndarray:
        if len(self.place) > CACHE_PIECES or self.held > CACHE_BYTES:
            self.forget()
        slot, words = _bpe.distinct(joined, starts)
        names = words.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes a scalar of each first
        place = np.fromiter(map(self.place.get, names, itertools.repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, at = [names[k] for k in missing.tolist()], len(self.place)
            self.learn(words.take(pa.array(missing)))
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
            self.held += sum(map(len, new))
            place[missing] = at + np.arange(len(new))
        return place[slot]


def slices(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """A binary array's bytes in a row, and each value's size."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return bytes(memoryview(words.buffers()[2] or b"")[offsets[0] : offsets[-1]]), np.diff(offsets).astype(np.int64)


class ByteVocabulary:
    """A byte-level vocabulary's ids of pieces, as its library gives them: with `special` its added
    string is a token wherever it stands, else it is plain text."""

    def __init__(self, path: str, special: bool):
        self.vocabulary = _bpe.vocabulary(path)
        v = self.vocabulary
        added = getattr(v, "added", [])
        if len(added) > 1 and special:
            raise ValueError("more than one added token: their order of precedence isn't defined here")
        self.added, self.added_id = (added[0], v.added_ids[0]) if special and added else (None, -1)
        self.tokens = v.tokens
        self.widths = np.array([len(t) for t in v.tokens], np.int64)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and each piece's number of ids."""
        joined, sizes = slices(words)
        if self.added is not None and self.added in joined:
            ends = np.cumsum(sizes)
            return self._around([joined[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)])
        return self._plain([joined], sizes)

    def _plain(self, parts: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that stand in a row: no pre-token goes from one into the next, unless it is put apart."""
        ends = np.cumsum(sizes)
        texts = parts if len(parts) > 1 else [parts[0][a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        joined, starts, counts = _bpe.pre_tokens(texts)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        slot, words = _bpe.distinct(joined, starts)
        flat, n = _bpe.merge(words, self.vocabulary.byte_ids, self.vocabulary.pairs)
        begin, got = (np.cumsum(n) - n)[slot], n[slot]
        sums, upto = np.append(0, np.cumsum(got)), np.cumsum(counts)
        return _bpe.ragged(flat, begin, got).astype(np.int64), sums[upto] - sums[upto - counts]

    def _around(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner, opens = [], [], []
        for k, t in enumerate(texts):
            here = t.split(self.added)
            parts += here
            owner += [k] * len(here)
            opens += [False] + [True] * (len(here) - 1)
        ids, n = self._plain(parts, np.array([len(p) for p in parts]))
        before, first = np.array(opens), np.cumsum(n) - n
        ids = np.insert(ids, first[before], self.added_id)
        return ids, np.bincount(np.array(owner), n + before, len(texts)).astype(np.int64)


class PieceVocabulary:
    """A sentencepiece vocabulary on texts that have their leading space already."""

    def __init__(self, path: str):
        # A message appended to a message is merged into it: field 3, the normalizer, with its field 3, a space before each text, false.
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=open(path, "rb").read() + b"\x1a\x02\x18\x00")
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.tokens = [bytes([int(t[3:5], 16)]) if p.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.widths = np.array([len(t) for t in self.tokens], np.int64)
        #: Whether one of its pieces goes from something else on into a space or newline: no text may be cut.
        self.whole = any(re.search("[^▁]▁|.\n|\n.", t, re.S) for i, t in enumerate(names) if not p.is_byte(i))

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = self.processor.encode([w.decode() for w in words.to_pylist()], num_threads=1)
        sizes = np.array([len(x) for x in each], np.int64)
        return np.fromiter((i for x in each for i in x), np.int64, int(sizes.sum())), sizes


@functools.lru_cache(maxsize=4)
def byte_vocabulary(path: str, special: bool) -> ByteVocabulary:
    return ByteVocabulary(path, special)


@functools.lru_cache(maxsize=4)
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)
