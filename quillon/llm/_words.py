"""Words, lines and their 64-bit hashes over the UTF-8 bytes of many texts at once, in numpy."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

#: Bytes of a word or line up to which numpy hashes it, eight at a time; longer ones go to BLAKE2.
SHORT = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


@functools.cache
def byte_values(lower: bool) -> np.ndarray:
    """What each byte counts as: itself, or with lower a-z for A-Z."""
    values = np.arange(256, dtype=np.uint8)
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@functools.cache
def table(kind: str) -> np.ndarray:
    """Which bytes belong to words: "space" (all but \\x09-\\x0D and the space) or "alnum" (digits,
    ASCII letters and all bytes of other characters)."""
    out = np.ones(256, bool)
    if kind == "space":
        out[[*range(0x09, 0x0E), 0x20]] = False
    else:
        out[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
    return out


class Texts:
    """Many texts as one byte array, a newline after each."""

    def __init__(self, texts: list[bytes], lower: bool):
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.lower = lower
        self.ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.n = len(texts)

    @functools.cached_property
    def lowered(self) -> np.ndarray:
        """The bytes, A-Z as a-z if so asked, and eight more."""
        return byte_values(self.lower)[np.append(self.bytes, np.zeros(8, np.uint8))]

    @functools.cached_property
    def chunks(self) -> np.ndarray:
        """The eight bytes from each place on, as a number."""
        return np.ndarray((len(self.bytes) + 1,), "<u8", self.lowered, strides=(1,))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A hash of each span's bytes: a chain of bijections, eight bytes at a time, so that no two
        spans share a hash but by chance. Other seeds give other hashes."""
        sizes = ends - starts
        salt = mix(np.full(1, seed, np.uint64))[0]
        out = mix(sizes.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93) + salt)
        live, at = np.flatnonzero((sizes > 0) & (sizes <= SHORT)), 0
        while len(live):
            word = self.chunks[starts[live] + at] & _MASKS[np.minimum(sizes[live] - at, 8)]
            out[live] = mix(out[live] ^ word)
            at += 8
            live = live[sizes[live] > at]
        for k in np.flatnonzero(sizes > SHORT).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.lowered[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(16)).digest(), "little")
        return out

    def words(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words start and end, and how many each text has."""
        inside = np.zeros(len(self.bytes) + 2, bool)
        inside[1:-1] = table(kind)[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, self.per_text(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the lines between newlines; a text's end ends its last line."""
        ends = np.flatnonzero(self.bytes == 0x0A)
        starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
        return starts, ends, self.per_text(starts)

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(starts, self.ends), prepend=0)


def windows(values: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of n consecutive values of a text begins, and the runs' hashes."""
    if len(values) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(values))
    at = np.flatnonzero(left >= n)
    size = len(values) - n + 1
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = values[:size] * factors[0]
    for k in range(1, n):
        out += values[k : k + size] * factors[k]
    return at, mix(out[at])


#: Base of rolling hashes: odd, so that its powers have inverses modulo 2^64; their differences have few factors of two.
BASE = 0x9E3779B97F4A7C15


class Rolling:
    """Hashes of all runs of any length over a row of values, modulo 2^64: one running sum of values times
    powers, of which a run's hash is a difference, brought back by the inverse power of its place."""

    def __init__(self, values: np.ndarray):
        powers = np.ones((2, len(values) + 1), np.uint64)
        powers[0, 1:], powers[1, 1:] = BASE, pow(BASE, -1, 1 << 64)
        np.multiply.accumulate(powers, axis=1, out=powers)
        self.sums, self.back = np.append(np.uint64(0), np.cumsum(values * powers[0, :-1], dtype=np.uint64)), powers[1]

    def windows(self, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """As windows(), by these hashes."""
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(self.sums) - 1)
        at = np.flatnonzero(left >= n)
        return at, mix((self.sums[at + n] - self.sums[at]) * self.back[at])


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size places lie in at least one of the runs of n from the places at."""
    edge = np.zeros(size + n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge)[:size] > 0


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the values of each run of counts."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
