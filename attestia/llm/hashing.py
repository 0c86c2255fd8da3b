"""Vectorised hashing of bytes, words and shingles, the same on every executor."""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTES = _rng.integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Longer spans are hashed one by one.
LONG = 4096
# White space of the word contracts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hash of bytes: entry i covers data[:i]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], wherever it lies, from prefix sums."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], eight bytes at a time through `mix`: all spans advance together.

    Unlike a polynomial modulo 2**64, whose collisions are known for periodic strings, every step is a bijection of
    the state that depends on all bits of it. Spans of more than LONG bytes are hashed by BLAKE2b.
    """
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chunks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(lengths.astype(np.uint64) + BASE)
    live = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    at, left = starts[live], lengths[live]
    while len(live):
        part = chunks[at]
        short = left < 8
        part = np.where(short, part & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)), part)
        out[live] = mix(out[live] * np.uint64(3) + mix(part ^ BASE))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "<u8")[0]
    return out


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts in order, and how many each text has."""
    data = LOWER[np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]) if texts else b"", np.uint8)]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    limits = np.cumsum([len(t or b"") + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], limits])))
    return spans(data, starts, ends), counts


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; fewer words make one shingle, none an empty set."""
    words, counts = word_hashes(texts)
    m = len(words) - n + 1
    grams = np.zeros(max(0, m), np.uint64)
    for k in range(n):
        grams = mix(grams * np.uint64(3) + words[k : k + m]) if m > 0 else grams
    ends = np.cumsum(counts)
    out = []
    for a, c in zip((ends - counts).tolist(), counts.tolist(), strict=True):
        if c >= n:
            out.append(np.unique(grams[a : a + c - n + 1]))
        elif c:
            h = np.uint64([c])
            for k in range(c):
                h = mix(h * np.uint64(5) + words[a + k : a + k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(items: list, size_of, limit: int):
    """Ranges of a list whose sizes sum up to about `limit` (one item at least)."""
    start, held = 0, 0
    for i, x in enumerate(items):
        s = size_of(x)
        if i > start and held + s > limit:
            yield start, i
            start, held = i, 0
        held += s
    if start < len(items):
        yield start, len(items)
