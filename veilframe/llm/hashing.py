"""Vectorised 64-bit hashing of the words of many texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: A random 64-bit value for each byte.
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> Powers:
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_INVERSE, n)
        return self


def prefix_hash(data: np.ndarray, at: Powers) -> np.ndarray:
    """p with (p[j] - p[i]) * base^-i a hash of data[i:j]; len(data) + 1 long."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * at.to(len(data) + 1).up[: len(data)], out=p[1:])
    return p


def word_hashes(data: bytes, at: Powers, block: int = 1 << 20) -> np.ndarray:
    """A hash of each word of data, in order. Works in blocks cut at white space, so memory follows the block."""
    raw, out, start = np.frombuffer(data, np.uint8), [], 0
    while start < len(raw):
        end = min(start + block, len(raw))
        while end < len(raw):
            cut = np.flatnonzero(_SPACE[raw[start:end]])
            if len(cut):
                end = start + int(cut[-1]) + 1
                break
            end = min(end + block, len(raw))
        b = raw[start:end]
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~_SPACE[b]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            p = prefix_hash(b, at)
            out.append(mix64((p[last] - p[first]) * at.down[first] + (last - first).astype(np.uint64)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def texts_in_groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8 in groups of about most bytes: first index, texts."""
    group: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if group and size + len(data) > most:
            yield first, group
            group, first, size = [], i, 0
        group.append(data)
        size += len(data)
    if group:
        yield first, group


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; one of all words if there are fewer, none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ words[j : n - k + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
    return mix64(out)
