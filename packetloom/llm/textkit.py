"""Vectorised text primitives in numpy: word spans, word hashes, shingles, sorted sets.

Words are runs of bytes outside a separator class, hashed by a polynomial modulo 2^64 whose prefix sums give every
word's hash in a few passes over the bytes, then mixed so that all bits count.
"""

from __future__ import annotations

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C55 | 1)
INV = np.uint64(pow(int(MULT), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and all bytes of non-ASCII characters, after A-Z have been lowered.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT and its inverse to the powers 0..n-1, grown by doubling."""
    while len(_powers["up"]) < n:
        for k, m in (("up", MULT), ("down", INV)):
            old = _powers[k]
            with np.errstate(over="ignore"):
                _powers[k] = np.concatenate([old, old * (old[-1] * m)])
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(text: str | bytes | None) -> np.ndarray:
    if text is None:
        text = b""
    return np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Sums s with hash(b[i:j]) = (s[j] - s[i]) * INV^i."""
    s = np.zeros(len(b) + 1, np.uint64)
    up, _ = powers(len(b))
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=s[1:])
    return s


def span_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(s))
    return mix((s[ends] - s[starts]) * down[starts])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    if inside[-1]:
        edge = np.concatenate([edge, [len(inside)]])
    return edge[0::2], edge[1::2]


def words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes other than ASCII white space."""
    starts, ends = spans(~SPACE[b])
    return starts, ends, span_hash(prefix_hash(b), starts, ends) if len(starts) else np.empty(0, np.uint64)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[j : n + j])
    return out


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; of fewer words, the sequence as one; of none, nothing."""
    if 0 < len(h) < k:
        return shingle_hashes(h, len(h))
    return np.unique(shingle_hashes(h, k))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lengths[i]-1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(starts - offsets, lengths) + np.arange(total)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, by doubling."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - width : w - width + len(x) - w + 1]) if width < w else out
