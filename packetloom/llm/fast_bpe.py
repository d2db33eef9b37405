"""The ids of a word-end BPE tokenizer file, computed in numpy for whole batches of texts.

Normalisation (NFC, lower case) is done on strings; classes of code points then give all pre-tokens of a batch at once,
their hashes are looked up in a direct-mapped cache that lives as long as the worker, and only words that miss it are
merged: all words of one length together, one merge of lowest rank (leftmost on ties) in each of them per pass. Words
over `LONG` bytes go to the tokenizers library, which the tests also hold all ids against.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np

from . import textkit as K

LONG = 192
NONE = np.iinfo(np.int32).max
#: White space of the file's \s, in code points.
BLANK = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(0x110000, 3, np.uint8)
    kinds = {"L": 1, "N": 2}
    for i in range(0x110000):
        k = kinds.get(unicodedata.category(chr(i))[0])
        if k:
            out[i] = k
    out[BLANK] = 0
    return out


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    def __init__(self, path: str, bits: int = 20, most: int = 600_000):
        self.path, self.bits, self.most, self.whole = path, bits, most, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.slots = 20
        self.key, self.rank = np.full(1 << self.slots, 2**64 - 1, np.uint64), np.full(1 << self.slots, NONE, np.int32)
        for r, (k, s) in enumerate(zip(keys, self.slot(keys).tolist(), strict=True)):
            while self.rank[s] != NONE and self.key[s] != k:
                s = (s + 1) & (1 << self.slots) - 1
            if self.rank[s] == NONE:
                self.key[s], self.rank[s] = k, r
        self.clear()

    def clear(self) -> None:
        self.map = np.zeros(1 << self.bits, np.int32)
        self.hash, self.off, self.len = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (K.mix(keys) >> np.uint64(64 - self.slots)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        s = self.slot(keys)
        found = self.key[s]
        out = np.where(found == keys, self.rank[s], NONE)
        open_ = np.flatnonzero((found != keys) & (self.rank[s] != NONE))
        while len(open_):
            s[open_] = (s[open_] + 1) & (1 << self.slots) - 1
            at = s[open_]
            hit = self.key[at] == keys[open_]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit & (self.rank[at] != NONE)]
        return out

    def merged(self, sym: np.ndarray):
        """(rows, their ids) of words of one length, as they get finished."""
        live, n = np.arange(len(sym)), sym.shape[1]
        rank = self.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(sym), n - 1) if n > 1 else None
        while n > 1:
            j = rank.argmin(1)
            low = rank[np.arange(len(live)), j]
            done = low == NONE
            if done.any():
                yield live[done], sym[done]
                keep = ~done
                live, sym, rank, j, low = live[keep], sym[keep], rank[keep], j[keep], low[keep]
            if not len(live):
                return
            rows = np.arange(len(live))
            sym[rows, j] = self.made[low]
            mask = np.ones(sym.shape, bool)
            mask[rows, j + 1] = False
            sym = sym[mask].reshape(len(live), n - 1)
            n -= 1
            if n > 1:
                mask = np.ones(rank.shape, bool)
                mask[rows, j] = False
                rank = rank[mask].reshape(len(live), n - 1)
                for at in (j - 1, j):
                    ok = np.flatnonzero((at >= 0) & (at < n - 1))
                    if len(ok):
                        rank[ok, at[ok]] = self.ranks(sym[ok, at[ok]], sym[ok, at[ok] + 1])
        if len(live):
            yield live, sym

    def learn(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        """Put the ids of these distinct words into the cache."""
        if len(self.hash) + len(h) > self.most:
            self.clear()
        size = ends - starts
        lens, order, flats = np.zeros(len(h), np.int64), [], []
        for n in np.unique(size):
            of = np.flatnonzero(size == n)
            if n > LONG:
                for i in of:
                    ids = self.slow(b[starts[i] : ends[i]].tobytes())
                    lens[i] = len(ids)
                    order.append(np.array([i]))
                    flats.append(np.array(ids, np.uint16))
                continue
            word = b[starts[of][:, None] + np.arange(n)]
            sym = self.inner[word]
            sym[:, -1] = self.last[word[:, -1]]
            for rows, ids in self.merged(sym):
                lens[of[rows]] = ids.shape[1]
                order.append(of[rows])
                flats.append(ids.astype(np.uint16).ravel())
        order = np.concatenate(order)
        flat = np.concatenate(flats)
        begin = np.cumsum(lens[order]) - lens[order] + len(self.flat)
        first = len(self.hash)
        self.hash, self.off, self.len = np.concatenate([self.hash, h[order]]), np.concatenate([self.off, begin]), np.concatenate([self.len, lens[order]])
        self.flat = np.concatenate([self.flat, flat])
        self.map[(h[order] >> np.uint64(64 - self.bits)).astype(np.int64)] = np.arange(first, len(self.hash), dtype=np.int32)

    def slow(self, word: bytes) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        return self.whole.encode(word.decode(), add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, without special tokens, as uint16."""
        given = [normal(t) for t in texts]
        joined = "\n".join(given) + "\n"
        u = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        b = K.raw(joined.encode("utf-8", "surrogatepass"))
        starts, ends = pretokens(u)
        doc_end = np.cumsum([len(x) + 1 for x in given])
        counts = np.searchsorted(starts, doc_end, "left")
        if len(b) != len(u):
            off = np.concatenate([[0], np.cumsum(1 + (u >= 0x80) + (u >= 0x800) + (u >= 0x10000), dtype=np.int64)])
            starts, ends = off[starts], off[ends]
        h = K.span_hash(K.prefix_hash(b), starts, ends)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        lens, flat = self.gather(b, starts, ends, h, slot)
        total = np.concatenate([[0], np.cumsum(lens)])
        at = total[counts]
        return [flat[i:j] for i, j in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]

    def gather(self, b, starts, ends, h, slot) -> tuple[np.ndarray, np.ndarray]:
        at = self.map[slot]
        miss = np.flatnonzero(self.hash[at] != h)
        if not len(miss):
            off, lens = self.off[at], self.len[at]
            return lens, self.flat[K.ragged(off, lens)]
        u, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
        hit_off, hit_len, flat = self.off[at], self.len[at], self.flat
        kept = len(self.hash) + len(u) <= self.most
        self.learn(b, starts[miss[first]], ends[miss[first]], u)
        base = 0 if kept else len(flat)
        order = np.argsort(self.hash[-len(u) :])
        new = len(self.hash) - len(u) + order[back]
        hit_off[miss], hit_len[miss] = self.off[new] + base, self.len[new]
        return hit_len, (self.flat if kept else np.concatenate([flat, self.flat]))[K.ragged(hit_off, hit_len)]


def normal(t: bytes) -> str:
    s = t.decode("utf-8", "replace")
    if s.isascii():
        return s.lower()
    if not unicodedata.is_normalized("NFC", s):
        s = unicodedata.normalize("NFC", s)
    return s.replace("Σ", "σ").lower()


def pretokens(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of 's 't 're 've 'm 'll 'd, letter runs, single numbers and runs of others."""
    c = classes()[u]
    cut = np.flatnonzero((c[1:] != c[:-1]) | (c[1:] == 2)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(u)]])
    keep = c[starts] != 0
    starts, ends = starts[keep], ends[keep]
    one = np.flatnonzero((u[starts[:-1]] == 39) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]) & (c[starts[1:]] == 1)) if len(starts) > 1 else np.empty(0, np.int64)
    if len(one):
        x = u[starts[one + 1]]
        y = np.where(ends[one + 1] - starts[one + 1] > 1, u[np.minimum(starts[one + 1] + 1, len(u) - 1)], 0)
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        take = np.where(np.isin(x, [115, 116, 109, 100]), 1, np.where(two, 2, 0))
        ends[one] += take
        starts[one + 1] += take
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
    return starts, ends
