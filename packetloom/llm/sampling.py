"""Sampled SentencePiece segmentations (op 8): forward filtering, backward sampling over the piece lattice.

The lattice has an edge for each vocabulary piece that matches, weighted by a Zipf prior over the pieces' ranks, and an
edge of byte pieces for each character the vocabulary lacks. Pieces never cross from a word into the white space after it,
so the lattice falls into units (spaces and the word after them). The distinct units of a batch are filtered forward
together, offset by offset; then all occurrences are sampled backward together, an edge for each per pass. The random
number of a step depends on the seed, the row's key, the unit's place in the text and the step alone, so results do
not depend on batches. Spaces are a marker byte inside the lattice; a literal marker character in the text goes by bytes,
so decoding gives back every text exactly.

Nulls: a null text is empty and has no ids; a null key counts as 0. Repeated rows have equal ids. An empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import text_map

SPACE_MARK, LITERAL = 0xFE, 0xFF  # bytes that UTF-8 never has
MARK = "▁".encode()
FIELDS = [("n_bytes", "long"), ("n_ids", "long"), ("ids_crc32", "long"), ("lossless", "boolean")]


@cache
def sampler(path: str, alpha: float = 1.0) -> Sampler:
    return Sampler(path, alpha)


class Table:
    """Hashes to values, by sorted search within buckets of their top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = 22
        first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.first = first.astype(np.int32)
        self.most = int(np.diff(np.append(first, len(keys))).max())

    def get(self, h: np.ndarray) -> np.ndarray:
        """Values, -1 where absent."""
        i = np.minimum(self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)], len(self.keys) - 1)
        found = self.keys[i]
        out = np.where(found == h, self.values[i], -1)
        todo = np.flatnonzero(found < h)
        i = i[todo]
        for _ in range(self.most):
            if not len(todo):
                break
            i = np.minimum(i + 1, len(self.keys) - 1)
            found = self.keys[i]
            hit = found == h[todo]
            out[todo[hit]] = self.values[i[hit]]
            less = found < h[todo]
            todo, i = todo[less], i[less]
        return out


class Sampler:
    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.byte_ids = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        known = [(i, p.id_to_piece(i)) for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        body = [x.encode().replace(MARK, bytes([SPACE_MARK])) for _, x in known]
        rank = np.arange(1, len(known) + 1)
        weight = -alpha * np.log(rank)
        weight -= np.log(np.exp(weight).sum())
        self.ids, self.weight = np.array([i for i, _ in known], np.int32), weight
        self.low = weight.min() - 2.0
        self.pieces = Table(hashes(body), np.arange(len(known)))
        stems = sorted({x[:k] for x in body for k in range(1, len(x) + 1)})
        self.stems = Table(hashes(stems), np.ones(len(stems), np.int64))
        self.bytes_of = [b""] * n
        for (i, x) in known:
            self.bytes_of[i] = x.replace("▁", " ").encode()
        for b in range(256):
            self.bytes_of[self.byte_ids[b]] = bytes([b])

    def lattice(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(from, to, piece) of the edges inside units of b; piece -1: the character goes by bytes."""
        sums = K.prefix_hash(b)
        stop = np.repeat(ends, ends - starts)
        at = K.ragged(starts, ends - starts)
        lead = (b[at] & 0xC0) != 0x80
        at, stop = at[lead], stop[lead]
        width = np.where(b[at] < 0x80, 1, np.where(b[at] < 0xE0, 2, np.where(b[at] < 0xF0, 3, np.where(b[at] < 0xF8, 4, 1))))
        single = self.pieces.get(K.span_hash(sums, at, np.minimum(at + width, stop)))
        lost = single < 0
        out = [(at[lost], np.minimum(at + width, stop)[lost], np.full(int(lost.sum()), -1))]
        k = 1
        while len(at):
            h = K.span_hash(sums, at, at + k)
            alive = self.stems.get(h) > 0
            at, stop, h = at[alive], stop[alive], h[alive]
            piece = self.pieces.get(h)
            hit = piece >= 0
            out.append((at[hit], at[hit] + k, piece[hit]))
            k += 1
            more = at + k <= stop
            at, stop = at[more], stop[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def filtered(self, b, starts, ends):
        """Edges by the node they lead to, in order, with the running probabilities of each node's edges.

        Returns (nodes' first edges, edges' from, piece, cumulative probability), nodes being places in b."""
        frm, to, piece = self.lattice(b, starts, ends)
        weight = np.where(piece >= 0, self.weight[piece], self.low * (to - frm))
        begin = np.zeros(len(b) + 1, np.int64)
        begin[starts] = starts
        origin = np.maximum.accumulate(begin)
        offset = to - origin[to - 1]
        order = np.lexsort((frm, to, offset))
        frm, to, piece, weight, offset = (x[order] for x in (frm, to, piece, weight, offset))
        alpha = np.full(len(b) + 1, -np.inf)
        score = np.zeros(len(b) + 1)  # alpha of a unit's end must not leak into the next unit's start
        cum = np.empty(len(frm))
        if not len(frm):
            return np.zeros(len(b) + 1, np.int64), frm, piece, cum
        at_start = frm == origin[frm]
        cuts = np.concatenate([[0], np.flatnonzero(offset[1:] != offset[:-1]) + 1, [len(frm)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            v = weight[i:j] + np.where(at_start[i:j], 0.0, alpha[frm[i:j]])
            node = to[i:j]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            size = np.diff(np.append(first, j - i))
            top = np.maximum.reduceat(v, first)
            top[np.isneginf(top)] = 0.0
            e = np.exp(v - np.repeat(top, size))
            total = np.add.reduceat(e, first)
            with np.errstate(divide="ignore"):
                alpha[node[first]] = top + np.log(total)
            run = np.cumsum(e)
            before = np.repeat(run[first] - e[first], size)
            cum[i:j] = (run - before) / np.repeat(np.maximum(total, 1e-300), size)
        del score
        order = np.argsort(to, kind="stable")
        frm, to, piece, cum = frm[order], to[order], piece[order], cum[order]
        return np.searchsorted(to, np.arange(len(b) + 2)), frm, piece, cum

    def encode(self, texts: list[bytes], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """The sampled ids of each text, uint32."""
        given = [t.replace(MARK, bytes([LITERAL])).replace(b" ", bytes([SPACE_MARK])) for t in texts]
        sizes = np.array([len(t) for t in given])
        b = K.raw(b"".join(given))
        if not len(b):
            return [np.empty(0, np.uint32) for _ in texts]
        space = b == SPACE_MARK
        cut = np.concatenate([[True], ~space[:-1] & space[1:]])
        edge = np.cumsum(sizes)
        cut[edge[:-1][edge[:-1] < len(b)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(b))
        doc = np.searchsorted(edge, starts, "right")
        h = K.span_hash(K.prefix_hash(b), starts, ends)
        _, first, unit = np.unique(h, return_index=True, return_inverse=True)
        ulen = (ends - starts)[first]
        flat = b[K.ragged(starts[first], ulen)]
        ustart = np.cumsum(ulen) - ulen
        head, frm, piece, cum = self.filtered(flat, ustart, ustart + ulen)
        place = np.arange(len(starts)) - np.searchsorted(starts, edge - sizes)[doc]
        stream = K.mix(K.mix(keys.astype(np.int64).view(np.uint64)[doc] + np.uint64(seed)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live, node, stop, picks, who = np.arange(len(starts)), (ustart + ulen)[unit], ustart[unit], [], []
        ladder = np.repeat(np.arange(len(flat) + 1), np.diff(head)) + cum * (1 - 1e-12)
        step = 0
        while len(live):
            u = (K.mix(stream[live] + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = np.clip(np.searchsorted(ladder, node + u, "right"), head[node], head[node + 1] - 1)
            picks.append(e)
            who.append(live)
            node = frm[e]
            go = node > stop[live]
            live, node = live[go], node[go]
            step += 1
        who, e, turn = np.concatenate(who), np.concatenate(picks), np.repeat(np.arange(step), [len(x) for x in picks])
        order = np.lexsort((-turn, who))
        who, e = who[order], e[order]
        width = np.where(piece[e] >= 0, 1, 0)
        by_byte = np.flatnonzero(piece[e] < 0)
        ids = np.where(piece[e] >= 0, self.ids[np.maximum(piece[e], 0)], 0).astype(np.uint32)
        if len(by_byte):
            ids, width = self.spelt(ids, width, by_byte, e, frm, flat)
        per = np.bincount(doc[who], width, len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per)[:-1])

    def spelt(self, ids, width, by_byte, e, frm, flat):
        """ids with the byte pieces of characters that have no piece."""
        chunks = []
        for i in by_byte.tolist():
            a = int(frm[e[i]])
            n = 1 if flat[a] < 0x80 or flat[a] >= 0xF8 else 2 if flat[a] < 0xE0 else 3 if flat[a] < 0xF0 else 4
            x = flat[a : a + n].tobytes()
            chunks.append(self.byte_ids[list(MARK if x == bytes([LITERAL]) else b" " if x == bytes([SPACE_MARK]) else x)].astype(np.uint32))
            width[i] = len(chunks[-1])
        out = np.empty(int(width.sum()), np.uint32)
        at = np.cumsum(width) - width
        plain = np.setdiff1d(np.arange(len(width)), by_byte, assume_unique=True)
        out[at[plain]] = ids[plain]
        out[K.ragged(at[by_byte], width[by_byte])] = np.concatenate(chunks)
        return out, width

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def hashes(body: list[bytes]) -> np.ndarray:
    size = np.array([len(x) for x in body])
    end = np.cumsum(size)
    return K.span_hash(K.prefix_hash(K.raw(b"".join(body))), end - size, end)


def sampled(docs: DataFrame, path: str, seed: int = 1, alpha: float = 1.0) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit), sampled by the row's doc_id."""
    return _run(docs, path, seed, alpha, lambda s, texts, ids: [[x.astype("<u4").tobytes() for x in ids]], [("ids", "binary")])


def sampled_digest(docs: DataFrame, path: str, seed: int = 1, alpha: float = 1.0) -> DataFrame:
    """doc_id and FIELDS: sizes, a checksum of the ids and whether decoding them gives back the text."""

    def digest(s, texts, ids):
        return [[len(t) for t in texts], [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [s.decode(x) == t for t, x in zip(texts, ids, strict=True)]]

    return _run(docs, path, seed, alpha, digest, FIELDS)


def _run(docs, path, seed, alpha, finish, fields):
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lpad(F.hex(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), 16, "0").cast("binary"), F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("keyed"))

    def run(texts):
        s = sampler(path, alpha)
        keys = np.array([int(t[:16], 16) for t in texts], np.uint64).view(np.int64)
        texts = [t[16:] for t in texts]
        return finish(s, texts, s.encode(texts, keys, seed))

    return text_map(keyed, run, fields, ["doc_id"], "keyed")
