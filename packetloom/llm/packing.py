"""Packing (op 9): documents into sequences of at most `window` tokens, in order, by dynamic programming.

Documents are tokenised once, in vectorised form (fast_bpe), dealt into ranges of neighbouring ids and packed in order. A
range's rows stream through in shards of about `most` tokens, so memory follows a shard (or one document that is longer),
whatever the range holds; there are at most `ranges` ranges, whose bounds are all that the driver sees.
Within a shard the cuts are chosen to minimise padding plus penalties: none at a document's end, `soft` tokens at a
sentence's end. Where no such boundary lies within window // 128 tokens, places that far apart are offered as well, at `hard`
tokens each: text without sentence ends would not fit a window otherwise, and may carry up to one token less than that as
padding. For a cut at p the best predecessor q in [p - window, p) minimises cost(q) + q, which a monotone queue over the
window yields in constant amortised time. The rest of a shard may also close with windows whose lengths are powers of two,
which need no padding.

Nulls: a null text is empty and holds the end id alone; null ids are dealt to all ranges by a hash of their text and come
first in each. Repeated rows are packed one by one, ties by id in the order of their tokens. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, partitions_for, slices, text_or_empty

END = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokens(docs: DataFrame, path: str, cuts: list[int]) -> DataFrame:
    """(doc_id, range, ids): the range is the number of cuts at or below the id, of null ids one by a hash of the text; ids are the
    token ids and END as unsigned 16-bit little-endian, compressed."""
    ddl = "doc_id long, range int, ids binary"
    schema = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        from .fast_bpe import encoder

        for batch in batches:
            for at, n in slices(batch.column(2), 1 << 19):
                doc_id, other, text = batch.slice(at, n).columns
                own = np.searchsorted(np.array(cuts, np.int64), doc_id.fill_null(0).to_numpy(), "right")
                part = np.where(doc_id.is_null().to_numpy(zero_copy_only=False), other.to_numpy() % (len(cuts) + 1), own)
                ids = [zlib.compress(np.append(x, END).astype("<u2").tobytes(), 1) for x in encoder(path).encode(text.to_pylist())]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(part.astype(np.int32)), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), text_or_empty().cast("binary")).mapInArrow(run, ddl)


def boundaries(docs: DataFrame, ranges: int) -> list[int]:
    """At most ranges - 1 ids that part the documents into about equal ranges."""
    if ranges < 2:
        return []
    at = docs.agg(F.percentile_approx("doc_id", F.lit([k / ranges for k in range(1, ranges)]), 10 * ranges).alias("q")).first()["q"]
    return sorted(set(at or []))


def pack(docs: DataFrame, path: str, window: int = 4096, soft: int = 8, hard: int = 48, range_bytes: int = 6 << 20, ranges: int = 8192, most: int = 2_000_000) -> DataFrame:
    """The pieces of all documents' token sequences: PIECES."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    cuts = boundaries(docs, min(ranges, partitions_for(docs, size, range_bytes, 1)))
    dealt = tokens(docs, path, cuts)
    ordered = dealt.repartition(max(1, len(cuts) + 1), "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    ends, schema = sentence_ends(path), arrow_schema(PIECES)

    def run(batches):
        import pyarrow as pa

        for first, ids, parts in by_shard(batches, most):
            made = pack_shard(parts, ends, window, soft, hard)
            cols = pieces(ids, parts, made, first)
            first[1] += len(made)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return ordered.mapInArrow(run, PIECES)


def by_shard(batches, most: int):
    """([range, sequences so far], ids, arrays of token ids) of runs of one range with about `most` tokens; the caller counts the sequences."""
    held, ids, parts, n = None, [], [], 0
    for batch in batches:
        for d, r, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if parts and (r != held[0] or n >= most):
                yield held, ids, parts
                ids, parts, n = [], [], 0
            if held is None or r != held[0]:
                held = [r, 0]
            ids.append(d)
            parts.append(np.frombuffer(zlib.decompress(x), "<u2"))
            n += len(parts[-1])
    if parts:
        yield held, ids, parts


def sentence_ends(path: str) -> np.ndarray:
    """Which ids end a sentence: tokens that close a word with a full stop, question or exclamation mark."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = np.zeros(max(1 << 16, t.get_vocab_size()), bool)
    for piece, i in t.get_vocab().items():
        if piece.endswith(("</w>",)) and piece[:-4].endswith((".", "!", "?")):
            out[i] = True
    return out


def candidates(parts: list[np.ndarray], ends: np.ndarray, window: int, soft: int, hard: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and their penalties; no gap between two is over window // 128 tokens."""
    ids = np.concatenate(parts)
    lengths = np.array([len(x) for x in parts])
    penalty = np.full(len(ids), 255, np.int32)
    penalty[ends[ids]] = soft
    penalty[np.cumsum(lengths) - 1] = 0
    at = np.flatnonzero(penalty < 255)
    gap, step = np.diff(at, prepend=-1), max(1, window // 128)
    wide = np.flatnonzero(gap > step)
    extra = within(at[wide] - gap[wide], gap[wide], step)
    penalty[extra] = np.minimum(penalty[extra], hard)
    at = np.union1d(at, extra)
    return at + 1, penalty[at]


def within(starts: np.ndarray, gaps: np.ndarray, step: int) -> np.ndarray:
    """starts + step, starts + 2 step ... within each gap."""
    from .textkit import ragged

    n = (gaps - 1) // step
    if not n.sum():
        return np.empty(0, np.int64)
    return np.repeat(starts, n) + step * (ragged(np.zeros(len(n), np.int64), n) + 1)


def pack_shard(parts: list[np.ndarray], ends: np.ndarray, window: int, soft: int, hard: int) -> list[int]:
    """Ends of the windows, in tokens of the shard, ascending to its last."""
    at, penalty = candidates(parts, ends, window, soft, hard)
    at, penalty = at.tolist(), penalty.tolist()
    total = at[-1]
    best, prior = [0], [0]
    queue = deque([0])
    key = [0]  # best + position: what a later cut pays for starting here, less its own terms
    where = [0, *at]
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    index = {}
    for j in range(1, len(where)):
        p = where[j]
        low = p - window
        while where[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        cost = key[i] + window - p + penalty[j - 1]
        if total - p < window:
            if not index:
                index = {q: k for k, q in enumerate(where[:j])}
            for w in powers:
                k = index.get(p - w)
                if k is not None and best[k] + penalty[j - 1] < cost:
                    cost, i = best[k] + penalty[j - 1], k
            index[p] = j
        best.append(cost)
        prior.append(i)
        key.append(cost + p)
        while queue and key[queue[-1]] >= cost + p:
            queue.pop()
        queue.append(j)
    out, j = [], len(where) - 1
    while j:
        out.append(where[j])
        j = prior[j]
    return out[::-1]


def pieces(ids: list, parts: list[np.ndarray], cuts: list[int], before: list[int]) -> list[list]:
    """Columns of PIECES: each document's tokens between its own ends and the windows' ends. before: the range, and the
    sequences that it has so far."""
    lengths = np.array([len(x) for x in parts])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    edges = np.union1d(ends, np.array(cuts))
    begin = np.concatenate([[0], edges[:-1]])
    doc = np.searchsorted(ends, begin, "right")
    seq = np.searchsorted(np.array(cuts), begin, "right")
    first = np.concatenate([[0], np.array(cuts)])[seq]
    crc = []
    wide, held = None, -1
    for d, a, b in zip(doc.tolist(), (begin - starts[doc]).tolist(), (edges - starts[doc]).tolist(), strict=True):
        if d != held:
            wide, held = memoryview(parts[d].astype("<u4")).cast("B"), d
        crc.append(zlib.crc32(wide[4 * a : 4 * b]))
    return [[ids[d] for d in doc.tolist()], (begin - starts[doc]).tolist(), (edges - begin).tolist(), crc, lengths[doc].tolist(), ((before[0] << 32) + before[1] + seq).tolist(), (begin - first).tolist()]
