"""Suffix-array dedup (op 1): bytes covered by a string of `length` bytes that also starts in an earlier document.

1. Anchors. Every string of `length` bytes is owned by the least 16-byte gram in it (leftmost on ties), so equal strings
   have equal anchors wherever they stand. Runs of neighbouring strings with one anchor form a window, described by the
   anchor's hash, a hash of the window's bytes and its place. Copies of a window within a few MB of documents are settled at once;
   the rest goes, packed by hash range, to the task that owns the range.
   An anchor that a fair share of all documents hold (found in a sample of them; a list of bounded size) is split by the
   bytes next to it: strings that begin near the anchor by the bytes after it, others by the bytes before it, which equal
   strings share. So no anchor gathers more than the windows that agree around it.
2. Windows that are equal throughout are settled by their hashes. An anchor whose windows differ needs its texts: the
   first document of each distinct window sends its bytes.
3. Suffix array. The windows of a range form one text, whose suffixes are sorted by bucket-pointer refinement: 8-byte
   buckets first, then buckets with more than one member are sorted by the bucket pointers of the places 8, 16, 32 ...
   further on, as updated by the round before, until `length` bytes are told apart. Every owned place in a bucket with a
   smaller document is marked.
4. Marks meet their document again, and the covered bytes go.

Nulls: a null text is empty; rows with a null id are compared with nothing and come back whole. Texts under `length` bytes
keep all. Repeated rows of one id do not remove each other's bytes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import arrow_schema, materialize, partitions_for, slices, text_map

Q = 16
FIELDS = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]
PIECE = 1 << 20


def codes(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number; zeros follow the end."""
    x = np.concatenate([b, np.zeros(7, np.uint8)]).astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return x[:-4] << np.uint64(32) | x[4:]


def suffix_buckets(b: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, pointer): places sorted by the `depth` bytes from them (zeros follow the end), and each place's bucket,
    the last rank of its equals. Without depth, the suffix array (a suffix before those it begins).

    Only buckets of several places are sorted again in a round. With a depth, the last round looks just as far as needed,
    so equal pointers mean equal strings of that depth.
    """
    size = len(b)
    if depth is not None:
        b = np.concatenate([b, np.zeros(depth, np.uint8)])
    n = len(b)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = codes(b)
    order = np.argsort(code, kind="stable")
    s = code[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    pointer = np.empty(n, np.int64)
    pointer[order] = last_of(new)
    done, goal = 8, depth or 2 * n + 8
    while done < goal:
        rank = pointer[order]
        edge = np.concatenate([[True], rank[1:] != rank[:-1], [True]])
        several = ~(edge[:-1] & edge[1:])
        if not several.any():
            break
        step = min(done, goal - done)
        at = np.flatnonzero(several)
        places = order[at]
        own, ahead = pointer[places], np.where(places + step < n, pointer[np.minimum(places + step, n - 1)], -1 - places if depth is None else -1)
        k = np.lexsort((ahead, own))
        order[at] = places[k]
        own, ahead = own[k], ahead[k]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
        group = np.flatnonzero(fresh)
        ends = np.concatenate([group[1:], [len(at)]]) - 1
        pointer[order[at]] = np.repeat(at[ends], np.diff(np.concatenate([group, [len(at)]])))
        done += step
    return order[order < size], pointer[:size]


def last_of(new: np.ndarray) -> np.ndarray:
    """For each row the last row of its group, groups starting where new is true."""
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(new)]]) - 1
    return np.repeat(ends, np.diff(np.concatenate([starts, [len(new)]])))


def windows(b: np.ndarray, length: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, 48-bit hash of the bytes, first place, places) of each window; the second only tells apart windows of
    one anchor. Windows of hot anchors (sorted) are split by the bytes next to the anchor, which then count as part of it."""
    made = []
    for at in range(0, max(1, len(b) - length + 1), PIECE):
        part = b[at : at + PIECE + length - 1]
        if len(part) < length:
            continue
        x = codes(part)
        n = len(part) - Q + 1
        g = K.mix(x[:n] * np.uint64(0x9FB21C651E98DF25) + x[8 : 8 + n] * np.uint64(0xD6E8FEB86659FD93))
        a = (K.sliding_min((g & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64), length - Q + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(a[1:] != a[:-1]) + 1
        start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(a)]])
        key, sums = g[a[start]], K.prefix_hash(part)
        if hot is not None and len(hot):
            key, start, end = split_hot(key, a[start], start, end, sums, length, hot)
        made.append((key, K.span_hash(sums, start, end + length - 1) >> np.uint64(16), start + at, end - start))
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*made, strict=True))


def split_hot(key, anchor, start, end, sums, length: int, hot: np.ndarray):
    """(key, start, end) of windows, those of hot anchors parted where strings begin too early to hold the bytes after the anchor."""
    i = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    own = hot[i] == key
    if not own.any():
        return key, start, end
    near = (length - Q) // 2
    k, c, s, e = key[own], anchor[own], start[own], end[own]
    mid = np.clip(c - near, s, e)
    out = [(key[~own], start[~own], end[~own])]
    for lo, hi, x, y, salt in ((mid, e, c + Q, c + length - near, 1), (s, mid, c - near, c, 2)):
        some = lo < hi
        out.append((K.mix(k[some] + np.uint64(salt) + K.span_hash(sums, x[some], y[some])), lo[some], hi[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def hot_anchors(docs: DataFrame, length: int, every: int = 64, share: float = 0.002, least: int = 32) -> np.ndarray:
    """Anchors that over `share` of a sample of documents hold (one in `every`, by a hash of the id), and `least` of them at least.

    At most 1/share times the mean number of anchors of a document, whatever the corpus; which anchors are listed changes how
    windows are dealt, not what is found."""
    schema = arrow_schema("h long")
    some = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(windows(K.raw(t.as_py()), length)[0]).view(np.int64))], schema=schema)

    n = some.count()
    rows = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") > max(least, share * n)).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def packed(part: np.ndarray, cols: list[np.ndarray], kinds: str) -> tuple[list, list]:
    """(part, blob) of rows sorted by part: each column's bytes in turn, compressed."""
    edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
    cols = [c.astype(k) for c, k in zip(cols, kinds.split(), strict=True)]
    return [int(part[i]) for i in edge[:-1]], [zlib.compress(b"".join(split_bytes(c[i:j]) for c in cols), 1) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def split_bytes(c: np.ndarray) -> bytes:
    """All low bytes, then all next ones: runs that compress."""
    return np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes()


def unpacked(blob: bytes, kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds.split()]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds.split(), sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(k).ravel())
        at += n * s
    return out


def squeezed(t: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(t)


def unsqueezed(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


KINDS = "<u8 <u8 <i8 <i4 <i4"


def anchors(docs: DataFrame, length: int, parts: int, hot: np.ndarray) -> DataFrame:
    """(part, blob): windows by hash range; part -1 holds windows whose batch has an equal one in an earlier document."""
    schema = arrow_schema("part int, blob binary")

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(at, size) for b in batches for at, size in slices(b.column(1), 2 << 20)):
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, c, p, n = windows(K.raw(t.as_py()), length, hot)
                if len(h):
                    rows.append((h, c, np.full(len(h), d, np.int64), p, n))
            if not rows:
                continue
            h, c, d, p, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((p, d, c, h))
            h, c, d, p, n = h[order], c[order], d[order], p[order], n[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            settled = d != d[np.flatnonzero(new)[np.cumsum(new) - 1]]
            keep = new  # later equal windows of the same document are like its first, only elsewhere
            same = ~new & ~settled
            part = part_of(h, parts)
            a, b = packed(part[keep | same], [x[keep | same] for x in (h, c, d, p, n)], KINDS)
            if settled.any():
                far = packed(np.full(int(settled.sum()), -1), [x[settled] for x in (h, c, d, p, n)], KINDS)
                a, b = a + far[0], b + far[1]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary())], schema=schema)

    return docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b""))).mapInArrow(run, "part int, blob binary")


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def by_part(batches):
    """(part, blobs) of rows sorted by part; part -1 in pieces."""
    held, blobs = None, []
    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if blobs and (p != held or p == -1):
                yield held, blobs
                blobs = []
            held = p
            blobs.append(x)
    if blobs:
        yield held, blobs


def settled(rows: DataFrame, parts: int) -> DataFrame:
    """(doc, p, n, h): places marked (h null), and windows whose anchor has others that differ."""
    ddl = "doc long, p int, n int, h long"
    schema = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        for part, blobs in by_part(batches):
            h, c, d, p, n = (np.concatenate(x) for x in zip(*(unpacked(b, KINDS) for b in blobs), strict=True))
            if part == -1:
                mark, ask = np.ones(len(h), bool), np.zeros(len(h), bool)
            else:
                order = np.lexsort((p, d, c, h))
                h, c, d, p, n = h[order], c[order], d[order], p[order], n[order]
                run_new = np.concatenate([[True], h[1:] != h[:-1]])
                new = run_new | np.concatenate([[True], c[1:] != c[:-1]])
                mark = d != d[np.flatnonzero(new)[np.cumsum(new) - 1]]
                run_ = np.cumsum(run_new) - 1
                ask = ~mark & (np.bincount(run_, new)[run_] > 1)
            keep = mark | ask
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(p[keep]), pa.array(n[keep]), pa.array(h[keep].view(np.int64), mask=mark[keep])], schema=schema)

    dealt = F.when(F.col("part") < 0, F.pmod(F.xxhash64("blob"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    return rows.withColumn("to", dealt).repartition(parts, "to").drop("to").sortWithinPartitions("part").mapInArrow(run, ddl)


def sorted_windows(asked: DataFrame, docs: DataFrame, length: int, parts: int) -> DataFrame:
    """(doc, p, n): runs of places whose string is also in an earlier document, by the suffix arrays of the ranges."""
    per = asked.groupBy("doc").agg(F.collect_list(F.struct("h", "p", "n")).alias("ws"))
    joined = per.join(docs, F.col("doc") == F.col("doc_id")).select("doc", F.col("ws.h").alias("h"), F.col("ws.p").alias("p"), F.col("ws.n").alias("n"), "z")
    cut_ddl, out_ddl = "part int, blob binary, body binary", "doc long, p int, n int"
    cut_schema, out_schema = arrow_schema(cut_ddl), arrow_schema(out_ddl)

    def cut(batches):
        import pyarrow as pa

        for batch in (b.slice(at, size) for b in batches for at, size in slices(b.column(4), 2 << 20)):
            rows, body = [], []
            for d, h, p, n, t in zip(*batch.columns, strict=True):
                h, p, n = (np.array(x.as_py()) for x in (h, p, n))
                b = K.raw(unsqueezed(t.as_py()))
                rows.append((h.astype(np.int64).view(np.uint64), np.full(len(h), d.as_py()), p, n))
                body.append(b[K.ragged(p, n + length - 1)])
            if not rows:
                continue
            h, d, p, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            body = np.concatenate(body)
            size = n + length - 1
            start = np.cumsum(size) - size
            order = np.argsort(h)
            part = part_of(h[order], parts)
            a, blobs = packed(part, [x[order] for x in (h, d, p, n)], "<u8 <i8 <i4 <i4")
            texts = [zlib.compress(body[K.ragged(start[k], size[k])].tobytes(), 1) for k in np.split(order, np.flatnonzero(part[1:] != part[:-1]) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(blobs, pa.binary()), pa.array(texts, pa.binary())], schema=cut_schema)

    def judge(batches):
        import pyarrow as pa

        for _, blobs in by_part(pa.RecordBatch.from_arrays([b.column(0), pa.array(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), pa.list_(pa.binary()))], names=["a", "b"]) for b in batches):
            h, d, p, n = (np.concatenate(x) for x in zip(*(unpacked(b[0], "<u8 <i8 <i4 <i4") for b in blobs), strict=True))
            text = np.concatenate([np.frombuffer(zlib.decompress(b[1]), np.uint8) for b in blobs])
            for chosen in anchor_chunks(h, n + length - 1):
                yield sort_chunk(d[chosen], p[chosen], n[chosen], text[K.ragged((np.cumsum(n + length - 1) - (n + length - 1))[chosen], (n + length - 1)[chosen])])

    def sort_chunk(d, p, n, text):
        import pyarrow as pa

        size = n + length - 1
        start = np.cumsum(size) - size
        places = K.ragged(start, n)
        _, pointer = suffix_buckets(text, length)
        group, doc = pointer[places], np.repeat(d, n)
        order = np.lexsort((doc, group))
        new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        least = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = np.zeros(len(places), bool)
        late[order] = doc[order] > least
        s, e = K.spans(np.concatenate([np.append(x, False) for x in np.split(late, np.cumsum(n)[:-1])])) if len(n) else (np.empty(0, int),) * 2
        base = np.cumsum(n + 1) - (n + 1)
        w = np.searchsorted(base, s, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(d[w]), pa.array((p[w] + s - base[w]).astype(np.int32)), pa.array((e - s).astype(np.int32))], schema=out_schema)

    return joined.mapInArrow(cut, cut_ddl).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(judge, out_ddl)


def anchor_chunks(h: np.ndarray, size: np.ndarray, most: int = 1 << 18):
    """Windows of whole anchors, about `most` bytes at a time: strings of different anchors are never equal."""
    order = np.argsort(h, kind="stable")
    total = np.cumsum(size[order])
    last = np.flatnonzero(np.append(h[order][1:] != h[order][:-1], True))
    at = done = 0
    while at < len(order):
        k = min(int(np.searchsorted(total[last], done + most)), len(last) - 1)
        to = int(last[k]) + 1
        yield order[at:to]
        at, done = to, int(total[to - 1])


def suffix_dedup(docs: DataFrame, length: int = 50, part_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of docs: doc_id and FIELDS."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = partitions_for(docs, F.octet_length(F.coalesce("text", F.lit(""))), part_bytes)
    found = materialize(settled(anchors(docs, length, parts, hot_anchors(docs, length)), parts), "windows")
    some = materialize(text_map(docs, lambda texts: [[squeezed(t) for t in texts]], [("z", "binary")]), "texts")
    late = sorted_windows(found.where("h is not null"), some.where("doc_id is not null"), length, parts)
    marks = found.where("h is null").select("doc", "p", "n").union(late).groupBy("doc").agg(F.collect_list(F.struct("p", "n")).alias("m"))
    joined = some.join(marks, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "z", F.col("m.p").alias("p"), F.col("m.n").alias("n"))
    out = "doc_id long, " + ", ".join(f"{f} {k}" for f, k in FIELDS)
    schema = arrow_schema(out)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for d, t, p, n in zip(*batch.columns, strict=True):
                t = unsqueezed(t.as_py())
                gone = np.zeros(len(t) + 1, np.int32)
                if p.is_valid:
                    p, n = p.values.to_numpy(), n.values.to_numpy()
                    np.add.at(gone, np.minimum(p, len(t)), 1)
                    np.add.at(gone, np.minimum(p + n + length - 1, len(t)), -1)
                    cover = np.cumsum(gone)[:-1] > 0
                    rest = K.raw(t)[~cover].tobytes()
                    rows.append((d.as_py(), len(t), int(cover.sum()), len(K.spans(cover)[0]), hashlib.sha256(rest).hexdigest()))
                else:
                    rows.append((d.as_py(), len(t), 0, 0, hashlib.sha256(t).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, out)
