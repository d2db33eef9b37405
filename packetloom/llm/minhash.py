"""MinHash near-duplicates (op 6) with sequential Bayesian verification and exact confirmation.

1. Every text becomes its set of hashed k-word shingles, a fingerprint of the set and a MinHash signature. Texts with one
   set form a class, one member of which stands for it, so copies are never compared.
2. Signatures are banded; a band's bucket links its members to pivots (the smallest and the smallest of a random order), so
   a bucket of n texts gives a few times n candidates, not n^2 pairs. Confirmed links are joined into components.
3. A candidate's signature is compared batch by batch; it is dropped as soon as the posterior probability of a similarity
   at or above the threshold, given the matches so far and a uniform prior, falls below `miss`. Survivors are confirmed
   on their full sets.
4. Buckets that still span several components are completed: the rows outside a bucket's largest component are compared
   with all rows that share a bucket of that component, in blocks of `block` by `block` rows, by the same test. So every
   pair that shares a band is tested unless it is already in one component.

Both steps deal each text's signature and compressed words to the blocks that need it, and a block tests, confirms and joins
up its rows in place: pairs exist only within numpy, and what leaves a task is a link between two components at most
once. Work in a family of n near copies of which m stay apart is m times n signature tests, spread over blocks.

With 128 hashes in 32 bands of 4, a pair at similarity 0.8 shares no band with probability 5e-8; `miss` is 1e-4. Sets
are told apart by 64-bit fingerprints: of 10^9 different sets two are taken for one with a chance of about 3 %.

Nulls: null or blank texts have no set and stand alone; null ids keep a row with a null component, not kept, and their sets
link others all the same. Rows of one id with different texts are sets of their own; each row gets its own set's
component, the smallest id among the component's rows. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import arrow_schema, connected_components, discard, materialize, slices, text_map

HASHES, BATCH, ROWS = 128, 32, 4
BANDS = HASHES // ROWS


@cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    return tuple((r.integers(0, 1 << 31, HASHES).astype(np.uint32) << np.uint32(1)) | np.uint32(1) for _ in range(2))


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima over the set, of two mixed halves times odd multipliers each."""
    a, b = multipliers()
    low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 256):
        np.minimum(out, (low[i : i + 256] * a[:, None] ^ high[i : i + 256] * b[:, None]).min(1), out=out)
    return out


def fingerprint(s: np.ndarray) -> int:
    """A 64-bit hash of a set, from two sums over differently mixed members; equal sets are taken by it for one."""
    both = np.array([K.mix(s).sum(dtype=np.uint64), K.mix(s + np.uint64(7)).sum(dtype=np.uint64)])
    return int(K.mix(both[:1] * np.uint64(3) + K.mix(both[1:] + np.uint64(len(s))))[0].view(np.int64))


def profile(docs: DataFrame, k: int, carry: list[str]) -> DataFrame:
    """carry, n (set size), rid (the set's id, a hash of its fingerprint), sig and z (compressed words); null for empty sets."""

    def run(texts):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        out = [[], [], [], []]
        for t in texts:
            b = K.LOWER[K.raw(t)]
            s = K.shingle_set(K.words(b)[2], k)
            n, none = len(s), not len(s)
            rid = None if none else fingerprint(s)
            for col, v in zip(out, (n, rid, None if none else signature(s).tobytes(), None if none else z.compress(b.tobytes())), strict=True):
                col.append(v)
        return out

    return text_map(docs, run, [("n", "long"), ("rid", "long"), ("sig", "binary"), ("z", "binary")], carry)


def banded_rows(reps: DataFrame) -> DataFrame:
    """(id, bucket): each signature's BANDS buckets, hashes of ROWS minima and the band's number."""
    schema = arrow_schema("id long, bucket long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = signatures(batch.column(1))
            h = np.full((len(x), BANDS), 0x51ED270B, np.uint64)
            for c in range(ROWS):
                h = K.mix(h * np.uint64(0x9FB21C651E98DF25) + x[:, c::ROWS])
            h = K.mix(h + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(h.view(np.int64).ravel())], schema=schema)

    return reps.select("rid", "sig").mapInArrow(run, "id long, bucket long")


def limits(threshold: float, miss: float) -> list[int]:
    """Fewest matches, after each batch of a signature, at which P(similarity >= threshold) is still at least miss."""
    x = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= threshold].sum() / p.sum() >= miss:
                out.append(m)
                break
    return out


def survivors(x: np.ndarray, sigs: np.ndarray, rows: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the given rows of a signature matrix pass the sequential test with x; later batches look at survivors alone."""
    matches = np.zeros(len(rows), np.int64)
    for i, m in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (sigs[rows, part] == x[part]).sum(1)
        keep = matches >= m
        rows, matches = rows[keep], matches[keep]
    return rows


def signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


class Sets:
    """Shingle sets of some rows as indices into their union, to intersect one set with many of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.union, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.starts = flat, np.cumsum(self.sizes) - self.sizes

    def common(self, s: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        held = np.zeros(len(self.union), bool)
        held[at[self.union[at] == s]] = True
        size = self.sizes[rows]
        return np.add.reduceat(held[self.flat[K.ragged(self.starts[rows], size)]], np.cumsum(size) - size, dtype=np.int64)


class Group:
    """The left rows of one block, its components as joined up so far, and the links found."""

    def __init__(self, k: int, percent: int, least: list[int]):
        import zstandard

        self.k, self.percent, self.least, self.z = k, percent, least, zstandard.ZstdDecompressor()
        self.parent: dict[int, int] = {}
        self.ids, self.comps, self.few, self.sigs, self.packed, self.sets = [], [], [], [], [], {}

    def root(self, c: int) -> int:
        while (p := self.parent.get(c, c)) != c:
            self.parent[c] = c = self.parent.get(p, p)
        return c

    def shingles(self, z: bytes) -> np.ndarray:
        return K.shingle_set(K.words(K.raw(self.z.decompress(z)))[2], self.k)

    def left(self, ids, comps, sigs, packed) -> None:
        self.ids += ids
        self.comps += comps
        self.sigs += list(sigs)
        self.packed += packed

    def compare(self, ids: np.ndarray, comps: np.ndarray, few: np.ndarray, sigs: np.ndarray, packed: list[bytes]) -> list[tuple[int, int]]:
        """Links of the left rows with the given ones: one for each two components at most."""
        out, sets, place = [], None, np.full(len(ids), -1)
        roots = np.array([self.root(c) for c in comps.tolist()], np.int64)
        near = [(i, survivors(self.sigs[i], sigs, np.flatnonzero((roots != self.root(self.comps[i])) & ~(few & (ids >= x))), self.least)) for i, x in enumerate(self.ids)]
        asked = np.unique(np.concatenate([r for _, r in near])) if near else np.empty(0, np.int64)
        if not len(asked):
            return out
        sets, place[asked] = Sets([self.shingles(packed[j]) for j in asked.tolist()]), np.arange(len(asked))
        for i, rows in near:
            if not len(rows):
                continue
            own = self.sets.get(i)
            if own is None:
                own = self.sets[i] = self.shingles(self.packed[i])
            n = sets.sizes[place[rows]]
            fit = self.percent * np.maximum(n, len(own)) <= 100 * np.minimum(n, len(own))
            rows, n = rows[fit], n[fit]
            if not len(rows):
                continue
            both = sets.common(own, place[rows])
            for j in rows[100 * both >= self.percent * (n + len(own) - both)].tolist():
                a, b = self.root(self.comps[i]), self.root(int(comps[j]))
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    out.append((self.ids[i], int(ids[j])))
        return out


def links_of(rows: DataFrame, vectors: DataFrame, k: int, threshold: float, least: list[int]) -> DataFrame:
    """(a, b) of the rows (key, right, few, id, c): in each key, links of left rows with right ones of other components c.

    few marks right rows that are left ones too, so that such a pair is met once."""
    percent, schema = round(100 * threshold), arrow_schema("a long, b long")

    def run(batches):
        import pyarrow as pa

        held, group = None, None
        for batch in (b.slice(at, size) for b in batches for at, size in slices(b.column(6), 1 << 20)):
            key, right = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (right[1:] != right[:-1])) + 1
            found = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
                if key[a] != held:
                    held, group = key[a], Group(k, percent, least)
                part = batch.slice(a, b - a)
                ids, comps, sigs, packed = part.column(3), part.column(4), signatures(part.column(5)), part.column(6).to_pylist()
                if right[a]:
                    found += group.compare(ids.to_numpy(), comps.to_numpy(), part.column(2).to_numpy(zero_copy_only=False), sigs, packed)
                else:
                    group.left(ids.to_pylist(), comps.to_pylist(), sigs, packed)
            if found:
                x, y = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=schema)

    full = rows.join(vectors.withColumnRenamed("rid", "id"), "id").select("key", "right", "few", "id", "c", "sig", "z")
    return full.repartition("key").sortWithinPartitions("key", "right", "id").mapInArrow(run, "a long, b long")


def parts_of(n: Column, block: int) -> Column:
    """A power of two of parts for n rows, so that buckets of about one size agree on it."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(n / block)))).cast("int")


def star_rows(rows: DataFrame, block: int) -> DataFrame:
    """Rows for links_of: each bucket's pivots on the left of all its rows, in parts."""
    pivots = rows.groupBy("bucket").agg(F.min("id").alias("p0"), F.min_by("id", F.xxhash64(F.lit(1), "id")).alias("p1"), F.count("*").alias("m")).where("m > 1")
    pivots = pivots.select("bucket", F.explode(F.array_distinct(F.array("p0", "p1"))).alias("g"), parts_of(F.col("m"), block).alias("parts"))
    key = lambda part: F.xxhash64("g", "parts", part).alias("key")
    right = rows.join(pivots, "bucket").where("id <> g").select(key(F.pmod(F.xxhash64("id"), F.col("parts"))), F.lit(True).alias("right"), "id")
    left = pivots.select("g", "parts").distinct().select("g", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(key(F.col("part").cast("long")), F.lit(False).alias("right"), F.col("g").alias("id"))
    return right.distinct().union(left).select("key", "right", F.lit(False).alias("few"), "id", F.col("id").alias("c"))


def mixed_rows(rows: DataFrame, labels: DataFrame, block: int, temp: list[str]) -> DataFrame:
    """Rows for links_of: of the buckets that span several components, those outside the largest one, top, on the left of all
    rows in buckets of that top, in parts on both sides."""
    labelled = materialize(rows.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")), "labelled", temp)
    by_comp = labelled.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    several = by_comp.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "top")
    members = materialize(labelled.join(several, "bucket").select("top", "id", "c").distinct(), "mixed", temp)
    sizes = members.groupBy("top").agg(parts_of(F.count_if(F.col("c") != F.col("top")), block).alias("nl"), parts_of(F.count("*"), block).alias("nr"))
    dealt = members.join(sizes, "top")
    side = lambda n, n2, right: F.struct(F.xxhash64("top", *((n2, n) if right else (n, n2))).alias("key"), F.lit(right).alias("right"))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    many = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1)
    left = F.when(F.col("c") != F.col("top"), F.transform(many("nr"), lambda j: side(own("nl"), j, False))).otherwise(F.array().cast("array<struct<key:long,right:boolean>>"))
    right = F.transform(many("nl"), lambda j: side(own("nr"), j, True))
    return dealt.select("id", "c", (F.col("c") != F.col("top")).alias("few"), F.explode(F.concat(left, right)).alias("x")).select("x.key", "x.right", "few", "id", "c")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = 1e-4, block: int = 2048, carry: list[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, carry, n_shingles, component_id (smallest id reachable), kept (it is that id)."""
    spark, temp = docs.sparkSession, []
    least = limits(threshold, miss)
    carry = ["doc_id", *carry]
    prof = materialize(profile(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry[1:]), k, carry), "profile")
    reps = materialize(prof.where("rid is not null").groupBy("rid").agg(F.min("doc_id").alias("head"), F.first("sig").alias("sig")), "reps")
    rows = banded_rows(reps)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    rows = materialize(rows.join(shared, "bucket"), "bands", temp)
    some = rows.select(F.col("id").alias("rid")).distinct().join(reps.select("rid", "sig"), "rid")
    words = prof.where("rid is not null").groupBy("rid").agg(F.first("z").alias("z"))
    vectors = materialize(some.join(words, "rid"), "vectors", temp)
    stars = links_of(star_rows(rows, block), vectors, k, threshold, least)
    labels = connected_components(stars)
    more = links_of(mixed_rows(rows, labels, block, temp), vectors, k, threshold, least)
    labels = connected_components(more.union(labels.where("id <> component").select("id", "component")))
    discard(spark, temp)

    named = reps.select("rid", "head").join(labels, F.col("rid") == F.col("id"), "left").select("rid", "head", F.coalesce("component", "rid").alias("c"))
    least_id = named.groupBy("c").agg(F.min("head").alias("component_id"))
    of_set = named.join(least_id, "c").select(F.col("rid").alias("r"), "component_id")
    out = prof.select(*carry, "n", "rid").join(of_set, F.col("rid") == F.col("r"), "left")
    comp = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select(*carry, F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))
