"""Approximate nearest neighbours by inner product (op 5): stable projections, kd cells and a chi-square stopping test.

A vector x of norm at most M gets a further coordinate sqrt(M^2 - |x|^2), so the largest inner product is the smallest
distance. A Gaussian (2-stable) projection to `dims` axes keeps distances up to a chi-square factor: for a true
distance s, (projected distance / s)^2 has the chi-square distribution with `dims` degrees of freedom.

A kd-tree over the projected axes, fitted on a sample of at most `sample` rows, deals all rows into cells of about `cell`
rows, or as many cells as leave 32 rows of the sample in each; cells of over `salt` rows (a large table, or copies of one
vector, which cannot be split) are dealt on by a hash of the id, and a query visits all their parts. A query first
searches its own cell. Its k-th distance there decides which other cells it must visit: those whose box is not yet so
far, in projected distance, that the chi-square test at confidence `stop` would stop the search before it. Inside a cell
rows are verified in the order of projected distance, in blocks, until the test holds for the next one. Scores are inner
products of the original vectors in double precision.

Every row is indexed. Nulls: vectors null, zero, or with null or non-finite components take no part, nor do null ids. Ties
go to the smaller id; a query meets copies of its vector under other ids, and never rows of its own id, whatever their vectors.
Rows of one id and vector count once. Vectors
of other lengths than the first query's take no part. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialize


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    if x > 50 + 10 * a:
        return 1.0
    term = total = 1.0 / a
    n = a
    for _ in range(2000):
        n += 1
        term *= x / n
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(dims / 2, mid / 2) < p else (low, mid)
    return high


class Projection:
    def __init__(self, width: int, dims: int, norm: float, seed: int = 7):
        self.norm2 = norm * norm
        self.axes = np.random.default_rng(seed).standard_normal((width + 1, dims))

    def data(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(1)))
        return np.column_stack([x, rest]) @ self.axes

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Queries keep their direction and get the norm M: the order of inner products does not change."""
        scale = np.sqrt(self.norm2) / np.sqrt((x * x).sum(1))
        return np.column_stack([x * scale[:, None], np.zeros(len(x))]) @ self.axes


class Cells:
    """A kd-tree's inner nodes as arrays, and the boxes of its leaves within the sample."""

    def __init__(self, points: np.ndarray, cells: int):
        depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.depth, dims = depth, points.shape[1]
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        node = np.ones(len(points), np.int64)
        low, high = np.full((2 << depth, dims), -np.inf), np.full((2 << depth, dims), np.inf)
        for level in range(depth):
            for n in range(1 << level, 2 << level):
                own = points[node == n]
                axis = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
                cut = float(np.median(own[:, axis])) if len(own) else 0.0
                self.axis[n], self.cut[n] = axis, cut
                for child in (2 * n, 2 * n + 1):
                    low[child], high[child] = low[n], high[n]
                high[2 * n, axis], low[2 * n + 1, axis] = cut, cut
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        self.low, self.high = low[1 << depth :], high[1 << depth :]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance from a point to every box."""
        gap = np.maximum(0.0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(1)


def search(q: np.ndarray, far: np.ndarray, qid: int, x: np.ndarray, ids: np.ndarray, k: int, chi: float, base: float, bound: float = np.inf, block: int = 512) -> list[tuple[float, int]]:
    """The best (score, id) among rows (in order of their ids), verified in order of projected distance `far` until the test
    stops the search.

    base: what the squared distance of the scaled query is with an inner product of 0; bound: a squared distance that
    k rows are known to be within, so that rows the test would stop before are not even sorted.
    """
    near = np.flatnonzero(far <= chi * max(bound, 0.0)) if np.isfinite(bound) else np.arange(len(far))
    order = near[np.argsort(far[near], kind="stable")]
    best: list[tuple[float, int]] = []
    scale = math.sqrt(base / 2) / math.sqrt(float(q @ q))
    for at in range(0, len(order), block):
        kth = min(bound, base - 2 * scale * best[-1][0]) if len(best) == k else bound
        if far[order[at]] > chi * max(kth, 0.0):
            break
        rows = order[at : at + block]
        rows = rows[ids[rows] != qid]
        score = (x[rows] * q).sum(1)
        if len(best) == k:
            some = score >= best[-1][0]
            rows, score = rows[some], score[some]
        top = np.lexsort((ids[rows], -score))[:k]
        best = sorted(best + [(float(score[i]), int(ids[rows[i]])) for i in top], key=lambda v: (-v[0], v[1]))[:k]
    return best


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, dims: int = 8, cell: int = 4096, sample: int = 20_000, stop: float = 0.9, salt: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, its k nearest rows found."""
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("v", v).where(ok).select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    facts = rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.min(F.struct("vec_id", F.size("v").alias("w"))).alias("first")).first()
    ddl = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], ddl)
    width = facts["first"]["w"]
    rows = rows.where(F.size("v") == width)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    proj = Projection(width, dims, facts["norm"])
    chi = chi_square_quantile(stop, dims)
    base = 2 * facts["norm"] ** 2
    tree = Cells(proj.data(some), min(-(-facts["n"] // cell), max(1, len(some) // 32)))
    schema_in, schema_out = arrow_schema("vec_id long, v array<double>, cell int, px array<double>"), arrow_schema("query_id long, vec_id long, score double")

    def place(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if len(x):
                p = proj.data(x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.of(p).astype(np.int32)), pa.array(list(p), schema_in.field(3).type)], schema=schema_in)

    placed = materialize(rows.mapInArrow(place, "vec_id long, v array<double>, cell int, px array<double>"), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("m"))
    parts = {r["cell"]: -(-r["m"] // salt) for r in sizes.where(F.col("m") > salt).collect()}
    split = F.coalesce(F.element_at(F.create_map(*[F.lit(z) for kv in parts.items() for z in kv]), F.col("cell")), F.lit(1)) if parts else F.lit(1)
    data = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), split).cast("int"))
    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v")

    def route(bounds: bool):
        """Queries with the (cell, part) they visit: their own cell, or all others within reach of their bound."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                if not len(x):
                    continue
                pq = proj.queries(x)
                home = tree.of(pq)
                qs, cells_, split_ = [], [], []
                for i in range(len(x)):
                    if bounds:
                        kth = b.column(2)[i].as_py()
                        kth = np.inf if kth is None else base - 2 * math.sqrt(base / 2) / math.sqrt(float(x[i] @ x[i])) * kth
                        visit = np.flatnonzero(tree.distances(pq[i]) <= chi * kth)
                        visit = visit[visit != home[i]]
                    else:
                        visit = [home[i]]
                    for c in visit:
                        for s in range(parts.get(int(c), 1)):
                            qs.append(i)
                            cells_.append(c)
                            split_.append(s)
                at = pa.array(qs, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), (b.column(2) if bounds else pa.nulls(len(x), pa.float64())).take(at), pa.array(cells_, pa.int32()), pa.array(split_, pa.int32())], names=["vec_id", "v", "bound", "cell", "part"])

        return run

    routed_ddl = "vec_id long, v array<double>, bound double, cell int, part int"

    def visit(queries: DataFrame) -> DataFrame:
        def run(key, left, right):
            import pyarrow as pa

            q = left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = right.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            px = right.column("px").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ids = right.column("vec_id").to_numpy()
            out = []
            if len(q) and len(x):
                pq = proj.queries(q)
                order = np.argsort(ids, kind="stable")
                ids, x, px = ids[order], x[order], px[order]
                sizes, far = (px * px).sum(1), None
                for i, (qid, kth) in enumerate(zip(left.column("vec_id").to_pylist(), left.column("bound").to_pylist(), strict=True)):
                    if i % 64 == 0:
                        part = pq[i : i + 64]
                        far = np.maximum(0.0, sizes - 2 * (part @ px.T) + (part * part).sum(1)[:, None])
                    bound = np.inf if kth is None else base - 2 * math.sqrt(base / 2) / math.sqrt(float(q[i] @ q[i])) * kth
                    out += [(qid, d, s) for s, d in search(q[i], far[i % 64], qid, x, ids, k, chi, base, bound)]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema_out, strict=True)], schema=schema_out)

        return queries.groupBy("cell", "part").cogroup(data.groupBy("cell", "part")).applyInArrow(run, "query_id long, vec_id long, score double")

    near = materialize(visit(asked.mapInArrow(route(False), routed_ddl)), "near")
    kth = near.groupBy("query_id").agg(F.array_sort(F.collect_list("score"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("s")).select(F.col("query_id").alias("vec_id"), F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).alias("bound"))
    rest = visit(asked.join(kth, "vec_id", "left").select("vec_id", "v", "bound").mapInArrow(route(True), routed_ddl))
    ranked = near.union(rest).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
