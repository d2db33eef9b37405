"""Helpers shared by the operators: reading tables, scratch tables and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local folder of our own only on a local master that names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="packetloom-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, label: str, temp: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and reread it: the lineage ends here, and lost executors cost nothing.

    temp gets the table's path, for discard() once nothing that is still to run reads it."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if temp is not None:
        temp.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, temp: list[str]) -> None:
    """Delete tables written by materialize; what was read from them must have been written or collected by now."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    while temp:
        path = jvm.org.apache.hadoop.fs.Path(temp.pop())
        path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let the driver drop what is out of use now, so that shuffle files of finished steps leave the executors' disks.

    What ends a step's plan in Java may itself go in the first round only, so there are two."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions_for(df: DataFrame, size: Column, target: int, least: int = 1) -> int:
    """Partitions of about target bytes each for a table whose rows take size bytes."""
    total = df.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    return max(least, -(-int(total) // target))


def contracted(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(a, b), a > b: the same components as the given edges, each task's runs of `most` edges turned into stars; loops stay."""
    schema = arrow_schema("a long, b long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def stars(held):
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            a, b, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
            while True:
                was, m = low, np.minimum(low[a], low[b])
                low = low.copy()
                np.minimum.at(low, a, m)
                np.minimum.at(low, b, m)
                low = low[low]
                if (low == was).all():
                    break
            keep = low != np.arange(len(ids))
            loops = np.unique(ids[a[a == b]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[keep], loops])), pa.array(np.concatenate([ids[low[keep]], loops]))], schema=schema)

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n >= most:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (id, component): the smallest id reachable, for each id in an edge; a table in the shared folder.

    Each task first turns its edges into stars. Then alternating large-star and small-star rounds run, each a few shuffles
    over the edges alone, until a round changes nothing; a round's edges are written to the shared folder. The neighbourhood
    minimum is a partial aggregate, so a vertex with a large share of the edges is never gathered in one task. Rounds are
    logarithmic in the longest chain of stars. Null ends are dropped; self-loops keep their vertex.
    """
    spark, temp = edges.sparkSession, []
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").cast("long"), F.col("b").cast("long"))
    cur = materialize(contracted(edges), "cc", temp)
    loops = cur.where("a = b").select(F.col("a").alias("id")).distinct()
    first, cur = list(temp), cur.where("a <> b")
    temp.clear()
    seen = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        down = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        watch, old = Observation(), list(temp)
        temp.clear()
        cur = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct().observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "cc", temp)
        discard(spark, old)
        mark = watch.get
        if mark == seen:
            break
        seen = mark
    known = cur.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("component")), F.struct(F.col("b").alias("id"), F.col("b").alias("component")))).alias("x")).select("x.*")
    out = materialize(known.union(loops.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component")), "components")
    discard(spark, temp + first)
    return out


def arrow_schema(ddl):
    """Arrow's form of a schema given as DDL or as a StructType."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl)


def text_map(df: DataFrame, fn, fields: list[tuple[str, str]], carry: list[str] = ("doc_id",), text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """carry columns of df plus fields, which fn makes of lists of texts as bytes (null: empty), in Arrow batches.

    fn takes a list of bytes and returns one list or array for each field. Texts are handed over in slices of about
    slice_bytes, so memory follows the longest text and not the batch.
    """
    from pyspark.sql import types as T

    carry = list(carry)
    given = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    out = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)])
    for name, kind in fields:
        out.add(f"f_{name}", T._parse_datatype_string(kind))
    n, schema = len(carry), arrow_schema(out)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, size in slices(batch.column(n), slice_bytes):
                part = batch.slice(at, size)
                made = fn(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(schema.field(i).type) for i in range(n)), *(pa.array(x, schema.field(n + j).type) for j, x in enumerate(made))], schema=schema)

    return given.mapInArrow(run, out).toDF(*carry, *[name for name, _ in fields])


def slices(column, most: int = 1 << 20):
    """(offset, rows) of runs of an Arrow binary column that hold about most bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to - at
        at, done = to, ends[to - 1]
