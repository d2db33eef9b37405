"""Correlations between packet rows: pairing, as-of, positional and prefix joins, each shuffled once by its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_keep_last(requests: DataFrame, responses: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, request, response, first): a key's last request, the last response after it, and its first frame."""
    req = requests.groupBy(key).agg(F.max(frame).alias("request"), F.min(frame).alias("first"))
    resp = responses.select(F.col(key).alias("_k"), F.col(frame).alias("_f"))
    joined = req.join(resp, (req[key] == resp["_k"]) & (F.col("_f") > F.col("request")), "left")
    return joined.groupBy(key, "request", "first").agg(F.max("_f").alias("response"))


def pair_next(rows: DataFrame, key: str, frame: str, is_request: Column) -> DataFrame:
    """(key, request, response): each request's next response, or the key's last one where none follows.

    One window pass instead of a range join: the next response is a minimum over the rows that follow.
    """
    resp = F.when(~is_request, F.col(frame))
    after = Window.partitionBy(key).orderBy(frame).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(key)
    marked = rows.select(key, frame, is_request.alias("_req"), F.min(resp).over(after).alias("_next"), F.max(resp).over(whole).alias("_last"))
    return marked.where("_req").select(key, F.col(frame).alias("request"), F.coalesce("_next", "_last").alias("response"))


def first_response(rows: DataFrame, responses: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    """rows with the value of their key's first response; keys without one get null."""
    first = responses.groupBy(F.col(key).alias("_k")).agg(F.min_by(value, frame).alias("first_response"))
    return rows.join(first, rows[key] == first["_k"], "left").drop("_k")


def zip_join(left: DataFrame, right: DataFrame, by: list[str], left_order: list, right_order: list, value: str) -> DataFrame:
    """left with the value of the right row of the same ordinal within `by`; '' where right is shorter."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    b = right.select(*[F.col(c).alias(f"_{c}") for c in by], F.row_number().over(Window.partitionBy(*by).orderBy(*right_order)).alias("_m"), F.col(value).alias("_v"))
    on = F.col("_n") == F.col("_m")
    for c in by:
        on &= a[c] == b[f"_{c}"]
    return a.join(b, on, "left").withColumn(value, F.coalesce("_v", F.lit(""))).drop("_m", "_v", *[f"_{c}" for c in by]).withColumnRenamed("_n", "ordinal")


def carry_forward(rows: DataFrame, key: str, order: list, value: Column, name: str, default: str) -> DataFrame:
    """rows with the last non-null value so far within the key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def segments(rows: DataFrame, key: str, order: list, trigger: Column, name: str = "segment") -> DataFrame:
    """rows with the number of triggers so far within the key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(trigger, 1).otherwise(0)).over(w))


def longest_magic(rows: DataFrame, data: str, signatures: list[tuple], extension: str = "extension") -> DataFrame:
    """rows with the extension of the longest signature that matches the bytes, the first listed on ties.

    The table of signatures has a fixed size, so the match unrolls into one expression and no join is needed.
    """
    size = F.octet_length(F.col(data))
    found = []
    for i, (magic, offset, ext, *_) in enumerate(signatures):
        n = len(magic) // 2
        test = (size >= offset + n) & (F.hex(F.substring(F.col(data), offset + 1, n)) == magic.upper())
        found.append(F.when(test, F.struct(F.lit(n).alias("n"), F.lit(-i).alias("i"), F.lit(ext).alias("e"))))
    return rows.withColumn(extension, F.array_max(F.array(*found))["e"])


def keep_best(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def numbered(df: DataFrame, key: str, name: str, width: int = 100_000, ties: tuple = ()) -> DataFrame:
    """df with each row's place (from 1) in the order of a numeric key, without a sort of all rows in one task: rows are
    numbered within ranges of `width` key values, and ranges by a running sum over their counts, a row for each range."""
    rows = df.withColumn("_range", F.floor(F.col(key) / width))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key, *ties))
    return rows.withColumn("_own", within).join(before, F.col("_range") == F.col("_r")).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_r", "_before")
