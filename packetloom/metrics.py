"""Counts on the side: how many rows of a query meet some conditions, without another pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """df and an observation that holds, once an action has run, `rows` and the number of rows of each condition."""
    watch = Observation()
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), watch


def hit_rate(watch: Observation, hit: str) -> float:
    """The share of an observation's rows that meet a condition; 0 without rows."""
    got = watch.get
    return got[hit] / got["rows"] if got["rows"] else 0.0
