"""Structured Streaming forms: deduplicated scoring of arriving payloads, and attempts by source and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scoring as S


def score_stream(rows: DataFrame, text: str, key: list[str], event_time: str, late: str = "10 minutes", least: int = 40) -> DataFrame:
    """Arriving payloads of at least this weight, once per key within the watermark."""
    once = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)
    return S.attack_scores(once, text).where(F.col("total_weight") >= least)


def attempts_by_window(rows: DataFrame, source: str, event_time: str, is_attempt: Column, width: str = "60 seconds", late: str = "10 minutes", least: int = 10) -> DataFrame:
    """Sources with many attempts in a tumbling window of event time."""
    counted = rows.where(is_attempt).withWatermark(event_time, late).groupBy(F.window(event_time, width), source).agg(F.count("*").alias("attempts"))
    return counted.where(F.col("attempts") >= least).select(source, F.col("window.start").alias("start"), "attempts")
