"""Sinks: reports, extracted files, name lists, captures, media and batches of a stream."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators.report import html_report, json_report


def write_summary(summary: dict, path: str) -> str:
    """A capture's summary as JSON or, by the path's ending, as a page."""
    text = html_report(summary) if path.endswith((".html", ".htm")) else json_report(summary)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def safe_name(name: str) -> str:
    """A file name without what systems forbid, within 100 characters."""
    return re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", os.path.basename(name.replace("\\", "/")))[:100].strip(". ") or "file"


def write_files(df: DataFrame, folder: str, name: str = "filename", content: str = "content") -> DataFrame:
    """(path, bytes) of the rows' contents written into a folder that all executors share; equal names get numbers.

    Numbers come from a window by name, so they do not depend on which task writes first; a task that runs again writes
    the same files."""
    from pyspark.sql import Window

    safe = F.udf(safe_name)
    os.makedirs(folder, exist_ok=True)
    rows = df.select(safe(F.coalesce(F.col(name), F.lit("file"))).alias("n"), F.col(content).alias("c"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("n").orderBy(F.octet_length("c"), F.md5("c"))))

    def put(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for n, c, i in pdf.itertuples(index=False):
                stem, ext = os.path.splitext(n)
                path = os.path.join(folder, n if i == 1 else f"{stem}_{i - 1}{ext}")
                tmp = f"{path}.{os.getpid()}.part"
                with open(tmp, "wb") as f:
                    f.write(c or b"")
                os.replace(tmp, path)
                out.append((path, len(c or b"")))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return rows.mapInPandas(put, "path string, bytes long")


def write_names(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column as lines of text, sorted within each file."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().sortWithinPartitions("value").write.mode("overwrite").text(path)


def wav(data: bytes, form: int = 7, rate: int = 8000, channels: int = 1, bits: int = 8) -> bytes:
    """Media bytes as a WAV file; form 7 is mu-law, 6 A-law, 1 plain samples."""
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHHH", form, channels, rate, rate * block, block, bits, 0)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data) // block) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def media_files(rows: DataFrame) -> DataFrame:
    """(filename, content): the media of RTP packets (see operators.protocols.rtp_packets) by stream; mu- and A-law as WAV."""
    parts = F.array_sort(F.collect_list(F.struct("frame_number", F.hex("media").alias("h"))))
    g = rows.groupBy("ssrc").agg(F.min_by("pt", "frame_number").alias("pt"), F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("raw"))

    @F.udf("binary")
    def made(pt, raw):
        return wav(bytes(raw), {0: 7, 8: 6}[pt]) if pt in (0, 8) else raw

    name = F.concat(F.lit("rtp_"), "ssrc", F.when(F.col("pt").isin(0, 8), ".wav").otherwise(".raw"))
    return g.select(name.alias("filename"), made(F.col("pt").cast("int"), "raw").alias("content"))


def emit(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, every: str = "200 milliseconds", mode: str = "append") -> StreamingQuery:
    """Hand a stream's batches to put(rows, number) at a latency; the source's options bound a batch, and nothing is dropped."""
    return stream.writeStream.outputMode(mode).trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(put).start()


def report_name(folder: str, kind: str = "json") -> str:
    return os.path.join(folder, f"report_{datetime.now():%Y%m%d_%H%M%S}.{kind}")
