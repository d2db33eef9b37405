"""Text scans of dissector output: field lines, quoted rows and PDML, as Columns over lines that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a quoted HTTP row, in order.
HTTP_FIELDS = ["frame_number", "method", "uri", "host", "content_type", "user_agent", "file_data", "src_ip", "dst_ip"]


def hex_bytes(text: Column) -> Column:
    """Bytes of hexadecimal text with or without colons; null for what is none."""
    return F.try_to_binary(F.replace(text, F.lit(":"), F.lit("")), F.lit("hex"))


def fields(lines: DataFrame, names: list[str], sep: str = "\t", least: int | None = None) -> DataFrame:
    """The named fields of lines (value) parted by a separator; missing last ones are empty, shorter lines than `least` go."""
    parts = F.split("value", "\\Q" + sep + "\\E", -1)
    rows = lines.where(F.trim("value") != "").select(parts.alias("p"))
    if least is not None:
        rows = rows.where(F.size("p") >= least)
    return rows.select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def quoted_rows(lines: DataFrame) -> DataFrame:
    """HTTP rows of lines (value) with quoted fields parted by bars; lines of under seven fields go, bad bodies are empty."""
    schema = ", ".join(f"{n} string" for n in HTTP_FIELDS)
    row = F.from_csv("value", F.lit(schema), {"sep": "|", "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    bars = F.length(F.regexp_replace(F.regexp_replace("value", '"[^"]*"', ""), r"[^|]", ""))
    out = lines.where((F.trim("value") != "") & (bars >= 6)).select(row.alias("r")).select("r.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(F.coalesce(F.col("frame_number").try_cast("long"), F.lit(0)).alias("frame_number"), *[text(c).alias(c) for c in HTTP_FIELDS[1:6]], F.coalesce(hex_bytes(F.col("file_data")), F.lit(b"")).alias("file_data"), text("src_ip").alias("src_ip"), text("dst_ip").alias("dst_ip"))


def pdml(packets: DataFrame, shown: dict[str, str]) -> DataFrame:
    """Fields of PDML packets (value, one <packet> each): output name -> field name; protocols, and shown values (null: absent)."""
    named = {n: F.get(F.xpath("value", F.lit(f"//field[@name='{f}']/@show")), F.lit(0)) for n, f in shown.items()}
    return packets.where(F.trim("value") != "").select(F.xpath("value", F.lit("/packet/proto/@name")).alias("protocols"), *[c.alias(n) for n, c in named.items()])


def read_pdml(spark, path: str, shown: dict[str, str]) -> DataFrame:
    """The packets of PDML files under a path, read with the packet's end as the end of a record."""
    text = spark.read.option("lineSep", "</packet>").text(path).where(F.contains("value", F.lit("<packet")))
    return pdml(text.select(F.concat(F.regexp_extract("value", r"(?s)(<packet.*)", 1), F.lit("</packet>")).alias("value")), shown)


def hex_text(text: Column) -> Column:
    """The text that a hexadecimal field stands for; colons, blanks and 0x aside, an odd last digit dropped, null under two."""
    clean = F.replace(F.replace(F.replace(text, F.lit(":"), F.lit("")), F.lit(" "), F.lit("")), F.lit("0x"), F.lit(""))
    even = F.substring(clean, F.lit(1), (F.floor(F.length(clean) / 2) * 2).cast("int"))
    return F.when(F.length(clean) >= 2, F.replace(F.make_valid_utf8(F.try_to_binary(even, F.lit("hex")).cast("string")), F.lit("�"), F.lit("")))


def key_files(spark, path: str) -> DataFrame:
    """(path, kind, keys) of key material under a path: PEM blocks, key log lines, or none for Java keystores and PKCS 12."""
    from ..operators.protocols import KEYLOG

    head = F.hex(F.substring("content", 1, 4))
    text = F.decode("content", "ISO-8859-1")
    pem = F.regexp_extract_all(text, F.lit(r"(?s)-----BEGIN ([A-Z ]+)-----.*?-----END \1-----"), F.lit(0))
    log = F.regexp_extract_all(text, F.lit(KEYLOG), F.lit(0))
    kind = F.when(F.size("pem") > 0, "pem").when(F.size("log") > 0, "keylog").when(head == "FEEDFEED", "jks").when(F.startswith(head, F.lit("3082")), "pkcs12").otherwise("unknown")
    rows = spark.read.format("binaryFile").load(path).select("path", "content", pem.alias("pem"), log.alias("log"))
    return rows.select("path", kind.alias("kind"), F.concat("pem", "log").alias("keys"))


def file_hex(spark, path: str, most: int = 4096) -> DataFrame:
    """(path, dump) of the first bytes of files under a path."""
    from ..operators.report import hex_lines

    return spark.read.format("binaryFile").load(path).select("path", hex_lines(F.col("content"), most).alias("dump"))
