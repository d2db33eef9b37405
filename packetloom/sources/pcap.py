"""Packet captures: `read_pcap` for batches in splits, and a data source, `spark.read.format("pcap")` or `readStream`.

Reads pcap (both byte orders, micro- and nanoseconds) and pcapng, Ethernet with VLAN tags, IPv4, TCP, UDP and ICMP, and the
first line and headers of HTTP/1 messages. A capture is dealt in splits of bytes: a split finds its first record by a run of
headers that fit each other, a first job counts each split's frames, and the sums number the frames of the second. Stores
that only Spark can open are read whole, a file a task. The data source filters rows by pushed comparisons before they
reach the JVM, and as a stream takes the files of a folder in the order of their names: a capture that is rotated while it
runs is read live.
"""

from __future__ import annotations

import glob
import os
import socket
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "frame_number long, ts timestamp, length int, protocol string, src_ip string, dst_ip string, src_port int, dst_port int, ttl int, tcp_flags int, icmp_type int, icmp_seq int, http_method string, http_uri string, http_response_code string, payload binary"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Magic numbers of the file header -> byte order and units of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
NG = b"\x0a\x0d\x0d\x0a"
METHODS = (b"GET ", b"POST ", b"PUT ", b"HEAD ", b"DELETE ", b"OPTIONS ", b"PATCH ")


def frames(data: bytes) -> Iterator[tuple[int, float, int, bytes]]:
    """(number, seconds, original length, bytes) of each whole frame of a capture; a cut last frame ends it."""
    if data[:4] == NG:
        for number, (seconds, size, frame) in enumerate(ng_frames(data), 1):
            yield number, seconds, size, frame
    elif data[:4] in MAGIC:
        order, unit = MAGIC[data[:4]]
        for number, (_, seconds, size, frame) in enumerate(records(data, 24, len(data), order, unit), 1):
            yield number, seconds, size, frame


def records(data: bytes, at: int, end: int, order: str, unit: int) -> Iterator[tuple[int, float, int, bytes]]:
    """(place, seconds, original length, bytes) of the records that begin from `at` to before `end`."""
    while at < end and at + 16 <= len(data):
        sec, frac, kept, size = struct.unpack_from(order + "IIII", data, at)
        if at + 16 + kept > len(data):
            return
        yield at, sec + frac / unit, size, data[at + 16 : at + 16 + kept]
        at += 16 + kept


def ng_frames(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    """(seconds, original length, bytes) of the enhanced and simple packet blocks of a pcapng capture."""
    at, order, units = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == NG:
            order, units = ("<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        if kind == 1:  # an interface, with its unit of time
            unit, o = 10**6, at + 16
            while o + 4 <= at + size - 4:
                code, n = struct.unpack_from(order + "HH", data, o)
                if code == 9 and n == 1:
                    unit = 2 ** (data[o + 4] & 127) if data[o + 4] & 128 else 10 ** data[o + 4]
                if code == 0:
                    break
                o += 4 + (n + 3) // 4 * 4
            units.append(unit)
        elif kind == 6:
            face, high, low, kept, full = struct.unpack_from(order + "IIIII", data, at + 8)
            yield ((high << 32) + low) / (units[face] if face < len(units) else 10**6), full, data[at + 28 : at + 28 + kept]
        elif kind == 3:
            full = struct.unpack_from(order + "I", data, at + 8)[0]
            yield 0.0, full, data[at + 12 : at + 12 + min(full, size - 16)]
        at += size


def first_record(data: bytes, order: str, unit: int, chain: int = 6) -> int | None:
    """The first place from which `chain` record headers (or all up to the end) fit each other; None for none."""
    for start in range(max(0, len(data) - 16)):
        at, seen, last = start, 0, None
        while at + 16 <= len(data) and seen < chain:
            sec, frac, kept, size = struct.unpack_from(order + "IIII", data, at)
            if frac >= unit or not 0 < kept <= size <= 1 << 18 or (last is not None and abs(sec - last) > 86_400):
                break
            last, at, seen = sec, at + 16 + kept, seen + 1
        else:
            if seen >= 2 or (seen and at == len(data)):
                return start
    return None


def dissect(frame: bytes) -> dict:
    """The fields of a frame that the layers down to HTTP's first line give."""
    out: dict = {"protocol": "ETH", "payload": b""}
    at, kind = 14, frame[12:14]
    while kind == b"\x81\x00" and len(frame) >= at + 4:
        kind, at = frame[at + 2 : at + 4], at + 4
    if kind != b"\x08\x00" or len(frame) < at + 20:
        return out
    head, proto = (frame[at] & 15) * 4, frame[at + 9]
    total = struct.unpack_from(">H", frame, at + 2)[0]
    out |= {"protocol": "IP", "src_ip": socket.inet_ntoa(frame[at + 12 : at + 16]), "dst_ip": socket.inet_ntoa(frame[at + 16 : at + 20]), "ttl": frame[at + 8]}
    body = frame[at + head : at + total] if total else frame[at + head :]
    if proto == 6 and len(body) >= 20:
        sport, dport = struct.unpack_from(">HH", body)
        out |= {"protocol": "TCP", "src_port": sport, "dst_port": dport, "tcp_flags": body[13], "payload": body[(body[12] >> 4) * 4 :]}
        line = out["payload"].split(b"\r\n", 1)[0]
        if line.startswith(METHODS) and b" HTTP/1." in line:
            method, uri = line.split(b" ")[:2]
            out |= {"protocol": "HTTP", "http_method": method.decode(), "http_uri": uri.decode("latin-1")}
        elif line.startswith(b"HTTP/1."):
            out |= {"protocol": "HTTP", "http_response_code": line[9:12].decode("latin-1")}
    elif proto == 17 and len(body) >= 8:
        sport, dport = struct.unpack_from(">HH", body)
        out |= {"protocol": "DNS" if 53 in (sport, dport) else "UDP", "src_port": sport, "dst_port": dport, "payload": body[8:]}
    elif proto == 1 and len(body) >= 8:
        out |= {"protocol": "ICMP", "icmp_type": body[0], "icmp_seq": struct.unpack_from(">H", body, 6)[0], "payload": body[8:]}
    return out


def fields_of(number: int, seconds: float, size: int, frame: bytes) -> dict:
    import datetime

    return {"frame_number": number, "ts": datetime.datetime.fromtimestamp(0, datetime.UTC).replace(tzinfo=None) + datetime.timedelta(seconds=seconds), "length": size} | dissect(frame)


def local_files(path: str) -> list[str] | None:
    """The files under a path that this machine and the executors open alike; None where only Spark can open it."""
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        return None
    found = glob.glob(where.path)
    files = [f for p in found for f in ([p] if os.path.isfile(p) else [os.path.join(p, n) for n in os.listdir(p)])]
    return sorted(f for f in files if os.path.isfile(f))


def split_bytes(file: str, start: int, end: int, margin: int = 1 << 19) -> tuple[bytes, str, int, int] | None:
    """(bytes, order, unit, place of the first record in them) of one split, with what its last record may need."""
    with open(file, "rb") as f:
        magic = f.read(4)
        if magic not in MAGIC:
            return None
        order, unit = MAGIC[magic]
        f.seek(max(24, start))
        data = f.read(end - max(24, start) + margin)
    first = 0 if start == 0 else first_record(data, order, unit)
    return None if first is None else (data, order, unit, first)


def read_pcap(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(path, fields of SCHEMA) of every frame of every capture under the path."""
    import pandas as pd

    def typed(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ["path", *NAMES]})
        for c in ("frame_number", "length", "src_port", "dst_port", "ttl", "tcp_flags", "icmp_type", "icmp_seq"):
            out[c] = out[c].astype("Int64")
        out["ts"] = pd.to_datetime(out["ts"])
        return out

    def batches_of(rows, most: int = 5000):
        held = []
        for row in rows:
            held.append(row)
            if len(held) == most:
                yield typed(held)
                held = []
        if held:
            yield typed(held)

    def whole(batches):
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                yield from batches_of({"path": file} | fields_of(*f) for f in frames(data))

    ddl = "path string, " + SCHEMA
    files = local_files(path)
    large = [f for f in files or [] if os.path.getsize(f) > split and open(f, "rb").read(4) in MAGIC]
    if not large:
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(whole, ddl)
    parts = [(f, at, min(at + split, os.path.getsize(f))) for f in files for at in (range(0, os.path.getsize(f), split) if f in large else [0])]
    dealt = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "i int, path string, start long, end long").repartitionByRange(len(parts), "i")

    def counted(batches):
        for pdf in batches:
            rows = []
            for i, file, start, end in pdf.itertuples(index=False):
                got = split_bytes(file, start, end)
                n = sum(1 for _ in records(got[0], got[3], end - max(24, start), *got[1:3])) if got else 0
                rows.append((i, n))
            yield pd.DataFrame(rows, columns=["i", "n"])

    counts = dict(dealt.mapInPandas(counted, "i int, n long").collect())
    begin, numbers = {}, []
    for i, (f, *_) in enumerate(parts):
        numbers.append((i, *parts[i], begin.get(f, 0)))
        begin[f] = begin.get(f, 0) + counts[i]
    numbered = spark.createDataFrame(numbers, "i int, path string, start long, end long, before long").repartitionByRange(len(parts), "i")

    def read(batches):
        for pdf in batches:
            for _, file, start, end, before in pdf.itertuples(index=False):
                got = split_bytes(file, start, end)
                if got:
                    rows = enumerate(records(got[0], got[3], end - max(24, start), *got[1:3]), before + 1)
                    yield from batches_of({"path": file} | fields_of(n, *r[1:]) for n, r in rows)
                elif start == 0:
                    with open(file, "rb") as f:
                        yield from batches_of({"path": file} | fields_of(*x) for x in frames(f.read()))

    return numbered.mapInPandas(read, ddl)


# The data source.

TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class FilePart(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def rows_of(files: list[str], names: list[str], tests: list, limit: int) -> Iterator[tuple]:
    """Tuples of the named fields of the frames that pass the tests (column, operation, value), `limit` a file at most (0: all)."""
    for file in files:
        with open(file, "rb") as f:
            data = f.read()
        given = 0
        for x in frames(data):
            row = fields_of(*x)
            if all(row.get(c) is not None and (op is None or op(row[c], v)) for c, op, v in tests):
                yield tuple(row.get(n) for n in names)
                given += 1
                if given == limit:
                    break


class PcapReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.tests = options, names, []

    def pushFilters(self, filters):
        for f in filters:
            op = next((t for kind, t in TESTS.items() if type(f) is kind), None)
            plain = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in NAMES and f.attribute[0] != "ts"
            if plain and op is not None:
                self.tests.append((f.attribute[0], op, f.value))
            elif plain and isinstance(f, IsNotNull):
                self.tests.append((f.attribute[0], None, None))
            else:
                yield f

    def partitions(self):
        return [FilePart([f]) for f in local_files(self.options["path"]) or []]

    def read(self, partition):
        return rows_of(partition.files, self.names, self.tests, int(self.options.get("limit", 0)))


class PcapStream(DataSourceStreamReader):
    """Files of a folder in the order of their names, a task each; a batch takes what has come since the last one."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        return {"after": max(local_files(self.options["path"]) or [""])}

    def partitions(self, start, end):
        return [FilePart([f]) for f in local_files(self.options["path"]) or [] if start["after"] < f <= end["after"]]

    def read(self, partition):
        return rows_of(partition.files, self.names, [], int(self.options.get("limit", 0)))


class PcapSource(DataSource):
    """Captures by format("pcap"). Options: path, limit (frames a file). Columns: schema(...)."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PcapReader(dict(self.options), [f.name for f in schema.fields])

    def streamReader(self, schema):
        return PcapStream(dict(self.options), [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    """Make format("pcap") known to the session, with its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PcapSource)


def write_pcap(packets: list[tuple[float, bytes]]) -> bytes:
    """A capture file of (seconds, frame) pairs."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for t, frame in packets:
        out.append(struct.pack("<IIII", int(t), round(t % 1 * 10**6), len(frame), len(frame)) + frame)
    return b"".join(out)


def repaired(data: bytes) -> list[bytes]:
    """Frames cut out of damaged bytes: from 12 bytes before each IPv4 EtherType and header start to the next one."""
    hits = []
    at = data.find(b"\x08\x00\x45")
    while at >= 0:
        hits.append(max(0, at - 12))
        at = data.find(b"\x08\x00\x45", at + 3)
    cut = [data[a:b] for a, b in zip(hits, [*hits[1:], len(data)], strict=True)]
    return [x[:1514] for x in cut if len(x) >= 40]


def read_damaged(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, frame) of the frames cut out of damaged captures under the path."""

    @F.udf("array<binary>")
    def cut(data):
        return [bytearray(x) for x in repaired(bytes(data))]

    return spark.read.format("binaryFile").load(path).select("path", F.posexplode(cut("content")).alias("number", "frame")).withColumn("number", F.col("number") + 1)


def read_ek(spark: SparkSession, path: str) -> DataFrame:
    """Dissected packets from EK JSON lines; index lines and lines that are not JSON are dropped."""
    return ek_fields(spark.read.text(path))


def ek_fields(lines: DataFrame) -> DataFrame:
    """Dissected packets of a table of EK JSON lines (value)."""
    v = F.try_parse_json("value")
    first = lambda key, kind="string": F.coalesce(F.try_variant_get("v", f"$.layers.{key}[0]", kind), F.try_variant_get("v", f"$.layers.{key}", kind))
    rows = lines.select(v.alias("v")).where(F.col("v").isNotNull() & F.try_variant_get("v", "$.layers", "variant").isNotNull())
    protocols = first("frame.frame_frame_protocols")
    data = F.coalesce(F.unhex(F.replace(first("http.http_http_file_data"), F.lit(":"), F.lit(""))), first("http.http_http_file_data").cast("binary"))
    answer = first("http.http_http_response_code").isNotNull() & first("http.http_http_request_method").isNull()
    return rows.select(
        F.coalesce(first("frame.frame_frame_number", "bigint"), F.lit(0)).alias("frame_number"),
        first("frame.frame_frame_time").alias("ts_text"),
        first("frame.frame_frame_len", "int").alias("length"),
        F.upper(F.element_at(F.split(protocols, ":"), -1)).alias("protocol"),
        F.split(protocols, ":").alias("layers"),
        first("ip.ip_ip_src").alias("src_ip"),
        first("ip.ip_ip_dst").alias("dst_ip"),
        F.coalesce(first("tcp.tcp_tcp_srcport", "int"), first("udp.udp_udp_srcport", "int")).alias("src_port"),
        F.coalesce(first("tcp.tcp_tcp_dstport", "int"), first("udp.udp_udp_dstport", "int")).alias("dst_port"),
        first("tcp.tcp_tcp_stream", "bigint").alias("tcp_stream"),
        first("http.http_http_request_method").alias("http_method"),
        first("http.http_http_request_uri").alias("http_uri"),
        first("http.http_http_host").alias("http_host"),
        first("http.http_http_content_type").alias("http_content_type"),
        first("http.http_http_user_agent").alias("http_user_agent"),
        first("http.http_http_cookie").alias("http_cookie"),
        first("http.http_http_response_code").alias("http_response_code"),
        data.alias("body"),
        F.when(answer, data).alias("http_response_body"),
        F.when(~answer, data).alias("http_request_body"),
        F.col("v").alias("raw"),
    )
