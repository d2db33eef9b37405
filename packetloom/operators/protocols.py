"""Protocol analyzers over payloads: TLS, RDP, SMB, SSH, FTP, SMTP, Redis, RTP, DNS, beacon cookies, industrial files.

Messages are cut out of payload bytes by small parsers over Arrow batches (handshakes, NTLM, RTP headers, commands); all that
joins, groups and orders them is DataFrame code by stream, so a stream's state is a window and not a loop over a capture. A
stream is the pair of ends of a conversation unless the packets name one (`tcp_stream`).
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Versions of the record and handshake layers.
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
WEAK_TLS = ["RC4", "DES", "NULL", "EXPORT", "anon", "MD5"]
#: Numbers and names of cipher suites that servers choose, those in use first.
SUITES = {
    0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", 0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", 0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256", 0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384", 0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA", 0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA", 0x000A: "TLS_RSA_WITH_3DES_EDE_CBC_SHA",
    0x0004: "TLS_RSA_WITH_RC4_128_MD5", 0x0005: "TLS_RSA_WITH_RC4_128_SHA", 0x0001: "TLS_RSA_WITH_NULL_MD5", 0x0003: "TLS_RSA_EXPORT_WITH_RC4_40_MD5", 0x0018: "TLS_DH_anon_WITH_RC4_128_MD5", 0x0009: "TLS_RSA_WITH_DES_CBC_SHA",
}
#: Labels of key log lines.
KEYLOG_LABELS = ["CLIENT_RANDOM", "CLIENT_HANDSHAKE_TRAFFIC_SECRET", "SERVER_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0", "EXPORTER_SECRET", "EARLY_TRAFFIC_SECRET", "RSA"]
KEYLOG = "(?:" + "|".join(KEYLOG_LABELS) + r")\s+[0-9a-fA-F]{64}\s+[0-9a-fA-F]{48,}"
#: Security protocols of remote desktops.
RDP_PROTOCOLS = {"0": "standard RDP", "1": "TLS", "2": "CredSSP (NLA)", "3": "CredSSP and TLS"}
#: Payload type -> codec, medium, clock.
RTP_TYPES = {
    0: ("PCMU", "audio", 8000), 3: ("GSM", "audio", 8000), 4: ("G723", "audio", 8000), 5: ("DVI4", "audio", 8000), 6: ("DVI4", "audio", 16000), 7: ("LPC", "audio", 8000), 8: ("PCMA", "audio", 8000), 9: ("G722", "audio", 8000),
    10: ("L16", "audio", 44100), 11: ("L16", "audio", 44100), 12: ("QCELP", "audio", 8000), 13: ("CN", "audio", 8000), 14: ("MPA", "audio", 90000), 15: ("G728", "audio", 8000), 16: ("DVI4", "audio", 11025), 17: ("DVI4", "audio", 22050), 18: ("G729", "audio", 8000),
    25: ("CelB", "video", 90000), 26: ("JPEG", "video", 90000), 28: ("nv", "video", 90000), 31: ("H261", "video", 90000), 32: ("MPV", "video", 90000), 33: ("MP2T", "video", 90000), 34: ("H263", "video", 90000),
}
VIDEO = ["H264", "H265", "VP8", "VP9", "AV1", "H261", "H263"]
#: Redis commands by what they tell.
REDIS_SET = ["SET", "SETNX", "SETEX", "MSET", "HSET", "HSETNX", "APPEND"]
REDIS_GET = ["GET", "HGET", "MGET", "HGETALL", "KEYS"]
REDIS_WRITE = ["LPUSH", "RPUSH", "SADD", "ZADD", "PUBLISH"]


def end_of(side: str) -> Column:
    return F.concat_ws(":", f"{side}_ip", F.col(f"{side}_port").cast("string"))


def streams(packets: DataFrame) -> DataFrame:
    """packets with `stream`, a number for each pair of ends."""
    if "tcp_stream" in packets.columns:
        return packets.withColumn("stream", F.col("tcp_stream"))
    return packets.withColumn("stream", F.xxhash64(F.least(end_of("src"), end_of("dst")), F.greatest(end_of("src"), end_of("dst"))))


# TLS.


def hello(data: bytes | None) -> dict | None:
    """The first client or server hello of a payload: side, version, suites, names; None for none."""
    if not data or len(data) < 44 or data[0] != 22 or data[5] not in (1, 2):
        return None
    try:
        side, at = data[5], 9
        version, at = struct.unpack_from(">H", data, at)[0], at + 34
        at += 1 + data[at]
        if side == 1:
            n = struct.unpack_from(">H", data, at)[0]
            suites, at = list(struct.unpack_from(f">{n // 2}H", data, at + 2)), at + 2 + n
            at += 1 + data[at]
        else:
            suites, at = [struct.unpack_from(">H", data, at)[0]], at + 3
        name = None
        if at + 2 <= len(data):
            end, at = min(len(data), at + 2 + struct.unpack_from(">H", data, at)[0]), at + 2
            while at + 4 <= end:
                kind, n = struct.unpack_from(">HH", data, at)
                body = data[at + 4 : at + 4 + n]
                if kind == 0 and len(body) > 5:
                    name = body[5:].decode("latin-1")
                if kind == 43 and side == 2 and n == 2:
                    version = struct.unpack(">H", body)[0]
                at += 4 + n
    except (struct.error, IndexError):
        return None
    return {"side": side, "version": version, "suites": suites, "sni": name}


HELLO = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("version", T.IntegerType()), T.StructField("suites", T.ArrayType(T.IntegerType())), T.StructField("sni", T.StringType())])


@F.pandas_udf(HELLO)
def _hello(x: pd.Series) -> pd.DataFrame:
    found = [hello(b) or {} for b in x]
    return pd.DataFrame({c: [f.get(c) for f in found] for c in ("side", "version", "suites", "sni")}).astype({"side": "Int32", "version": "Int32"})


def named(table: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key), other)


def weak_suite(name: Column) -> Column:
    """Words of weakness in a suite's name."""
    return F.array_join(F.filter(F.array(*map(F.lit, WEAK_TLS)), lambda w: F.contains(F.upper(name), F.upper(w))), ", ")


def rsa_exchange(name: Column) -> Column:
    """Whether a suite's keys can be had with the server's private key."""
    up = F.upper(name)
    return F.contains(up, F.lit("RSA")) & ~F.contains(up, F.lit("DHE"))


def tls_hellos(packets: DataFrame) -> DataFrame:
    """Hellos of the packets: side, version, suite that a server chose, its weakness, and the name a client asked for."""
    rows = packets.where(F.startswith(F.hex(F.substring("payload", 1, 1)), F.lit("16"))).withColumn("h", _hello("payload")).where("h.side is not null")
    suite = F.when(F.col("h.side") == 2, named(SUITES, F.get("h.suites", F.lit(0)), F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(F.get("h.suites", F.lit(0))), 4, "0")))))
    out = rows.select("frame_number", "src_ip", "dst_ip", F.when(F.col("h.side") == 1, "client").otherwise("server").alias("side"), named(TLS_VERSIONS, F.col("h.version"), F.hex("h.version")).alias("version"), "h.sni", F.size("h.suites").alias("offered"), suite.alias("suite"))
    return out.withColumns({"weak": weak_suite(F.coalesce("suite", F.lit(""))), "rsa_exchange": F.coalesce(rsa_exchange(F.col("suite")), F.lit(False))})


def key_log(texts: DataFrame, text: str) -> DataFrame:
    """Distinct key log lines that texts hold."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(KEYLOG), F.lit(0))).alias("line")).distinct()


def session_stats(packets: DataFrame, port: int, time: Column) -> DataFrame:
    """(stream, client, server, packets, seconds) of the conversations with a port."""
    rows = streams(packets).where((F.col("src_port") == port) | (F.col("dst_port") == port)).withColumn("t", time)
    first = F.min_by(F.struct("dst_port", end_of("src").alias("a"), end_of("dst").alias("b")), "frame_number")
    g = rows.groupBy("stream").agg(first.alias("f"), F.count("*").alias("packets"), (F.max_by("t", "frame_number") - F.min_by("t", "frame_number")).alias("seconds"))
    ours = F.col("f.dst_port") == port
    return g.select("stream", F.when(ours, F.col("f.a")).otherwise(F.col("f.b")).alias("client"), F.when(ours, F.col("f.b")).otherwise(F.col("f.a")).alias("server"), "packets", F.round("seconds", 2).alias("seconds"))


# Remote desktops and NTLM.


def text_of(payload: str = "payload") -> Column:
    return F.decode(F.col(payload), "ISO-8859-1")


def rdp_cookies(packets: DataFrame) -> DataFrame:
    """(frame_number, src_ip, dst_ip, username) of connection requests with a user's cookie."""
    name = F.regexp_extract(text_of(), r"mstshash=([^\r\n]+)", 1)
    return packets.where(F.col("dst_port") == 3389).select("frame_number", "src_ip", "dst_ip", F.trim(name).alias("username")).where("username <> ''")


def rdp_negotiations(packets: DataFrame) -> DataFrame:
    """(frame_number, src_ip, dst_ip, type, protocol) of negotiation parts: 01 asks, 02 answers."""
    h = F.regexp_extract(F.hex("payload"), "^0300[0-9A-F]{4}[0-9A-F]{14}(?:[0-9A-F]{2})*?(0[12])000800([0-9A-F]{8})$", 0)
    tail = F.substring(h, -16, 16)
    kind = F.substring(tail, 2, 1)
    chosen = F.conv(F.concat(F.substring(tail, 15, 2), F.substring(tail, 13, 2), F.substring(tail, 11, 2), F.substring(tail, 9, 2)), 16, 10)
    return packets.where((F.col("src_port") == 3389) | (F.col("dst_port") == 3389)).withColumn("h", h).where("h <> ''").select("frame_number", "src_ip", "dst_ip", F.when(kind == "1", "request").otherwise("response").alias("type"), named(RDP_PROTOCOLS, chosen, chosen).alias("protocol"))


def ntlm(data: bytes | None) -> dict | None:
    """The NTLM message of a payload: kind 2 with its challenge, or 3 with user, domain and responses."""
    at = (data or b"").find(b"NTLMSSP\x00")
    if at < 0:
        return None
    m = data[at:]
    try:
        kind = struct.unpack_from("<I", m, 8)[0]
        if kind == 2:
            return {"kind": 2, "challenge": m[24:32].hex()}
        if kind == 3:
            part = lambda o: m[struct.unpack_from("<I", m, o + 4)[0] :][: struct.unpack_from("<H", m, o)[0]]
            wide = "utf-16-le" if struct.unpack_from("<I", m, 60)[0] & 1 else "latin-1"
            return {"kind": 3, "lm": part(12).hex(), "nt": part(20).hex(), "domain": part(28).decode(wide, "replace"), "user": part(36).decode(wide, "replace")}
    except struct.error:
        pass
    return None


NTLM = T.StructType([T.StructField("kind", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("challenge", "lm", "nt", "domain", "user")])


@F.pandas_udf(NTLM)
def _ntlm(x: pd.Series) -> pd.DataFrame:
    found = [ntlm(b) or {} for b in x]
    return pd.DataFrame({c: [f.get(c) for f in found] for c in ("kind", "challenge", "lm", "nt", "domain", "user")}).astype({"kind": "Int32"})


def hash_line(user: Column, domain: Column, challenge: Column, nt: Column, lm: Column) -> Column:
    """(mode, line) for a cracker: version 1 by a response of 48 digits, else version 2."""
    old = F.length(nt) == 48
    head = F.concat(user, F.lit("::"), domain, F.lit(":"))
    line = F.when(old, F.concat(head, lm, F.lit(":"), nt, F.lit(":"), challenge)).otherwise(F.concat(head, challenge, F.lit(":"), F.substring(nt, 1, 32), F.lit(":"), F.substring(nt, F.lit(33), F.length(nt))))
    return F.struct(F.when(old, 5500).otherwise(5600).alias("mode"), line.alias("line"))


def ntlm_hashes(packets: DataFrame, per_stream: bool = True) -> DataFrame:
    """(frame_number, user, domain, mode, line): each answer with the challenge of its ordinal, within a stream or, as other
    tools do, over the whole capture."""
    rows = streams(packets).where(F.contains(F.hex("payload"), F.lit(b"NTLMSSP\x00".hex().upper()))).withColumn("m", _ntlm("payload"))
    by = ["stream"] if per_stream else ["capture"]
    rows = rows.withColumn("capture", F.col("path") if "path" in packets.columns else F.lit(""))
    w = Window.partitionBy(*by).orderBy("frame_number")
    asked = rows.where("m.kind = 2").select(*by, F.row_number().over(w).alias("n"), "m.challenge")
    told = rows.where("m.kind = 3 and length(m.nt) >= 48").select("frame_number", *by, F.row_number().over(w).alias("n"), "m.user", "m.domain", "m.lm", "m.nt")
    both = told.join(asked, [*by, "n"], "left").withColumn("h", hash_line(F.col("user"), F.col("domain"), F.coalesce("challenge", F.lit("")), F.col("nt"), F.col("lm")))
    return both.select("frame_number", "user", "domain", "h.mode", "h.line")


# Line protocols.


def lines(packets: DataFrame, port: int, carry: list[str] = ()) -> DataFrame:
    """(carry, stream, frame_number, pos, client, line): lines of text of the conversations with a port, in order."""
    rows = streams(packets).where(((F.col("src_port") == port) | (F.col("dst_port") == port)) & (F.octet_length("payload") > 0))
    return rows.select(*carry, "stream", "frame_number", (F.col("dst_port") == port).alias("client"), F.posexplode(F.split(F.regexp_replace(X.without_bad_utf8(F.col("payload")), r"\r?\n$", ""), r"\r?\n")).alias("pos", "line"))


def base64_line(line: Column) -> Column:
    """The text of a base64 line with or without the mark of its side; null for what is none."""
    clean = F.trim(F.regexp_replace(line, r"^[CS]:\s*", ""))
    return X.without_bad_utf8(F.try_to_binary(F.concat(clean, F.repeat(F.lit("="), F.pmod(-F.length(clean), F.lit(4)))), F.lit("base64")))


def clean_line(line: Column) -> Column:
    return F.trim(F.translate(F.replace(line, F.lit("\\xd\\xa"), F.lit("")), "\r\n", ""))


def smtp_mails(rows: DataFrame) -> DataFrame:
    """(stream, mail, sender, receiver, subject, lines, body): mails of a table of lines (see lines()), from DATA to the dot."""
    w = Window.partitionBy("stream").orderBy("frame_number", "pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    line, up = F.col("line"), F.upper(F.trim("line"))
    rows = rows.where("line <> ''").withColumns({"data": up == "DATA", "dot": F.trim("line") == "."})
    rows = rows.withColumns({"begun": F.coalesce(F.sum(F.col("data").cast("int")).over(before), F.lit(0)), "mark": F.last(F.when(F.col("data"), 1).when(F.col("dot"), 0), ignorenulls=True).over(before)})
    address = lambda word: F.last(F.when(F.coalesce("mark", F.lit(0)) == 0, F.nullif(F.regexp_extract(line, rf"(?i)^{word}:\s*<?([^<>\s]*)", 1), F.lit(""))), ignorenulls=True).over(w)
    rows = rows.withColumns({"sender": address("MAIL FROM"), "receiver": address("RCPT TO")})
    inside = rows.where("mark = 1")
    body = inside.where("not dot").groupBy("stream", F.col("begun").alias("mail")).agg(F.array_sort(F.collect_list(F.struct("frame_number", "pos", "line"))).alias("b"))
    done = inside.where("dot").select("stream", F.col("begun").alias("mail"), F.coalesce("sender", F.lit("Unknown")).alias("sender"), F.coalesce("receiver", F.lit("Unknown")).alias("receiver"))
    text = F.transform("b", lambda x: x["line"])
    subject = F.get(F.filter(text, lambda x: F.startswith(F.upper(x), F.lit("SUBJECT:"))), F.lit(0))
    out = done.join(body, ["stream", "mail"], "left").withColumn("text", F.coalesce(text, F.array().cast("array<string>")))
    return out.select("stream", "mail", "sender", "receiver", F.coalesce(F.trim(F.substring(subject, 9, 1000)), F.lit("NoSubject")).alias("subject"), F.size("text").alias("lines"), F.array_join("text", "\n").alias("body"))


def smtp_logins(rows: DataFrame) -> DataFrame:
    """(stream, frame_number, username, password): the two client lines after AUTH LOGIN, decoded."""
    w = Window.partitionBy("stream").orderBy("frame_number", "pos")
    client = rows.where("client")
    ahead = lambda n: base64_line(F.lead("line", n).over(w))
    return client.withColumns({"username": ahead(1), "password": ahead(2)}).where(F.contains(F.upper("line"), F.lit("AUTH LOGIN"))).select("stream", "frame_number", "username", "password")


def ftp_commands(rows: DataFrame) -> DataFrame:
    """(stream, frame_number, command, argument, username): client commands with the last user before or at them."""
    w = Window.partitionBy("stream").orderBy("frame_number", "pos").rowsBetween(Window.unboundedPreceding, 0)
    split = F.split("line", " ", 2)
    c = rows.where("client").withColumns({"command": F.upper(split[0]), "argument": F.coalesce(F.get(split, F.lit(1)), F.lit(""))})
    user = F.last(F.when(F.col("command") == "USER", F.col("argument")), ignorenulls=True).over(w)
    return c.select("stream", "frame_number", "command", "argument", F.coalesce(user, F.lit("unknown")).alias("username"))


def ftp_files(packets: DataFrame) -> DataFrame:
    """(filename, bytes, content): the data connections on port 20 or opened after RETR or STOR, named by the last of these."""
    packets = packets if "path" in packets.columns else packets.withColumn("path", F.lit(""))
    control = lines(packets, 21, ["path"]).where("client").select("path", "frame_number", F.regexp_extract("line", r"(?i)^(?:RETR|STOR) (.+)$", 1).alias("name")).where("name <> ''").select("path", "frame_number", "name", F.lit(None).cast("long").alias("stream"), F.lit(None).cast("binary").alias("payload"))
    data = streams(packets).where(((F.col("src_port") == 20) | (F.col("dst_port") == 20)) & (F.octet_length("payload") > 0)).select("path", "frame_number", F.lit(None).cast("string").alias("name"), "stream", "payload")
    w = Window.partitionBy("path").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    starts = control.unionByName(data.groupBy("path", "stream").agg(F.min("frame_number").alias("frame_number")).select("path", "frame_number", F.lit(None).cast("string").alias("name"), "stream", F.lit(None).cast("binary").alias("payload")))
    by = starts.withColumn("filename", F.coalesce(F.last("name", ignorenulls=True).over(w), F.lit("other_file"))).where("stream is not null").select("path", "stream", "filename")
    parts = F.array_sort(F.collect_list(F.struct("frame_number", F.hex("payload").alias("h"))))
    return data.groupBy("path", "stream").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("content")).join(by, ["path", "stream"]).select("filename", F.octet_length("content").alias("bytes"), "content")


def redis_class(words: Column) -> Column:
    """(class, key, value) rows of a client command given as words."""
    up = F.upper(words[0])
    at = lambda i: F.get(words, F.lit(i))
    row = lambda kind, k, v: F.array(F.struct(F.lit(kind).alias("class"), k.cast("string").alias("key"), v.cast("string").alias("value")))
    n, none = F.size(words), F.lit(None)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((n - 1) / 2).cast("int"))), lambda i: F.struct(F.lit("set").alias("class"), F.get(words, i * 2 - 1).alias("key"), F.get(words, i * 2).alias("value")))
    empty = F.array().cast("array<struct<class:string,key:string,value:string>>")
    rest = F.array_join(F.slice(words, F.lit(3), F.greatest(F.lit(0), n - 2)), " ")
    out = F.when((up == "AUTH") & (n == 2), row("credential", none, at(1))).when((up == "AUTH") & (n >= 3), row("credential", at(1), at(2)))
    out = out.when((up == "MSET") & (n >= 3), pairs).when((up == "SETEX") & (n >= 4), row("set", at(1), at(3))).when((up == "HSET") & (n >= 4), row("set", F.concat(at(1), F.lit("->"), at(2)), at(3)))
    out = out.when(up.isin(REDIS_SET) & (n >= 3), row("set", at(1), at(2))).when(up.isin(REDIS_GET), row("get", F.array_join(F.slice(words, F.lit(2), F.greatest(F.lit(0), n - 1)), " "), none))
    out = out.when(up == "CONFIG", row("config", at(1), F.array_join(words, " "))).when(up == "EVAL", row("eval", none, at(1))).when(up.isin(REDIS_WRITE) & (n >= 3), row("set", at(1), rest))
    return F.coalesce(out, empty)


# Media.

RTP = T.StructType([T.StructField(c, T.LongType()) for c in ("version", "pt", "seq", "stamp", "ssrc", "header")])


@F.pandas_udf(RTP)
def _rtp(x: pd.Series) -> pd.DataFrame:
    rows = []
    for b in x:
        if b is None or len(b) < 12 or b[0] >> 6 != 2:
            rows.append((None,) * 6)
            continue
        head = 12 + 4 * (b[0] & 15)
        if b[0] & 16 and len(b) >= head + 4:
            head += 4 + 4 * struct.unpack_from(">H", b, head + 2)[0]
        rows.append((2, b[1] & 127, *struct.unpack_from(">HII", b, 2), head))
    return pd.DataFrame(rows, columns=[f.name for f in RTP], dtype="Int64")


def rtp_packets(packets: DataFrame) -> DataFrame:
    """UDP packets that are RTP, with pt, seq, stamp, ssrc (normal form) and the media bytes."""
    rows = packets.where("protocol = 'UDP'").withColumn("r", _rtp("payload")).where("r.version = 2")
    return rows.select("frame_number", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "r.pt", "r.seq", "r.stamp", F.concat(F.lit("0x"), F.lower(F.hex("r.ssrc"))).alias("ssrc"), F.substring("payload", (F.col("r.header") + 1).cast("int"), F.octet_length("payload")).alias("media"))


def rtp_statistics(rows: DataFrame, clock: Column | None = None, digits: int = 3, wrap: int | None = 65536) -> DataFrame:
    """(ssrc, pt, packets, lost, jitter, duration) by stream: lost from gaps in sequence, jitter in ms as RFC 3550 smooths it,
    rounded once, to these digits. Sequence numbers start over at wrap; None where they never do.

    The smoothing is a fold over a stream's differences in order, so each stream's differences are gathered once."""
    rate = F.coalesce(clock, F.lit(8000)) if clock is not None else named({k: v[2] for k, v in RTP_TYPES.items()}, F.col("pt").cast("int"), F.lit(8000))
    w = Window.partitionBy("ssrc").orderBy("frame_number")
    at = F.unix_micros("ts") / 1e6
    d = F.abs((at - F.lag(at).over(w)) - (F.col("stamp") - F.lag("stamp").over(w)) / rate)
    step = F.col("seq") - F.lag("seq").over(w)
    r = rows.withColumns({"d": d, "gap": (F.pmod(step, F.lit(wrap)) if wrap else step) - 1})
    fold = lambda a, x: F.struct((a["j"] + (x["d"] - a["j"]) / 16).alias("j"), F.greatest(a["top"], a["j"] + (x["d"] - a["j"]) / 16).alias("top"))
    diffs = F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("frame_number", "d"))))
    g = r.groupBy("ssrc").agg(F.min_by("pt", "frame_number").alias("pt"), F.count("*").alias("packets"), F.sum(F.when(F.col("gap").between(1, 32767), F.col("gap")).otherwise(0)).alias("lost"), diffs.alias("diffs"))
    medium = named({k: v[1] for k, v in RTP_TYPES.items()}, F.col("pt").cast("int"), F.lit("audio"))
    top = F.aggregate("diffs", F.struct(F.lit(0.0).alias("j"), F.lit(0.0).alias("top")), fold, lambda a: a["top"])
    return g.select("ssrc", "pt", "packets", "lost", X.rounded(top * 1000, digits).alias("jitter"), F.round(F.when(medium == "video", F.col("packets") / 30).otherwise(F.col("packets") * 0.02), 1).alias("duration"))


def sdp_codecs(texts: DataFrame, text: str, order: str) -> DataFrame:
    """(pt, codec, medium, clock) of session descriptions; the last line, in an order of texts, of a payload type from 96 on
    counts."""
    m = F.regexp_extract_all(F.col(text), F.lit(r"rtpmap:(\d+)\s+([^/\s]+)(?:/(\d+))?"), F.lit(0))
    rows = texts.select(F.col(order).alias("row"), F.posexplode(m).alias("pos", "m"))
    part = lambda i: F.regexp_extract("m", r"rtpmap:(\d+)\s+([^/\s]+)(?:/(\d+))?", i)
    rows = rows.select("row", "pos", part(1).cast("int").alias("pt"), F.upper(part(2)).alias("codec"), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(8000)).alias("clock")).where("pt >= 96")
    g = rows.groupBy("pt").agg(F.max_by(F.struct("codec", "clock"), F.struct("row", "pos")).alias("x"))
    return g.select("pt", "x.codec", F.when(F.col("x.codec").isin(VIDEO), "video").otherwise("audio").alias("medium"), "x.clock")


def codecs(rows: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """rows with codec, medium and clock by payload type: session descriptions for types from 96 on, the fixed table below."""
    fixed = rows.sparkSession.createDataFrame([(k, *v) for k, v in RTP_TYPES.items()], "pt int, codec string, medium string, clock int")
    table = fixed if told is None else fixed.unionByName(told.select("pt", "codec", "medium", "clock"))
    return rows.join(table.withColumnRenamed("pt", "_pt"), F.col("pt") == F.col("_pt"), "left").drop("_pt")


# Hidden text.


def gb2312(buffer: str | None) -> tuple[str, str] | None:
    """(text, way) of a buffer: hexadecimal of base64 of GB2312, else base64 of GB2312, whichever reads."""
    import base64

    def reads(t: str | None) -> bool:
        return bool(t) and len(t.strip()) >= 2 and sum(c.isprintable() or c in "\r\n\t" for c in t) / len(t) > 0.5

    def tried(make):
        try:
            return make()
        except ValueError:
            return None

    t = buffer or ""
    one = tried(lambda: base64.b64decode(bytes.fromhex(t[: len(t) // 2 * 2])).decode("gb2312", "ignore"))
    if reads(one):
        return one, "hex"
    plain = t.replace("-", "+").replace("_", "/")
    two = tried(lambda: base64.b64decode(plain + "=" * (-len(plain) % 4)).decode("gb2312", "ignore"))
    return (two, "base64") if reads(two) else None


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("way", T.StringType())]))
def decoded_buffer(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([gb2312(v) or (None, None) for v in x], columns=["text", "way"])


def covert_buffers(rows: DataFrame, stream: str, order: str, label: Column, trigger: Column) -> DataFrame:
    """(stream, segment, buffer): labels of more than four characters joined in order, a trigger ending each segment."""
    w = Window.partitionBy(stream).orderBy(order)
    seg = F.coalesce(F.sum(trigger.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = rows.withColumns({"segment": seg, "_label": F.when((F.length(label) > 4) & ~trigger, label)})
    parts = F.array_sort(F.collect_list(F.when(F.col("_label").isNotNull(), F.struct(order, "_label"))))
    return s.groupBy(stream, "segment").agg(F.array_join(F.transform(parts, lambda x: x["_label"]), "").alias("buffer")).where("buffer <> ''")


def beacon_cookies(packets: DataFrame) -> DataFrame:
    """Distinct cookies of more than 30 characters, first seen first, and whether they decode to 48 bytes or more."""
    cookie = F.regexp_extract(text_of(), r"(?i)\r\ncookie:\s*([^\r\n]+)", 1)
    rows = packets.where("http_method is not null").select("frame_number", cookie.alias("cookie")).where("length(cookie) > 30")
    g = rows.groupBy("cookie").agg(F.min("frame_number").alias("frame_number"))
    return g.select("cookie", "frame_number", F.coalesce(F.octet_length(F.try_to_binary("cookie", F.lit("base64"))) >= 48, F.lit(False)).alias("beacon"))


def beacon_sessions(packets: DataFrame, pem: str) -> DataFrame:
    """(cookie, frame_number, fields of the metadata) of the beacon cookies that a private key opens."""
    from ..functions.crypto import beacon_metadata
    from ..functions.rsa import decrypt

    rows = beacon_cookies(packets).withColumn("data", decrypt(pem)(F.try_to_binary("cookie", F.lit("base64"))))
    return rows.withColumn("m", beacon_metadata(F.col("data"))).where("m is not null").select("cookie", "frame_number", "m.*")


def values_text(values: Column) -> Column:
    """What a sequence of numbers spells: bits of 0 and 1 or of two values as bytes if that reads, else as digits; else characters."""
    bits = F.array_sort(F.array_distinct(values))
    two = (F.size(values) >= 8) & (F.size(bits) == 2)
    plain = (F.size(values) >= 8) & F.forall(values, lambda v: v.isin(0, 1))
    digits = F.array_join(F.transform(values, lambda v: F.when(plain, v.cast("string")).when(v == bits[0], "0").otherwise("1")), "")
    size = F.floor(F.length(digits) / 8).cast("int")
    numbers = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), size) - 1), lambda i: F.conv(F.substring(digits, i * 8 + 1, F.lit(8)), 2, 10).cast("int"))
    char = lambda v: F.when(v.between(32, 126), F.char(v)).otherwise(F.lit("."))
    spelt = F.array_join(F.transform(F.filter(numbers, lambda v: v != 0), char), "")
    reads = (size > 0) & (F.length(spelt) > 0) & (X.shown(spelt, r"[\x20-\x7E]") >= 0.7)
    return F.when(plain | two, F.when(reads, spelt).otherwise(digits)).otherwise(F.array_join(F.transform(values, char), ""))


def flag_like(text: Column) -> Column:
    """Whether a text holds one of the words that mark a flag."""
    from ..rules.webshell import FLAG_WORDS

    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, FLAG_WORDS)), lambda w: F.contains(low, w))


# Names.


def dns_name(data: bytes | None) -> tuple[str, int, bool] | None:
    """(name, type, whether it is an answer) of a DNS message's first question."""
    if not data or len(data) < 17 or not struct.unpack_from(">H", data, 4)[0]:
        return None
    labels, at = [], 12
    while at < len(data) and data[at]:
        n = data[at]
        if n > 63 or at + 1 + n > len(data):
            return None
        labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
        at += 1 + n
    if at + 3 > len(data):
        return None
    return ".".join(labels), struct.unpack_from(">H", data, at + 1)[0], bool(data[2] & 128)


DNS = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.IntegerType()), T.StructField("answer", T.BooleanType())])


@F.pandas_udf(DNS)
def _dns(x: pd.Series) -> pd.DataFrame:
    rows = [dns_name(b) or (None, None, None) for b in x]
    return pd.DataFrame(rows, columns=["name", "type", "answer"]).astype({"type": "Int32", "answer": "boolean"})


def dns_queries(packets: DataFrame) -> DataFrame:
    """(frame_number, stream, src_ip, name, type): questions asked, each name of a stream once, the first time."""
    rows = streams(packets.where("dst_port = 53")).withColumn("q", _dns("payload")).where("not q.answer and q.name <> ''")
    g = rows.groupBy("stream", F.lower("q.name").alias("name")).agg(F.min(F.struct("frame_number", "src_ip", F.col("q.type").alias("type"))).alias("f"))
    return g.select("f.frame_number", "stream", "f.src_ip", "name", "f.type")


def dns_hidden(queries: DataFrame, trigger: str | None = None) -> DataFrame:
    """(src_ip, segment, text, way): first labels of more than four characters that are hexadecimal or base64, joined by host in
    order, a trigger domain ending each buffer, and what they spell."""
    label = F.split("name", r"\.")[0]
    flush = F.endswith("name", F.lit(trigger)) if trigger else F.lit(False)
    coded = F.when(label.rlike("^[0-9A-Fa-f]+$") | label.rlike("^[A-Za-z0-9_-]+$"), label).otherwise("")
    buffers = covert_buffers(queries, "src_ip", "frame_number", coded, flush)
    return buffers.withColumn("d", decoded_buffer("buffer")).where("d.text is not null").select("src_ip", "segment", "d.text", "d.way")


# Files of shares.


def smb2_messages(data: bytes | None) -> list[tuple]:
    """(command, answer, message, file, name, place, content) of the create, read and write messages of one side's bytes."""
    out, at = [], 0
    data = data or b""
    while at + 4 <= len(data):
        size = int.from_bytes(data[at + 1 : at + 4], "big")
        m, at = data[at + 4 : at + 4 + size], at + 4 + size
        try:
            if m[:4] != b"\xfeSMB":
                continue
            command, answer, number = struct.unpack_from("<H", m, 12)[0], bool(m[16] & 1), struct.unpack_from("<Q", m, 24)[0]
            body = m[64:]
            if command == 5 and not answer:
                o, n = struct.unpack_from("<HH", body, 44)
                out.append((5, False, number, None, m[o : o + n].decode("utf-16-le", "replace"), None, None))
            elif command == 5:
                out.append((5, True, number, body[64:80].hex(), None, None, None))
            elif command == 8 and not answer:
                out.append((8, False, number, body[16:32].hex(), None, struct.unpack_from("<Q", body, 8)[0], None))
            elif command == 8:
                o, n = body[2], struct.unpack_from("<I", body, 4)[0]
                out.append((8, True, number, None, None, None, m[o : o + n]))
            elif command == 9 and not answer:
                o, n = struct.unpack_from("<HI", body, 2)
                out.append((9, False, number, body[16:32].hex(), None, struct.unpack_from("<Q", body, 8)[0], m[o : o + n]))
        except (struct.error, IndexError):
            continue
    return out


SMB2 = "array<struct<command:int,answer:boolean,message:long,file:string,name:string,place:long,content:binary>>"


def smb_files(packets: DataFrame) -> DataFrame:
    """(filename, bytes, content): files read from or written to shares, put together by place.

    Each side's bytes of a stream are joined in order, so that messages over several segments are whole; requests meet their
    answers by message, reads and writes their names by file."""
    sides = streams(packets.where("src_port = 445 or dst_port = 445")).where(F.octet_length("payload") > 0).withColumn("side", end_of("src"))
    parts = F.array_sort(F.collect_list(F.struct("frame_number", F.hex("payload").alias("h"))))

    @F.udf(SMB2)
    def cut(data):
        return [(*m[:6], bytearray(m[6]) if m[6] is not None else None) for m in smb2_messages(bytes(data))]

    joined = sides.groupBy("stream", "side").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("raw"))
    m = joined.select("stream", F.explode(cut("raw")).alias("m")).select("stream", "m.*")
    pick = lambda cond, *cols: m.where(cond).select("stream", "message", *cols)
    made = pick("command = 5 and answer", "file").join(pick("command = 5 and not answer", "name"), ["stream", "message"]).select("stream", "file", "name").distinct()
    read = pick("command = 8 and answer", "content").join(pick("command = 8 and not answer", "file", "place"), ["stream", "message"]).select("stream", "file", "place", "content")
    pieces = read.unionByName(m.where("command = 9 and not answer").select("stream", "file", "place", "content"))
    named = pieces.dropDuplicates(["stream", "file", "place"]).join(made, ["stream", "file"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("place", F.hex("content").alias("h"))))
    g = named.groupBy("stream", "file", F.coalesce("name", F.lit("unknown")).alias("filename")).agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("content"))
    return g.select("filename", F.octet_length("content").alias("bytes"), "content")


# Industrial files.


def mms_files(packets: DataFrame) -> DataFrame:
    """(name, content): files read by open (72) and read (73) exchanges; packets: frame_number, kind (request, response),
    service, invoke_id, frsm_id, name, data.

    An answer belongs to the last request of its invocation before it, a read to the last open of its handle: carries over
    windows, so that numbers may be used again."""
    by = lambda *k: Window.partitionBy(*k).orderBy("frame_number")
    asks = F.col("kind") == "request"
    w = by("service", "invoke_id")
    p = packets.withColumns({"asked_name": F.last(F.when(asks, F.col("name")), ignorenulls=True).over(w), "asked_frsm": F.last(F.when(asks, F.col("frsm_id")), ignorenulls=True).over(w)})
    handle = F.when((F.col("service") == 72) & ~asks, F.col("frsm_id")).when((F.col("service") == 73) & ~asks, F.col("asked_frsm"))
    p = p.withColumn("handle", handle).where("handle is not null")
    p = p.withColumn("file", F.last(F.when(F.col("service") == 72, F.col("asked_name")), ignorenulls=True).over(by("handle")))
    parts = F.array_sort(F.collect_list(F.struct("frame_number", F.hex("data").alias("h"))))
    return p.where("service = 73 and file is not null").groupBy("file").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("content")).select(F.col("file").alias("name"), "content")
