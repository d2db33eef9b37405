"""The registry of protocol analyzers: functions from packets to findings that share one scan.

A finding is (protocol, title, description, confidence, is_flag, frame_number). Analyzers are registered by protocol and run
over the packets of that protocol alone; results of protocols without packets are empty, not missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.webshell import FLAG_WORDS
from . import protocols as P

FINDING = "protocol string, title string, description string, confidence double, is_flag boolean, frame_number long"
#: What marks a flag in any text: one of the fixed words.
FLAG = "(?i)(" + "|".join(re.escape(w) for w in FLAG_WORDS) + ")"
ANALYZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def analyzer(protocol: str):
    """Register a function from packets (see sources.pcap.SCHEMA) to findings."""

    def put(f):
        ANALYZERS[protocol] = f
        return f

    return put


def finding(protocol: str, title: str, description: Column, confidence: float, flag: Column, frame: Column) -> list[Column]:
    return [F.lit(protocol).alias("protocol"), F.lit(title).alias("title"), description.alias("description"), F.lit(confidence).alias("confidence"), flag.alias("is_flag"), frame.alias("frame_number")]


def joined(order: str, value: Column) -> Column:
    """Bytes of a group in order, as hexadecimal text made bytes again."""
    return F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.hex(value).alias("h")))), lambda x: x["h"]), ""))


@analyzer("ICMP")
def icmp(packets: DataFrame) -> DataFrame:
    """Payloads of echo requests joined per pair of hosts, where mostly printable; the flag in them decides confidence."""
    body = packets.where("icmp_type = 8").groupBy("src_ip", "dst_ip").agg(joined("frame_number", F.col("payload")).alias("b"), F.min("frame_number").alias("f"))
    text = F.decode("b", "ISO-8859-1")
    shown = F.length(F.regexp_replace(text, r"[^\x20-\x7E\t\n\r]", "")) / F.greatest(F.lit(1), F.length(text))
    whole = body.where(shown > 0.7).select(*finding("ICMP", "data in echo requests", text, 0.7, text.rlike(FLAG), F.col("f")))
    return reduce(DataFrame.unionByName, [whole, *(sequence(packets, *s) for s in SEQUENCES)])


#: What echo requests may hide text in: title, value of a packet, confidence with a flag and without.
SEQUENCES = [("lengths", "octet_length(payload)", 0.7, 0.5), ("times to live", "ttl", 0.8, 0.6), ("sequence numbers", "icmp_seq & 255", 0.8, 0.6)]


def sequence(packets: DataFrame, title: str, value: str, sure: float, other: float) -> DataFrame:
    """What the ordered values of a pair's echo requests spell, where they vary and spell a flag or many values."""
    rows = packets.where("icmp_type = 8").withColumn("v", F.expr(value).cast("int")).where("v is not null")
    parts = F.array_sort(F.collect_list(F.struct("frame_number", "v")))
    g = rows.groupBy("src_ip", "dst_ip").agg(F.transform(parts, lambda x: x["v"]).alias("v"), F.min("frame_number").alias("f"))
    g = g.withColumns({"n": F.size(F.array_distinct("v")), "t": P.values_text(F.col("v"))}).where("n > 1")
    g = g.withColumn("flag", P.flag_like(F.col("t"))).where(F.col("flag") | (F.col("n") > 0.3 * F.size("v")))
    return g.select(F.lit("ICMP").alias("protocol"), F.lit(title).alias("title"), F.col("t").alias("description"), F.when(F.col("flag"), sure).otherwise(other).alias("confidence"), F.col("flag").alias("is_flag"), F.col("f").alias("frame_number"))


@analyzer("HTTP")
def http(packets: DataFrame) -> DataFrame:
    """Requests whose text scores 40 or more."""
    from .scoring import attack_scores

    text = packets.where("http_method is not null").withColumn("t", F.decode("payload", "ISO-8859-1"))
    s = attack_scores(text, "t", method=F.col("http_method"), uri=F.col("http_uri")).where("total_weight >= 40")
    return s.select(*finding("HTTP", "attack", F.concat_ws(" ", "attack_type", "threat_level", "http_uri"), 0.8, F.col("t").rlike(FLAG), F.col("frame_number")))


@analyzer("TCP")
def ssh_attempts(packets: DataFrame) -> DataFrame:
    """Sources with ten or more opening segments to port 22."""
    syn = packets.where("dst_port = 22 and (tcp_flags & 18) = 2")
    at = F.unix_micros("ts") / 1e6
    g = syn.groupBy("src_ip").agg(F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("span"), F.min("frame_number").alias("f")).where("n >= 10")
    rate = F.round(F.when(F.col("span") > 0, F.col("n") / F.col("span")).otherwise(F.col("n")), 3)
    return g.select(*finding("SSH", "brute force", F.concat_ws(" ", "src_ip", F.col("n").cast("string"), rate.cast("string")), 0.8, F.lit(False), F.col("f")))


@analyzer("DNS")
def dns(packets: DataFrame) -> DataFrame:
    """The ten hosts that send most queries, first seen first on ties."""
    g = packets.where("dst_port = 53").groupBy("src_ip").agg(F.count("*").alias("n"), F.min("frame_number").alias("f")).orderBy(F.desc("n"), "f").limit(10)
    out = g.select(*finding("DNS", "queries", F.concat_ws(" ", "src_ip", F.col("n").cast("string")), 0.5, F.lit(False), F.col("f")))
    hidden = P.dns_hidden(P.dns_queries(packets))
    return out.unionByName(hidden.select(*finding("DNS", "hidden text", F.col("text"), 0.8, F.col("text").rlike(FLAG), F.lit(0).cast("long"))))


@analyzer("FTP")
def ftp(packets: DataFrame) -> DataFrame:
    """Logins with their user, and files of data connections."""
    c = P.ftp_commands(P.lines(packets, 21)).where("command = 'PASS'")
    login = F.concat("username", F.lit(":"), "argument")
    f = P.ftp_files(packets)
    text = F.concat("filename", F.lit(" "), F.col("bytes").cast("string"))
    return c.select(*finding("FTP", "login", login, 0.9, login.rlike(FLAG), F.col("frame_number"))).unionByName(f.select(*finding("FTP", "file", text, 0.8, F.decode("content", "ISO-8859-1").rlike(FLAG), F.lit(0).cast("long"))))


@analyzer("SMTP")
def smtp(packets: DataFrame) -> DataFrame:
    """Logins and mails."""
    rows = P.lines(packets, 25)
    logins = P.smtp_logins(rows).select(*finding("SMTP", "login", F.concat("username", F.lit(":"), F.coalesce("password", F.lit("???"))), 0.95, F.lit(False), F.col("frame_number")))
    mails = P.smtp_mails(rows)
    flag = F.concat("subject", F.lit("\n"), "body").rlike(FLAG)
    text = F.concat_ws(" ", "sender", F.lit(">"), "receiver", "subject")
    return logins.unionByName(mails.select(*finding("SMTP", "mail", text, 0.7, flag, F.lit(0).cast("long"))))


@analyzer("CS")
def beacon(packets: DataFrame) -> DataFrame:
    """Cookies that may hold a beacon's metadata."""
    c = P.beacon_cookies(packets)
    return c.where("beacon").select(*finding("CS", "metadata cookie", F.substring("cookie", 1, 200), 0.6, F.lit(False), F.col("frame_number")))


@analyzer("TLS")
def tls(packets: DataFrame) -> DataFrame:
    """Names asked for, weak suites chosen, suites that the private key opens."""
    h = P.tls_hellos(packets)
    names = h.where("sni is not null").groupBy("sni").agg(F.min("frame_number").alias("f"))
    weak = h.where("weak <> ''")
    rsa = h.where("rsa_exchange")
    out = names.select(*finding("TLS", "server name", F.col("sni"), 0.5, F.col("sni").rlike(FLAG), F.col("f")))
    out = out.unionByName(weak.select(*finding("TLS", "weak suite", F.concat_ws(" ", "suite", "weak"), 0.8, F.lit(False), F.col("frame_number"))))
    return out.unionByName(rsa.select(*finding("TLS", "RSA key exchange", F.col("suite"), 0.6, F.lit(False), F.col("frame_number"))))


@analyzer("RDP")
def rdp(packets: DataFrame) -> DataFrame:
    """Users of cookies, conversations, hashes."""
    c = P.rdp_cookies(packets).groupBy("username").agg(F.min("frame_number").alias("f"))
    s = P.session_stats(packets, 3389, F.unix_micros("ts") / 1e6)
    h = P.ntlm_hashes(packets.where("src_port = 3389 or dst_port = 3389"))
    out = c.select(*finding("RDP", "user", F.col("username"), 0.8, F.col("username").rlike(FLAG), F.col("f")))
    out = out.unionByName(s.select(*finding("RDP", "session", F.concat_ws(" ", "client", "server", F.col("packets").cast("string"), F.col("seconds").cast("string")), 0.5, F.lit(False), F.lit(0).cast("long"))))
    return out.unionByName(h.select(*finding("RDP", "hash", F.col("line"), 0.9, F.lit(False), F.col("frame_number"))))


@analyzer("Redis")
def redis(packets: DataFrame) -> DataFrame:
    """What clients' commands tell."""
    from ..plans.sessions import resp_udtf_rows

    rows = packets.where("dst_port = 6379").select("frame_number", "payload")
    c = resp_udtf_rows(rows, "frame_number", "payload").select("frame_number", F.explode(P.redis_class(F.col("words"))).alias("x"))
    text = F.concat_ws(" ", "x.key", "x.value")
    sure = F.when(F.col("x.class").isin("config", "eval", "credential"), 0.9).otherwise(0.5)
    return c.select(F.lit("Redis").alias("protocol"), F.col("x.class").alias("title"), text.alias("description"), sure.alias("confidence"), text.rlike(FLAG).alias("is_flag"), "frame_number")


@analyzer("SMB")
def smb(packets: DataFrame) -> DataFrame:
    """Hashes of logins."""
    h = P.ntlm_hashes(packets.where("src_port in (139, 445) or dst_port in (139, 445)"))
    f = P.smb_files(packets)
    text = F.concat_ws(" ", "filename", F.col("bytes").cast("string"))
    out = h.select(*finding("SMB", "hash", F.col("line"), 0.9, F.lit(False), F.col("frame_number")))
    return out.unionByName(f.select(*finding("SMB", "file", text, 0.8, F.decode("content", "ISO-8859-1").rlike(FLAG), F.lit(0).cast("long"))))


@analyzer("SSH")
def ssh(packets: DataFrame) -> DataFrame:
    """Banners, weak algorithms on offer, conversations."""
    from ..plans.sessions import WEAK_SSH

    text = P.text_of()
    rows = packets.where("src_port = 22 or dst_port = 22").withColumn("t", text)
    banners = rows.where(F.startswith("t", F.lit("SSH-"))).select("frame_number", F.regexp_extract("t", r"^(SSH-[^\r\n]+)", 1).alias("b"))
    weak = F.filter(F.array(*map(F.lit, WEAK_SSH)), lambda w: F.contains(F.col("t"), w))
    offers = rows.where(F.contains("t", F.lit("diffie-hellman")) | F.contains("t", F.lit("-cbc")) | F.contains("t", F.lit("arcfour"))).select("frame_number", F.array_join(weak, ", ").alias("w")).where("w <> ''")
    s = P.session_stats(packets, 22, F.unix_micros("ts") / 1e6)
    out = banners.select(*finding("SSH", "banner", F.col("b"), 0.5, F.lit(False), F.col("frame_number")))
    out = out.unionByName(offers.select(*finding("SSH", "weak algorithms", F.col("w"), 0.7, F.lit(False), F.col("frame_number"))))
    return out.unionByName(s.select(*finding("SSH", "session", F.concat_ws(" ", "client", "server", F.col("packets").cast("string")), 0.4, F.lit(False), F.lit(0).cast("long"))))


@analyzer("RTP")
def rtp(packets: DataFrame) -> DataFrame:
    """Media streams with what was lost."""
    s = P.codecs(P.rtp_statistics(P.rtp_packets(packets)).withColumn("pt", F.col("pt").cast("int"))).where("packets >= 10")
    text = F.concat_ws(" ", "ssrc", F.coalesce("codec", F.lit("dynamic")), F.col("packets").cast("string"), F.col("lost").cast("string"))
    return s.select(*finding("RTP", "stream", text, 0.6, F.lit(False), F.lit(0).cast("long")))


def analyze(packets: DataFrame, protocols: list[str] | None = None) -> DataFrame:
    """Findings of the analyzers over one scan of the packets; the caller keeps the packets where that pays."""
    chosen = protocols or list(ANALYZERS)
    return reduce(DataFrame.unionByName, [ANALYZERS[p](packets) for p in chosen])


def counts(packets: DataFrame) -> DataFrame:
    """Packets by protocol: analyzers of protocols without any find nothing."""
    return packets.groupBy("protocol").agg(F.count("*").alias("packets"))


def analyze_protocol(spark, path: str, protocol: str) -> DataFrame:
    """Findings of one protocol's analyzer in the captures under a path."""
    from ..sources.pcap import read_pcap

    return ANALYZERS[protocol](read_pcap(spark, path))
