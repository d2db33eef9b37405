"""Reports: typed results, texts of requests, shaping, JSON and HTML, and the analysis of a capture from end to end."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import scoring as S

#: Fields of a request's headers in the order they are written, and fields that are no header lines.
HEADERS = {"Host": "host", "User-Agent": "user_agent", "Accept": "accept", "Accept-Encoding": "accept_encoding", "Accept-Language": "accept_language", "Connection": "connection", "Content-Type": "content_type", "Content-Length": "content_length", "Sec-Fetch-Site": "sec_fetch_site", "Sec-Fetch-Mode": "sec_fetch_mode", "Sec-Fetch-Dest": "sec_fetch_dest", "Priority": "priority", "Referer": "referer", "Cookie": "cookie", "Authorization": "authorization"}
NO_HEADERS = ["response_code", "response_phrase", "file_data", "response_for_uri", "request_method", "request_uri", "chat", "response_line", "request_line"]
#: How many rows each part of a summary shows.
LIMITS = {"webshell": 20, "attack": 20, "protocol": 10}


def is_binary(text: Column) -> Column:
    """Whether over three tenths of the first thousand characters are control characters."""
    return X.bind(F.substring(text, 1, 1000), lambda t: X.ratio(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]") > 0.3)


def hex_lines(data: Column, most: int = 4096) -> Column:
    """A dump of bytes: place, sixteen bytes in two halves, characters."""
    digits = F.lower(F.hex(F.substring(data, 1, most)))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(digits) / 32).cast("int") - 1)), lambda i: F.struct(i.alias("i"), F.substring(digits, i * 32 + 1, F.lit(32)).alias("h")))
    half = lambda h, at: F.rpad(F.trim(F.regexp_replace(F.substring(h, at, 16), "(..)", "$1 ")), 23, " ")
    chars = lambda h: F.regexp_replace(F.decode(F.unhex(h), "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    lines = F.transform(rows, lambda r: F.concat(F.lpad(F.lower(F.hex((r["i"] * 16).cast("bigint"))), 4, "0"), F.lit("   "), half(r["h"], 1), F.lit("  "), half(r["h"], 17), F.lit("  |"), chars(r["h"]), F.lit("|")))
    return F.when(F.length(digits) > 0, F.array_join(lines, "\n")).otherwise("")


def shown_text(text: Column, most: int = 50_000) -> Column:
    """What is shown of a text: a dump of binary ones, the beginning of long ones."""
    cut = F.concat(F.substring(text, 1, most), F.lit("\n... (cut)"))
    return F.when(is_binary(text), hex_lines(F.encode(text, "UTF-8"))).when(F.length(text) > most, cut).otherwise(F.coalesce(text, F.lit("")))


def safe_text(data: Column) -> Column:
    """Bytes as UTF-8, bad parts replaced."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.make_valid_utf8(data.cast("string")))


def header_block(fields: Column) -> Column:
    """Header lines of a map of fields."""
    kept = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(NO_HEADERS) & (F.length(e["value"]) > 0))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.array_join(F.transform(F.split(e["key"], "_"), F.initcap), "-"), F.lit(": "), e["value"])), "\r\n")


def request_text(method: Column, uri: Column, headers: Column, body: Column, version: str = "HTTP/1.1") -> Column:
    """A request as text, to be sent again."""
    lines = [F.when(F.length(F.element_at(headers, F.lit(f))) > 0, F.concat(F.lit(f"{n}: "), F.element_at(headers, F.lit(f)), F.lit("\n"))).otherwise("") for n, f in HEADERS.items()]
    up = F.upper(method)
    return F.concat(up, F.lit(" "), uri, F.lit(f" {version}\n"), *lines, F.lit("\n"), F.when(up.isin("POST", "PUT", "PATCH"), F.coalesce(body, F.lit(""))).otherwise(""))


def response_info(packets: DataFrame) -> DataFrame:
    """(frame_number, status_code, content_type, content_length, body) of packets that begin an HTTP answer."""
    text = F.decode("payload", "ISO-8859-1")
    at = F.instr(text, "\r\n\r\n")
    field = lambda n: F.trim(F.regexp_extract(text, rf"(?i)\r\n{n}:([^\r\n]*)", 1))
    body = F.when(at > 0, safe_text(F.substring("payload", at + 4, F.octet_length("payload"))))
    return packets.where("http_response_code is not null").select("frame_number", F.col("http_response_code").alias("status_code"), field("content-type").alias("content_type"), field("content-length").try_cast("long").alias("content_length"), body.alias("body"))


def indicators(text: Column, rules: dict[str, tuple[str, int]]) -> Column:
    """The rules that match, as (name, weight), heaviest first and in the rules' order on ties."""
    hits = F.array(*[F.when(S.hit(text, p), F.struct(F.lit(-w).alias("w"), F.lit(i).alias("i"), F.lit(n).alias("name"))) for i, (n, (p, w)) in enumerate(rules.items())])
    return F.transform(F.array_sort(F.filter(hits, lambda h: h.isNotNull())), lambda h: F.struct(h["name"].alias("name"), (-h["w"]).alias("weight")))


def typed(df: DataFrame, kind: str, uri: str, most: int = 150) -> DataFrame:
    """df (with indicators) as results: detection_type, total_weight, threat_level, uri cut short, indicator (three names)."""
    weight = F.aggregate("indicators", F.lit(0), lambda a, x: a + x["weight"])
    out = df.withColumns({"detection_type": F.lit(kind), "total_weight": weight, "indicator": F.array_join(F.transform(F.slice("indicators", 1, 3), lambda x: x["name"]), ", ")})
    return out.withColumns({"threat_level": S.level(F.col("total_weight")), "uri": F.substring(F.col(uri), 1, most)})


def listed(values: Column, most: int) -> Column:
    """The first values of a list, and how many more there are."""
    more = F.when(F.size(values) > most, F.concat(F.lit(" (+"), (F.size(values) - most).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), more)


def table_rows(df: DataFrame, key: str) -> DataFrame:
    """Results (see typed(); with method, tags and timestamp) as the eight cells of a table's row."""
    uri = F.when(F.length("uri") > 50, F.concat(F.substring("uri", 1, 50), F.lit("..."))).otherwise(F.col("uri"))
    names = F.transform("indicators", lambda x: x["name"])
    return df.select(key, F.col("threat_level").alias("level"), F.col("detection_type").alias("kind"), "method", uri.alias("uri"), listed(names, 3).alias("indicator"), listed(F.col("tags"), 2).alias("tags"), F.when(F.col("total_weight") > 0, F.col("total_weight").cast("string")).otherwise("").alias("weight"), F.col("timestamp").alias("time"))


def protocol_paths(packets: DataFrame, column: str, outer: tuple = ("eth", "frame"), inner: tuple = ("data",)) -> DataFrame:
    """(path, packets, pct) of every prefix of the paths that a column holds, outer and inner layers left out; the share is of
    all packets, counted once."""
    layers = F.filter(F.split(column, ":"), lambda p: ~p.isin(*outer, *inner))
    paths = packets.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(layers))), lambda n: F.array_join(F.slice(layers, F.lit(1), n), ":"))).alias("path"))
    total = packets.agg(F.count("*").alias("all"))
    g = paths.where("path <> ''").groupBy("path").agg(F.count("*").alias("packets")).crossJoin(F.broadcast(total))
    return g.select("path", "packets", F.round(100.0 * F.col("packets") / F.col("all"), 4).alias("pct"))


def repeats(df: DataFrame, text: str, low: int = 3, high: int = 10, least: int = 3, most: int = 10) -> DataFrame:
    """(n, gram, times): the commonest substrings of each length that occur some times at least."""
    places = lambda n: F.transform(F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col(text), i, F.lit(n)))
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), places(n).alias("g")) for n in range(low, high + 1)])).alias("x")).select("x.n", F.explode("x.g").alias("gram"))
    counted = rows.groupBy("n", "gram").agg(F.count("*").alias("times")).where(F.col("times") >= least)
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("times"), "gram"))).where(F.col("r") <= most).drop("r")


def limited(df: DataFrame, limits: dict[str, int], other: int) -> DataFrame:
    """The heaviest rows of each kind, as many as its limit, with their rank; smaller ids first on ties."""
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(z) for kv in limits.items() for z in kv]), F.col("kind")), F.lit(other))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("weight"), "id")))
    return ranked.where(F.col("rank") <= most)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts; bytes as hexadecimal digits."""
    cells = [F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cells)).alias("json"))


def with_decoded(detections: DataFrame, decoded: DataFrame, key: str) -> DataFrame:
    """Detections with what was decoded for them."""
    return detections.join(decoded, F.col(key) == F.col("associated_detection_id"), "left").drop("associated_detection_id")


def protocol_counts(packets: DataFrame) -> DataFrame:
    """(protocol, count, percentage), most frequent first."""
    g = packets.groupBy("protocol").agg(F.count("*").alias("count"))
    return g.withColumn("percentage", F.round(100 * F.col("count") / F.sum("count").over(Window.partitionBy()), 1)).orderBy(F.desc("count"), "protocol")


def analyze_capture(spark, path: str, limit: int = 0, display: str | None = None) -> dict:
    """A capture from end to end: packets, protocols, attacks, findings of all analyzers; the parts of a summary are limited,
    the counts are of everything. The packets are scanned once and kept for the analyzers."""
    from pyspark import StorageLevel

    from ..sources.pcap import read_pcap
    from .analyzers import analyze
    from .display import scan

    packets = scan(read_pcap(spark, path), display, None, limit).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        http = packets.where("http_method is not null").withColumn("text", F.decode("payload", "ISO-8859-1"))
        attacks = S.attack_scores(http, "text", F.col("http_method"), F.col("http_uri")).where("total_weight >= 40")
        found = analyze(packets)
        by_type = {r["attack_type"]: r["n"] for r in attacks.groupBy("attack_type").agg(F.count("*").alias("n")).collect()}
        top = attacks.orderBy(F.desc("total_weight"), "frame_number").limit(LIMITS["attack"])
        return {
            "ok": True, "file_path": path, "total_packets": packets.count(), "protocol_stats": [r.asDict() for r in protocol_counts(packets).limit(LIMITS["protocol"]).collect()],
            "threat_count": sum(by_type.values()), "detection_counts": by_type,
            "attack_detections": [r.asDict() for r in top.select("frame_number", "src_ip", "dst_ip", "http_method", F.substring("http_uri", 1, 150).alias("uri"), "attack_type", "threat_level", "total_weight").collect()],
            "findings": [r.asDict() for r in found.orderBy("protocol", "frame_number").limit(200).collect()],
        }
    finally:
        packets.unpersist()


def cut_responses(summary: dict, most: int = 500) -> dict:
    """A summary with long texts of responses cut."""
    out = json.loads(json.dumps(summary, default=str))
    todo = [out]
    while todo:
        at = todo.pop()
        for k, v in at.items() if isinstance(at, dict) else enumerate(at):
            if isinstance(v, dict | list):
                todo.append(v)
            elif k == "response_data" and isinstance(v, str) and len(v) > most:
                at[k] = v[:most] + "..."
    return out


def json_report(summary: dict) -> str:
    return json.dumps(cut_responses(summary), ensure_ascii=False, indent=2)


def html_report(summary: dict) -> str:
    """A summary as one page: totals, protocols, attacks and findings as tables."""

    def rows(items: list[dict]) -> str:
        if not items:
            return "<p>none</p>"
        heads = "".join(f"<th>{html.escape(str(c))}</th>" for c in items[0])
        return f"<table><tr>{heads}</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in items) + "</table>"

    parts = [f"<h2>{title}</h2>{rows(summary.get(key, []))}" for title, key in (("Protocols", "protocol_stats"), ("Attacks", "attack_detections"), ("Findings", "findings"))]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Capture report</title></head><body><h1>{html.escape(str(summary.get('file_path', '')))}</h1><p>{summary.get('total_packets', 0)} packets, {summary.get('threat_count', 0)} threats</p>{''.join(parts)}</body></html>"
