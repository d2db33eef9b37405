"""Hand vectors and round trips for what SQL cannot express: ciphers, web shells, captures, analyzers, sinks, streams."""

import base64
import hashlib
import hmac
import struct

import pytest
from pyspark.sql import functions as F

from packetloom.functions import crypto as K
from packetloom.operators import decode as D
from packetloom.operators import protocols as P
from packetloom.operators import scoring as S
from packetloom.operators import webshell as E
from packetloom.rules.fixed import GODZILLA_DEFAULT_KEYS
from packetloom.sources import pcap

from .test_operators import frame


def one(spark, row: tuple, ddl: str, *columns):
    return spark.createDataFrame([row], ddl).select(*columns).first()


# Ciphers. The first vector is the standard's own for AES-128 in CBC mode.
KEY, IV = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
PLAIN, CIPHER = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51"), bytes.fromhex("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")


def test_aes_without_padding(spark):
    r = one(spark, (CIPHER, KEY, IV, CIPHER[:20]), "c binary, k binary, v binary, cut binary", K.aes_raw(F.col("c"), F.col("k"), F.col("v")).alias("a"), K.aes_raw(F.col("cut"), F.col("k"), F.col("v")).alias("b"), K.aes_raw(F.col("c"), F.col("cut"), F.col("v")).alias("d"))
    assert bytes(r["a"]) == PLAIN and r["b"] is None and r["d"] is None


def test_hmac_and_tasks(spark):
    for key, text in ((KEY, b"abc"), (b"k" * 64, b""), (b"", b"x" * 200)):
        assert bytes(one(spark, (key, text), "k binary, m binary", K.hmac_sha256(F.col("k"), F.col("m")).alias("h"))["h"]) == hmac.new(key, text, hashlib.sha256).digest()
    body = struct.pack(">III", 7, 20, 30) + b"uid=0(root) gid=0 ok" + b"\0" * 16
    code = one(spark, (body[:48],), "b binary", F.substring(F.aes_encrypt("b", F.lit(KEY), F.lit("CBC"), F.lit("PKCS"), F.lit(K.TASK_IV)), 17, 48).alias("c"))["c"]
    sign = hmac.new(b"h" * 16, bytes(code), hashlib.sha256).digest()[:16]
    task = struct.pack(">I", len(code) + 16) + bytes(code) + sign
    rows = spark.createDataFrame([(1, task), (2, task[:-1] + b"\0"), (3, task[:30]), (4, None)], "i int, d binary")
    got = {r["i"]: r["t"] for r in rows.select("i", K.beacon_task(F.col("d"), F.lit(KEY), F.lit(b"h" * 16)).alias("t")).collect()}
    assert (got[1]["valid"], got[1]["counter"], got[1]["length"], got[1]["type"], bytes(got[1]["content"])) == (True, 7, 20, 30, b"uid=0(root) gid=0 ok")
    assert got[2]["valid"] is False and got[3] is None and got[4] is None


def b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


def test_aes_trials(spark):
    key = b"e45e329feb5d925b"
    code = one(spark, (b"<?php eval($_POST['x']); system('id'); ?>",), "b binary", F.aes_encrypt("b", F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(key)).alias("c"))["c"]
    rows = spark.createDataFrame([(1, b64(bytes(code)[16:])), (2, b64(b"x" * 32)), (3, ""), (4, None)], "i int, c string")
    got = {r["i"]: r["d"] for r in rows.select("i", E.aes_text(F.col("c"), E.binary_keys(["0" * 16, key.decode()])).alias("d")).collect()}
    assert bytes(got[1]["key"]) == key and got[1]["text"].startswith("<?php eval") and got[2] is None and got[3] is None and got[4] is None


def test_xor_trials():
    text = b"<?php echo system('whoami'); return 1; ?>"
    key = b"3c6e0b8a9c15224a"
    mixed = bytes(a ^ key[i % len(key)] for i, a in enumerate(text))
    usual = [key.decode(), *GODZILLA_DEFAULT_KEYS]
    assert E.xor_trial(b64(mixed), usual) == (text.decode(), key.decode(), "XOR+Base64")
    again = bytes(a ^ key[i % len(key)] for i, a in enumerate(base64.b64encode(text)))
    assert E.xor_trial(b64(again), usual)[2] in ("XOR+Double-Base64", "XOR+Base64")
    assert E.xor_trial("", usual) is None and E.xor_trial(None, usual) is None and E.xor_trial(b64(b"\x80\x90" * 30), usual) is None
    own = bytes(a ^ b"myown"[i % 5] for i, a in enumerate(text))
    assert E.xor_trial(b64(own), ["myown"])[1] == "myown"


PARAMS = [
    ("a=1&b=%20x&a=2", {"a": "2", "b": "%20x"}),
    ('------B\r\nContent-Disposition: form-data; name="f"; filename="x.php"\r\n\r\n<?php 1\r\n------B\r\nContent-Disposition: form-data; name="g"\r\n\r\nv\r\n------B--', {"f": "<?php 1", "g": "v"}),
    ("nothing", {}),
    ("", {}),
    ("Content-Type=1&ok=2", {"ok": "2"}),
]


def test_params(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARAMS)], "i int, t string")
    got = {r["i"]: r["p"] for r in rows.select("i", E.params(F.col("t")).alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(PARAMS)}


def test_decoded_params(spark):
    inner = b64(b"cat /etc/passwd")
    cases = [(b64(b"echo 'hello world';"), "Base64", "echo 'hello world';"), ("xy" + b64(b"whoami && ls -la /tmp"), "Base64 (prefix=2)", "whoami && ls -la /tmp"), (b"system('id');".hex(), "Hex", "system('id');"), ("abc", None, None), (None, None, None), ("%63%61%74".replace("%", "%25") + "zz", None, None), (inner, "Base64", "cat /etc/passwd")]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    got = {r["i"]: r["d"] for r in rows.select("i", E.decoded_param(F.col("v")).alias("d")).collect()}
    for i, (_, method, text) in enumerate(cases):
        assert (None if got[i] is None else (got[i]["method"], got[i]["text"])) == (None if method is None else (method, text)), cases[i]


def exchange(spark, **given):
    row = {"id": 1, "method": "POST", "uri": "/s.php", "content_type": "", "headers": {}, "body": "", "response": ""} | given
    ddl = "id long, method string, uri string, content_type string, headers map<string,string>, body string, response string"
    return spark.createDataFrame([tuple(row.values())], ddl)


def test_tools(spark):
    ant = exchange(spark, body="ant=" + b64(b"@ini_set('display_errors','0');@set_time_limit(0);eval($_POST['a']);"), response="->|ok|<-")
    assert E.antsword(ant).first()["weight"] > E.antsword(exchange(spark, body="name=John")).first()["weight"] == 0
    z = E.caidao(exchange(spark, body="pass=x&z0=" + b64(b"@ini_set(\"display_errors\",\"0\");") + "&z1=" + b64(b"cd /var/www; whoami"))).first()
    assert z["weight"] >= 50
    key = b"e45e329feb5d925b"
    code = bytes(one(spark, (b"<?php eval('x'); assert(1);" * 4,), "b binary", F.aes_encrypt("b", F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(key)).alias("c"))["c"])[16:]
    b = E.behinder(exchange(spark, body=b64(code))).first()
    assert b["confidence"] == "high" and b["decoded"]["text"].startswith("<?php eval")
    told = exchange(spark, method="GET", response="fedcba9876543210").unionByName(exchange(spark, id=2, body=b64(code)))
    assert {r["id"]: r["told"] for r in E.behinder(told).collect()}[2] == ["fedcba9876543210".encode().hex().upper()]
    text = b"<?php return system('id'); ?>"
    body = b64(bytes(a ^ b"3c6e0b8a9c15224a"[i % 16] for i, a in enumerate(text)))
    answer = "11cd6a8758984163" + b64(b"result") + "6c37ac826a2a04bc"
    g = E.godzilla(exchange(spark, body="pass=" + body.replace("=", "%3D"), response=answer, headers={"user-agent": "Java/1.8.0"})).first()
    assert g["confidence"] == "high" and g["hits"] == 1 and g["responses"] == 1
    s = E.statistical(exchange(spark, body=b64(bytes(range(256)) * 3))).first()
    assert s["weight"] >= 50 and E.statistical(exchange(spark, method="GET", body="x" * 100)).first()["weight"] == 0


def test_best_tool(spark):
    text = b"<?php return system('id'); ?>"
    body = b64(bytes(a ^ b"3c6e0b8a9c15224a"[i % 16] for i, a in enumerate(text)))
    rows = exchange(spark, body="pass=" + body.replace("=", "%3D"), response="11cd6a8758984163" + b64(b"result") + "6c37ac826a2a04bc", headers={"user-agent": "Java/1.8.0", "cookie": "a=1;"}).unionByName(exchange(spark, id=2, method="GET", body="", uri="/x"))
    got = E.detect_webshell(rows).collect()
    assert [(r["id"], r["tool"], r["confidence"]) for r in got] == [(1, "godzilla", "high")]
    assert E.parameter_kind("z1") == "path" and E.is_base64("d2hvYW1p") and not E.is_base64("AAAAA") and E.is_hex("68:65") and not E.is_hex("abc")


def test_usb(spark):
    from packetloom.operators.usb import pointer_path, typed

    keys = ["00:00:09:00:00:00:00:00", "0000000000000000", "2000040000000000", "02002f0000000000", "00001f0000000000", "00ff", "zz00040000000000"]
    rows = spark.createDataFrame([("k", i, d) for i, d in enumerate(keys)] + [("m", 1, "01ff0200"), ("m", 2, "00010000"), ("m", 3, "000102f0ff00"), ("m", 4, "bad")], "s string, o int, d string")
    assert [tuple(r) for r in typed(rows, "s", "o", "d").collect()] == [("k", "fA{2")]
    assert [tuple(r) for r in pointer_path(rows, "s", "o", "d").orderBy("o").collect()] == [("m", 1, -1, 2), ("m", 3, 2, 1)]


def test_metrics(spark):
    from packetloom.metrics import counted, hit_rate

    df, watch = counted(spark.range(10), even=F.col("id") % 2 == 0)
    df.collect()
    assert watch.get == {"rows": 10, "even": 5} and hit_rate(watch, "even") == 0.5


def test_response_info(spark, tmp_path):
    from packetloom.operators.report import response_info

    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap([(1.0, reply(b"HTTP/1.1 200 OK\r\nContent-Type: text/x\r\nContent-Length: 2\r\n\r\nhi", 80, 9)), (2.0, frame(b"GET / HTTP/1.1\r\n\r\n"))]))
    assert [tuple(r) for r in response_info(pcap.read_pcap(spark, str(tmp_path))).collect()] == [(1, "200", "text/x", 2, "hi")]


def test_program_analysis(spark):
    from packetloom.operators.php import SCHEMA, adjusted, analyze, validated

    shell = analyze("<?php eval($_POST['a']);")
    assert shell["calls"] == [{"name": "eval", "tainted": True}] and shell["adjustment"] > 0
    assert analyze("<?php system('ls');")["adjustment"] < 0 and adjusted([]) == 0
    late = "<?php " + "$a = 1; " * 10_000 + "eval($_GET['x']);"
    assert analyze(late)["webshell"] and not analyze(late, 50_000)["webshell"]
    php = lambda code: tuple(analyze(code)[c] for c in ("webshell", "severity", "sinks", "obfuscation", "calls", "adjustment"))
    codes = ["<?php eval($_POST['a']);", "<?php echo 1;", "<?php system('ls');"]
    rows = spark.createDataFrame([(80, tuple(php(c)[:4]) + ([tuple(x.values()) for x in php(c)[4]], php(c)[5])) for c in codes], f"w int, php struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    assert [r["v"]["reason"] for r in rows.select(validated(F.col("w"), F.col("php")).alias("v")).collect()] == ["ast_confirmed", "no_dangerous_calls", "no_taint_propagation"]


def test_sinks_and_leaves(spark):
    calls = [[("mysql_query", True)], [("mysql_query", False)], [], [("println", True)]]
    rows = spark.createDataFrame([(i, 60, c) for i, c in enumerate(calls)], "i int, w int, c array<struct<name:string,tainted:boolean>>")
    got = [r["b"] for r in rows.orderBy("i").select(S.sink_boost(F.col("w"), F.col("c"), F.lit(0.6), F.lit(5), "sqli").alias("b")).collect()]
    assert got == [60 + 60 + 5 + 18, 60 - 20 + 18, 78, 78]
    assert S.json_leaves('{"a":["xyz",{"b":"long"}],"c":"ab","d":5}') == ["xyz", "long"] and S.json_leaves("no") is None and S.json_leaves("{}") == []
    deep = "x"
    for _ in range(12):
        deep = [deep]
    assert S.json_leaves(__import__("json").dumps([deep, "top!"])) == ["top!"]


def test_facade(spark):
    assert S.is_malicious(spark, "1 UNION SELECT NULL,2") and not S.is_malicious(spark, "hello") and S.attack_types(spark, "hello") == ["unknown"]
    hit = S.detect_attack(spark, '{"q":"1 UNION SELECT NULL,2"}', content_type="application/json")
    assert hit["attack_type"] == "sqli" and hit["detected"]
    assert S.detect_attack(spark, '{"q":1234,"r":"../../"}', content_type="application/json")["total_weight"] >= S.detect_attack(spark, '{"q":1234}', content_type="application/json")["total_weight"]
    S.register_detector("mine", {"word": ("swordfish", 55)})
    try:
        with pytest.raises(ValueError):
            S.register_detector("mine", {})
        assert S.detect_attack(spark, "the Swordfish")["attack_type"] == "mine"
    finally:
        S.forget_detector("mine")
    assert S.detect_attack(spark, "the Swordfish")["attack_type"] is None


def test_needed_words():
    assert S.needed(r"UNION\s{1,10}(ALL\s{1,10})?SELECT\s") == ("select",) and set(S.needed(r"\bon(error|load)\s=")) and S.needed("a?b*") == ()
    assert S.needed(r"(cat|whoami)\b") == ("cat", "whoami")


def test_decoders():
    assert D.decode_as("decimal", "104 105") == b"hi" and D.decode_as("decimal", "104 105,106") is None and D.decode_as("hex", "41 42:43") is None and D.decode_as("octal", "150,151") == b"hi"
    assert D.decode_http("%66lag%7Bx%7D")["flags"] == ["flag{x}"] and D.find_flags(b64(b"see flag{abc} here")) == ["flag{abc}"]
    assert D.decode_param(b64(b"just a plain english sentence here"))["final"] == "just a plain english sentence here"
    assert D.decode(b64(b"see flag{abc} here"), crib="flag")["kind"] == "flag"
    D.register_decoder("backwards", r"^<<.*>>$", lambda t: t[2:-2][::-1].encode(), 6, 1)
    try:
        assert D.decode("<<ereh tnes saw egassem elttil a>>", crib="message")["chain"][:1] in ([], ["backwards"]) and D.decode_as("backwards", "<<cba>>") == b"abc"
    finally:
        D.CODECS[:] = [c for c in D.CODECS if c.name != "backwards"]


# Files.


def test_files(spark):
    from packetloom.operators import files as FI

    cases = [("a.jpg", b"PK\x03\x04" + b"x" * 50, True, "zip"), ("b.txt", b"<?php eval($_POST[1]);", True, "php"), ("login.do", b"ok", False, None), ("x.html", b"<html>404 not found", False, None), ("d.json", b'{"a":1}', False, None), ("p.png", b"tiny", False, None), ("note.txt", b"n" * 600, True, "txt"), ("run.zzz", b"\x00\x01" * 6000, True, "bin"), ("s.zzz", b"\x7fELF" + b"\x00" * 3000, True, "elf"), ("w", b"", False, None)]
    rows = spark.createDataFrame([(n, c) for n, c, *_ in cases], "name string, content binary")
    got = {r["name"]: r["verdict"] for r in FI.kept_files(rows, "name", "content").collect()}
    assert {n: (got[n]["keep"], got[n]["extension"]) for n, *_ in cases} == {n: (k, e) for n, _, k, e in cases}
    noisy = spark.createDataFrame([(1, bytes(range(256)) * 20), (2, b"PK" + bytes(range(256)) * 20)], "i int, c binary")
    assert [r["malicious"] and r["malicious"]["category"] for r in FI.malicious(noisy, "c").orderBy("i").collect()] == ["encrypted", None]
    assert FI.kept_files(rows.limit(0), "name", "content").count() == 0


def test_http_objects(spark, tmp_path):
    from packetloom.operators.files import http_objects

    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Length: 10\r\n\r\n01234"
    packets = [(1.0, frame(b"GET /a.txt HTTP/1.1\r\n\r\n", sport=999)), (1.1, reply(answer, 80, 999)), (1.2, reply(b"56789", 80, 999)), (1.3, frame(b"GET /b HTTP/1.1\r\n\r\n", sport=999)), (1.4, reply(b"HTTP/1.1 404 no\r\n\r\n", 80, 999))]
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap(packets))
    rows = http_objects(pcap.read_pcap(spark, str(tmp_path))).collect()
    assert [(r["uri"], r["code"], r["content_type"], bytes(r["content"])) for r in rows] == [("/a.txt", "200", "text/plain", b"0123456789")]


def reply(payload: bytes, sport: int, dport: int, proto: int = 6) -> bytes:
    """A frame from the server of frame() back to its client."""
    f = frame(payload, proto, sport, dport)
    return f[:26] + f[30:34] + f[26:30] + f[34:]


# Captures.


def ng(packets: list[tuple[float, bytes]]) -> bytes:
    def block(kind: int, body: bytes) -> bytes:
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for t, f in packets:
        at = int(t * 10**9)
        out += block(6, struct.pack("<IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(f), len(f)) + f)
    return out + block(3, struct.pack("<I", len(packets[0][1])) + packets[0][1])


def test_pcapng(spark, tmp_path):
    (tmp_path / "a.pcapng").write_bytes(ng([(5.25, frame(b"GET /x HTTP/1.1\r\n\r\n")), (6.0, frame(b"q", 17, 1, 53))]))
    rows = pcap.read_pcap(spark, str(tmp_path)).orderBy("frame_number").collect()
    assert [(r["frame_number"], r["protocol"]) for r in rows] == [(1, "HTTP"), (2, "DNS"), (3, "HTTP")] and rows[0]["ts"].microsecond == 250_000


def test_pcap_splits(spark, tmp_path):
    frames = [(1.0 + i / 100, frame(b"x" * (i * 37 % 900), dport=1000 + i % 7)) for i in range(700)]
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap(frames))
    (tmp_path / "b.pcap").write_bytes(pcap.write_pcap(frames[:3]))
    whole = pcap.read_pcap(spark, f"{tmp_path}/*.pcap")
    parts = pcap.read_pcap(spark, f"{tmp_path}/*.pcap", split=40_000)
    cells = lambda d: sorted((r["path"].removeprefix("file:"), r["frame_number"], r["ts"], r["dst_port"], bytes(r["payload"])) for r in d.collect())
    assert cells(parts) == cells(whole) and parts.count() == 703


def test_pcap_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pcap").write_bytes(pcap.write_pcap([(1.0, frame(b"GET /%d HTTP/1.1\r\n\r\n" % i)), (2.0, frame(b"q", 17, 1, 53))]))
    pcap.register(spark)
    df = spark.read.format("pcap").load(str(tmp_path))
    assert df.count() == 6 and df.where("protocol = 'HTTP' and dst_port = 80").count() == 3 and df.where("frame_number > 1").select("protocol").distinct().collect()[0][0] == "DNS"
    assert spark.read.format("pcap").option("limit", 1).load(str(tmp_path)).count() == 3
    stream = spark.readStream.format("pcap").load(str(tmp_path))
    q = stream.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    (tmp_path / "3.pcap").write_bytes(pcap.write_pcap([(9.0, frame(b"late"))]))
    q.processAllAvailable()
    from packetloom.streaming.sessions import metrics, stop_all

    assert spark.table("live").count() == 7 and metrics(q)["dropped_late"] == 0 and stop_all(spark) >= 1


def test_display_filter_errors(spark):
    from packetloom.operators.display import display_filter, scan

    for bad in ("tcp.nope == 1", "http &&", "(http", "frame.len > 1 )", "=="):
        with pytest.raises(ValueError):
            display_filter(bad, ["protocol", "length"])
    rows = spark.createDataFrame([(1, "HTTP", 5), (2, "DNS", 7)], "frame_number long, protocol string, length int")
    assert [r["frame_number"] for r in scan(rows, "dns or frame.len eq 5", ["frame_number"], 1).collect()] == [1]


def test_damaged_and_keys(spark, tmp_path):
    from packetloom.sources import scans

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"noise" + frame(b"x" * 40) + frame(b"y" * 40))
    assert pcap.read_damaged(spark, str(tmp_path / "d")).count() == 2
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.pem").write_text("-----BEGIN RSA PRIVATE KEY-----\nAA\n-----END RSA PRIVATE KEY-----\n")
    (tmp_path / "k" / "b.log").write_text("CLIENT_RANDOM " + "a" * 64 + " " + "b" * 96 + "\n")
    (tmp_path / "k" / "c.jks").write_bytes(b"\xfe\xed\xfe\xed\0\0")
    assert sorted((r["kind"], len(r["keys"])) for r in scans.key_files(spark, str(tmp_path / "k")).collect()) == [("jks", 0), ("keylog", 1), ("pem", 1)]
    dump = scans.file_hex(spark, str(tmp_path / "k" / "c.jks")).first()["dump"]
    assert dump.startswith("0000   fe ed fe ed 00 00") and dump.endswith("|......|")
    (tmp_path / "p.xml").write_text('<?xml version="1.0"?><pdml><packet><proto name="ip"/><proto name="tcp"><field name="tcp.dstport" show="80"/></proto></packet><packet><proto name="arp"/></packet></pdml>')
    got = scans.read_pdml(spark, str(tmp_path / "p.xml"), {"port": "tcp.dstport"}).collect()
    assert [(r["protocols"], r["port"]) for r in got] == [(["ip", "tcp"], "80"), (["arp"], None)]
    r = one(spark, ("0x68:65:6c:6c:6f:f",), "t string", scans.hex_text(F.col("t")).alias("t"))
    assert r["t"] == "hello"


# Protocols.


def hello(side: int, suites: list[int], name: bytes | None = None) -> bytes:
    ext = b""
    if name:
        sni = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name
        ext = struct.pack(">HH", 0, len(sni)) + sni
    body = struct.pack(">H", 0x0303) + b"r" * 32 + b"\0"
    body += struct.pack(">H", 2 * len(suites)) + b"".join(struct.pack(">H", s) for s in suites) + b"\x01\0" if side == 1 else struct.pack(">H", suites[0]) + b"\0"
    body += struct.pack(">H", len(ext)) + ext
    hand = bytes([side]) + struct.pack(">I", len(body))[1:] + body
    return b"\x16\x03\x01" + struct.pack(">H", len(hand)) + hand


def ntlm(kind: int) -> bytes:
    if kind == 2:
        return b"xx" + b"NTLMSSP\0" + struct.pack("<I", 2) + b"\0" * 12 + bytes(range(8)) + b"\0" * 20
    parts = [b"L" * 24, b"N" * 40, "DOM".encode("utf-16-le"), "bob".encode("utf-16-le"), b"", b""]
    at, head, body = 64, b"", b""
    for x in parts:
        head += struct.pack("<HHI", len(x), len(x), at + len(body))
        body += x
    return b"NTLMSSP\0" + struct.pack("<I", 3) + head + struct.pack("<I", 1) + body


def test_all_analyzers(spark, tmp_path):
    from packetloom.operators.analyzers import ANALYZERS, analyze, analyze_protocol

    rtp = lambda i: bytes([0x80, 0]) + struct.pack(">HII", i if i < 8 else i + 2, 160 * i, 0xABC) + b"\xff" * 20
    redis = b"*2\r\n$4\r\nAUTH\r\n$6\r\nsecret\r\n*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$8\r\nflag{ok}\r\n"
    cookie = b64(bytes(range(60))).encode()
    packets = [
        frame(hello(1, [0x1301, 4], b"a.example"), sport=5, dport=443), reply(hello(2, [4]), 443, 5),
        frame(b"\x03\x00Cookie: mstshash=alice\r\n", sport=6, dport=3389), frame(redis, sport=7, dport=6379),
        reply(ntlm(2), 445, 8), frame(ntlm(3), sport=8, dport=445),
        frame(b"SSH-2.0-x_1\r\n", sport=9, dport=22), frame(b"..diffie-hellman-group1-sha1,aes128-cbc..", sport=9, dport=22),
        frame(b"USER ann\r\n", sport=10, dport=21), frame(b"PASS pw1\r\nRETR f.txt\r\n", sport=10, dport=21), reply(b"data!", 20, 11), reply(b"more", 20, 11),
        frame(b"AUTH LOGIN\r\n", sport=12, dport=25), frame(base64.b64encode(b"user-name") + b"\r\n", sport=12, dport=25), frame(base64.b64encode(b"pass-word") + b"\r\n", sport=12, dport=25),
        frame(b"MAIL FROM:<a@x>\r\nRCPT TO:<b@y>\r\nDATA\r\n", sport=12, dport=25), frame(b"Subject: hi\r\nflag{mail}\r\n.\r\n", sport=12, dport=25),
        frame(b"GET / HTTP/1.1\r\nCookie: " + cookie + b"\r\n\r\n", sport=13), *[frame(rtp(i), 17, 14, 15) for i in range(12)],
    ]
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap([(1 + i / 10, p) for i, p in enumerate(packets)]))
    rows = pcap.read_pcap(spark, str(tmp_path))
    found = {(r["protocol"], r["title"]): r for r in analyze(rows).collect()}
    text = {k: r["description"] for k, r in found.items()}
    assert text[("TLS", "server name")] == "a.example" and text[("TLS", "weak suite")] == "TLS_RSA_WITH_RC4_128_MD5 RC4, MD5" and ("TLS", "RSA key exchange") in text
    assert text[("RDP", "user")] == "alice" and text[("Redis", "credential")] == "secret" and found[("Redis", "set")]["is_flag"]
    assert text[("SMB", "hash")] == "bob::DOM:0001020304050607:" + "4e" * 16 + ":" + "4e" * 24
    assert text[("SSH", "banner")] == "SSH-2.0-x_1" and "aes128-cbc" in text[("SSH", "weak algorithms")] and text[("FTP", "login")] == "ann:pw1" and text[("FTP", "file")] == "f.txt 9"
    assert text[("SMTP", "login")] == "user-name:pass-word" and text[("SMTP", "mail")] == "a@x > b@y hi" and found[("SMTP", "mail")]["is_flag"] and ("CS", "metadata cookie") in text
    assert text[("RTP", "stream")] == "0xabc PCMU 12 2"
    assert analyze_protocol(spark, str(tmp_path), "Redis").count() == 2 and len(ANALYZERS) == 13
    assert analyze(rows.limit(0)).count() == 0

    from packetloom import sinks

    files = sinks.write_files(sinks.media_files(P.rtp_packets(rows)), str(tmp_path / "out")).collect()
    assert [f["path"].rsplit("/", 1)[1] for f in files] == ["rtp_0xabc.wav"] and open(files[0]["path"], "rb").read()[:4] == b"RIFF"


def der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def test_beacon_sessions(spark):
    from packetloom.functions.rsa import opened, private_key

    p, q = 2**521 - 1, 2**607 - 1  # two primes that need no search
    n, d = p * q, pow(65537, -1, (p - 1) * (q - 1))
    whole = lambda v: der(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))
    one_ = der(0x30, whole(0) + whole(n) + whole(65537) + whole(d) + whole(p) + whole(q) + whole(1) + whole(1) + whole(1))
    eight = der(0x30, whole(0) + der(0x30, b"") + der(4, one_))
    pems = [f"-----BEGIN {k}-----\n{b64(x)}\n-----END {k}-----" for k, x in (("RSA PRIVATE KEY", one_), ("PRIVATE KEY", eight))]
    assert [private_key(x) for x in pems] == [(n, d)] * 2
    data = bytes.fromhex("0000beef00000000") + b"S" * 16 + b"\0" * 4 + struct.pack(">IIHB", 77, 88, 99, 1) + b"\x64\x02\x00\x0a" + b"\0" * 12 + b"\x04\x03\x02\x0a" + b"PC\tann\ta.exe"
    size = (n.bit_length() + 7) // 8
    block = pow(int.from_bytes(b"\0\x02" + b"\x55" * (size - len(data) - 3) + b"\0" + data, "big"), 65537, n).to_bytes(size, "big")
    assert opened(block, (n, d)) == data and opened(block[:-1], (n, d)) is None and opened(None, (n, d)) is None and opened(b"\1" * size, (n, d)) is None
    rows = spark.createDataFrame([(1, "GET", b"GET / HTTP/1.1\r\nCookie: " + base64.b64encode(block) + b"\r\n\r\n"), (2, "GET", b"GET / HTTP/1.1\r\nCookie: " + b"x" * 40 + b"\r\n\r\n")], "frame_number long, http_method string, payload binary")
    r = P.beacon_sessions(rows, pems[0]).collect()
    assert [(x["bid"], x["pid"], x["port"], x["host"], x["username"]) for x in r] == [(77, 88, 99, "10.2.3.4", "ann")]


def smb2(command: int, answer: bool, message: int, body: bytes) -> bytes:
    m = b"\xfeSMB" + b"\0" * 8 + struct.pack("<HHI", command, 0, int(answer)) + b"\0" * 4 + struct.pack("<Q", message) + b"\0" * 32 + body
    return b"\0" + len(m).to_bytes(3, "big") + m


def test_smb_files(spark, tmp_path):
    name, file = "dir\\a.txt".encode("utf-16-le"), bytes(range(16))
    asks = [smb2(5, False, 1, b"\0" * 44 + struct.pack("<HH", 64 + 48, len(name)) + name), smb2(8, False, 2, b"\0" * 8 + struct.pack("<Q", 4) + file), smb2(8, False, 3, b"\0" * 8 + struct.pack("<Q", 0) + file), smb2(9, False, 4, b"\0\0" + struct.pack("<HI", 64 + 48, 4) + struct.pack("<Q", 9) + file + b"\0" * 16 + b"tail")]
    told = smb2(5, True, 1, b"\0" * 64 + file) + smb2(8, True, 2, b"\0\0" + bytes([64 + 16]) + b"\0" + struct.pack("<I", 5) + b"\0" * 8 + b"world") + smb2(8, True, 3, b"\0\0" + bytes([64 + 16]) + b"\0" + struct.pack("<I", 4) + b"\0" * 8 + b"helo")
    packets = [(1 + i / 10, frame(a, sport=9, dport=445)) for i, a in enumerate(asks)] + [(2.0, reply(told[:100], 445, 9)), (2.1, reply(told[100:], 445, 9))]
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap(packets))
    assert [(r["filename"], bytes(r["content"])) for r in P.smb_files(pcap.read_pcap(spark, str(tmp_path))).collect()] == [("dir\\a.txt", b"heloworldtail")]
    assert P.smb2_messages(b"\0\0\0\x05short") == [] and P.smb2_messages(None) == []


def test_dns_hidden(spark):
    text = "你好, flag{dns}"
    code = base64.b64encode(text.encode("gb2312")).hex()
    ask = lambda name: b"\0\1\1\0\0\1\0\0\0\0\0\0" + b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0\0\1\0\1"
    names = [code[i : i + 10] + ".x.example" for i in range(0, len(code), 10)] + ["www.example"]
    rows = spark.createDataFrame([(i, "a", "b", 1000 + i % 3, 53, ask(n)) for i, n in enumerate(names)] + [(99, "a", "b", 5, 53, b"junk"), (98, "b", "a", 53, 5, ask("z.example"))], "frame_number long, src_ip string, dst_ip string, src_port int, dst_port int, payload binary")
    q = P.dns_queries(rows)
    assert {r["name"] for r in q.collect()} == {n.lower() for n in names}
    assert [(r["text"], r["way"]) for r in P.dns_hidden(q).collect()] == [(text, "hex")]


def test_icmp_sequences(spark, tmp_path):
    from packetloom.operators.analyzers import analyze

    def echo(ttl: int, seq: int) -> bytes:
        body = b"\x08\0\0\0\0\x01" + struct.pack(">H", seq) + b"\x01" * 8
        return b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, ttl, 1, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + body

    bits = [int(b) for c in b"flag{t}" for b in f"{c:08b}"]
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap([(1 + i / 10, echo(64 if b else 32, 300 + i)) for i, b in enumerate(bits)]))
    found = {r["title"]: r for r in analyze(pcap.read_pcap(spark, str(tmp_path)), ["ICMP"]).collect()}
    assert found["times to live"]["description"] == "flag{t}" and found["times to live"]["is_flag"] and found["times to live"]["confidence"] == 0.8


def test_rdp_negotiation(spark):
    asks, told = bytes.fromhex("030000130ee000000000000100080003000000"), bytes.fromhex("030000130ed000001234000200080002000000")
    rows = spark.createDataFrame([(1, "a", "b", 50000, 3389, asks), (2, "b", "a", 3389, 50000, told), (3, "a", "b", 1, 3389, b"x")], "frame_number long, src_ip string, dst_ip string, src_port int, dst_port int, payload binary")
    assert [(r["type"], r["protocol"]) for r in P.rdp_negotiations(rows).orderBy("frame_number").collect()] == [("request", "CredSSP and TLS"), ("response", "CredSSP (NLA)")]


def test_rtp_jitter(spark):
    import datetime

    base = datetime.datetime(2024, 1, 1)
    at, stamps, seqs = [0, 0.02, 0.05, 0.06, 0.1], [0, 160, 320, 480, 640], [65534, 65535, 0, 1, 4]
    rows = spark.createDataFrame([(i, base + datetime.timedelta(seconds=t), 0, s, x, "0x1") for i, (t, x, s) in enumerate(zip(at, stamps, seqs, strict=True))], "frame_number long, ts timestamp, pt long, seq long, stamp long, ssrc string")
    j = top = 0.0
    for i in range(1, 5):
        j += (abs((at[i] - at[i - 1]) - (stamps[i] - stamps[i - 1]) / 8000) - j) / 16
        top = max(top, j)
    r = P.rtp_statistics(rows).first()
    assert (r["packets"], r["lost"], r["duration"]) == (5, 2, 0.1) and abs(r["jitter"] - top * 1000) < 1e-3


def test_hidden_text(spark):
    text = "你好 world"
    code = base64.b64encode(text.encode("gb2312"))
    assert P.gb2312(code.hex()) == (text, "hex") and P.gb2312(code.decode().rstrip("=").replace("+", "-")) == (text, "base64") and P.gb2312("") is None and P.gb2312(None) is None
    bits = [int(b) for c in b"flag" for b in f"{c:08b}"]
    rows = spark.createDataFrame([(1, bits), (2, [64 if b else 32 for b in bits]), (3, [72, 105, 7]), (4, [1, 0, 1]), (5, [0, 1] * 5), (6, [])], "i int, v array<int>")
    got = {r["i"]: r["t"] for r in rows.select("i", P.values_text(F.col("v")).alias("t")).collect()}
    assert got == {1: "flag", 2: "flag", 3: "Hi.", 4: "...", 5: got[5], 6: ""} and got[5] in ("U", "0101010101")


def test_mms(spark):
    rows = [(1, "request", 72, 1, None, "a.txt", None), (2, "response", 72, 1, 9, None, None), (3, "request", 73, 2, 9, None, None), (4, "response", 73, 2, None, None, b"one"), (5, "request", 73, 1, 9, None, None), (6, "response", 73, 1, None, None, b"two"), (7, "request", 72, 2, None, "b.txt", None), (8, "response", 72, 2, 9, None, None), (9, "request", 73, 3, 9, None, None), (10, "response", 73, 3, None, None, b"three"), (11, "response", 73, 77, None, None, b"lost")]
    df = spark.createDataFrame(rows, "frame_number long, kind string, service int, invoke_id int, frsm_id int, name string, data binary")
    assert {r["name"]: bytes(r["content"]) for r in P.mms_files(df).collect()} == {"a.txt": b"onetwo", "b.txt": b"three"}


def test_ntlm_over_capture(spark):
    rows = [(1, "s", "c", 445, 1, ntlm(2)), (2, "c", "s", 2, 445, ntlm(3))]
    df = spark.createDataFrame(rows, "frame_number long, src_ip string, dst_ip string, src_port int, dst_port int, payload binary")
    assert ":0001020304050607:" in P.ntlm_hashes(df, per_stream=False).first()["line"] and P.ntlm_hashes(df).first()["line"].startswith("bob::DOM::")


# Commands, reports, sinks.


def test_commands(spark):
    from packetloom.operators.commands import commands, of_parameter

    text = "<?php system('ls -la'); $c = 'id'; exec($c); file_get_contents('/etc/passwd'); fopen('a.txt', 'w'); mysql_query('select 1'); ?>\nwhoami && pwd"
    rows = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "i int, t string")
    got = {(r["type"], r["command"]) for r in commands(rows, "i", "t").collect()}
    assert {("System Command", "ls -la"), ("System Command", "id"), ("File Read", "/etc/passwd"), ("File Operation", "a.txt (mode: w)"), ("SQL Query", "select 1"), ("Shell Command", "whoami && pwd")} <= got
    cases = ["", "whoami", "/var/flags", "/opt/x/", "drop table", "<script>", "xyz"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    assert [r["k"]["type"] for r in rows.orderBy("i").select(of_parameter(F.lit("z2"), F.col("t")).alias("k")).collect()] == ["empty", "shell command", "file read", "folder list", "SQL", "code", "parameter"]


def test_capture_report(spark, tmp_path):
    from packetloom.operators.report import analyze_capture, cut_responses
    from packetloom.sinks import write_names, write_summary

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.pcap").write_bytes(pcap.write_pcap([(1.0, frame(b"GET /?q=SLEEP(5) HTTP/1.1\r\n\r\n")), (2.0, frame(b"GET /<b> HTTP/1.1\r\n\r\n")), (3.0, frame(b"q", 17, 1, 53))]))
    s = analyze_capture(spark, str(tmp_path / "c"))
    assert s["total_packets"] == 3 and s["detection_counts"] == {"sqli": 1} and s["protocol_stats"][0] == {"protocol": "HTTP", "count": 2, "percentage": 66.7}
    page = open(write_summary(s, str(tmp_path / "r.html"))).read()
    assert "<h2>Attacks</h2><table>" in page and "SLEEP(5)" in page and "&lt;" not in s["attack_detections"][0]["uri"]
    assert '"total_packets": 3' in open(write_summary(s, str(tmp_path / "r.json"))).read()
    assert len(cut_responses({"a": [{"response_data": "x" * 900}]})["a"][0]["response_data"]) == 503
    write_names(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "n string"), "n", str(tmp_path / "names"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "names")).collect()) == ["a", "b"]
    assert analyze_capture(spark, str(tmp_path / "c"), display="dns")["total_packets"] == 1


def test_file_sink(spark, tmp_path):
    from packetloom.sinks import safe_name, wav, write_files

    assert safe_name("../../x:y?.txt") == "x_y_.txt" and safe_name("") == "file"
    rows = spark.createDataFrame([("a.txt", b"1"), ("a.txt", b"22"), (None, b"3"), ("b", None)], "filename string, content binary")
    got = sorted((r["path"].rsplit("/", 1)[1], r["bytes"]) for r in write_files(rows, str(tmp_path / "f")).collect())
    assert got == [("a.txt", 1), ("a_1.txt", 2), ("b", 0), ("file", 1)]
    w = wav(b"\x01" * 80)
    assert w[:4] == b"RIFF" and struct.unpack_from("<I", w, 4)[0] == len(w) - 8 and w[-80:] == b"\x01" * 80


def test_stream_sessions(spark, tmp_path):
    from packetloom.sinks import emit
    from packetloom.streaming.sessions import session_windows, sessions

    ddl = "k string, at timestamp, fin boolean"
    src = tmp_path / "in"
    put = lambda rows: spark.createDataFrame(rows, "k string, at string, fin boolean").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(src))
    put([("a", "2024-01-01 00:00:01", False), ("a", "2024-01-01 00:00:03", True), ("b", "2024-01-01 00:00:02", False)])
    stream = spark.readStream.schema(ddl).parquet(str(src))
    got = []
    q = emit(sessions(stream, F.col("k"), "at", F.col("fin"), "1 second", 5000), lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"), "0 seconds")
    q.processAllAvailable()
    put([("c", "2024-01-01 01:00:00", False)])
    q.processAllAvailable()
    put([("c", "2024-01-01 01:00:01", False)])
    q.processAllAvailable()
    q.stop()
    assert sorted((k, n, e) for k, n, _, _, e in got) == [("a", 2, True), ("b", 1, False)]
    w = session_windows(stream, "k", "at").writeStream.outputMode("append").format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "cp2")).start()
    w.processAllAvailable()
    w.stop()
    assert {(r["k"], r["packets"]) for r in spark.table("gaps").collect()} == {("a", 2), ("b", 1)}
