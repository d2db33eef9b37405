"""Queries of protocol sessions, decoders, file identification and program analysis, on table bindings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import correlate as C
from ..operators import files
from ..registry import register, table
from ..rules import fixed as R
from .scoring import payloads

#: USB HID usages 0x04 to 0x38 and their characters, plain and shifted; gaps have none.
KEYS = "abcdefghijklmnopqrstuvwxyz1234567890"
KEY_MORE = {0x28: "\n", 0x2C: " ", 0x2D: "-", 0x2E: "=", 0x2F: "[", 0x30: "]", 0x31: "\\", 0x33: ";", 0x34: "'", 0x36: ",", 0x37: ".", 0x38: "/"}
SHIFT_FROM, SHIFT_TO = "1234567890-=[]\\;',./", "!@#$%^&*()_+{}|:\"<>?"
WEAK_SSH = R.WEAK_SSH


def key_map() -> dict[int, str]:
    return {4 + i: c for i, c in enumerate(KEYS)} | KEY_MORE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TTL = "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END"


@register("icmp_sequence_decode", f"SELECT l_suppkey, count(*) AS packets, count(DISTINCT {_TTL}) AS ttls, string_agg({_TTL}, '' ORDER BY l_orderkey, l_linenumber, l_partkey, {_TTL}) AS bits FROM lineitem GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT {_TTL}) = 2")
def icmp_sequence_decode(spark, sf_dir):
    """Two-valued sequences of a source in capture order, as bits: the small value is 0."""
    ttl = F.when(F.col("l_quantity") > 25, 1).otherwise(0)
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("packets"), F.count_distinct(ttl).alias("ttls"), F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", ttl.alias("b")))).alias("s"))
    return g.where("packets >= 8 and ttls = 2").select("l_suppkey", "packets", "ttls", F.array_join(F.transform("s", lambda x: x["b"].cast("string")), "").alias("bits"))


@register("icmp_concat_flag", "SELECT conv_id, octet_length(encode(string_agg(text, '' ORDER BY turn)))::BIGINT AS bytes, regexp_matches(lower(string_agg(text, '' ORDER BY turn)), 'flag\\{|ctf\\{|ctfhub\\{|key\\{|secret\\{|\\{flag|flag:|key:') AS flag FROM conversations GROUP BY 1")
def icmp_concat_flag(spark, sf_dir):
    """Payloads of a conversation joined in order, their bytes, and whether a word that marks a flag is in them."""
    from ..operators.protocols import flag_like

    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("body"))
    return g.select("conv_id", F.octet_length("body").cast("long").alias("bytes"), flag_like(F.col("body")).alias("flag"))


_LABEL = "split_part(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.', 1)"


@register("dns_label_buffer", f"SELECT page_id // 16 AS stream, string_agg({_LABEL}, '' ORDER BY page_id) FILTER (length({_LABEL}) > 4) AS buffer, count(DISTINCT {_LABEL}) AS labels FROM pages GROUP BY 1")
def dns_label_buffer(spark, sf_dir):
    """Labels of more than four characters, joined in capture order by stream."""
    label = F.split(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), r"\.")[0]
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 16).alias("stream"), "page_id", label.alias("label"))
    parts = F.array_sort(F.collect_list(F.when(F.length("label") > 4, F.struct("page_id", "label"))))
    g = p.groupBy("stream").agg(F.array_join(F.transform(parts, lambda x: x["label"]), "").alias("b"), F.count_distinct("label").alias("labels"))
    return g.select("stream", F.when(F.col("b") != "", F.col("b")).alias("buffer"), "labels")


_USER = "last_value(CASE WHEN event_type = 'login' OR event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@register("ftp_credentials", f"SELECT event_id, user_id, coalesce('u' || {_USER}, 'unknown') || ':' || props AS credential, event_type FROM events QUALIFY event_type = 'purchase'")
def ftp_credentials(spark, sf_dir):
    """Each password with the last user name before it in its session, 'unknown' where there is none."""
    e = C.carry_forward(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type").isin("login", "signup"), F.concat(F.lit("u"), F.col("event_id").cast("string"))), "name", "unknown")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", F.concat("name", F.lit(":"), "props").alias("credential"), "event_type")


@register("mms_files", "SELECT o.o_custkey AS invoke_id, o.o_orderkey AS opened, min(r.o_orderkey) AS answered FROM orders o LEFT JOIN orders r ON r.o_custkey = o.o_custkey AND r.o_orderkey > o.o_orderkey AND r.o_orderstatus = 'F' WHERE o.o_orderstatus = 'O' GROUP BY ALL")
def mms_files(spark, sf_dir):
    """Each open with the next answer of its invocation: a minimum over the rows that follow."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(1, Window.unboundedFollowing)
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).over(w).alias("answered"))
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("invoke_id"), F.col("o_orderkey").alias("opened"), "answered")


@register("obex_segments", """WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM events)
SELECT user_id, segment::BIGINT AS segment, string_agg(props, '' ORDER BY ts, event_id) AS body, bool_or(event_type = 'purchase') AS final FROM s GROUP BY ALL""")
def obex_segments(spark, sf_dir):
    """Bodies that end with a final packet, joined in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("event_type") == "purchase"
    s = table(spark, sf_dir, "events").withColumn("segment", F.coalesce(F.sum(F.when(last, 1).otherwise(0)).over(w), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("ts", "event_id", "props")))
    return s.groupBy("user_id", "segment").agg(F.array_join(F.transform(parts, lambda x: x["props"]), "").alias("body"), F.bool_or(last).alias("final"))


_KEY = "4 + l_partkey % 53"
_KEY_CASE = "CASE k " + " ".join(f"WHEN {k} THEN {q(c)}" for k, c in key_map().items()) + " ELSE '' END"


@register("usb_keyboard_decode", f"""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {_KEY} AS k, l_quantity > 25 AS shift FROM lineitem), c AS (SELECT *, {_KEY_CASE} AS c FROM k)
SELECT l_orderkey, string_agg(CASE WHEN shift THEN upper(translate(c, {q(SHIFT_FROM)}, {q(SHIFT_TO)})) ELSE c END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS typed FROM c GROUP BY 1""")
def usb_keyboard_decode(spark, sf_dir):
    """Key reports as typed text; shift by its modifier."""
    codes = F.create_map(*[F.lit(x) for kv in key_map().items() for x in kv])
    c = F.coalesce(F.element_at(codes, (4 + F.col("l_partkey") % 53).cast("int")), F.lit(""))
    typed = F.when(F.col("l_quantity") > 25, F.upper(F.translate(c, SHIFT_FROM, SHIFT_TO))).otherwise(c)
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", typed.alias("c"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("typed"))


_DX, _DY = "CASE WHEN l_partkey % 256 > 127 THEN l_partkey % 256 - 256 ELSE l_partkey % 256 END", "CASE WHEN l_suppkey % 256 > 127 THEN l_suppkey % 256 - 256 ELSE l_suppkey % 256 END"


@register("usb_mouse_trace", f"WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, sum({_DX}) OVER w AS x, sum({_DY}) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, l_linenumber, x::BIGINT AS x, y::BIGINT AS y FROM m WHERE l_returnflag <> 'N'")
def usb_mouse_trace(spark, sf_dir):
    """Running positions of signed byte moves, given out while a button is down."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    signed = lambda c: F.when(F.col(c) % 256 > 127, F.col(c) % 256 - 256).otherwise(F.col(c) % 256)
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.sum(signed("l_partkey")).over(w).alias("x"), F.sum(signed("l_suppkey")).over(w).alias("y"))
    return m.where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "x", "y")


_OFFERS = ["curve25519-sha256,aes256-gcm", "diffie-hellman-group1-sha1,aes128-cbc", "arcfour256,hmac-md5-96", "ecdh-sha2-nistp256,chacha20-poly1305", "diffie-hellman-group-exchange-sha1,3des-cbc,blowfish-cbc"]
_OFFER_SQL = "o(i, offer) AS (VALUES " + ", ".join(f"({i}, '{o}')" for i, o in enumerate(_OFFERS)) + ")"


def _weak(name: str, words: list[str]):
    @register(name, f"WITH {_OFFER_SQL} SELECT s_suppkey, array_to_string(list_filter([{', '.join(q(w) for w in words)}], lambda w: contains(upper(offer || ',' || s_name), upper(w))), ',') AS weak FROM supplier JOIN o ON s_suppkey % {len(_OFFERS)} = i")
    def run(spark, sf_dir):
        offers = F.array(*map(F.lit, _OFFERS))
        n = table(spark, sf_dir, "supplier").withColumn("offer", F.upper(F.concat(F.element_at(offers, (F.col("s_suppkey") % len(_OFFERS) + 1).cast("int")), F.lit(","), "s_name")))
        return n.select("s_suppkey", F.array_join(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("offer"), F.upper(w))), ",").alias("weak"))


_weak("ssh_weak_alg", WEAK_SSH)


@register("ntlm_hashcat_lines", """WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS n, CASE WHEN o_orderstatus = 'F' THEN substr(md5(o_orderkey::VARCHAR) || md5(o_custkey::VARCHAR), 1, 48) ELSE md5(o_orderkey::VARCHAR) || md5(o_custkey::VARCHAR) END AS nt FROM orders),
c AS (SELECT o_custkey, substr(md5(o_orderkey::VARCHAR), 1, 16) AS challenge, row_number() OVER (ORDER BY o_orderkey) AS m FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT a.o_orderkey, CASE WHEN length(nt) = 48 THEN 5500 ELSE 5600 END AS mode, 'u' || a.o_custkey || '::d:' || CASE WHEN length(nt) = 48 THEN '00:' || nt || ':' || coalesce(challenge, '') ELSE coalesce(challenge, '') || ':' || substr(nt, 1, 32) || ':' || substr(nt, 33) END AS line FROM a LEFT JOIN c ON a.n = c.m""")
def ntlm_hashcat_lines(spark, sf_dir):
    """Answers zipped to challenges by ordinal over the capture, written for version 1 or 2 by the response's length."""
    o = table(spark, sf_dir, "orders")
    digest = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    nt = F.concat(digest("o_orderkey"), digest("o_custkey"))
    auth = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.substring(nt, 1, 48)).otherwise(nt).alias("nt"))
    asked = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.substring(digest("o_orderkey"), 1, 16).alias("challenge"))
    told = C.numbered(asked, "o_orderkey", "m").select("m", "challenge")
    z = C.numbered(auth, "o_orderkey", "n").join(told, F.col("n") == F.col("m"), "left").withColumn("challenge", F.coalesce("challenge", F.lit("")))
    old = F.length("nt") == 48
    line = F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("::d:"), F.when(old, F.concat(F.lit("00:"), "nt", F.lit(":"), "challenge")).otherwise(F.concat("challenge", F.lit(":"), F.substring("nt", 1, 32), F.lit(":"), F.expr("substr(nt, 33)"))))
    return z.select("o_orderkey", F.when(old, 5500).otherwise(5600).alias("mode"), line.alias("line"))


def resp_udtf_rows(df, key, payload):
    """(key, words): the commands of each payload, one row each, by a table function joined laterally."""

    @F.udtf(returnType="words array<string>")
    class Commands:
        def eval(self, data: bytes):
            for words in resp_commands(bytes(data or b"")):
                yield (words,)

    return df.lateralJoin(Commands(F.col(payload).outer())).select(key, "words")


def resp_commands(data: bytes) -> list[list[str]]:
    """The commands of a RESP stream, as lists of words; a cut last one is dropped."""
    out, at = [], 0
    while at < len(data) and data[at : at + 1] == b"*":
        end = data.find(b"\r\n", at)
        if end < 0 or not data[at + 1 : end].isdigit():
            break
        n, at, words = int(data[at + 1 : end]), end + 2, []
        for _ in range(n):
            end = data.find(b"\r\n", at)
            if end < 0 or data[at : at + 1] != b"$" or not data[at + 1 : end].isdigit():
                return out
            size = int(data[at + 1 : end])
            if end + 4 + size > len(data):
                return out
            words.append(data[end + 2 : end + 2 + size].decode("utf-8", "replace"))
            at = end + 4 + size
        out.append(words)
    return out


_SIGS = [("3c21444f4354595045", 0, "html"), ("3c736372697074", 0, "script"), ("3c696d67", 0, "image"), ("25504446", 0, "pdf"), ("504b0304", 0, "zip")]
_SIG_SQL = "s(magic, ext) AS (VALUES " + ", ".join(f"('{m.upper()}', '{e}')" for m, _, e in _SIGS) + ")"
_PLACES = f"WITH {_SIG_SQL}, h AS (SELECT page_id, hex(encode(html)) AS h FROM pages), c AS (SELECT page_id, ext, length(magic) AS n, string_split(h, magic) AS p FROM h, s WHERE contains(h, magic)), e AS (SELECT page_id, ext, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda y: length(y))) + (i - 1) * n)) AS raw_place FROM c), f AS (SELECT DISTINCT page_id, (raw_place // 2)::INT AS place, ext AS extension FROM e WHERE raw_place % 2 = 0)"


@register("embedded_scan", f"{_PLACES} SELECT * FROM f")
def embedded_scan(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    return files.embedded(p, "page_id", "data", _SIGS)


@register("carve_lead", f"{_PLACES} SELECT page_id, place, extension, (coalesce(lead(place) OVER (PARTITION BY page_id ORDER BY place, extension), strlen(html)) - place)::INT AS length FROM f JOIN pages USING (page_id)")
def carve_lead(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    return files.carved(files.embedded(p, "page_id", "data", _SIGS), "page_id", p.select("page_id", F.octet_length("data").alias("size")))


for _name, _spark, _duck in [
    ("detect_base64", "length(c) % 4 = 0 and c rlike '^[A-Za-z0-9+/]+={0,2}$'", "length(c) % 4 = 0 AND regexp_matches(c, '^[A-Za-z0-9+/]+={0,2}$')"),
    ("detect_hex", "length(c) % 2 = 0 and c rlike '^[0-9A-Fa-f]+$'", "length(c) % 2 = 0 AND regexp_matches(c, '^[0-9A-Fa-f]+$')"),
    ("detect_url", "size(regexp_extract_all(c, '%[0-9A-Fa-f]{2}', 0)) >= 4", "len(regexp_extract_all(c, '%[0-9A-Fa-f]{2}')) >= 4"),
]:

    @register(_name, f"SELECT 'd' || doc_id AS id, {_duck} AS encoded FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN to_base64(encode(text)) WHEN 1 THEN hex(encode(text)) ELSE text END AS c FROM documents) UNION ALL SELECT 'p' || page_id, {_duck} FROM (SELECT page_id, replace(url, '/', '%2F') AS c FROM pages)")
    def _detect(spark, sf_dir, sql=_spark):
        raw = F.col("text").cast("binary")
        c = F.when(F.col("doc_id") % 3 == 0, F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))).when(F.col("doc_id") % 3 == 1, F.hex(raw)).otherwise(F.col("text"))
        d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), c.alias("c"))
        p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.replace("url", F.lit("/"), F.lit("%2F")).alias("c"))
        return d.unionByName(p).select("id", F.expr(sql).alias("encoded"))


#: kind -> base, digits of a number, the delimiters that are read.
_CODED = {"binary": (2, 8, ["", " "]), "octal": (8, 3, [" ", ","]), "decimal": (10, 1, [" ", ","]), "hex": (16, 2, ["", " ", ":"])}


def _coded(kind: str):
    base, width, seps = _CODED[kind]
    n = len(seps) + 1

    @register(f"{kind[:3]}_decode", f"SELECT item_id, CASE WHEN item_id % {n} < {len(seps)} THEN text END AS text FROM benchmark")
    def run(spark, sf_dir):
        """Texts written as numbers with each delimiter and read back; with two delimiters in one text they are none."""
        from ..operators.decode import decode_as

        @F.pandas_udf(T.BinaryType())
        def read(x: pd.Series) -> pd.Series:
            return x.map(lambda t: decode_as(kind, t))

        h = F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit(".."), F.lit(0))
        number = lambda b: F.when(F.length(F.conv(b, 16, base)) < width, F.lpad(F.conv(b, 16, base), width, "0")).otherwise(F.conv(b, 16, base))
        written = F.transform(h, number)
        forms = [F.array_join(written, s) for s in seps] + [F.concat(F.array_join(written, seps[1]), F.lit(seps[0] or "-"), F.lit("7" * width if base > 2 else "0" * (width - 1)))]
        coded = F.element_at(F.array(*forms), (F.col("item_id") % n + 1).cast("int"))
        return table(spark, sf_dir, "benchmark").select("item_id", read(coded).cast("string").alias("text"))


for _kind in _CODED:
    _coded(_kind)


@register("auto_decode_best")
def auto_decode_best(spark, sf_dir):
    """Benchmark texts and payloads under one to three layers of encoding, read back by search."""
    from ..operators.decode import auto_decode

    t = F.col("text")
    b64 = lambda c: F.replace(F.base64(c.cast("binary")), F.lit("\r\n"), F.lit(""))
    coded = F.when(F.col("item_id") % 3 == 0, b64(t)).when(F.col("item_id") % 3 == 1, F.lower(F.hex(t.cast("binary")))).otherwise(b64(F.lower(F.hex(t.cast("binary")))))
    d = auto_decode(table(spark, sf_dir, "benchmark").select("item_id", coded.alias("payload")), "payload")
    return d.select("item_id", "decoded.layers", F.array_join("decoded.chain", ">").alias("chain"), F.md5(F.col("decoded.final").cast("binary")).alias("digest"))


@register("php_ast_taint")
def php_ast_taint(spark, sf_dir):
    from ..operators.php import php_taint

    return php_taint(payloads(spark, sf_dir), "text").select("id", "php.webshell", "php.severity", F.array_join("php.sinks", ",").alias("sinks"), "php.obfuscation")
