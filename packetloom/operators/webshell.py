"""Web-shell analysis of HTTP exchanges: parameters and their encodings, keys, decryption, headers, weights of each tool.

An exchange is a row with method, uri, content_type, body, response and headers (a map with lower-case names). Everything is
Columns, AES included, but for the XOR trials and the entropy, which run over Arrow batches, and the PHP analysis. Keys that
a server hands out are collected per address and joined back, so no state is kept between rows.
"""

from __future__ import annotations

import base64
import binascii
import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..rules import fixed as R
from ..rules import webshell as W
from . import scoring as S
from .php import php_ast

SCRIPT = r"(?i)\.(php|jsp|aspx?|jspx?)\b"


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# Encodings of single values.


def normal_base64(text: Column) -> Column:
    """Base64 of either alphabet, without white space, padded."""
    plain = F.regexp_replace(F.translate(text, "-_", "+/"), r"\s", "")
    return X.bind(plain, lambda t: F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4)))))


def relaxed_base64(text: Column) -> Column:
    """Whether a text of four characters or more is base64 of either alphabet, with or without padding."""
    return (F.length(text) >= 4) & X.bind(normal_base64(text), lambda t: t.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(t) % 4 == 0))


def text_of(data: Column) -> Column:
    """Bytes as UTF-8; with bad parts left out where at least four fifths stay, else null."""
    return X.bind(data, lambda b: F.coalesce(F.try_validate_utf8(b.cast("string")), X.bind(X.without_bad_utf8(b), lambda t: F.when(F.length(t) >= 0.8 * F.octet_length(b), t))))


def base64_text(text: Column) -> Column:
    """The text that base64 of either alphabet stands for; null for what is not base64 or not text."""
    return X.bind(normal_base64(text), lambda t: F.when((F.length(text) >= 4) & t.rlike("^[A-Za-z0-9+/]*={0,2}$"), text_of(F.try_to_binary(t, F.lit("base64")))))


def hex_text(text: Column) -> Column:
    """The text that hexadecimal digits stand for, colons, dashes and white space aside; null otherwise."""
    return X.bind(F.regexp_replace(text, r"[:\s-]", ""), lambda t: F.when(t.rlike("^[0-9a-fA-F]{4,}$") & (F.length(t) % 2 == 0), text_of(F.unhex(t))))


def meaningful(text: Column) -> Column:
    """Whether a decoded text means something: mostly printable, and known words or nearly all printable."""
    share = X.shown(text)
    return F.coalesce((F.length(trimmed(text)) >= 3) & (share >= 0.65) & (any_of(F.lower(text), W.MEANINGFUL) | (share > 0.85)), F.lit(False))


def shares(text: Column) -> tuple[Column, Column, Column]:
    """Shares of printable characters, of other ones above 126 and of control characters."""
    return X.shown(text), X.ratio(text, r"[^\x00-\x7E]"), X.ratio(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def decrypted(text: Column) -> Column:
    """Whether a text looks like decrypted code."""
    plain, other, control = shares(text)
    coded = (plain > 0.80) & (other < 0.05) & (control < 0.05) & any_of(F.lower(text), W.DECRYPTED)
    return F.coalesce((F.length(text) >= 5) & (coded | ((plain > 0.95) & (other < 0.03) & (control < 0.02))), F.lit(False))


def readable(text: Column) -> Column:
    """Whether a response can be shown: short, or nearly all printable."""
    plain, other, control = shares(text)
    return (F.length(text) < 5) | ((plain > 0.90) & (other < 0.05) & (control < 0.05))


def param_name(name: Column) -> Column:
    """Whether a parameter's name is one."""
    bad = F.lit(False)
    for p in W.BAD_NAMES:
        bad = bad | name.rlike("(?i)" + p)
    return (F.length(name) > 0) & (F.length(name) <= 128) & ~F.startswith(name, F.lit("-----")) & ~bad


def params(body: Column) -> Column:
    """Parameters of a form or a multipart body as a map; of a name's values the last counts."""

    def last(pairs: Column) -> Column:
        def add(acc: Column, p: Column) -> Column:
            return F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p))

        empty = F.array().cast("array<struct<key:string,value:string>>")
        return F.map_from_entries(F.aggregate(pairs, empty, add))

    multi = F.contains(body, F.lit("Content-Disposition: form-data")) | body.rlike("(?m)^------")
    pattern = F.lit(r'(?s)name="([^"]+)"(?:[^\r\n]*)\r?\n\r?\n(.*?)(?=\r?\n------|\Z)')
    parts = F.transform(F.arrays_zip(F.regexp_extract_all(body, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(body, pattern, F.lit(2)).alias("b")), lambda z: F.struct(trimmed(z["a"]).alias("key"), trimmed(z["b"]).alias("value")))
    pairs = F.transform(F.filter(F.split(body, r"&(?![^=]*;)"), lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(trimmed(F.split(p, "=", 2)[0]).alias("key"), F.split(p, "=", 2)[1].alias("value")))
    return last(F.filter(F.when(multi, parts).otherwise(pairs), lambda z: param_name(z["key"])))


def decoded_param(value: Column) -> Column:
    """(method, text) of a parameter's value: base64 after the shortest random prefix that gives sense, hexadecimal, or base64
    twice; null where nothing does or the value is under 4 or over 100 000 characters long."""
    none = F.lit(None).cast("struct<method:string,text:string>")

    def of(v: Column) -> Column:
        tries = F.filter(F.transform(F.array(*map(F.lit, W.PREFIXES)), lambda n: F.struct(n.alias("n"), F.when(F.length(v) > n + 4, base64_text(F.substring(v, n + 1, F.length(v)))).alias("t"))), lambda z: meaningful(z["t"]))

        def pick(z: Column) -> Column:
            one = F.when(F.size(z) > 0, F.struct(F.when(z[0]["n"] > 0, F.concat(F.lit("Base64 (prefix="), z[0]["n"].cast("string"), F.lit(")"))).otherwise("Base64").alias("method"), z[0]["t"].alias("text")))
            h = X.bind(hex_text(v), lambda t: F.when(meaningful(t), F.struct(F.lit("Hex").alias("method"), t.alias("text"))))
            return F.coalesce(one, h, none)

        return X.bind(tries, pick)

    return F.when((F.length(value) >= 4) & (F.length(value) <= 100_000), X.bind(X.url_decoded(trimmed(value), 3), of))


def purpose(text: Column) -> Column:
    """What a decoded text is for."""

    def of(low: Column) -> Column:
        out = F.lit("Argument (Data)")
        for p, name in reversed(W.PURPOSES_AFTER_PATH):
            out = F.when(low.rlike("(?i)" + p), name).otherwise(out)
        out = F.when(trimmed(text).rlike(r"^[a-zA-Z]:\\|^/"), "Argument (Path)").otherwise(out)
        for p, name in reversed(W.PURPOSES):
            out = F.when(low.rlike("(?i)" + p), name).otherwise(out)
        return out

    return F.when(F.length(text) > 0, X.bind(F.lower(text), of)).otherwise("Unknown")


# Keys and decryption.


def pure_base64(text: Column) -> Column:
    """Whether 32 characters or more are nothing but base64, and not a form."""
    form = (X.count_of(text, "&") >= 1) & (X.count_of(text, "=") >= 2)
    clean = F.regexp_replace(text, r"\s", "")
    return F.coalesce((F.length(text) >= 32) & ~form & X.bind(clean, lambda c: c.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(c) % 4 == 0) & (F.length(c) >= 24)), F.lit(False))


def sixteen(text: Column) -> Column:
    """The 16 bytes that base64 stands for, else null."""
    return X.bind(F.try_to_binary(text, F.lit("base64")), lambda b: F.when(F.octet_length(b) == 16, b))


def handed_key(response: Column) -> Column:
    """The 16-byte key that a response holds: 16 characters, base64, 32 hexadecimal digits, or a field of JSON; else null."""
    hexed = lambda t: F.when(t.rlike("^[a-fA-F0-9]{32}$"), F.unhex(t))
    sized = lambda t, low, high, v: F.when(F.length(t).between(low, high), v)

    def of(t: Column) -> Column:
        page = F.startswith(t, F.lit("<")) & (F.contains(t, F.lit("<!DOCTYPE")) | F.contains(F.lower(t), F.lit("<html")))
        plain = lambda v: F.when(F.length(v) == 16, F.encode(v, "ISO-8859-1"))
        clean = F.regexp_replace(t, "[^A-Za-z0-9+/=]", "")
        inner = F.regexp_extract(t, "[a-fA-F0-9]{32}", 0)
        short = sized(t, 0, 49, F.coalesce(X.bind(clean, lambda c: sized(c, 20, 30, sixteen(c))), F.when(inner != "", F.unhex(inner))))
        field = lambda v: F.coalesce(plain(v), hexed(v), sized(v, 20, 30, sixteen(v)))
        fields = F.coalesce(*[field(F.get_json_object(t, f"$.{f}")) for f in W.KEY_FIELDS])
        coded = X.bind(F.try_to_binary(t, F.lit("base64")), lambda b: F.coalesce(F.when(F.octet_length(b) == 16, b), F.when(F.octet_length(b) == 32, hexed(F.decode(b, "ISO-8859-1")))))
        return F.when(~page, F.coalesce(plain(t), F.when(pure_base64(t), sized(t, 20, 30, sixteen(t))), hexed(t), short, F.when(F.startswith(t, F.lit("{")), sized(t, 0, 199, fields)), sized(t, 20, 50, coded)))

    return X.bind(trimmed(response), of)


def aes_text(cipher: Column, keys: Column) -> Column:
    """(key, text) of the first key that decrypts base64 (AES, CBC, the key or zeros before the data) to something like code.

    The mode needs whole padding: data cut short, which gives the other tools half a text, gives null here."""
    zero = F.unhex(F.lit("00" * 16))

    def tried(b: Column) -> Column:
        def one(k: Column) -> Column:
            texts = F.array(*[F.when((F.octet_length(k) == 16) & (F.octet_length(b) >= 16), X.without_bad_utf8(F.try_aes_decrypt(F.concat(iv, b), k, F.lit("CBC"), F.lit("PKCS")))) for iv in (k, zero)])
            return F.struct(k.alias("key"), F.get(F.filter(texts, decrypted), F.lit(0)).alias("text"))

        return F.get(F.filter(F.transform(keys, one), lambda z: z["text"].isNotNull()), F.lit(0))

    return X.bind(F.try_to_binary(F.regexp_replace(cipher, r"\s", ""), F.lit("base64")), tried)


def binary_keys(keys: list[str]) -> Column:
    return F.array(*[F.lit(k.encode()) for k in keys])


_PRINTABLE, _ASCII, _LETTERS = bytes([9, 10, 13, *range(32, 127)]), bytes(range(127)), (string.ascii_letters + string.digits + "+/").encode()


def looks_decrypted(text: str) -> bool:
    """decrypted() for one text."""
    if len(text) < 5:
        return False
    raw = text.encode("utf-8", "surrogatepass")
    plain = (len(raw) - len(raw.translate(None, _PRINTABLE))) / len(text)
    if plain <= 0.80:
        return False
    other = (len(text) - len(raw) + len(raw.translate(None, _ASCII))) / len(text)
    control = 1 - plain - other
    return (plain > 0.80 and other < 0.05 and control < 0.05 and any(w in text.lower() for w in W.DECRYPTED)) or (plain > 0.95 and other < 0.03 and control < 0.02)


def xor_trial(text: str | None, keys: list[str]) -> tuple[str, str, str] | None:
    """(text, key, method) of the first key whose XOR with the decoded text gives code, of base64 twice, or of base64 alone."""
    import numpy as np

    def plain(data: bytes) -> str:
        return data.decode("utf-8", "ignore")

    def coded(t: str) -> bytes | None:
        try:
            return base64.b64decode(t)
        except (binascii.Error, ValueError):
            return None

    def hopeless(out: bytes) -> bool:
        """Whether base64 within these bytes, without the end mark, breaks off within four characters."""
        return b"=" not in out and (len(out) - len(out.translate(None, _LETTERS))) % 4 != 0

    if not text:
        return None
    first = coded(text)
    data = np.frombuffer(first if first is not None else text.encode("utf-8", "ignore"), np.uint8)
    for key in filter(None, keys):
        k = key.encode()
        raw = (data ^ np.frombuffer((k * (len(data) // len(k) + 1))[: len(data)], np.uint8)).tobytes()
        printable = len(raw) - len(raw.translate(None, _PRINTABLE))
        strange = len(raw.translate(None, _ASCII))
        # Of len(raw) - strange ASCII characters at least, more than four fifths must be printable; base64 must end whole.
        if printable <= 0.80 * (len(raw) - strange) and hopeless(raw):
            continue
        out = plain(raw)
        if looks_decrypted(out):
            return out, key, "XOR+Base64"
        twice = coded(out)
        if twice is not None and looks_decrypted(plain(twice)):
            return plain(twice), key, "XOR+Double-Base64"
    if first is not None and looks_decrypted(plain(first)):
        return plain(first), "none", "Base64"
    return None


XOR = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "key", "method")])


def xor_text(keys: list[str]):
    """xor_trial() over Arrow batches with these keys before the usual ones."""
    tried = [*keys, *R.GODZILLA_DEFAULT_KEYS]

    @F.pandas_udf(XOR)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([xor_trial(t, tried) or (None, None, None) for t in x], columns=["text", "key", "method"])

    return run


# Weights of the tools.


def header(name: str) -> Column:
    return F.coalesce(F.element_at("headers", F.lit(name)), F.lit(""))


def counted(features: list[tuple[Column, int, bool]]) -> tuple[Column, Column]:
    """Sum of weights and number of matched features; some features do not count as one."""
    return S.total([F.when(c, w).otherwise(0) for c, w, _ in features]), S.total([F.when(c, 1).otherwise(0) for c, _, own in features if own])


def behinder_headers() -> Column:
    """Weight of request headers that this tool sends."""
    kind, accept, lang, enc = header("content-type"), header("accept"), header("accept-language"), header("accept-encoding")
    form = F.contains(kind, F.lit("application/x-www-form-urlencoded"))
    script = F.contains(accept, F.lit("application/json")) & F.contains(accept, F.lit("text/javascript"))
    size = header("content-length").try_cast("long")
    agent = any_of(header("user-agent"), W.BEHINDER_AGENTS)
    features = [
        (form, 10, True), (F.contains(kind, F.lit("application/octet-stream")), 15, True), (script, 25, True), (~script & ((accept == "*/*") | F.contains(accept, F.lit("text/html"))), 5, False),
        (F.contains(lang, F.lit("zh-CN")) & F.contains(lang, F.lit("en-US")), 15, True), (trimmed(enc) == "gzip", 15, True), ((trimmed(enc) != "gzip") & F.contains(enc, F.lit("gzip")), 5, False),
        (F.contains(F.lower(header("connection")), F.lit("keep-alive")), 10, True), (size > 5000, 20, True), (size.between(2001, 5000), 15, True), (size.between(1001, 2000), 10, True), (agent, 20, True),
        (F.contains(header("pragma"), F.lit("no-cache")) | F.contains(header("cache-control"), F.lit("no-cache")), 5, False),
    ]
    weight, n = counted(features)
    return weight + F.when(n >= 4, 30).when(n >= 3, 15).otherwise(0)


def godzilla_headers() -> Column:
    """Weight of request headers that this tool sends."""
    agent, accept, kind = header("user-agent"), header("accept"), header("content-type")
    java = agent.rlike(r"^Java/\d+\.\d+")
    jdk = F.lit(False)
    for p in W.JDK_ACCEPT:
        jdk = jdk | accept.rlike("(?i)" + p)
    form = F.contains(kind, F.lit("application/x-www-form-urlencoded"))
    features = [(java, 40, True), (~java & F.contains(agent, F.lit("Java/")), 30, True), (jdk, 35, True), (header("cookie").rlike(r";\s*$"), 60, True), (form, 10, True), (~form & F.contains(kind, F.lit("application/octet-stream")), 15, True), (F.contains(F.lower(header("connection")), F.lit("keep-alive")), 5, False)]
    weight, n = counted(features)
    return weight + F.when(n >= 3, 25).when(n >= 2, 10).otherwise(0)


def wrapped_response(response: Column) -> Column:
    """The base64 between the halves of a hash that this tool's responses have, else null."""
    pattern = r"^([0-9a-fA-F]{16})([A-Za-z0-9_+/]+={0,2})([0-9a-fA-F]{16})$"
    return F.when(F.length(response) >= 36, X.bind(F.regexp_extract(F.regexp_replace(response, r"\s", ""), pattern, 2), lambda b: F.when((b != "") & F.try_to_binary(b, F.lit("base64")).isNotNull(), b)))


def uri_base(uri: Column) -> Column:
    return F.substring_index(uri, "?", 1)


def key_exchanges(df: DataFrame) -> DataFrame:
    """(base, keys): keys that script addresses hand out to requests that look like an exchange."""
    asks = (F.col("method") == "GET") | ((F.col("method") == "POST") & ((F.length(trimmed(F.col("response"))) <= 50) | (F.length(trimmed(F.coalesce("body", F.lit("")))) < 32)))
    rows = df.where(F.col("uri").rlike(SCRIPT) & (F.length("response") > 0) & asks).select(uri_base(F.col("uri")).alias("base"), handed_key(F.col("response")).alias("key"))
    return rows.where("key is not null").groupBy("base").agg(F.array_sort(F.collect_set(F.hex("key"))).alias("keys"))


def godzilla_sessions(df: DataFrame) -> DataFrame:
    """(base, responses): addresses with wrapped responses and how many."""
    return df.where(wrapped_response(F.col("response")).isNotNull()).groupBy(uri_base(F.col("uri")).alias("base")).agg(F.count("*").alias("responses"))


def prepared(df: DataFrame) -> DataFrame:
    """df with base, plain (the decoded body), params, pure, form and entropies of body and response."""
    df = df.withColumns({"base": uri_base(F.col("uri")), "plain": X.url_decoded(F.coalesce("body", F.lit("")), 3)})
    df = df.withColumns({"stripped": trimmed(F.col("plain")), "params": params(F.col("plain")), "answer": trimmed(F.coalesce("response", F.lit("")))})
    df = df.withColumns({"pure": pure_base64(F.col("stripped")), "form": F.contains("stripped", F.lit("&")) & F.contains("stripped", F.lit("=")), "answer_pure": pure_base64(F.col("answer"))})
    return df.withColumns({"h": X.entropy(F.col("stripped")), "answer_h": X.entropy(F.when(F.length("answer") > 16, F.col("answer")).otherwise(""))})


def decoded_params(given: Column) -> Column:
    """(name, method, text, purpose) of the parameters that decode, in their order."""
    rows = F.transform(F.map_entries(given), lambda e: F.struct(e["key"].alias("name"), F.when(e["value"].rlike(r"@ini_set\s*\(\s*[\"']display_errors"), F.struct(F.lit("Plaintext").alias("method"), F.lit("").alias("text"))).otherwise(decoded_param(e["value"])).alias("d")))
    return F.transform(F.filter(rows, lambda z: z["d"].isNotNull()), lambda z: F.struct(z["name"].alias("name"), z["d"]["method"].alias("method"), z["d"]["text"].alias("text"), F.when(z["d"]["method"] == "Plaintext", "PHP_Code (Shell Core)").otherwise(purpose(z["d"]["text"])).alias("purpose")))


def php_adjustment(texts: Column) -> Column:
    """What program analysis of up to three decoded texts adds: its adjustments, and 40 for each web shell."""
    php = F.filter(texts, lambda t: F.length(t).between(15, 5000) & (F.contains(F.lower(t), F.lit("<?php")) | F.contains(t, F.lit("<?=")) | ((F.contains(t, F.lit("$")).cast("int") + t.rlike(r"\w+\s*\(").cast("int") + F.contains(t, F.lit(";")).cast("int")) >= 2)))
    return php_ast(F.slice(php, 1, 3))


def antsword(df: DataFrame) -> DataFrame:
    """df with weight and confidence of this tool: indicators, parameter names, what parameters decode to, the response."""
    body = F.when(F.col("method").isin("POST", "PUT", "PATCH") & (F.length("body") > 0), F.col("plain")).otherwise("")
    df = prepared(df).withColumn("found", decoded_params(F.when(F.length(body) > 0, F.col("params")).otherwise(F.create_map().cast("map<string,string>"))))
    names = F.aggregate(F.map_keys("params"), F.lit(0), lambda a, n: a + S.param_weight(n))
    bonus = F.aggregate("found", F.lit(0), lambda a, z: a + F.when(F.contains(z["purpose"], F.lit("Command")), 25).when(F.contains(z["purpose"], F.lit("Code")), 20).otherwise(10))
    weight = S.indicator_weight(body, R.ANTSWORD_INDICATORS) + F.when(F.length(body) > 0, names + bonus + php_adjustment(F.transform("found", lambda z: z["text"]))).otherwise(0) + S.indicator_weight(F.col("answer"), R.RESPONSE_INDICATORS)
    return weighed(df, weight)


def caidao(df: DataFrame) -> DataFrame:
    """df with weight and confidence of this tool."""
    df = prepared(df).withColumn("found", decoded_params(F.col("params")))
    shells = F.size(F.filter(F.regexp_extract_all("plain", F.lit(r"([a-zA-Z_]\w*)=(QGluaV9zZXQ[A-Za-z0-9+/]*=*)"), F.lit(2)), lambda v: base64_text(v).isNotNull()))
    named = F.regexp_extract_all("plain", F.lit(r"([a-zA-Z_]\w*)=(QGluaV9zZXQ[A-Za-z0-9+/]*=*)"), F.lit(1))
    rest = F.filter("found", lambda z: ~F.array_contains(named, z["name"]))
    bonus = F.aggregate(rest, F.lit(0), lambda a, z: a + F.when(F.contains(z["purpose"], F.lit("Command")), 20).when(F.contains(z["purpose"], F.lit("Path")), 10).otherwise(0))
    plain = F.col("plain")
    weight = S.indicator_weight(plain, R.CAIDAO_INDICATORS) + 30 * shells + bonus + F.floor(S.indicator_weight(plain, R.ANTSWORD_INDICATORS) / 2).cast("int") + php_adjustment(F.transform("found", lambda z: z["text"])) + S.indicator_weight(F.col("answer"), R.RESPONSE_INDICATORS)
    return weighed(df, weight)


def behinder(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """df with weight, confidence and `decoded` (key, text) of this tool; own keys come first, handed out ones next."""
    rows = prepared(df)
    told = key_exchanges(df)
    rows = rows.join(told.withColumnRenamed("keys", "told"), "base", "left")
    given = F.concat(binary_keys(list(keys)).cast("array<binary>") if keys else F.array().cast("array<binary>"), F.coalesce(F.transform("told", F.unhex), F.array().cast("array<binary>")), binary_keys(R.BEHINDER_DEFAULT_KEYS))
    body, size = F.col("stripped"), F.length("stripped")
    opaque = F.col("pure") | (~F.col("form") & (size > 32))
    inner = F.filter(F.map_values("params"), lambda v: (F.length(v) > 20) & pure_base64(trimmed(v)))
    rows = rows.withColumn("decoded", F.when(opaque, aes_text(body, given)))
    within = F.transform(inner, lambda v: aes_text(v, given).isNotNull())
    first = F.exists(F.array(*map(F.lit, W.BEHINDER_FIRST)), lambda p: F.contains(body, p))
    aligned = F.octet_length(F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))) % 16 == 0
    parts = [
        F.when(first, 90).otherwise(0), S.indicator_weight(F.col("plain"), R.BEHINDER_INDICATORS), F.when(F.col("pure"), 45).otherwise(0), F.when(F.col("h") > 5.5, 40).when(F.col("h") > 4.5, 25).otherwise(0),
        F.when(F.col("pure") & aligned, 35).otherwise(0), F.when(~F.col("form") & (size > 32), 30).otherwise(0), F.when(F.col("uri").rlike(SCRIPT), 20).otherwise(0), F.when((F.length("base") < 50) & (size > 200), 25).otherwise(0),
        behinder_headers(), F.when(F.col("told").isNotNull(), 60).otherwise(0), F.when(F.col("decoded").isNotNull(), 80).otherwise(0), F.when(~opaque, 80 * F.size(F.filter(within, lambda z: z))).otherwise(0),
        F.when(F.col("answer_pure") & (F.col("answer_h") > 4.5), F.lit(40) + F.when(F.col("pure"), 30).otherwise(0)).when(F.col("answer_pure") & (F.length("answer") > 32), 25).otherwise(0),
        S.indicator_weight(F.col("answer"), R.RESPONSE_INDICATORS),
    ]
    return weighed(rows, F.when(F.col("method").isin("POST", "PUT") & (size >= 16), S.total(parts)).otherwise(0))


def godzilla(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """df with weight, confidence and `decoded` (text, key, method of the whole body) of this tool."""
    rows = prepared(df).join(godzilla_sessions(df), "base", "left")
    body, size = F.col("stripped"), F.length("stripped")
    xor = xor_text(list(keys))
    values = F.filter(F.map_values("params"), lambda v: F.length(v) > 20)
    rows = rows.withColumns({"decoded": xor(F.when((F.size("params") == 0) & (size > 20), body)), "hits": xor_hits(list(keys))(values)})
    strange = X.ratio(body, r"[^\x20-\x7E]")
    multi = F.contains(F.lower(header("content-type")), F.lit("multipart/form-data"))
    parts = [
        godzilla_headers(), F.when(F.col("responses") > 0, 50).otherwise(0), S.indicator_weight(F.col("plain"), R.GODZILLA_INDICATORS), F.when(F.col("pure") & (size > 5000), 45).when(F.col("pure") & (size > 500), 30).otherwise(0),
        F.when(~multi & (strange > 0.3) & (size > 100), 40).otherwise(0), 30 * F.coalesce("hits", F.lit(0)), F.when(F.col("decoded.text").isNotNull(), 30).otherwise(0),
        F.when(wrapped_response(F.col("response")).isNotNull(), 90).otherwise(0), S.indicator_weight(F.col("answer"), R.RESPONSE_INDICATORS),
    ]
    return weighed(rows, S.total(parts))


def xor_hits(keys: list[str]):
    """How many of a list of values xor_trial() opens, over Arrow batches."""
    tried = [*keys, *R.GODZILLA_DEFAULT_KEYS]

    @F.pandas_udf(T.IntegerType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([sum(xor_trial(v, tried) is not None for v in values) if values is not None else 0 for values in x], dtype="int32")

    return run


def weighed(df: DataFrame, weight: Column) -> DataFrame:
    out = df.withColumn("weight", X.held(weight.cast("long")))
    return out.withColumn("confidence", S.confidence(F.col("weight")))


# The statistical fallback.


def step(value: Column, bounds: list[tuple]) -> Column:
    out = F.lit(0)
    for b in reversed(bounds):
        out = F.when(value >= b[0], b[1]).otherwise(out)
    return out


def statistics(text: str) -> dict[str, Column]:
    """Weight and parts of the statistical analysis of a text column; its characters are counted once."""
    t, m = F.col(text), X.measures(F.col(text))
    share = lambda n: F.when(m["chars"] > 0, n / m["chars"]).otherwise(0.0)
    e, special, strange, plain = m["entropy"], share(m["special"]), share(m["strange"]), share(m["named"])
    odd = (e >= 5.5).cast("int") + (special >= 0.35).cast("int") + (strange >= 0.1).cast("int")
    clean = m["chars"] - m["blank"]
    base = (m["chars"] >= 20) & F.when(clean > 0, m["coded"] / clean >= 0.95).otherwise(False) & (m["pads"] <= 2) & (m["coded"] % 4 == 0)
    weight = step(e, W.STAT_ENTROPY) + step(special, W.STAT_SPECIAL) + step(strange, W.STAT_NON_PRINTABLE) + F.when((plain < 0.4) & ((e > 4.0) | (special > 0.2)), 20).otherwise(0) + F.when(odd >= 2, 30).otherwise(0) + F.when(base, 20).otherwise(0)
    return {"weight": F.when(F.length(t) >= 20, weight).otherwise(0), "strange": strange}


def statistical(df: DataFrame) -> DataFrame:
    """df with weight and confidence of bodies that look encrypted: the fallback where no tool is named."""
    rows = prepared(df).withColumn("kind", F.lower(F.coalesce("content_type", F.lit(""))))
    own, other = statistics("stripped"), statistics("answer")
    body = own["weight"] + F.when(F.col("uri").rlike(r"(?i)\.(php|jsp|aspx?|jspx?|asp)\b"), 15).otherwise(0)
    more = F.when((F.length("answer") > 30) & (other["weight"] >= 30), F.floor(other["weight"] / 2).cast("int")).otherwise(0)
    fits = F.col("method").isin("POST", "PUT") & (F.length(trimmed(F.col("body"))) >= 30) & ~F.contains("kind", F.lit("multipart/form-data"))
    out = rows.withColumn("weight", X.held(F.when(fits, body + more).otherwise(0).cast("long")))
    return out.withColumn("confidence", F.when(F.col("weight") >= 80, "high").when(F.col("weight") >= 50, "medium").when(F.col("weight") >= 30, "suspicious").otherwise("none"))


# Program analysis hints.


def needs_taint(code: Column) -> Column:
    """Whether a call of a dangerous function has an argument that is not one literal."""
    args = F.regexp_extract_all(code, F.lit(rf"(?i)\b(?:{W.TAINT_SINKS})\s*\(([^)]*)\)"), F.lit(1))
    return F.exists(args, lambda a: F.contains(a, F.lit("$")) | ~trimmed(a).rlike("^\\s*([\"'])[^\"']*[\"']\\s*$"))


def sink_names(code: Column) -> Column:
    """Dangerous functions called, in lower case and alphabetical order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(code, F.lit(rf"(?i)\b({W.TAINT_SINKS})\s*\("), F.lit(1)), F.lower)))


def sources_of(code: Column) -> Column:
    """(sink, source): request variables that stand in the arguments of dangerous calls, in the text's order."""
    sources = F.regexp_extract_all(code, F.lit(r"(?i)(\$_(?:GET|POST|REQUEST|COOKIE|FILES|SERVER|ENV)\s*\[[^\]]+\]|\$GLOBALS\s*\[[^\]]+\])"), F.lit(1))
    pattern = F.lit(rf"(?i)\b({W.TAINT_SINKS})\s*\(([^)]*)\)")
    calls = F.arrays_zip(F.regexp_extract_all(code, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(code, pattern, F.lit(2)).alias("a"))
    return F.flatten(F.transform(calls, lambda c: F.transform(F.filter(F.array_distinct(sources), lambda s: F.contains(c["a"], s)), lambda s: F.struct(F.lower(c["n"]).alias("sink"), s.alias("source")))))


def safe_type(content_type: Column) -> Column:
    """Whether a content type is passed over by the quick filter."""
    return any_of(F.lower(F.coalesce(content_type, F.lit(""))), W.SAFE_TYPES)


def word_pattern(words: list[str], call: bool = False) -> str:
    """A pattern for any of some words, or for calls of them."""
    some = "|".join(re.sub(r"([$(){}.*+?|\[\]\\^])", r"\\\1", w) for w in words)
    return rf"\b({some})\s*\(" if call else f"({some})"


def fast_filter(df: DataFrame, text: str, content_type: Column | None = None, most: int | None = None) -> DataFrame:
    """df with risk (0 to 100) and decision (full, fast or skip): whether program analysis of a payload is worth it. most:
    characters that are looked at, all by default; texts under 10 or over 500 000 characters are skipped."""
    t = F.substring(F.col(text), 1, most) if most else F.col(text)
    called, named = F.contains(t, F.lit("(")), F.contains(t, F.lit("$")) | F.contains(t, F.lit("://"))

    def n(pattern: str) -> Column:
        """How often a pattern occurs, told only where the sign stands that it cannot match without; words and blanks are ASCII."""
        plain = pattern.replace(r"\b", "(?<![A-Za-z0-9_])").replace(r"\s", r"[ \t\n\r\f]")
        return F.when(called if pattern.endswith(r"\(") else named | F.contains(t, F.lit("->(")), F.regexp_count(t, F.lit(plain))).otherwise(0)

    words = 40 * n("(?i)" + word_pattern(R.FILTER_SINKS, True)) + 25 * n("(?i)" + word_pattern(R.FILTER_HIDING, True)) + 15 * n("(?i)" + word_pattern(R.FILTER_FILES, True)) + 20 * n("(?i)" + word_pattern(R.FILTER_SOURCES)) + 15 * n(word_pattern(R.FILTER_DYNAMIC))
    fits = F.length(text).between(10, 500_000) & ~safe_type(content_type if content_type is not None else F.lit(""))
    out = df.withColumn("_words", X.held(F.when(fits, words).otherwise(0)))
    out = out.withColumn("_h", X.entropy(F.when(F.col("_words") > 0, t)))
    raw = F.col("_words")
    risk = F.when((raw == 0) | ((F.col("_h") < 4.0) & (raw < 30)), 0).otherwise(F.least(F.lit(100), raw + F.when(F.col("_h") > 6.5, 20).otherwise(0)))
    out = out.withColumn("risk", risk.cast("int")).drop("_words", "_h")
    return out.withColumn("decision", F.when(F.col("risk") >= 60, "full").when(F.col("risk") >= 30, "fast").otherwise("skip"))


def score_breakdown(df: DataFrame, text: str) -> DataFrame:
    """df with breakdown: entropy and its class, what the text is, risk of its words, statistical weight, and a verdict."""
    out = fast_filter(df, text).withColumns({"_h": X.entropy(F.col(text)), "_t": F.col(text)})
    kind = F.when(F.contains(F.lower("_t"), F.lit("<?php")), "PHP").when(trimmed(F.col("_t")).rlike(r"^\{[\s\S]*\}$"), F.when(F.try_parse_json("_t").isNotNull(), "JSON").otherwise("like JSON")).when(trimmed(F.col("_t")).rlike(r"^<[\s\S]*>"), "markup").when(F.contains("_t", F.lit("=")) & F.contains("_t", F.lit("&")), "form").otherwise("unknown")
    weight = statistics("_t")["weight"]
    total = F.least(F.lit(100), F.greatest(F.col("risk"), weight))
    verdict = F.when(total >= 80, "audit").when(total >= 50, "review").when(total >= 30, "notice").otherwise("skip")
    return out.withColumn("breakdown", F.struct(F.round("_h", 4).alias("entropy"), X.entropy_class(F.col("_h")).alias("entropy_class"), kind.alias("kind"), F.col("risk").alias("risk"), weight.alias("statistics"), total.alias("total"), verdict.alias("verdict"))).drop("_h", "_t", "risk", "decision")


def simple_signatures(body: Column) -> Column:
    """Whether a body holds one of three words of simple shells."""
    return any_of(F.lower(body), ["@ini_set", "@eval(", "base64_decode"])


# Single values, for use outside a query.


def parameter_kind(name: str) -> str:
    """What a parameter of the simple tools holds, by its name."""
    return {"z0": "framework", "z1": "path", "z2": "command"}.get(name, "code" if name.startswith(("_0x", "ant")) else "parameter")


def is_base64(text: str) -> bool:
    """relaxed_base64() for one text."""
    t = re.sub(r"\s", "", text.strip().replace("-", "+").replace("_", "/"))
    return len(text) >= 4 and len(t) % 4 != 1 and bool(re.fullmatch(r"[A-Za-z0-9+/]*={0,2}", t + "=" * (-len(t) % 4)))


def is_hex(text: str) -> bool:
    t = re.sub(r"[:\s-]", "", text)
    return len(t) >= 4 and len(t) % 2 == 0 and bool(re.fullmatch("[0-9a-fA-F]+", t))


def detect_webshell(exchanges: DataFrame, suspicious: bool = True) -> DataFrame:
    """(id, tool, weight, confidence): the best tool of each exchange, the first named on ties; the statistical fallback stands in
    where no tool is sure. Confidence `suspicious` is left out unless asked for."""
    from functools import reduce

    tools = {"antsword": antsword, "caidao": caidao, "behinder": behinder, "godzilla": godzilla, "statistical": statistical}
    rows = reduce(DataFrame.unionByName, [of(exchanges).select("id", F.lit(n).alias("tool"), F.lit(i).alias("rank"), "weight", "confidence") for i, (n, of) in enumerate(tools.items())])
    sure = rows.where((F.col("confidence") != "none") & (F.lit(suspicious) | (F.col("confidence") != "suspicious")))
    named = F.when(F.col("tool") != "statistical", F.struct("weight", (-F.col("rank")).alias("r"), "tool", "confidence"))
    other = F.when(F.col("tool") == "statistical", F.struct("weight", (-F.col("rank")).alias("r"), "tool", "confidence"))
    best = sure.groupBy("id").agg(F.coalesce(F.max(named), F.max(other)).alias("b"))
    return best.select("id", "b.tool", "b.weight", "b.confidence")
