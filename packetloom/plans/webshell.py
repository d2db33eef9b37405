"""Queries of the web-shell analysis, file judgement and encodings: pages as exchanges, documents as files, and hand-made cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import files as FI
from ..operators import scoring as S
from ..operators import webshell as E
from ..registry import register, table
from ..rules import webshell as W
from .scoring import PAYLOADS, quoted

#: Hand-made values of parameters, keys, responses and names; every query over values has them beside whole tables.
VALUES = [
    *PAYLOADS, "d2hvYW1p", "d2hvYW1p==", "ZWNobyAnaGVsbG8gd29ybGQnOw==", "ZWNob yBo", "AAAA=", "A", "AAAAA", "____----", "68656c6c6f20776f726c64", "68:65:6c:6c:6f", "zz", "1234567890123456", "0123456789abcdef0123456789abcdef",
    '{"key":"1234567890123456"}', '{"k":"x"}', "MTIzNDU2Nzg5MDEyMzQ1Ng==", "<html>1234567890123456</html>", "cd /var/www; ls -la", "C:\\Windows", "/etc/passwd", "<% response.write(1) %>", "net user", "echo [S]", "wget http://x ", "class Foo { }",
    "11cd6a8758984163d2hvYW1pOw==6c37ac826a2a04bc", "3c6e0b8a9c15224aAAAA3c6e0b8a9c15224a", "%41%42%43%44%45", "eval($_POST['x']);", "system('ls')", "exec( \"id\" );", "include $page; require('a.php')", "assert($_GET[a] . $_GET[a])", "function f (x)", "if (a)", "$x = 1", "@eval($_POST[1])",
    "name=a&b=c=d&&=x&boundary=1&z0=QGluaV9zZXQ", "a=1&a=2&b", "0x1F", "255", " 0X00ff ", "ssrc",
]
VALUE_SQL = "v AS (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {quoted(p)})" for i, p in enumerate(VALUES)) + ") x(id, t))"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t): all documents, and the hand-made values under negative ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return docs.unionByName(spark.createDataFrame([(-1 - i, p) for i, p in enumerate(VALUES)], "id long, t string"))


def value_query(key: str, oracle: str | None, made):
    """A query over the values whose Columns made(t) gives; oracle: SQL over id and t."""

    @register(key, oracle and f"WITH {VALUE_SQL} {oracle}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return values(spark, sf_dir).select("id", *[c.alias(n) for n, c in made(F.col("t")).items()])


_NORMAL = "(regexp_replace(translate(t, '-_', '+/'), '[ \\t\\n\\r\\f\\v]', '', 'g'))"
_PADDED = f"({_NORMAL} || repeat('=', ((4 - length({_NORMAL}) % 4) % 4)::BIGINT))"


def share_sql(pattern: str, t: str = "t") -> str:
    return f"(CASE WHEN length({t}) > 0 THEN (length({t}) - length(regexp_replace({t}, '{pattern}', '', 'g'))) / length({t}) ELSE 0.0 END)"


def any_sql(words: list[str], t: str) -> str:
    return "(" + " OR ".join(f"contains({t}, {quoted(w)})" for w in words) + ")"


_PLAIN, _OTHER, _CONTROL = share_sql("[\\x20-\\x7E\\t\\n\\r]"), share_sql("[^\\x00-\\x7E]"), share_sql("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")
_TRIM = "regexp_replace(t, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"
value_query("relaxed_base64", f"SELECT id, length(t) >= 4 AND regexp_matches({_PADDED}, '^[A-Za-z0-9+/]*={{0,2}}$') AND length({_PADDED}) % 4 = 0 AS valid FROM v", lambda t: {"valid": E.relaxed_base64(t)})
value_query("meaningful_text", f"SELECT id, length({_TRIM}) >= 3 AND {_PLAIN} >= 0.65 AND ({any_sql(W.MEANINGFUL, 'lower(t)')} OR {_PLAIN} > 0.85) AS meaningful, length(t) >= 5 AND (({_PLAIN} > 0.80 AND {_OTHER} < 0.05 AND {_CONTROL} < 0.05 AND {any_sql(W.DECRYPTED, 'lower(t)')}) OR ({_PLAIN} > 0.95 AND {_OTHER} < 0.03 AND {_CONTROL} < 0.02)) AS decrypted, length(t) < 5 OR ({_PLAIN} > 0.90 AND {_OTHER} < 0.05 AND {_CONTROL} < 0.05) AS readable FROM v", lambda t: {"meaningful": E.meaningful(t), "decrypted": E.decrypted(t), "readable": E.readable(t)})
value_query("param_name_valid", "SELECT id, length(t) > 0 AND length(t) <= 128 AND NOT starts_with(t, '-----') AND NOT (" + " OR ".join(f"regexp_matches(t, {quoted('(?i)' + p)})" for p in W.BAD_NAMES) + ") AS valid FROM v", lambda t: {"valid": E.param_name(t)})


def case_sql(rules, t: str, rest: str, flags: str = "(?i)") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {quoted(flags + p)}) THEN {quoted(n)}" for p, n in rules) + f" ELSE {rest} END"


_AFTER = case_sql(W.PURPOSES_AFTER_PATH, "lower(t)", "'Argument (Data)'")
value_query("payload_purpose", f"SELECT id, CASE WHEN length(t) = 0 THEN 'Unknown' ELSE {case_sql(W.PURPOSES, 'lower(t)', f'(CASE WHEN regexp_matches({_TRIM}, {quoted(chr(94) + "[a-zA-Z]:" + chr(92) * 2 + "|^/")}) THEN {quoted("Argument (Path)")} ELSE {_AFTER} END)')} END AS purpose FROM v", lambda t: {"purpose": E.purpose(t)})
_BAD_SQL = " OR ".join(f"regexp_matches(name, {quoted('(?i)' + p)})" for p in W.BAD_NAMES)


@register("param_last_wins", f"""WITH {VALUE_SQL}, q AS (SELECT id, unnest(string_split(t, '&')) AS p, unnest(range(1, len(string_split(t, '&')) + 1)) AS i FROM v WHERE NOT contains(t, ';') AND NOT contains(t, 'form-data') AND NOT contains(t, '------')),
n AS (SELECT id, i, regexp_replace(split_part(p, '=', 1), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS name, substr(p, strpos(p, '=') + 1) AS value FROM q WHERE contains(p, '='))
SELECT id, name, md5(arg_max(value, i)) AS digest FROM n WHERE length(name) > 0 AND length(name) <= 128 AND NOT starts_with(name, '-----') AND NOT ({_BAD_SQL}) GROUP BY id, name""")
def param_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of forms; of a name's values the last counts."""
    rows = values(spark, sf_dir).where("not contains(t, ';') and not contains(t, 'form-data') and not contains(t, '------')")
    return rows.select("id", F.explode(E.params(F.col("t"))).alias("name", "value")).select("id", "name", F.md5(F.col("value").cast("binary")).alias("digest"))


@register("param_map", None)
def param_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of form and multipart bodies, each decoded where an encoding gives sense."""
    rows = values(spark, sf_dir).select("id", E.decoded_params(E.params(F.col("t"))).alias("p"))
    return rows.select("id", F.explode("p").alias("x")).select("id", "x.*")


value_query("decode_values", None, lambda t: {"base64": E.base64_text(t), "hexadecimal": E.hex_text(t), "key": F.lower(F.hex(E.handed_key(t)))})
value_query("pure_base64", "SELECT id, coalesce(length(t) >= 32 AND NOT (contains(t, '&') AND length(t) - length(replace(t, '=', '')) >= 2) AND regexp_matches(regexp_replace(t, '\\s', '', 'g'), '^[A-Za-z0-9+/]+={0,2}$') AND length(regexp_replace(t, '\\s', '', 'g')) % 4 = 0 AND length(regexp_replace(t, '\\s', '', 'g')) >= 24, false) AS pure FROM v", lambda t: {"pure": E.pure_base64(t)})
value_query("wrapped_response", "SELECT id, CASE WHEN length(t) >= 36 THEN nullif(regexp_extract(regexp_replace(t, '\\s', '', 'g'), '^([0-9a-fA-F]{16})([A-Za-z0-9_+/]+={0,2})([0-9a-fA-F]{16})$', 2), '') END AS inner_text FROM v", lambda t: {"inner_text": E.wrapped_response(t)})

_CALL = f"(?i)\\b(?:{W.TAINT_SINKS})\\s*\\(([^)]*)\\)"
value_query("needs_taint", f"SELECT id, len(list_filter(regexp_extract_all(t, '{_CALL}', 1), lambda a: contains(a, '$') OR NOT (regexp_matches(a, '^\\s*\"[^\"'']*\"\\s*$') OR regexp_matches(a, '^\\s*''[^\"'']*''\\s*$')))) > 0 AS needs, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)\\b({W.TAINT_SINKS})\\s*\\(', 1), lambda s: lower(s)))), ',') AS sinks FROM v", lambda t: {"needs": E.needs_taint(t), "sinks": F.array_join(E.sink_names(t), ",")})
_SRC = "(?i)(\\$_(?:GET|POST|REQUEST|COOKIE|FILES|SERVER|ENV)\\s*\\[[^\\]]+\\]|\\$GLOBALS\\s*\\[[^\\]]+\\])"


@register("sink_sources", f"WITH {VALUE_SQL}, s AS (SELECT id, list_distinct(regexp_extract_all(t, '{_SRC}', 1)) AS src, regexp_extract_all(t, '(?i)\\b({W.TAINT_SINKS})\\s*\\(([^)]*)\\)', 1) AS n, regexp_extract_all(t, '(?i)\\b({W.TAINT_SINKS})\\s*\\(([^)]*)\\)', 2) AS a FROM v), c AS (SELECT id, src, unnest(n) AS n, unnest(a) AS a FROM s), j AS (SELECT id, n, a, unnest(src) AS source FROM c) SELECT id, lower(n) AS sink, source FROM j WHERE contains(a, source)")
def sink_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request variables within the arguments of dangerous calls."""
    return values(spark, sf_dir).select("id", F.explode(E.sources_of(F.col("t"))).alias("x")).select("id", "x.sink", "x.source")


value_query("code_like", "SELECT id, " + " OR ".join(f"regexp_matches(left(t, 5000), {quoted('(?i)' + p)})" for p in W.CODE_LIKE) + " AS code FROM v", lambda t: {"code": S.code_like(t)})
value_query("simple_signatures", f"SELECT id, {any_sql(['@ini_set', '@eval(', 'base64_decode'], 'lower(t)')} AS hit FROM v", lambda t: {"hit": E.simple_signatures(t)})
value_query("detect_encodings", f"""SELECT id, CASE WHEN b IS NOT NULL AND b >= coalesce(h, 0) AND b >= coalesce(u, 0) THEN 'base64' WHEN h IS NOT NULL AND h >= coalesce(u, 0) THEN 'hex' WHEN u IS NOT NULL THEN 'url' END AS name, round(CASE WHEN b IS NULL AND h IS NULL AND u IS NULL THEN NULL ELSE greatest(coalesce(b, 0), coalesce(h, 0), coalesce(u, 0)) END, 6) AS confidence FROM (SELECT id,
CASE WHEN length(t) >= 4 AND length(s) >= 1 AND {share_sql('[A-Za-z0-9+/=]', 's')} >= 0.95 AND length(s) % 4 = 0 AND length(s) - length(replace(s, '=', '')) <= 2 AND ends_with(s, repeat('=', length(s) - length(replace(s, '=', '')))) THEN 1.0 END AS b,
CASE WHEN length(t) >= 2 AND length(x) > 0 AND {share_sql('[0-9A-Fa-f]', 'x')} >= 0.95 AND length(x) % 2 = 0 THEN 0.85 + 0.15 * {share_sql('[0-9A-Fa-f]', 'x')} END AS h,
CASE WHEN n > 0 AND 3 * n / length(t) > 0.1 AND n = length(t) - length(replace(t, '%', '')) THEN least(0.95, 0.5 + 3 * n / length(t)) END AS u
FROM (SELECT *, CASE WHEN starts_with(y, chr(92) || 'x') THEN replace(y, chr(92) || 'x', '') ELSE y END AS x FROM (SELECT id, t, {_TRIM} AS s, regexp_replace({_TRIM}, '^0[xX]', '') AS y, len(regexp_extract_all(t, '%[0-9A-Fa-f]{{2}}')) AS n FROM v)))""", lambda t: {"name": X.best_encoding(t)["name"], "confidence": F.round(X.best_encoding(t)["confidence"], 6)})
value_query("likely_base64", f"SELECT id, length(t) >= 20 AND {share_sql('[A-Za-z0-9+/=]', 'c')} >= 0.95 AND length(c) - length(replace(c, '=', '')) <= 2 AND length(regexp_replace(c, '[^A-Za-z0-9+/=]', '', 'g')) % 4 = 0 AS likely FROM (SELECT id, t, regexp_replace(t, '\\s', '', 'g') AS c FROM v)", lambda t: {"likely": X.likely_base64(t)})
value_query("ssrc_normal", f"SELECT id, CASE WHEN regexp_matches(lower(s), '^0x[0-9a-f]{{1,15}}$') THEN '0x' || lower(to_hex(('0x' || substr(lower(s), 3))::BIGINT)) WHEN regexp_matches(s, '^[0-9]{{1,18}}$') THEN '0x' || lower(to_hex(s::BIGINT)) ELSE lower(s) END AS ssrc FROM (SELECT id, {_TRIM} AS s FROM v)", lambda t: {"ssrc": X.ssrc(t)})


@register("file_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size FROM (SELECT doc_id, octet_length(encode(text)) * (doc_id % 3000 + 1) AS n FROM documents)")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") * (F.col("doc_id") % 3000 + 1)).alias("n"))
    return d.select("doc_id", X.file_size(F.col("n")).alias("size"))


@register("large_payload_samples", "WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), p AS (SELECT doc_id, n, text, unnest(CASE WHEN n > 5000 THEN [0, floor(n * 0.25), floor(n * 0.5), floor(n * 0.75), n - 1000] ELSE [0] END)::BIGINT AS o, unnest(CASE WHEN n > 5000 THEN [1000, 100, 100, 100, 1000] ELSE [n] END)::BIGINT AS s FROM d) SELECT doc_id, o AS \"offset\", md5(substr(text, o + 1, s)) AS digest FROM p")
def large_payload_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, three places between and tail of long texts (over 5000 characters here), others whole."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.sampled(F.col("text"), 5000, 1000, 100)).alias("x"))
    return rows.select("doc_id", "x.offset", F.md5(F.col("x.part").cast("binary")).alias("digest"))


@register("json_leaves", "WITH j AS (SELECT doc_id, json_object('a', [lang, source], 'b', json_object('c', left(text, 40), 'n', n_chars)) AS js FROM documents) SELECT doc_id, array_to_string(list_filter([js->>'$.a[0]', js->>'$.a[1]', js->>'$.b.c'], lambda x: length(x) > 2), '|') AS leaves FROM j")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of JSON documents of more than two characters, in order."""
    js = F.to_json(F.struct(F.array("lang", "source").alias("a"), F.struct(F.substring("text", 1, 40).alias("c"), F.col("n_chars").alias("n")).alias("b")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.leaves(js), "|").alias("leaves"))


_WORDS = ["eval", "mysql_query", "MyExec", "fopen", "xml", "println", "unserialize", "os.system", "nothing", "load", "readObject", "basename"]
_SINK_SQL = " UNION ALL ".join(f"SELECT w, '{d}' AS detector, coalesce(CASE lower(w) " + " ".join(f"WHEN {quoted(n)} THEN {x}" for n, x in s) + " END, CASE " + " ".join(f"WHEN contains(lower(w), {quoted(n)}) OR contains({quoted(n)}, lower(w)) THEN {x}" for n, x in s) + " ELSE 0 END) AS weight FROM w" for d, s in W.SINKS.items())


@register("sink_weights", f"WITH w AS (SELECT unnest([{', '.join(map(quoted, _WORDS))}]) AS w UNION ALL SELECT DISTINCT p_type FROM part) SELECT w AS name, detector, weight::INT AS weight FROM ({_SINK_SQL})")
def sink_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight that each detector gives a called function's name."""
    names = spark.createDataFrame([(w,) for w in _WORDS], "name string").union(table(spark, sf_dir, "part").select("p_type").distinct())
    both = names.select("name", F.explode(F.create_map(*[z for d in W.SINKS for z in (F.lit(d), S.sink_weight(F.col("name"), d))])).alias("detector", "weight"))
    return both.select("name", "detector", F.col("weight").cast("int").alias("weight"))


# Exchanges.

_AGENTS = ["Java/1.8.0_121", "x Java/11", "curl/8", W.BEHINDER_AGENTS[0], ""]
_ACCEPTS = ["text/html, image/gif, image/jpeg, *; q=.2, */*; q=.2", "application/json, text/javascript", "*/*", "text/html", "image/png"]
_KINDS = ["application/x-www-form-urlencoded", "application/octet-stream", "text/plain", "multipart/form-data; boundary=a"]
_COOKIES = ["a=1;", "a=1", "", "b=2; c=3; "]
_ENCODINGS = ["gzip", "gzip, deflate", "identity"]
_BODIES = ["a=1&b=2", "dFAXQV1LORcHRQtLRlwMAhwFTAg/M", "e0J/cXo5bWdnSGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODk=", "z0=QGluaV9zZXQ=&z1=L3Zhci93d3c=&z2=d2hvYW1pOyBscyAtbGE=", "<?php @eval($_POST['a']);?>", "x"]
_ANSWERS = ["1234567890123456", "11cd6a8758984163d2hvYW1pOw==6c37ac826a2a04bc", "ok", "[S]uid=0(root)[E]", "e0J/cXo5bWdnSGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODk="]
_URIS = ["/shell.php", "/up/a.jsp?x=1", "/index.html", "/api/v1/users"]


def choice(n, options: list[str]):
    return F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))


def choice_sql(n: str, options: list[str]) -> str:
    return f"[{', '.join(map(quoted, options))}][({n}) % {len(options)} + 1]"


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as bodies of exchanges, and as many with hand-made bodies and answers under negative ids."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n = F.col("page_id")
    heads = F.map_from_arrays(F.array(*map(F.lit, ["user-agent", "accept", "content-type", "cookie", "accept-encoding", "connection", "content-length"])), F.array(choice(n, _AGENTS), choice(F.floor(n / 3), _ACCEPTS), choice(F.floor(n / 5), _KINDS), choice(F.floor(n / 7), _COOKIES), choice(F.floor(n / 2), _ENCODINGS), F.when(n % 2 == 0, "Keep-Alive").otherwise(""), (n * 37 % 7000).cast("string")))
    method = choice(n, ["POST", "GET", "PUT"])
    own = p.select((-1 - n).alias("id"), method.alias("method"), choice(n, _URIS).alias("uri"), choice(F.floor(n / 5), _KINDS).alias("content_type"), heads.alias("headers"), choice(n, _BODIES).alias("body"), choice(F.floor(n / 2), _ANSWERS).alias("response"))
    return p.select(n.alias("id"), method.alias("method"), F.col("url").alias("uri"), choice(F.floor(n / 5), _KINDS).alias("content_type"), heads.alias("headers"), F.col("html").alias("body"), choice(n, _ANSWERS).alias("response")).unionByName(own)


_H = "page_id"
_HEADS = f"{choice_sql(_H, _AGENTS)} AS ua, {choice_sql('page_id // 3', _ACCEPTS)} AS ac, {choice_sql('page_id // 5', _KINDS)} AS ct, {choice_sql('page_id // 7', _COOKIES)} AS ck, {choice_sql('page_id // 2', _ENCODINGS)} AS en, page_id % 2 = 0 AS alive, page_id * 37 % 7000 AS n, {choice_sql(_H, ['POST', 'GET', 'PUT'])} AS method"
EXCHANGE_SQL = f"e AS (SELECT page_id AS id, {_HEADS}, url AS uri, html AS body, {choice_sql(_H, _ANSWERS)} AS response FROM pages UNION ALL SELECT -1 - page_id, {_HEADS}, {choice_sql(_H, _URIS)}, {choice_sql(_H, _BODIES)}, {choice_sql('page_id // 2', _ANSWERS)} FROM pages)"


def n_sql(features: list[tuple[str, int, bool]]) -> tuple[str, str]:
    return " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in features), " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _, own in features if own)


_GW, _GN = n_sql([("regexp_matches(ua, '^Java/[0-9]+\\.[0-9]+')", 40, True), ("NOT regexp_matches(ua, '^Java/[0-9]+\\.[0-9]+') AND contains(ua, 'Java/')", 30, True), ("(" + " OR ".join(f"regexp_matches(ac, {quoted('(?i)' + p)})" for p in W.JDK_ACCEPT) + ")", 35, True), ("regexp_matches(ck, ';\\s*$')", 60, True), ("contains(ct, 'x-www-form-urlencoded')", 10, True), ("contains(ct, 'octet-stream')", 15, True), ("alive", 5, False)])
_SCRIPT = "contains(ac, 'application/json') AND contains(ac, 'text/javascript')"
_BW, _BN = n_sql([("contains(ct, 'x-www-form-urlencoded')", 10, True), ("contains(ct, 'octet-stream')", 15, True), (_SCRIPT, 25, True), (f"NOT ({_SCRIPT}) AND (ac = '*/*' OR contains(ac, 'text/html'))", 5, False), ("en = 'gzip'", 15, True), ("en <> 'gzip' AND contains(en, 'gzip')", 5, False), ("alive", 10, True), ("n > 5000", 20, True), ("n > 2000 AND n <= 5000", 15, True), ("n > 1000 AND n <= 2000", 10, True), (any_sql(W.BEHINDER_AGENTS, "ua"), 20, True)])


@register("webshell_headers", f"WITH {EXCHANGE_SQL} SELECT id, ({_BW}) + CASE WHEN ({_BN}) >= 4 THEN 30 WHEN ({_BN}) >= 3 THEN 15 ELSE 0 END AS behinder, ({_GW}) + CASE WHEN ({_GN}) >= 3 THEN 25 WHEN ({_GN}) >= 2 THEN 10 ELSE 0 END AS godzilla FROM e")
def webshell_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of request headers of two tools."""
    return exchanges(spark, sf_dir).select("id", E.behinder_headers().alias("behinder"), E.godzilla_headers().alias("godzilla"))


_ASKS = "regexp_matches(uri, '(?i)\\.(php|jsp|aspx?|jspx?)\\b') AND (method = 'GET' OR (method = 'POST' AND (length(trim(response)) <= 50 OR length(trim(body)) < 32)))"


@register("behinder_key_scan", f"WITH {EXCHANGE_SQL} SELECT split_part(uri, '?', 1) AS base, string_agg(DISTINCT hex(encode(response)), ',' ORDER BY hex(encode(response))) AS keys FROM e WHERE {_ASKS} AND length(response) = 16 GROUP BY 1")
def behinder_key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys handed out by address; the answers here hold them plainly."""
    rows = exchanges(spark, sf_dir).where("length(response) = 16")
    return E.key_exchanges(rows).select("base", F.array_join("keys", ",").alias("keys"))


@register("godzilla_session_scan", f"WITH {EXCHANGE_SQL} SELECT split_part(uri, '?', 1) AS base, count(*) AS responses FROM e WHERE length(response) >= 36 AND regexp_matches(response, '^[0-9a-fA-F]{{16}}[A-Za-z0-9_+/]+={{0,2}}[0-9a-fA-F]{{16}}$') GROUP BY 1")
def godzilla_session_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.godzilla_sessions(exchanges(spark, sf_dir))


for _tool, _of in (("antsword", E.antsword), ("caidao", E.caidao), ("behinder", E.behinder), ("godzilla", E.godzilla)):

    @register(f"webshell_{_tool}_exchange")
    def _exchange(spark: SparkSession, sf_dir: str, of=_of) -> DataFrame:
        """Exchanges with the tool's weight and confidence, indicators, parameters, keys and decryption taken together."""
        return of(exchanges(spark, sf_dir)).where("weight > 0").select("id", "weight", "confidence")


@register("webshell_best")
def webshell_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest tool of each exchange."""
    return E.detect_webshell(exchanges(spark, sf_dir))


@register("statistical_fallback")
def statistical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that look encrypted or hidden, by entropy and shares of characters."""
    return E.statistical(exchanges(spark, sf_dir)).where("weight > 0").select("id", "weight", "confidence")


# Files.

_FILES = [("a.jpg", "zip"), ("b.png", "exe"), ("report.pdf", "php"), ("x.txt", "sh"), ("same.zip", "zip"), ("noext", "exe"), ("0123456789abcdef0123.bin", "gz"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ.dat", "pdf"), ("short.php", "gz"), ("K.JPEG", "tar")]
_DISGUISE = "CASE WHEN ext = '' OR real = '' OR ext = real THEN false ELSE (real IN ({x}) AND ext IN ({d})) OR (real IN ({s}) AND ext IN ({d})) OR (real IN ({a}) AND ext IN ({i})) END".format(x=", ".join(map(quoted, W.EXECUTABLES)), s=", ".join(map(quoted, W.SCRIPTS)), d=", ".join(map(quoted, W.IMAGES + W.DOCUMENTS)), a=", ".join(map(quoted, W.ARCHIVES)), i=", ".join(map(quoted, W.IMAGES)))


@register("file_names", f"WITH f(name, real) AS (SELECT * FROM (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in _FILES)}) UNION ALL SELECT replace(p_name, ' ', '.'), lower(split_part(p_type, ' ', 1)) FROM part), g AS (SELECT name, real, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem FROM f) SELECT name, real, {_DISGUISE} AS disguised, length(stem) >= 16 AND (regexp_matches(stem, '^[0-9a-fA-F]+$') OR (regexp_matches(stem, '^[A-Za-z0-9+/=]+$') AND length(stem) > 24)) AS random_name FROM g")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose extension hides what a file is, and names that are random strings."""
    f = spark.createDataFrame(_FILES, "name string, real string").union(table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit(".")), F.lower(F.substring_index("p_type", " ", 1))))
    return f.select("name", "real", FI.disguised(FI.extension(F.col("name")), F.col("real")).alias("disguised"), FI.random_name(F.col("name")).alias("random_name"))


def pairs_sql(pairs, t: str) -> str:
    return " ".join(f"WHEN contains({t}, {quoted(a)})" + (f" AND contains({t}, {quoted(b)})" if b else "") + f" THEN {quoted(why)}" for a, b, why, *_ in pairs)


@register("malicious_content", f"WITH {VALUE_SQL}, p AS (SELECT id, left(t, 51200) AS raw, lower(left(t, 51200)) AS t FROM v) SELECT id, CASE {pairs_sql(W.MALICIOUS, 't')} " + " ".join(f"WHEN starts_with(raw, '#!/') AND contains(t, {quoted(d)}) THEN {quoted('Shell script with ' + d)}" for d in W.SHELL_DANGERS) + f" {pairs_sql(W.MALICIOUS_BATCH, 't')} {pairs_sql(W.MALICIOUS_JS, 't')} END AS reason FROM p")
def malicious_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What malicious thing a file's text is, by the first pair of markers in it."""
    return FI.malicious(values(spark, sf_dir).select("id", F.col("t").cast("binary").alias("content")), "content").select("id", "malicious.reason")


@register("service_magic", "WITH f AS (SELECT doc_id, [" + ", ".join(quoted(m[0]) for m in W.SERVICE_MAGIC) + "][doc_id % 24 + 1] AS m FROM documents) SELECT doc_id, CASE m " + " ".join(f"WHEN {quoted(m[0])} THEN {quoted(m[1])}" for m in W.SERVICE_MAGIC) + " END AS extension, CASE m " + " ".join(f"WHEN {quoted(m[0])} THEN {quoted(m[4])}" for m in W.SERVICE_MAGIC) + " END AS description FROM f")
def service_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by their first bytes, longest signature first; some of the files here begin with none."""
    n = F.col("doc_id") % 24
    head = F.when(n < len(W.SERVICE_MAGIC), F.unhex(F.element_at(F.array(*[F.lit(m[0]) for m in W.SERVICE_MAGIC]), F.least(n, F.lit(len(W.SERVICE_MAGIC) - 1)).cast("int") + 1))).otherwise(F.lit(b"\x01"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit(b"\x00\x02")).alias("content"))
    return d.select("doc_id", FI.service_kind(F.col("content")).alias("k")).select("doc_id", "k.extension", "k.description")


@register("real_downloads", f"""WITH m AS (SELECT o_orderkey AS id, {choice_sql('o_orderkey', W.DOWNLOAD_TYPES + W.DOWNLOAD_TYPES_NOT + ['video/mp4', ''])} AS ct, CASE WHEN o_orderkey % 11 = 0 THEN 'attachment; filename=x' ELSE '' END AS disp, {choice_sql('o_custkey', ['/files/a.zip', '/api/list', '/img/1.png', '/x.json', '/pub/b'])} AS uri, {choice_sql('o_orderkey // 7', ['200', '404', '200', '500', '206'])} AS code, (o_totalprice * 3)::BIGINT AS size FROM orders)
SELECT id FROM m WHERE NOT regexp_matches(code, '^[45]') AND size >= 500 AND (contains(disp, 'attachment') OR ({any_sql(W.DOWNLOAD_TYPES, 'ct')} AND NOT {any_sql(W.API_PATHS, 'uri')} AND NOT (contains(ct, 'octet-stream') AND size < 1024)) OR (size > 51200 AND NOT {any_sql(W.DOWNLOAD_TYPES_NOT, 'ct')} AND NOT {any_sql(W.API_PATHS, 'uri')} AND NOT (contains(ct, 'octet-stream') AND size < 1024)))""")
def real_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that are downloads: no errors, attachments, known types off API paths, and large ones of no page's type."""
    n = F.col("o_orderkey")
    m = table(spark, sf_dir, "orders").select(n.alias("id"), choice(n, W.DOWNLOAD_TYPES + W.DOWNLOAD_TYPES_NOT + ["video/mp4", ""]).alias("content_type"), F.when(n % 11 == 0, "attachment; filename=x").otherwise("").alias("disposition"), choice(F.col("o_custkey"), ["/files/a.zip", "/api/list", "/img/1.png", "/x.json", "/pub/b"]).alias("uri"), choice(F.floor(n / 7), ["200", "404", "200", "500", "206"]).alias("code"), F.round(F.col("o_totalprice") * 3).cast("long").alias("size"))
    return m.where(FI.real_download()).select("id")


@register("file_verdicts")
def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of extracted files and why: the ladder of names, sizes, disguise, markers and kinds."""
    v = values(spark, sf_dir).select("id", F.concat(F.lit("f"), F.col("id").cast("string"), choice(F.abs("id"), [".php", ".txt", ".jpg", "", ".zip", ".xyz"])).alias("name"), F.col("t").cast("binary").alias("content"))
    return FI.kept_files(v, "name", "content").select("id", "name", "verdict.keep", "verdict.extension", "verdict.category", "verdict.reason")


@register("attacker_commands")
def attacker_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that decoded payloads hold, one row for each kind and command of a payload."""
    from ..operators.commands import commands

    return commands(values(spark, sf_dir), "id", "t")
