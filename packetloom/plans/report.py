"""Queries of projections and report shaping: response filters, table rows, labels, hex dumps, request texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..registry import register, table
from ..rules import fixed as R
from .scoring import PAYLOAD_SQL, payloads, quoted

_RULES = [(n, p, w, i) for i, (n, (p, w)) in enumerate(R.SQLI.items())]


@register("top_indicator_label", f"WITH {PAYLOAD_SQL}, r(name, pattern, weight, i) AS (VALUES " + ", ".join(f"('{n}', {quoted('(?is)' + p)}, {w}, {i})" for n, p, w, i in _RULES) + "), h AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY weight DESC, i) AS n FROM payloads JOIN r ON regexp_matches(text, pattern)) SELECT id, string_agg(name, ', ' ORDER BY n) AS label FROM h WHERE n <= 3 GROUP BY 1")
def top_indicator_label(spark, sf_dir):
    """The three heaviest rules of a payload, the first listed on ties."""
    hits = F.filter(F.array(*[F.when(S.hit(F.col("text"), p), F.struct(F.lit(-w).alias("w"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for n, p, w, i in _RULES]), lambda x: x.isNotNull())
    label = F.array_join(F.transform(F.slice(F.array_sort(hits), 1, 3), lambda x: x["n"]), ", ")
    return payloads(spark, sf_dir).select("id", label.alias("label")).where("label <> ''")


@register("request_text", "SELECT conv_id, turn, 'POST /c/' || conv_id || ' HTTP/1.1' || chr(13) || chr(10) || 'Content-Length: ' || strlen(text) || chr(13) || chr(10) || chr(13) || chr(10) || text AS request FROM conversations WHERE role = 'user'")
def request_text(spark, sf_dir):
    """A request as its text on the wire."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.concat_ws("\r\n", F.concat(F.lit("POST /c/"), "conv_id", F.lit(" HTTP/1.1")), F.concat(F.lit("Content-Length: "), F.octet_length("text").cast("string")), F.lit(""), "text").alias("request"))


@register("hex_dump", "WITH h AS (SELECT item_id, lower(hex(encode(text))) AS h FROM benchmark), l AS (SELECT item_id, unnest(range(0, (length(h) + 31) // 32)) AS line, h FROM h) SELECT item_id, line::INT AS line, lower(lpad(to_hex(line * 16), 8, '0')) AS place, substr(h, line * 32 + 1, 32) AS bytes FROM l")
def hex_dump(spark, sf_dir):
    """Sixteen bytes a line, with the place of the first."""
    h = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("h")).where("h <> ''")
    lines = h.select("item_id", "h", F.explode(F.sequence(F.lit(0), F.floor((F.length("h") - 1) / 32).cast("int"))).alias("line"))
    return lines.select("item_id", "line", F.lpad(F.lower(F.hex(F.col("line").cast("long") * 16)), 8, "0").alias("place"), F.substring(F.col("h"), F.col("line") * 32 + 1, F.lit(32)).alias("bytes"))


@register("point_lookup", "SELECT event_id, event_type, props FROM events WHERE event_id = 42")
def point_lookup(spark, sf_dir):
    """One frame by its number: the filter reaches the scan."""
    return table(spark, sf_dir, "events").where("event_id = 42").select("event_id", "event_type", "props")


@register("param_suspicious", "WITH p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '_0xab12' WHEN 1 THEN 'z' || (c_custkey % 90) WHEN 2 THEN 'ant_x' WHEN 3 THEN 'cmd' ELSE 'password' END AS name FROM customer) SELECT c_custkey, name, CASE WHEN name IN ('password') THEN 0 WHEN regexp_matches(name, '(?i)^_0x[a-f0-9]+$') THEN 35 WHEN regexp_matches(name, '(?i)^[a-z]{1,2}[0-9]{1,2}$') THEN 20 WHEN regexp_matches(name, '(?i)^ant[_-]?') THEN 40 WHEN regexp_matches(name, '(?i)^(cmd|exec|shell|payload|code)$') THEN 30 WHEN regexp_matches(name, '(?i)^[a-f0-9]{32}$') THEN 25 ELSE 0 END AS weight FROM p")
def param_suspicious(spark, sf_dir):
    """The weight of parameter names, harmless ones aside."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "_0xab12").when(k % 5 == 1, F.concat(F.lit("z"), (k % 90).cast("string"))).when(k % 5 == 2, "ant_x").when(k % 5 == 3, "cmd").otherwise("password")
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).select("c_custkey", "name", S.param_weight(F.col("name")).alias("weight"))


@register("tree_levels", "SELECT event_type, count(*) AS n, sum(CASE WHEN contains(props, '7') THEN 1 ELSE 0 END)::BIGINT AS flagged, rank() OVER (ORDER BY count(*) DESC, event_type)::INT AS place FROM events GROUP BY 1")
def tree_levels(spark, sf_dir):
    """A result tree's top: groups with counts and flags, largest first. The window runs over the few groups."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.contains("props", F.lit("7"))).alias("flagged"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "event_type")))


@register("follow_stream", "SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS body, count(*) AS packets FROM conversations GROUP BY ALL")
def follow_stream(spark, sf_dir):
    """The bytes of a stream by direction, in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("body"), F.count("*").alias("packets"))


def write_report(findings: DataFrame, path: str, limit: int = 500) -> None:
    """Findings as JSON lines, response data cut to `limit` characters."""
    cut = findings.withColumn("response_data", F.substring("response_data", 1, limit)) if "response_data" in findings.columns else findings
    cut.write.mode("overwrite").json(path)
