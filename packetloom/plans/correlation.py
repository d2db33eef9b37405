"""Queries of pairing, joins, deduplication, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import correlate as C
from ..registry import register, table
from ..rules import fixed as R


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as packets: a stream's turns are its frames, users ask and others answer."""
    return table(spark, sf_dir, "conversations")


@register("http_pair_keep_last", """WITH q AS (SELECT conv_id, max(turn) AS request, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT q.conv_id, q.request, q.first, max(c.turn) AS response FROM q LEFT JOIN conversations c ON c.conv_id = q.conv_id AND c.role <> 'user' AND c.turn > q.request GROUP BY ALL""")
def http_pair_keep_last(spark, sf_dir):
    t = turns(spark, sf_dir)
    return C.pair_keep_last(t.where("role = 'user'"), t.where("role <> 'user'"), "conv_id", "turn").select("conv_id", "request", "first", "response")


@register("http_pair_asof_next", """WITH q AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), p AS (SELECT conv_id, turn FROM conversations WHERE role <> 'user')
SELECT q.conv_id, q.turn AS request, coalesce(min(p.turn) FILTER (p.turn > q.turn), max(p.turn)) AS response FROM q LEFT JOIN p ON p.conv_id = q.conv_id GROUP BY q.conv_id, q.turn""")
def http_pair_asof_next(spark, sf_dir):
    return C.pair_next(turns(spark, sf_dir), "conv_id", "turn", F.col("role") == "user")


@register("response_first_per_stream", """WITH f AS (SELECT conv_id, arg_min(text, turn) AS first_response FROM conversations WHERE role <> 'user' GROUP BY 1)
SELECT c.conv_id, c.turn, f.first_response FROM conversations c LEFT JOIN f USING (conv_id) WHERE c.role = 'user'""")
def response_first_per_stream(spark, sf_dir):
    t = turns(spark, sf_dir)
    return C.first_response(t.where("role = 'user'"), t.where("role <> 'user'"), "conv_id", "turn", "text").select("conv_id", "turn", "first_response")


@register("ordinal_zip_join", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS ordinal FROM lineitem),
b AS (SELECT l_orderkey, l_shipmode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS m FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag AS l_shipmode FROM lineitem WHERE l_quantity > 20))
SELECT a.l_orderkey, a.l_linenumber, a.ordinal, coalesce(b.l_shipmode, '') AS challenge FROM a LEFT JOIN b ON a.l_orderkey = b.l_orderkey AND a.ordinal = b.m""")
def ordinal_zip_join(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    right = l.where("l_quantity > 20").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag").alias("challenge"))
    return C.zip_join(l.select("l_orderkey", "l_linenumber", "l_partkey"), right, ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_partkey", "l_linenumber"], "challenge").select("l_orderkey", "l_linenumber", "ordinal", "challenge")


@register("asof_backward_carry", """SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'unknown') AS current FROM events""")
def asof_backward_carry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return C.carry_forward(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("props")), "current", "unknown").select("event_id", "user_id", "current")


@register("trigger_segments", """WITH s AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events)
SELECT user_id, segment::BIGINT AS segment, count(*) AS packets, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY ALL""")
def trigger_segments(spark, sf_dir):
    s = C.segments(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return s.groupBy("user_id", "segment").agg(F.count("*").alias("packets"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@register("chained_consume_join", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase'))
SELECT a.user_id, a.n::BIGINT AS n, a.event_id AS opened, b.event_id AS answered, c.event_id AS finished FROM e a JOIN e b ON a.user_id = b.user_id AND a.n = b.n AND b.event_type = 'click' LEFT JOIN e c ON b.user_id = c.user_id AND b.n = c.n AND c.event_type = 'purchase' WHERE a.event_type = 'view'""")
def chained_consume_join(spark, sf_dir):
    """Each open meets the answer of its ordinal, and that the finish of its ordinal; one shuffle by user."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'purchase')").withColumn("n", F.row_number().over(w))
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    out = e.groupBy("user_id", "n").agg(at("view").alias("opened"), at("click").alias("answered"), at("purchase").alias("finished"))
    return out.where("opened is not null and answered is not null").select("user_id", F.col("n").cast("long").alias("n"), "opened", "answered", "finished")


_SIGS = [s for s in R.FILE_SIGNATURES] + [("3c21444f4354595045", 0, "html", "", "", ""), ("3c68746d6c", 0, "html", "", "", ""), ("3c21", 0, "xml", "", "", "")]
_SIG_SQL = ", ".join(f"('{m.upper()}', {o}, '{e}', {len(m) // 2}, {-i})" for i, (m, o, e, *_) in enumerate(_SIGS))


@register("prefix_longest_match", f"""WITH s(magic, off, ext, n, i) AS (VALUES {_SIG_SQL}), p AS (SELECT page_id, hex(encode(html)) AS h FROM pages)
SELECT p.page_id, arg_max(s.ext, s.n * 1000 + s.i) AS extension FROM p LEFT JOIN s ON substr(p.h, 2 * s.off + 1, 2 * s.n) = s.magic GROUP BY 1""")
def prefix_longest_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    return C.longest_magic(p, "data", _SIGS).select("page_id", "extension")


@register("semi_join_streams", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def semi_join_streams(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@register("anti_join_streams", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join_streams(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@register("cartesian_small", "SELECT '(' || r_name || ',' || n_name || ')' AS pair FROM region, nation")
def cartesian_small(spark, sf_dir):
    """The product of two lists of fixed size."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.crossJoin(F.broadcast(n)).select(F.concat(F.lit("("), "r_name", F.lit(","), "n_name", F.lit(")")).alias("pair"))


@register("key_list_lookup", "SELECT s_suppkey, n_name, list_concat(list_concat(['custom'], [r_name]), ['default']) AS keys FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def key_list_lookup(spark, sf_dir):
    """Keys to try for each endpoint: custom, extracted, default, in this order."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", F.array(F.lit("custom"), F.col("r_name"), F.lit("default")).alias("keys"))


@register("dedup_first", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, length(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("len", F.length("text"))
    return C.keep_best(d, ["source", "lang", "len"], ["doc_id"]).select("doc_id", "source")


@register("dedup_best", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_best(spark, sf_dir):
    """The heaviest row of a key, the first on ties, by one aggregate with map-side combining."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b")).select("o_custkey", "b.*")


@register("dedup_keyset", "SELECT min(page_id) AS page_id, split_part(url, '?', 1) AS uri, count(*) AS copies FROM pages GROUP BY split_part(url, '?', 1)")
def dedup_keyset(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.split("url", r"\?")[0].alias("uri")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies")).select("page_id", "uri", "copies")


@register("md5_dedup", "SELECT md5(html) AS digest, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1")
def md5_dedup(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.md5(F.col("html").cast("binary")).alias("digest")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@register("ordered_concat", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body FROM conversations GROUP BY 1")
def ordered_concat(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("body"))


@register("running_sum_trace", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS x FROM events")
def running_sum_trace(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.sum("value").over(w), 4).alias("x"))


@register("byte_column_pivot", "WITH b AS (SELECT item_id, item_id // 8 AS stream, unnest(range(1, strlen(text) + 1)) AS place, hex(encode(text)) AS h FROM benchmark) SELECT stream, (place - 1)::INT AS at, string_agg(substr(h, 2 * place - 1, 2), '' ORDER BY item_id) AS column_hex FROM b GROUP BY ALL")
def byte_column_pivot(spark, sf_dir):
    """The i-th byte of every payload of a stream, in order: rows become columns."""
    h = table(spark, sf_dir, "benchmark").select("item_id", F.floor(F.col("item_id") / 8).alias("stream"), F.posexplode(F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit(".."), F.lit(0))).alias("at", "b"))
    parts = F.array_sort(F.collect_list(F.struct("item_id", "b")))
    return h.groupBy("stream", "at").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "").alias("column_hex"))


@register("threat_sort", """SELECT page_id, row_number() OVER (ORDER BY CASE WHEN length(html) > 20000 THEN 4 WHEN length(html) > 10000 THEN 3 WHEN length(html) > 5000 THEN 2 ELSE 0 END, page_id) AS place FROM pages""")
def threat_sort(spark, sf_dir):
    """Lowest level first, in order of arrival within one: places from ranges of (level, id) and a running sum of their counts."""
    n = F.length("html")
    level = F.when(n > 20000, 4).when(n > 10000, 3).when(n > 5000, 2).otherwise(0)
    p = table(spark, sf_dir, "pages").select("page_id", (level.cast("long") * (1 << 50) + F.col("page_id")).alias("key"))
    return C.numbered(p, "key", "place").select("page_id", "place")


_RANK = [("php", 0), ("jsp", 0), ("asp", 0), ("exe", 1), ("zip", 2), ("pdf", 3), ("js", 5), ("css", 6), ("html", 7)]


@register("file_priority_sort", "SELECT page_id, CASE " + " ".join(f"WHEN ends_with(lower(split_part(url, '?', 1)), '.{e}') THEN {r}" for e, r in _RANK) + " ELSE 8 END AS priority FROM pages")
def file_priority_sort(spark, sf_dir):
    uri = F.lower(F.split("url", r"\?")[0])
    out = F.lit(8)
    for e, r in reversed(_RANK):
        out = F.when(F.endswith(uri, F.lit(f".{e}")), r).otherwise(out)
    return table(spark, sf_dir, "pages").select("page_id", out.alias("priority")).orderBy("priority", "page_id")


@register("union_results", "SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def union_results(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").groupBy(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return c.unionByName(s)


_LISTS = "WITH l AS (SELECT n.n_nationkey AS k, list(c.c_custkey % 7 ORDER BY c.c_custkey) AS a, (SELECT list(s_suppkey % 7 ORDER BY s_suppkey) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS b FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1)"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, a, b): two lists with repeated members for every nation."""
    ordered = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), (F.col(key) % 7).alias("v")))), lambda x: x["v"])
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(ordered("c_custkey").alias("a"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(ordered("s_suppkey").alias("b"))
    return a.join(b, "k", "left").withColumn("b", F.coalesce("b", F.array().cast("array<bigint>")))


for _name, _sql, _col in [
    ("set_union", "list_sort(list_distinct(list_concat(a, coalesce(b, []))))", lambda: F.array_sort(F.array_union("a", "b"))),
    ("set_intersect_keepdup", "list_filter(a, lambda x: list_contains(coalesce(b, []), x))", lambda: F.filter("a", lambda x: F.array_contains("b", x))),
    ("set_difference_keepdup", "list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))", lambda: F.filter("a", lambda x: ~F.array_contains("b", x))),
    ("set_symmetric", "list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x)), list_filter(coalesce(b, []), lambda x: NOT list_contains(a, x))))", lambda: F.array_sort(F.concat(F.filter("a", lambda x: ~F.array_contains("b", x)), F.filter("b", lambda x: ~F.array_contains("a", x))))),
]:

    @register(_name, f"{_LISTS} SELECT k, array_to_string({_sql}, ',') AS members FROM l")
    def _set(spark, sf_dir, col=_col):
        return lists(spark, sf_dir).select("k", F.array_join(F.transform(col(), lambda x: x.cast("string")), ",").alias("members"))


@register("set_powerset", "WITH l AS (SELECT n_regionkey AS k, list(n_name ORDER BY n_nationkey) AS a FROM nation GROUP BY 1), s AS (SELECT k, a, unnest(range(0, 1 << len(a))) AS subset FROM l) SELECT k, subset::INT AS subset, array_to_string(list_filter(a, lambda x, i: (subset >> (i - 1)) & 1 = 1), ',') AS members FROM s")
def set_powerset(spark, sf_dir):
    """All subsets of each list, by the bits of their numbers."""
    lists_ = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("a"))
    subsets = lists_.select("k", "a", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, size(a))") - 1)).alias("subset"))
    return subsets.select("k", "subset", F.array_join(F.filter("a", lambda x, i: F.getbit(F.col("subset"), i) == 1), ",").alias("members"))


@register("tree_ancestors", """WITH RECURSIVE t(id, name, parent) AS (SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region), u AS (SELECT id, name, parent FROM t WHERE contains(name, 'A') UNION SELECT t.id, t.name, t.parent FROM t JOIN u ON t.id = u.parent) SELECT DISTINCT id, name FROM u""")
def tree_ancestors(spark, sf_dir):
    """Nodes whose name matches, with all of their ancestors."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nodes = n.unionByName(r)
    return spark.sql("WITH RECURSIVE u(id, name, parent) AS (SELECT id, name, parent FROM {t} WHERE contains(name, 'A') UNION ALL SELECT t.id, t.name, t.parent FROM {t} t JOIN u ON t.id = u.parent) SELECT DISTINCT id, name FROM u", t=nodes)
