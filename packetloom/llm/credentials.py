"""Secret scans (op 2): pattern scans plus multipart credential linking, in DataFrame functions alone.

Base kinds (assign, access, hex) are leftmost non-overlapping matches; their spans are whole matches in code points.
Multipart linking adds weak parts, which alone mean little: identifiers (client or key ids), secret-like values and
endpoints. All parts, base ones included, are laid on the axis of their document, and an interval join over scopes of
`scope` code points keeps a weak part only where complementary parts start near it:

    id        near a secret part (a base match or a weak value)
    value     near an identifier or access key, or an endpoint that itself has an identifier near
    endpoint  near an identifier (or access key) and a secret part

The interval join is an equi-join of buckets as long as the scope: a part looks up, in its own and both neighbouring
buckets, the first and last starts there of each role, which decide nearness exactly, so no pairs are formed and a
document full of parts costs as many rows as it has parts. The endpoints found near an identifier are summed up by bucket
in the same way for the values that have none near.

Places come from splitting at the pattern: the lengths of the pieces and of the matches between them add up to starts.

Nulls: a null text is empty; rows with a null id are scanned like others. Rows of one id share scopes only if their texts
are equal, so repeated rows give equal results and ties do not mix. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def either_case(word: str) -> str:
    """A pattern for a word's letters in either case, spelt out so that all regex dialects agree."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() and c.isascii() else c for c in word)


#: The base patterns, in the order that ties sort by. group: the part whose length counts, and its minimum.
ASSIGN = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
#: Weak parts of multipart credentials; roles i (identifier), s (secret value), e (endpoint).
ID = "(" + either_case("client") + "|" + either_case("account") + "|" + either_case("access") + "|" + either_case("user") + ")_?(" + either_case("id") + "|" + either_case("key") + "|" + either_case("name") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
VALUE = "(" + either_case("pwd") + "|" + either_case("signature") + "|" + either_case("credential") + "|" + either_case("private") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ENDPOINT = r"(https?|wss?|amqps?|postgres|mysql|redis|mongodb)://([A-Za-z0-9._~:/?#@%&=+-]+)"
WEAK = [("id", ID, 3, 6, "i"), ("value", VALUE, 2, 8, "s"), ("endpoint", ENDPOINT, 2, 4, "e")]
ROLE = {"assign": "s", "access": "i", "hex": "s"} | {k: r for k, _, _, _, r in WEAK}
ORDER = ["assign", "access", "hex", "id", "value", "endpoint"]


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, ord, finish) of the pattern's matches whose group has at least `least` characters."""
    found, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), part.alias("g"), F.slice(pieces, F.lit(1), F.size(found)).alias("p")) if group else F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,o:int,e:int>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        hit = F.array(F.struct(start.alias("s"), F.lit(ORDER.index(kind)).alias("o"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(F.length(x["g" if group else "m"]) >= least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<s:int,o:int,e:int>>")
    return F.when(text.rlike(long_enough(pattern, least)), F.aggregate(rows, zero, step, lambda a: a["out"])).otherwise(empty)


def long_enough(pattern: str, least: int) -> str:
    """The pattern with its last run, the one that counts, of `least` characters or more: most texts fail it at once."""
    head, plus, tail = pattern.rpartition("+")
    fixed = 4 if head.startswith("AKIA") else 0
    return head + "{%d,}" % (least - fixed) + tail


def with_spans(docs: DataFrame, scope: int = 200, most: int = 200_000) -> DataFrame:
    """docs with __pl_base, the base spans, and __pl_spans, those and the linked weak ones; each in order of (s, o, e).

    The linked spans go to the texts where there are at most `most` (some 10 MB); otherwise both are shuffled by id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = BASE + [w[:4] for w in WEAK]
    none = F.array().cast("array<struct<s:int,o:int,e:int>>")
    found = docs.withColumns({f"__pl_{k[0]}": matches(text, *k) for k in kinds})
    base = F.array_sort(F.concat(*[F.col(f"__pl_{k[0]}") for k in BASE]))
    weak = F.concat(*[F.col(f"__pl_{w[0]}") for w in WEAK])
    rows = found.select(*docs.columns, base.alias("__pl_base"), weak.alias("__pl_weak"), F.when(F.size(weak) > 0, F.md5(text)).alias("__pl_mark"))
    some = rows.where("__pl_mark is not null").select("doc_id", F.col("__pl_mark").alias("mark"), F.concat("__pl_base", "__pl_weak").alias("parts"))
    linked = materialize(link(some.dropDuplicates(["doc_id", "mark"]), scope), "linked").select(F.col("doc_id").alias("__pl_d"), F.col("mark").alias("__pl_k"), F.col("weak").alias("__pl_linked"))
    spans = linked.agg(F.sum(F.size("__pl_linked")).alias("n")).first()["n"] or 0
    joined = rows.join(F.broadcast(linked) if spans <= most else linked, F.col("doc_id").eqNullSafe(F.col("__pl_d")) & (F.col("__pl_mark") == F.col("__pl_k")), "left")
    return joined.select(*docs.columns, "__pl_base", F.array_sort(F.concat("__pl_base", F.coalesce("__pl_linked", none))).alias("__pl_spans"))


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_weak (linked weak spans)."""
    rows = with_spans(docs.select("doc_id", "text"), scope)

    def count(kind: str) -> Column:
        return F.size(F.filter("__pl_base", lambda x: x["o"] == ORDER.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k[0]) for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("__pl_base")), 256).alias("base_sha256"), written(F.col("__pl_spans")).alias("spans"), (F.size("__pl_spans") - F.size("__pl_base")).cast("long").alias("n_weak"))


def redact(docs: DataFrame, scope: int = 200) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans go under the first one's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = F.array(*map(F.lit, ORDER))

    def step(acc, x):
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.element_at(kinds, x["o"] + 1), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    new = F.aggregate("__pl_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return with_spans(docs, scope).withColumn("__pl_text", F.when(F.size("__pl_spans") > 0, new).otherwise(F.col("text"))).select(*[F.col("__pl_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ORDER)), x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def link(rows: DataFrame, scope: int) -> DataFrame:
    """(doc_id, mark, weak): the weak parts that have their complements within the scope."""
    parts = rows.select("doc_id", "mark", F.explode("parts").alias("x")).select("doc_id", "mark", "x", F.col("x.s").alias("s"), F.element_at(F.array(*[F.lit(ROLE[k]) for k in ORDER]), F.col("x.o") + 1).alias("r"))
    parts = parts.withColumn("bucket", F.floor(F.col("s") / scope))
    key = ["doc_id", "mark"]
    ends = [g(F.when(F.col("r") == r, F.col("s"))).alias(f"{n}_{r}") for r in "ise" for n, g in (("lo", F.min), ("hi", F.max))]
    sums = parts.groupBy(*key, "bucket").agg(*ends)
    weak = parts.where(F.col("x.o") >= 3)
    near = weak.select(*key, "x", "s", "r", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("b"))
    other = sums.select(F.col("doc_id").alias("d"), F.col("mark").alias("k"), F.col("bucket").alias("b2"), *[f"{n}_{r}" for r in "ise" for n in ("lo", "hi")])
    joined = near.join(other, near.doc_id.eqNullSafe(F.col("d")) & (near.mark == F.col("k")) & (near.b == F.col("b2")))

    def close(r: str) -> Column:
        return F.coalesce((F.abs(F.col(f"lo_{r}") - F.col("s")) <= scope) | (F.abs(F.col(f"hi_{r}") - F.col("s")) <= scope), F.lit(False))

    seen = joined.groupBy(*key, "x", "r").agg(*[F.max(close(r)).alias(f"has_{r}") for r in "ise"])
    keep = F.when(F.col("r") == "i", F.col("has_s")).when(F.col("r") == "s", F.col("has_i")).otherwise(F.col("has_i") & F.col("has_s"))
    at = F.floor(F.col("x.s") / scope)
    hops = seen.where("r = 'e' and has_i").groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("k"), at.alias("b2")).agg(F.min("x.s").alias("lo_h"), F.max("x.s").alias("hi_h"))
    far = seen.where("r = 's' and not has_i").select(*key, "x", F.col("x.s").alias("s"), F.explode(F.array(at - 1, at, at + 1)).alias("b"))
    second = far.join(hops, far.doc_id.eqNullSafe(F.col("d")) & (far.mark == F.col("k")) & (far.b == F.col("b2"))).where(close("h")).select(*key, "x").distinct()
    return seen.where(keep).select(*key, "x").union(second).groupBy(*key).agg(F.collect_list("x").alias("weak"))


def oracle() -> str:
    """The same rows in DuckDB SQL; nearness is tested part by part."""

    def list_of(kind: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""list_filter(list_transform(range(1, len({kind}_m) + 1), lambda i: {{'s': list_sum(list_transform({kind}_p[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform({kind}_m[1:i-1], lambda y: length(y))), 0)::BIGINT, 'o': {ORDER.index(kind)}, 'e': (list_sum(list_transform({kind}_p[1:i], lambda y: length(y))) + list_sum(list_transform({kind}_m[1:i], lambda y: length(y))))::BIGINT, 'g': length({kind}_g[i])}}), lambda z: z.g >= {least})"""

    kinds = BASE + [w[:4] for w in WEAK]
    raw_ = ", ".join(f"regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}', 0) AS {k}_m, regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}', {g}) AS {k}_g, string_split_regex(t, '{p.replace(chr(39), chr(39) * 2)}') AS {k}_p" for k, p, g, _ in kinds)
    lists = ", ".join(f"{list_of(*k)} AS {k[0]}" for k in kinds)
    name = "['" + "','".join(ORDER) + "']"
    role = "['" + "','".join(ROLE[k] for k in ORDER) + "']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS MATERIALIZED (SELECT rid, doc_id, {raw_} FROM d),
f AS MATERIALIZED (SELECT rid, doc_id, {lists} FROM m),
p AS MATERIALIZED (SELECT rid, unnest(list_concat({", ".join(k[0] for k in kinds)})) AS x FROM f),
q AS (SELECT rid, x.s AS s, x.o AS o, x.e AS e, {role}[x.o + 1] AS r FROM p),
w AS (SELECT a.rid, a.s, a.o, a.e, a.r, bool_or(b.r = 'i') AS i, bool_or(b.r = 's') AS v FROM q a JOIN q b ON a.rid = b.rid AND abs(a.s - b.s) <= 200 WHERE a.o >= 3 GROUP BY ALL),
h AS (SELECT rid, s FROM w WHERE r = 'e' AND i),
l AS (SELECT rid, s, o, e FROM q WHERE o < 3 UNION ALL SELECT rid, s, o, e FROM w WHERE (r = 'i' AND v) OR (r = 's' AND (i OR EXISTS (SELECT 1 FROM h WHERE h.rid = w.rid AND abs(h.s - w.s) <= 200))) OR (r = 'e' AND i AND v)),
g AS (SELECT rid, string_agg({name}[o + 1] || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans, string_agg({name}[o + 1] || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER (o < 3) AS base, count(*) FILTER (o >= 3) AS n_weak FROM l GROUP BY rid)
SELECT f.doc_id, len(f.assign)::BIGINT AS n_assign, len(f.access)::BIGINT AS n_access, len(f.hex)::BIGINT AS n_hex, sha256(coalesce(g.base, '')) AS base_sha256, coalesce(g.spans, '') AS spans, coalesce(g.n_weak, 0)::BIGINT AS n_weak
FROM f LEFT JOIN g ON f.rid = g.rid"""
