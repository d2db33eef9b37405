"""Weighted rule scoring: each rule that matches a payload adds its weight; sums become levels.

Rules are unrolled into literal patterns, so Catalyst compiles each once per task and all of a detector stays in one
projection. A pattern runs only on texts that contain one of the words it cannot match without (derived from the pattern),
so most rules cost a substring search. Weights, names and thresholds are in rules.
"""

from __future__ import annotations

import json
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bind, traversal_depth, url_decoded
from ..rules import fixed as R
from ..rules import webshell as W

#: Detector, its rules, the least weight that counts as detected, and its rank among equal weights.
DETECTORS = [("upload", R.UPLOAD, 50, 3), ("rce", R.RCE, 50, 5), ("cmdi", R.CMDI, 50, 8), ("sqli", R.SQLI, 40, 10), ("xss", R.XSS, 40, 15), ("xxe", R.XXE, 50, 20), ("ssrf", R.SSRF, 50, 25), ("traversal", R.TRAVERSAL, 50, 30), ("deser", R.DESER, 50, 35)]
THRESHOLD = {name: least for name, _, least, _ in DETECTORS}
OWN = len(DETECTORS)


def register_detector(name: str, rules: dict[str, tuple[str, int]], least: int = 40, rank: int = 100) -> None:
    """Add a detector, rules of name -> (pattern, weight), to those of attack_scores(); its column is w_<name>."""
    if any(name == n for n, *_ in DETECTORS):
        raise ValueError(f"{name} is registered twice")
    DETECTORS.append((name, rules, least, rank))
    THRESHOLD[name] = least


def forget_detector(name: str) -> None:
    """Take a registered detector out again; the engine's own ones stay."""
    DETECTORS[OWN:] = [d for d in DETECTORS[OWN:] if d[0] != name]


NOISE, DOUBLE_FROM, DOUBLE_TO = R.NOISE, R.DOUBLE_FROM, R.DOUBLE_TO


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case words of which a match of the pattern contains one at least; none if no such words are known."""
    from re import _parser as P

    def best(options: list[tuple[str, ...]]) -> tuple[str, ...]:
        return max((o for o in options if o), key=lambda o: (min(map(len, o)), -len(o)), default=())

    def of(sequence) -> tuple[str, ...]:
        options, run = [], ""
        for op, arg in [*sequence, (None, None)]:
            if op is P.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if run:
                options.append((run,))
            run = ""
            if op is P.SUBPATTERN:
                options.append(of(arg[-1]))
            elif op in (P.MAX_REPEAT, P.MIN_REPEAT) and arg[0] >= 1:
                options.append(of(arg[2]))
            elif op is P.BRANCH:
                parts = [of(x) for x in arg[1]]
                if all(parts):
                    options.append(tuple(sorted({w for p in parts for w in p})))
        return best(options)

    words = of(P.parse(pattern))
    return words if words and min(map(len, words)) >= 2 else ()


def hit(text: Column, pattern: str, dotall: bool = True) -> Column:
    found = text.rlike(("(?is)" if dotall else "(?i)") + pattern)
    words = needed(pattern)
    if not words:
        return found
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) & found


def rule_weight(text: Column, rules: dict[str, tuple[str, int]]) -> Column:
    """Sum of the weights of the rules that match, each once."""
    return total([F.when(hit(text, p), w).otherwise(0) for p, w in rules.values()])


def rule_names(text: Column, prefix: str, rules: dict[str, tuple[str, int]]) -> Column:
    """Names of the rules that match, in the rules' order."""
    return F.filter(F.array(*[F.when(hit(text, p), F.lit(f"{prefix}:{n}")) for n, (p, _) in rules.items()]), lambda x: x.isNotNull())


def odd_quotes(text: Column) -> Column:
    """Whether unescaped single or double quotes are odd in number within the first 10 000 characters."""
    head = F.substring(text, 1, 10_000)

    def count(what: str) -> Column:
        return (F.length(head) - F.length(F.replace(head, F.lit(what), F.lit("")))) / len(what)

    return ((count("'") - count("\\'")) % 2 != 0) | ((count('"') - count('\\"')) % 2 != 0)


def first_of(text: Column, weights: dict[str, int]) -> Column:
    """The weight of the first listed word that occurs in the text, else 0."""
    low = F.lower(text)
    out = F.lit(0)
    for word, w in reversed(weights.items()):
        out = F.when(F.contains(low, F.lit(word.lower())), w).otherwise(out)
    return out


def sqli_weight(text: Column) -> Column:
    return rule_weight(text, R.SQLI) + rule_weight(text, R.WAF_BYPASS) + F.when(odd_quotes(text), 20).otherwise(0)


def xml_like(text: Column) -> Column:
    up = F.upper(text)
    return F.contains(up, F.lit("<?XML")) | F.contains(up, F.lit("<!DOCTYPE")) | F.contains(up, F.lit("<!ENTITY")) | F.startswith(F.regexp_replace(text, r"^\s+", ""), F.lit("<"))


def xxe_weight(text: Column) -> Column:
    return F.when(xml_like(text), rule_weight(text, R.XXE) + first_of(text, R.DANGEROUS_PROTOCOLS)).otherwise(0)


def traversal_weight(text: Column) -> Column:
    """Rules on the text and, where it differs, on the decoded text, plus depth and the first sensitive file."""

    def plain_weight(plain: Column) -> Column:
        return bind(traversal_depth(plain), lambda d: F.when(d >= 2, d * 20).otherwise(0)) + first_of(plain, R.SENSITIVE_FILES)

    decoded = bind(url_decoded(text, 5), lambda p: F.when(p != text, rule_weight(p, R.TRAVERSAL)).otherwise(0) + plain_weight(p))
    return rule_weight(text, R.TRAVERSAL) + F.when(F.contains(text, F.lit("%")), decoded).otherwise(plain_weight(text))


def upload_weight(text: Column, method: Column, content_type: Column) -> Column:
    """Upload rules, dangerous and doubled extensions of each file name, and 20 more for multipart with any evidence."""
    multipart = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("multipart/form-data"))
    names = F.transform(F.concat(F.regexp_extract_all(text, F.lit(r"(?i)filename\s*=\s*[\"']?([^\"';\r\n]+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"/([^/\s?]+\.\w{2,5})(?:\?|$|\s)"), F.lit(1))), F.lower)

    def extension(name: Column) -> Column:
        out = F.lit(0)
        for ext, w in reversed(R.DANGEROUS_EXTENSIONS.items()):
            out = F.when(F.endswith(name, F.lit(ext)), w).otherwise(out)
        return out

    def doubled(name: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(name, F.lit(d)) for d in DOUBLE_FROM]) & reduce(lambda a, b: a | b, [F.endswith(name, F.lit(i)) for i in DOUBLE_TO])

    files = F.aggregate(names, F.lit(0), lambda a, n: a + extension(n) + F.when(doubled(n), 90).otherwise(0))
    weight = rule_weight(text, R.UPLOAD) + files
    return F.when(multipart | F.upper(method).isin("PUT", "POST"), weight + F.when(multipart & (weight > 0), 20).otherwise(0)).otherwise(0)


def weights(text: Column, method: Column, content_type: Column) -> dict[str, Column]:
    """Each detector's weight of a payload."""
    return {
        "upload": upload_weight(text, method, content_type),
        "rce": rule_weight(text, R.RCE),
        "cmdi": rule_weight(text, R.CMDI),
        "sqli": sqli_weight(text),
        "xss": rule_weight(text, R.XSS),
        "xxe": xxe_weight(text),
        "ssrf": rule_weight(text, R.SSRF),
        "traversal": traversal_weight(text),
        "deser": rule_weight(text, R.DESER),
    } | {name: rule_weight(text, rules) for name, rules, *_ in DETECTORS[OWN:]}


def level(weight: Column) -> Column:
    return F.when(weight >= 200, "critical").when(weight >= 150, "high").when(weight >= 80, "medium").when(weight >= 40, "low").otherwise("info")


def noise(uri: Column) -> Column:
    """What harmless URIs take off a weight."""
    return total([F.when(hit(uri, p), w).otherwise(0) for p, w in NOISE])


def json_leaves(text: str | None, depth: int = 10, least: int = 2) -> list[str] | None:
    """String leaves of more than `least` characters down to a depth, in order; None for what is not JSON."""
    try:
        todo, out = [(json.loads(text or ""), 0)], []
    except (ValueError, RecursionError):
        return None
    while todo:
        value, at = todo.pop()
        if isinstance(value, str) and len(value) > least:
            out.append(value)
        elif isinstance(value, dict | list) and at <= depth:
            todo += [(v, at + 1) for v in reversed(list(value.values()) if isinstance(value, dict) else value) if at < depth]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def leaves(text: pd.Series) -> pd.Series:
    return pd.Series([json_leaves(t) if t is not None else None for t in text], dtype=object)


def sampled(text: Column, most: int = 1 << 20, end: int = 1 << 16, middle: int = 4096) -> Column:
    """Texts of over `most` characters as (offset, part): head, three places between, tail; others whole."""
    n = F.length(text)
    part = lambda at, size: F.struct(at.cast("long").alias("offset"), F.substring(text, at.cast("int") + 1, size).alias("part"))
    parts = [part(F.lit(0), F.lit(end)), *[part(F.floor(n * r), F.lit(middle)) for r in (0.25, 0.5, 0.75)], part(n - end, F.lit(end))]
    return F.when(n > most, F.array(*parts)).otherwise(F.array(part(F.lit(0), n)))


def code_like(text: Column) -> Column:
    """Whether the first 5000 characters look like code."""
    return bind(F.substring(text, 1, 5000), lambda t: reduce(lambda a, b: a | b, [hit(t, p, dotall=False) for p in W.CODE_LIKE]))


def sink_weight(name: Column, detector: str) -> Column:
    """A called function's weight for a detector: the sink of that name, else the first that holds it or is held by it, else 0."""
    low = F.lower(name)
    exact, near = F.lit(None).cast("int"), F.lit(0)
    for sink, w in reversed(W.SINKS[detector]):
        exact = F.when(low == sink, w).otherwise(exact)
        near = F.when(F.contains(low, F.lit(sink)) | F.contains(F.lit(sink), low), w).otherwise(near)
    return F.coalesce(exact, near)


def sink_boost(weight: Column, calls: Column, obfuscation: Column, adjustment: Column, detector: str, least: int = 20) -> Column:
    """A detector's weight after program analysis: calls is an array of (name, tainted). Tainted sinks add their weights and the
    adjustment; sinks without taint take a third off weights under 100, at most 30; hidden code adds up to 30."""
    sinks = F.transform(calls, lambda c: F.struct(sink_weight(c["name"], detector).alias("w"), c["tainted"].alias("t")))
    known = F.filter(sinks, lambda s: s["w"] > 0)
    dirty = F.filter(known, lambda s: s["t"])
    tainted = F.aggregate(dirty, F.lit(0), lambda a, s: a + s["w"])
    changed = F.when(F.size(dirty) > 0, weight + tainted + adjustment).when((F.size(known) > 0) & (weight < 100), weight - F.least(F.lit(30), F.floor(weight / 3).cast("int"))).otherwise(weight)
    return F.when(weight < least, weight).otherwise(changed + F.when(obfuscation > 0.5, F.floor(obfuscation * 30).cast("int")).otherwise(0))


def attack_scores(df: DataFrame, text: str, method: Column | None = None, uri: Column | None = None, content_type: Column | None = None) -> DataFrame:
    """df with w_<detector>, total_weight, detected, attack_type (heaviest; ties by rank) and threat_level.

    With a content type, JSON bodies are scored by their string leaves where that matters, and count half without any."""
    method, uri, ctype = (F.lit("GET") if method is None else method), (F.lit("") if uri is None else uri), (F.lit("") if content_type is None else content_type)
    given = df.columns
    body = F.coalesce(F.col(text), F.lit(""))
    if content_type is None:
        scored = df.withColumns({f"w_{n}": w.cast("int") for n, w in weights(body, method, ctype).items()} | {"_empty_json": F.lit(False)})
    else:
        with_leaves = df.withColumn("_leaves", leaves(F.when(F.contains(F.lower(ctype), F.lit("application/json")), body)))
        values = F.when(F.size("_leaves") > 0, F.array_join("_leaves", " ")).otherwise(body)
        own = weights(body, method, ctype) | {n: w for n, w in weights(values, method, ctype).items() if n in ("sqli", "xss", "ssrf")}
        scored = with_leaves.withColumns({f"w_{n}": w.cast("int") for n, w in own.items()} | {"_empty_json": F.coalesce(F.size("_leaves") == 0, F.lit(False))})
    raw = total([F.col(f"w_{n}") for n, *_ in DETECTORS])
    heaviest = F.array_max(F.array(*[F.struct(F.col(f"w_{n}").alias("w"), F.lit(-rank).alias("r"), F.lit(n).alias("n")) for n, _, _, rank in DETECTORS]))
    less = F.greatest(F.lit(0), F.when(F.col("_empty_json"), F.floor(raw / 2).cast("int")).otherwise(raw) + noise(uri))
    out = scored.withColumns({"total_weight": less, "detected": raw >= 40, "attack_type": F.when(heaviest["w"] > 0, heaviest["n"]), "threat_level": level(less)})
    return out.select(*[c for c in given if not c.startswith("w_")], *[f"w_{n}" for n, *_ in DETECTORS], "total_weight", "detected", "attack_type", "threat_level")


def detect_attack(spark, data: str, method: str = "GET", uri: str = "/", content_type: str = "") -> dict:
    """One payload through all detectors."""
    row = attack_scores(spark.createDataFrame([(data,)], "t string"), "t", F.lit(method), F.lit(uri), F.lit(content_type)).drop("t").first()
    return row.asDict()


def is_malicious(spark, data: str, threshold: int = 40) -> bool:
    return detect_attack(spark, data)["total_weight"] >= threshold


def attack_types(spark, data: str) -> list[str]:
    return [detect_attack(spark, data)["attack_type"] or "unknown"]


# Web shells: indicator lists, parameter names, confidence.


def indicator_weight(text: Column, indicators: list[tuple[str, str, int, bool]], divide: int = 1) -> Column:
    return total([F.when(hit(text, p, dotall), w // divide).otherwise(0) for _, p, w, dotall in indicators])


def indicator_names(text: Column, indicators: list[tuple[str, str, int, bool]]) -> Column:
    return F.filter(F.array(*[F.when(hit(text, p, dotall), F.lit(n)) for n, p, _, dotall in indicators]), lambda x: x.isNotNull())


def param_weight(name: Column) -> Column:
    """The weight of the first suspicious pattern of a parameter's name; listed harmless names weigh nothing."""
    out = F.lit(0)
    for _, p, w in reversed(R.SUSPICIOUS_PARAMS):
        out = F.when(name.rlike("(?i)" + p), w).otherwise(out)
    return F.when(F.lower(name).isin(R.PARAM_NAME_WHITELIST), 0).otherwise(out)


def confidence(weight: Column) -> Column:
    return F.when(weight >= 100, "high").when(weight >= 75, "medium").when(weight >= 60, "low").when(weight >= 30, "suspicious").otherwise("none")
