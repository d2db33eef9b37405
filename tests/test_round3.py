"""Findings of round 3: each case differed from its SQL, or did not end in time, before."""

import datetime

from pyspark.sql import functions as F

from packetloom import catalog
from packetloom.functions import text as X

from .conftest import normal


def both(spark, tmp_path, name: str, **tables):
    """Rows of a query and of its SQL over given tables, as sorted tuples."""
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for n, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{tmp_path}/{n}.parquet/*.parquet')")
    return normal(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), normal(c.execute(catalog.ORACLES[name]).df())


def test_rtp_jitter_rounds_once(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    # The smoothed jitter of the second stream is 0.0499375 ms: 0.0 at one digit, 0.05 at three and 0.1 rounded twice.
    at = [(1, 1, 0), (200_000, 1, 5_000_000), (2, 2, 0), (3, 2, 20_799), (4, 3, 0), (70_004, 3, 10)]
    events = spark.createDataFrame([(e, u, base + datetime.timedelta(microseconds=t)) for e, u, t in at], "event_id long, user_id long, ts timestamp")
    got, want = both(spark, tmp_path, "rtp_jitter", events=events)
    assert got == want
    rows = spark.createDataFrame([(0.04996, 0), (0.05, 1), (2.5, 2)], "x double, i int")
    assert [r["x"] for r in rows.orderBy("i").select(X.rounded(F.col("x"), 1).alias("x")).collect()] == [0.0, 0.1, 2.5]


ODD = [(1, None), (2, ""), (3, "a"), (4, "aabéé你"), (5, "Kelvin K and İ with \U0001f600 letters enough"), (6, "(x)=[y];{z}" * 4), (7, "YWJj" * 10 + "=="), (8, "naïve ٣½ \x01\x02 text, long enough for weights"), (9, "é" * 30)]


def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in ODD], "doc_id long, text string")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_char_entropy_of_odd_texts(spark, tmp_path):
    got, want = both(spark, tmp_path, "char_entropy", documents=odd(spark))
    assert got == want


def test_byte_entropy_of_odd_texts(spark, tmp_path):
    rows = odd(spark).union(spark.createDataFrame([(3, "bbbbb"), (3, None), (10, None), (10, ""), (None, "ab")], "doc_id long, text string"))
    got, want = both(spark, tmp_path, "byte_entropy", documents=rows)
    assert got == want


def test_chi2_english_counts_once(spark, tmp_path):
    got, want = both(spark, tmp_path, "chi2_english", documents=odd(spark))
    assert got == want
    p = plan(catalog.QUERIES["chi2_english"](spark, str(tmp_path)))
    assert p.count("EvalPython") == 1 and "regexp_replace" not in p


def test_stat_body_weight_counts_once(spark, tmp_path):
    got, want = both(spark, tmp_path, "stat_body_weight", documents=odd(spark).where("text is not null"))
    assert got == want
    p = plan(catalog.QUERIES["stat_body_weight"](spark, str(tmp_path)))
    assert p.count("EvalPython") == 1 and "regexp_replace" not in p


def test_xor_trial_is_quick_and_exact():
    """Characters were judged one by one for each key: 2.0 s of CPU a MB of markup, now 0.08 s."""
    import base64
    import time

    from packetloom.operators import webshell as E
    from packetloom.rules.fixed import GODZILLA_DEFAULT_KEYS as KEYS

    for t, want in [("abc\x7f" * 5, False), ("echo 'x';" + "\x01" * 1, False), ("x" * 97 + "é", True), ("eval(é)" + " " * 20, True), ("abcd", False)]:
        assert E.looks_decrypted(t) == want
    code = b"<?php eval($_POST['x']); ?>"
    mixed = lambda b, k: bytes(x ^ k[i % len(k)] for i, x in enumerate(b))
    for inner in (code, base64.b64encode(code), base64.b64encode(code + b"!") + b"=="):
        assert E.xor_trial(base64.b64encode(mixed(inner, b"z")).decode(), ["z"])[1] == "z"
    markup = "~" + "<p>ordinary words, 12 of them</p> " * 90_000
    start = time.process_time()
    assert E.xor_trial(markup, KEYS) is None
    assert time.process_time() - start < 2


def test_levenshtein_of_one_long_line(spark):
    """A text of one line against itself took 4e10 steps."""
    from packetloom.functions.transforms import TEXT

    rows = spark.createDataFrame([(1, "ab" * 100_000), (2, "kitten\nx\nsitting"), (3, None), (4, "")], "i int, x string")
    assert [r["d"] for r in rows.selectExpr("i", TEXT["levenshtein_first_last_line"] + " as d").orderBy("i").collect()] == ["0", "3", None, "0"]


def test_fast_filter_looks_where_signs_stand(spark, tmp_path):
    texts = ["plain words only, nothing else", "eval ($_GET[x]); EVAL(", "PHP://input and more text", "$x->($y) ${a}", "a ->(b) c d e f", "$$ ::$ $globals $GLOBALS", "file\t( 'a' ) include(", "eval without a call", "(((((((((((((", "é" * 12 + "exec("]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, want = both(spark, tmp_path, "fast_filter_decision", documents=rows)
    assert sorted(set(got[1]) ^ set(want[1])) == []
    assert plan(catalog.QUERIES["fast_filter_decision"](spark, str(tmp_path))).count("WHEN Contains(") >= 3
