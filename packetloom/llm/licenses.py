"""License scans (op 3): base phrases, and licence texts found by diagonal voting.

Every text becomes words; all windows of `k` words whose words occur in a template at all (others can match none) are
hashed and joined to the templates' positions, which is a broadcast of a table of fixed size. A match votes for its
diagonal, the offset between text and template; votes are counted by document, template and diagonal, diagonals at
most `slack` apart are merged, which bridges inserted or dropped words. A span is verified by its words: those of the
template that windows of equal text cover on its diagonals must make up `least` of the template and of the stretch of
text that they span, so votes scattered over a text or drifting across many diagonals are none. Copies of a text are voted
on once. Templates are notices and whole texts; a whole text's notice is reported with it.

Nulls: a null text is empty; rows with a null id are scanned alike. Repeated rows give equal rows; ties between templates
keep all labels. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .common import materialize, text_map
from .license_texts import TEMPLATES

#: The base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base", "array<string>"), ("pos", "array<int>"), ("h", "array<long>"), ("g", "array<string>"), ("mark", "long")]


def words_of(t: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, and starts, ends and hashes of their words."""
    b = K.LOWER[K.raw(t)]
    starts, ends = K.spans(K.ALNUM[b])
    return b, starts, ends, K.span_hash(K.prefix_hash(b), starts, ends) if len(starts) else np.empty(0, np.uint64)


def split_words(t: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def scan(docs: DataFrame, k: int, templates: list[tuple[str, str]]) -> DataFrame:
    """doc_id and FIELDS: words, base places, and the windows whose words all occur in a template."""
    vocabulary = np.unique(np.array([words_of(w.encode())[3][0] for _, t in templates for w in split_words(t)], np.uint64))
    phrases = [([w.encode() for w in p.split()], label) for p, label in PHRASES]
    firsts = [np.concatenate([words_of(w)[3] for w in p]) for p, _ in phrases]

    def run(texts):
        rows = []
        for t in texts:
            b, s, e, h = words_of(t)
            places, labels = [], []
            for (p, label), want in zip(phrases, firsts, strict=True):
                n = len(h) - len(p) + 1
                if n <= 0:
                    continue
                hit = np.ones(n, bool)
                for j, v in enumerate(want):
                    hit &= h[j : j + n] == v
                own = [i for i in np.flatnonzero(hit).tolist() if all(b[s[i + j] : e[i + j]].tobytes() == w for j, w in enumerate(p))]
                if own:
                    places += own
                    labels.append(label)
            at, h_at, g_at = [], [], []
            if len(h) >= k:
                i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                found = np.flatnonzero(np.convolve(vocabulary[i] == h, np.ones(k, int), "valid") == k)
                if len(found):
                    at, h_at = found.tolist(), K.shingle_hashes(h, k)[found].view(np.int64).tolist()
                    text = [b[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(s.tolist(), e.tolist(), strict=True)] if len(found) * 8 > len(h) else None
                    word = (lambda j: text[j]) if text else (lambda j: b[s[j] : e[j]].tobytes().decode("utf-8", "replace"))
                    g_at = [" ".join(word(j) for j in range(x, x + k)) for x in at]
            mark = int(K.span_hash(K.prefix_hash(b), np.array([0]), np.array([len(b)]))[0].view(np.int64)) if at else None
            rows.append((len(h), len(places), min(places, default=None), max(places, default=None), labels, at, h_at, g_at, mark))
        return [list(c) for c in zip(*rows, strict=True)]

    return text_map(docs, run, FIELDS)


def template_grams(spark, k: int, templates: list[tuple[str, str]]) -> DataFrame:
    """(h, g, template, label, tpos, size): every window of every template; a table of fixed size."""
    rows = []
    for i, (label, t) in enumerate(templates):
        w = split_words(t)
        h = K.shingle_hashes(np.concatenate([words_of(x.encode())[3] for x in w]), k)
        rows += [(int(h[j].view(np.int64)), " ".join(w[j : j + k]), i, label, j, len(w)) for j in range(len(h))]
    return spark.createDataFrame(rows, "h long, g string, template int, label string, tpos int, size int")


def find_licenses(docs: DataFrame, k: int = 3, slack: int = 3, least: float = 0.75, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    templates = templates or TEMPLATES
    found = materialize(scan(docs.select("doc_id", "text"), k, templates), "licenses")
    key = ["doc_id", "mark"]
    grams = found.where("mark is not null").dropDuplicates(key).select(*key, F.explode(F.arrays_zip("pos", "h", "g")).alias("x")).select(*key, "x.*")
    table = template_grams(docs.sparkSession, k, templates)
    votes = grams.join(F.broadcast(table.withColumnRenamed("g", "tg")), "h").where("g = tg").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    by_diagonal = votes.groupBy(*key, "template", "label", "size", "diagonal").agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= slack, 0).otherwise(1)
    merged = by_diagonal.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(order))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("at")), lambda t: F.sequence(t, t + (k - 1)))))
    spans = merged.groupBy(*key, "template", "label", "size", "band").agg(F.size(covered).alias("n"), (F.max("hi") + k - F.min("lo")).alias("span")).withColumn("share", F.col("n") / F.greatest("size", "span")).where(F.col("share") >= least)
    best = spans.groupBy(*key).agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("share").alias("share"))
    best = best.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "more", "share")
    joined = found.join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    none = F.array().cast("array<string>")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"), score.alias("score"))
