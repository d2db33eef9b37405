"""Quality rules (op 7): counted base rules and a hashed n-gram logistic regression with calibrated probabilities.

The model has two families of hashed features, words (one and two in a row) and characters (four bytes in a row). A
document's score is a bias plus the mean weight of its n-grams in each family, so long and short texts compare. It is
trained by full-batch Adam on a bounded sample of labelled rows (`sample`, the rows with the smallest hash of their id),
calibrated by Platt scaling on rows held out of the training, and applied in Arrow batches against a fixed threshold.

Nulls: a null text is empty (no words: the base rules fail it); labels with a null id or quality are left out. Without
labels of both classes there is no model and the base rules decide alone. Repeated rows are scored alike, one by one; of
several texts with one labelled id the least is trained on. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import text_map

BITS = 16
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("low_quality_p", "double")]


@dataclass
class Model:
    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float
    shift: float
    threshold: float

    def probability(self, b: np.ndarray, h: np.ndarray) -> float:
        """Calibrated probability that a text is of low quality."""
        word, char = features(b, h)
        z = self.bias + (self.word[word].mean() if len(word) else 0.0) + (self.char[char].mean() if len(char) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50))))


def features(b: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indices of the word one- and two-grams and of the four-byte grams."""
    word = np.concatenate([h, K.shingle_hashes(h, 2)]) >> np.uint64(64 - BITS)
    x = b.astype(np.uint32)
    char = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24 if len(b) > 3 else np.empty(0, np.uint32)
    return word.astype(np.int64), ((char * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def base_rules(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's bytes and words."""
    chars = int(((b & 0xC0) != 0x80).sum() - (K.SPACE[b]).sum())
    lines = [x for x in b.tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    grams = K.shingle_hashes(h, 3)
    repeated = 0
    if len(grams) > 1:
        order = np.argsort(grams)
        same = grams[order[1:]] == grams[order[:-1]]
        if same.any():
            twice = np.zeros(len(h), bool)
            for at in (order[1:][same], order[:-1][same]):
                for k in range(3):
                    twice[at + k] = True
            repeated = int(twice.sum())
    return len(h), chars, int(SYMBOLS[b].sum()), len(lines) - len(set(lines)), repeated


def judge(texts: list[bytes], model: Model | None, min_words: int = 50) -> list[list]:
    rows = []
    for t in texts:
        b = K.raw(t)
        starts, ends, h = K.words(b)
        counts = base_rules(b, starts, ends, h)
        failed = counts[0] < min_words or 100 * counts[4] > 50 * counts[0]
        p = model.probability(b, h) if model is not None else 0.0
        rows.append((*counts, failed, not failed and (model is None or p < model.threshold), p))
    return [list(x) for x in zip(*rows, strict=True)]


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, steps: int = 60, rate: float = 0.5, penalty: float = 1e-6, threshold: float = 0.5) -> Model | None:
    """A model of labels.quality = 0 from at most `sample` labelled documents; None unless both classes occur."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def counted(texts):
        made = [[], []]
        for t in texts:
            b = K.raw(t)
            _, _, h = K.words(b)
            for k, x in enumerate(features(b, h)):
                at, n = np.unique(x, return_counts=True)
                made[k].append(at.astype("<u2").tobytes() + (n / max(1, len(x))).astype("<f4").tobytes())
        return made

    got = text_map(rows, counted, [("word", "binary"), ("char", "binary")], ["doc_id", "quality"]).orderBy("doc_id").collect()
    if len({r["quality"] for r in got}) < 2:
        return None
    y = np.array([r["quality"] == 0 for r in got], np.float64)
    held = np.arange(len(y)) % 3 == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    chunks = chunked([(r["word"], r["char"]) for r in got])
    del got
    w, bias = fit(chunks, y, ~held, steps, rate, penalty)
    z = bias + scores(chunks, w, len(y))
    slope, shift = platt(z[held] if held.any() else z, y[held] if held.any() else y)
    return Model(w[: 1 << BITS].astype(np.float32), w[1 << BITS :].astype(np.float32), bias, slope, shift, threshold)


def chunked(rows: list[tuple[bytes, bytes]], most: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, share, row) of the rows' word and character features, some `most` at a time: what training needs at once."""
    out, index, value, at, n = [], [], [], [], 0
    for i, families in enumerate(rows):
        for k, x in enumerate(families):
            m = len(x) // 6
            index.append(np.frombuffer(x, "<u2", m).astype(np.uint32) + np.uint32(k << BITS))
            value.append(np.frombuffer(x, "<f4", m, 2 * m))
            at.append(np.full(m, i, np.uint32))
            n += m
        if n >= most or i == len(rows) - 1:
            out.append((np.concatenate(index), np.concatenate(value), np.concatenate(at)))
            index, value, at, n = [], [], [], 0
    return out


def scores(chunks, w: np.ndarray, n: int) -> np.ndarray:
    z = np.zeros(n)
    for index, value, row in chunks:
        z += np.bincount(row, w[index] * value, n)
    return z


def fit(chunks, y, used, steps, rate, penalty) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam on the rows used; both classes weigh alike."""
    w, bias = np.zeros(2 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, y[used].sum()), 0.5 / max(1, (1 - y[used]).sum())) * used
    for t in range(1, steps + 1):
        z = bias + scores(chunks, w, len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad = penalty * w
        for index, value, row in chunks:
            grad += np.bincount(index, g[row] * value, len(w))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        c, d = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        bias -= 0.1 * rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, float(bias)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of a sigmoid over the held-out scores, with Platt's smoothed targets, by Newton steps."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def quality_rules(docs: DataFrame, model: Model | None, carry: list[str] = ("doc_id",)) -> DataFrame:
    """carry columns with the base counts, base_failed, kept and the calibrated probability of low quality."""
    return text_map(docs, lambda texts: judge(texts, model), FIELDS, carry)
