"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector over hashed text features and thresholds t_0 < t_1 < ... of their
own. Features are the shares of a text's words by hashed word and hashed shape (letters, digits and marks, runs collapsed),
of words that repeat the one before, and a few of the whole text (share of distinct words and lines, length), one-hot. A
score is the mean of its words' weights, so that a text is scored in one pass with a table of the words seen.

The fit takes at most MAX_ROWS labelled rows (see labelled.sample), by Adam over all of them at once, in fixed order: equal
inputs give equal weights. Weights are two arrays of fixed size.

A null text is empty: it has the whole-text features only. Where no row is labelled, or all have one grade, every text
gets the highest grade there is (1 without any) and is kept. Rows with equal doc_id are scored each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberframe.llm.common import by_batch, ident, texts
from emberframe.llm.labelled import sample

#: Labelled rows in the fit at most.
MAX_ROWS = 4000
BUCKETS = 1 << 15
STEPS, RATE, DECAY = 120, 0.1, 1e-4
#: Different words that a task remembers at most.
KEPT = 200_000
#: A text stays if its probability to be above the lowest grade is this much.
LEAST_TAIL = 0.5


def _shape(word: str) -> str:
    out = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def word_features(word: str) -> tuple[int, int]:
    return _bucket("w:" + word), _bucket("s:" + _shape(word))


def text_features(text: str, words: list[str]) -> list[int]:
    lines = text.split("\n")
    distinct = len(set(words)) / len(words) if words else 1.0
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
    return [
        _bucket(f"d:{int(distinct * 10)}"), _bucket(f"r:{int(np.ceil(same * 10))}"),
        _bucket(f"l:{int(len(set(lines)) / len(lines) * 5)}"), _bucket(f"n:{len(words).bit_length()}"),
    ]


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Weights, thresholds, grades."""
    grades = sorted({g for _, g in rows})
    if len(grades) < 2:
        return np.zeros(BUCKETS), np.empty(0), grades or [1]
    index, value, at = [], [], []
    cache: dict = {}
    for i, (text, _) in enumerate(rows):
        words = text.split()
        own = [f for w in words for f in (cache.get(w) or cache.setdefault(w, word_features(w)))]
        ids, n = np.unique(np.array(own, np.int64), return_counts=True)
        whole = text_features(text, words)
        index += [ids, np.array(whole)]
        value += [n / max(1, len(words)), np.full(len(whole), 0.5)]
        at.append(np.full(len(ids) + len(whole), i))
    index, value, at = np.concatenate(index), np.concatenate(value), np.concatenate(at)
    y = np.searchsorted(grades, [g for _, g in rows])
    n, k = len(rows), len(grades) - 1
    above = (y[:, None] > np.arange(k)).astype(float)
    base = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    t = -np.log(base / (1 - base))
    # thresholds as the first and the logarithms of the steps, which keeps them in order
    param = np.concatenate([np.zeros(BUCKETS), t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    m, v = np.zeros_like(param), np.zeros_like(param)
    for step in range(1, STEPS + 1):
        w, first, gaps = param[:BUCKETS], param[BUCKETS], np.exp(param[BUCKETS + 1 :])
        t = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, w[index] * value, n)
        above_p = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-(score[:, None] - t))), np.zeros((n, 1))])
        own = np.maximum(above_p[np.arange(n), y] - above_p[np.arange(n), y + 1], 1e-9)
        slope = above_p * (1 - above_p)
        hi, lo = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        by_score = -(hi - lo) / own / n
        by_t = np.zeros((n, k + 2))
        by_t[np.arange(n), y] += hi / own / n
        by_t[np.arange(n), y + 1] -= lo / own / n
        g_t = by_t.sum(0)[1:-1]
        tails = np.cumsum(g_t[::-1])[::-1]
        grad = np.concatenate([np.bincount(index, by_score[at] * value, BUCKETS) + DECAY * w, tails[:1], tails[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        param = param - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return param[:BUCKETS], param[BUCKETS] + np.concatenate([[0.0], np.cumsum(np.exp(param[BUCKETS + 1 :]))]), grades


def _scores(text_list: list[str], w: np.ndarray, cache: dict) -> np.ndarray:
    out = []
    for text in text_list:
        words = text.split()
        try:
            total = sum(map(cache.__getitem__, words))
        except KeyError:
            for x in [x for x in set(words) if x not in cache]:
                a, b = word_features(x)
                cache[x] = float(w[a] + w[b])
            total = sum(map(cache.__getitem__, words))
        out.append(total / max(1, len(words)) + 0.5 * float(sum(w[f] for f in text_features(text, words))))
        if len(cache) > KEPT:
            cache.clear()
    return np.array(out)


def _grade(batches_texts: list[str], model, cache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, expected grade, probability above the lowest grade."""
    w, t, grades = model
    s = _scores(batches_texts, w, cache)
    if not len(t):
        return s, np.full(len(s), float(grades[-1])), np.ones(len(s))
    tail = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -500, 500)))
    return s, grades[0] + tail @ np.diff(np.array(grades, float)), tail[:, 0]


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, score, expected_grade, tail (probability above the lowest grade), keep."""
    model = fit(sample(docs, labels, "quality", max_rows))

    def run(batches):
        cache: dict = {}
        for batch in batches:
            s, e, p = _grade(texts(batch), model, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(e), pa.array(p), pa.array(p >= LEAST_TAIL)], ["doc_id", "score", "expected_grade", "tail", "keep"])

    return by_batch(ident(docs, "doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, expected_grade double, tail double, keep boolean")


def select(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps."""
    model = fit(sample(docs, labels, "quality", max_rows))

    def run(batches):
        cache: dict = {}
        for batch in batches:
            yield batch.filter(pa.array(_grade(texts(batch), model, cache)[2] >= LEAST_TAIL))

    return by_batch(docs, run, docs.schema)


__all__ = ["fit", "score", "select"]
