"""Quality classification: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts. Trees are grown level by level from histograms of gradients over at most ``bins``
quantile bins a feature, on a sample of at most ``sample`` labelled documents, the first by a hash of their id: a documented
bound. All trees are flattened into arrays and walked together with numpy.

Null and empty texts have statistics of zero and are scored like others. Labels that are null or of no document are left out;
of repeated labels each counts; of several documents of one id that with the smallest statistics is learned from. Without both classes the score is the share of label 1 in the sample, 0.5 if that is empty.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .langid import fold

SAMPLE, BINS, TREES, DEPTH, RATE, LEAST, RIDGE, THRESHOLD = 20000, 64, 80, 4, 0.15, 20, 1.0, 0.3
_SYMBOLS = b"!#$%&*|.,;:-<>{}=/@\"'()"
FEATURES = (
    ["log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digits", "high_bytes", "punctuation", "distinct_words", "top_word", "repeated_next", "capital_words", "all_capital_words", "odd_ends", "line_length", "distinct_lines", "byte_entropy"]
    + [f"symbol_{chr(c)}" for c in _SYMBOLS]
)
_LOWER, _UPPER, _DIGIT = (np.array([chr(b) in s for b in range(256)]) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_WORDY = _LOWER | _UPPER | _DIGIT | (np.arange(256) >= 128)
_INK = _WORDY | (np.arange(256) > 32)
_CALM = b".,;:?)\"'-"


def statistics(rows: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(rows), len(FEATURES)), np.float32)
    for k, row in enumerate(rows):
        words = (row or b"").split()
        if not words:
            continue
        n = len(words)
        hist = np.bincount(np.frombuffer(row, np.uint8), minlength=256)
        size = np.fromiter(map(len, words), np.int64, n)
        ink = max(1, int(hist[_INK].sum()))
        letters = max(1, int(hist[_LOWER | _UPPER].sum()))
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in row.split(b"\n") if x.strip()]
        share = hist[hist > 0] / len(row)
        out[k] = [
            np.log1p(len(row)), np.log1p(n), size.mean(), size.std(), hist[_UPPER].sum() / letters, hist[_DIGIT].sum() / ink, hist[128:].sum() / ink, hist[_INK & ~_WORDY].sum() / ink,
            len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, sum(map(bytes.istitle, words)) / n, sum(map(bytes.isupper, words)) / n,
            sum(w[-1] < 128 and not _WORDY[w[-1]] and w[-1] not in _CALM for w in words) / n, len(row) / len(lines), len(set(lines)) / len(lines), -(share * np.log2(share)).sum(),
            *(hist[list(_SYMBOLS)] / ink),
        ]
    return out


class Forest(NamedTuple):
    """Flat trees: an inner node sends x[feature] <= threshold to ``left``, else to ``left + 1``; a leaf sends everything to itself."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST, ridge: float = RIDGE) -> Forest:
    mean = float(np.mean(y)) if len(y) else 0.5
    if mean in (0.0, 1.0) or not len(y):
        big = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        return Forest(big, *(np.zeros(0, t) for t in (np.int64, np.float32, np.int64, np.float64, np.int64)), 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: at most edge b
    bias = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), bias)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node(v):
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        value.append(v)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        roots.append(node(0.0))
        level, at = [roots[-1]], np.zeros(len(y), np.int64)  # at: which of the level's nodes, -1 for none
        for d in range(depth + 1):
            k, some = len(level), at >= 0
            g, h = (np.bincount(at[some], v[some], k) for v in (grad, hess))
            for i, n in enumerate(level):
                value[n] = rate * g[i] / (h[i] + ridge)
            if d == depth:
                break
            best = np.full(k, 1e-6)
            split = np.full((k, 2), -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = len(e) + 1
                key = at[some] * b + binned[some, f]
                gs, hs, ns = (np.cumsum(np.bincount(key, v, k * b).reshape(k, b), axis=1)[:, :-1] for v in (grad[some], hess[some], None))
                total = np.bincount(at[some], minlength=k)[:, None]
                gain = gs**2 / (hs + ridge) + (g[:, None] - gs) ** 2 / (h[:, None] - hs + ridge) - (g**2 / (h + ridge))[:, None]
                gain[(ns < least) | (total - ns < least)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(k), top] > best
                best[better] = gain[np.arange(k), top][better]
                split[better] = np.stack((np.full(k, f), top), axis=1)[better]
            new, move = [], np.full((k, 2), -1)
            for i, n in enumerate(level):
                f, b = split[i]
                if f >= 0:
                    feature[n], threshold[n] = int(f), float(edges[f][b])
                    move[i] = len(new), len(new) + 1
                    left[n] = node(0.0)
                    new += [left[n], node(0.0)]
            own = np.flatnonzero(some)
            i = at[own]
            goes = (binned[own, np.maximum(split[i, 0], 0)] > split[i, 1]).astype(np.int64)
            at[own] = move[i, goes]
            level = new
            if not level:
                break
        flat = Forest(0.0, np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(value), np.array(roots[-1:]), depth)
        score += margins(flat, x)
    return Forest(bias, np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(value), np.array(roots), depth)


def margins(forest: Forest, x: np.ndarray, rows: int = 2048) -> np.ndarray:
    """All trees at once: every row stands at one node of each tree and takes ``depth`` steps down."""
    out = np.full(len(x), forest.bias)
    if not len(forest.roots):
        return out
    leaf = forest.left == np.arange(len(forest.left))
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        at = np.broadcast_to(forest.roots, (len(part), len(forest.roots)))
        row = np.arange(len(part))[:, None]
        for _ in range(forest.depth):
            right = part[row, forest.feature[at]] > forest.threshold[at]
            at = np.where(leaf[at], at, forest.left[at] + right)
        out[a : a + rows] += forest.value[at].sum(axis=1)
    return out


def scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margins(forest, x)))


def _statistics_kernel(batches):
    for batch in batches:
        x = statistics(base.byte_rows(batch, "text")).astype(np.float64)
        flat = pa.array(x.reshape(-1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("times"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], ["doc_id", "y", "times", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 5, held_out: int = 0, **options) -> Forest:
    known = base.columns_only(labels, {"doc_id": "long", label: "int"}).where(f"doc_id is not null and `{label}` is not null")
    known = known.where(fold("doc_id", folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(sample)
    known = known.groupBy("doc_id", F.col(label).alias("y")).agg(F.count("*").alias("times"))
    rows = base.columns_only(docs, {"doc_id": "long", "text": "string"}).join(F.broadcast(known), "doc_id")  # at most ``sample`` rows of three numbers
    found = base.mapped(rows, _statistics_kernel, "doc_id long, y int, times long, x array<double>")
    found = found.groupBy("doc_id", "y", "times").agg(F.min("x").alias("x")).orderBy("doc_id", "y").toPandas()
    found = found.loc[found.index.repeat(found.times)]
    x = np.stack(found.x).astype(np.float32) if len(found) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, found.y.to_numpy(float), **options)


def score(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # a few thousand numbers, whatever the input

    def kernel(batches):
        for batch in batches:
            s = scores(shared.value, statistics(base.byte_rows(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return base.mapped(base.columns_only(docs, {"doc_id": "long", "text": "string"}), kernel, "doc_id long, score double, predicted int")
