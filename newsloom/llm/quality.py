"""Quality of documents: histogram gradient-boosted trees over document statistics.

Statistics are shares and means over the whole text (``NAMES``). Training takes at most ``TRAIN_ROWS`` labelled
documents of each class, weighted to the number of labels of their class; only their statistics come to the driver. Every tree is grown level by level from
histograms of gradients over at most ``BINS`` quantile bins. The trees are complete binary trees in three
arrays (feature, threshold, value), so a batch walks down all of them with a few numpy operations a level.

Scores: the probability of label 1. Null and empty texts have all statistics 0 and get the score of that
point. Without labels of both classes every score is the share of label 1, or 0.5 without any. Repeated rows
repeat their score; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import batches, filtered, texts
from newsloom.llm.labelled import held_out, label_sample

TRAIN_ROWS = 10_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 5.0
FOLDS, HELD = 3, 1
CUT = 0.5

NAMES = (
    "log_bytes log_words word_bytes longest_word spaces breaks upper lower digits stops commas calls symbols bars wide "
    "capital_rate distinct_words commonest_word repeated_next log_lines line_bytes distinct_lines lines_ending words_per_stop"
).split()


def statistics(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, w = len(text), len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    stops, commas, calls, bars, wide = seen[46], seen[44] + seen[59] + seen[58], seen[33] + seen[63], seen[124], seen[128:].sum()
    symbols = seen[33:127].sum() - upper - lower - digits - stops - commas - calls - bars
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ending = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines)
    return [
        np.log1p(n), np.log1p(w), sum(map(len, words)) / w, np.log1p(max(map(len, counts))),
        seen[32] / n, seen[10] / n, upper / n, lower / n, digits / n, stops / n, commas / n, calls / n, symbols / n, bars / n, wide / n,
        upper / (1 + upper + lower), len(counts) / w, max(counts.values()) / w, sum(map(eq, words, words[1:])) / w,
        np.log1p(len(lines)), n / len(lines) / 1000, len(set(lines)) / len(lines), ending / len(lines), min(w / (1 + stops), 1000),
    ]


class Trees:
    """Boosted trees as arrays: node ``i`` has the children ``2 i + 1`` (value at most the threshold) and ``2 i + 2``."""

    def __init__(self, base: float):
        self.base = base
        self.feature = np.empty((0, 2**DEPTH - 1), np.int32)
        self.threshold = np.empty((0, 2**DEPTH - 1))
        self.value = np.empty((0, 2**DEPTH))

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
    weight = np.ones(len(y)) if weight is None else weight
    rate = np.average(y, weights=weight) if len(y) else 0.5
    if not len(y) or rate in (0.0, 1.0):
        model = Trees(float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
        return model
    model = Trees(float(np.log(rate / (1 - rate))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.base)
    grown = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        feature, threshold, value, leaf = grow(binned, edges, weight * (p - y), weight * p * (1 - p))
        margin += value[leaf]
        grown.append((feature, threshold, value))
    model.feature, model.threshold, model.value = (np.stack(part) for part in zip(*grown))
    return model


def grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple:
    """One tree: split features and thresholds of the inner nodes, leaf values, and each row's leaf."""
    inner = 2**DEPTH - 1
    feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
    node = np.zeros(len(g), np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        best = np.full(width, 1e-6)
        cut = np.zeros(width, np.int64)
        local = node - first
        for f, e in enumerate(edges):
            if not len(e):
                continue
            at = local * BINS + binned[:, f]
            left_g, left_h = (np.bincount(at, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h))
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST) | (right_h < LEAST)] = 0
            gain = gain[:, : len(e)]
            top = gain.argmax(axis=1)
            better = gain[np.arange(width), top] > best
            best[better], cut[better] = gain[np.arange(width), top][better], top[better]
            feature[first : first + width][better] = f
            threshold[first : first + width][better] = e[top[better]]
        # a node that can't be split sends all its rows to the left
        splits = np.isfinite(threshold[node])
        right = splits & (binned[np.arange(len(g)), feature[node]] > cut[local])
        node = 2 * node + 1 + right
    leaf = node - inner
    value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
    return feature, threshold, value, leaf


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """The trees, from labelled documents outside the held-out fold."""
    schema = "doc_id long, label int, weight double, statistics array<double>"

    def measure(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(1), "label": batch.column(2), "weight": batch.column(3), "statistics": [statistics(t) for t in texts(batch)]}

    # at most 2 * TRAIN_ROWS triples of numbers
    sample = F.broadcast(label_sample(labels, "quality", FOLDS, HELD, TRAIN_ROWS))
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("text", "doc_id", "label", "weight")
    rows = sorted((r.doc_id, r.statistics, r.label, r.weight) for r in taught.mapInArrow(batches(measure, schema), schema).collect())
    y, weight = (np.array([r[i] for r in rows], float) for i in (2, 3))
    return fit(np.array([r[1] for r in rows]).reshape(len(rows), len(NAMES)), y, weight)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    model = train(docs, labels)
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def rate(batch: pa.RecordBatch) -> dict:
        score = model.score(np.array([statistics(t) for t in texts(batch)]).reshape(-1, len(NAMES)))
        return {"doc_id": batch.column(1), "held_out": batch.column(2), "score": score, "predicted": (score >= CUT).astype(np.int32)}

    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLDS, HELD)).mapInArrow(batches(rate, schema), schema)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    model = train(docs, labels)

    def choose(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(model.score(np.array([statistics(t) for t in texts(batch)]).reshape(-1, len(NAMES))) >= CUT)

    return filtered(docs, choose)
