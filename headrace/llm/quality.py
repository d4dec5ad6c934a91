"""Operator 7: quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrace.llm.common import find_code, kept_rows, with_results

#: Labelled rows that the trees learn from, at most; the first by a hash of doc_id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, RIDGE, MIN_ROWS = 0.2, 1.0, 10
#: Rows with a score below this are rejected.
CUT = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t", "line": b"\n", "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|_~^\\<>{}[]/=+",
    "sign": b"#$%&*@", "quote": b"\"'()-", "lead": bytes(range(192, 256)), "trail": bytes(range(128, 192)),
}
_TABLE = np.array([[b in chars for chars in _CLASSES.values()] for b in range(256)], np.float64)
FEATURES = (*(f"{name}_share" for name in _CLASSES), "log_bytes", "log_words", "mean_word", "long_words", "distinct_words",
            "top_word", "repeated_next", "distinct_lines", "mean_line", "mark_words")


def statistics(text: str | None) -> np.ndarray:
    """FEATURES of a whole text; NULL and empty texts are all zeros."""
    out = np.zeros(len(FEATURES))
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if not data:
        return out
    n = len(data)
    out[:len(_CLASSES)] = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE / n
    words, lines = data.split(), data.split(b"\n")
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    out[len(_CLASSES):] = (
        np.log1p(n), np.log1p(len(words)), sizes.sum() / k, (sizes > 14).sum() / k, len(counts) / k,
        max(counts.values(), default=0) / k, sum(map(eq, words, words[1:])) / k, len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), counts[b"|"] / k)
    return out


@dataclass
class Trees:
    """Complete trees flattened to arrays: node i has the children 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes: go right above it
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss. No rows: 0.5 for all; one label only: its smoothed share."""
    n, width = len(x), len(FEATURES)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    rate = (y.sum() + 0.5) / (n + 1)
    trees = Trees(float(np.log(rate / (1 - rate))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, trees.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            at = (node - first) * BINS
            best = np.full(count, 1e-9)
            for j in range(width):
                if not len(edges[j]):
                    continue
                sums = [np.bincount(at + binned[:, j], w, count * BINS).reshape(count, BINS) for w in (grad, hess, None)]
                left = [np.cumsum(s, 1) for s in sums]
                whole = [s[:, -1:] for s in left]
                right = [w - s for w, s in zip(whole, left)]
                gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
                gain[(left[2] < MIN_ROWS) | (right[2] < MIN_ROWS)] = -1
                gain[:, len(edges[j]):] = -1
                cut = gain.argmax(1)
                top = gain[np.arange(count), cut]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better], limit[first + better] = j, edges[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = RATE * g / (h + RIDGE)
        margin += value[leaf]
        trees.feature = np.vstack([trees.feature, feature])
        trees.limit = np.vstack([trees.limit, limit])
        trees.value = np.vstack([trees.value, value])
    return trees


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``SAMPLE_ROWS`` labelled rows that are not held out."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        "doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_ROWS)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame(np.array([statistics(t) for t in b["text"]]), columns=FEATURES).assign(quality=b["quality"].to_numpy())

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality").mapInPandas(
        described, ", ".join(f"{f} double" for f in FEATURES) + ", quality int").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)  # the fit doesn't depend on the order of rows
    return rows[list(FEATURES)].to_numpy(), (rows["quality"].to_numpy() > 0).astype(float)


def text_scores(trees: Trees, texts: list) -> np.ndarray:
    return trees.score(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, repeated rows included.

    Only the text is an input of a score. Without labelled rows every score is 0.5.
    """
    find_code(docs.sparkSession)
    trees = fit(*training_rows(docs, labels))
    scored = with_results(docs, ["doc_id"], lambda texts: [{"quality_score": float(s)} for s in text_scores(trees, texts)], "quality_score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    find_code(docs.sparkSession)
    trees = fit(*training_rows(docs, labels))
    return kept_rows(docs, lambda texts: (text_scores(trees, texts) >= CUT).tolist())
