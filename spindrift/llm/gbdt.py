"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts on the executors. Trees are grown on the driver
from the statistics of a bounded number of labelled documents, by gradient and curvature
sums over quantile bins, and flattened into arrays that hold complete binary trees; a
batch of documents walks all trees in vector steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ensure_importable

#: Labelled documents that a model is fitted on at most.
FIT_DOCS = 20_000
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 80, 4, 0.15, 64, 20, 1.0
NAMES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "marks", "bangs", "bars", "points",
    "spaces", "lines_per_word", "line_repeats", "distinct_words", "distinct_pairs", "capital_words",
    "long_words", "marked_words", "wide_bytes",
]


def _classes() -> np.ndarray:
    m = np.zeros((256, 8))
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>^~=_\\/@{}[]+", b"!?", b"|", b".,;:", b" \t\r\n\v\f")):
        m[list(chars), k] = 1
    m[128:, 7] = 1
    return m


_CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """The numbers of ``NAMES``; all finite, for the empty text too."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, raw.size)
    upper, digits, symbols, bangs, bars, points, spaces, wide = np.bincount(raw, minlength=256) @ _CLASSES / n
    words = text.split()
    w = max(1, len(words))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    # a few properties of words need each distinct word once, not each word
    d = max(1, len(distinct))
    capital = sum(x[0].isupper() for x in distinct) / d
    long = sum(len(x) > 12 for x in distinct) / d
    marked = sum(not x[-1].isalnum() for x in distinct) / d
    return [
        float(np.log1p(raw.size)), float(np.log1p(len(words))), raw.size / w, upper, digits, symbols, symbols + bangs + bars,
        bangs, bars, points, spaces, len(lines) / w, 1 - len(set(lines)) / max(1, len(lines)), len(distinct) / w,
        pairs / max(1, len(words) - 1), capital, long, marked, wide,
    ]


class Trees:
    """Complete binary trees in arrays: column, cut and value of every node."""

    def __init__(self, base: float, cols: np.ndarray, cuts: np.ndarray, values: np.ndarray):
        self.base, self.cols, self.cuts, self.values = base, cols, cuts, values

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by walking every tree with all rows at once."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for cols, cuts, values in zip(self.cols, self.cuts, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(values)))):
                node = 2 * node + 1 + (x[rows, cols[node]] > cuts[node])
            margin += values[node - len(cols)]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boost the log loss; with no rows or one label, the trees are none and the base says all."""
    if not len(y) or y.min() == y.max():
        return Trees(0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1), np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    all_cols, all_cuts, all_values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        cols, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            gain_best, col_best, bin_best = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(f):
                if not len(edges[j]):
                    continue
                key = local * bins + code[:, j]
                gs, hs, cs = (np.cumsum(np.bincount(key, wt, width * bins).reshape(width, bins), axis=1) for wt in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(cs < MIN_LEAF) | (ct - cs < MIN_LEAF)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > gain_best + 1e-9
                gain_best[better] = gain[np.arange(width), top][better]
                col_best[better], bin_best[better] = j, top[better]
            for k in range(width):
                if bin_best[k] >= 0:
                    cols[first + k], cuts[first + k] = col_best[k], edges[col_best[k]][bin_best[k]]
            node = 2 * node + 1 + (x[np.arange(n), cols[node]] > cuts[node])
        leaf = node - inner
        values = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin += values[leaf]
        all_cols.append(cols)
        all_cuts.append(cuts)
        all_values.append(values)
    return Trees(base, np.array(all_cols), np.array(all_cuts), np.array(all_values))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_docs: int = FIT_DOCS) -> Trees:
    """Fit on the labelled documents, or on ``max_docs`` of them chosen by a hash of doc_id.

    A document with several labels counts with its highest, one with several rows once,
    with the greatest statistics, so that ``max_docs`` bounds what the driver gets. Rows
    without doc_id or label teach nothing; an empty table, or one label only, gives a constant.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    seen = rows.select("doc_id", "text", "_label").mapInArrow(run, "doc_id long, y double, x array<double>")
    got = seen.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return grow(x, got["y"].to_numpy(float))


def score(df: DataFrame, trees: Trees, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Append the probability of label 1.

    Null and empty texts are scored like any other, texts of any length whole; rows are
    scored one by one, so repeated rows agree; a column named ``out_col`` is replaced, other
    columns pass; an empty table gives an empty table.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def run(text):
        import pandas as pd

        x = np.array([statistics(t or "") for t in text], float).reshape(len(text), len(NAMES))
        return pd.Series(shared.value.score(x))

    return df.withColumn(out_col, run(F.col(text_col)))
