"""Quality classifier: a generalised additive model with pairwise interactions.

Per-document features come from one pass over the text. Every feature is cut into quantile bins;
boosting visits the features in turn and adds a shallow tree over the bins to each feature's lookup
table, then the strongest pairs get two-dimensional tables from four-leaf trees in the same way. A
score is the logistic of a sum of table entries, looked up for whole batches at once.

The fit sees at most ``sample`` labelled rows, those with the smallest hashes of doc_id; only
their features (not texts) come to the driver. Everything else covers all rows.

Null and empty texts have features like any other text (all zero). Rows without a label, or with
one other than 0 and 1, are not learnt from. With no labels, or labels of one kind only, the score
is the smoothed share of label 1. Repeated rows get the same score. Other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows fit the model.
SAMPLE = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE, PAIRS = 32, 8, 80, 40, 0.15, 2.0, 8

NAMES = (
    "log_chars", "upper", "exclaiming", "symbols", "digits", "blanks", "lines", "word_length", "distinct_words", "distinct_pairs", "top_word",
    "repeats", "odd_ends", "no_letters", "repeated_lines", "entropy", "longest_word", "short_words", "other_bytes", "sentences",
)
_CLASS = np.zeros(256, dtype=np.int64)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s.isupper() else 2 if _s.islower() else 3 if _s.isdigit() else 4 if _s in "!?" else 5 if _s in ".,;:'\"-" else 6 if _s == "\n" else 7 if _s.isspace() else 8
_CLASS[128:] = 9


def features(text: str | None) -> list[float]:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(NAMES) - 1)
    hist = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, weights=hist, minlength=10)
    n, nb, w = len(words), len(data), Counter(words)
    share = hist[hist > 0] / nb
    letters = kinds[1] + kinds[2] + kinds[9]
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    after = words[1:]
    ends = [x[-1] for x in words]
    odd = sum(map(ends.count, "!#$%&*|@^~+=<>"))
    bare = sum(c for x, c in w.items() if not any(map(str.isalpha, x)))
    return [
        float(np.log1p(len(text))), kinds[1] / max(letters, 1), kinds[4] / nb, kinds[8] / nb, kinds[3] / nb, (kinds[6] + kinds[7]) / nb, kinds[6] / nb,
        float(lengths.mean()), len(w) / n, len(set(zip(words, after, strict=False))) / max(n - 1, 1), max(w.values()) / n,
        sum(map(str.__eq__, words, after)) / n, odd / n, bare / n, 1 - len(set(lines)) / max(len(lines), 1),
        float(-(share * np.log2(share)).sum()), float(lengths.max()), float((lengths <= 3).mean()), kinds[9] / nb, kinds[5] / n,
    ]


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """One lookup per table for all rows at once."""
        z = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree that splits, leaf by leaf, where the gain is largest."""
    cuts = [0, len(g)]
    G, H = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    worth = lambda a, z: (G[z] - G[a]) ** 2 / (H[z] - H[a] + RIDGE)
    for _ in range(leaves - 1):
        best = max(((worth(a, m) + worth(m, z) - worth(a, z), m) for a, z in zip(cuts, cuts[1:], strict=False) for m in range(a + 1, z)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, z in zip(cuts, cuts[1:], strict=False):
        out[a:z] = (G[z] - G[a]) / (H[z] - H[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features once."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, out = 0.0, np.zeros_like(g)
    whole = G[-1, -1] ** 2 / (H[-1, -1] + RIDGE)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(x[i, j], x[i, -1] - x[i, j], x[-1, j] - x[i, j], x[-1, -1] - x[i, -1] - x[-1, j] + x[i, j]) for x in (G, H)]
            gain = sum(a * a / (b + RIDGE) for a, b in zip(*parts, strict=True)) - whole
            if gain > best:
                v = [a / (b + RIDGE) for a, b in zip(*parts, strict=True)]
                best, out = gain, np.block([[np.full((i, j), v[0]), np.full((i, g.shape[1] - j), v[1])], [np.full((g.shape[0] - i, j), v[2]), np.full((g.shape[0] - i, g.shape[1] - j), v[3])]])
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts one feature after the other, then the pairs that promise most."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), [], [], [], [], [])
    if not 0 < y.sum() < len(y):
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), 3)
            model.tables[j] += step
            z += step[bins[j]]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(a, b, w):
        return np.bincount(bins[a] * sizes[b] + bins[b], w, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    found = sorted(((_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(k) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in found[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for i, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            model.pair_tables[i] += step
            z += step[bins[a], bins[b]]
    return model


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled rows that are not held out: at most ``sample``, by the hash of doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id", "text").alias("o"), "y", vector(F.col("text")).alias("x"))
    rows = rows.orderBy("o", "y").limit(sample).collect()  # doc_ids may repeat
    return fit(np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows]))


def vector(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return of(text)


def with_quality(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All rows and columns and the score, from the text alone. An older column of that name is replaced."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in text.to_pylist()], dtype=float).reshape(-1, len(NAMES))
        return pa.array(model.score(x))

    return documents.withColumn(column, score("text"))
