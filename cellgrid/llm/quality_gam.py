"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; cyclic boosting visits the features in turn, fits a shallow tree to the gradients summed by
bin, and adds its leaves to the feature's lookup table with a small step. Then the pairs of features whose residuals gain
most from a joint tree get tables of their own in the same way. A score is the sum of a few looked-up numbers, so a batch of
texts is scored by adding table entries at their bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, hash_sample, table

#: The learner reads about this many labelled rows at most, those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
FEATURES = ("log_words", "chars_per_word", "upper_share", "symbols_per_word", "bars_per_word", "bangs_per_word", "stops_per_word", "commas_per_word", "digit_share", "short_words", "distinct_words", "distinct_pairs", "top_word", "dup_lines", "wide_share", "words_per_line")

_UPPER, _SYMBOLS, _DIGITS, _WIDE = bytes(range(65, 91)), b"#*$%&<>@^~_=+{}[]\\", bytes(range(48, 58)), bytes(range(128, 256))


def text_features(text: str | None) -> list[float]:
    """The features of one whole text; null counts as empty, and an empty text has zeros."""
    b = (text or "").encode()
    w = b.split()
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, w))
    without = lambda drop: len(b) - len(b.translate(None, drop))
    lines = [x for x in b.split(b"\n") if x.strip()]
    low = b.lower().split()
    return [
        np.log1p(n), chars / n, without(_UPPER) / chars, without(_SYMBOLS) / n, b.count(b"|") / n, b.count(b"!") / n, b.count(b".") / n, b.count(b",") / n, without(_DIGITS) / chars,
        sum(len(x) <= 3 for x in w) / n, len(set(low)) / n, len(set(zip(low, low[1:], strict=False))) / max(1, n - 1), Counter(low).most_common(1)[0][1] / n,
        1 - len(set(lines)) / len(lines), without(_WIDE) / chars, n / len(lines),
    ]


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """The value of each bin under a tree of at most `leaves` leaves over ordered bins with gradient sums g and curvature h."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            if p[1] - p[0] > 1:
                at = np.arange(p[0] + 1, p[1])
                gain = worth(p[0], at) + worth(at, p[1]) - worth(*p)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), p, int(at[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best tree that cuts each of two dimensions once, as a table, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n, m = g.shape
    if n < 2 or m < 2:
        return np.zeros_like(g), 0.0
    quads_g = [cg[:-1, :-1], cg[:-1, -1:] - cg[:-1, :-1], cg[-1:, :-1] - cg[:-1, :-1], cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + cg[:-1, :-1]]
    quads_h = [ch[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1], ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + ch[:-1, :-1]]
    gain = sum(a**2 / (b + ridge) for a, b in zip(quads_g, quads_h, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for k, (a, b) in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[a, b] = quads_g[k][i, j] / (quads_h[k][i, j] + ridge)
    return out, float(gain[i, j])


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; scores are sums of entries."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each row of features."""
        z = np.full(len(x), self.start)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, k], "right")]
        coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.pair_edges)]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, bins: int = 32, pair_bins: int = 8) -> AdditiveModel:
    """Learns from features x and labels y (0 or 1). With no rows the score is 0.5 everywhere; with one kind of rows it is near that label."""
    n, k = len(x), len(FEATURES)
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    cut = lambda q: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, q + 1)[1:-1])) if n else np.empty(0) for j in range(k)]
    edges, coarse_edges = cut(bins), cut(pair_bins)
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse_edges)]
    tables, z = [np.zeros(len(e) + 1) for e in edges], np.full(n, start)
    if n:
        for _ in range(rounds):
            for j in range(k):
                p = 1 / (1 + np.exp(-z))
                size = len(tables[j])
                step = rate * shallow_tree(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size))
                tables[j] += step
                z += step[at[j]]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = 1 / (1 + np.exp(-z)), (len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)
        flat, size = coarse[a] * shape[1] + coarse[b], shape[0] * shape[1]
        return np.bincount(flat, y - p, size).reshape(shape), np.bincount(flat, p * (1 - p), size).reshape(shape)

    chosen = sorted(combinations(range(k), 2), key=lambda ab: (-pair_tree(*sums(*ab))[1], ab))[:pairs] if n else []
    pair_tables = [np.zeros((len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds if n else 0):
        for t, (a, b) in zip(pair_tables, chosen, strict=True):
            step = rate * pair_tree(*sums(a, b))[0]
            t += step
            z += step[coarse[a], coarse[b]]
    return AdditiveModel(start, edges, tables, coarse_edges, chosen, pair_tables)


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each row, computed in the tasks that read the texts."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(compute, "doc_id bigint, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """The model from labelled documents outside the held-out fold (crc32 of doc_id as text, modulo 4).

    Labels without doc_id or quality don't count; of repeated labels of a document the lowest does. About `sample_rows`
    label ids at most are broadcast, and only their documents' features come to the driver, one row for each id: where rows
    share an id, those that are least.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    if held_out is not None:
        chosen = chosen.where(crc32_of_id("doc_id") % 4 != held_out)
    chosen = hash_sample(chosen, "doc_id", sample_rows)
    few = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = with_features(few).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([float(r.quality > 0) for r in rows]))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null and empty texts are scored by their zeros; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t) for t in b.column(2).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.scores(x))], ["doc_id", "held_out", "score"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc32_of_id("doc_id") % 4 == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = d.mapInArrow(compute, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches the threshold; the texts are not shuffled."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t) for t in b.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(shared.value.scores(x) >= threshold))

    return docs.mapInArrow(compute, docs.schema)


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
