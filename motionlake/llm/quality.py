"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

Statistics of whole texts are standardized; cosines of random projections approximate a Gaussian kernel over
them. The normal equations of the labelled rows are summed partition by partition, once for each of two folds;
the ridge weights of one fold score the other, and isotonic regression of the labels on these scores turns the
scores of the full fit into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.chunks import blocks
from motionlake.llm.common import in_arrow, written

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b"#$%&*"
#: Bins of out-of-fold scores for the isotonic fit.
BINS = 2000
LEAST, MOST = -1.0, 2.0


def statistics(text: str | None) -> list[float]:
    """Twenty numbers about a text: lengths, shares of kinds of characters, repetition. Null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    size = max(len(data), 1)
    kind = lambda some: (len(data) - len(data.translate(None, some))) / size
    words = text.split()
    n = max(len(words), 1)
    distinct = set(words)
    lines = [x for x in text.split("\n") if x]
    m = max(len(lines), 1)
    halves = list(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        len(text) / n,
        kind(_UPPER),
        kind(_LOWER),
        kind(_DIGIT),
        kind(_MARKS),
        text.count("!") / n,
        text.count("|") / n,
        text.count(".") / n,
        text.count(",") / n,
        text.count("?") / n,
        (text.count("(") + text.count("[") + text.count("{") + text.count("<")) / n,
        len(distinct) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(halves)) / max(len(halves), 1),
        len(set(lines)) / m,
        max(map(len, words), default=0) / 50.0,
        len([x for x in words if len(x) < 4]) / n,
    ]


N_STATISTICS = 20


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its text, of each row; repeated rows give a row each, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                rows = [statistics(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Quality:
    """mean, scale: of the statistics; w, b: the projections; weights: ridge; steps: scores and what they stand for."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        return _features(x, self.mean, self.scale, self.w, self.b)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.features(x) @ self.weights, *self.steps), 0.0, 1.0)


def _features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b) * np.sqrt(2.0 / len(b))
    return np.hstack([z, np.ones((len(x), 1))])


def _summed(rows: DataFrame, size: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of add(batch) over all batches: one vector a partition, summed in a few tasks, then here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += add(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for row in batch.column("v"):
                total += row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    parts = in_arrow(in_arrow(rows, each, "v array<double>").repartition(4), again, "v array<double>").collect()
    return np.sum([r.v for r in parts], axis=0)


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return np.asarray(batch.column(column).flatten().to_numpy(), float).reshape(batch.num_rows, N_STATISTICS)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: the mean x and the value of each pool."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, weight, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(labelled: DataFrame, size: int = 256, gamma: float = 0.05, ridge: float = 1e-4, seed: int = 7) -> Quality:
    """Fit on rows doc_id, x, y (0 or 1). With no row, or labels of one kind only, every score is their mean or 0.5."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(batch), batch.column("y").to_numpy()
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)])

    total = _summed(labelled, 2 + 2 * N_STATISTICS, moments)
    n = max(total[0], 1.0)
    mean = total[2 : 2 + N_STATISTICS] / n
    scale = np.sqrt(np.maximum(total[2 + N_STATISTICS :] / n - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (N_STATISTICS, size))
    b = rng.uniform(0, 2 * np.pi, size)
    share = total[1] / n if total[0] else 0.5
    if not total[0] or not 0 < share < 1:
        return Quality(mean, scale, w, b, np.zeros(size + 1), (np.array([0.0]), np.array([share])))
    d = size + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y, fold = _features(_matrix(batch), mean, scale, w, b), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        return np.concatenate([np.concatenate([(z[k].T @ z[k]).ravel(), z[k].T @ y[k]]) for k in (fold == 0, fold == 1)])

    folds = labelled.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    sums = _summed(folds, 2 * (d * d + d), equations).reshape(2, -1)
    solve = lambda s: np.linalg.solve(s[: d * d].reshape(d, d) + ridge * n * np.eye(d) / d, s[d * d :])
    full, apart = solve(sums.sum(0)), [solve(sums[1]), solve(sums[0])]

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        z, y, fold = _features(_matrix(batch), mean, scale, w, b), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        s = np.where(fold == 0, z @ apart[0], z @ apart[1])
        at = np.clip((s - LEAST) / (MOST - LEAST) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    count, ones = _summed(folds, 2 * BINS, binned).reshape(2, -1)
    used = count > 0
    centre = LEAST + (np.arange(BINS) + 0.5) * (MOST - LEAST) / BINS
    return Quality(mean, scale, w, b, full, isotonic(centre[used], ones[used] / count[used], count[used]))


def train(docs: DataFrame, labels: DataFrame, learn: object = None) -> tuple[Quality, DataFrame]:
    """The model, fitted on labels of documents for which the condition `learn` on doc_id holds; and all statistics.

    Labels without an id or a quality are left out; a document with several labels counts with each.
    """
    stats = written(measured(docs), "statistics")
    known = labels.where("doc_id is not null and quality is not null")
    known = known.where(learn) if learn is not None else known
    # statistics are learned from the documents alone; the label joins by id
    labelled = stats.join(known.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    return fit(written(labelled, "labelled")), stats


def scores(stats: DataFrame, model: Quality) -> DataFrame:
    """doc_id, score of each row of statistics, repeated ones and such without an id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)), pa.float64())], names=["doc_id", "score"])

    return in_arrow(stats, run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Quality, least: float = 0.5) -> DataFrame:
    """The documents that score at least so much, all columns. Null texts score as empty ones; ids play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                x = np.array([statistics(t) for t in part.column("text").to_pylist()]).reshape(-1, N_STATISTICS)
                yield part.filter(pa.array(model.score(x) >= least))

    return in_arrow(docs, run, docs.schema)
