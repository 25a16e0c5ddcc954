"""Quality classifier (5): positive-unlabelled learning.

A linear model over byte shares and shape statistics of whole texts minimises
the non-negative unbiased risk
    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]),
p: trusted positives, u: unlabelled web text, pi: the class prior. No negative
label is read: the prior is estimated from positives and unlabelled texts, as the
least share of the unlabelled above a threshold to that of the positives, on rows
that the ranking did not learn from. The loss is squared, so that the risk over
all unlabelled rows is a function of their moments: one pass over the texts adds
these up exactly, another counts scores for the prior, and nothing of a row is kept.
Trusted positives are a bounded sample (SAMPLE rows, those with the lowest hash of
their doc_id), whose mean and spread standardise the features; every row is scored.

Defined cases: a null text scores as an empty one; without trusted positives every
score is 0.5; a repeated doc_id is scored as often as it occurs, teaches as
unlabelled as often, and as a positive by its least text; a row with a null doc_id
teaches where `train` admits it; in labels, the lowest quality of a doc_id holds.
The model does not depend on the order of rows or on how they are cut into tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import lean, others, shuffle_partitions
from kgloom.llm.words import BY_SPACE, word_slices

#: Trusted positives that the model is fitted on.
SAMPLE = 10_000
#: Standardised features end at CLIP spreads and are whole numbers of 1/GRID; no spread is below LEAST_SCALE.
CLIP, GRID, LEAST_SCALE = 8, 256, 0.01
RIDGE = 0.1
_SHAPES = 12
FEATURES = 256 + _SHAPES


def text_features(batch: pa.RecordBatch) -> np.ndarray:
    """Square roots of byte shares, and shape statistics, of each text."""
    out = np.zeros((batch.num_rows, FEATURES), np.float32)
    for i, j, words in word_slices(batch, BY_SPACE, lower=False):
        n = j - i
        size = np.diff(words.offsets)
        byte_doc = np.repeat(np.arange(n), size)
        shares = np.bincount(byte_doc * 256 + words.data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
        out[i:j, :256] = np.sqrt(shares)
        h, doc, count = words.hashes(), words.doc, words.counts
        some = np.maximum(count, 1)
        per_doc = lambda x, doc=doc, n=n: np.bincount(doc[: len(x)], weights=x, minlength=n)
        same = np.zeros(len(h))
        if len(h):
            same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        key = np.sort((h >> np.uint64(20)) | (doc.astype(np.uint64) << np.uint64(44)))  # documents of a slice are fewer than 2^20
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)
        length = words.end - words.start
        first, last = words.data[words.start], words.data[words.end - 1]
        lower, upper = (words.data >= 97) & (words.data <= 122), (words.data >= 65) & (words.data <= 90)
        of_bytes = lambda x, byte_doc=byte_doc, n=n: np.bincount(byte_doc, weights=x, minlength=n) / np.maximum(size, 1)  # noqa: E731,B023
        shapes = (
            np.log1p(count), np.log1p(size), per_doc(length) / some, np.sqrt(per_doc(length.astype(float) ** 2) / some), distinct / some, np.log1p(distinct),
            per_doc(same) / some, per_doc((first >= 65) & (first <= 90)) / some, per_doc((last == 46) | (last == 44)) / some,
            of_bytes(lower), of_bytes(upper), of_bytes(words.data == 10) * np.log1p(size),
        )
        out[i:j, 256:] = np.stack(shapes, 1)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The margin estimates twice the probability less one; the logistic curve of that slope keeps its order to both ends."""
        z = on_grid(x, self.mean, self.scale) @ self.weights / GRID + self.bias
        return 1 / (1 + np.exp(-np.clip(2 * z, -60, 60)))


def on_grid(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features as whole numbers of 1/GRID, so that sums of them and of their products are exact in any order."""
    return np.rint(np.clip((x - mean) / scale, -CLIP, CLIP) * GRID)


@dataclass
class Moments:
    """Of a set of rows: how many, and the sums of their standardised features, with a constant one last, and of all products of two."""

    n: int
    sums: np.ndarray

    @staticmethod
    def none() -> Moments:
        return Moments(0, np.zeros((FEATURES + 1, FEATURES + 1), np.int64))

    def add(self, z: np.ndarray) -> None:
        """Add rows of `on_grid`, some thousands at a time: their products stay below 2^53."""
        for k in range(0, len(z), 4096):
            rows = np.c_[z[k : k + 4096], np.full(len(z[k : k + 4096]), GRID)]
            self.sums += (rows.T @ rows).astype(np.int64)
            self.n += len(rows)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums)

    def means(self) -> np.ndarray:
        return self.sums / (self.n * float(GRID * GRID))


def non_negative_weights(positive: Moments, unlabelled: Moments, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the constant's last) that minimise the non-negative risk with the squared loss l(z) = (1 - z)^2 / 4.

    Where the bracket is positive at the unbounded minimum, that is the answer. Else the bracket is zero at the minimum, which
    is that of pi * E_p[l(g)] + k * bracket for a multiplier k between 0 and 1: convex in the weights, and the bracket falls as
    k grows, so k is found by halving.
    """
    p, u = positive.means(), unlabelled.means()
    penalty = np.diag(np.r_[np.full(len(p) - 1, ridge), 1e-9])
    at = lambda k: np.linalg.solve((prior * (1 - k) * p + k * u) / 2 + penalty, (prior * (1 + k) * p[-1] - k * u[-1]) / 2)
    loss = lambda m, w: (1 + 2 * m[-1] @ w + w @ m @ w) / 4
    bracket = lambda w: loss(u, w) - prior * loss(p, w)
    if bracket(at(1.0)) >= 0:
        return at(1.0)
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if bracket(at(middle)) >= 0 else (low, middle)
    return at(low)


def least_ratio(positive: np.ndarray, counts: np.ndarray, margin: float = 1.01, delta: float = 0.1) -> float:
    """The share of unlabelled to positive scores above the threshold where that ratio and its error bound are least.

    Thresholds are the distinct positive scores; counts: of all unlabelled scores, how many are below the first, from each on to the next, and so on.
    """
    cuts = np.unique(positive)
    n = counts.sum()
    p, u = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive), 1 - np.cumsum(counts)[:-1] / n
    error = margin * (np.sqrt(np.log(4 / delta) / 2 / len(positive)) + np.sqrt(np.log(4 / delta) / 2 / n))
    best = int(((u + error) / p).argmin())
    return float(u[best] / p[best])


def _half_rankings(positive: np.ndarray, moments: list[Moments], mean: np.ndarray, scale: np.ndarray) -> list[QualityModel]:
    """For each half of the rows a ranking that it taught, with even odds."""
    out = []
    for k in (0, 1):
        taught = Moments.none()
        taught.add(on_grid(positive[k::2], mean, scale))
        w = non_negative_weights(taught, moments[k], 0.5)
        out.append(QualityModel(mean, scale, w[:-1], float(w[-1]), 0.5))
    return out


def _over_rows(docs: DataFrame, condition: str, work: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sums by key of what `work` yields, (key, whole numbers), from each task's batches of (features, half) of the rows that `condition` admits.

    Tasks yield a bounded number of rows, which are added by key on their way to the driver. Rows that repeat are in one half.
    """
    halves = docs.filter(condition).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int").alias("half"))
    names = ["key", "v"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((text_features(b), b.column("half").to_numpy()) for b in batches if b.num_rows)
        for key, v in work(parts):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([v.astype(np.int64).tobytes()], pa.binary())], names=names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, v in zip(batch.column("key").to_pylist(), batch.column("v")):
                row = np.frombuffer(v.as_buffer(), np.int64)
                sums[key] = sums[key] + row if key in sums else row.copy()
        for key, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=names)

    schema = "key int, v binary"
    rows = halves.mapInArrow(lean(each), schema).repartition(shuffle_partitions(docs.sparkSession), "key").mapInArrow(lean(added), schema)
    return {r["key"]: np.frombuffer(bytes(r["v"]), np.int64) for r in rows.collect()}


def unlabelled_moments(docs: DataFrame, condition: str, mean: np.ndarray, scale: np.ndarray) -> list[Moments]:
    """Moments of each half of all rows that the SQL condition admits; a row of the matrix is a key of its own, so that no task adds whole matrices of all others."""
    width = FEATURES + 1

    def work(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        held = [Moments.none(), Moments.none()]
        for x, half in parts:
            z = on_grid(x, mean, scale)
            for k in (0, 1):
                held[k].add(z[half == k])
        for k, m in enumerate(held):
            if m.n:
                yield from ((k * width + i, row) for i, row in enumerate(m.sums))

    rows, out = _over_rows(docs, condition, work), []
    for k in (0, 1):
        sums = np.array([rows.get(k * width + i, np.zeros(width, np.int64)) for i in range(width)])
        out.append(Moments(int(sums[-1, -1]) // (GRID * GRID), sums))
    return out


def estimated_prior(docs: DataFrame, condition: str, positive: np.ndarray, rankings: list[QualityModel]) -> float:
    """The share of positives among all rows that the condition admits, each half judged by the ranking that the other half taught."""
    judged = [rankings[1 - k].scores(positive[k::2]) for k in (0, 1)]
    cuts = [np.unique(s) for s in judged]

    def work(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        counts = [np.zeros(len(c) + 1, np.int64) for c in cuts]
        for x, half in parts:
            for k in (0, 1):
                counts[k] += np.bincount(np.searchsorted(cuts[k], rankings[1 - k].scores(x[half == k]), side="right"), minlength=len(cuts[k]) + 1)
        yield from enumerate(counts)

    counts = _over_rows(docs, condition, work)
    found = [least_ratio(judged[k], counts[k]) for k in (0, 1) if k in counts and counts[k].sum()]
    return min(0.99, max(0.01, float(np.mean(found)))) if found else 0.5


def train_quality(docs: DataFrame, labels: DataFrame, train: str = "true", sample: int = SAMPLE) -> QualityModel:
    """Learn from the rows that the SQL condition `train` (on doc_id) admits: at most `sample` trusted positives, and all of `docs` as unlabelled."""
    spark = docs.sparkSession
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(train).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = marked.filter("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample)
    ids = spark.createDataFrame(trusted.collect(), "doc_id bigint")  # `sample` rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in text_features(batch)], pa.binary())], names=["doc_id", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(lean(features), "doc_id bigint, x binary")
    got = sorted((r["doc_id"], bytes(r["x"])) for r in rows.collect())
    p = np.array([np.frombuffer(x, np.float32) for _, x in got], np.float32).reshape(-1, FEATURES)
    blank = QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    if not len(p):
        return blank
    mean, scale = p.mean(0, dtype=np.float64), p.std(0, dtype=np.float64) + LEAST_SCALE
    halves = unlabelled_moments(docs, train, mean, scale)
    prior = 0.5
    if len(p) >= 4 and min(m.n for m in halves) >= 2:
        prior = estimated_prior(docs, train, p, _half_rankings(p, halves, mean, scale))
    taught = Moments.none()
    taught.add(on_grid(p, mean, scale))
    w = non_negative_weights(taught, halves[0] + halves[1], prior)
    return QualityModel(mean, scale, w[:-1], float(w[-1]), prior)


def score_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and score (0 to 1) of each row; a result column takes the place of one in `keep` of its name."""
    keep = others(keep, "score")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.scores(text_features(batch)).astype(np.float64))], names=[*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(lean(scored), f"{fields}, score double")
