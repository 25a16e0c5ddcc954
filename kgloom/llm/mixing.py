"""Mixing sources to target weights (7): soft membership, natively.

A model fitted on a bounded sample of a labelled table (SAMPLE rows, those with
the lowest hash of their doc_id) gives each document posteriors over the domains.
Words fall into BUCKETS by hash; a bucket speaks for or against a domain with the
log ratio of the shares of its documents and the others' that have it, if these
differ by SIGNIFICANT standard errors. A document's sums over its distinct buckets,
their rates by length and its length are calibrated to posteriors by a softmax.

Rates r >= 0 then minimise the least squares (T - t)' W (T - t),
    T_k = sum_i r_i n_i p_ik,
n_i: tokens, p_ik: posteriors, t_k: target totals, by projected gradient from rate 1:
    r_i <- max(0, r_i - p_i' W (T - t)).
W is the inverse of sum n_i p_i p_i' over the documents of positive rate, as then a
step that stays above zero meets the targets at once. A step is one aggregation
over the written posteriors; a rate is an expression of the steps' gradients (one
number a domain), so none is kept between steps.

Defined cases: a null or empty text has no tokens, posteriors by its empty sums and
a rate that changes no total; without labelled rows all posteriors are equal;
labels of domains without a target are ignored, the least domain of a doc_id
holds; targets out of reach give the nearest totals and a warning; rows are kept one
for one; other columns are ignored, and a kept one named like a result gives way to it.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import SPACES, carries, materialize

BUCKETS = 1 << 17
#: Labelled rows that the model is fitted on.
SAMPLE = 20_000
#: Standard errors by which a bucket's shares must differ.
SIGNIFICANT = 5.0
#: Sums are cut at this size for the calibration.
CLIP = 8.0
#: Projected-gradient steps at most; the distance to the targets, by their total, at which they end.
STEPS, TOLERANCE = 24, 0.002


def _buckets(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _n_tokens(text: Column) -> Column:
    """Parts between spaces, without empty ones at the ends."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")


class Domains:
    """What `fit_domains` has learnt: the chosen buckets and their weights by domain, and the calibration."""

    def __init__(self, k: int) -> None:
        self.k, self.chosen, self.weights = k, np.empty(0, np.int64), np.zeros((k, 0))
        self.mean, self.scale, self.softmax = np.zeros(2 * k + 1), np.ones(2 * k + 1), np.zeros((2 * k + 2, k))

    def _sums(self) -> list[Column]:
        """A document's sum of weights for each domain, from its column `chosen` of distinct numbers of chosen buckets."""
        of = lambda table: F.aggregate("chosen", F.lit(0.0), lambda s, b: s + F.get(table, b))
        return [of(_constant(self.weights[d])) for d in range(self.k)]

    def features(self, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """`keep`, n_tokens and the array x of the calibration's features."""
        number = np.full(BUCKETS, -1, np.int64)
        number[self.chosen] = np.arange(len(self.chosen))
        places = F.transform(_buckets(F.col("text")), lambda b: F.get(_constant(number, "int"), b))
        rows = docs.select(*keep, _n_tokens(F.col("text")).cast("long").alias("n_tokens"), F.array_distinct(F.filter(places, lambda i: i >= 0)).alias("chosen"))
        rows = rows.select(*keep, "n_tokens", F.array(*self._sums()).alias("sums"))
        root = F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
        cut = F.transform("sums", lambda x: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x)))
        return rows.select(*keep, "n_tokens", F.concat(cut, F.transform("sums", lambda x: x / root), F.array(F.log1p(F.col("n_tokens").cast("double")))).alias("x"))

    def calibrate(self, x: np.ndarray, domain: np.ndarray, rounds: int = 1500, rate: float = 0.1, decay: float = 1e-4) -> None:
        """Softmax regression by Adam on a sample's features."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z, goal = np.c_[(x - self.mean) / self.scale, np.ones(len(x))], np.eye(self.k)[domain]
        w = np.zeros((z.shape[1], self.k))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            e = z @ w
            e = np.exp(e - e.max(1, keepdims=True))
            g = z.T @ (e / e.sum(1, keepdims=True) - goal) / len(z) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.softmax = w

    @carries("n_tokens", "posteriors")
    def posteriors(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """`keep`, n_tokens and posteriors (array, by domain) of each row."""
        slope = self.softmax[:-1] / self.scale[:, None]
        start = self.softmax[-1] - self.mean @ slope
        z = [sum((F.get("x", F.lit(i)) * float(slope[i, d]) for i in range(len(slope))), F.lit(float(start[d]))) for d in range(self.k)]
        rows = self.features(docs, keep).select(*keep, "n_tokens", F.array(*z).alias("z"))
        rows = rows.select(*keep, "n_tokens", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
        return rows.select(*keep, "n_tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).alias("posteriors"))


def _constant(values: np.ndarray, kind: str = "double") -> Column:
    """An array that the optimizer folds to a constant of the plan."""
    return F.from_json(F.lit(f"[{','.join(f'{x:.6g}' for x in values.tolist())}]"), f"array<{kind}>")


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> Domains:
    """Learn from `labelled` (doc_id, domain)."""
    spark, k, model = docs.sparkSession, len(domains), Domains(len(domains))
    marked = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = spark.createDataFrame(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect(), "doc_id bigint, domain string")
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    taught = materialize(taught.select("text", (F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1).cast("int").alias("domain")), "labelled")
    size = dict(taught.groupBy("domain").count().collect())
    if not size:
        return model
    n = np.array([size.get(d, 0) for d in range(k)], float)
    found = taught.select("domain", F.explode(F.array_distinct(_buckets(F.col("text")))).alias("b")).groupBy("b").agg(*(F.count_if(F.col("domain") == d).alias(f"n{d}") for d in range(k)), F.count("*").alias("n"))
    all_ = float(n.sum())

    def error(d: int) -> Column:
        share, there, rest = F.col("n") / all_, F.col(f"n{d}"), F.col("n") - F.col(f"n{d}")
        gap = there / max(n[d], 1.0) - rest / max(all_ - n[d], 1.0)
        return F.abs(gap) >= F.sqrt(share * (1 - share) * (1 / max(n[d], 1.0) + 1 / max(all_ - n[d], 1.0))) * SIGNIFICANT

    several = [d for d in range(k) if 0 < n[d] < all_]
    apart = [error(d) & (F.col("n") < all_) for d in several]
    rows = found.filter(F.lit(False) if not apart else F.greatest(*apart, F.lit(False))).orderBy("b").collect()  # BUCKETS rows at most
    model.chosen = np.array([r["b"] for r in rows], np.int64)
    there = np.array([[r[f"n{d}"] for r in rows] for d in range(k)], float).reshape(k, -1)
    whole = np.array([r["n"] for r in rows], float)
    model.weights = np.zeros((k, len(rows)))
    for d in several:
        gap = there[d] / n[d] - (whole - there[d]) / (all_ - n[d])
        sure = np.abs(gap) >= SIGNIFICANT * np.sqrt(whole / all_ * (1 - whole / all_) * (1 / n[d] + 1 / (all_ - n[d])))
        ratio = np.log((there[d] + 0.5) / (n[d] + 1)) - np.log((whole - there[d] + 0.5) / (all_ - n[d] + 1))
        model.weights[d] = np.where(sure, ratio, 0.0)
    got = model.features(taught, ("domain",)).collect()  # `sample` rows of a few numbers at most
    model.calibrate(np.array([r["x"] for r in got]), np.array([r["domain"] for r in got]))
    return model


def _rate(steps: list[np.ndarray], p: list[Column]) -> Column:
    rate = F.lit(1.0)
    for g in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((x * float(y) for x, y in zip(p, g, strict=True)), F.lit(0.0)))
    return rate


def fit_rates(rows: DataFrame, targets: list[float]) -> tuple[Column, list[float]]:
    """The rate of each of `rows` (n_tokens, posteriors) as a column, and the expected domain totals that it gives."""
    k = len(targets)
    p = [F.get("posteriors", F.lit(i)) for i in range(k)]
    scale = max(sum(targets), 1.0)
    t = np.array(targets) / scale
    steps: list[np.ndarray] = []
    best, length = (np.inf, 0, np.zeros(k)), 1.0
    for _ in range(STEPS):
        r, n = F.col("r"), F.col("n_tokens")
        at = rows.select("n_tokens", *(x.alias(f"p{i}") for i, x in enumerate(p)), _rate(steps, p).alias("r"))
        sums = [F.sum(r * n * F.col(f"p{i}")).alias(f"t{i}") for i in range(k)]
        sums += [F.sum(F.when(r > 0, n * F.col(f"p{i}") * F.col(f"p{j}"))).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        got = at.agg(*sums).first()
        totals = np.array([got[f"t{i}"] or 0.0 for i in range(k)]) / scale
        off = float(np.abs(totals - t).sum())
        if off < best[0]:
            if best[0] < np.inf and off > 0.999 * best[0]:  # no nearer: out of reach
                best = (off, len(steps), totals)
                break
            best = (off, len(steps), totals)
        else:  # too long a step
            steps, length = steps[: best[1]], length / 2
            if length < 1 / 64:
                break
        if off <= TOLERANCE:
            break
        if off == best[0]:
            h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) / scale
            weight = np.linalg.pinv(h + np.eye(k) * 1e-9 * max(np.trace(h), 1e-9), rcond=1e-8, hermitian=True)
            gradient = weight @ (totals - t)
        steps = [*steps, gradient * length]
    steps = steps[: best[1]]
    if best[0] > TOLERANCE and scale > 1.0:
        warnings.warn(f"targets {targets} are out of reach; the nearest totals are {(best[2] * scale).tolist()}", stacklevel=2)
    return _rate(steps, p), (best[2] * scale).tolist()


@carries("n_tokens", "posteriors", "rate")
def mixing_rates(docs: DataFrame, labelled: DataFrame, shares: dict[str, float], tokens: float | None = None, lead: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, posteriors (by sorted domain) and rate of each row.

    The targets are `shares` of `tokens` (by default what the table has). With
    `lead`, that domain gets 1.05 times its expected tokens, and each other one what
    its share is beside it, or its own expected tokens where it has fewer: a mix
    lowers what there is too much of and repeats no other documents.
    """
    domains = sorted(shares)
    rows = materialize(fit_domains(docs, labelled, domains).posteriors(docs, keep), "posteriors")
    had = rows.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.get("posteriors", F.lit(i))).alias(f"n{i}") for i in range(len(domains)))).first()
    whole = sum(shares.values())
    if tokens is None and lead:
        tokens = 1.05 * (had[f"n{domains.index(lead)}"] or 0) * whole / shares[lead]
        targets = [tokens * shares[d] / whole if d == lead else min(tokens * shares[d] / whole, had[f"n{i}"] or 0.0) for i, d in enumerate(domains)]
    else:
        targets = [(had["n"] or 0 if tokens is None else tokens) * shares[d] / whole for d in domains]
    rate, _ = fit_rates(rows, targets)
    return rows.withColumn("rate", rate)


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks: toxic, low or good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").alias("domain"))


def copies(rate: Column, doc_id: Column) -> Column:
    """How often a document of this rate occurs in the mix: the rate rounded up or down, by a hash of its id, so that the mean is the rate."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
