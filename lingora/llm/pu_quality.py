"""A quality classifier from positive and unlabelled text.

Trusted positives are documents labelled as good; the unlabelled class is web text as it comes, good and bad mixed. The
share of good text in it, the class prior, is estimated: a first classifier tells positives from unlabelled text, and on
held-back halves the prior is the least ratio of the unlabelled to the positive share above a score, with an allowance
for the sizes of the samples. Then a small network over standardised document statistics minimises the non-negative
unbiased risk  prior * R(positive, +) + max(0, R(unlabelled, -) - prior * R(positive, -))  with logistic loss: where the
second part turns negative, its gradient is reversed, which stops the network from learning single unlabelled texts.
With logistic loss the network's output is a calibrated chance of good quality.

No negative label is used. Both samples are bounded by documented parameters and leave the held-out fold alone; the
features of a scored text come from the whole text.

Defined results: null texts count as empty and are scored like any other; each row is scored for itself; without
positives or unlabelled text all scores are 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm import stats

POSITIVES, UNLABELLED = 8_000, 16_000
HIDDEN = 16
THRESHOLD = 0.3
RESULT = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Network:
    """Standardisation, then one hidden layer."""

    shift: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((np.sqrt(np.maximum(x, 0)) - self.shift) / self.scale, -6, 6)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        h = np.maximum(z @ a + b, 0)
        return h, h @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.standard(x))[1])


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


def _gradient(net: Network, z: np.ndarray, h: np.ndarray, by_output: np.ndarray) -> list[np.ndarray]:
    a, b, c, d = net.weights
    back = np.outer(by_output, c) * (h > 0)
    return [z.T @ back, back.sum(0), h.T @ by_output, np.array([by_output.sum()])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 1500, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Network:
    """Minimises the non-negative risk; without a prior, tells positives from unlabelled text."""
    rng = np.random.default_rng(seed)
    both = np.sqrt(np.maximum(np.concatenate([positive, unlabelled]), 0))
    n = both.shape[1]
    net = Network(both.mean(0), both.std(0) + 1e-6, [rng.standard_normal((n, HIDDEN)) * np.sqrt(2 / n), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1)])
    zp, zu = net.standard(positive), net.standard(unlabelled)
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for t in range(1, steps + 1):
        p, u = zp[rng.integers(0, len(zp), batch)], zu[rng.integers(0, len(zu), batch)]
        (hp, op), (hu, ou) = net.forward(p), net.forward(u)
        sp, su = _sigmoid(op), _sigmoid(ou)
        if prior is None:
            parts = [(p, hp, (sp - 1) / batch), (u, hu, su / batch)]
        else:
            excess = np.logaddexp(0, ou).mean() - prior * np.logaddexp(0, op).mean()
            if excess >= 0:
                parts = [(p, hp, prior * (sp - 1) / batch - prior * sp / batch), (u, hu, su / batch)]
            else:
                parts = [(p, hp, prior * sp / batch), (u, hu, -su / batch)]
        gradients = [sum(g) for g in zip(*(_gradient(net, *x) for x in parts))]
        for w, g, m, v in zip(net.weights, gradients, first, second):
            g = g + decay * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the best bin of a classifier's scores on held-back halves."""
    net = fit(positive[::2], unlabelled[::2], None, steps=600)
    p, u = (np.sort(net.score(x)) for x in (positive[1::2], unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(np.concatenate([p, u]))
    qp, qu = (1 - np.searchsorted(x, at, "left") / len(x) for x in (p, u))
    slack = np.sqrt(np.log(4 / risk) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    ok = qp > 1e-9
    best = int(np.argmin(np.where(ok, (qu + slack * (1 + 1)) / np.maximum(qp, 1e-9), np.inf)))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network, float] | None:
    """The network and the estimated prior; None without texts of both classes."""
    trusted = stats.labelled_sample(labels, "quality", positives, 1)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~stats.held_out())
    web = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).distinct().withColumn("y", F.lit(0))
    p, _ = stats.features_of(docs, trusted.distinct(), positives)
    u, _ = stats.features_of(docs, web, unlabelled)
    if len(p) < 4 or len(u) < 4:
        return None
    prior = class_prior(p, u)
    return fit(p, u, prior), prior


def score(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            s = network.score(x) if network else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    scored = stats.stats(docs).select("doc_id", "features").mapInArrow(run, "doc_id long, score double")
    fold = F.coalesce(stats.held_out(), F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, found[0] if found else None)
