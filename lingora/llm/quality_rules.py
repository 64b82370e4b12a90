"""Quality rules: base rules on counts, then gradient-boosted trees over document statistics.

The trees are grown here with logistic loss over binned features. Features named in stats.FEATURES with -1 are
constrained: a split on one sends no better value to its higher side, and the bounds that follow pass down the tree.
A grown forest is flattened to numpy arrays (feature, threshold, left, right, value), and all documents of a batch walk
down all trees together.

The trees learn from at most `rows` labelled documents outside the held-out fold (a documented bound); all documents
are measured and judged whole. Without labels of both kinds the verdict rests on the base rules.

Defined results: a null text counts as empty, and with fewer than 20 words a text fails the base rules; each row is
judged for itself, repeated or not; labels that are null or of unknown documents are ignored; an empty table gives no
rows; other columns are ignored by judge() and kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm import stats
from lingora.llm.common import WordCodes, batches

ROWS = 12_000
#: Documents at or above this chance of good quality are kept.
THRESHOLD = 0.5
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


class Forest:
    """Trees as flat arrays; the trees' roots are at `roots`. A leaf points to itself."""

    def __init__(self, base: float, depth: int, roots, feature, threshold, left, right, value) -> None:
        self.base, self.depth = base, depth
        self.roots, self.feature, self.left, self.right = (np.asarray(x, np.int32) for x in (roots, feature, left, right))
        self.threshold, self.value = np.asarray(threshold, np.float64), np.asarray(value, np.float64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 8.0, ridge: float = 2.0) -> Forest:
    """Boosts trees on binned features. least: the smallest sum of second derivatives on a side of a split."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(value) - 1

    def best_split(rows, g, h, low, high):
        best = (1e-6, None)
        gs, hs = g[rows].sum(), h[rows].sum()
        for f, sign in enumerate(signs):
            n = len(cuts[f]) + 1
            if n < 2:
                continue
            b = binned[rows, f]
            gl, hl = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g[rows], h[rows]))
            gr, hr = gs - gl, hs - hl
            vl, vr = (np.clip(-a / (c + ridge), low, high) for a, c in ((gl, hl), (gr, hr)))
            gain = -(gl * vl + (hl + ridge) * vl * vl / 2) - (gr * vr + (hr + ridge) * vr * vr / 2)
            v = np.clip(-gs / (hs + ridge), low, high)
            gain += gs * v + (hs + ridge) * v * v / 2
            gain[(hl < least) | (hr < least) | (sign * (vr - vl) < 0)] = 0
            if (k := int(np.argmax(gain))) is not None and gain[k] > best[0]:
                best = (float(gain[k]), (f, k, float(vl[k]), float(vr[k])))
        return best[1]

    def build(rows, g, h, level, low, high) -> int:
        at = node()
        value[at] = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high)) * rate
        split = best_split(rows, g, h, low, high) if level < depth else None
        if split is None:
            total[rows] += value[at]
            return at
        f, k, vl, vr = split
        mid = (vl + vr) / 2
        below, above = ((low, high), (low, high)) if not signs[f] else (((mid, high), (low, mid)) if signs[f] < 0 else ((low, mid), (mid, high)))
        down = binned[rows, f] <= k
        feature[at], threshold[at] = f, float(cuts[f][k])
        left[at] = build(rows[down], g, h, level + 1, *below)
        right[at] = build(rows[~down], g, h, level + 1, *above)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    return Forest(base, depth, roots, feature, threshold, left, right, value)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Forest | None:
    """A forest from the labelled documents of a bounded sample; None without both kinds."""
    x, y = stats.features_of(docs, stats.labelled_sample(labels, "quality", rows), rows)
    if len(np.unique(y)) < 2:
        return None
    return grow(x, y, list(stats.FEATURES.values()), least=min(8.0, max(0.5, len(y) / 200)))


def _verdicts(counts: np.ndarray, features: np.ndarray, forest: Forest | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, repeats = counts[:, 0], counts[:, 4]
    failed = (words < 20) | (100 * repeats > 30 * words)
    score = forest.score(features) if forest else np.ones(len(counts))
    return failed, ~failed & (score >= threshold), score


def judge(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, counts, base_failed, kept, score) of every document."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts = np.stack([batch.column(1 + k).to_numpy() for k in range(5)], 1)
            features = batch.column(6).flatten().to_numpy().astype(np.float64).reshape(len(counts), -1)
            failed, kept, score = _verdicts(counts, features, forest, threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *stats.COUNTS, "base_failed", "kept", "score"])

    return stats.stats(docs).mapInArrow(run, RESULT)


def keep(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that pass the base rules and the trees; one pass, without a join."""
    place = docs.columns.index("text")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordCodes()
        for batch in batches(it, 4 << 20, place):
            found = [stats.measure(raw.as_py().encode() if raw.is_valid else b"", memo) for raw in batch.column(place)]
            counts = np.array([x[0] for x in found], np.int64).reshape(-1, 5)
            features = np.array([x[1] for x in found], np.float32).astype(np.float64).reshape(len(found), -1)
            yield batch.filter(pa.array(_verdicts(counts, features, forest, threshold)[1]))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, forest).withColumn("score", F.round("score", 6))
