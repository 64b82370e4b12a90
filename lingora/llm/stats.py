"""Statistics of whole documents, and the bounded labelled sample that classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingora.llm.common import WordCodes, batches, covered, rolling, texts

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_LATER = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no character
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_STOPS = b".,;:"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features, and how each may move the verdict of good quality: -1 only down as it grows, 0 freely.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "upper_ratio": -1, "shout_ratio": -1,
    "digit_ratio": 0, "bar_ratio": -1, "stop_ratio": 0, "wide_ratio": 0, "distinct_ratio": 0, "words_a_line": 0, "marked_words": -1,
}
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<float>"


def _without(raw: bytes, gone: bytes) -> int:
    return len(raw.translate(None, gone))


def measure(raw: bytes, memo: WordCodes) -> tuple[list[int], list[float]]:
    """The counts and the features of one text."""
    words = raw.split()
    n, size = len(words), len(raw)
    chars = _without(raw, _SPACE + _LATER)
    symbols = size - _without(raw, _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    codes = memo.of(words)
    windows = rolling(codes, 8)
    repeated = 0
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            repeated = int(covered(n, np.flatnonzero(twice), 8).sum())
    upper, lower, digits = (size - _without(raw, x) for x in (_UPPER, _LOWER, _DIGITS))
    stops = size - _without(raw, _STOPS)
    m, c = max(n, 1), max(chars, 1)
    marked = sum(1 for w in words if w[-1] in _SYMBOLS or w[-1] == 33)
    features = [
        float(np.log1p(n)), chars / m, symbols / c, dup_lines / max(len(lines), 1), repeated / m, upper / max(upper + lower, 1), raw.count(b"!") / m,
        digits / c, raw.count(b"|") / m, stops / m, 1 - (size - _without(raw, bytes(range(0x80)))) / max(size, 1), len(set(words)) / m, n / max(len(lines), 1), marked / m,
    ]
    return [n, chars, symbols, dup_lines, repeated], features


def stats(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, features) of every document; null texts count as empty."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordCodes()
        for batch in batches(it):
            found = [measure(raw, memo) for raw in batch.column(1).to_pylist()]
            counts = [pa.array([x[0][k] for x in found], pa.int64()) for k in range(len(COUNTS))]
            features = pa.array([x[1] for x in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, features], ["doc_id", *COUNTS, "features"])

    return texts(docs).mapInArrow(run, STATS)


def held_out(column: str = "doc_id"):
    """Whether a document belongs to the fold that no classifier learns from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def labelled_sample(labels: DataFrame, target: str, rows: int, value: int | None = None) -> DataFrame:
    """(doc_id, y): at most `rows` labels outside the held-out fold, those with the least hash of their id."""
    kept = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    if value is not None:
        kept = kept.where(F.col(target) == value)
    kept = kept.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    return kept.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)


def sampled(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Documents of a bounded sample, with its columns; the sample is small enough to be sent to every executor."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")


def features_of(docs: DataFrame, sample: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, on the driver: `rows` short rows at most, also if ids repeat."""
    picked = sampled(docs, sample).drop("y")
    found = stats(picked).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "features")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "features").limit(rows).collect()
    return np.array([r.features for r in got], np.float64).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], np.float64)
