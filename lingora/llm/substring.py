"""Substring dedup over words, by level-wise doubling.

A passage of `width` words that also starts in a document with a smaller id is removed. Testing all windows of that
width at once would ship one code for each word of the corpus. Instead, windows of a short length are tested first, and
only those that repeat are extended to twice that length (cut at `width`), level by level, until a level has no
candidates, where all later ones are left out, or the width is reached. The first level needs just one short window for each long one: its anchor, the
window of the short length with the smallest code, which equal long windows share. Anchors are a quarter of all words,
and one that occurs in a single document ends all long windows that it stands for.

Levels before the last select, so a chance collision of their 64-bit codes costs nothing but work. At the last level, a
code is compared with 32 more bits of another code of the same words: 96 bits decide.

Defined results: a null text has no words, and a null doc_id counts as later than any other; rows that share a doc_id
are one document as to who is earlier, each with its own text; documents of fewer than `width` words keep all; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lingora.llm import packed
from lingora.llm.common import WordCodes, batches, covered, durable, rolling, runs

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>"


def _words(batch: pa.RecordBatch, memo: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all documents in a row, and each document's offset."""
    each = [memo.of(raw.split()) for raw in batch.column(1).to_pylist()]
    offsets = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(x) for x in each], out=offsets[1:])
    return np.concatenate(each) if each else np.zeros(0, np.uint64), offsets


def _inside(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, and the document's place in the batch."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][row] + within, row


def anchors(codes: np.ndarray, starts: np.ndarray, short: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` words, the start of its anchor; and the codes of all short windows."""
    grams = rolling(codes, short)
    if not len(starts):
        return np.zeros(0, np.int64), grams
    best, at = grams[starts], starts.copy()
    for j in range(1, width - short + 1):
        here = grams[starts + j]
        better = here < best
        best[better] = here[better]
        at[better] = starts[better] + j
    return at, grams


def _firsts(code: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each code and document (its first place), sorted by code and document, and which it was."""
    order = np.lexsort((pos, tag, doc, code))
    code, doc, tag, pos = code[order], doc[order], tag[order], pos[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])] if len(code) else np.zeros(0, bool)
    return code[new], doc[new], tag[new], pos[new], order[new]


def _reduced(code, doc, tag, pos, repeated_only: bool, check: np.ndarray | None = None) -> packed.Found:
    """Ships a single document for each code; the others of the batch are decided here.

    repeated_only: a code holds for all its documents if it has two (the first level); otherwise for all but the least.
    """
    own, checks = code, check
    if check is not None:
        code = packed.told_apart(own, check)
    code, doc, tag, pos, at = _firsts(code, doc, tag, pos)
    starts, n = runs(code)
    least = np.repeat(doc[starts], n) if len(code) else doc
    later = doc != least
    if repeated_only:
        several = np.repeat(np.logical_or.reduceat(later, starts), n) if len(code) else later
        sure = several
        # Of a code that the batch alone decides, two entries tell the other batches that it repeats.
        ship = np.zeros(len(code), bool)
        ship[starts] = ship[starts + n - 1] = True
        sure_out = (doc[sure], tag[sure], pos[sure])
    else:
        sure = later
        ship = ~later
        sure_out = (doc[sure], tag[sure], pos[sure])
    order = np.lexsort((sure_out[2], sure_out[1], sure_out[0]))
    sure_out = tuple(x[order] for x in sure_out)
    sent = np.flatnonzero(ship)
    sent = sent[np.lexsort((pos[sent], tag[sent], doc[sent]))]
    return own[at[sent]], doc[sent], tag[sent], pos[sent], sure_out, None if checks is None else checks[at[sent]]


def _in_two(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    starts, n = runs(code)
    if not len(code):
        return np.zeros(0, bool)
    last = doc[starts + n - 1]
    return np.repeat(doc[starts] != last, n)


def _not_least(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    starts, n = runs(code)
    return doc != np.repeat(doc[starts], n) if len(code) else np.zeros(0, bool)


def _first_level(memo: WordCodes, short: int, width: int, batch: pa.RecordBatch) -> packed.Found:
    codes, offsets = _words(batch, memo)
    starts, row = _inside(offsets, width)
    at, grams = anchors(codes, starts, short, width)
    keep = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    at, row = at[keep], row[keep]
    doc, tag = _ids(batch)
    return _reduced(grams[at], doc[row], tag[row], at - offsets[row], True)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.uint32)


def _spread(marked: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Marks the later places in a document of the codes whose first place is marked."""
    if not marked.any():
        return marked
    return np.isin(codes, codes[marked])


def _next_level(memo: WordCodes, short: int, long: int, width: int, last: bool, batch: pa.RecordBatch) -> packed.Found:
    """Extends what repeats at the short length."""
    codes, offsets = _words(batch, memo)
    starts, row = _inside(offsets, width)
    at, grams = anchors(codes, starts, short, width)
    alive = np.zeros(len(codes) + 1, bool)
    for i, marks in enumerate(packed.marks_of(batch)):
        if len(marks):
            alive[offsets[i] + marks] = True
    survives = np.zeros(len(starts), bool)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            survives[a:b] = _spread(alive[at[a:b]], grams[at[a:b]])
    starts, row = starts[survives], row[survives]
    doc, tag = _ids(batch)
    if not last:
        at, grams = anchors(codes, starts, long, width)
        keep = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        at, row = at[keep], row[keep]
        return _reduced(grams[at], doc[row], tag[row], at - offsets[row], True)
    check = (rolling(codes, width, 0xC2B2AE3D27D4EB4F)[starts] >> np.uint64(32)).astype(np.uint32)
    return _reduced(rolling(codes, width)[starts], doc[row], tag[row], starts - offsets[row], False, check)


def _spans(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def _cut(width: int, it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordCodes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
    for batch in batches(it):
        out: list[list] = [[], [], [], [], []]
        for doc, raw, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), packed.marks_of(batch)):
            words = raw.split()
            gone, spans = 0, []
            n = len(words)
            if len(marks):
                codes = rolling(memo.of(words), width)
                marked = np.zeros(len(codes), bool)
                marked[marks] = True
                lost = covered(n, np.flatnonzero(_spread(marked, codes)), width)
                gone, spans = int(lost.sum()), _spans(lost)
                words = [w for w, x in zip(words, lost.tolist()) if not x]
            for column, value in zip(out, (None if doc == packed.LAST else doc, n, gone, hashlib.sha256(b" ".join(words)).hexdigest(), spans)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def levels(width: int, start: int | None = None) -> list[int]:
    """Lengths of the levels: each twice the one before, the last cut to the width."""
    length = start or (width + 1) // 2
    out = [min(length, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def repeated_words(docs: DataFrame, width: int = 13, start: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): spans are the removed runs of words, by place."""
    source = packed.keyed(docs)
    steps = levels(width, start)
    memo = WordCodes()
    if len(steps) == 1:
        steps = [width, width]
    marks = durable(packed.exchange(source, partial(_first_level, memo, steps[0], width), _in_two), small=True)
    for i, (short, long) in enumerate(zip(steps, steps[1:])):
        if marks.isEmpty():
            break
        last = i == len(steps) - 2
        alive = packed.with_marks(source, marks, "inner")
        marks = packed.exchange(alive, partial(_next_level, memo, short, long, width, last), _not_least if last else _in_two)
        if not last:
            marks = durable(marks, small=True)
    return packed.with_marks(source, marks).mapInArrow(partial(_cut, width), RESULT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.drop("spans")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT s, min(doc_id) AS d FROM k GROUP BY s),
bad AS (SELECT k.doc_id, k.i FROM k JOIN m USING (s) WHERE m.d < k.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM bad, range(13) AS t(j)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
