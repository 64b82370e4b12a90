"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in a normal form: lower case, with each run of ASCII white space and punctuation as one space. Items
are cut into parts of PART bytes, one every STRIDE bytes; an item of WHOLE bytes or fewer is a part as a whole too, so
that edits which stand close together are weighed against all of it. A document leaks an item if some part of it aligns
with a stretch of the document within the part's edit budget k, a sixteenth of its length. A part that is shorter than a
q-gram is searched as it is, between word boundaries.

By the q-gram lemma such a stretch shares at least m - q + 1 - k * q of the part's q-grams, and since k edits shift the
alignment by k places at most, all of them lie within k + 1 neighbouring diagonals (place in the document less place in
the part). So the shared q-grams are counted in bands of 2 * (k + 1) diagonals, each overlapping the next by half; some
band holds all of a true match. Bands that reach the bound are verified by a banded alignment, all of a batch at once.
The filter loses nothing and the alignment admits nothing false, so the result is that of comparing everything.

The benchmark is cut by Spark and dealt into blocks of some BLOCK bytes of parts. Each block is one pass over the
documents with an index of its own, which is dropped before the next, so a larger benchmark takes more passes, not more
memory of the driver or of a task. Usual benchmarks are one block, judged in a single pass without any shuffle.

Defined results: null, empty and blank texts leak nothing; items without a letter or digit are no evidence, as are null
ones; a null item_id counts as -1; repeated parts count each; each row is judged for itself, repeated or not; with an
empty benchmark nothing leaks; an empty table gives no rows; other columns are ignored by judge() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm.common import batches, durable, mix

Q, PART, STRIDE, WHOLE, RATE = 12, 64, 16, 200, 16
BLOCK = 4 << 20
RESULT = "doc_id long, leaked boolean, item_ids array<long>, n_regions long"
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_FILTER_BITS = 21


def normal(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_FORM).split())


def budget(m: int) -> int:
    """Edits allowed in a part of m bytes; few enough for the lemma's bound to be 1 at least."""
    return max(0, min(m // RATE, (m - Q) // Q))


def cut(text: bytes) -> list[bytes]:
    """Parts of an item in normal form."""
    m = len(text)
    if m <= PART:
        return [text] if text else []
    starts = [*range(0, m - PART, STRIDE), m - PART]
    return [text[s : s + PART] for s in starts] + [text] * (m <= WHOLE)


@dataclass
class Index:
    """The parts of a block and their q-grams, sorted by code."""

    item: np.ndarray  # item of each part
    text: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    code: np.ndarray
    first: np.ndarray  # of the entries of each code
    part: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # by the leading bits of a code, whether there may be such a code
    short: dict[bytes, list[int]] = field(default_factory=dict)  # items by those parts that have no q-gram


def codes(data: np.ndarray) -> np.ndarray:
    """Codes of all q-grams of a byte array (q = 12: the bytes, 8 and 4, mixed)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(np.concatenate([data, np.zeros(8, np.uint8)]))
    low = np.ndarray((n,), "<u8", data, 0, (1,)).astype(np.uint64)
    high = np.ndarray((n,), "<u4", data, 8, (1,)).astype(np.uint64)
    low *= np.uint64(0x9E3779B97F4A7C15)
    low ^= low >> np.uint64(29)
    low += high * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(low)


def index(parts: list[tuple[int, bytes]]) -> Index:
    """parts: (item_id, part)."""
    short: dict[bytes, list[int]] = {}
    for item, t in parts:
        if len(t) < Q:
            short.setdefault(t, []).append(item)
    parts = [x for x in parts if len(x[1]) >= Q]
    text = [t for _, t in parts]
    each = [codes(np.frombuffer(t, np.uint8)) for t in text]
    sizes = [len(x) for x in each]
    code = np.concatenate([*each, np.zeros(0, np.uint64)])
    part = np.repeat(np.arange(len(text), dtype=np.int32), sizes)
    place = np.concatenate([*(np.arange(n, dtype=np.int16) for n in sizes), np.zeros(0, np.int16)])
    order = np.argsort(code, kind="stable")
    code, part, place = code[order], part[order], place[order]
    distinct, first = np.unique(code, return_index=True)
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(distinct >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    k = np.array([budget(len(t)) for t in text], np.int64)
    m = np.array([len(t) for t in text], np.int64)
    return Index(np.array([i for i, _ in parts], np.int64), text, k, m - Q + 1 - k * Q, distinct, np.r_[first, len(code)].astype(np.int32), part, place, maybe, short)


def _hits(ix: Index, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the data, part, place in the part) of all shared q-grams."""
    code = codes(data)
    at = np.flatnonzero(ix.maybe[(code >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    code = code[at]
    slot = np.minimum(np.searchsorted(ix.code, code), max(len(ix.code) - 1, 0))
    same = ix.code[slot] == code if len(ix.code) else np.zeros(len(code), bool)
    at, slot = at[same], slot[same]
    n = (ix.first[slot + 1] - ix.first[slot]).astype(np.int64)
    entry = np.repeat(ix.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(at, n), ix.part[entry].astype(np.int64), ix.place[entry].astype(np.int64)


def _aligned(ix: Index, data: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each part aligns, within its budget, along the band of diagonals that begins at `begin`.

    Bytes outside of the document [low, high) match nothing. All candidates' parts are of one length.
    """
    m, k = len(ix.text[part[0]]), int(ix.budget[part[0]])
    width = 2 * (k + 1) + 2 * k
    pattern = np.frombuffer(b"".join(ix.text[p] for p in part), np.uint8).reshape(-1, m)
    origin = (begin - k)[:, None] + np.arange(width)
    steps = np.arange(width, dtype=np.int16)
    cost = np.zeros((len(part), width), np.int16)
    for i in range(m):
        at = origin + i
        inside = (at >= low[:, None]) & (at < high[:, None])
        unlike = ~inside | (data[np.clip(at, 0, len(data) - 1)] != pattern[:, i : i + 1])
        best = cost + unlike
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(best - steps, axis=1) + steps
    return cost.min(1) <= k


def leaks(ix: Index, docs: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """For each text in normal form, the items that it leaks and the number of parts found."""
    found = _long_leaks(ix, docs)
    if not ix.short:
        return found
    lengths = sorted({t.count(b" ") + 1 for t in ix.short})
    for d, t in enumerate(docs):
        words = t.split(b" ")
        said = {x for k in lengths for x in (b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if x in ix.short}
        if said:
            more = [i for x in said for i in ix.short[x]]
            found[d] = np.union1d(found[d][0], np.array(more, np.int64)), found[d][1] + len(more)
    return found


def _long_leaks(ix: Index, docs: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """leaks() by the parts that have q-grams."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    data = np.frombuffer(b"\0".join(docs) + b"\0", np.uint8) if docs else np.zeros(0, np.uint8)
    nothing = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, int]] = [(nothing, 0)] * len(docs)
    at, part, place = _hits(ix, data)
    if not len(at):
        return found
    doc = np.searchsorted(ends, at, "right")
    half = ix.budget[part] + 1
    band = (at - place) // half
    doc, part, place, band = (np.concatenate([x, y]) for x, y in ((doc, doc), (part, part), (place, place), (band, band - 1)))
    # Most hits are on parts of which a document has far too few; they go before anything is sorted by diagonal.
    key = doc * len(ix.text) + part
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    ok = n[back] >= 2 * ix.bound[part]
    doc, part, place, band = doc[ok], part[ok], place[ok], band[ok]
    if not len(doc):
        return found
    order = np.lexsort((place, band, part, doc))
    doc, part, place, band = doc[order], part[order], place[order], band[order]
    new_band = np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (band[1:] != band[:-1])]
    new_place = new_band | np.r_[True, place[1:] != place[:-1]]
    starts = np.flatnonzero(new_band)
    distinct = np.add.reduceat(new_place.astype(np.int64), starts)
    doc, part, band = doc[starts], part[starts], band[starts]
    ok = distinct >= ix.bound[part]
    doc, part, band = doc[ok], part[ok], band[ok]
    if not len(doc):
        return found
    true = np.zeros(len(doc), bool)
    sizes = np.array([len(t) for t in ix.text])[part]
    for m in np.unique(sizes):
        of_size = np.flatnonzero(sizes == m)
        for i in range(0, len(of_size), 4096):
            s = of_size[i : i + 4096]
            true[s] = _aligned(ix, data, begins[doc[s]], begins[doc[s]] + lengths[doc[s]], part[s], band[s] * (ix.budget[part[s]] + 1))
    pairs = np.unique(np.stack([doc[true], part[true]]), axis=1)
    for d in np.unique(pairs[0]):
        parts = pairs[1][pairs[0] == d]
        found[d] = np.unique(ix.item[parts]), len(parts)
    return found


def parts_of(benchmark: DataFrame) -> DataFrame:
    """(item, part) of all items."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 20):
            found = [(item, p) for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in cut(normal(raw))]
            for i in range(0, len(found), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found[i : i + 20_000]), (pa.int64(), pa.binary()))], ["item", "part"])

    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item"), F.encode("text", "UTF-8").alias("raw"))
    return items.mapInArrow(run, "item long, part binary")


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's blocks, one after another; a block's parts are all that the driver ever holds."""
    parts = durable(parts_of(benchmark), small=True)
    n = max(1, -(-(parts.agg(F.sum(F.length("part"))).first()[0] or 0) // BLOCK))
    mine = F.pmod(F.xxhash64("part", "item"), F.lit(n))
    for b in range(n):
        yield index([(r.item, bytes(r.part)) for r in parts.where(mine == b).collect()])


def _judged(it: Iterable[pa.RecordBatch], ix: Index) -> Iterator[pa.RecordBatch]:
    """Rows (doc, raw, ...) to (doc_id, leaked, item_ids, n_regions) by one block."""
    for batch in batches(it, 4 << 20):
        found = leaks(ix, [normal(x) for x in batch.column(1).to_pylist()])
        regions = [n for _, n in found]
        columns = [pa.array([n > 0 for n in regions], pa.bool_()), pa.array([x.tolist() for x, _ in found], pa.list_(pa.int64())), pa.array(regions, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], ["doc_id", "leaked", "item_ids", "n_regions", *batch.schema.names[2:]])


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("raw"))


def _hits_by_passes(docs: DataFrame, first: Index, others: Iterable[Index]) -> DataFrame:
    """(doc_id, digest, item_ids, n_regions) of what leaks, by a pass for each block; each is kept before the next begins."""
    keyed, hits = _raw(docs).withColumn("digest", F.md5("raw")), None
    for ix in _chained(first, others):
        sent = docs.sparkSession.sparkContext.broadcast(ix)
        found = keyed.mapInArrow(lambda it: _judged(it, sent.value), RESULT + ", digest string").where("leaked")
        here = durable(found.select("doc_id", "digest", "item_ids", "n_regions").distinct(), small=True)
        sent.destroy()
        hits = here if hits is None else hits.unionByName(here)
    together = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
    return hits.groupBy("doc_id", "digest").agg(together, F.sum("n_regions").alias("n_regions"))


def _chained(first: Index, others: Iterator[Index]) -> Iterator[Index]:
    yield first
    yield from others


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, leaked, item_ids, n_regions) of every document."""
    todo = blocks(benchmark)
    first, second = next(todo), next(todo, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)
        return _raw(docs).mapInArrow(lambda it: _judged(it, sent.value), RESULT)
    hits = _hits_by_passes(docs, first, _chained(second, todo))
    rows = _raw(docs).select("doc_id", F.md5("raw").alias("digest")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.digest") == F.col("h.digest"))
    none = F.array().cast("array<long>")
    return rows.join(hits.alias("h"), same, "left").select("d.doc_id", F.col("h.digest").isNotNull().alias("leaked"), F.coalesce("h.item_ids", none).alias("item_ids"), F.coalesce("h.n_regions", F.lit(0).cast("long")).alias("n_regions"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that leak nothing; one pass without a join, if the benchmark is one block."""
    todo = blocks(benchmark)
    first, second = next(todo), next(todo, None)
    place = docs.columns.index("text")
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches(it, 4 << 20, place):
                found = leaks(sent.value, [normal(x.encode()) if x else b"" for x in part.column(place).to_pylist()])
                yield part.filter(pa.array([n == 0 for _, n in found], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    hits = _hits_by_passes(docs, first, _chained(second, todo)).select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.md5(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))) == F.col("__digest"))
    return docs.join(hits, same, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
