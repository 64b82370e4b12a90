"""Removal of repeated byte strings by suffix arrays that are built by external induced sorting.

A byte goes if a string of `width` bytes that covers it also starts earlier: in a document with a smaller id, or before
in the same one. Suffix arrays are built for shards of the corpus, and shards are cut by content so that all places of
a string fall into one shard: each window of `width` bytes has an anchor, its 40-byte gram of the least code, which
equal windows share; a maximal run of windows with one anchor is a fragment, and its anchor's code names its shard.

 1. Whole copies of an earlier document are known by a digest, and are removed whole if they have `width` bytes.
 2. Anchors alone are exchanged (packed, reduced in each batch): most occur once, and end all their windows.
 3. Fragments of anchors that repeat go to their shards, each batch shipping a fragment once, whatever its copies.
    A shard keeps distinct fragments in a file, each with its earliest place, and sorts the suffixes of all those whose
    anchor code another fragment has. Induction carries common prefixes along (induced.py), so neighbours of `width`
    common bytes are known as they leave; they are places of one string, whose earliest place stays and all others are
    marked. Arrays beyond `memory` bytes are files in the task's own temporary folder, as a task's spills are: a lost
    executor costs no more than its running tasks. Shards shrink as spark.sql.shuffle.partitions rises.

Fragments are told apart by digests of 128 bits; strings are compared byte by byte.

Defined results: a null text is empty; a null doc_id is later than any other; rows that share a doc_id are one document
as to what starts earlier, so equal rows leave each other alone; texts under `width` bytes stay; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm import induced, packed
from lingora.llm.common import batches, buffer_of, mix, partitions, runs, spread_keys

WIDTH, GRAM = 100, 40
#: Copies of a text meet the earliest of them in this many groups.
SALTS = 16
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:int,last:int>>"


def gram_codes(data: np.ndarray, gram: int) -> np.ndarray:
    """Codes of all byte grams of a length that 8 divides."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    held = np.ascontiguousarray(np.concatenate([data, np.zeros(8, np.uint8)]))
    words = mix(np.ndarray((len(data),), "<u8", held, 0, (1,)))
    out = np.zeros(n, np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, gram, 8):
        out *= k
        out += words[at : at + n]
    return mix(out)


def window_anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside documents, their documents' places, their anchors, and all gram codes."""
    codes = gram_codes(data, gram)
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    starts = offsets[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(starts):
        return starts, row, starts, codes
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    least = (codes >> bits) << bits | np.arange(len(codes), dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return starts, row, at, codes


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.uint32)


def _anchor_level(width: int, gram: int, batch: pa.RecordBatch) -> packed.Found:
    """Anchors of a batch; a code that the batch has twice is decided here, and two of its places tell other batches."""
    data, offsets = buffer_of(batch.column(1))
    _, row, at, codes = window_anchors(data, offsets, width, gram)
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    at, row = at[new], row[new]
    doc, tag = _ids(batch)
    code, place = codes[at], at - offsets[row]
    order = np.argsort(code, kind="stable")
    code, row, place = code[order], row[order], place[order]
    starts, n = runs(code)
    several = np.repeat(n, n) > 1
    ship = np.zeros(len(code), bool)
    ship[starts] = ship[starts + n - 1] = True
    back = np.lexsort((place, row))
    several, ship, code, row, place = several[back], ship[back], code[back], row[back], place[back]
    return code[ship], doc[row[ship]], tag[row[ship]], place[ship], (doc[row[several]], tag[row[several]], place[several]), None


def _twice(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    starts, n = runs(code)
    return np.repeat(n, n) > 1 if len(code) else np.zeros(0, bool)


def _fragments(batch: pa.RecordBatch, width: int, gram: int):
    """Fragments of living anchors: (start, number of windows, place of the document, code), and the bytes."""
    data, offsets = buffer_of(batch.column(1))
    starts, row, at, codes = window_anchors(data, offsets, width, gram)
    alive = np.zeros(len(data) + 1, bool)
    for i, marks in enumerate(packed.marks_of(batch)):
        if len(marks):
            alive[offsets[i] + marks] = True
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.r_[cut, len(at)])
    live = alive[at[cut]]
    cut, n = cut[live], n[live]
    return starts[cut], n, row[cut], codes[at[cut]], data, offsets


class Distinct:
    """Distinct fragments, numbered, in a file; only their digests are in memory."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.lengths: list[int] = []
        self.file = tempfile.TemporaryFile(prefix="fragments-")

    def add(self, text: bytes) -> int:
        import xxhash

        k = self.number.setdefault(xxhash.xxh3_128_digest(text), len(self.lengths))
        if k == len(self.lengths):
            self.lengths.append(len(text))
            self.file.write(text)
        return k

    def joined(self, wanted: np.ndarray, store: induced.Store) -> tuple[np.ndarray, np.ndarray]:
        """The wanted ones in a row, a separator after each, as small integers; and where each begins."""
        self.number.clear()
        self.file.flush()
        lengths = np.array(self.lengths, np.int64)
        raw = np.memmap(self.file, np.uint8, "r")
        source, size = (np.cumsum(lengths) - lengths)[wanted], lengths[wanted] + 1
        ends = np.cumsum(size)
        begins = ends - size
        wide = max(int(raw[i : i + induced.WAVE].max()) for i in range(0, len(raw), induced.WAVE)) >= 255
        flat = store.array(int(ends[-1]), np.uint16 if wide else np.uint8)
        at = 0
        while at < len(wanted):
            to = max(at + 1, int(np.searchsorted(ends, begins[at] + induced.WAVE, "right")))
            n = size[at:to]
            place = np.arange(begins[at], ends[to - 1])
            here = raw[np.minimum(place - np.repeat(begins[at:to] - source[at:to], n), len(raw) - 1)].astype(flat.dtype) + 1
            here[ends[at:to] - 1 - begins[at]] = induced.SEPARATOR
            flat[begins[at] : ends[to - 1]] = here
            at = to
        return flat, begins


def repeated_windows(flat: np.ndarray, begins: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int, store: induced.Store) -> np.ndarray:
    """Which places of the joined fragments begin a string of `width` bytes that also begins earlier.

    doc and start are the fragments' earliest places.
    """
    marked = store.array(len(flat), bool)

    def mark(place: np.ndarray, head: np.ndarray) -> None:
        """Of a part of the order that ends with a whole group."""
        several = ~head | np.r_[~head[1:], False]
        place, group = place[several], np.cumsum(head[several])
        fragment = np.searchsorted(begins, place, "right") - 1
        d, s = doc[fragment], start[fragment] + place - begins[fragment]
        by = np.lexsort((s, d, group))
        first, n = runs(group[by])
        least_d, least_s = np.repeat(d[by[first]], n), np.repeat(s[by[first]], n)
        later = (d[by] > least_d) | ((d[by] == least_d) & (s[by] > least_s))
        marked[place[by[later]]] = True

    held = [np.zeros(0, np.int64), np.zeros(0, bool)]
    for place, common in induced.suffixes(flat, width, store):
        held = [np.r_[held[0], place], np.r_[held[1], common < width]]
        last = int(np.flatnonzero(held[1])[-1]) if held[1].any() else 0
        mark(held[0][:last], held[1][:last])
        held = [x[last:] for x in held]
    mark(*held)
    return marked


def _runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of marked places."""
    edges = []
    for i in range(0, len(marked), induced.WAVE):
        part = marked[i : i + induced.WAVE]
        edges.append(i + np.flatnonzero(part != np.r_[marked[i - 1] if i else False, part[:-1]]))
    edge = np.concatenate([*edges, np.zeros(0, np.int64)])
    return edge[::2], edge[1::2] - edge[::2]


def _span_rows(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, count: np.ndarray):
    order = np.lexsort((first, tag, doc))
    return doc[order], tag[order], first[order], count[order].astype(np.int32)


def removed(docs_with_anchors: DataFrame, width: int, gram: int, memory: int, spilled: Accumulator | None = None) -> DataFrame:
    """(doc, tag, marks): runs of repeated windows as int32 pairs (first, number)."""
    spark = docs_with_anchors.sparkSession
    n_parts = partitions(spark)
    keys = spread_keys(spark, n_parts)

    def scatter(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in batches(it, 4 << 20):
                start, n, row, code, data, offsets = _fragments(batch, width, gram)
                doc, tag = _ids(batch)
                raw = data.tobytes()
                order = np.lexsort((start - offsets[row], doc[row])) if len(row) else row
                seen: dict[bytes, int] = {}
                later, first = [], []
                for i, s, k in zip(order.tolist(), start[order].tolist(), n[order].tolist()):
                    text = raw[s : s + k + width - 1]
                    (first if seen.setdefault(text, i) == i else later).append(i)
                # A fragment that the batch has twice is marked here but for its earliest place, which is shipped.
                # Rows that share both document and place do not precede each other; they are shipped as they are.
                by_text = {raw[start[i] : start[i] + n[i] + width - 1]: i for i in first} if later else {}
                sure = []
                for i in later:
                    j = by_text[raw[start[i] : start[i] + n[i] + width - 1]]
                    same = doc[row[i]] == doc[row[j]] and start[i] - offsets[row[i]] == start[j] - offsets[row[j]]
                    (first if same else sure).append(i)
                f = np.array(sorted(first), np.int64)
                for b, (i,) in packed.deal(packed.bucket_of(mix(code[f]), n_parts), f):
                    texts = b"".join(raw[s : s + k + width - 1] for s, k in zip(start[i].tolist(), n[i].tolist()))
                    places = packed.pack_places(doc[row[i]], tag[row[i]], start[i] - offsets[row[i]], n[i].astype(np.int32), code[i], np.frombuffer(texts, np.uint8))
                    yield int(keys[b]), b"\0" + places
                s = np.array(sure, np.int64)
                if len(s):
                    spans = _span_rows(doc[row[s]], tag[row[s]], start[s] - offsets[row[s]], n[s])
                    for b, (d, t, p, k) in packed.deal(packed.chunk_of(spans[0], n_parts), *spans):
                        yield int(keys[b]), b"\1" + packed.pack_places(d, t, p, k)

        return packed.rows(pairs())

    def gather(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            distinct = Distinct()
            parts = []
            for batch in it:
                for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if blob[0]:
                        yield key, blob[1:]
                        continue
                    doc, tag, pos, n, code, data = packed.unpack_places(blob[1:])
                    raw, ends = data.tobytes(), np.cumsum(n.astype(np.int64) + width - 1)
                    which = [distinct.add(raw[a:b]) for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
                    parts.append((doc, tag, pos, n, code, np.array(which, np.int64)))
            if not parts:
                return
            doc, tag, pos, n, code, which = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.lexsort((pos, doc, which))
            first, size = runs(which[order])
            lead = order[first]  # by fragment: its earliest place
            again = (doc != doc[lead][which]) | (pos != pos[lead][which])
            code_of = code[lead]
            _, back, count = np.unique(code_of, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(count[back] > 1)
            begin = length = hit = window = np.zeros(0, np.int64)
            if len(shared):
                store = induced.Store(memory)
                flat, begins = distinct.joined(shared, store)
                begin, length = _runs_of(repeated_windows(flat, begins, doc[lead[shared]], pos[lead[shared]], width, store))
                at = np.searchsorted(begins, begin, "right") - 1
                hit, window = shared[at], begin - begins[at]
                if spilled is not None:
                    spilled.add(store.spilled)
            # What is marked of a fragment holds for all rows at its earliest place.
            at_lead = np.flatnonzero(~again)
            at_lead = at_lead[np.argsort(which[at_lead], kind="stable")]
            low, high = np.searchsorted(which[at_lead], hit, "left"), np.searchsorted(which[at_lead], hit, "right")
            reps = high - low
            occ = at_lead[np.repeat(low, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)] if len(low) else np.zeros(0, np.int64)
            spans = _span_rows(
                np.r_[doc[again], doc[occ]], np.r_[tag[again], tag[occ]],
                np.r_[pos[again], pos[occ] + np.repeat(window, reps)], np.r_[n[again].astype(np.int64), np.repeat(length, reps)],
            )
            for b, (d, t, p, k) in packed.deal(packed.chunk_of(spans[0], n_parts), *spans):
                yield int(keys[b]), packed.pack_places(d, t, p, k)

        return packed.rows(pairs())

    def settle(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [packed.unpack_places(blob) for batch in it for blob in batch.column(1).to_pylist()]
        if not parts:
            return
        doc, tag, pos, n = _span_rows(*(np.concatenate(x) for x in zip(*parts)))
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        both = np.stack([pos.astype(np.int32), n], 1)
        ends = np.r_[starts[1:], len(doc)]
        for i in range(0, len(starts), 1000):
            s, e = starts[i : i + 1000], ends[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(tag[s].astype(np.int64)), pa.array([both[a:b].tobytes() for a, b in zip(s, e)], pa.binary())], ["doc", "tag", "marks"])

    dealt = docs_with_anchors.mapInArrow(scatter, packed.PACKED).repartition(n_parts, "key")
    return dealt.mapInArrow(gather, packed.PACKED).repartition(n_parts, "key").mapInArrow(settle, packed.MARKED)


def _cut(width: int, it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents beside their runs of repeated windows, to what is left of them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
    for batch in batches(it):
        out: list[list] = [[] for _ in schema]
        for doc, raw, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            spans: list[list[int]] = []
            if marks:
                for first, n in np.frombuffer(marks, np.int32).reshape(-1, 2).tolist():
                    last = first + n + width - 1
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last)
                    else:
                        spans.append([first, last])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            gone = sum(b - a for a, b in spans)
            for column, value in zip(out, (None if doc == packed.LAST else doc, len(raw), gone, len(spans), kept.hexdigest(), [{"first": a, "last": b - 1} for a, b in spans])):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def _whole(width: int, it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies (doc, tag, size) as documents with one run of all their windows."""
    for batch in it:
        marks = [np.array([0, n - width + 1], np.int32).tobytes() for n in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())], ["doc", "tag", "marks"])


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, memory: int = 8 << 20, spilled: Accumulator | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are removed runs of bytes, by place.

    spilled: gets the bytes of the sorters' arrays that went to files.
    """
    if gram % 8 or not 8 <= gram <= width <= 254:
        raise ValueError("gram must be a multiple of 8, and width at least as large and 254 at most")
    source = packed.keyed(docs)
    described = source.select("doc", "tag", F.md5("raw").alias("digest"), F.length("raw").alias("size")).where(F.col("size") >= width)
    earliest = described.groupBy("digest").agg(F.min("doc").alias("least"))
    salted = earliest.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    described = described.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    copies = described.join(salted, ["digest", "salt"]).where("doc > least").select("doc", "tag", "size").distinct()
    anchors = packed.exchange(source, partial(_anchor_level, width, gram), _twice, 3 << 20)
    living = packed.with_marks(source, anchors.join(copies, ["doc", "tag"], "left_anti"), "inner")
    marks = removed(living, width, gram, memory, spilled).unionByName(copies.mapInArrow(partial(_whole, width), packed.MARKED))
    return packed.with_marks(source, marks).mapInArrow(partial(_cut, width), RESULT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


#: All windows of all texts, grouped; for small tables.
ORACLE_SQL = r"""
WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS t FROM documents),
k AS (SELECT doc_id, unnest(range(0, length(t) // 2 - 99)) AS i, t FROM h),
s AS (SELECT doc_id, i, substr(t, (2 * i + 1)::BIGINT, 200) AS s FROM k),
b AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5_number(s) ORDER BY doc_id, i) AS nth FROM s) WHERE nth > 1),
v AS (SELECT doc_id, i, i - coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) > 100 AS new FROM b),
g AS (SELECT doc_id, min(i) AS first, max(i) + 100 AS stop FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM v) GROUP BY doc_id, grp),
q AS (SELECT doc_id, first, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM g),
a AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(stop - first)::BIGINT AS gone, max(stop) AS last FROM g GROUP BY doc_id),
kept AS (SELECT q.doc_id, string_agg(substr(t, (2 * before + 1)::BIGINT, (2 * (first - before))::BIGINT), '' ORDER BY first) AS head FROM q JOIN h USING (doc_id) GROUP BY q.doc_id)
SELECT h.doc_id, (length(t) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(t, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM h LEFT JOIN a USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


__all__ = ["op7_suffix_dedup", "repeated_bytes"]
