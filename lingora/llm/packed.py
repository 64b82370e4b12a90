"""Exchanges of packed occurrences.

A corpus has far more windows than rows, so a row for each window would spend most of a shuffle on row headers.
Here each map task packs the occurrences that one bucket gets into a single binary row: codes as they are, document
ids as runs, positions as compressed differences. Buckets are ranges of the mixed code (anchors are minima, so that
their codes are not spread evenly by themselves), one to a shuffle partition, so the
bytes of a bucket fall as the cluster's spark.sql.shuffle.partitions rises. Occurrences are reduced before they are
shipped (a batch ships one document for each code), which bounds what a very common window costs: one entry for each
batch of text, not one for each document.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingora.llm.common import batches, buffer_of, mix, partitions, runs, spread_keys

#: A document with a null id counts as later than all others.
LAST = 2**63 - 1
PACKED = "key int, blob binary"
MARKED = "doc long, tag long, marks binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any fixed-width types as one compressed value; the order is the caller's."""
    import zstandard

    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = zstandard.ZstdCompressor(level=1).compress(raw) if a.dtype != np.uint64 else raw
        parts += [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(small)), small]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    out, at = [], 1
    for _ in range(blob[0]):
        kind, n = struct.unpack_from("<2sQ", blob, at)
        at += 10
        raw = blob[at : at + n]
        at += n
        out.append(np.frombuffer(raw if kind == b"u8" else zstandard.ZstdDecompressor().decompress(raw), "<" + kind.decode()))
    return out


def pack_places(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> bytes:
    """(document, tag, position) triples in an order that keeps a document's entries together."""
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return pack(doc[starts].astype(np.int64), tag[starts].astype(np.uint32), np.diff(np.r_[starts, len(doc)]).astype(np.int32), np.diff(pos, prepend=0).astype(np.int32), *more)


def unpack_places(blob: bytes) -> list[np.ndarray]:
    doc, tag, n, pos, *more = unpack(blob)
    return [np.repeat(doc, n), np.repeat(tag, n), np.cumsum(pos, dtype=np.int64), *more]


def bucket_of(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket is a range of the code."""
    return (((codes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n < 65536 else np.int64)


def chunk_of(doc: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(doc.astype(np.uint64)), n)


def deal(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' parts for each bucket, in their old order."""
    order = np.argsort(bucket, kind="stable")
    arrays = [a[order] for a in arrays]
    b = bucket[order]
    for start, n in zip(*runs(b)):
        yield int(b[start]), [a[start : start + n] for a in arrays]


def rows(pairs: Iterable[tuple[int, bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (key, blob) of bounded size."""
    keys: list[int] = []
    blobs: list[bytes] = []
    held = 0
    for key, blob in pairs:
        keys.append(key)
        blobs.append(blob)
        held += len(blob)
        if held >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["key", "blob"])
            keys, blobs, held = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["key", "blob"])


def by_code(code: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by code, and among equal codes by the other keys; most codes occur once, and are sorted just once."""
    order = np.argsort(code, kind="stable")
    start, n = runs(code[order])
    if (n > 1).any():
        tied = np.flatnonzero(np.repeat(n, n) > 1)
        part = order[tied]
        order[tied] = part[np.lexsort((*(x[part] for x in then[::-1]), code[part]))]
    return order


#: What a map step finds in a batch: codes with their places, places that are decided without any exchange, and, if
#: codes alone are to decide nothing, 32 more bits of each.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray | None]


def told_apart(code: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Numbers of codes by their checks: equal where both are, in the order of codes."""
    order = by_code(code, check)
    c, k = code[order], check[order]
    out = np.empty(len(code), np.uint64)
    out[order] = np.cumsum(np.r_[False, (c[1:] != c[:-1]) | (k[1:] != k[:-1])]) if len(c) else 0
    return out


def exchange(source: DataFrame, find: Callable[..., Found], judge: Callable[..., np.ndarray], batch_bytes: int = 6 << 20) -> DataFrame:
    """Marks of documents: (doc, tag, marks), marks being the int32 positions that were found to hold.

    source: doc, raw, tag and what else `find` needs. find(batch) gives codes with their document, tag and position,
    the places that the batch alone decides, and checks of the codes or None. judge(codes, docs), which gets all entries of a bucket sorted by code
    and document, says which hold.
    """
    spark = source.sparkSession
    n = partitions(spark)
    keys = spread_keys(spark, n)

    def scatter(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in batches(it, batch_bytes):
                code, doc, tag, pos, sure, check = find(batch)
                for b, (c, d, t, p, *k) in deal(bucket_of(mix(code), n), code, doc, tag, pos, *([] if check is None else [check])):
                    yield int(keys[b]), b"\0" + pack_places(d, t, p, c, *k)
                for b, (d, t, p) in deal(chunk_of(sure[0], n), *sure):
                    yield int(keys[b]), b"\1" + pack_places(d, t, p)

        return rows(pairs())

    def gather(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            parts = []
            for batch in it:
                for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if blob[0]:
                        yield key, blob[1:]
                    else:
                        parts.append(unpack_places(blob[1:]))
            if not parts:
                return
            doc, tag, pos, code, *check = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            if check:
                code = told_apart(code, check.pop())
            order = by_code(code, doc)
            holds = np.zeros(len(order), bool)
            holds[order] = judge(code[order], doc[order])
            del order, code
            doc, tag, pos = doc[holds], tag[holds], pos[holds]
            order = np.lexsort((pos, tag, doc))
            doc, tag, pos = doc[order], tag[order], pos[order]
            for b, (d, t, p) in deal(chunk_of(doc, n), doc, tag, pos):
                yield int(keys[b]), pack_places(d, t, p)

        return rows(pairs())

    def settle(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_places(blob) for batch in it for blob in batch.column(1).to_pylist()]
        if not parts:
            return
        doc, tag, pos = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((pos, tag, doc))
        doc, tag, pos = doc[order], tag[order], pos[order].astype(np.int32)
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        ends = np.r_[starts[1:], len(doc)]
        for i in range(0, len(starts), 1000):
            s, e = starts[i : i + 1000], ends[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(tag[s].astype(np.int64)), pa.array([pos[a:b].tobytes() for a, b in zip(s, e)], pa.binary())], ["doc", "tag", "marks"])

    dealt = source.mapInArrow(scatter, PACKED).repartition(n, "key")
    return dealt.mapInArrow(gather, PACKED).repartition(n, "key").mapInArrow(settle, MARKED)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, raw, tag): tag tells apart rows that share a doc_id but not their text."""
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), raw.alias("raw")).withColumn("tag", F.xxhash64("raw").bitwiseAND(F.lit(0xFFFFFFFF)))


def with_marks(docs: DataFrame, marks: DataFrame, how: str = "left") -> DataFrame:
    """(doc, raw, tag, marks): documents beside what was found in them."""
    return docs.join(marks, ["doc", "tag"], how).select("doc", "raw", "tag", "marks")


def marks_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """For each row, its marks (column 3)."""
    return [np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in batch.column(3).to_pylist()]


__all__ = ["LAST", "batches", "buffer_of", "exchange", "keyed", "marks_of", "with_marks"]
