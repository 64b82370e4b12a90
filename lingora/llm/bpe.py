"""Byte-level BPE encoding and decoding, with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each adjacent pair that has a rank waits in the bucket of that rank, as the
list position of its left part. A two-level bitmap over the ranks names the buckets in use, so find-first-set gives the
lowest rank in two steps whatever the length of the pre-token. Entries are never removed: one whose pair has
changed since is stale, and is skipped when its turn comes. A pre-token of n bytes costs O(n log n), also where it is
one run of a single letter over megabytes.

Pre-tokens repeat, so their ids are remembered up to a bound on entries and length; beyond it they are worked out anew.

Defined results: null and empty texts give no ids; white space gives the ids of its own pre-tokens; rows with the same
text or doc_id are encoded each for itself; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lingora.llm.common import batches, texts

RESULT = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines `base64 rank` of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


WORD = 8  # a bitmap word covers 2 ** WORD ranks


class RankQueue:
    """Positions by rank; the lowest rank comes first and, within it, the leftmost position.

    A bucket with one position is that number; more are a heap. Words are 256 bits wide, which Python's integers hold
    as easily as 64, so that two levels cover vocabularies of hundreds of thousands.
    """

    __slots__ = ("buckets", "root", "words")

    def __init__(self) -> None:
        self.buckets: dict[int, int | list[int]] = {}
        self.words: dict[int, int] = {}
        self.root = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = position
            word = rank >> WORD
            self.words[word] = self.words.get(word, 0) | 1 << (rank & 255)
            self.root |= 1 << word
        elif bucket.__class__ is int:
            self.buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The first (rank, position); the queue must not be empty."""
        word = (self.root & -self.root).bit_length() - 1
        bits = self.words[word]
        rank = word << WORD | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if bucket.__class__ is not int:
            position = heappop(bucket)
            if bucket:
                return rank, position
        else:
            position = bucket
        del self.buckets[rank]
        self.words[word] = bits = bits & (bits - 1)
        if not bits:
            self.root &= self.root - 1
        return rank, position

    def __bool__(self) -> bool:
        return self.root != 0


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    find = ranks.get
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    waiting = [find(piece[i : i + 2]) for i in range(n - 1)]  # the rank of the pair that begins at a place, as of now
    waiting.append(None)
    queue = RankQueue()
    push, pop = queue.push, queue.pop
    for i, r in enumerate(waiting):
        if r is not None:
            push(r, i)
    while queue.root:
        r, i = pop()
        if waiting[i] != r:
            continue
        gone = after[i]
        end = after[gone]
        waiting[gone] = None
        after[i] = end
        if end < n:
            before[end] = i
            waiting[i] = r = find(piece[i : after[end]])
            if r is not None:
                push(r, i)
        else:
            waiting[i] = None
        left = before[i]
        if left >= 0:
            r = find(piece[left:end])
            if r != waiting[left]:
                waiting[left] = r
                if r is not None:
                    push(r, left)
    out = []
    i = 0
    while i < n:
        end = after[i]
        out.append(ranks[piece[i:end]])
        i = end
    return tuple(out)


class Encoder(dict):
    """Ids by pre-token. Holds at most BOUND pre-tokens of at most LONG characters."""

    BOUND, LONG = 400_000, 48

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        super().__init__()
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        self.names = [str(i) for i in range(len(self.tokens))]
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= self.LONG and len(self) < self.BOUND:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker; its memory of pre-tokens outlives a task."""
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(data), pattern)
    return _ENCODERS[key]


def _apply(docs: DataFrame, vocabulary: str, pattern: str, schema: str, finish) -> DataFrame:
    """The driver reads the vocabulary (a fixed file of some 50,000 lines) and sends it along."""
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, pattern)
        for batch in batches(it, 4 << 20):
            out = [finish(encoder, encoder.encode(str(raw, "utf-8"))) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array([x[0] for x in out], pa.int64()), **{k: pa.array([x[1][k] for x in out], t) for k, t in finish.columns}})

    return texts(docs).mapInArrow(run, schema)


class _Whole:
    columns = (("ids", pa.list_(pa.int32())), ("decoded", pa.binary()))

    def __call__(self, encoder: Encoder, ids: list[int]):
        return len(ids), {"ids": ids, "decoded": encoder.decode(ids)}


class _Digest:
    columns = (("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))

    def __call__(self, encoder: Encoder, ids: list[int]):
        return len(ids), {"ids_sha256": hashlib.sha256(",".join(map(encoder.names.__getitem__, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(encoder.decode(ids)).hexdigest()}


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)."""
    return _apply(docs, vocabulary, pattern, RESULT, _Whole())


def digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode(), digested where the ids are made."""
    return _apply(docs, vocabulary, pattern, DIGEST, _Digest())


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
