"""SentencePiece BPE encoding and decoding by a table of prefixes.

The encoding of a prefix of a text is the encoding of a shorter prefix and one more piece, and that last piece is unique.
So a table that holds the last piece of each prefix holds the encoding of all of them. It is filled from left to right:
an automaton names the pieces that end at a place, and the one is right whose left neighbour, which is the last piece
of the prefix before it, is compatible with it: merging the two pieces' text by itself gives the two back. Ids are then
read off backwards. A text of n characters costs n steps, however long its words are, and no queue of merges.

That adjacent pairs decide is a property of merging by one order (the score of what a merge makes, then its place), also
where pieces share a score, as those of repeated white space do. Pieces that merging their own text does not give
never occur and are left out. A character that is no piece stays alone, as it would among the merges, and becomes bytes.

A text is cut where no piece crosses: before white space, if no piece has white space after another character, and around
characters that are in no piece. What lies between repeats, so its ids are remembered up to a bound on entries and length.

Defined results: null and empty texts give no ids; others begin with a mark of white space that decoding takes away; U+2581
in a text means a space, as in the library, and comes back as one; rows with the same text or doc_id are encoded each for itself; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lingora.llm.common import batches, texts

RESULT = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Fixed values of the file format: kinds of pieces, the model type of BPE, the mark of white space.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE, SPACE = 1, 2, 3, 6, 2, "▁"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of one protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(text, score, kind) by id. A model that asks for something else than merges of the text as it is raises."""
    pieces, trainer, normal = [], {}, {}
    for field, value in fields(data):
        if field == 1:
            piece = dict(fields(value))
            pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(fields(value))
        elif field == 3:
            normal = dict(fields(value))
    plain = not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1)
    if trainer.get(3) != BPE or not trainer.get(35) or not plain or {p[2] for p in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte fallback, a leading space and no further normalization can be read")
    return pieces


class Encoder(dict):
    """Ids by stretch of text. Holds at most BOUND stretches of at most LONG characters, and PAIRS compared pairs."""

    BOUND, LONG, PAIRS = 1_000_000, 48, 500_000

    def __init__(self, model: bytes) -> None:
        import ahocorasick

        super().__init__()
        pieces = read_model(model)
        self.kinds = [kind for _, _, kind in pieces]
        self.size = len(pieces)
        self.score = {text: score for text, score, kind in pieces if kind == NORMAL}
        known = set(chain.from_iterable(self.score))
        self.inside = {text[i : i + 2] for text in self.score for i in range(len(text) - 1)}
        self.texts = [text for text, _, _ in pieces] + sorted(known - self.score.keys())
        self.lengths = list(map(len, self.texts))
        self[""] = ()
        self.bytes = [0] * 256
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(text[1:-1], 16)] = i
        order = {score: i for i, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {text: order[score] for text, score in self.score.items()}
        self.automaton = ahocorasick.Automaton()
        parts: dict[str, tuple[str, str]] = {}
        for i, text in enumerate(self.texts):
            if i >= self.size or self.kinds[i] == NORMAL:
                found, left = self.merged(text)
                if found == [text]:
                    self.automaton.add_word(text, (i, len(text)))
                    if left:
                        parts[text] = text[:left], text[left:]
        self.automaton.make_automaton()
        self.heads = {text: left for text, (left, _) in parts.items()}
        self.tails = {text: right for text, (_, right) in parts.items()}
        self.ordered = all(self.rank.get(part, -1) <= self.rank[text] for text, two in parts.items() for part in two if part in parts)
        self.pairs: dict[int, bool] = {}
        self.names = list(map(str, range(self.size)))
        self.surfaces = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, _, k in pieces]
        self.alone = [c for c in map(chr, range(128)) if c not in known and c != " "]
        self.crossed = any(SPACE in text.lstrip(SPACE) for text in self.score)

    def stretches(self, text: str) -> list[str]:
        """The text, with its spaces marked, in stretches that no piece crosses; some may be empty."""
        text = " " + text.replace(SPACE, " ")
        if self.crossed:
            text = text.replace(" ", SPACE)
        else:
            text = text.replace(" ", " " + SPACE)
            while f"{SPACE} {SPACE}" in text:
                text = text.replace(f"{SPACE} {SPACE}", SPACE + SPACE)
        for c in self.alone:
            if c in text:
                text = text.replace(c, f" {c} ")
        return text.split(" ")

    def merged(self, text: str) -> tuple[list[str], int]:
        """Merging as it is defined, for the few characters of one or two pieces; and the length of the last merge's left part."""
        parts, rank, left = list(text), self.rank, 0
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = rank.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            left = len(parts[at])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, left

    def compatible(self, left: int, right: int) -> bool:
        """Whether the right piece may follow the left one: merging their text gives the two back.

        The merges that made them are undone, the latest first and of equal ones the right one first. What then meets
        in the middle must not make a piece that would have come before the merge just undone.
        """
        a, b = self.texts[left], self.texts[right]
        if self.ordered:
            rank, heads, tails, follows, limit = self.rank, self.heads, self.tails, True, 2 * len(self.texts)
            while follows:
                across = rank.get(a + b)
                if across is not None and 2 * across + 1 < limit:
                    follows = False
                elif a in tails and (b not in heads or rank[a] > rank[b]):
                    limit, a = 2 * rank[a], tails[a]
                elif b in heads:
                    limit, b = 2 * rank[b] + 2, heads[b]
                else:
                    break
        else:
            follows = self.merged(a + b)[0] == [a, b]
        if len(self.pairs) < self.PAIRS:
            self.pairs[left * len(self.texts) + right] = follows
        return follows

    def last_pieces(self, text: str) -> list[int]:
        """For each prefix the last piece of its encoding, or -1 where its last character is in no piece."""
        last, pairs, size, done = [-1] * (len(text) + 1), self.pairs, len(self.texts), -1
        for end, (piece, length) in self.automaton.iter(text):
            if end != done:
                before = last[end + 1 - length]
                if before < 0:
                    follows = True
                else:
                    follows = pairs.get(before * size + piece)
                    if follows is None:
                        follows = self.compatible(before, piece)
                if follows:
                    last[end + 1] = piece
                    done = end
        return last

    def __missing__(self, text: str) -> tuple[int, ...]:
        if 2 < len(text) <= self.LONG and text[-2:] not in self.inside:  # no piece crosses here: a word and the mark that ends it
            return self[text[:-1]] + self[text[-1]]
        last, at, found = self.last_pieces(text), len(text), []
        while at:
            piece = last[at]
            if 0 <= piece < self.size:
                found.append(piece)
                at -= self.lengths[piece]
            else:
                at -= 1
                found.extend(self.bytes[b] for b in reversed(text[at].encode()))
        ids = tuple(reversed(found))
        if len(text) <= self.LONG and len(self) < self.BOUND:
            self[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.stretches(text))))

    def decode(self, ids: list[int]) -> bytes:
        """The text in UTF-8; its first piece loses the mark that encoding put there, bytes that are not UTF-8 become U+FFFD each."""
        parts = list(map(self.surfaces.__getitem__, ids))
        first = next((i for i, piece in enumerate(ids) if self.kinds[piece] != CONTROL), None)
        if first is not None and self.kinds[ids[first]] == NORMAL:
            parts[first] = parts[first].removeprefix(b" ")
        joined = b"".join(parts)
        try:
            str(joined, "utf-8")
            return joined
        except UnicodeDecodeError:
            return joined.decode(errors="each byte").encode()


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each byte", _each_byte)

_ENCODERS: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder for each model in a Python worker; what it remembers outlives a task."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def _apply(docs: DataFrame, model: str, schema: str, finish, columns: dict[str, pa.DataType]) -> DataFrame:
    """The driver reads the model (a fixed file of half a megabyte) and sends it along."""
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches(it):
            out = [finish(encoder, encoder.encode(str(raw, "utf-8"))) for raw in batch.column(1).to_pylist()]
            made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *columns])

    return texts(docs).mapInArrow(run, schema)


def _whole(encoder: Encoder, ids: list[int]) -> tuple:
    return len(ids), ids, str(encoder.decode(ids), "utf-8")


def _digest(encoder: Encoder, ids: list[int]) -> tuple:
    return len(ids), hashlib.sha256(",".join(map(encoder.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)."""
    return _apply(docs, model, RESULT, _whole, {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string()})


def digest(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode(), digested where the ids are made."""
    return _apply(docs, model, DIGEST, _digest, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
