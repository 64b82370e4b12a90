"""Terms in texts: all places of a dictionary's terms, and what is made of them.

A dictionary whose automaton is small, by its measured size, is sent to the tasks as flat arrays: the next state for each
state and class of character, the pattern that ends in a state, and the next shorter one that ends there too. A batch of texts
is cut into lanes that overlap by the longest pattern, and one step moves all lanes on by a character, so neither many
terms nor long texts cost a loop over them. A larger dictionary is dealt by the first word of its terms and
joined with the words of the texts; no part of it goes through the driver.

A term is found in any case, also in its plural, where neither a letter nor a digit of ASCII stands before or after it. Texts
are compared in lower case, or if that changes a text's length with ASCII alone in lower case.

Defined results: a null text has null for `found`, an empty one none; empty terms, wildcards `.../*` and single ideographs are
no terms; of equal places the longer term comes first, then the earlier one.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lingora.sources import dims

#: Characters of all patterns that may go through the driver, and cells of the automaton's table that tasks may be sent.
CHARACTERS, CELLS = 200_000, 16_000_000
LANE, LANES = 256, 8192
#: Bytes of texts that are worked on at once: what Python makes of them is many times that.
PIECE = 1 << 20
FOUND = "array<struct<start:int,end:int,less:int,ord:int,value:string>>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII = str.maketrans(_UPPER, _UPPER.lower())
_CJK = "[㐀-䶿一-鿿豈-﫿]"
_PUNCTUATION = re.compile(r"[,.;:!?()\[\]{}\"'`-]+")
_HOLE = re.compile(r"\{\{[\s\S]*?\}\}|\$\{[\s\S]*?\}")


def folded(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII)


def fold_column(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) == F.length(text), low).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def patterns(glossary: DataFrame) -> DataFrame:
    """(pattern, less, ord, value) of a glossary (key, value, ord): each term in lower case, and its plural."""
    key = F.col("key")
    terms = glossary.where((F.length(key) > 0) & ~key.endswith("*") & ~key.rlike(rf"^{_CJK}\z"))
    last = F.regexp_extract(key, "([A-Za-z]+)\\z", 1)
    ending = F.when(last.endswith("y"), F.concat(F.expr("substr(last, 1, length(last) - 1)"), F.lit("ies"))).when(F.lower("last").rlike(r"(?:[sxz]|ch|sh)\z"), F.concat("last", F.lit("es"))).otherwise(F.concat("last", F.lit("s")))
    plural = F.when(key.rlike(r"^[A-Za-z][A-Za-z\s-]*\z") & (F.col("last") != ""), F.concat(F.expr("substr(key, 1, length(key) - length(last))"), ending))
    rows = terms.withColumn("last", last).select((-F.length(key)).alias("less"), F.col("ord").cast("int").alias("ord"), "value", F.explode(F.array_distinct(F.array_compact(F.array(key, plural)))).alias("pattern"))
    return rows.select(fold_column(F.col("pattern")).alias("pattern"), "less", "ord", "value")


@dataclass
class Automaton:
    """step[state, class] is the next state; ends[state] the pattern that ends there, or -1; also[state] the next state that does, or 0."""

    classes: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    also: np.ndarray
    lengths: np.ndarray

    @property
    def longest(self) -> int:
        return int(self.lengths.max(initial=1))

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end, pattern) of all occurrences between boundaries, in order of text and start."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(map(folded, texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[np.minimum(codes, len(self.classes) - 1)]
        first = np.r_[0, np.cumsum(sizes)]
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        start = first[owner] + (np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(lanes)[:-1]], lanes)) * LANE
        before = self.longest - 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(owner), LANES):
            own, at = owner[i : i + LANES], start[i : i + LANES] - before
            low, high = first[own], np.minimum(at + before + LANE, first[own + 1])
            state = np.zeros(len(own), np.int32)
            for t in range(before + LANE):
                place = at + t
                inside = (place >= low) & (place < high)
                state = np.where(inside, self.step[state, kind[np.where(inside, place, 0)]], 0)
                if t >= before and (hit := np.flatnonzero((self.ends[state] >= 0) | (self.also[state] > 0))).size:
                    found.append((own[hit], place[hit], state[hit]))
        rows, last, state = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        out = []
        while len(rows):
            some = self.ends[state] >= 0
            out.append((rows[some], last[some], self.ends[state[some]]))
            rows, last, state = (x[self.also[state] > 0] for x in (rows, last, self.also[state]))
        rows, last, pattern = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        begin = last + 1 - self.lengths[pattern]
        word = np.zeros(128, bool)
        word[48:58] = word[97:123] = True
        solid = word[np.minimum(codes, 127)] & (codes < 127)
        lone = ((begin == first[rows]) | ~solid[np.maximum(begin - 1, 0)]) & ((last + 1 == first[rows + 1]) | ~solid[np.minimum(last + 1, max(len(codes) - 1, 0))]) if len(rows) else np.zeros(0, bool)
        rows, begin, last, pattern = rows[lone], begin[lone], last[lone], pattern[lone]
        order = np.lexsort((pattern, begin, rows))
        rows, begin, last, pattern = rows[order], begin[order], last[order], pattern[order]
        return rows, begin - first[rows], last + 1 - first[rows], pattern


def automaton(words: list[str]) -> Automaton:
    """Of distinct patterns, none of them empty."""
    letters = {c: i for i, c in enumerate(sorted(set("".join(words))), 1)}
    classes = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
    for c, i in letters.items():
        classes[ord(c)] = i
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for k, word in enumerate(words):
        node = 0
        for c in word:
            at = children[node].get(letters[c])
            if at is None:
                at = children[node][letters[c]] = len(children)
                children.append({})
                ends.append(-1)
            node = at
        ends[node] = k
    step = np.zeros((len(children), len(letters) + 1), np.int32)
    also = np.zeros(len(children), np.int32)
    queue = deque([(0, 0)])
    while queue:  # by depth; a state's row is that of its longest proper suffix, but for its own children
        node, suffix = queue.popleft()
        if node:
            step[node] = step[suffix]
            also[node] = suffix if ends[suffix] >= 0 else also[suffix]
        for letter, child in children[node].items():
            queue.append((child, int(step[node, letter]) if node else 0))
            step[node, letter] = child
    return Automaton(classes, step, np.array(ends, np.int32), also, np.fromiter(map(len, words), np.int64, len(words)))


def small_automaton(terms: DataFrame) -> tuple[Automaton, list[list[tuple]]] | None:
    """The automaton and the (less, ord, value) of each pattern, if the dictionary is within the bounds."""
    size = terms.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)), F.count("*")).first()
    if size[0] > CHARACTERS or size[1] > CHARACTERS:
        return None
    named: dict[str, list[tuple]] = {}
    for r in terms.orderBy("less", "ord").collect():
        named.setdefault(r.pattern, []).append((r.less, r.ord, r.value))
    if (sum(map(len, named)) + 1) * (len(set("".join(named))) + 1) > CELLS:
        return None
    return automaton(list(named)), list(named.values())


def _pieces(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut where the texts of a column have PIECE bytes; a longer text stays whole."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, "right")))
            yield batch.slice(start, stop - start)
            start = stop


@lru_cache(1 << 16)
def _overlaps_itself(form: str) -> bool:
    return any(form.startswith(form[i:]) for i in range(1, len(form)))


def _apart(text: str, places: Iterable[tuple]) -> list[bool]:
    """Whether a search from left to right comes to a place (start, end, ...): it goes on from the end of each occurrence, also of one that does not stand alone."""
    low, met = folded(text), {}
    out = []
    for start, end, *_ in places:
        form = low[start:end]
        free = not _overlaps_itself(form) or low.find(form, max(0, start - len(form) + 1), end - 1) < 0
        if not free and form not in met:
            met[form] = {m.start() for m in re.finditer(re.escape(form), low)}
        out.append(free or start in met[form])
    return out


def occurrences(texts: DataFrame, glossary: DataFrame, apart: bool = False) -> DataFrame:
    """texts with `found`: the places of all terms of a glossary (key, value, ord), by start and rank.

    texts has a column `text` and a column `key` that tells its rows apart. Places of a form, which is a term or its plural, may
    overlap. With apart they do not: a text is searched for each form from left to right, as if it were split at it.
    """
    terms = patterns(glossary)
    small = small_automaton(terms)
    if small is None:
        return _searched(_joined(texts, terms)) if apart else _joined(texts, terms)
    machine, named = small
    at, columns = texts.columns.index("text"), texts.columns
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("less", pa.int32()), ("ord", pa.int32()), ("value", pa.string())]))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(it, at):
            asked = batch.column(at).to_pylist()
            found: list[list | None] = [None if t is None else [] for t in asked]
            for row, start, end, pattern in zip(*(x.tolist() for x in machine.places([t or "" for t in asked]))):
                found[row] += [(start, end, *term) for term in named[pattern]]
            for t, f in zip(asked, found):
                if f:
                    f.sort(key=lambda p: (p[0], p[2], p[3], -p[1]))
                    if apart:
                        f[:] = compress(f, _apart(t, f))
            rows = [None if f is None else [dict(zip(("start", "end", "less", "ord", "value"), p)) for p in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*columns, "found"])

    schema = StructType([*texts.schema.fields, StructField("found", texts.sparkSession.createDataFrame([], f"found {FOUND}").schema[0].dataType)])
    return texts.mapInArrow(run, schema)


def _joined(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """occurrences() by a join of the words of the texts with the first words of the patterns."""
    units = F.regexp_extract_all("low", F.lit("([a-z0-9]+|[^a-z0-9])"), 1)
    words = texts.select("key", fold_column(F.col("text")).alias("low")).withColumn("units", units)
    # The place of a unit is the length of those before it.
    placed = words.select("key", "low", F.posexplode("units").alias("nth", "unit"), "units").select(
        "key", "low", "unit", F.lead("unit").over(_in_text()).alias("next"), F.lag("unit").over(_in_text()).alias("last"), (F.sum(F.length("unit")).over(_in_text()) - F.length("unit")).cast("int").alias("start")
    )
    solid = lambda c: F.coalesce(c.rlike("^[a-z0-9]"), F.lit(False))
    begins = placed.where(solid(F.col("unit")) | ~solid(F.col("last"))).select("key", "low", "unit", "start")
    keyed = terms.withColumn("unit", F.regexp_extract("pattern", "^([a-z0-9]+|[^a-z0-9])", 1))
    end = F.col("start") + F.length("pattern")
    hits = begins.join(keyed, "unit").where(F.substr("low", F.col("start") + 1, F.length("pattern")) == F.col("pattern"))
    hits = hits.where(~F.substr("low", end + 1, F.lit(1)).rlike("^[a-z0-9]"))
    place = F.struct("start", "less", "ord", (-end).alias("before"), "value")
    found = hits.groupBy("key").agg(F.array_sort(F.collect_list(place)).alias("f"))
    found = found.select("key", F.transform("f", lambda p: F.struct(p["start"].alias("start"), (-p["before"]).cast("int").alias("end"), p["less"].alias("less"), p["ord"].alias("ord"), p["value"].alias("value"))).alias("found"))
    return texts.join(found, "key", "left").withColumn("found", F.when(F.col("text").isNotNull(), F.coalesce("found", F.array().cast(FOUND)))).select(*texts.columns, "found")


def _searched(texts: DataFrame) -> DataFrame:
    """texts whose `found` keeps the places apart."""
    text, found = texts.columns.index("text"), texts.columns.index("found")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(it, text):
            rows = batch.column(found).to_pylist()
            kept = [f and list(compress(f, _apart(t, [(p["start"], p["end"]) for p in f]))) for t, f in zip(batch.column(text).to_pylist(), rows)]
            yield batch.set_column(found, "found", pa.array(kept, batch.schema.field(found).type))

    return texts.mapInArrow(run, texts.schema)


def _in_text():
    from pyspark.sql.window import Window

    return Window.partitionBy("key").orderBy("nth")


def _composed(text: str | None, found) -> str | None:
    if text is None:
        return None
    best: dict[int, tuple[int, str]] = {}
    for p in found:  # the first of a place has the best rank, and of that rank the longer form
        best.setdefault(p["start"], (p["end"], p["value"]))
    at, stop, out = len(text) - len(text.lstrip()), len(text.rstrip()), ""
    while at < stop:
        if text[at].isspace():
            at += 1
            continue
        piece = None
        if mark := _HOLE.match(text, at) or _PUNCTUATION.match(text, at):
            piece, at = mark[0], mark.end()
        elif at in best and best[at][0] <= stop:
            at, piece = best[at]
        else:
            word = re.compile("[A-Za-z]+").match(text, at)
            if not word or word[0].lower() not in dims.DROPPED:
                return None
            at = word.end()
        if piece is not None:
            tight = not out or _PUNCTUATION.fullmatch(piece) or re.search(_CJK, out) or re.search(_CJK, piece)
            out += piece if tight else f" {piece}"
    return out


@F.pandas_udf(StringType())
def composed(text: pd.Series, found: pd.Series) -> pd.Series:
    """A translation made of the terms found alone; null if some part of the text has none. One place follows another."""
    return pd.Series([_composed(t, f) for t, f in zip(text, found)], dtype=object)


def enforced(translation: Column, found: Column) -> Column:
    """The translation, with known mistranslations of the terms found in its source put right, term by term."""
    terms = F.array_distinct(F.array_sort(F.transform(found, lambda p: F.struct(p["less"], p["ord"], p["value"].alias("value")))))
    bad = F.create_map(*[x for k, v in dims.MISTRANSLATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def put(text: Column, term: Column) -> Column:
        wrong = F.filter(F.coalesce(F.try_element_at(bad, term["value"]), F.array().cast("array<string>")), lambda b: F.contains(text, b))
        return F.when(F.contains(text, term["value"]) | (F.size(wrong) == 0), text).otherwise(F.replace(text, F.get(wrong, F.lit(0)), term["value"]))

    return F.when(found.isNull(), translation).otherwise(F.aggregate(terms, translation, put))


def _replaced(text: str, key: str, value: str) -> tuple[str, list[str]]:
    """The text with key replaced at all its places, overlapping ones too, from right to left; and what is between them."""
    places, at = [], text.find(key) if key else -1
    while at >= 0:
        places.append(at)
        at = text.find(key, at + 1)
    if not places:
        return text, [text]
    size, last, result, rest = len(key), len(text), text, []
    apart = all(q - p >= size for p, q in zip(places, places[1:]))
    for p in reversed(places):
        rest.append(text[min(p + size, last) : max(p + size, last)])
        last = p
        if not apart:
            result = result[:p] + value + result[p + size :]
    rest.append(text[:last])
    return text.replace(key, value) if apart else result, [x for x in reversed(rest) if x]


def replaced(texts: DataFrame) -> DataFrame:
    """texts with `result` and `rest`: its `terms` (key, value) put into `text` one after another, and the distinct parts of the text that none of them took.

    A null text or list of terms changes nothing and leaves nothing out; of an empty text there are no parts.
    """
    columns, text, terms = texts.columns, texts.columns.index("text"), texts.columns.index("terms")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(it, text):
            results, rests = [], []
            for t, pairs in zip(batch.column(text).to_pylist(), batch.column(terms).to_pylist()):
                result, rest = t, None if t is None else [t] if t else []
                for p in pairs or [] if t is not None else []:
                    result = _replaced(result, p["key"], p["value"])[0]
                    rest = list(dict.fromkeys(x for part in rest for x in _replaced(part, p["key"], p["value"])[1]))
                results.append(result)
                rests.append(rest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, pa.string()), pa.array(rests, pa.list_(pa.string()))], [*columns, "result", "rest"])

    kinds = [StructField("result", StringType()), StructField("rest", ArrayType(StringType()))]
    return texts.mapInArrow(run, StructType([*texts.schema.fields, *kinds]))
