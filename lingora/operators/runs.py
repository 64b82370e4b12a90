"""Characters and runs of languages, scores of romance texts, nomenclature, packing into requests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lingora.operators.folds import in_order, running_sum
from lingora.session import durable
from lingora.sources import dims

# Letters that mark romance languages, and the letters and pairs that tell them apart.
ROMANCE = "éèêàçœñáóòìãõ"
ROMANCE_LETTERS = {"french": "éèêàçœ", "spanish": "ñáó", "italian": "òì", "portuguese": "ãõ"}
ROMANCE_PAIRS = {"spanish": ["ll"], "italian": ["cc", "ss"]}
# Classes of single characters, in the order of the tests.
CLASSES = [
    ("russian", "[\\u0410-\\u044F\\u0401\\u0451]"), ("english", "[A-Za-z]"), ("romance", f"[{ROMANCE}]"),
    ("specialCharacter", r"[\s!-/:-@\[-`{-~\u00A0-\u00BF\u2000-\u206F\u3000-\u303F\uFF00-\uFF0F\uFF1A-\uFF20]"), ("number", "[0-9]"),
    ("chinese", "[\\u4E00-\\u9FA5]"), ("japanese", "[\\u3040-\\u30FF]"), ("korean", "[\\uAC00-\\uD7AF]"), ("greek", "[\\u0391-\\u03A9\\u03B1-\\u03C9]"),
    ("thai", "[\\u0E01-\\u0E59]"), ("arabic", "[\\u0600-\\u06FF\\u0750-\\u077F]"), ("romanian", "[\\u00C0-\\u017F\\u0218-\\u021B]"), ("hebrew", "[\\u0590-\\u05FF]"),
]
CONNECTOR = ["specialCharacter", "number"]


TRADITIONAL = "".join(c for c in dict.fromkeys(dims.TRADITIONAL) if c not in dims.SIMPLIFIED)


def char_class(ch: Column, traditional: str = TRADITIONAL) -> Column:
    """The class of one character; '' for none. traditional: the characters that count as traditional Chinese."""
    out = None
    for name, pattern in CLASSES:
        value = F.when(F.contains(F.lit(traditional), ch), "chinese_traditional").otherwise("chinese_simplified") if name == "chinese" else F.lit(name)
        out = F.when(ch.rlike(f"^{pattern}"), value) if out is None else out.when(ch.rlike(f"^{pattern}"), value)
    return out.otherwise("")


class _Tags(dict):
    """One ASCII letter for the class of each character, by code point; what is met is remembered. Connectors are `!`."""

    NAMES = ["", *[n for n, _ in CLASSES if n not in [*CONNECTOR, "chinese"]], "chinese_traditional", "chinese_simplified"]
    TESTS = [(n, re.compile(p, re.A)) for n, p in CLASSES]

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        name = next((n for n, p in self.TESTS if p.match(ch)), "")
        if name == "chinese":
            name = "chinese_traditional" if ch in TRADITIONAL else "chinese_simplified"
        self[code] = out = "!" if name in CONNECTOR else chr(65 + self.NAMES.index(name))
        return out


def _folded(text: str, tags: _Tags) -> list[tuple[str, str]]:
    """(lang, text) of the runs of one text: a run begins where the class differs from that of the last that is no connector."""
    t = np.frombuffer(text.translate(tags).encode("ascii"), np.uint8)
    named = np.flatnonzero(t != ord("!"))
    if not len(named):
        return [("", text)] if text else []
    own = t[named]
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    at = [0, *named[new[1:]].tolist(), len(text)]
    return [(tags.NAMES[k - 65], text[i:j]) for k, i, j in zip(own[new].tolist(), at, at[1:])]


def language_runs(texts: DataFrame, key: str = "id", text: str = "text", whole: str | None = None) -> DataFrame:
    """(key, run_idx, lang, text): neighbours of one language; connectors (space, digits, marks) join the run before.

    Each text is folded on its own in Arrow batches; null and empty texts have no runs. whole: a column that names the
    language of elements which are translated as one run, whatever is in them; null for the others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tags = _Tags()
        for frame in frames:
            for i in range(0, len(frame), 500):
                part = frame.iloc[i : i + 500]
                forced = part["__whole"] if whole else [None] * len(part)
                found = [(k, [(f, t)] if f is not None and t else _folded(t, tags)) for k, t, f in zip(part[key], part[text], forced) if t is not None]
                rows = [(k, n, lang, t) for k, pairs in found for n, (lang, t) in enumerate(pairs, 1)]
                yield pd.DataFrame(rows, columns=[key, "run_idx", "lang", "text"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text, *([F.col(whole).alias("__whole")] if whole else [])).mapInPandas(run, f"`{key}` {kind}, run_idx long, lang string, text string")


def romance_scores(text: Column) -> dict[str, Column]:
    """Scores by language: one a letter, two a pair; pairs may overlap, so runs are counted by look-ahead."""
    low = F.lower(text)
    out = {}
    for lang, letters in ROMANCE_LETTERS.items():
        score = F.regexp_count(low, F.lit(f"[{letters}]"))
        for pair in ROMANCE_PAIRS.get(lang, []):
            score = score + 2 * F.regexp_count(low, F.lit(f"{pair[0]}(?={pair[1]})"))
        out[lang] = score
    return out


def romance(text: Column) -> Column:
    """The language with the greatest score; of equals the first."""
    scores = romance_scores(text)
    best = F.greatest(*scores.values())
    out = None
    for lang, score in scores.items():
        out = F.when(score == best, lang) if out is None else out.when(score == best, lang)
    return out


def nomenclature(text: Column) -> Column:
    """Terms of lines `key=value` with exactly one `=`, the longest key first; a later line overrides."""
    pairs = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.split(x, "=", -1)), lambda p: (F.size(p) == 2) & (F.trim(p[0]) != ""))
    rows = F.transform(pairs, lambda p, i: F.struct((-F.length(F.trim(p[0]))).alias("less"), i.alias("ord"), F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value")))
    last = F.filter(rows, lambda r: ~F.exists(rows, lambda o: (o["key"] == r["key"]) & (o["ord"] > r["ord"])))
    return F.transform(F.array_sort(last), lambda r: F.struct(r["key"].alias("key"), r["value"].alias("value")))


def url_parts(text: Column) -> Column:
    """struct(kind, value): addresses and what is between them."""
    pattern = r"https?://[^\s<>\"']+"
    urls = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern, -1)
    woven = F.flatten(F.transform(between, lambda t, i: F.array(F.struct(F.lit("text").alias("kind"), t.alias("value")), F.struct(F.lit("url").alias("kind"), F.get(urls, i).alias("value")))))
    return F.filter(woven, lambda p: p["value"].isNotNull() & (p["value"] != ""))


#: Texts of one key that a single task packs one after another.
FOLD = 200_000


def json_length(text: Column) -> Column:
    """Characters of a text as a JSON string; a null text is an empty one."""
    return F.length(F.to_json(F.array(F.coalesce(text, F.lit(""))))) - 2


def packed_requests(items: DataFrame, partition: list[str], order: list[str], chars: int = 40_000, most: int = 900) -> DataFrame:
    """Request numbers for texts in order: the JSON list of a request has at most `chars` characters and `most` texts.

    A text beyond the limit is a request of its own. order tells the rows of a key apart. The texts of a usual key are
    packed one after another in a task; those of a key with more than FOLD by jumps, see jumped().
    """
    key = F.to_json(F.struct(*partition)).alias("__k")
    rows = items.select(*partition, *order, key, (json_length(F.col("text")) + 1).alias("__n"))
    counts = rows.groupBy("__k").agg(F.count("*").alias("__count")).where(F.col("__count") > FOLD).select("__k")
    small, large = rows.join(counts, "__k", "left_anti"), rows.join(counts, "__k", "left_semi")

    def step(state, n):
        request, used, count = state or (0, 0, 0)
        if count and (used + n > chars - 1 or count >= most):
            request, used, count = request + 1, 0, 0
        return (request, used + n, count + 1), request

    out = in_order(small, partition, order, [F.col("__n")], "request", IntegerType(), step).drop("__n", "__k")
    return out.unionByName(jumped(large, partition, order, chars, most)) if counts.limit(1).count() else out


def jumped(rows: DataFrame, partition: list[str], order: list[str], chars: int, most: int) -> DataFrame:
    """packed_requests() of (partition, order, __k, __n) with each key __k spread over all tasks.

    Prefix sums tell where a request that begins at a row would end: with the last row whose sum is within the
    limit, found by one sort of sums and limits. Rows that do begin one are marked by doubling: from the first row one
    jump, then two, four and so on, so that there are as many rounds as the logarithm of the number of requests.
    """
    key = ["__k"]
    placed = running_sum(rows, key, order, F.lit(1), "__at")
    placed = durable(running_sum(placed, key, order, F.col("__n"), "__sum"))
    asked = placed.select("__k", "__at", (F.col("__sum") - F.col("__n") + chars - 1).alias("__v"), F.lit(1).alias("__ask"))
    given = placed.select("__k", "__at", F.col("__sum").alias("__v"), F.lit(0).alias("__ask"))
    within = running_sum(asked.unionByName(given), key, ["__v", "__ask", "__at"], 1 - F.col("__ask"), "__fit").where("__ask = 1")
    after = F.greatest(F.col("__at") + 1, F.least(F.col("__at") + most, F.col("__fit") + 1))
    inside = placed.select("__k", F.col("__at").alias("__to"))
    jump = durable(within.select("__k", "__at", after.alias("__to")).join(inside, ["__k", "__to"], "left_semi"))
    begin, found, now = durable(placed.where("__at = 1").select("__k", "__at")), -1, 0
    while now > found:
        then = jump.select("__k", F.col("__at").alias("__to"), F.col("__to").alias("__next"))
        further = begin.join(jump, ["__k", "__at"]).select("__k", F.col("__to").alias("__at"))
        begin = durable(begin.unionByName(further).distinct())
        jump = durable(jump.join(then, ["__k", "__to"]).select("__k", "__at", F.col("__next").alias("__to")))
        found, now = now, begin.count()
    marked = placed.select("__k", *partition, *order, "__at", F.lit(0).alias("__mark")).unionByName(begin.withColumn("__mark", F.lit(1)), allowMissingColumns=True)
    marks = durable(marked.groupBy("__k", "__at").agg(*[F.max(c).alias(c) for c in (*partition, *order, "__mark")]))
    numbered = running_sum(marks, key, ["__at"], F.col("__mark"), "__request")
    return numbered.select(*partition, *order, (F.col("__request") - 1).cast("int").alias("request"))
