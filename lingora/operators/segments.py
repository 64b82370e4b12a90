"""Segments of sources: lines, quoted strings, HTML text and attributes, JSON values, with ids and places."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lingora.functions.lang import BLANKS, has_locale_text, locale_length, trim
from lingora.functions.text import segment_id
from lingora.sources import dims

# Patterns of the source formats.
HTML_TEXT = r"""<[^'">]*(?:'[^']*'[^'">]*|"[^"]*"[^'">]*)*>([^<]*)"""
HTML_ATTR = r"""\s([\w-]+)=["']([^"']*)["']"""
HTML_ATTRS = ["title", "alt", "placeholder", "aria-label", "label", "tab"]
JSON_STRING = r'"((?:[^"\\]|\\.)*)"(\s{0,11}:)?'
QUOTED = r"""(["'`])((?:\\.|[^\\])*?)\1"""
CSS_CONTENT = r"""content:\s*(["'])((?:\\.|[^\\])*?)\1"""
SKIPPED_ATTR = r"^(?:class|style|id|key|ref|data-.*|aria-.*)\z"
INTERPOLATION = r"\{\{[\s\S]*?\}\}|\$\{[\s\S]*?\}|__TM_[0-9]+__"
FENCE = r"```[\s\S]*?```"


def lines(docs: DataFrame, path: Column, text: str = "text") -> DataFrame:
    """(path, seg_idx, id, text, start, end, line, column) of non-blank lines; places in code points, from 0 and from 1.

    Offsets come from the lengths of the lines before, inside one row: no window over the exploded lines. Each line is
    trimmed once, before it becomes a row.
    """
    parts = F.split(F.col(text), "\n", -1)
    begins = running_sums(F.transform(parts, lambda x: F.length(x) + 1))
    placed = F.zip_with(parts, begins, lambda x, b: F.struct(F.ltrim(x, F.lit(BLANKS)).alias("rest"), F.length(x).alias("size"), b.alias("begin")))
    bodies = F.transform(placed, lambda p, i: F.struct(i.alias("at"), F.rtrim(p["rest"], F.lit(BLANKS)).alias("text"), (p["size"] - F.length(p["rest"])).alias("lead"), p["begin"].alias("begin")))
    rows = docs.select(path.alias("path"), F.explode(F.filter(bodies, lambda x: x["text"] != "")).alias("l")).select("path", "l.*")
    start = F.col("begin") + F.col("lead")
    return rows.select(
        "path", F.col("at").alias("seg_idx"), segment_id(F.col("text"), F.col("path")).alias("id"), "text", start.alias("start"),
        (start + F.length("text")).alias("end"), (F.col("at") + 1).alias("line"), (F.col("lead") + 1).alias("column"),
    )


def running_sums(sizes: Column, block: int = 256) -> Column:
    """For each number of an array, the sum of those before it.

    Sums are built for blocks first and then inside of these, so that what appending to arrays costs stays in proportion.
    """
    append = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0), lambda acc, n: acc + n))
    starts = F.aggregate(totals, F.array(F.lit(0)), append)
    inside = F.transform(blocks, lambda part, b: F.slice(F.aggregate(part, F.array(F.get(starts, b)), append), F.lit(1), F.size(part)))
    return F.when(F.size(sizes) > 0, F.flatten(inside)).otherwise(F.array().cast("array<int>"))


def masked_markdown(text: Column) -> Column:
    """Markdown without the text of code fences: each fence leaves its line breaks."""
    pieces = F.split(text, FENCE, -1)
    fences = F.regexp_extract_all(text, F.lit(f"({FENCE})"), 1)
    blanked = F.transform(fences, lambda f: F.regexp_replace(f, r"[^\n]", " "))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(blanked, i), F.lit("")))), "")


def html_texts(html: Column) -> Column:
    """Trimmed texts between tags, those that are not blank; scripts and styles are not left out."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(HTML_TEXT), 1), trim), lambda t: t != "")


def html_attrs(html: Column) -> Column:
    """struct(name, value) of the attributes that hold text for a reader."""
    names, values = F.regexp_extract_all(html, F.lit(HTML_ATTR), 1), F.regexp_extract_all(html, F.lit(HTML_ATTR), 2)
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return F.filter(pairs, lambda p: p["name"].isin(HTML_ATTRS) & (trim(p["value"]) != ""))


def json_values(text: Column) -> Column:
    """Strings of a JSON text that are not keys; none if it does not parse."""
    found = F.zip_with(F.regexp_extract_all(text, F.lit(JSON_STRING), 1), F.regexp_extract_all(text, F.lit(JSON_STRING), 2), lambda s, colon: F.struct(s.alias("s"), colon.alias("colon")))
    values = F.transform(F.filter(found, lambda x: x["colon"] == ""), lambda x: x["s"])
    return F.when(F.try_parse_json(text).isNotNull(), values)


def quoted(text: Column) -> Column:
    """Contents of quoted strings that are not blank, unescaped."""
    found = F.regexp_extract_all(text, F.lit(QUOTED), 2)
    plain = lambda s: F.replace(F.replace(F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')), F.lit("\\`"), F.lit("`"))
    return F.filter(F.transform(found, plain), lambda s: trim(s) != "")


def css_contents(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CSS_CONTENT), 2)


def yaml_values(text: Column) -> Column:
    """Values after the first colon of each line, without a pair of quotes around them."""
    values = F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.contains(x, F.lit(":"))), lambda x: trim(F.regexp_replace(x, r"^[^:]*:", "")))
    bare = F.transform(values, lambda v: F.regexp_replace(v, r"""^(["'])([\s\S]*)\1\z""", "$2"))
    return F.filter(bare, lambda v: trim(v) != "")


PLACE = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), *(StructField(c, StringType()) for c in ("text", "context", "quote"))]))


def places_in(content: str, kind: str) -> list[tuple[int, int, str, str, str]]:
    """Where the texts of a source that is not a script stand: (start, end, text, context, quote)."""
    out = []

    def add(start: int, text: str, context: str, quote: str = "") -> None:
        body = text.strip(BLANKS)
        if body:
            lead = len(text) - len(text.lstrip(BLANKS)) if context != "json-value" else 0
            body = body if context != "json-value" else text
            out.append((start + lead, start + lead + len(body), body, context, quote))

    if kind == "json":
        try:
            json.loads(content)
        except ValueError:
            return []
        for m in re.finditer(JSON_STRING, content):
            if not m[2]:
                add(m.start(1), m[1], "json-value", '"')
    elif kind == "html":
        for m in re.finditer(HTML_TEXT, content):
            add(m.start(1), m[1], "html-text")
        for m in re.finditer(HTML_ATTR, content):
            if m[1] in HTML_ATTRS:
                add(m.start(2), m[2], "html-attr", content[m.start(2) - 1])
    elif kind in ("css", "scss", "less"):
        for m in re.finditer(CSS_CONTENT, content):
            add(m.start(2), m[2], "style", m[1])
    elif kind in ("yaml", "yml"):
        for m in re.finditer(r"(?m)^[^:\n]*:([^\n]*)$", content):
            value = m[1].strip(BLANKS)
            at = m.start(1) + m[1].find(value)
            quoted_ = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            add(at + quoted_, value[1:-1] if quoted_ else value, "yaml-value", value[0] if quoted_ else "")
    elif kind == "md":
        plain = re.sub(FENCE, lambda m: re.sub(r"[^\n]", " ", m[0]), content)
        for m in re.finditer(r"[^\n]+", plain):
            add(m.start(), m[0], "markdown")
    return out


@F.pandas_udf(PLACE)
def places(content: pd.Series, kind: pd.Series) -> pd.Series:
    names = ("start", "end", "text", "context", "quote")
    return pd.Series([[dict(zip(names, x)) for x in places_in(c, k)] if c is not None and k is not None else [] for c, k in zip(content, kind)])


def first_spans(segments: DataFrame) -> DataFrame:
    """One segment for each place of a path: the one with the least seg_idx."""
    best = segments.groupBy("path", "start", "end").agg(F.min_by(F.struct(*[c for c in segments.columns if c not in ("path", "start", "end")]), "seg_idx").alias("s"))
    return best.select("path", "start", "end", "s.*")


def should_translate(text: Column, context: Column, locale: Column, rules: list[tuple] = dims.RULES) -> Column:
    """Whether a text goes to a translator; one expression for all rules."""
    shown = F.regexp_replace(text, INTERPOLATION, " ")
    length = locale_length(shown, locale)
    trimmed = trim(shown)
    single = (F.length(trimmed) == 1) & (locale_length(trimmed, locale) == 1) & has_locale_text(trimmed, locale)
    forced, skipped = F.lit(False), F.lit(False)
    for kind, value in rules:
        pattern = value.replace("$", r"\z") if isinstance(value, str) else value
        if kind == "force-pattern":
            forced = forced | shown.rlike(pattern)
        elif kind == "skip-context":
            skipped = skipped | (context == value)
        elif kind == "skip-pattern":
            applies = ~F.lower(locale).startswith("en") if value == "^[a-zA-Z]" else F.lit(True)
            skipped = skipped | (applies & shown.rlike(pattern))
        elif kind == "min-length":
            skipped = skipped | ((length < value) & ~single)
        elif kind == "max-length":
            skipped = skipped | (length > value)
    return has_locale_text(shown, locale) & (forced | ~skipped)


def spliced(content: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits (start, end, value) in order, made from the last to the first; one that reaches into a later one's value
    takes of it what its places say."""
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:])):
        for start, end, value in reversed(edits):
            content = content[:start] + value + content[end:]
        return content
    out, at = [], 0
    for start, end, value in edits:
        out += content[at:start], value
        at = end
    return "".join([*out, content[at:]])


@F.pandas_udf(StringType())
def _splice(content: pd.Series, edits: pd.Series) -> pd.Series:
    def one(text, todo):
        if text is None or todo is None:
            return None
        return spliced(text, [(e["start"], e["end"], e["value"]) for e in sorted(todo, key=lambda e: (e["start"], e["ord"], e["end"], e["value"]))])

    return pd.Series([one(t, e) for t, e in zip(content, edits)])


def splice(content: Column, edits: Column) -> Column:
    """Content with edits (start, end, ord, value) made from the last to the first, so that earlier places stay true."""
    plain = F.transform(edits, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["ord"].cast("int").alias("ord"), e["value"].alias("value")))
    return _splice(content, plain)


def line_diff(before: Column, after: Column) -> Column:
    """Lines that differ place by place: '-' old, '+' new."""
    old, new = F.split(before, "\n", -1), F.split(after, "\n", -1)
    pairs = F.filter(F.zip_with(old, new, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: ~p["a"].eqNullSafe(p["b"]))
    shown = F.transform(pairs, lambda p: F.array_compact(F.array(F.concat(F.lit("-"), p["a"]), F.concat(F.lit("+"), p["b"]))))
    return F.flatten(shown)
