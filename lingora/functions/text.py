"""Placeholders, keys, escapes, ids, diffs: scalar operations on texts, as Column expressions where they can be."""

from __future__ import annotations

import re
import unicodedata
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lingora.functions.lang import lookup
from lingora.sources import dims

PLACEHOLDER = r"\{\{[\s\S]*?\}\}|\$\{[\s\S]*?\}"
TOKEN = "__TM_"


def segment_id(text: Column, path: Column) -> Column:
    return F.substr(F.sha2(F.concat(text, F.lit(":"), path), 256), F.lit(1), F.lit(8))


def key_hash(text: Column) -> Column:
    return F.substr(F.sha1(text), F.lit(1), F.lit(8))


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), 1)


def protect(text: Column) -> Column:
    """Text with its placeholders as numbered tokens, left to right: pieces between them, woven with the tokens."""
    pieces = F.split(text, PLACEHOLDER, -1)
    numbered = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(TOKEN), (i - 1).cast("string"), F.lit("__"), p)))
    return F.array_join(numbered, "")


def restore_exact(text: Column, values: Column) -> Column:
    """Tokens back to placeholders, higher numbers first."""
    steps = F.reverse(F.transform(values, lambda v, i: F.struct(F.concat(F.lit(TOKEN), i.cast("string"), F.lit("__")).alias("t"), v.alias("v"))))
    return F.aggregate(steps, text, lambda acc, s: F.replace(acc, s["t"], s["v"]))


@F.pandas_udf(StringType())
def restore(text: pd.Series, values: pd.Series) -> pd.Series:
    """Tokens back to placeholders, also where a translator has altered a token's case, spaces or underscores."""

    def one(t, vs):
        if t is None:
            return None
        vs = [] if vs is None else list(vs)
        for i, v in enumerate(vs):
            t = t.replace(f"{TOKEN}{i}__", v)
        for i, v in enumerate(vs):
            t = re.sub(rf"(?:__+)?T[\W_]*M[\W_]*{i}(?:__+)?", lambda m, v=v: v, t, flags=re.I | re.A)
        return t

    return pd.Series([one(t, v) for t, v in zip(text, values)])


def _plain(text: Column) -> Column:
    """Words of a key before case is dealt with; for text whose accents are already taken off."""
    humps = F.regexp_replace(text, r"([a-z\d])([A-Z])", "$1 $2")
    return F.filter(F.split(F.trim(F.regexp_replace(humps, r"[^A-Za-z0-9_$]+", " ")), r"\s+"), lambda w: w != "")


@F.pandas_udf(StringType())
def _unaccented(text: pd.Series) -> pd.Series:
    def one(t):
        return None if t is None else re.sub("[\u0300-\u036F]", "", unicodedata.normalize("NFKD", t))

    return text.map(one)


def unaccented(text: Column, ascii_only: bool = False) -> Column:
    """Compatibility decomposition without combining marks; the identity on ASCII, so that texts of it stay in the JVM."""
    return text if ascii_only else F.coalesce(_unaccented(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def camel(words: Column) -> Column:
    clean = F.filter(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[_$]+|[_$]+\z", ""))), lambda w: w != "")
    return F.array_join(F.transform(clean, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))), "")


def normalize_key(value: Column, ascii_only: bool = False) -> Column:
    return F.nullif(camel(_plain(unaccented(value, ascii_only))), F.lit(""))


def semantic_candidate(text: Column, ascii_only: bool = False) -> Column:
    words = F.filter(_plain(unaccented(protect(text), ascii_only)), lambda w: ~F.lower(w).isin(dims.KEY_STOPS) & ~w.rlike(r"(?i)^_*tm_*\d+_*\z"))
    return F.nullif(camel(words), F.lit(""))


def chinese_candidate(text: Column) -> Column:
    compact = F.regexp_replace(F.regexp_replace(text, PLACEHOLDER, ""), r"[^\u4E00-\u9FFF]", "")
    terms = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in dims.KEY_TERMS.items()])
    found = F.transform(F.filter(terms, lambda t: F.contains(compact, t["k"])), lambda t: t["v"])
    return F.when(compact != "", F.coalesce(lookup(dims.KEY_TEXTS, compact), F.nullif(camel(found), F.lit(""))))


def _candidates(text: Column, translation: Column, glossary_value: Column, ascii_only: bool) -> list[Column]:
    raw = [semantic_candidate(glossary_value, ascii_only), chinese_candidate(text), semantic_candidate(translation, ascii_only), semantic_candidate(text, ascii_only)]
    return [F.nullif(camel(_plain(k)), F.lit("")) for k in raw]


def key_candidates(text: Column, translation: Column, glossary_value: Column, ascii_only: bool = False) -> Column:
    """Distinct keys in order of preference."""
    return F.array_distinct(F.array_compact(F.array(*_candidates(text, translation, glossary_value, ascii_only))))


def first_candidate(text: Column, translation: Column, glossary_value: Column, ascii_only: bool = False) -> Column:
    """The first of key_candidates(), if any; those after it are not worked out."""
    return F.coalesce(*_candidates(text, translation, glossary_value, ascii_only))


_PARAM = r"[a-z_$][\w$]*(?:\.[a-z_$][\w$]*|\[[^\]]+\])*"


def param_name(expression: str) -> str:
    words = unicodedata.normalize("NFKD", re.sub(r"\[['\"]?([^'\"\]]+)['\"]?\]", r" \1 ", expression.strip()))
    words = re.sub("[\u0300-\u036F]", "", words)
    words = re.sub(r"([a-z\d])([A-Z])", r"\1 \2", words)
    words = [w.strip("_$").lower() for w in re.sub(r"[^A-Za-z0-9_$]+", " ", words).split()]
    words = [w for w in words if w]
    return words[0] + "".join(w[0].upper() + w[1:] for w in words[1:]) if words else "value"


@F.pandas_udf(StringType())
def named_params(text: pd.Series) -> pd.Series:
    """Interpolations of member chains as named parameters."""
    both = re.compile(rf"\{{\{{\s*({_PARAM})\s*\}}\}}|\$\{{\s*({_PARAM})\s*\}}", re.I | re.A)
    return text.map(lambda t: None if t is None else both.sub(lambda m: "{" + param_name(m[1] or m[2]) + "}", t))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_script(text: Column, quote: Column) -> Column:
    base = _replaced(text, ("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"), ("\b", "\\b"))
    template = _replaced(base, ("`", "\\`"), ("${", "\\${"))
    plain = F.replace(_replaced(base, ("\t", "\\t"), ("\f", "\\f")), quote, F.concat(F.lit("\\"), quote))
    return F.when(quote == "`", template).otherwise(plain)


def escape_json(text: Column) -> Column:
    """The inside of a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substr(whole, F.lit(7), F.length(whole) - 8)


def escape_css(text: Column, quote: Column) -> Column:
    text = F.regexp_replace(_replaced(text, ("\\", "\\\\")), r"\r\n|\r|\n", r"\\A ")
    return F.replace(text, quote, F.concat(F.lit("\\"), quote))


def escape_html(text: Column) -> Column:
    return _replaced(text, ("&", "&amp;"), ("<", "&lt;"))


def escape_html_attr(text: Column, quote: Column) -> Column:
    text = _replaced(escape_html(text), (">", "&gt;"))
    return F.when(quote == "'", _replaced(text, ("'", "&#39;"))).otherwise(_replaced(text, ('"', "&quot;")))


def escape_yaml(text: Column, quote: Column) -> Column:
    return F.when(quote == "'", _replaced(text, ("'", "''"), ("\r", "\\r"), ("\n", "\\n"))).otherwise(escape_json(text))


def escape(text: Column, context: Column, quote: Column) -> Column:
    """A translation as it may stand in a source of the given context, between the given quotes ('' for none)."""
    none = quote == ""
    json_whole = F.concat(F.lit('"'), escape_json(text), F.lit('"'))
    return (
        F.when(context == "script", F.when(none, text).otherwise(escape_script(text, quote)))
        .when(context == "json-value", F.when(quote == '"', escape_json(text)).otherwise(json_whole))
        .when(context == "style", F.when(none, text).otherwise(escape_css(text, quote)))
        .when(context == "html-attr", escape_html_attr(text, quote))
        .when(context.isin("html-text", "template"), escape_html(text))
        .when(context == "yaml-value", F.when(none, json_whole).otherwise(escape_yaml(text, quote)))
        .otherwise(text)
    )


def java_hash(text: Column) -> Column:
    """31-polynomial over UTF-16 units in 32 bits, as text: of a character beyond the basic plane, both surrogates."""
    hexed = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 4).cast("int")), lambda i: F.conv(F.substr(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    wrapped = F.aggregate(F.filter(units, lambda c: c.isNotNull()), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32)))
    return F.when(wrapped >= 2**31, wrapped - 2**32).otherwise(wrapped).cast("string")


def without_digits(text: Column) -> Column:
    """Texts that differ in digits only are equal in this."""
    return F.regexp_replace(text, "[0-9]", "")


def _module(path: Column) -> Column:
    """A source's path without a leading src and without the extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^(?:src|source)/", ""), r"\.[^./]+\z", "")


def namespace_key(path: Column, key: Column, separator: str = ".", namespace: str = "", local: bool = False) -> Column:
    """A key with the namespace and its file's path before it; local: the key alone."""
    if local:
        return key
    parts = [p.strip() for p in namespace.replace("\\", "/").split("/") if p.strip()]
    below = F.filter(F.split(_module(path), "/"), lambda p: p != "")
    return F.concat_ws(separator, *[F.lit(p) for p in parts], F.array_join(below, separator), key)


def locale_output_path(path: Column, locale: Column, out_dir: str = "locales", kind: str = "json", namespace: str = "") -> Column:
    parts = [F.lit(p) for p in namespace.replace("\\", "/").split("/") if p]
    return F.concat_ws("/", F.lit(out_dir), locale, *parts, F.concat(_module(path), F.lit(f".{kind}")))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, a row of the table at a time; for short texts."""
    left, right = (F.filter(F.split(x, ""), lambda c: c != "") for x in (a, b))
    start = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))

    def step(row, ch):
        first = F.array(F.lit(0))

        def cell(done, j):
            up, diagonal, here = F.get(row, j), F.get(row, j - 1), F.get(done, j - 1)
            return F.concat(done, F.array(F.when(F.get(right, j - 1) == ch, diagonal + 1).otherwise(F.greatest(up, here))))

        return F.when(F.size(right) == 0, row).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(right), F.lit(1))), first, cell))

    return F.element_at(F.aggregate(left, start, step), -1)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one integer: each 0 is a step up."""
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return head + tail + len(b) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    return 2 * lcs(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b)], dtype="float64")
