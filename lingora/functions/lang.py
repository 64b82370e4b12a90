"""Languages: codes, Chinese variants, detection by script, text of a locale. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingora.sources import dims

#: What counts as blank at the ends of a text.
BLANK = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same characters, for functions that take a set instead of a pattern.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK_ALL = r"[\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normalize(lang: Column) -> Column:
    """Code of an English language name; any other value stays as it is."""
    return F.coalesce(lookup(dims.ALIASES, F.lower(lang)), lang)


def to_flores(lang: Column) -> Column:
    return F.coalesce(lookup(dims.FLORES, lang), lookup(dims.FLORES, F.lower(lang)))


def from_flores(code: Column) -> Column:
    reverse: dict[str, str] = {}
    for k, v in dims.FLORES.items():
        reverse.setdefault(v, k)
    return lookup(reverse, code)


def zh_variant(text: Column) -> Column:
    """zh-CN unless the text has more traditional than simplified characters."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, "".join(dict.fromkeys(chars)), ""))
    simplified, traditional = count(dims.SIMPLIFIED), count(dims.TRADITIONAL)
    return F.when(simplified >= traditional, "zh-CN").otherwise("zh-TW")


def _class(low: int, high: int) -> str:
    return f"[\\x{{{low:X}}}-\\x{{{high:X}}}]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def detect(text: Column) -> Column:
    """struct(lang, confidence): the script with the most characters; of equals, the one that appears first.

    Latin letters are counted on the text, all other scripts on what is left of it without ASCII, which for most text
    is little or nothing.
    """
    last = F.lit(2**31 - 1)
    out = lambda lang, confidence: F.struct(lang.alias("lang"), confidence.cast("double").alias("confidence"))

    def counted(x):
        beyond = x["beyond"]
        n = lambda low, high: F.length(beyond) - F.length(F.regexp_replace(beyond, _class(low, high) + "+", ""))
        fields = [n(low, high).alias(f"n_{lang}") for lang, low, high in dims.RANGES]
        variant = F.when(zh_variant(beyond) == "zh-CN", "zh").otherwise("zh-TW")
        return F.struct(x["text"].alias("text"), x["letters"].alias("letters"), (x["letters"] + F.length(beyond)).alias("total"), n(0x4E00, 0x9FFF).alias("cjk"), variant.alias("variant"), *fields)

    def entry(lang, count, at):
        return F.struct((-count).alias("less"), at.cast("int").alias("at"), F.lit(lang).alias("lang"))

    def ranked(x):
        first = lambda count, pattern: F.when(count > 0, F.regexp_instr(x["text"], F.lit(pattern))).otherwise(last)
        han = (x["cjk"] > 0) & (x["n_ja"] == 0)
        entries = [entry("en", x["letters"], first(x["letters"], "[A-Za-z]"))]
        for lang, low, high in dims.RANGES:
            own = x[f"n_{lang}"]
            more = {"ja": F.when(own > 0, x["cjk"]).otherwise(0), "zh": F.when(han & (x["variant"] == "zh"), x["cjk"]).otherwise(0)}.get(lang, F.lit(0))
            entries.append(entry(lang, own + more, first(own, _class(low, high))))
        entries.append(entry("zh-TW", F.when(han & (x["variant"] == "zh-TW"), x["cjk"]).otherwise(0), last))
        return F.struct(x["total"].alias("total"), F.try_element_at(F.array_sort(F.filter(F.array(*entries), lambda e: e["less"] < 0)), F.lit(1)).alias("best"))

    def chosen(x):
        return F.when(x["best"].isNull(), out(F.lit("en"), F.lit(0.5))).otherwise(out(x["best"]["lang"], F.least(-x["best"]["less"] / x["total"], F.lit(1.0))))

    def decided(x):
        ascii_only = F.when(x["letters"] > 0, out(F.lit("en"), F.lit(1.0))).when(F.length(trim(x["text"])) == 0, out(F.lit("en"), F.lit(0.0))).otherwise(out(F.lit("en"), F.lit(0.5)))
        blank = F.length(trim(x["beyond"])) == 0
        empty = blank & (F.length(trim(x["text"])) == 0)
        return F.when(x["beyond"] == "", ascii_only).when(empty, out(F.lit("en"), F.lit(0.0))).otherwise(let(let(let(x, counted), ranked), chosen))

    whole = F.coalesce(text, F.lit(""))
    parts = let(whole, lambda t: F.struct(t.alias("text"), F.length(F.regexp_replace(t, "[^A-Za-z]", "")).alias("letters"), F.regexp_replace(t, r"[\x00-\x7F]+", "").alias("beyond")))
    return let(parts, decided)


def _locale_class(locale: Column, zh, en, other) -> Column:
    low = F.lower(locale)
    return F.when(low.startswith("zh"), zh).when(low.startswith("en"), en).otherwise(other)


def has_locale_text(text: Column, locale: Column) -> Column:
    return _locale_class(locale, text.rlike(CJK_ALL), text.rlike("[A-Za-z]"), text.rlike(r"\p{L}"))


def locale_length(text: Column, locale: Column) -> Column:
    """Number of characters of the locale's script."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    return _locale_class(locale, n(CJK_ALL), n("[A-Za-z]"), n(r"\p{L}"))


# Languages that the browser's translator offers.
CHROME = [
    "ar", "bg", "bn", "cs", "da", "de", "el", "en", "es", "fi", "fr", "hi", "hr", "hu", "id", "it", "iw", "ja", "kn", "ko", "lt", "mr", "nl", "no",
    "pl", "pt", "ro", "ru", "sk", "sl", "sv", "ta", "te", "th", "tr", "uk", "vi", "zh", "zh-Hant",
]


def chrome_language(locale: Column) -> Column:
    """The translator's language for a locale; null where it has none (strict_chrome_language raises)."""
    name = F.regexp_replace(trim(locale), "_", "-")
    low = F.lower(name)
    known = {c.lower(): c for c in CHROME}
    return (
        F.when((low == "iw") | (low == "he") | low.startswith("he-"), "iw")
        .when(low.isin("zh-hant", "zh-tw", "zh-hk", "zh-mo"), "zh-Hant")
        .when(low.isin("zh-hans", "zh-cn", "zh-sg", "zh-my"), "zh")
        .otherwise(F.coalesce(lookup(known, low), lookup(known, F.split_part(low, F.lit("-"), F.lit(1)))))
    )


def strict_chrome_language(locale: Column) -> Column:
    found = chrome_language(locale)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no such translator language: "), locale)))


def download_progress(loaded: Column, total: Column) -> Column:
    """Whole per cent of a download: a ratio up to 1, or bytes of a total."""
    loaded, total = F.coalesce(loaded, F.lit(0.0)), F.coalesce(total, F.lit(0.0))
    raw = F.when(loaded <= 1, loaded * 100).when(total > 0, loaded / total * 100).otherwise(loaded)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5))).cast("int")


def chrome_major_version(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)\b(?:Google\s+)?Chrome(?:\s+for\s+Testing)?\s+(\d+)\.", 1)
    return F.nullif(found, F.lit("")).cast("int")


def version_key(version: Column) -> Column:
    """Sorts dotted versions by their numbers."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


def locale_base(locale: Column) -> Column:
    """The language of a locale, in lower case."""
    return F.lower(F.split(locale, "[-_]")[0])


def locale_name(locale: Column) -> Column:
    return F.replace(F.lower(locale), F.lit("_"), F.lit("-"))
