"""Queries on languages, routing and segments of documents, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingora.functions import lang as L
from lingora.functions import text as T
from lingora.operators import routing, segments
from lingora.session import table
from lingora.sources import dims


def _class(low, high):
    return f"[\\x{{{low:X}}}-\\x{{{high:X}}}]"


def _detect_sql(source: str, key: str = "doc_id") -> str:
    """(key, lang_detected, confidence) of a relation with key and text."""
    variant = f"CASE WHEN length(regexp_replace(text, '[^{''.join(dict.fromkeys(dims.SIMPLIFIED))}]', '', 'g')) >= length(regexp_replace(text, '[^{''.join(dict.fromkeys(dims.TRADITIONAL))}]', '', 'g')) THEN 'zh' ELSE 'zh-TW' END"
    count = lambda p: f"length(regexp_replace(beyond, '[^{p[1:]}', '', 'g'))"
    first = lambda p: f"length(regexp_extract(text, '^[^{p[1:]}*'))"
    entries = [f"{{'less': -letters, 'at': {first('[A-Za-z]')}, 'lang': 'en'}}"]
    for name, low, high in dims.RANGES:
        n, at = count(_class(low, high)), first(_class(low, high))
        if name == "ja":
            n = f"(CASE WHEN kana > 0 THEN kana + cjk ELSE 0 END)"
        if name == "zh":
            at = f"(CASE WHEN {n} > 0 THEN {at} ELSE 2147483647 END)"
            n = f"({n} + CASE WHEN cjk > 0 AND kana = 0 AND variant = 'zh' THEN cjk ELSE 0 END)"
        entries.append(f"{{'less': -{n}, 'at': {at}, 'lang': '{name}'}}")
    entries.append("{'less': -(CASE WHEN cjk > 0 AND kana = 0 AND variant = 'zh-TW' THEN cjk ELSE 0 END), 'at': 2147483647, 'lang': 'zh-TW'}")
    return f"""(
  WITH t0 AS (SELECT {key}, coalesce(text, '') AS text FROM {source}),
  t1 AS (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, regexp_replace(text, '[\\x00-\\x7F]', '', 'g') AS beyond, {variant} AS variant FROM t0),
  t2 AS (SELECT *, {count(_class(0x4E00, 0x9FFF))} AS cjk, {count(_class(0x3040, 0x30FF))} AS kana FROM t1),
  t3 AS (SELECT *, list_sort(list_filter([{', '.join(entries)}], lambda e: e.less < 0)) AS ranked FROM t2)
  SELECT {key}, CASE WHEN trim(text, ' \t\n\r') = '' OR len(ranked) = 0 THEN 'en' ELSE ranked[1].lang END AS lang_detected,
    CASE WHEN trim(text, ' \t\n\r') = '' THEN 0.0::DOUBLE WHEN len(ranked) = 0 THEN 0.5::DOUBLE
      ELSE least((-ranked[1].less)::DOUBLE / (letters + length(beyond)), 1.0::DOUBLE) END AS confidence
  FROM t3)"""


def detect_language_docs(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", L.detect(F.col("text")).alias("d"))
    return found.select("doc_id", F.col("d.lang").alias("lang_detected"), "d.confidence")


FIXTURE = [
    (1, ""), (2, "   "), (3, "Hello, world!"), (4, "你好世界"), (5, "ひらがなです"), (6, "カタカナ"), (7, "日本語のテキスト"), (8, "안녕하세요"), (9, "Привет мир"), (10, "مرحبا بالعالم"),
    (11, "สวัสดีชาวโลก"), (12, "नमस्ते दुनिया"), (13, "國東車書"), (14, "国东车书"), (15, "12345 !?"), (16, "ab你好"), (17, "你好ab"), (18, "Ελληνικά"), (19, "שלום"), (20, "café"), (21, "㐀ab國車"),
]


def _fixture_sql() -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in FIXTURE) + ") AS f(id, text)"


def detect_language_fixture(spark, sf_dir):
    found = L.detect(F.col("text"))
    rows = spark.createDataFrame(FIXTURE, "id int, text string")
    return rows.select("id", found["lang"].alias("lang_detected"), found["confidence"].alias("confidence"))


def lang_confidence_summary(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("lang", L.detect(F.col("text")).alias("d"))
    docs = found.select("lang", F.col("d.lang").alias("from"), "d.confidence", F.lit("zh").alias("to"))
    small = docs.groupBy("lang", "from", "to").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    routed = routing.route(small)
    return routed.select("lang", F.col("from").alias("lang_detected"), "model", "n", "avg_confidence")


PAIRS = [("zh", "en"), ("en", "zh"), ("Chinese", "English"), ("fr", "de"), ("French", "German"), ("xx", "yy"), ("ZH-tw", "en"), ("zh-TW", "ja"), ("en", "xx")]


def route_models(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("from")).distinct().join(spark.createDataFrame([("zh",), ("en",), ("de",)], "to string"))
    fixed = spark.createDataFrame(PAIRS, "from string, to string")
    return routing.route(own.unionByName(fixed)).select(F.col("from").alias("lang_from"), F.col("to").alias("lang_to"), "model", "src_lang", "tgt_lang", "error")


def _values(rows, names):
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS v({names})"


def _route_sql() -> str:
    aliases, flores = _values(list(dims.ALIASES.items()), "name, code"), _values(list(dims.FLORES.items()), "code, flores")
    return f"""
WITH p AS (SELECT DISTINCT lang AS lang_from, t.x AS lang_to FROM documents, (VALUES ('zh'), ('en'), ('de')) AS t(x) UNION ALL SELECT * FROM {_values(PAIRS, 'lang_from, lang_to')}),
a AS (SELECT * FROM {aliases}), f AS (SELECT * FROM {flores}),
n AS (SELECT lang_from, lang_to, coalesce(x.code, lang_from) AS nf, coalesce(y.code, lang_to) AS nt FROM p LEFT JOIN a x ON x.name = lower(lang_from) LEFT JOIN a y ON y.name = lower(lang_to)),
g AS (SELECT n.*, coalesce(f1.flores, f2.flores) AS src, coalesce(g1.flores, g2.flores) AS tgt,
    CASE WHEN nf = 'zh' AND nt = 'en' THEN 'Xenova/opus-mt-zh-en' WHEN nf = 'en' AND nt = 'zh' THEN 'Xenova/opus-mt-en-zh' END AS exact
  FROM n LEFT JOIN f f1 ON f1.code = nf LEFT JOIN f f2 ON f2.code = lower(nf) LEFT JOIN f g1 ON g1.code = nt LEFT JOIN f g2 ON g2.code = lower(nt))
SELECT lang_from, lang_to, coalesce(exact, CASE WHEN src IS NOT NULL AND tgt IS NOT NULL THEN 'Xenova/nllb-200-distilled-600M' END) AS model,
  CASE WHEN exact IS NULL AND tgt IS NOT NULL THEN src END AS src_lang, CASE WHEN exact IS NULL AND src IS NOT NULL THEN tgt END AS tgt_lang,
  exact IS NULL AND (src IS NULL OR tgt IS NULL) AS error
FROM g"""


def language_dimension(spark, sf_dir):
    """Supported languages with their FLORES codes and what these lead back to."""
    return dims.languages(spark).select("code", "name", "native_name", L.to_flores(F.col("code")).alias("flores"), L.from_flores(L.to_flores(F.col("code"))).alias("back"))


def chrome_locales(spark, sf_dir):
    rows = spark.createDataFrame([("zh-TW",), ("zh_HK",), ("en-US",), ("he",), ("ms",), (" fr ",), ("zh-Hans",), ("pt_BR",), ("",), ("IW",), ("xx-yy",)], "locale string")
    return rows.select("locale", L.chrome_language(F.col("locale")).alias("code"))


_LINES = """
  SELECT 'doc/' || doc_id || '.md' AS path, nr - 1 AS seg_idx, raw, begin
  FROM (SELECT doc_id, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS nr,
      unnest(list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)))) AS begin
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
_SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIMMED = f"regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _path():
    return F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md"))


def extract_lines(spark, sf_dir):
    return segments.lines(table(spark, sf_dir, "documents"), _path())


EXTRACT_SQL = f"""
WITH l AS ({_LINES}), t AS (SELECT *, {_TRIMMED} AS text, length(raw) - length(regexp_replace(raw, '^{_SPACE}+', '')) AS lead FROM l)
SELECT path, seg_idx::INT AS seg_idx, substr(sha256(text || ':' || path), 1, 8) AS id, text, (coalesce(begin, 0) + lead)::INT AS start,
  (coalesce(begin, 0) + lead + length(text))::INT AS "end", (seg_idx + 1)::INT AS line, (lead + 1)::INT AS "column"
FROM t WHERE text <> ''"""


def filter_segments(spark, sf_dir):
    """Which lines go to a translator, for three source locales."""
    lines = extract_lines(spark, sf_dir).select("path", "seg_idx", "text")
    locale = lambda x: segments.should_translate(F.col("text"), F.lit("markdown"), F.lit(x))
    return lines.select("path", "seg_idx", locale("zh").alias("keep_zh"), locale("en").alias("keep_en"), locale("fr").alias("keep_fr"))


FILTER_SQL = f"""
WITH l AS ({_LINES}), t AS (SELECT path, seg_idx, {_TRIMMED} AS text FROM l),
v AS (SELECT *, regexp_replace(text, '\\{{\\{{[\\s\\S]*?\\}}\\}}|\\$\\{{[\\s\\S]*?\\}}|__TM_[0-9]+__', ' ', 'g') AS shown FROM t WHERE text <> ''),
n AS (SELECT *, length(regexp_replace(shown, '[^\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]', '', 'g')) AS zh, length(regexp_replace(shown, '[^A-Za-z]', '', 'g')) AS en, length(regexp_replace(shown, '[^\\p{{L}}]', '', 'g')) AS fr,
  regexp_matches(shown, '^[a-zA-Z]') AS latin FROM v)
SELECT path, seg_idx::INT AS seg_idx, zh > 0 AND NOT latin AND (zh >= 2 OR length(trim(shown)) = 1) AS keep_zh,
  en > 0 AND (en >= 2 OR length(trim(shown)) = 1) AS keep_en, fr > 0 AND NOT latin AND (fr >= 2 OR length(trim(shown)) = 1) AS keep_fr
FROM n"""


def distinct_texts(spark, sf_dir):
    """Texts to translate, each once, with its first place."""
    lines = extract_lines(spark, sf_dir)
    return lines.groupBy("text").agg(F.count("*").alias("uses"), F.min(F.struct("path", "seg_idx")).alias("f")).select("text", "uses", F.col("f.path").alias("first_path"), F.col("f.seg_idx").alias("first_idx"))


DISTINCT_SQL = f"""
WITH l AS ({_LINES}), t AS (SELECT path, seg_idx, {_TRIMMED} AS text FROM l)
SELECT text, count(*) AS uses, min({{'p': path, 's': seg_idx}}).p AS first_path, min({{'p': path, 's': seg_idx}}).s::INT AS first_idx FROM t WHERE text <> '' GROUP BY text"""


def placeholder_fixture(spark, sf_dir):
    rows = spark.createDataFrame([(1, "Hello ${name}, you have {{ n }} items"), (2, "no holes"), (3, "{{a}}{{b}}${c}"), (4, "{{ x\ny }}")], "id int, text string")
    out = rows.select("id", "text", T.protect(F.col("text")).alias("protected"), T.placeholders(F.col("text")).alias("holes"))
    return out.select("id", "protected", F.array_join("holes", "|").alias("holes"), (T.restore_exact(F.col("protected"), F.col("holes")) == F.col("text")).alias("same"))


def escape_texts(spark, sf_dir):
    """Texts of conversations as they may stand in HTML."""
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.escape(c, F.lit("html-text"), F.lit("")).alias("as_text"), T.escape(c, F.lit("html-attr"), F.lit("'")).alias("as_attr"), T.escape(c, F.lit("yaml-value"), F.lit("'")).alias("as_yaml"))


def java_hash(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return names.select("p_partkey", T.java_hash(F.col("p_name")).alias("hash"))


QUERIES = {
    "detect_language_docs": detect_language_docs, "detect_language_fixture": detect_language_fixture, "lang_confidence_summary": lang_confidence_summary, "route_models": route_models,
    "language_dimension": language_dimension, "chrome_locales": chrome_locales, "extract_lines": extract_lines, "filter_segments": filter_segments, "distinct_texts": distinct_texts,
    "protect_placeholders": placeholder_fixture, "escape_texts": escape_texts, "java_hash": java_hash,
}
ORACLES = {
    "detect_language_docs": f"SELECT * FROM {_detect_sql('documents')}",
    "detect_language_fixture": f"SELECT * FROM {_detect_sql(_fixture_sql(), 'id')}",
    "lang_confidence_summary": f"""
SELECT lang, lang_detected, CASE WHEN lang_detected = 'en' THEN 'Xenova/opus-mt-en-zh' ELSE 'Xenova/nllb-200-distilled-600M' END AS model, count(*) AS n, round(avg(confidence), 6) AS avg_confidence
FROM documents JOIN {_detect_sql('documents')} USING (doc_id) GROUP BY ALL""",
    "route_models": _route_sql(),
    "language_dimension": f"""
WITH l AS (SELECT * FROM {_values(dims.LANGUAGES, 'code, name, native_name')}), f AS (SELECT * FROM {_values([(i, *x) for i, x in enumerate(dims.FLORES.items())], 'ord, code, flores')})
SELECT code, name, native_name, flores, (SELECT arg_min(g.code, g.ord) FROM f g WHERE g.flores = f.flores) AS back FROM l LEFT JOIN f USING (code)""",
    "chrome_locales": "SELECT * FROM " + _values([("zh-TW", "zh-Hant"), ("zh_HK", "zh-Hant"), ("en-US", "en"), ("he", "iw"), ("ms", None), (" fr ", "fr"), ("zh-Hans", "zh"), ("pt_BR", "pt"), ("", None), ("IW", "iw"), ("xx-yy", None)], "locale, code"),
    "extract_lines": EXTRACT_SQL, "filter_segments": FILTER_SQL, "distinct_texts": DISTINCT_SQL,
    "protect_placeholders": "SELECT id, protected, holes, true AS same FROM " + _values([(1, "Hello __TM_0__, you have __TM_1__ items", "${name}|{{ n }}"), (2, "no holes", ""), (3, "__TM_0____TM_1____TM_2__", "{{a}}|{{b}}|${c}"), (4, "__TM_0__", "{{ x\ny }}")], "id, protected, holes"),
    "escape_texts": """
SELECT conv_id, turn, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS as_text, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;') AS as_attr,
  replace(replace(replace(text, '''', ''''''), chr(13), '\\r'), chr(10), '\\n') AS as_yaml FROM conversations""",
    "java_hash": """
SELECT p_partkey, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::VARCHAR AS hash
FROM (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part)""",
}
