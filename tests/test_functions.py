"""Scalar operations on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lingora.functions import lang as L
from lingora.functions import text as T
from lingora.operators import glossary as G
from lingora.operators import mapping as M
from lingora.operators import routing, runs
from lingora.operators import segments as S


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_language_codes(spark):
    assert column(spark, ["English", "zh-CN", "TRADITIONAL CHINESE", "xx"], L.normalize) == ["en", "zh-CN", "zh-TW", "xx"]
    assert column(spark, ["EN", "zh-TW", "ZH-tw", "xx"], L.to_flores) == ["eng_Latn", "zho_Hant", None, None]
    assert column(spark, ["zho_Hans", "zho_Hant", "none"], L.from_flores) == ["zh", "zh-TW", None]
    assert column(spark, ["国学", "國學", "abc", "国國"], L.zh_variant) == ["zh-CN", "zh-TW", "zh-CN", "zh-CN"]
    assert column(spark, ["zh_HK", "ms", "he-IL", "en-GB"], L.chrome_language) == ["zh-Hant", None, "iw", "en"]
    with pytest.raises(Exception, match="no such translator language"):
        column(spark, ["ms"], L.strict_chrome_language)


def test_downloads_and_versions(spark):
    rows = spark.createDataFrame([(0.5, 0.0), (50.0, 200.0), (70.0, None), (500.0, None)], "a double, b double")
    assert [r[0] for r in rows.select(L.download_progress(F.col("a"), F.col("b"))).collect()] == [50, 25, 70, 100]
    assert column(spark, ["Google Chrome 138.0.1", "Chromium 1.2", "chrome for testing 140.1"], L.chrome_major_version) == [138, None, 140]
    assert column(spark, ["10.2", "9.10.1"], L.version_key) == [[10, 2], [9, 10, 1]]


def test_detect_ties_and_blanks(spark):
    got = column(spark, ["你好ab", "ab你好", "", " \t", "123", "かな漢字", "가나 ab", None, "ééé"], L.detect)
    assert [(r.lang, round(r.confidence, 3)) for r in got] == [("en", 0.5), ("en", 0.5), ("en", 0), ("en", 0), ("en", 0.5), ("ja", 1), ("ko", 0.5), ("en", 0), ("en", 0.5)]


def test_filter_rules(spark):
    rows = [("保存", "template", "zh", True), ("单", "template", "zh", True), ("保存", "console", "zh", False), ("Save", "template", "zh", False), ("Save", "template", "en", True), ("x {{ 保存 }}", "script", "zh", False), ("A保存", "script", "zh", False)]
    frame = spark.createDataFrame(rows, "text string, context string, locale string, keep boolean")
    got = frame.select("keep", S.should_translate(F.col("text"), F.col("context"), F.col("locale")).alias("k")).collect()
    assert all(r.k == r.keep for r in got)
    forced = [("force-pattern", "^OK$"), ("min-length", 5)]
    assert frame.limit(1).select(S.should_translate(F.lit("OK"), F.lit("x"), F.lit("en"), forced)).first()[0]
    assert not frame.limit(1).select(S.should_translate(F.lit("OK\n"), F.lit("x"), F.lit("en"), forced)).first()[0]


def test_placeholders(spark):
    text = "a ${x} b {{ y }} c"
    frame = spark.createDataFrame([(text, "a __tm_0__ b T M 1 c")], "t string, mutated string")
    r = frame.select(T.protect(F.col("t")).alias("p"), T.placeholders(F.col("t")).alias("h"), T.restore(F.col("mutated"), T.placeholders(F.col("t"))).alias("r"), T.named_params(F.lit("{{ a.b }} ${c[0]} {{ f() }}")).alias("n")).first()
    assert r.p == "a __TM_0__ b __TM_1__ c" and r.h == ["${x}", "{{ y }}"] and r.r == text and r.n == "{aB} {c0} {{ f() }}"


def test_keys(spark):
    assert column(spark, ["Please save the Settings", "Créer un café", "${x}", "__TM_0__ items"], T.semantic_candidate) == ["saveSettings", "creerUnCafe", None, "items"]
    assert column(spark, ["保存设置", "请保存订单", "你好", "abc"], T.chinese_candidate) == ["saveSettings", "orderSave", None, None]
    assert column(spark, ["__userName$", "HTTPServer"], T.normalize_key) == ["userName", "httpserver"]
    assert column(spark, ["src/views/a.vue"], lambda p: T.namespace_key(p, F.lit("k"))) == ["views.a.k"]
    assert column(spark, ["src/views/a.vue"], lambda p: T.locale_output_path(p, F.lit("de"))) == ["locales/de/views/a.json"]


def test_escapes(spark):
    cases = [("a'b\n\\", "script", "'", "a\\'b\\n\\\\"), ("`${x}", "script", "`", "\\`\\${x}"), ('q"\t', "json-value", '"', 'q\\"\\t'), ("x", "json-value", "", '"x"'), ("a\r\nb'", "style", "'", "a\\A b\\'"), ("<&>'", "html-attr", "'", "&lt;&amp;&gt;&#39;"), ('<"', "html-attr", '"', "&lt;&quot;"), ("<&>", "html-text", "", "&lt;&amp;>"), ("it's", "yaml-value", "'", "it''s"), ("x", "other", "", "x")]
    frame = spark.createDataFrame(cases, "text string, context string, quote string, want string")
    for r in frame.select("want", T.escape(F.col("text"), F.col("context"), F.col("quote")).alias("got")).collect():
        assert r.got == r.want


def test_extractors(spark):
    assert column(spark, ['{"a": "x", "b": ["y", {"c": 1}]}', "{bad"], S.json_values) == [["x", "y"], None]
    assert column(spark, ["""f('a\\'b', "c", ` `)"""], S.quoted) == [["a'b", "c"]]
    assert column(spark, ["a: 'x'\nb: y # z\nc"], S.yaml_values) == [["x", "y # z"]]
    assert column(spark, ["p{content: \"hi\"; color:red}"], S.css_contents) == [["hi"]]
    assert column(spark, ["a\n```\ncode\n```\nb"], S.masked_markdown) == ["a\n   \n    \n   \nb"]
    assert column(spark, ['<a title="T" href="x">hi <b>there</b></a>'], S.html_texts) == [["hi", "there"]]
    assert column(spark, ["a\nb", "a"], lambda c: S.line_diff(c, F.lit("a\nc"))) == [["-b", "+c"], ["+c"]]
    edits = "array(named_struct('start', 0, 'end', 1, 'ord', 0, 'value', 'X'), named_struct('start', 2, 'end', 4, 'ord', 1, 'value', ''))"
    assert column(spark, ["abcdef"], lambda c: S.splice(c, F.expr(edits))) == ["Xbef"]
    over = "array(named_struct('start', 1, 'end', 4, 'ord', 0, 'value', 'X'), named_struct('start', 3, 'end', 5, 'ord', 1, 'value', 'YZ'))"
    assert column(spark, ["abcdef", None], lambda c: S.splice(c, F.expr(over))) == ["aXZf", None]
    assert column(spark, ["see https://a.b/c now"], runs.url_parts)[0][1].value == "https://a.b/c"


def test_places_of_many_lines(spark):
    text = "\n".join("\u3000" * (i % 3) + "x" * (i % 7) + " " * (i % 2) for i in range(1500))
    rows = S.lines(spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "path string, text string"), F.col("path")).orderBy("seg_idx").collect()
    assert len(rows) == sum(i % 7 > 0 for i in range(1500))
    assert all(text[r.start : r.end] == r.text and text[: r.start].count("\n") + 1 == r.line and r.start - (text.rfind("\n", 0, r.start) + 1) + 1 == r.column for r in rows)
    sums = spark.createDataFrame([([1, 2, 3],), ([5],), ([],), ([1] * 5,)], "a array<int>").select(S.running_sums(F.col("a"), 2).alias("s")).collect()
    assert [r.s for r in sums] == [[0, 1, 3], [0], [], [0, 1, 2, 3, 4]]


def test_hash_counts_utf16_units(spark):
    def units(t):
        h, raw = 0, t.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) % 2**32
        return str(h - 2**32 if h >= 2**31 else h)

    texts = ["", "abc", "é漢", "a\U0001F600b", "\U00020000" * 9]
    assert column(spark, texts, T.java_hash) == [units(t) for t in texts]


def test_registered_models_sort_by_priority(spark):
    pairs = spark.createDataFrame([("fr", "de"), ("zh", "en")], "from string, to string")
    out = routing.route(pairs, [("own/fr-de", "opus-mt", [("French", "German")], 0, False), ("own/zh", "opus-mt", [("zh", "en")], 0, False)])
    assert {(r["from"], r.model) for r in out.collect()} == {("fr", "own/fr-de"), ("zh", "own/zh")}


def test_contexts(spark):
    assert column(spark, ["src/views/order/List.vue", "a.ts", "x"], G.contexts) == [["views/order", "src/views", "src"], [], ["x"]]


def test_similarity_and_claims(spark):
    frame = spark.createDataFrame([("请输入用户名", "请输入用户名称"), ("", "a"), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in frame.select(T.lcs_length(F.col("a"), F.col("b"))).collect()] == [6, 0, 3]
    assert T.similarity("abc", "abc") == 1 and T.similarity("", "") == 0 and round(T.similarity("abcd", "abce"), 3) == 0.75
    seg = spark.createDataFrame([("p", "save it", 0), ("p", "save this", 1), ("p", "new", 2)], "source_path string, text string, ord int")
    old = spark.createDataFrame([("p", "save its", 0), ("p", "save it!", 1), ("p", "save this", 2)], "source_path string, text string, ord int")
    got = {r.text: r.previous_text for r in M.merge_fuzzy(seg, old).collect()}
    assert got == {"save it": "save its", "save this": "save this", "new": None}


def test_merged_entries(spark):
    kind = "struct<translation:string,translation_source:string,approved:boolean,translation_approved:boolean,key:string,key_source:string,key_approved:boolean>"
    old, new = ("a", "machine", True, None, "k", "manual", None), ("b", "machine", False, False, "n", "generated", False)
    glossary = ("g", "glossary", False, None, None, None, None)
    frame = spark.createDataFrame([(1, old, new, False), (2, old, glossary, False), (3, None, new, False), (4, old, None, True)], f"i int, p {kind}, n {kind}, fuzzy boolean")
    got = {r.i: r.e for r in frame.select("i", M.merged_entry(F.col("p"), F.col("n"), F.col("fuzzy")).alias("e")).collect()}
    assert (got[1].translation, got[1].approved, got[1].key) == ("a", False, "k")
    assert (got[2].translation, got[2].approved, got[2].key_approved) == ("g", True, True)
    assert (got[3].translation, got[3].approved, got[3].key) == ("b", False, "n")
    assert (got[4].translation, got[4].approved, got[4].key) == ("a", False, "k")


def test_backends_retry_and_fall_back_to_single_texts(spark):
    def fragile(texts):
        if len(texts) > 1:
            raise OSError("too many")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "text string").coalesce(1)
    assert sorted((r.text, r.translation) for r in M.translate(rows, fragile, 0).collect()) == [("a", "A"), ("b", "B")]
    assert [r.translation for r in M.translate(rows.limit(1), M.dictionary({"a": "x"})).collect()] == ["x"]
    with pytest.raises(Exception, match="no translation of"):
        M.translate(rows, lambda t: [], 1).collect()


def test_language_runs(spark):
    rows = spark.createDataFrame([(1, "Hello 你好, 123 мир")], "id int, text string")
    got = [(r.lang, r.text) for r in runs.language_runs(rows).orderBy("run_idx").collect()]
    assert got == [("english", "Hello "), ("chinese_simplified", "你好, 123 "), ("russian", "мир")]
    forced = spark.createDataFrame([(1, "Hello 你好", "french"), (2, "Hello 你好", None), (3, "", "french"), (4, None, "french")], "id int, text string, as string")
    got = [(r.id, r.lang, r.text) for r in runs.language_runs(forced, whole="as").orderBy("id", "run_idx").collect()]
    assert got == [(1, "french", "Hello 你好"), (2, "english", "Hello "), (2, "chinese_simplified", "你好")]
