"""Backends, translation end to end, and what a project's commands gained with them."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from lingora.functions import text as T
from lingora.operators import backends as B
from lingora.operators import commands as C
from lingora.operators import mapping as M
from lingora.operators import pages as P
from lingora.operators import segments as S
from lingora.operators import translation as X
from lingora.sources import files as files_


def test_service_answers():
    sent = []

    def post(url, body, headers, seconds):
        sent.append((url, json.loads(body), headers, seconds))
        return json.dumps({"translations": ["A", {"translation": "B", "translationSource": "glossary", "confidence": 0.5}]}).encode()

    got = B.service("http://s", "zh", "en", {"x": "y"}, "k", 1500, post)(["a", "b"])
    assert [(x["source"], x["translation"], x["translation_source"], x["confidence"]) for x in got] == [("a", "A", "machine", None), ("b", "B", "glossary", 0.5)]
    assert sent == [("http://s", {"texts": ["a", "b"], "sourceLocale": "zh", "targetLocale": "en", "glossary": {"x": "y"}}, {"content-type": "application/json", "authorization": "Bearer k"}, 1.5)]
    assert B.service(None, "zh", "en")(["a"])[0] | {"confidence": 0.0, "translation": "a"} == B.service(None, "zh", "en")(["a"])[0]
    for payload in ({"no": 1}, ["A"], ["A", 3]):
        with pytest.raises(RuntimeError, match="no valid answer"):
            B.service("http://s", "zh", "en", post=lambda *_, p=payload: json.dumps(p).encode())(["a", "b"])

    def refuse(*_):
        raise OSError(111, "refused")

    with pytest.raises(RuntimeError, match="no answer from http://s to 1 text") as caught:
        B.service("http://s", "zh", "en", post=refuse)(["a"])
    assert B.error_chain(caught.value).split("\n")[1].startswith("Caused by: ConnectionRefusedError: ") and "errno=111" in B.error_chain(caught.value)
    assert B.error_chain("plain") == "plain" and B.error_chain(Exception()) == "Unknown error"


@pytest.mark.parametrize(("body", "shown"), [(b" over\n  quota ", ": over quota"), (b"", ""), (b"x" * 300, ": " + "x" * 200 + "...")])
def test_a_refusal_is_told_with_its_status_and_body(body, shown):
    def refuse(url, *_):
        raise urllib.error.HTTPError(url, 429, "Too Many Requests", {}, io.BytesIO(body))

    with pytest.raises(RuntimeError) as caught:
        B.service("http://s", "zh", "en", post=refuse)(["a"])
    assert str(caught.value) == f"the service refused 1 text(s): 429 Too Many Requests (http://s){shown}"


def test_backend_of_settings():
    local = B.echo("en")
    settings = files_.config({"translator": {"name": "api"}})
    assert B.chosen(settings, local) is local and B.chosen(settings, local, {"api": lambda s: B.dictionary({"a": "b"})})(["a"]) == ["b"]
    assert B.chosen(files_.config({"translator": {"name": "api", "endpoint": "http://s"}}), local) is not local
    assert B.generation("a", "b")["src_lang"] == "a" and "src_lang" not in B.generation(None, "b")


def test_translated_rows(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, "你好"), (4, "Привет"), (5, " "), (6, None), (7, "known")], "id int, text string")
    cache = spark.createDataFrame([("known", "en", "zh", "记得")], X.CACHE)
    out = {r.id: r for r in X.translated(X.languages(rows, "Chinese"), B.echo("zh"), cache, True).collect()}
    assert {i: (r.state, r.translation) for i, r in out.items()} == {
        1: ("translated", "[zh] hello"), 2: ("translated", "[zh] hello"), 3: ("target", None), 4: ("translated", "[zh] Привет"), 5: ("blank", None), 6: ("blank", None), 7: ("cached", "记得"),
    }
    assert out[7].model == "cache" and out[1].model == "Xenova/opus-mt-en-zh" and out[4].model.startswith("Xenova/nllb") and out[1]["from"] == "en"
    rows_, seen = X.counted(X.translated(X.languages(rows, "Chinese"), B.echo("zh"), cache, True))
    assert rows_.count() == 7 and seen.get == {"rows": 7, "blank": 2, "target": 1, "cached": 1, "translated": 3, "unroutable": 0}
    odd = X.translated(X.languages(rows.limit(1), "xx", "yy"), B.echo("xx")).first()
    assert (odd.state, odd.translation, odd.confidence) == ("unroutable", None, None)
    batch = spark.createDataFrame([("p", 0, "你好"), ("p", 1, "hello"), ("q", 0, "hello")], "page string, ord int, text string")
    assert {(r.page, r.ord): r["from"] for r in X.languages(batch, "en", batch=["page"], order="ord").collect()} == {("p", 0): "zh", ("p", 1): "zh", ("q", 0): "en"}
    assert X.translated(X.languages(rows.where("false"), "en"), B.echo("en")).count() == 0


def test_stream_uses_and_fills_the_cache(spark, tmp_path):
    place = {k: str(tmp_path / k) for k in ("in", "cache", "out", "check")}
    schema = "id int, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place["in"])
        query = X.stream(spark.readStream.schema(schema).parquet(place["in"]), "zh", B.echo("zh"), place["cache"], place["out"], place["check"])
        query.awaitTermination(120)

    arrive([(1, "hello"), (2, "你好")])
    arrive([(3, "hello"), (4, "bye")])
    got = {r.id: (r.translation, r.state) for r in spark.read.parquet(place["out"]).collect()}
    assert got == {1: ("[zh] hello", "translated"), 3: ("[zh] hello", "cached"), 4: ("[zh] bye", "translated")}
    assert sorted(r.text for r in X.StreamCache(spark, place["cache"]).read(9).collect()) == ["bye", "hello"]


def test_a_cache_stays_small_and_a_batch_run_again_sees_what_it_saw(spark, tmp_path):
    at = str(tmp_path / "cache")
    store = X.StreamCache(spark, at, every=3)
    frame = lambda *texts: spark.createDataFrame([(t, "en", "zh", f"{t}!") for t in texts], X.CACHE)
    seen = {}
    for n in range(11):
        assert {r.text for r in store.read(n).collect()} == {"a", *(f"t{i}" for i in range(n))} - ({"a"} if n == 0 else set())
        gen, batches = store.parts(n)
        seen[n] = len(batches)
        store.add(n, frame("a", f"t{n}"))
        again = {r.text for r in store.read(n).collect()}
        store.add(n, frame("a", f"t{n}"))
        assert {r.text for r in store.read(n).collect()} == again and f"t{n}" not in again
    assert max(seen.values()) <= 3 and store.parts(11)[0] == 9
    assert len(store._numbers("batch")) <= 6 and len(store._numbers("gen")) <= 2
    asked = spark.createDataFrame([("t3",)], "text string")
    assert "t3" in {r.text for r in store.read(11, asked).collect()} and store.read(11, asked).count() < store.read(11).count()
    assert X.StreamCache(spark, at, ttl=-5).read(11).count() == 0 and X.StreamCache(spark, str(tmp_path / "none")).read(0).count() == 0


def test_apply_rewrites_all_kinds_of_files_and_leaves_skipped_entries(spark):
    sources = {
        "a.json": '{"k": "提交", "提交": ["跳过", "提交"]}', "b.html": '<a title="提交">\n 提交 </a><p>跳过</p>', "c.css": "p::before{content: '提交'}", "d.yaml": "k: '提交'\nx: 提交 # n\ny: 提交",
        "e.md": "提交\n```\n提交\n```\n", "f.ts": "const a = '提交', b = '跳过'", "bad.json": '{"k": "提交"',
    }
    files = spark.createDataFrame(list(sources.items()), "path string, content string")
    entries = spark.createDataFrame([(p, t, v, True, s) for p in sources for t, v, s in (("提交", "it's \"<ok>", False), ("跳过", "never", True))], "source_path string, text string, translation string, approved boolean, skip boolean")
    out = {r.path: r.content for r in C.apply(files, entries).collect()}
    assert out == {
        "a.json": '{"k": "it\'s \\"<ok>", "提交": ["跳过", "it\'s \\"<ok>"]}', "b.html": '<a title="it\'s &quot;&lt;ok&gt;">\n it\'s "&lt;ok> </a><p>跳过</p>', "c.css": "p::before{content: 'it\\'s \"<ok>'}",
        "d.yaml": "k: 'it''s \"<ok>'\nx: 提交 # n\ny: \"it's \\\"<ok>\"", "e.md": "it's \"<ok>\n```\n提交\n```\n", "f.ts": "const a = 'it\\'s \"<ok>', b = '跳过'",
    }
    assert S.places_in("x", "other") == [] and S.places_in("", "md") == []


def test_keys_of_references_and_outputs(spark):
    row = spark.range(1).select(
        T.namespace_key(F.lit("src/a/b.vue"), F.lit("k"), ".", "app\\ x ").alias("full"), T.namespace_key(F.lit("src/a/b.vue"), F.lit("k"), local=True).alias("local"),
        T.locale_output_path(F.lit("source/a/b.vue"), F.lit("de"), "out", "ts", "app").alias("path"),
    ).first()
    assert tuple(row) == ("app.x.a.b.k", "k", "out/de/app/a/b.ts")


def test_macros_of_components_are_skipped(spark):
    vue = "<script setup>\nconst p = defineProps<{ a: string }>({ a: { default: f('默认') } })\nconst m = '消息'\n</script>\n"
    files = spark.createDataFrame([("src/a.vue", vue)], "path string, content string")
    entries = spark.createDataFrame([("src/a.vue", t, k, True) for t, k in (("默认", "d"), ("消息", "m"))], "source_path string, text string, key string, approved boolean")
    entries = entries.withColumns({c: F.lit(None).cast("boolean") for c in ("translation_approved", "key_approved", "skip", "deprecated")})
    out, skipped = C.adapt(files, entries, files_.config()["adapt"] | {"mode": "local"})
    assert [(r.text, r.reason) for r in skipped.collect()] == [("默认", "vue-compiler-macro")]
    assert "f('默认')" in out.first().content and "m = t('m')" in out.first().content


def test_approval_by_flags_and_counts(spark):
    rows = [("p", "保存", "x", "k", False, False, False), ("p", "b", "", "k2", False, False, False), ("p", "c", "y", None, True, False, False), ("p", "d", "z", "k4", False, True, False), ("q", "e", "v", "k5", False, False, True)]
    entries = spark.createDataFrame(rows, "source_path string, text string, translation string, key string, skip boolean, deprecated boolean, approved boolean")
    entries = entries.withColumns({"translation_approved": F.lit(None).cast("boolean"), "key_approved": F.lit(None).cast("boolean"), "key_source": F.lit(None).cast("string")})
    yes = lambda **flags: {r.text for r in M.approve(entries, **flags).where("approved").collect()}
    assert yes() == {"保存", "e"} and yes(allow_empty=True) == {"保存", "b", "e"} and yes(include_deprecated=True) == {"保存", "d", "e"} and yes(include_skipped=True) == {"保存", "e"}
    keyed = M.derived_keys(entries)
    assert {r.text: (r.key, r.key_source) for r in keyed.collect()}["c"] == ("y", "generated")
    assert {r.text for r in M.approve(keyed, include_skipped=True).where("approved").collect()} == {"保存", "c", "e"}
    assert {tuple(r) for r in M.approval_counts(M.approve(entries)).collect()} == {("p", 4, 1, 0, 3, True), ("q", 1, 0, 1, 0, False)}


def test_top_lists(spark):
    stats = spark.createDataFrame([(f"p{i}", i, i % 3) for i in range(9)], "path string, entries int, ready int")
    status = spark.createDataFrame([("p1", True), ("p2", False)], "source_path string, adapted boolean")
    full = M.adapt_counts(stats, status, spark.createDataFrame([(f"p{i}",) for i in range(6)], "path string"))
    assert [r.path for r in M.top_orphans(full, 2).collect()] == ["p8", "p7"]
    assert [r.path for r in M.top_waiting(full).collect()] == ["p2", "p5", "p4"]


def test_packages_in_another_locale(spark):
    files = spark.createDataFrame([("l/zh/a.json", '{"k": "x"}'), ("l/zh/b.json", "{}")], "path string, content string")
    there = spark.createDataFrame([("l/en/b.json", "old")], "path string, content string")
    out = {r.path: (r.content, r.skipped, r.changed) for r in C.translate_locale(files, there, B.dictionary({"x": "y"}), "l/zh/", "zh", "en").collect()}
    assert out == {"l/en/a.json": ('{"k": "y"}', False, True), "l/en/b.json": ("{}", True, False)}
    again = C.translate_locale(files, there, B.dictionary({"x": "y"}), "l/zh", "de", "en", "o", True)
    assert {r.path for r in again.collect()} == {"o/a.json", "o/b.json"}
    with pytest.raises(ValueError, match="outside"):
        C.translate_locale(files, there, B.dictionary({}), "l/zh", "zh", "en", "l/zh/en")


def test_init_keeps_what_is_there(tmp_path):
    first = C.init(str(tmp_path), files_.config())
    assert ".tmigrate/config.json" in first["created"] and json.loads((tmp_path / ".tmigrate/config.json").read_text())["target_locale"] == "en"
    (tmp_path / ".tmigrate/glossary.json").write_text('{"a": "b"}')
    again = C.init(str(tmp_path), files_.config({"target_locale": "de"}), overwrite=False)
    assert set(again["skipped"]) == {".tmigrate/config.json", ".tmigrate/glossary.json", *(f".tmigrate/{d}/.gitkeep" for d in ("maps", "cache", "backups"))}
    assert (tmp_path / ".tmigrate/glossary.json").read_text() == '{"a": "b"}'


def test_packages_are_written_sorted_and_indented(spark):
    frame = spark.createDataFrame([({"b": 'x"', "a": "é"},), ({},)], "m map<string,string>").select(M.pretty(F.col("m")).alias("p"))
    assert [r.p for r in frame.collect()] == ['{\n  "a": "é",\n  "b": "x\\""\n}', "{}"]


def test_what_is_in_view_comes_first(spark):
    rows = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, None), (1, 3, True)], "page_id int, pos int, visible boolean")
    assert [r.pos for r in P.visible_first(rows, ["page_id"], "pos").orderBy("place").collect()] == [1, 3, 0, 2]
