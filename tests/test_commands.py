"""A small project through the commands."""

import json

import pytest
from pyspark.sql import functions as F

from lingora.operators import commands as C
from lingora.operators import mapping as M
from lingora.operators import script
from lingora.sources import files as S

VUE = """<template>
  <div title="标题" class="x" :label="'标签'">你好 {{ name }}</div>
</template>
<script>
import x from '模块'
export default { data() { return { msg: '消息', '键': 1 } } }
</script>
"""
TS = "'use strict'\nconst a = '保存', b = `共 ${n} 条`, c = /'不'/; // '注释'\n"
TSX = "export const V = () => <p alt=\"图\">欢迎 <b>你</b></p>\n"


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in {"src/a.vue": VUE, "src/b.ts": TS, "src/c.tsx": TSX, "src/d.json": '{"k": "提交", "n": 1}', "src/e.md": "标题行\n```\n代码\n```\n", "src/x.test.ts": "'测试'", "dist/z.ts": "'不要'", "src/i18n/q.ts": "'不要'"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return S.source_files(spark, str(root), S.config()).cache()


def test_discovery_and_config(project, spark):
    assert sorted(r.path for r in project.collect()) == ["src/a.vue", "src/b.ts", "src/c.tsx", "src/d.json", "src/e.md"]
    c = S.config({"translator": {"retries": 1}}, {"source_locale": "en"})
    assert c["translator"] == {"timeout": 30000, "retries": 1, "concurrency": 5} and c["source_locale"] == "en" and c["exclude"][-1] == "locales/**"
    assert S.narrowed("src/a.vue") == ["src/a.vue"] and S.narrowed("src/views")[0].startswith("src/views/**/*.{vue")


def test_lexer():
    got = [(t, k) for _, _, t, _, k in script.component(VUE)]
    assert got == [("标题", "VueStaticAttribute"), ("标签", "VueDirectiveStringLiteral"), ("你好 {{ name }}", "VueTemplateText"), ("消息", "StringLiteral")]
    assert [t for *_, t, _ in script.script_strings(TS)] == ["保存", "共", "条"]
    assert [(t, k) for _, _, t, k in script.script_strings(TSX, True)] == [("图", "JSXStringLiteral"), ("欢迎", "JSXText"), ("你", "JSXText")]
    assert script.script_strings("x = 'open") == [] and script.script_strings("`${`a ${'b'} c`}`")[0][2] == "a"
    assert script.cooked(r"\u4f60\x41\n\'") == "你A\n'"


def test_scan_convert_adapt_apply(project, spark):
    settings = S.config()
    glossary = spark.createDataFrame([(0, "保存", "Save"), (1, "提交", "Submit")], "ord int, key string, value string")
    known = spark.createDataFrame([], "path string, hash string")
    entries = C.scan(project, known, glossary, settings, M.echo("en")).cache()
    rows = {(r.source_path, r.text): r for r in entries.collect()}
    assert rows["src/b.ts", "保存"].translation == "Save" and rows["src/b.ts", "保存"].key == "save" and rows["src/b.ts", "保存"].approved
    assert rows["src/a.vue", "你好 {{ name }}"].translation == "[en] 你好 {{ name }}"
    assert ("src/e.md", "代码") not in rows and ("src/e.md", "标题行") in rows
    seen = project.select("path", "hash")
    assert C.scan(project, seen, glossary, settings, M.echo("en")).count() == 0

    flags = {c: F.lit(None).cast("boolean") for c in ("translation_approved", "key_approved", "skip", "deprecated")}
    done = entries.withColumns(flags).withColumn("approved", F.lit(True)).cache()
    packages = {r.output: json.loads(r.package) for r in C.convert(done, "en", settings).collect()}
    assert packages["locales/en/d.json"] == {"submit": "Submit"} and packages["locales/en/b.json"]["save"] == "Save"
    with pytest.raises(ValueError, match="texts"):
        C.convert(done.withColumn("key", F.lit("same")), "en", settings)

    adapted, skipped = C.adapt(project, done.withColumn("key", F.when(F.col("text") != "图", F.col("key"))), settings["adapt"], "import { t } from '@/i18n'")
    out = {r.path: r.content for r in adapted.collect()}
    key = rows["src/a.vue", "你好 {{ name }}"].key
    assert f"{{{{ $t('a.{key}', {{ name: name }}) }}}}" in out["src/a.vue"] and ":title=\"$t('a." in out["src/a.vue"] and "msg: t('a." in out["src/a.vue"]
    assert "const a = t('b.save')" in out["src/b.ts"] and out["src/b.ts"].startswith("import { t }")
    assert {(r.text, r.reason) for r in skipped.collect()} >= {("图", "missing-key"), ("共", "unsupported-context")}

    applied = C.apply(project, done)
    text = {r.path: r.content for r in applied.collect()}
    assert "const a = 'Save'" in text["src/b.ts"] and "消息" in text["src/a.vue"] and "[en] 消息" in text["src/a.vue"]
    assert {r.path: r.content for r in C.restore(applied).collect()}["src/b.ts"] == TS
    assert "+" in {r.path: r.diff for r in C.dry_run(applied).collect()}["src/b.ts"]


def test_maps_round_trip_and_corruption(spark):
    entries = spark.createDataFrame([("src/a.ts", 0, "文", "id1", "t", "manual", True)], "source_path string, ord int, text string, id string, translation string, translationSource string, approved boolean")
    files = S.map_json(entries, "2024").unionByName(spark.createDataFrame([(".tmigrate/maps/src/b.ts.json", "{oops")], "path string, content string"))
    good, bad = S.maps(files)
    assert [(r.source_path, r.text, r.translation, r.approved) for r in good.collect()] == [("src/a.ts", "文", "t", True)]
    assert [r.path for r in bad.collect()] == [".tmigrate/maps/src/b.ts.json"]
    assert S.maps(files, "src/a.ts/")[0].count() == 1 and S.maps(files, "src")[1].count() == 1 and S.maps(files, "sr")[0].count() == 0
    assert [tuple(r) for r in S.first_invalid(bad).select("path", "others").collect()] == [(".tmigrate/maps/src/b.ts.json", 0)] and S.first_invalid(bad, 0).count() == 0
    assert S.orphaned(good, spark.createDataFrame([("src/z.ts",)], "path string")).count() == 1
    with pytest.raises(Exception, match="not a map file"):
        files.select(S.source_of_map(F.lit("x.json"))).collect()


def test_packages_are_found_in_a_locales_order(spark, tmp_path):
    for name in ("b.json", "a.ts", "B.js", "c.css", "sub/é.json", "sub/f.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert [r.path for r in S.package_files(spark, str(tmp_path), S.config()).collect()] == ["a.ts", "B.js", "b.json", "sub/é.json", "sub/f.json"]


def test_packages_are_translated_in_place(spark):
    files = spark.createDataFrame([("en.json", '{\n  "a": "x $1",\n  "x $1": ["y", "x"]\n}'), ("e.json", "{}")], "path string, content string")
    out = {r.path: r.content for r in C.translate_package(files, lambda ts: [t.upper() for t in ts]).collect()}
    assert out["en.json"] == '{\n  "a": "X $1",\n  "x $1": ["Y", "X"]\n}' and out["e.json"] == "{}"


def test_adapt_status(spark):
    entries = spark.createDataFrame([("p", "i", "k", True), ("q", "j", "l", True)], "source_path string, id string, key string, approved boolean")
    refs = spark.createDataFrame([("p", ["i:k"]), ("q", ["old:l"])], "source_path string, refs array<string>")
    assert {r.source_path: r.adapted for r in C.adapt_status(entries, refs).collect()} == {"p": True, "q": False}


def test_scan_keeps_the_earlier_map(spark):
    glossary = spark.createDataFrame([(0, "保存", "Save")], "ord int, key string, value string")
    text = "const a = '保存', b = '请输入用户名称', c = '欢迎', d = '没有变化', e = '全新'\n"
    files = spark.createDataFrame([("src/b.ts", text, "2"), ("src/same.ts", "'不变'", "1")], "path string, content string, hash string")
    known = spark.createDataFrame([("src/b.ts", "1"), ("src/same.ts", "1")], "path string, hash string")
    kind = "source_path string, ord int, text string, id string, translation string, translationSource string, approved boolean, translationApproved boolean, key string, keySource string, keyApproved boolean, skip boolean, deprecated boolean"
    rows = [
        ("src/b.ts", 0, "保存", "i0", "by hand", "manual", False, False, "mine", "manual", False, False, None), ("src/b.ts", 1, "请输入用户名", "i1", "Enter a name", "manual", True, True, "enterName", "generated", True, None, None),
        ("src/b.ts", 2, "欢迎", "i2", "Welcome!", "manual", True, True, "hello", "manual", True, True, None), ("src/b.ts", 3, "没有变化", "i3", "old", "machine", False, False, "oldKey", "generated", None, None, None),
        ("src/b.ts", 4, "已经删除的文本", "i4", "Gone", "manual", True, True, "gone", "manual", True, None, None), ("src/same.ts", 0, "不变", "i5", "Same", "manual", True, True, "same", "manual", True, None, None),
    ]
    before = spark.createDataFrame(rows, kind)
    out = C.scan(files, known, glossary, S.config(), M.echo("en"), before).cache()
    got = {r.text: r for r in out.collect()}
    assert set(got) == {"保存", "请输入用户名称", "欢迎", "没有变化", "全新", "已经删除的文本"} and out.count() == 6
    assert (got["保存"].translation, got["保存"].approved) == ("Save", True)
    near = got["请输入用户名称"]
    assert (near.translation, near.approved, near.translation_approved, near.key_approved, near.id) == ("Enter a name", False, False, False, "i1") and near.key != "enterName"
    stays = got["欢迎"]
    assert (stays.translation, stays.key, stays.key_source, stays.approved, stays.skip, stays.deprecated) == ("Welcome!", "hello", "manual", True, True, False)
    # A machine's entry gives way to the new one, with its key.
    assert (got["没有变化"].translation, got["没有变化"].approved) == ("[en] 没有变化", False)
    gone = got["已经删除的文本"]
    assert (gone.translation, gone.key, gone.deprecated, gone.ord) == ("Gone", "gone", True, max(r.ord for r in got.values()))
    assert got["全新"].translation == "[en] 全新"
    assert {r.text for r in C.scan(files, known, glossary, S.config(), M.echo("en"), before, True).collect()} == set(got) - {"已经删除的文本"}
