"""Queries see whole tables and whole texts, held to brute force where SQL can't say it."""

import hashlib
import random
import re
import unicodedata

import pytest

from pyspark.sql import functions as F

from lingora.functions import text as T
from lingora.operators import runs as R
from lingora.plans import bundle
from lingora.plans import workflow as W
from lingora.sources import dims

SF = "/root/testdata/sf0.001"


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abé漢😀", k=rng.randrange(150))) for _ in range(2))
        assert T.lcs(a, b) == table_lcs(a, b)


def claimed(new, old):
    """new, old: texts in order, of one path."""
    used, out = set(), []
    for t in new:
        score = lambda c: 2 * table_lcs(t, c) / max(1, len(t) + len(c))  # noqa: B023, E731
        free = [(score(c), -i, c) for i, c in enumerate(old) if c not in used]
        best = (1.0, 0, t) if t in old else max((x for x in free if x[0] >= 0.8), default=None)
        if best:
            used.add(best[2])
        out.append((t, best and best[2], best[0] if best else 0.0))
    return out


def test_merges_see_whole_turns(spark, tmp_path):
    head = "The same forty characters begin all turns " * 2
    tails = {0: ["one", "two", "one"], 1: ["x" * 90, "y" * 90, "z" * 90, "zz" * 40], 2: ["é", "é!", "0123456789" * 20], 5: ["", "a"]}
    rows = [(c, i, "user", head + x if x else "") for c, xs in tails.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = set()
    for c in tails:
        new = [t for k, _, _, t in rows if k == c]
        old = dict.fromkeys([t for k, i, _, t in rows if k == c and (c + i) % 5] + ["old " + t for k, i, _, t in rows if k == c and i % 2 == 0])
        want |= {(f"chat/{c}", *x) for x in claimed(new, list(old))}
    got = {tuple(r) for r in W.merge_fuzzy(spark, str(tmp_path)).collect()}
    assert got == want
    assert W.merge_exact(spark, str(tmp_path)).count() == len({(c, t) for c, _, _, t in rows})
    assert all(r.text in ("old ", "old " + head + "one") or len(r.text) > 80 for r in W.deprecated_entries(spark, str(tmp_path)).collect())


def plain(t):
    t = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t)
    return re.sub(r"[^A-Za-z0-9_$]+", " ", t).split()


def camel(words):
    words = [w for w in (x.strip("_$").lower() for x in words) if w]
    return "".join(w if i == 0 else w[0].upper() + w[1:] for i, w in enumerate(words))


def semantic(t):
    n = iter(range(99))
    t = re.sub(T.PLACEHOLDER, lambda m: f"__TM_{next(n)}__", t)
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f")
    return camel([w for w in plain(t) if w.lower() not in dims.KEY_STOPS and not re.fullmatch(r"_*tm_*\d+_*", w, re.I)])


def key_of(text, translation):
    compact = re.sub("[^\u4e00-\u9fff]", "", re.sub(T.PLACEHOLDER, "", text))
    chinese = compact and (dims.KEY_TEXTS.get(compact) or camel([v for k, v in dims.KEY_TERMS.items() if k in compact]))
    keys = [camel(plain(k)) for k in (chinese, semantic(translation), semantic(text))]
    return next((k for k in keys if k), "message_" + hashlib.sha1(text.encode()).hexdigest()[:8])


LINES = {
    0: "Café crème brûlée\nZweite Zeile über Größe\n\nEl niño pequeño", 1: "plain ASCII line\n保存 {{ n }}\nfi\ufb01x", 2: "no label éà\nÉcole d'été ${x}",
    10: "Übersicht\nthird's camelCase_x $y_", 11: "", 22: "你好\nname ñ",
}


@pytest.fixture
def lined(spark, tmp_path):
    spark.createDataFrame([(d, t, f"s{d % 2}") for d, t in LINES.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (10, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_keys_of_all_lines(spark, lined):
    want = set()
    for d, t in LINES.items():
        for i, line in enumerate(t.split("\n")):
            translation = "" if (d + i) % 11 == 0 else "t " + line.split(" ")[0]
            want.add((f"src/s{d % 2}/{d}.vue", i, key_of(line, translation), hashlib.sha1(line.encode()).hexdigest()[:8]))
    rows = W.key_generation(spark, lined).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_entries_of_all_lines(spark, lined):
    every = [line for t in LINES.values() for line in t.split("\n")]
    assert bundle.locale_fill(spark, lined).count() == len(every)
    assert W.key_uniqueness(spark, lined).count() == sum((d + i) % 13 > 0 for d, t in LINES.items() for i, _ in enumerate(t.split("\n")))
    assert {r.text for r in W.translate_texts(spark, lined).collect()} == {re.sub(T.PLACEHOLDER, "__TM_0__", x) for x in every}


RUNS = [(1, "Hello 你好 world"), (2, "123 abc"), (3, "ひらがなと漢字"), (4, "привет, 世界!"), (5, "國家 and 国家"), (6, "..."), (7, "école"), (8, ""), (9, None), (10, "a😀b\u00a0ж\u000b한")]


def by_character(spark, texts):
    """Runs of texts, from the class of each character that Spark gives."""
    every = sorted({c for _, t in texts for c in t or ""})
    kinds = dict(map(tuple, spark.createDataFrame([(c,) for c in every], "c string").select("c", R.char_class(F.col("c"))).collect()))
    out = set()
    for k, t in texts:
        langs = [kinds[c] for c in t or ""]
        named = [x for x in langs if x not in R.CONNECTOR]
        last, runs = named[0] if named else "", []
        for c, x in zip(t or "", langs):
            last = last if x in R.CONNECTOR else x
            if runs and runs[-1][0] == last:
                runs[-1][1].append(c)
            else:
                runs.append((last, [c]))
        out |= {(k, i, lang, "".join(cs)) for i, (lang, cs) in enumerate(runs, 1)}
    return out


def test_runs_of_fixtures_and_documents(spark):
    assert {tuple(r) for r in R.language_runs(spark.createDataFrame(RUNS, "id int, text string")).collect()} == by_character(spark, RUNS)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in W.language_runs(spark, SF).collect()} == by_character(spark, docs)
    assert bundle.run_spacing(spark, SF).count() == W.language_runs(spark, SF).count()
    assert {r.id: r.chars for r in bundle.recognize_documents(spark, SF).collect()} == {k: len(t) for k, t in docs}


def test_whole_texts_of_conversations_and_documents(spark):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in W.turn_similarity(spark, SF).collect():
        a, b = turns[r.conv_id, r.turn], turns[min(k for k in turns if k[0] == r.conv_id and k[1] > r.turn)]
        assert abs(r.similarity - 2 * table_lcs(a, b) / (len(a) + len(b))) < 1e-8 and r.fuzzy == (r.similarity >= 0.8)
    assert W.glossary_turns(spark, SF).count() == len(turns)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {(r.doc_id, r.holes, r.same) for r in W.protect_documents(spark, SF).collect()} == {(d.doc_id, len(re.findall(T.PLACEHOLDER, d.text)), True) for d in docs}
    assert W.glossary_match_lines(spark, SF).count() == W.S.lines(spark.createDataFrame(docs), F.col("doc_id").cast("string")).count()
