import random
import re

import pytest
from pyspark.sql import functions as F

from lingora.operators import terms as W

GLOSSARY = "ord int, key string, value string"
LETTER = re.compile("[A-Za-z0-9]")


def plural(term):
    if not re.fullmatch(r"[a-z][a-z\s-]*", term, re.I) or not (last := re.search("[a-z]+$", term, re.I)):
        return None
    w = last[0]
    return term[: -len(w)] + (w[:-1] + "ies" if w.endswith("y") else w + ("es" if re.search("([sxz]|ch|sh)$", w, re.I) else "s"))


def length(text, at, term):
    for v in sorted({term, plural(term) or term}, key=len, reverse=True):
        edge = lambda i: not 0 <= i < len(text) or not LETTER.match(text[i])
        if text[at : at + len(v)].lower() == v.lower() and edge(at - 1) and edge(at + len(v)):
            return len(v)
    return 0


def places(text, terms):
    out = []
    for ord_, key, value in terms:
        if key and not key.endswith("*") and not re.fullmatch("[㐀-䶿一-鿿豈-﫿]", key):
            for v in {key, plural(key) or key}:
                for at in range(len(text)):
                    edge = lambda i: not 0 <= i < len(text) or not LETTER.match(text[i])
                    if text[at : at + len(v)].lower() == v.lower() and edge(at - 1) and edge(at + len(v)):
                        out.append((at, at + len(v), -len(key), ord_, value))
    return sorted(out, key=lambda p: (p[0], p[2], p[3], -p[1]))


def compose(text, terms):
    keep = sorted([t for t in terms if t[1] and not t[1].endswith("*") and not re.fullmatch("[㐀-䶿一-鿿豈-﫿]", t[1])], key=lambda t: -len(t[1]))
    text, at, out = text.strip(), 0, ""
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        piece, size = None, 0
        if m := re.compile(r"\{\{[\s\S]*?\}\}|\$\{[\s\S]*?\}").match(text, at) or re.compile(r"[,.;:!?()\[\]{}\"'`-]+").match(text, at):
            piece, size = m[0], len(m[0])
        else:
            for _, key, value in keep:
                if size := length(text, at, key):
                    piece = value
                    break
            else:
                word = re.match("[a-z]+", text[at:], re.I)
                if not word or word[0].lower() not in W.dims.DROPPED:
                    return None
                size = len(word[0])
        at += size
        if piece is not None:
            out += piece if not out or re.fullmatch(r"[,.;:!?()\[\]{}\"'`-]+", piece) or re.search(W._CJK, out) or re.search(W._CJK, piece) else f" {piece}"
    return out


def sample(rng):
    words = ["order", "orders", "box", "Boxes", "user name", "user", "name", "category", "Categories", "单", "订单", "é", "the", "of", "a-b", "x1", "  ", "\n", "{{ n }}", ",", "İ", "now"]
    return "".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12)))


TERMS = [(0, "order", "A"), (1, "user name", "B"), (2, "user", "C"), (3, "name", "订"), (4, "category", "E"), (5, "box", "F"), (6, "单", "G"), (7, "订单", "H"), (8, "order/*", "I"), (9, "Order", "J"), (10, "é", "K"), (11, "a-b", "L"), (12, "name orders box", "M"), (13, "", "N"), (14, "x1", "O")]


@pytest.mark.parametrize("bound", [W.CHARACTERS, 3])
def test_places_and_compositions_equal_plain_search(spark, monkeypatch, bound):
    monkeypatch.setattr(W, "CHARACTERS", bound)
    rng = random.Random(4)
    texts = [sample(rng) for _ in range(150)] + ["", "the user name, orders!", "order " * 700 + "box"]
    frame = spark.createDataFrame([*enumerate(texts), (999, None)], "key long, text string").withColumn("other", F.lit(1)).repartition(3)
    got = {r.key: r for r in W.occurrences(frame, spark.createDataFrame(TERMS, GLOSSARY)).withColumn("composed", W.composed("text", "found")).collect()}
    assert got[999].found is None and got[999].composed is None and len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        assert [tuple(p) for p in got[i].found] == places(text, TERMS), text
        assert got[i].composed == compose(text, TERMS), text


def test_lanes_do_not_change_places(monkeypatch):
    rng = random.Random(6)
    words = list({"".join(rng.choices("ab ", k=rng.randint(1, 9))) for _ in range(30)})
    texts = ["".join(rng.choices("ab ", k=rng.randint(0, 90))) for _ in range(60)]
    want = [x.tolist() for x in W.automaton(words).places(texts)]
    for lane, lanes in ((1, 7), (5, 3), (64, 1000)):
        monkeypatch.setattr(W, "LANE", lane)
        monkeypatch.setattr(W, "LANES", lanes)
        assert [x.tolist() for x in W.automaton(words).places(texts)] == want
    assert [x.tolist() for x in W.automaton([]).places(["abc", ""])] == [[], [], [], []]


def test_enforcement(spark):
    rows = [(1, "cancel the order", "取消命令"), (2, "orders", "顺序列表"), (3, "border", "命令"), (4, "order", "订单命令"), (5, None, "命令")]
    frame = spark.createDataFrame(rows, "key int, text string, translation string")
    got = {r.key: r.e for r in W.occurrences(frame, spark.createDataFrame([(0, "cancel", "取消"), (1, "order", "订单")], GLOSSARY)).select("key", W.enforced(F.col("translation"), F.col("found")).alias("e")).collect()}
    assert got == {1: "取消订单", 2: "订单列表", 3: "命令", 4: "订单命令", 5: "命令"}


def slow_replace(text, key, value):
    places = [i for i in range(len(text)) if key and text.startswith(key, i)]
    if not places:
        return text, [text]
    rest, result, last = [], text, len(text)
    for p in reversed(places):
        a, b = p + len(key), last
        rest.insert(0, text[min(a, b) : max(a, b)])
        result = result[:p] + value + result[p + len(key) :]
        last = p
    rest.insert(0, text[:last])
    return result, [x for x in rest if x]


def test_replacement_takes_overlaps_from_the_right(spark):
    assert W._replaced("你好我好她也好", "好", "hao") == ("你hao我hao她也hao", ["你", "我", "她也"])
    rng = random.Random(8)
    for _ in range(2000):
        text, key, value = ("".join(rng.choices("ab", k=rng.randint(0, n))) for n in (12, 4, 3))
        assert W._replaced(text, key, value) == slow_replace(text, key, value)
    frame = spark.createDataFrame([("你好吗我好", [("好", "x"), ("我", "y")]), ("aaa", [("aa", "b")]), (None, [("a", "b")]), ("same", [])], "text string, terms array<struct<key:string,value:string>>")
    got = [(r.result, r.rest) for r in W.replaced(frame).collect()]
    assert got == [("你x吗yx", ["你", "吗"]), slow_replace("aaa", "aa", "b"), (None, None), ("same", ["same"])]


def test_pieces_of_batches_are_bounded_by_their_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(W, "PIECE", 10)
    texts = ["abc", None, "defg", "x" * 25, "", "é" * 5, "y", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["key", "text"])
    pieces = [p.column(1).to_pylist() for p in W._pieces([batch, batch.slice(0, 0)], 1)]
    assert pieces == [["abc", None, "defg"], ["x" * 25], ["", "é" * 5], ["y", "z"]]


def test_leftovers_of_empty_and_null_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from lingora.plans import workflow

    texts = ["", None, "the", "theund", "und the end", " ", "unthed"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = duck.execute(f"SELECT doc_id, parts, rest_sha256 FROM ({workflow.ORACLES['nomenclature_leftovers']}) ORDER BY doc_id").fetchall()
    given = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            got = [tuple(r) for r in workflow.QUERIES["nomenclature_leftovers"](spark, str(tmp_path)).orderBy("doc_id").collect()]
            assert got == want
    finally:
        spark.conf.set("spark.sql.ansi.enabled", given)
    assert [r[1] for r in want] == [0, None, 0, 0, 2, 1, 2]


def searched(text, terms):
    low, out = W.folded(text), []
    for ord_, key, value in terms:
        for v in {key, plural(key) or key}:
            for m in re.finditer(re.escape(v.lower()), low):
                if not any(0 <= i < len(low) and re.match("[a-z0-9]", low[i]) for i in (m.start() - 1, m.end())):
                    out.append((m.start(), m.end(), -len(key), ord_, value))
    return sorted(out, key=lambda p: (p[0], p[2], p[3], -p[1]))


@pytest.mark.parametrize("bound", [W.CHARACTERS, 3])
def test_places_apart_are_those_of_a_search_from_left_to_right(spark, monkeypatch, bound):
    monkeypatch.setattr(W, "CHARACTERS", bound)
    rng = random.Random(9)
    terms = [(0, "as a", "A"), (1, "a-a", "B"), (2, "aa", "C"), (3, "was", "D"), (4, "é é", "E")]
    texts = ["Was as a", "as as as", "As a as a", "a-a-a-a", "", *("".join(rng.choices(["as", "a", "w", "é", " ", " ", "-", "As a "], k=rng.randint(0, 25))) for _ in range(200))]
    frame = spark.createDataFrame([*enumerate(texts), (999, None)], "key long, text string").repartition(3)
    glossary = spark.createDataFrame(terms, GLOSSARY)
    got, whole = ({r.key: r.found and [tuple(p) for p in r.found] for r in W.occurrences(frame, glossary, apart).collect()} for apart in (True, False))
    assert got.pop(999) is None and got == {i: searched(t, terms) for i, t in enumerate(texts)}
    assert whole.pop(999) is None and whole == {i: places(t, terms) for i, t in enumerate(texts)}
    assert got[0] == [(0, 3, -3, 3, "D")] and len(got[1]) == 1 and len(whole[1]) == 2


def test_places_of_terms_that_overlap_themselves_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from lingora.plans import workflow

    texts = ["Was as a", "As as as as", "x as a as a", "theİ the", "ΑΣ ΒΣ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "As a rule"), (1, "the the"), (2, "ΑΣ ΒΣ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = "doc_id, term, n, first_start, last_end, starts"
    with duckdb.connect() as duck:
        for t in ("documents", "benchmark"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = duck.execute(f"SELECT {columns} FROM ({workflow.ORACLES['term_places']})").fetchall()
    got = [tuple(r) for r in workflow.QUERIES["term_places"](spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 6
