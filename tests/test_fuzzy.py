import random

import pytest

from lingora.functions.text import similarity
from lingora.operators import fuzzy

SCHEMA = "source_path string, text string, ord int"


def claimed(new, old):
    """One text after another, against all earlier ones."""
    used, out = set(), []
    for text, _ in sorted(new, key=lambda x: x[1]):
        best = (1.0, text) if text in [t for t, _ in old] else None
        if best is None and text is not None:
            for candidate, _ in sorted(old, key=lambda x: x[1]):
                score = similarity(text, candidate) if candidate is not None and candidate not in used else 0
                if score >= fuzzy.FUZZY and (best is None or score > best[0]):
                    best = (score, candidate)
        if best:
            used.add(best[1])
        out.append((text, best and best[1], best[0] if best else 0.0))
    return out


def check(spark, paths):
    new = [(p, t, o) for p, (a, _) in paths.items() for t, o in a]
    old = [(p, t, o) for p, (_, b) in paths.items() for t, o in b]
    got = fuzzy.merge_fuzzy(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(old, SCHEMA)).collect()
    want = [(p, *row) for p, (a, b) in paths.items() for row in claimed(a, b)]
    assert sorted(((r.source_path, r.text, r.previous_text, round(r.score, 12)) for r in got), key=repr) == sorted(((p, t, q, round(s, 12)) for p, t, q, s in want), key=repr)


def text(rng, alphabet, least=1, most=14):
    return "".join(rng.choices(alphabet, k=rng.randint(least, most)))


@pytest.mark.parametrize(("fold", "direct"), [(0, 0), (5, 300), (fuzzy.FOLD, 10_000)])
def test_random_texts_with_ties_equal_one_after_another(spark, monkeypatch, fold, direct):
    monkeypatch.setattr(fuzzy, "FOLD", fold)
    monkeypatch.setattr(fuzzy, "DIRECT", direct)
    rng = random.Random(11)
    paths = {}
    for p in range(6):
        alphabet = ["ab", "abc", "abcdefg", "请输入用户名字ab"][p % 4]
        old = list(dict.fromkeys(text(rng, alphabet) for _ in range(25)))
        new = [rng.choice(old) if rng.random() < 0.25 else text(rng, alphabet) for _ in range(25)]
        paths[f"p{p}"] = ([(t, o) for o, t in enumerate(new)], [(t, o) for o, t in enumerate(old)])
    check(spark, paths)


def test_a_chain_of_wishes_takes_rounds(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "FOLD", 0)
    old = [(f"the item number {i:02d} of the list", i) for i in range(12)]
    check(spark, {"p": ([(f"the item number {i:02d} of a list", 20 - i) for i in range(12)], old), "q": ([("the item number xx of the list", i) for i in range(6)], old)})


def test_odd_texts(spark):
    old = [("", 0), ("a", 1), ("ab", 2), (None, 3), ("é" * 40, 4), ("long " * 300, 5), ("axb", 6)]
    new = [("", 0), (None, 1), ("b", 2), ("aab", 3), ("ab", 4), ("é" * 39, 5), ("long " * 299, 6), ("long " * 300 + "!", 7), ("axb", 8)]
    check(spark, {"p": ([(t, o) for t, o in new], [(t, o) for t, o in old if t is not None])})
    nothing = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("p", "x", 0)], SCHEMA)
    assert fuzzy.merge_fuzzy(nothing, some).collect() == []
    assert [tuple(r) for r in fuzzy.merge_fuzzy(some, nothing).collect()] == [("p", "x", None, 0.0)]


def test_all_similar_pairs_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "DIRECT", 0)
    rng = random.Random(3)
    texts = [text(rng, rng.choice(["ab", "abcd", "abcdefghij"]), 1, 12) for _ in range(120)]
    new = spark.createDataFrame([("p", t, i) for i, t in enumerate(texts)], SCHEMA).selectExpr("source_path", "struct(cast(ord as long) as ord, 0L as hash) as who", "text")
    old = new.withColumnRenamed("who", "what")
    got = {(r.who.ord, r.what.ord) for r in fuzzy.similar_pairs(new, old).collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if similarity(a, b) >= fuzzy.FUZZY}


def test_one_path_of_many_texts_is_spread(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "FOLD", 500)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)]
    old = list(dict.fromkeys(" ".join(rng.choices(words, k=3)) for _ in range(3000)))
    new = [t[:5] + "#" + t[6:] if i % 3 else t for i, t in enumerate(old)]
    frame = lambda xs: spark.createDataFrame([("p", t, i) for i, t in enumerate(xs)], SCHEMA).repartition(4)
    got = {r.text: r.previous_text for r in fuzzy.merge_fuzzy(frame(new), frame(old)).collect()}
    assert all(got[n] == o for n, o in zip(new, old))


@pytest.mark.parametrize(("block", "most", "meetings", "fold"), [(7, 2, 1 << 30, 0), (64, 1, 1 << 30, 40), (0, 2, 0, 5), (0, 2, 1 << 30, 5), (64, 64, 1 << 30, fuzzy.FOLD)])
def test_lists_that_are_cut_and_blocks_equal_one_after_another(spark, monkeypatch, block, most, meetings, fold):
    for name, value in {"BLOCK": block, "LIST": most, "MEETINGS": meetings, "FOLD": fold, "DIRECT": 0}.items():
        monkeypatch.setattr(fuzzy, name, value)
    rng = random.Random(5)
    paths = {}
    for p, alphabet in enumerate(["ab", "abcdefg", "请输入用户名字ab"]):
        old = list(dict.fromkeys(text(rng, alphabet) for _ in range(25)))
        new = [rng.choice(old) if rng.random() < 0.25 else text(rng, alphabet) for _ in range(25)]
        paths[f"p{p}"] = ([(t, o) for o, t in enumerate(new)], [(t, o) for o, t in enumerate(old)])
    old = [f"the number {i:03d}" + " of all of them in this very long list of items that we keep" * (i % 3 == 0) for i in range(24)]
    paths["q"] = ([(t.replace("number", "nummer") if i % 4 else t, i) for i, t in enumerate(old + old[:9])], [(t, i) for i, t in enumerate(old)])
    check(spark, paths)


def test_names_all_alike_make_no_pairs_of_all(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "DIRECT", 0)
    listed, plain = [], fuzzy._lists
    monkeypatch.setattr(fuzzy, "_lists", lambda *a: listed.append(plain(*a)) or listed[-1])
    new = [(f"Customer#{i:09d}", i) for i in range(1, 400)]
    check(spark, {"p": (new, [(t, i) for t, i in new if i % 10 == 0])})
    assert sum(x.count() for x in listed) <= 3 * fuzzy.LIST * len(new)
