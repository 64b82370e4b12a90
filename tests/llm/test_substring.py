import random

import numpy as np

from lingora.llm import packed, substring
from tests.llm.util import ODD, SF, WORD, docs_frame, sf_rows, sha


def brute(rows, width):
    late = lambda d: 2**63 if d is None else d
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, 2**64), late(d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < late(d):
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), sha(" ".join(kept).encode())))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    assert got(substring.op8_substring_dedup(spark, SF)) == brute(sf_rows(spark), 13)


def test_odd_texts_repeated_rows_and_few_words(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += rows[:7] + ODD + [(3, "a b c d a b c d a b c d"), (3, None)]
    for width, start in ((5, None), (6, 2), (4, 4), (1, 1)):
        assert got(substring.repeated_words(docs_frame(spark, rows), width, start)) == brute(rows, width)


def test_codes_alone_decide_nothing():
    code, doc = np.array([5, 5, 5, 9], np.uint64), np.array([3, 1, 2, 1])
    zero, check = np.zeros(4, np.uint32), np.array([7, 8, 7, 7], np.uint32)
    sent, d, _, _, sure, k = substring._reduced(code, doc, zero, zero.astype(np.int64), False, check)
    assert sorted(zip(sent.tolist(), d.tolist(), k.tolist())) == [(5, 1, 8), (5, 2, 7), (9, 1, 7)] and sure[0].tolist() == [3]
    assert packed.told_apart(code, check).tolist() == [0, 1, 0, 2]


def test_later_levels_are_left_out_when_nothing_repeats(spark, monkeypatch):
    levels, exchange = [], packed.exchange
    monkeypatch.setattr(packed, "exchange", lambda *a: levels.append(1) or exchange(*a))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(9)]
    assert got(substring.repeated_words(docs_frame(spark, rows), 40, 5)) == brute(rows, 40) and len(levels) == 1


def test_empty_table_and_extra_columns(spark):
    empty = docs_frame(spark, [(1, "x")]).where("false")
    assert substring.repeated_words(empty).collect() == []
    extra = docs_frame(spark, [(1, "a b c d e"), (2, "z a b c d e")]).selectExpr("*", "1 as doc", "2 as tag", "3 as marks", "4 as raw")
    assert [(r.doc_id, r.n_removed) for r in substring.repeated_words(extra, 5).orderBy("doc_id").collect()] == [(1, 0), (2, 5)]


def test_levels_double_up_to_the_width():
    assert substring.levels(13) == [7, 13] and substring.levels(50, 4) == [4, 8, 16, 32, 50] and substring.levels(3, 9) == [3]
