import random

import numpy as np

from lingora.llm import components, jaccard
from tests.llm.util import ODD, SF, WORD, docs_frame, sf_rows


def shingle_set(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    late = lambda d: 2**63 if d is None else d
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    near = {(i, j) for x in index.values() for i in x for j in x if i < j}
    for i, j in near:
        both = len(sets[i] & sets[j])
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 2**64), late(d))
    return sorted(((d, len(sets[i]), None if least[root(i)] == 2**63 else least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    want = brute(sf_rows(spark))
    assert got(jaccard.op2_ngram_jaccard(spark, SF)) == want
    assert sum(d != c for d, _, c in want) > 3


def test_chains_edges_of_the_threshold_and_odd_rows(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows, at = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 9)):  # a random walk of edits, so that ends of a chain are unlike
            if rng.random() < 0.8:
                for _ in range(rng.randint(0, max(1, len(base) // 25))):
                    k = rng.randrange(len(base))
                    base[k : k + 1] = rng.choice([[], [word()], [base[k], word()]])
            rows.append((at, " ".join(base) if rng.random() < 0.8 else " ".join(base).upper()))
            at += 1
    hub = [word() for _ in range(150)]
    for _ in range(14):  # like the hub, unlike each other
        copy = list(hub)
        for k in rng.sample(range(150), 4):
            copy[k] = word()
        rows.append((at, " ".join(copy)))
        at += 1
    rows.append((at, " ".join(hub)))
    rng.shuffle(rows)
    rows += rows[:5] + ODD + [(990, "Two WORDS"), (991, "two words"), (992, "two words more"), (3, "two words")]
    docs = docs_frame(spark, rows).selectExpr("*", "1 as n", "2 as cid", "3 as tag", "4 as label")
    assert got(jaccard.similar(docs)) == brute(rows)
    assert jaccard.similar(docs.where("false")).count() == 0


def excerpts_and_copies(seed, words=104, shared=94, size=14, copies=2):
    """Copies of a passage with ends of their own, and excerpts that tile it, which sort first in every group."""
    rng = random.Random(seed)
    passage = [f"p{seed}x{rng.randrange(10**6)}" for _ in range(shared)]
    rows = [" ".join(passage + [f"e{seed}x{k}x{i}" for i in range(words - shared)]) for k in range(copies)]
    at = list(range(0, shared - size + 1, size - 4)) + [shared - size]
    return rows, [" ".join(passage[i : i + size]) for i in at]


def test_excerpts_that_lead_every_group_hide_no_link(spark):
    copies, parts = excerpts_and_copies(1)
    rows = list(enumerate([*copies, *parts], 1))
    assert got(jaccard.similar(docs_frame(spark, rows))) == brute(rows)
    assert [c for d, _, c in brute(rows) if d == 2] == [1]
    y = [f"y{i}" for i in range(12)]
    rows = list(enumerate([" ".join(x) for x in (y, [*y[:11], "z"], y[:9], y[2:11])], 1))
    assert got(jaccard.similar(docs_frame(spark, rows))) == brute(rows)


def test_random_excerpts_and_near_copies(spark):
    rng, texts = random.Random(12), []
    for seed in range(2, 9):
        copies, parts = excerpts_and_copies(seed, rng.randint(60, 130), rng.randint(50, 60), rng.randint(6, 30), rng.randint(2, 5))
        texts += copies + rng.sample(parts, rng.randint(0, len(parts)))
    rng.shuffle(texts)
    assert got(jaccard.similar(docs_frame(spark, list(enumerate(texts))))) == brute(list(enumerate(texts)))


def test_groups_of_many_blocks(spark, monkeypatch):
    """Near copies, and texts that share passages without a link, in groups far larger than a block."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    monkeypatch.setattr(jaccard, "PARTNERS", 3)
    monkeypatch.setattr(jaccard, "AT_ONCE", 20)
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base = [word() for _ in range(90)]
    texts = []
    for _ in range(30):
        copy = list(base)
        copy[rng.randrange(90)] = word()
        texts.append(copy)
    passages = [[word() for _ in range(30)] for _ in range(6)]
    for _ in range(30):
        three = rng.sample(range(6), 3)
        texts.append([w for k in three for w in passages[k]] + [word() for _ in range(rng.randint(0, 30))])
    rows, seen = list(enumerate(map(" ".join, texts))), []
    across = jaccard.block_candidates
    monkeypatch.setattr(jaccard, "block_candidates", lambda members, turn: seen.append(members.count()) or across(members, turn))
    want = brute(rows)
    assert got(jaccard.similar(docs_frame(spark, rows))) == want and len({c for _, _, c in want}) > 5
    assert seen and min(seen) > 0


def test_rounds_compare_all_pairs_that_matter():
    for size in (2, 3, 7, 20, 60, 200):
        cid = np.arange(size)
        seen = set()
        turn = 1
        while True:
            found, more = jaccard._ranked_pairs(np.zeros(size, np.uint64), cid, np.full(size, 9), np.full(size, 9), cid, turn)
            seen |= set(zip(found[0].tolist(), found[1].tolist()))
            turn += 1
            if not more:
                break
        assert len(seen) == size * (size - 1) // 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 120)] + [(7, 7), (300, 200)]
    out = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert components.components(spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a long, b long")).collect() == []
    assert all(out[i] == 0 for i in range(21)) and all(out[k] == 100 for k in range(100, 120)) and out[300] == out[200] == 200


def test_estimates_do_not_grow_with_the_rounds(spark, monkeypatch):
    """A chain takes many passes; the estimated size of what each leaves is one number of a fixed length."""
    seen, durable = [], components.durable

    def noted(df, small=False):
        out = durable(df, small)
        seen.append(int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length())
        return out

    monkeypatch.setattr(components, "durable", noted)
    order = list(range(40))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.label for r in components.components(edges).collect()} == {0}
    assert len(seen) > 4 and max(seen) <= 64
