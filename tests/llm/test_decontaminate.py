import pickle
import random

from lingora.llm import decontaminate as D
from tests.llm.util import ODD, SF, docs_frame, sf_rows


def distance(part, text):
    """Least edits between the part and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(part, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(items, docs):
    out = []
    for t in docs:
        leaked, n = set(), 0
        for i, x in items:
            starts = [0] if len(x) <= D.PART else [*range(0, len(x) - D.PART, D.STRIDE), len(x) - D.PART]
            parts = [x[s : s + D.PART] for s in starts] + ([x] if D.PART < len(x) <= D.WHOLE else [])
            for part in filter(None, parts):
                if distance(part, t) <= D.budget(len(part)) if len(part) >= D.Q else b" %b " % part in b" %b " % t:
                    leaked.add(i)
                    n += 1
        out.append((sorted(leaked), n))
    return out


def parts(items):
    return [(i, p) for i, x in items for p in D.cut(x)]


def test_filter_and_alignment_equal_full_comparison():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(n)).encode()) for i, n in enumerate((8, 12, 20, 26, 9, 3, 1, 48))]

    def edited(t, k):
        t = list(t)
        for _ in range(k if len(t) > 12 else 0):
            at = rng.randrange(len(t))
            kind = rng.randrange(3)
            t[at : at + 1] = [] if kind == 0 else [rng.choice(b"abcdef")] if kind == 1 else [t[at], rng.choice(b"abcdef")]
        return bytes(t)

    docs = [b"", b"a b"]
    for _ in range(40):
        body = [" ".join(word() for _ in range(rng.randint(0, 10))).encode()]
        for i, x in rng.sample(items, rng.randint(0, 2)):
            a = rng.randint(0, len(x) // 3)
            body += [edited(x[a:], rng.randint(0, 9)), b" "]
        docs.append(b" ".join(body))
    got = [(sorted(map(int, ids)), n) for ids, n in D.leaks(D.index(parts(items)), docs)]
    want = brute(items, docs)
    assert got == want and 5 < sum(n > 0 for _, n in want) < len(docs)


def test_query_finds_the_items_that_texts_contain(spark):
    items = [(r.item_id, D.normal(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in D.op4_decontaminate(spark, SF).collect()}
    texts = sf_rows(spark)
    assert len(rows) == len(texts)
    for d, t in texts:
        whole = {i for i, x in items if x in D.normal((t or "").encode())}
        assert whole <= set(rows[d].item_ids) and rows[d].leaked == bool(rows[d].item_ids)
    assert sum(r.leaked for r in rows.values()) < 0.2 * len(rows)


def test_edits_that_stand_together_are_weighed_against_the_whole_item():
    item = D.normal(b"the quick brown fox jumps over the lazy dog while seven wizards quietly box the jumping quartz of a distant vow")
    text = item.replace(b"wizards", b"wombats")
    assert len(item) <= D.WHOLE and D.leaks(D.index([(1, item)]), [b"so " + text + b" it is"])[0][1] == 1


def test_query_equals_full_comparison_on_short_documents(spark):
    items = [(r.item_id, D.normal(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: (sorted(r.item_ids), r.n_regions) for r in D.op4_decontaminate(spark, SF).collect()}
    short = [(d, D.normal((t or "").encode())) for d, t in sf_rows(spark)]
    short = sorted(short, key=lambda x: len(x[1]))[:12]
    assert [rows[d] for d, _ in short] == brute(items, [t for _, t in short])


def test_memory_of_a_pass_does_not_grow_with_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 20_000)
    sizes = {}
    for n in (100, 800):
        bench = spark.range(n).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(1, 25), i -> md5(concat(id, '-', i)))) AS text")
        made = list(D.blocks(bench))
        sizes[n] = len(made), max(len(pickle.dumps(x)) - len(x.maybe) for x in made)
    assert sizes[800][0] >= 6 * sizes[100][0] and sizes[800][1] < 1.3 * sizes[100][1]


def test_odd_texts_blocks_and_clean(spark, monkeypatch):
    item = "What is the answer to the ultimate question of life, the universe and everything? It is known to be 42."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "another benchmark item of some forty chars"), (5, "short"), (6, " .. ")], "item_id long, text string")
    rows = [*ODD, (1, f"so: {item.upper()}!"), (1, f"so: {item.upper()}!"), (2, "what is\n\nthe answer; to the ultimate question of life the universe and everythin"), (3, "ANOTHER benchmark, item of some forty chars"), (4, "so: SHORT!"), (5, "shorts")]
    docs = docs_frame(spark, rows).selectExpr("*", "true as leaked", "1 as raw")
    for size in (D.BLOCK, 10):
        monkeypatch.setattr(D, "BLOCK", size)
        got = sorted((r.doc_id, r.item_ids) for r in D.judge(docs, bench).collect() if r.leaked)
        assert got == [(1, [1]), (1, [1]), (2, [1]), (3, [-1]), (4, [5])]
        kept = D.clean(docs, bench)
        assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in [*ODD, (5, "")])
    assert D.judge(docs.where("false"), bench).count() == 0 and D.judge(docs, bench.where("false")).where("leaked").count() == 0
    assert D.clean(docs, bench.where("false")).count() == len(rows)
