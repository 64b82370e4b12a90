import random

from lingora.llm import suffix_dedup
from tests.llm.util import ODD, SF, docs_frame, sf_rows, sha


def brute(rows, width):
    late = lambda d: 2**63 if d is None else d
    texts = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - width + 1):
            k, here = t[i : i + width], (late(d), i)
            if k not in least or here < least[k]:
                least[k] = here
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if least[t[i : i + width]] < (late(d), i):
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), sha(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    assert got(suffix_dedup.op7_suffix_dedup(spark, SF)) == brute(sf_rows(spark), 100)


def test_shards_of_the_query_exceed_the_memory_limit(spark):
    """At production parameters, what a partition of one megabyte of text sorts is on disk in part."""
    spilled = spark.sparkContext.accumulator(0)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert suffix_dedup.repeated_bytes(docs, spilled=spilled).agg({"n_removed": "sum"}).first()[0] > 0 and spilled.value > 1 << 20


def test_odd_texts_periods_and_repeated_rows(spark):
    rng = random.Random(6)
    pieces = ["".join(rng.choices("ab\0é", k=rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 8)))) for i in range(60)]
    rows += rows[:6] + ODD + [(3, "ab" * 200), (3, rows[8][1]), (70, "ab" * 150), (71, "a" * 500)]
    docs = docs_frame(spark, [(d, (t or "").replace("\0", "\x01") if t else t) for d, t in rows])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = docs.selectExpr("*", "1 as doc", "2 as tag", "3 as raw", "4 as marks")
    assert got(suffix_dedup.repeated_bytes(docs, 24, 8)) == brute(rows, 24)
    assert got(suffix_dedup.repeated_bytes(docs, 16, 16, memory=64)) == brute(rows, 16)
    assert suffix_dedup.repeated_bytes(docs.where("false")).count() == 0
