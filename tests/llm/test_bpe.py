import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402

from lingora.llm import bpe  # noqa: E402
from tests.llm.util import ODD, SF, docs_frame, sf_rows, sha  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def want(rows):
    out = []
    for d, t in rows:
        ids = OWN.encode_ordinary(t or "")
        out.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_query_equals_the_library(spark):
    assert got(bpe.op3_byte_bpe(spark, SF)) == want(sf_rows(spark))


def test_odd_texts(spark):
    rows = ODD + [(1, "don't   stop\n\n  <|endoftext|> 12345 ½ ñandú 🙂🙂"), (1, "don't"), (2, "aaab" * 5000), (3, " 　 ﻿x")]
    assert got(bpe.digest(docs_frame(spark, rows), PATH, P.PATTERN)) == want(rows)
    full = bpe.encode(docs_frame(spark, rows).selectExpr("*", "1 as ids", "2 as raw"), PATH, P.PATTERN).collect()
    assert all(OWN.decode_bytes(r.ids) == r.decoded and len(r.ids) == r.n_tokens for r in full)
    assert bpe.digest(docs_frame(spark, rows).where("false"), PATH, P.PATTERN).collect() == []


def test_merge_equals_plain_search_under_random_ranks():
    rng = random.Random(3)
    for _ in range(300):
        ranks = {bytes([b]): b for b in range(97, 101)}
        for k in range(40):
            ranks.setdefault(bytes(rng.choices(range(97, 101), k=rng.randint(2, 4))), 1000 + k)
        piece = bytes(rng.choices(range(97, 101), k=rng.randint(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while piece not in ranks:
            best = min(((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(10**9, 0))
            if best[0] == 10**9:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.merge(piece, ranks) == ((ranks[piece],) if piece in ranks else tuple(ranks[p] for p in parts))
