import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
import public_tokenizers as P  # noqa: E402

from lingora.llm import piece_bpe  # noqa: E402
from tests.llm.util import ODD, SF, docs_frame, sf_rows, sha  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return piece_bpe.Encoder(open(PATH, "rb").read())


def want(rows):
    out = []
    for d, t in rows:
        ids = LIBRARY.encode(t or "")
        out.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(LIBRARY.decode(ids).encode())))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_query_equals_the_library(spark):
    assert got(piece_bpe.op11_piece_bpe(spark, SF)) == want(sf_rows(spark))


def test_odd_texts(spark):
    rows = ODD + [(1, "two  spaces\n\n\ttab <s> <0x41> ▁ \u2581x 𝒳🙂 nul\0nul"), (1, " lead and trail  "), (2, "ab" * 30000), (2, " " * 5001 + "x"), (3, "漢字" * 4000), (4, "\n"), (4, "\n")]
    assert got(piece_bpe.digest(docs_frame(spark, rows), PATH)) == want(rows)
    full = piece_bpe.encode(docs_frame(spark, rows).selectExpr("*", "1 as ids", "2 as raw", "3 as n_tokens"), PATH).collect()
    assert all(LIBRARY.decode(r.ids) == r.decoded and len(r.ids) == r.n_tokens for r in full)
    assert sorted((r.doc_id or -1, r.decoded) for r in full) == sorted((d or -1, (t or "").replace("▁", " ")) for d, t in rows)
    assert piece_bpe.digest(docs_frame(spark, rows).where("false"), PATH).collect() == []


def test_random_texts_and_ids(encoder):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices("  ▁ab\n\t\0é漢𝒳🙂.,01 the in er", k=rng.randint(1, 50)))
        ids = encoder.encode(text)
        assert ids == LIBRARY.encode(text), text
        assert encoder.decode(ids).decode() == LIBRARY.decode(ids)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(1, 8))]
        assert encoder.decode(ids).decode() == LIBRARY.decode(ids), ids


def test_each_prefix_has_the_last_piece_of_its_own_encoding(encoder):
    text = "▁internationalization▁▁▁ofthewhole,kelorinñandú"
    for end, piece in enumerate(encoder.last_pieces(text)[1:], 1):
        parts = encoder.merged(text[:end])[0]
        assert parts[-1] == (encoder.texts[piece] if piece >= 0 else text[end - 1])


def test_compatible_pairs_are_those_that_merging_gives_back(encoder):
    rng = random.Random(7)
    normal = [i for i, kind in enumerate(encoder.kinds) if kind == piece_bpe.NORMAL]
    spaces = [i for i in normal if not encoder.texts[i].strip("▁")]
    for _ in range(6000):
        a, b = rng.choice(rng.choice([normal, spaces])), rng.choice(rng.choice([normal[:400], normal, spaces]))
        if encoder.merged(encoder.texts[a])[0] == [encoder.texts[a]] and encoder.merged(encoder.texts[b])[0] == [encoder.texts[b]]:
            assert encoder.compatible(a, b) == (encoder.merged(encoder.texts[a] + encoder.texts[b])[0] == [encoder.texts[a], encoder.texts[b]])


def test_memory_is_bounded(encoder):
    small = piece_bpe.Encoder(open(PATH, "rb").read())
    small.BOUND = small.PAIRS = 20
    text = " ".join(f"word{i}" for i in range(200))
    assert small.encode(text) == LIBRARY.encode(text) and len(small) <= 21 and len(small.pairs) <= 20


def test_other_models_are_refused():
    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    with pytest.raises(ValueError):
        piece_bpe.read_model(field(1, field(1, b"a")) + field(2, bytes([3 << 3, 1])))
