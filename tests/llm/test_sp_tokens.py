import os
import random

import numpy as np
import pytest
import sentencepiece as sp

from tabsight.llm.sp_tokens import PieceModel, Tokenizer, decoder, round_trip, tokenize

PATH = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="public model not present")


@pytest.fixture(scope="module")
def blob():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(blob):
    return sp.SentencePieceProcessor(model_proto=blob)


@pytest.fixture(scope="module")
def tokenizer(blob):
    return Tokenizer(PieceModel(blob))


def texts(n=1500):
    rng = random.Random(5)
    letters = "ab th e  in\n▁\t é漢字ーゼ😀0123,.aaaa" "eiou rstln"
    out = ["", " ", "  ", "\n", "a ", " a", "x    y     ", "▁▁a", "aaaaaaaaaaaaaaaaaaaaaaaa", " " * 70, "é́", "\x00\x7f", "z" * 3000, "Hello, world!", "0" * 200]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_ids_equal_the_librarys(tokenizer, library):
    t = texts()
    assert [x.tolist() for x in tokenizer.encode(t)] == library.encode(t)


def test_decoding_equals_the_librarys_and_restores_texts(tokenizer, library):
    t = texts()
    ids = tokenizer.encode(t)
    back = tokenizer.decode(ids)
    assert back == library.decode([x.tolist() for x in ids])
    assert all(a == b for a, b in zip(back, t) if "▁" not in b)


def test_remembered_words_and_small_runs(blob, library, monkeypatch):
    import tabsight.llm.sp_tokens as m
    monkeypatch.setattr(m, "RUN", 20)
    monkeypatch.setattr(m, "REMEMBER", 30)
    t = texts(200)
    tok = Tokenizer(PieceModel(blob))
    assert [x.tolist() for x in tok.encode(t)] == library.encode(t)


def best_sum(model, word):
    """The largest score sum by plain dynamic programming over pieces."""
    best = [0.0] + [-1e30] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(max(0, i - 16), i):
            s = model.get(word[j:i], -1e6 if i - j == 1 else None)
            if s is not None:
                best[i] = max(best[i], best[j] + s)
    return best[-1]


def test_unigram_models_take_the_largest_sum(blob):
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(blob)
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = -3.0 + p.score / 2000.0 if p.score > -1e8 else -30.0
    model = PieceModel(m.SerializeToString())
    score = {p.piece: p.score for p in m.pieces if p.type == 1}
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    piece = [p.piece for p in m.pieces]
    for w, ids in zip(words, model.encode_words(words)):
        assert "".join(piece[i] for i in ids) == w
        assert sum(score[piece[i]] for i in ids) == pytest.approx(best_sum(score, w), abs=1e-6)


def test_columns_and_edge_rows(spark, make_docs, library):
    docs = make_docs([(1, None), (2, ""), (None, "some text here"), (4, "same"), (4, "same"), (6, "long " * 30000)])
    out = tokenize(docs, PATH)
    assert out.columns == docs.columns + ["ids", "n_tokens"]
    rows = out.withColumn("back", decoder(spark, PATH)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids) and r.back == (r.text or "")
    assert all(r.exact for r in round_trip(docs, PATH).collect())
    assert tokenize(make_docs([]), PATH).collect() == []


def test_other_models_are_refused(blob):
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(blob)
    m.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError):
        PieceModel(m.SerializeToString())
    assert np.array_equal(PieceModel(blob).whole.all(), True)
