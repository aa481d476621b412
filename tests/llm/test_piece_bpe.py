import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossloom.llm import piece_bpe

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.model(path)


def test_odd_texts(both):
    theirs, own = both
    r = random.Random(5)
    letters = "abcdefghijklmnop       \n\t▁é日本🙂①\x00<>s/0123456789.,'ing the of"
    texts = ["", " ", "   ", "<s>", "<unk>", "a" * 300, "aab" * 3000, " " * 500 + "the", "́a", "é"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + [" " * k + "the" for k in range(60)]
    for t in texts:
        ids = theirs.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == theirs.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    text = text.encode("utf-8", "ignore").decode()
    theirs, own = both
    assert own.encode(text) == theirs.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_any_ids(both, ids):
    theirs, own = both
    assert own.decode(ids) == theirs.decode(ids)


def test_tables(both, odd_docs, none):
    theirs, _ = both
    path = tokenizers.path("piece_bpe_32k.model")
    out = piece_bpe.decode(piece_bpe.encode(odd_docs, path), path).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert r.ids == theirs.encode(r.text or "") and r.decoded == theirs.decode(r.ids)
    assert piece_bpe.digests(none, path).count() == 0


def test_memo_is_bounded(both, monkeypatch):
    theirs, _ = both
    monkeypatch.setattr(piece_bpe, "MEMO_WORDS", 5)
    own = piece_bpe.PieceModel(tokenizers.path("piece_bpe_32k.model"))
    for k in range(200):
        t = f"word{k} and other{k % 7}"
        assert own.digest(t)[0] == len(theirs.encode(t)) and own.encode(t) == theirs.encode(t)
    assert len(own.memo_text) <= 6
