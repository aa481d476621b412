import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossloom.llm import bin_slack as b

import public_tokenizers  # isort: skip

FILE = public_tokenizers.path("word_bpe_49k.json")


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=5), st.integers(20, 30))
@settings(max_examples=200, deadline=None)
def test_the_fullest_combination(counts, capacity):
    took = b.fullest(counts, capacity)
    items = [k for k, n in counts.items() for _ in range(n)]
    best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= capacity)
    assert sum(k * n for k, n in took.items()) == best and all(n <= counts[k] for k, n in took.items())
    held = b.fullest(counts, capacity, max(counts))
    assert held[max(counts)] >= 1 and sum(k * n for k, n in held.items()) <= capacity


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
@settings(max_examples=100, deadline=None)
def test_all_pieces_are_in_sequences(counts):
    plan = b.best_combinations(counts, 64)
    used = Counter()
    for times, took in plan:
        assert sum(k * n for k, n in took.items()) <= 64
        for k, n in took.items():
            used[k] += n * times
    assert used == Counter(counts)
    # No worse than opening a sequence for each piece of more than half, and close to the sum of lengths.
    assert sum(t for t, _ in plan) >= -(-sum(k * n for k, n in counts.items()) // 64)


def test_planted_full_sequences_are_found():
    """Lengths cut out of full sequences: the bound is met where short ones are plentiful."""
    r = random.Random(2)
    counts = Counter()
    for _ in range(2000):
        left = 2048
        while left:
            k = min(left, r.choice([r.randint(1, 60), r.randint(1, 900)]))
            counts[k] += 1
            left -= k
    assert sum(t for t, _ in b.best_combinations(counts)) == 2000


def test_steps_do_not_grow_with_the_corpus():
    r = random.Random(3)
    counts = Counter(min(2048, 1 + int(r.expovariate(1 / 300))) for _ in range(5000))
    small, large = (len(b.combinations({k: n * m for k, n in counts.items()})) for m in (10, 10**9))
    assert large < 2 * small


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_words_are_encoded_as_texts(text):
    ids = b.word_ids(FILE)
    want = ids.tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert np.frombuffer(next(iter(ids([text]))), "<u4").tolist() == want


@given(st.text("abAB'srtelvmd01.,<|>éÉßÿ×÷\u0301 \n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_of_known_letters(text):
    test_words_are_encoded_as_texts.hypothesis.inner_test(text)


@pytest.mark.parametrize("text", ["Hello\x1cworld\x85a\xa0b c", "It's the END's", "<|endoftext|> a <|startoftext|>b", "é ́a", "a" * 3000, "ΑΣ ΟΔΟΣ x", "don 't", "가 ᆨ", "�\x00 \x01"])
def test_odd_texts(text):
    ids = b.WordIds(FILE)
    want = ids.tokenizer.encode(text, add_special_tokens=False).ids + [0]
    for _ in range(2):
        assert np.frombuffer(next(iter(ids([text]))), "<u4").tolist() == want


def test_a_small_memo_gives_the_same(monkeypatch):
    monkeypatch.setattr(b, "MEMO_WORDS", 5)
    ids, plain, r = b.WordIds(FILE), b.word_ids(FILE), random.Random(1)
    texts = [" ".join(f"word{r.randint(0, 30)}" for _ in range(r.randint(0, 12))) for _ in range(100)]
    assert list(ids(texts)) == list(plain(texts)) and len(ids.memo) < 40


def test_packed_documents(odd_docs, spark):
    rows = b.pack(odd_docs, FILE, keep_ids=True).collect()
    texts = defaultdict(list)
    tok = b.word_ids(FILE).tokenizer
    for x in odd_docs.collect():
        texts[x.doc_id].append(tok.encode(x.text or "", add_special_tokens=False).ids + [0])
    got, bins = Counter(), defaultdict(list)
    for x in rows:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and x.start == 2048 * x.piece
        assert 0 < x.length <= 2048
        got[x.doc_id, x.piece, tuple(x.ids)] += 1
        bins[x.sequence_id].append((x.offset, x.length))
    want = Counter((i, k // 2048, tuple(t[k : k + 2048])) for i, all_of in texts.items() for t in all_of for k in range(0, len(t), 2048))
    assert got == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x.length for x in rows)
    assert -(-total // 2048) <= len(bins) <= -(-total // 2048) + 1
    whole = b.sequences(b.pack(odd_docs, FILE, keep_ids=True)).collect()
    assert sum(len(x.ids) for x in whole) == total and all(len(x.ids) == sum(x.lengths) <= 2048 and len(x.doc_ids) == len(x.lengths) for x in whole)


def test_empty_table(odd_docs):
    out = b.pack(odd_docs.where(F.lit(False)), FILE)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
