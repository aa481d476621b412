import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crossloom.llm import max_ent as m

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TABLE)) + [None]


@pytest.mark.parametrize("top", [200_000, 20])
def test_counts_and_base_scores_equal_brute_force(odd_docs, monkeypatch, top):
    """Also with so few broadcast words that most go through the blocks' dictionaries."""
    monkeypatch.setattr(m, "TOP_WORDS", top)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    mod = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    c = Counter(w for i, t in rows if mod(i) != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(str((i, mod(i) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10(c[w] + 1) - math.log10(n + v + 1) for w in tokens(t)), 6))) for i, t in rows)
    got = m.score(odd_docs).collect()
    assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_table(none):
    assert m.score(none).count() == 0


def some_vocabulary(rng, words, n):
    cls = m._tail_class(rng.integers(1, 2**62, len(words)).astype(np.uint64)).astype(np.int64)
    v = m.Vocabulary(words, cls, n, np.bincount(cls, n, minlength=m.CLASSES).astype(np.int64), np.bincount(cls, minlength=m.CLASSES))
    own = {int(x): k for k, x in enumerate(v.own_word)}
    return v, np.array([own.get(int(x), c) for x, c in zip(words, cls, strict=True)])


def test_classes_and_words_sum_to_one():
    rng = np.random.default_rng(0)
    word, n = rng.integers(1, 2**62, 500).astype(np.uint64), rng.integers(1, 50, 500)
    v, cls = some_vocabulary(rng, word, n)
    assert v.n_class.sum() == n.sum() and v.v_class.sum() == 500
    for k in range(m.CLASSES):
        mine = cls == k
        assert n[mine].sum() == v.n_class[k] and mine.sum() == v.v_class[k]
    back = np.repeat(np.arange(5, dtype=np.uint64), m.CLASSES)
    times = rng.integers(0, 9, len(back)).astype(float)
    x = m.class_part(np.log(v.n_class + 1.0), back, back * np.uint64(3), np.tile(np.arange(m.CLASSES), 5), times)
    assert np.allclose(np.exp(x).reshape(5, -1).sum(1), 1, atol=1e-5)


def test_places_of_frequent_words():
    rng = np.random.default_rng(5)
    word = np.unique(np.append(rng.integers(0, 2**64, 3000, dtype=np.uint64), [np.uint64(0), m.END, np.uint64(2**64 - 1)]))
    v, _ = some_vocabulary(rng, word, rng.integers(1, 9, len(word)))
    assert (v.find(v.word) == np.arange(1, len(word) + 1)).all()
    other = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    assert ((v.find(other) > 0) == np.isin(other, word)).all()


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(1)
    back1, back2 = (rng.integers(1, 6, 5000).astype(np.uint64) for _ in range(2))
    order = np.lexsort((back2, back1))
    back1, back2 = back1[order], back2[order]
    y = ((back1 + back2) % np.uint64(m.CLASSES)).astype(np.int64)
    got = [m.class_part(np.zeros(m.CLASSES), back1, back2, y, np.ones(5000), k).mean() for k in (0, 1, 4)]
    assert np.isclose(got[0], -np.log(m.CLASSES)) and got[0] + 1 < got[1] < got[2] < 0


def test_packed_tokens_come_back():
    rng = np.random.default_rng(6)
    word = rng.integers(1, 2**63, 50).astype(np.uint64)
    v, _ = some_vocabulary(rng, word[:30], rng.integers(1, 9, 30))
    w, back1 = rng.choice(word, 400), np.sort(rng.choice(word, 400))
    back2, row, kind = rng.integers(0, 2**32, 400).astype(np.uint32), rng.integers(-9, 9, 400), rng.integers(0, 256, 400).astype(np.uint8)
    got = m.unpack(m.pack(back1, back2, v.find(w), w, row, kind), v)
    assert all((x == y).all() for x, y in zip(got, (back1, back2, w, row, kind), strict=True))


def test_scores_do_not_depend_on_partitions(docs, spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_TOKENS", 3000)
    got = []
    for n in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got.append({r.doc_id: r.score for r in m.score(docs.repartition(n)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(abs(x - got[1][i]) < 1e-6 * max(1, abs(x)) for i, x in got[0].items())


def test_words_that_a_sum_over_places_would_equate(spark):
    """Thue-Morse words: any hash that is a polynomial modulo a power of two takes one for the other."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    learn = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][0]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    got = {r.doc_id: r for r in m.score(spark.createDataFrame([(learn, f"x {a}"), (held, f"x {b}")], "doc_id long, text string")).collect()}
    assert got[learn].n_known == 3 and got[held].n_known == 2


def test_histories_reach_words_of_a_class(spark, monkeypatch):
    """Two words of one class and of equal counts: what tells them apart is the word before. Also with several shards and slices."""
    monkeypatch.setattr(m, "SHARD_TOKENS", 200)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    fill = " ".join(f"f{k}" for k in range(14))
    texts = ["aa xxee", "bb yyee"]
    rows, n = [], 0
    for i in range(700):
        if not held(i):
            rows.append((i, f"{texts[n % 2]} {fill} {fill}"))
            n += 1
    a, b = [i for i in range(700, 800) if held(i)][:2]
    got = {r.doc_id: r for r in m.score(spark.createDataFrame([*rows, (a, "aa xxee"), (b, "aa yyee")], "doc_id long, text string")).collect()}
    assert abs(got[a].base_score - got[b].base_score) < 0.01
    assert got[a].score > got[b].score + 0.5


def test_a_shards_words_sum_to_one():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 2**62, 300).astype(np.uint64)
    v, y = some_vocabulary(rng, words, rng.integers(2, 60, 300))
    seen = rng.choice(200, 3000)
    unknown = np.flatnonzero(v.n_class[m.OWN :]) + m.OWN
    word, y = np.concatenate([words[seen], words, np.arange(len(unknown)).astype(np.uint64)]), np.concatenate([y[seen], y, unknown])
    back = np.concatenate([rng.choice(words, 3000), np.full(len(word) - 3000, words[0])])
    got, rare = m.shard_scores(back, back * np.uint64(0) + words[1], word, y, np.arange(len(word)) < 3000, v)
    whole = (10 ** got[3000:]).sum()
    assert not rare[: 3000 + 300].any() and rare[3300:].all()
    assert 0.97 < whole < 1 + 1e-5


def test_held_out_texts_score_above_the_base(spark):
    """Texts of a small grammar: what follows depends on the one or two words before."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        w, k = [], rng.integers(0, 40)
        for _ in range(60):
            k = (3 * k + int(rng.integers(0, 3))) % 40
            w.append(f"w{k}")
        rows.append((i, " ".join(w)))
    got = [r for r in m.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 50 and sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


@pytest.mark.parametrize("hot", [10**9, 300, 20])
def test_one_model_however_tokens_are_dealt(docs, monkeypatch, hot):
    """Scores are those of one model over all tasks: not of as many as there are groups, nor of pieces of what follows a frequent word."""
    want = {r.doc_id: r.score for r in m.score(docs).collect()}
    for name, x in (("SHARD_TOKENS", 300), ("HOT_TOKENS", hot), ("FLUSH_TOKENS", 500), ("GROUP_SHARDS", 1)):
        monkeypatch.setattr(m, name, x)
    dealt = []
    deal = m._deal
    monkeypatch.setattr(m, "_deal", lambda *x: dealt.append(x[2:]) or deal(*x))
    got = {r.doc_id: r.score for r in m.score(docs).collect()}
    assert got.keys() == want.keys() and all(abs(x - want[i]) < 1e-5 * max(1, abs(x)) for i, x in got.items())
    assert (len(dealt[0][0][0]) > 1) == (hot == 20)  # pairs that are spread by document
    assert len(dealt) == m.SLICES and dealt[0][1] > m.SLICES * m.TASK_GROUPS  # more groups than one batch a slice


def test_all_outcomes_sum_to_one_with_every_feature():
    """The softmax within a class against a plain sum over all outcomes, also of rare words' buckets, for histories seen and unseen."""
    rng = np.random.default_rng(8)
    words, n = rng.integers(1, 2**62, 400).astype(np.uint64), rng.integers(2, 60, 400)
    cls = m._tail_class(words).astype(np.int64)
    rare = np.zeros((2, m.CLASSES, 3), np.int64)
    rare[:, m.OWN :] = rng.integers(1, 9, (2, m.CLASSES - m.OWN, 3))
    v = m.Vocabulary(words, cls, n, np.bincount(cls, n, minlength=m.CLASSES).astype(np.int64) + rare[0].sum(1), np.bincount(cls, minlength=m.CLASSES) + rare[1].sum(1), rare)
    every = len(v.share)
    assert np.allclose(np.bincount(v.cls_of, v.share), 1)
    skips = m.Skips(m.skip_counts(rng.integers(0, 5, 4000).astype(np.uint32), rng.integers(0, every, 4000), v, 64), v)
    learned = rng.integers(0, 4, 3000), rng.integers(0, 5, 3000), rng.integers(0, 90, 3000)
    back1, back2 = np.repeat([0, 1, 9], 2 * every), np.tile(np.repeat([0, 3], every), 3)
    one, two, what = (np.concatenate(x) for x in zip(learned, (back1, back2, np.tile(np.arange(every), 6)), strict=True))
    got = m.token_scores(one.astype(np.uint64), two.astype(np.uint32), what.astype(np.int32), np.arange(len(one)) < 3000, v, skips)
    mass = (10 ** got[3000:] * v.inside[what[3000:]]).reshape(6, every).sum(1)
    assert np.allclose(mass, 1, atol=1e-4)


def test_steps_are_where_the_gradient_is_zero():
    rng = np.random.default_rng(9)
    n, expected = rng.integers(1, 500, 2000), 10 ** rng.uniform(-6, 3, 2000)
    x = m.step(n, expected, 0.2)
    assert np.abs(n - expected * np.exp(x) - 0.2 * x).max() < 0.01 * n.max()
    assert (np.abs(n - expected * np.exp(x) - 0.2 * x) < 0.05 * n + 1e-6).mean() > 0.95


def test_stored_ids_stand_for_words():
    """What is dealt are ids of four bytes, read from texts once: outcomes and counts follow from them, also of rare words."""
    rng = np.random.default_rng(10)
    words = rng.integers(1, 2**64, 600, dtype=np.uint64)
    cls = m._tail_class(words).astype(np.int64)
    n = rng.integers(2, 60, 400)
    rare = np.zeros((2, m.CLASSES, 7), np.int64)
    bucket = ((words[400:] >> np.uint64(38)) % np.uint64(7)).astype(np.int64)
    np.add.at(rare, (slice(None), cls[400:], bucket), 1)
    v = m.Vocabulary(words[:400], cls[:400], n, np.bincount(cls[:400], n, minlength=m.CLASSES).astype(np.int64) + rare[0].sum(1), np.bincount(cls, minlength=m.CLASSES), rare)
    own = {int(x): k for k, x in enumerate(v.own_word)}
    place = v.find(words)
    ids = v.ids(words, cls, place)
    out = v.outcomes(ids)
    assert ids.dtype == np.uint32 and len(np.unique(ids)) == 600
    assert (v.cls_of[out] == [own.get(int(x), c) for x, c in zip(words, cls, strict=True)]).all()
    assert (v.times(ids) == np.append(n, np.zeros(200))).all()
    assert len(np.unique(out[:400])) == 400 and (v.inside[out[:400]] == 1).all()
    assert (v.inside[out[400:]] == 2 * rare[0][cls[400:], bucket] + 1).all()
