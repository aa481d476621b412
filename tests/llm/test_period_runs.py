import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossloom.llm import period_runs as p


def brute(w):
    """All runs by looking at each period: stretches of word[j] == word[j - q], of which the smallest period stays."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        j = q
        while j < len(w):
            if w[j] != w[j - q]:
                j += 1
                continue
            k = j
            while k < len(w) and w[k] == w[k - q]:
                k += 1
            s, n = j - q, k - j + q
            if n >= max(24, 3 * q):
                found.setdefault((s, n), q)
            j = k
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        per = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % per] for i in range(n)]
    found = brute(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-(x[1] * 10**12 // x[2]), x[0], x[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[2] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@given(st.lists(st.integers(0, 2), max_size=120))
@settings(max_examples=200, deadline=None)
def test_small_alphabets(w):
    assert p.runs(w) == brute(w)


@given(st.integers(0, 10**9))
@settings(max_examples=150, deadline=None)
def test_planted_repetitions(seed):
    r = random.Random(seed)
    w = []
    for _ in range(r.randint(1, 5)):
        unit = [r.randint(0, r.choice([1, 3, 50])) for _ in range(r.randint(1, 25))]
        w += [r.randint(0, 50) for _ in range(r.randint(0, 20))] + (unit * 12)[: r.randint(1, 12 * len(unit))]
    assert p.runs(w) == brute(w)


def test_squares_are_squares():
    r = random.Random(3)
    w = [r.randint(0, 1) for _ in range(300)]
    seen = list(p.squares(w))
    assert seen and all(w[e - 2 * d + 1 : e - d + 1] == w[e - d + 1 : e + 1] and e - 2 * d + 1 >= 0 for e, d in seen)


def test_a_run_within_runs():
    w = ([1] * 30 + [2]) * 4
    assert p.runs(w) == brute(w) and (0, 124, 31) in p.runs(w) and (0, 30, 1) in p.runs(w)


def test_long_texts_take_no_longer_than_their_words():
    r = random.Random(1)
    unit = [r.randint(0, 10**6) for _ in range(30000)]
    assert p.runs(unit * 4) == [(0, 120000, 30000)]
    assert p.runs([5] * 200000) == [(0, 200000, 1)]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    rows = []
    for k in range(120):
        words = [r.choice(["a", "b", "Ab", "é"]) if k % 3 else f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 150))]
        if k % 4 == 0:
            words += ["x", "y"] * r.randint(0, 20)
        rows.append((k, (" \t\n"[k % 3]).join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one"), (203, "one"), (None, "ha " * 40), (204, "ha " * 23), (205, "ha " * 24), (206, "ha " * 5000), (207, " ".join(["A", "a"] * 12))]
    return spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, start string, unit long").repartition(4)


def test_report_against_brute_force(texts):
    got = sorted((tuple(x) for x in p.report(texts).collect()), key=str)
    assert got == sorted((brute_row(x.doc_id, x.text) for x in texts.collect()), key=str)


def test_found_runs_and_collapsed_texts(texts):
    want = sorted((str(x.doc_id), s, n, q) for x in texts.collect() for s, n, q in brute((x.text or "").split()))
    found = p.find(texts)
    assert found.columns == ["doc_id", "start", "length", "period", "unit"]
    assert sorted((str(x.doc_id), x.start, x.length, x.period) for x in found.collect()) == want and want
    out = p.collapse(texts)
    assert out.columns == texts.columns
    got = {x.doc_id: x.text for x in out.collect()}
    assert got[206] == got[205] == got[None] == "ha" and got[204] == "ha " * 23 and got[200] is None and got[202] == " \n "


def test_empty_table(texts):
    none = texts.where(F.lit(False))
    assert p.report(none).count() == p.find(none).count() == p.collapse(none).count() == 0
