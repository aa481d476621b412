import random
import re

import numpy as np
import pytest

from crossloom.llm import near_dedup as n

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TABLE))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(docs, size):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], size, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in n.components(docs, size, 80).collect()}
    assert got == want


def test_large_bundles_in_blocks(spark, monkeypatch):
    """Chains and clusters larger than nodes and blocks, so that every path beyond the small one runs."""
    monkeypatch.setattr(n, "NODE", 8)
    monkeypatch.setattr(n, "BLOCK", 6)
    r = random.Random(3)
    rows, base = [], [f"w{k}" for k in range(60)]
    for k in range(40):  # near copies of one text
        w = list(base)
        w[r.randrange(60)] = f"v{k}"
        rows.append((k, " ".join(w)))
    w = list(base)
    for k in range(40, 90):  # a chain that drifts away
        w[(k * 7) % 60] = f"u{k}"
        rows.append((k, " ".join(w)))
    for k in range(90, 110):  # under the threshold, but close
        w = list(base)
        for j in range(0, 60, 9):
            w[j] = f"t{k}_{j}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 80)
    monkeypatch.setattr(n, "BROADCAST_MEMBERS", 0)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in n.components(df, 4, 80).collect()}
    assert got == want


def test_words_that_a_sum_over_places_would_equate(spark):
    """Thue-Morse words: any hash that is a polynomial modulo a power of two takes one for the other."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"x {a} y z"), (4, f"x {b} y z")]
    got = {r.doc_id: r.component_id for r in n.components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_odd_tables(odd_docs, none):
    assert n.components(odd_docs).count() == odd_docs.count()
    assert n.components(none).count() == 0
    kept = n.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id IS NULL").count() == 2


def test_exact_labels():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a[:80], a[:79], a[60:]]
    assert n.exact_labels(sets, 80).tolist() == [0, 0, 0, 3]
    assert n.exact_labels([a, a[:79]], 80).tolist() == [0, 1]


def test_odd_sketches_lose_no_link(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        w = [f"a{r.randrange(10**6)}" for _ in range(r.choice([3, 30, 130, 260, 700]))]
        rows.append((2 * k, " ".join(w)))
        for _ in range(r.randrange(1 + len(w) // 20)):
            w[r.randrange(len(w))] = "changed"
        rows.append((2 * k + 1, " ".join(w[: r.randrange(len(w) * 4 // 5, len(w)) + 1])))
    odd = {x.rep: bytes(x.odd) for x in n.odd_sketches(spark.createDataFrame(rows, "rep long, text string"), 4).collect()}
    cells = [(0, 0, side, i, i, odd[i]) for i in odd for side in (0, 1)]
    found = n._odd_links(spark.createDataFrame(cells, "g long, h long, side int, rep long, c long, odd binary"), 80).collect()
    near, want = {i: i for i in odd}, brute(rows, 4, 80)
    for a, b in sorted((x.a, x.b) for x in found):
        near[b] = near[a]
    assert all(near[i] == near[want[i][1]] for i in odd)
    assert len(found) < 60


def family(members, links):
    """Texts of similarity 0.68 or so to each other; every seventh has a copy at 0.9, with an id far off."""
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(members):
        w = list(base)
        for j in random.Random(k).sample(range(0, 300, 4), 8):
            w[j] = f"t{k}_{j}"
        rows.append((k, " ".join(w)))
        if links and k % 7 == 0:
            rows.append((10**6 - k, " ".join([*w[:-8], *(f"z{k}_{j}" for j in range(8))])))
    return rows


def test_families_below_the_threshold_send_few_texts(spark, monkeypatch):
    monkeypatch.setattr(n, "NODE", 8)
    monkeypatch.setattr(n, "BLOCK", 16)
    monkeypatch.setattr(n, "ODD_BLOCK", 128)
    sent, whole = [], n._meeting

    def counted(label, payload, block):
        out = whole(label, payload, block)
        sent.append((payload, out.count()))
        return out

    monkeypatch.setattr(n, "_meeting", counted)
    rows = family(140, True)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in n.components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute(rows, 4, 80)
    texts = dict(sent)["text"]
    sent.clear()
    rows = family(280, True)
    assert {x.doc_id: x.component_id for x in n.components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()} == {i: c for i, (_, c, _) in brute(rows, 4, 80).items()}
    assert dict(sent)["text"] <= 2.2 * texts + 16
