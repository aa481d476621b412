import hashlib
import re

from crossloom.llm import decontaminate as d

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(TABLE))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(len(w), 13)
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                x = tuple(w[k : k + m])
                if x in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[x]
        s = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(s.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def items(spark, docs):
    texts = [r.text for r in docs.where("doc_id IN (1, 4, 8, 10, 22)").collect()]
    rows = [(k, " ".join(t.split(" ")[k : k + 20])) for k, t in enumerate(texts)]
    rows += [(10, "ONE"), (11, None), (12, ""), (13, "!!!"), (14, "É naïve"), (15, "ein, ZWEI"), (15, "x1Y2"), (None, "w1 w2 w3"), (99, "never seen in any of these texts " * 4)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(spark, odd_docs):
    b = items(spark, odd_docs)
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in b.collect()])
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.contamination(odd_docs, b).collect()), key=str)
    assert got == want


def test_shuffled_joins_give_the_same(spark, docs, monkeypatch):
    b = items(spark, docs)
    want = sorted(map(str, d.contamination(docs, b).collect()))
    monkeypatch.setattr(d, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, d.contamination(docs, b).collect())) == want


def test_empty_tables_and_removal(spark, odd_docs, none):
    b = items(spark, odd_docs)
    assert d.contamination(none, b).count() == 0
    assert d.contamination(odd_docs, b.where("false")).where("n_hit > 0 OR contaminated").count() == 0
    kept = d.remove(odd_docs, b)
    assert kept.columns == odd_docs.columns
    assert kept.count() == d.contamination(odd_docs, b).where("NOT contaminated").count()


def test_spans_are_cut_out(spark, odd_docs):
    b = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "(one) Alpha, BETA; gamma! two. DELTA?"), (2, "alpha beta"), (3, None), (4, ""), (5, "delta delta")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in d.remove_spans(docs, b).collect()}
    assert got == {1: "(one) ! two. ?", 2: "alpha beta", 3: None, 4: "", 5: ""}
    out = d.remove_spans(odd_docs, items(spark, odd_docs))
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert d.contamination(out.where("doc_id IN (1, 4)"), items(spark, odd_docs).where("item_id < 10")).where("n_hit > 0").count() == 0
