import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from crossloom.llm import line_dedup as n

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
key = lambda x: x.strip(n.WHITE).translate(TABLE)


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and i is not None and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_report_equals_brute_force(odd_docs, none):
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in n.report(odd_docs).collect()), key=str)
    index = n.LineIndex(odd_docs.sparkSession)
    index.insert(odd_docs)
    assert got == sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in n.report(odd_docs, index=index).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert n.report(none).count() == 0


def test_without_broadcast_filters(docs, odd_docs, none, monkeypatch):
    want = [sorted(map(str, n.report(x).collect())) for x in (docs, odd_docs, none)]
    monkeypatch.setattr(n, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(n, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(n, "SHARD_KEYS", 3)
    monkeypatch.setattr(n, "PART_KEYS", 2)
    asked = []
    whole = n.routed
    monkeypatch.setattr(n, "routed", lambda *a: asked.append(whole(*a)) or asked[-1])
    assert [sorted(map(str, n.report(x).collect())) for x in (docs, odd_docs, none)] == want
    refs = n.references(docs).select("k1", "k2").distinct()
    assert len(asked) == 3 and n.common_keys(docs).join(asked[0], ["k1", "k2"], "left_anti").count() == 0
    assert asked[0].count() == asked[0].distinct().count() < refs.count()


def test_remove_keeps_columns(odd_docs):
    out = n.remove(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.where(F.col("text").isNotNull() & (F.length("text") != F.col("n_chars"))).count() == 0
    assert out.where("doc_id = 200 AND text IS NULL").count() == 1


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    k = rng.integers(-(2**63), 2**63 - 1, (2, 20000))
    f = n.CuckooFilter.build(k[0], k[1])
    assert f.contains(k[0], k[1]).all()
    other = rng.integers(-(2**63), 2**63 - 1, (2, 20000))
    assert f.contains(other[0], other[1]).mean() < 0.001
    f.delete(k[0][:5000], k[1][:5000])
    assert f.contains(k[0][5000:], k[1][5000:]).all() and f.contains(k[0][:5000], k[1][:5000]).mean() < 0.01
    assert (n.CuckooFilter.load(f.dump()).table == f.table).all()


def test_full_filters_ask_for_a_larger_one():
    rng = np.random.default_rng(3)
    k = rng.integers(-(2**63), 2**63 - 1, (2, 300))
    f = n.CuckooFilter(32)
    assert f.insert(k[0][:100], k[1][:100]) and f.contains(k[0][:100], k[1][:100]).all()
    assert not f.insert(k[0][100:], k[1][100:])
    assert n.CuckooFilter.build(k[0], k[1]).contains(k[0], k[1]).all()


def test_insertion_and_deletion_are_inverse(spark, docs, monkeypatch):
    monkeypatch.setattr(n, "SHARD_KEYS", 4)
    monkeypatch.setattr(n, "MERGE_AFTER", 3)
    index = n.LineIndex(spark)
    first, second, third = docs.where("doc_id < 80"), docs.where("doc_id >= 80 AND doc_id < 120"), docs.where("doc_id >= 120")
    state = lambda d: (sorted(map(str, index.counts().collect())), sorted(map(str, index.references().collect())), sorted(map(str, index.remove(d).collect())))
    index.insert(first)
    before = state(first)
    index.insert(second)
    index.insert(third)
    whole = sorted((r.doc_id, r.text) for r in index.remove(docs).collect())
    assert whole == sorted((r.doc_id, r.text) for r in n.remove(docs).collect())
    filters = {r.shard: n.CuckooFilter.load(bytes(r.table)) for r in index.filters.collect()}
    for r in index.common().collect():
        k1, k2 = np.array([r.k1]), np.array([r.k2])
        assert filters[int(n.shard_of(k2, index.shards)[0])].contains(k1, k2).all()
    index.delete(third.select("doc_id"))
    index.delete(second.select("doc_id"))
    assert state(first) == before
    index.insert(second)
    index.delete(second)
    assert state(first) == before
    index.delete(first)
    assert index.counts().count() == index.references().count() == 0


def test_index_of_nothing(spark, none, docs):
    index = n.LineIndex(spark)
    index.insert(none)
    index.delete(none)
    assert index.remove(docs).count() == docs.count() and n.report(none, index=index).count() == 0
