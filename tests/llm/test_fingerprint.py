import hashlib

import numpy as np
import pyarrow as pa

from crossloom.llm import fingerprint as f


def test_edited_fingerprints_equal_brute_force(docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in f.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    one = lambda x: f.digest_arrays(pa.array([x]))
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e, r = f.edited(t, nxt), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f.to_strings(one(t))[0], f.to_strings(one(e))[0])
        assert abs(r.near_edited - f.likeness(one(t), one(e))[0]) < 1e-12 and abs(r.near_next - f.likeness(one(t), one(nxt))[0]) < 1e-12


def brute_digest(text):
    """The digest of one text with loops: counts of hashed triplets, quartile codes, length and checksum."""
    data = text.encode()
    counts = [0] * f.BUCKETS
    for i in range(len(data)):
        for k, places in enumerate(((i, i + 1, i + 2), (i, i + 1, i + 3), (i, i + 2, i + 3))):
            if places[-1] < len(data):
                a, b, c = (int(f._TABLES[3 * k + q][data[p]]) for q, p in enumerate(places))
                counts[(int(f._SPREAD[int(f._SPREAD[a]) ^ b]) ^ c) & 127] += 1
    ranked = sorted(counts)
    codes = [sum(x > ranked[q] for q in (31, 63, 95)) for x in counts]
    check = sum(c * (7 * k + 1) for k, c in enumerate(codes)) % 251
    length = min(255, round(float(np.log2(len(data) + 1) * 8)))
    packed = bytes(codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 128, 4))
    return (bytes([length, check]) + packed).hex(), codes, length


def test_digest_and_likeness_equal_loops(docs):
    texts = [r.text or "" for r in docs.collect() if len(r.text or "") < 1000]
    got = f.to_strings(f.digest_arrays(pa.array(texts)))
    want = [brute_digest(x) for x in texts]
    assert got == [w[0] for w in want]
    near = f.likeness(f.from_strings(got[:-1]), f.from_strings(got[1:]))
    for (_, a, m), (_, b, n), x in zip(want, want[1:], near, strict=False):
        apart = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(p - q)] for p, q in zip(a, b, strict=True)) + 2 * max(0, min(32, abs(m - n)) - 1)
        assert abs(x - (1 - min(224, apart) / 224)) < 1e-12


def test_likeness_of_equal_and_of_near_texts():
    a, b, c = (f.digest_arrays(pa.array([x])) for x in ("the quick brown fox jumps over the lazy dog " * 20, "the quick brown fox jumps over the lazy cat " * 20, "0123456789 ~~~ entirely different bytes !!! " * 20))
    assert f.likeness(a, a)[0] == 1 and f.likeness(a, b)[0] > f.likeness(a, c)[0]
    assert (f.from_strings(f.to_strings(a)) == a).all()


def test_odd_and_empty_tables(odd_docs, none):
    assert f.edited_fingerprints(odd_docs).count() == odd_docs.count()
    assert f.edited_fingerprints(none).count() == 0
    one = f.fingerprint(odd_docs).collect()
    assert len({r.fingerprint for r in one if (r.text or "") == ""}) == 1
    assert {"rep", "n", "fingerprint"} <= set(f.fingerprint(odd_docs).columns)
    assert f.compare(f.fingerprint(odd_docs), "fingerprint", "fingerprint").where("likeness < 1").count() == 0
    assert np.array_equal(f.digest_arrays(pa.array([None, ""], pa.string()))[0], f.digest_arrays(pa.array([""]))[0])
