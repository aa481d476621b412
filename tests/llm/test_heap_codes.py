import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossloom.llm import heap_codes as h

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def brute(rows, rounds=2):
    """Plain loops over Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(first[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    first = [r for r in first if len(r[1]) == width][:64]
    cut = [k * width // 16 for k in range(17)]
    part = lambda v, p: v[cut[p] : cut[p + 1]]
    books = [[part(v, p) for _, v, _ in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(16):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[own(v, p)].append(part(v, p))
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e], strict=True)] if e in got else books[p][e] for e in range(len(books[p]))]
    out, total = [], defaultdict(int)
    for i, v, lab in kept:
        codes = [own(v, p) for p in range(16)]
        error = sum(far(part(v, p), books[p][c]) for p, c in enumerate(codes))
        total[lab] += error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in out), key=str)


def made(n, width, seed=1, spread=0.3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    f = lambda x: float(np.float32(x))
    return [(k * 3 + 1, [f(x + r.gauss(0, spread)) for x in centres[r.randint(0, 8)]], r.choice([None, 1, 2, 2, 2])) for k in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("width", [64, 16, 37, 5])
def test_equals_plain_lloyd(spark, width):
    rows = made(300, width)
    rows += [(5000, rows[0][1], 1), (1, rows[0][1], None), (5001, None, 1), (5002, [float("nan")] * width, 1), (5003, [None] * width, 2), (5004, [float("inf")] * width, 2), (5005, [1.0], 2), (None, rows[3][1], 7)]
    assert sorted((tuple(x) for x in h.compress(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_ties_and_few_rows(spark):
    rows = [(k, [float(k % 2)] * 16, 1) for k in range(10)]
    assert sorted((tuple(x) for x in h.compress(frame(spark, rows)).collect()), key=str) == brute(rows)
    one = [(7, [0.5] * 32, None)]
    assert [tuple(x) for x in h.compress(frame(spark, one, 1)).collect()] == brute(one)


def test_large_components(spark):
    rows = [(k, [float(np.float32(x * 4000)) for x in v], lab) for k, v, lab in made(120, 32)]
    assert sorted((tuple(x) for x in h.compress(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_blocks_and_rounds(spark, monkeypatch):
    rows = made(500, 32, seed=4)
    want = brute(rows, 5)
    monkeypatch.setattr(h, "BLOCK_ROWS", 37)
    fitted = h.fit(frame(spark, rows), rounds=5)
    assert sorted((tuple(x) for x in h.assign(fitted).select("vec_id", "code", "error").collect()), key=str) == [x[:3] for x in want]
    assert fitted.books.digest == want[0][4]
    # The first round looks at all parts, later ones at fewer and fewer.
    assert fitted.popped[0] == 500 * 16 and fitted.popped[-1] < fitted.popped[1] < fitted.popped[0]
    near = h.decode(h.assign(fitted), fitted.books).join(frame(spark, rows).select("vec_id", "embedding"), "vec_id").collect()
    assert max(abs(sum((256 * a - math.floor(256 * b)) ** 2 for a, b in zip(x.vector, x.embedding, strict=True)) - x.error) for x in near) < 1e-6


def test_heaps_pop_by_drift():
    r = np.random.default_rng(3)
    x, entries = r.integers(-500, 500, (400, 4)), r.integers(-500, 500, (20, 4))
    own, slack = h.nearest(x, entries)
    heap = h.Heaps.of(np.arange(400), h._down(slack), own, 20)
    assert not heap.pop(np.full(20, -1.0)).any() and heap.pop(np.full(20, 1e9)).all()
    keys = [heap.key[heap.start[e] : heap.start[e + 1]] for e in range(20)]
    assert all((np.diff(k) >= 0).all() for k in keys)
    moved = entries + r.integers(-20, 21, entries.shape)
    step = np.sqrt(((moved - entries) ** 2).sum(1))
    drift = step + np.array([max(np.delete(step, e)) for e in range(20)])
    new, *_ = heap.settle(x, moved, drift)
    got = np.zeros(400, int)
    got[new.slot] = new.entry
    assert (got == h.nearest(x, moved)[0]).all() and 0 < heap.pop(drift).sum() < 400


def test_empty_table(spark):
    none = frame(spark, made(3, 16)).where(F.lit(False))
    out = h.compress(none)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
