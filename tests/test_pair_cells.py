"""Pair tables against a loop over individuals and pairs, with one block and with many, sums kept and sums sent on."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from crossloom.operators import pair_cells as p

KIND = pa.schema([("m1", pa.string()), ("m2", pa.string()), ("g1", pa.int32()), ("g2", pa.int32()), ("n", pa.int64()), ("y", pa.float64())])


@pytest.mark.parametrize(("columns", "entries", "cells"), [(2048, 1 << 22, 1 << 23), (2048, 60, 30), (7, 60, 50), (7, 1 << 22, 1 << 23), (20, 40, 100)])
def test_tables_of_all_pairs(monkeypatch, columns, entries, cells):
    monkeypatch.setattr(p, "COLUMNS", columns)
    monkeypatch.setattr(p, "ENTRIES", entries)
    monkeypatch.setattr(p, "CELLS", cells)
    rng = np.random.default_rng(3)
    people = [([(f"m{m}", int(rng.integers(1, 4))) for m in rng.permutation(12) if rng.random() < 0.7], float(rng.normal())) for _ in range(60)]
    people.append(([], 1.0))
    rank = lambda m: -int(m[1:])
    want = defaultdict(lambda: [0, 0.0])
    for a, y in people:
        for m1, g1 in a:
            for m2, g2 in a:
                if rank(m1) < rank(m2):
                    want[m1, m2, g1, g2][0] += 1
                    want[m1, m2, g1, g2][1] += y
    got = defaultdict(lambda: [0, 0.0])
    task = p._Task(1, rank, KIND)
    kind = pa.list_(pa.struct([("marker", pa.string()), ("g", pa.int32())]))
    out = []
    for k in range(0, len(people), 9):
        part = people[k : k + 9]
        lists = pa.array([[{"marker": m, "g": g} for m, g in a] for a, _ in part], kind)
        out += task.take(pa.RecordBatch.from_arrays([lists, pa.array([y for _, y in part])], names=["a", "y"]))
    out += [*task.multiply(), *task.finish()]
    for b in out:
        for m1, m2, g1, g2, n, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[m1, m2, g1, g2][0] += n
            got[m1, m2, g1, g2][1] += y
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    if columns == 2048:
        assert sum(b.num_rows for b in out) == len(want)  # one row for each pair of codes, not for each individual
