"""Normal mixtures of many individuals: their traits are Chebyshev sums by panels, with the same results as individuals' own rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossloom.operators import locus_models as lm
from crossloom.operators.scan2 import _collapse
from tests.test_large_tables import few_kinds


@pytest.mark.parametrize("maps", [np.eye(4), _collapse(2, 2)[2], np.eye(1)])
@pytest.mark.parametrize("steep", [0.0, 1e-6, 0.01, 0.3, 0.6])
def test_points_add_up_to_their_individuals(maps, steep):
    r = np.random.default_rng(4)
    mean, width, q = 2.5e5, 4e5, len(maps)
    k, y, z = np.repeat([0, 1, 2], 400), r.uniform(5e4, 4.4e5, 1200), np.repeat([1.0, 5.0, 3.0], 400)[:, None]
    x = r.dirichlet(np.ones(q), 3)
    for inter in (False, True):
        one = lambda z: np.concatenate([np.ones((len(z), 1)), z[:, : int(inter)] / 10], axis=1)
        family, most = lm.Family(False, "em"), np.array([1.0, 0.5][: 1 + inter])
        b = r.normal(size=(maps.shape[1], 1 + inter))
        b *= steep / max(1e-300, family.steepness(maps, np.append(b.ravel(), [0.0, 1.3e10]), most) * width / 2) if q > 1 else 0.0
        b[:, 0] += np.linalg.lstsq(maps, np.full(q, 2.5e5), rcond=None)[0]
        state = np.concatenate([b.ravel(), [700.0, 1.3e10]])
        want = family.equations(x[k], maps, y, one(z), z, state)
        p = lm._points(family.steepness(maps, state, most) * width / 2)
        assert p and p <= lm.NODES and (steep > 1e-3 or p <= 4)
        t = np.arccos((y - mean) / width * 2)
        s = np.array([[np.cos(j * t[k == i]).sum() for j in range(lm.NODES)] for i in range(3)])
        rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 0]), pa.array(list(s))], names=["panel", "s"])
        at, times = lm._traits(rows, mean, width, p)
        v = np.repeat(z[::400], p, axis=0)
        got = family.equations(np.repeat(x, p, axis=0), maps, at.ravel(), one(v), v, state, times.ravel())
        assert np.allclose(got, want, rtol=1e-11, atol=1e-11 * abs(want).max() * 1e-6)
        first = family.equations(x[k], maps, y, one(z), z, None)
        at, times = lm._traits(rows, mean, width, 3)
        v = np.repeat(z[::400], 3, axis=0)
        assert np.allclose(family.equations(np.repeat(x, 3, axis=0), maps, at.ravel(), one(v), v, None, times.ravel()), first, rtol=1e-11)


def test_steeper_models_take_finer_panels():
    assert lm._points(0) == 3 and lm._points(1e-3) < lm._points(0.1) < lm._points(0.5) <= lm.NODES
    assert lm._points(5.0) is lm._points(np.inf) is lm._points(np.nan) is None
    panels = lm.Panels(None, 0.0, 4.0)
    assert [panels.place(x)[0] for x in (0, 0.3, 1.2, 5.0, np.inf)] == [0, 0, 1, 2, lm.LEVELS]


def lods(scan):
    return {(r.locus1, r.locus2): np.array([r.lod_full, r.lod_add, r.lod_one1, r.lod_one2]) for r in scan.collect()}


@pytest.mark.parametrize("case", ["plain", "covariate", "interactive", "steep", "outlier"])
def test_rounds_read_panels_not_individuals(spark, monkeypatch, case):
    """traits that all differ don't make a round read all individuals."""
    c = few_kinds(spark, 4000)
    if case == "steep":  # classes far apart
        g = c.geno.where("marker = 'D1M1'").select("ind", F.col("g").alias("own"))
        c = c.with_(pheno=c.pheno.join(g, "ind", "left").select("ind", "trait", (F.coalesce("own", F.lit(1)) * 12.0 + F.col("y")).alias("y")))
    if case == "outlier":
        c = c.with_(pheno=c.pheno.withColumn("y", F.when(F.col("ind") == 7, 900.0).otherwise(F.col("y"))))
    covar = c.individual.select("ind", F.lit("z").alias("name"), (F.col("ind") % 2).cast("double").alias("value"))
    more = {"covariate": {"covar": covar, "addcovar": ["z"]}, "interactive": {"covar": covar, "intcovar": ["z"]}}.get(case, {})
    want = lods(lm.scantwo_model(c, "phenotype", **more))
    seen, store = [], lm.materialise
    monkeypatch.setattr(lm, "materialise", lambda df, name: (lambda got: (seen.append((name, got)), got)[1])(store(df, name)))
    monkeypatch.setattr(lm, "MOST_PEOPLE", 100)
    got = lods(lm.scantwo_model(c, "phenotype", **more))
    assert got.keys() == want.keys() and len(want) == 6
    assert all(abs(got[k] - want[k]).max() < 1e-6 for k in want)
    sums = [df for name, df in seen if name == "sums"]
    alone = [df for name, df in seen if name == "people"][1:]  # the first are all, read once for each level
    assert len(sums) >= (2 if case == "steep" else 1)
    for many, few in zip(sums, alone, strict=False):
        n = many.agg(F.sum(F.col("s")[0])).first()[0] or 0
        assert abs(n + few.agg(F.sum("times")).first()[0] - 4000) < 1e-6
    assert sums[0].count() <= 500 and alone[0].count() < 2500


def test_only_crowded_panels_are_summed(spark):
    r = np.random.default_rng(1)
    rows = [([0], [1 + k % 2], float(r.normal()), []) for k in range(200)] + [([0], [3], float(k % 2), []) for k in range(6)]
    people = spark.createDataFrame(rows, "m array<int>, g array<int>, y double, z array<double>")
    few, many = lm.Panels(people, 0.0, 8.0).tables(0)
    assert sorted((r.g, r.times) for r in few.collect()) == [([3], 3.0), ([3], 3.0)]
    assert sorted((r.g, r.s[0]) for r in many.collect()) == [([1], 100.0), ([2], 100.0)]
    assert few.count() == lm.Panels(people, 0.0, 8.0).tables(lm.LEVELS)[0].where("g = array(3)").count() == 2
