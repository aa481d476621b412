import math

import numpy as np
import pytest
from crossloom.functions import chains
from crossloom.operators import hmm, scan, scan2
from crossloom.operators import locus_models as lm
from crossloom.operators.scan2 import _chromosomes, _collapse, _loci, joint_designs

from tests.test_mixture import small


@pytest.fixture(scope="module")
def cross(spark):
    c = small(spark, "f2", n=60, markers=6, missing=0.3)
    y = c.pheno.collect()
    mid = float(np.median([r.y for r in y]))
    return c.with_(pheno=spark.createDataFrame([*((r.ind, "t", r.y) for r in y), *((r.ind, "b", float(r.y > mid)) for r in y)], "ind long, trait string, y double"))


@pytest.fixture(scope="module")
def covar(spark, cross):
    r = np.random.default_rng(9)
    return spark.createDataFrame([(x.ind, n, float(r.normal())) for x in cross.individual.orderBy("ind").collect() for n in ("age", "dose")], "ind long, name string, value double")


def probabilities(cross):
    """Joint class probabilities of loci and pairs, on the driver."""
    t = hmm.tracks(cross)
    b = hmm.sequences(cross).orderBy("ind").toArrow().combine_chunks().to_batches()[0]
    got = _chromosomes(b, t, (cross.crosstype, cross.scheme), 1e-4, "haldane")
    loci = _loci(t)
    pairs, at = {}, 0
    names = [(t[c].names[j]) for c, j in loci]
    for at, x, k1 in joint_designs(got, loci):
        pairs[at] = x, k1
    order = [(names[i], names[j]) for i in range(len(loci)) for j in range(i + 1, len(loci))]
    return {n: got[c][0][:, j] for n, (c, j) in zip(names, loci, strict=True)}, {order[k]: v for k, v in pairs.items()}


def plain(x, maps, y, u, v, binary, method):
    """Log likelihood by loops: EM with several inner Newton steps, or direct iterations."""
    n, q = x.shape
    rows = np.array([[np.concatenate([np.kron(maps[g], u[i]), v[i]]) for g in range(q)] for i in range(n)])
    d = rows.shape[2]
    b, s2, old = np.zeros(d), None, -1e300
    if method == "hk":
        c = np.einsum("ng,ngd->nd", x, rows)
        if not binary:
            b = np.linalg.lstsq(c, y, rcond=None)[0]
            return -n / 2 * (math.log(2 * math.pi * ((y - c @ b) ** 2).mean()) + 1)
        for _ in range(200):
            p = 1 / (1 + np.exp(-c @ b))
            b = b + np.linalg.lstsq((c * (p * (1 - p))[:, None]).T @ c, c.T @ (y - p), rcond=1e-10)[0]
        eta = c @ b
        return (y * eta - np.logaddexp(0, eta)).sum()
    w = x
    for turn in range(20000):
        if turn:
            eta = rows @ b
            f = x * (np.exp(y[:, None] * eta - np.logaddexp(0, eta)) if binary else np.exp(-((y[:, None] - eta) ** 2) / (2 * s2)) / math.sqrt(2 * math.pi * s2))
            ll = np.log(f.sum(1)).sum()
            if abs(ll - old) < 1e-8:
                break
            w, old = f / f.sum(1, keepdims=True), ll
        flat, ww, yy = rows.reshape(-1, d), w.ravel(), np.repeat(y, q)
        if binary:
            for _ in range(5):
                p = 1 / (1 + np.exp(-flat @ b))
                b = b + np.linalg.lstsq((flat * (ww * p * (1 - p))[:, None]).T @ flat, flat.T @ (ww * (yy - p)), rcond=1e-10)[0]
        else:
            b = np.linalg.lstsq((flat * ww[:, None]).T @ flat, flat.T @ (ww * yy), rcond=None)[0]
            s2 = (ww * (yy - flat @ b) ** 2).sum() / n
    return old


@pytest.mark.parametrize("binary,method,add,inter", [(False, "em", ["age", "dose"], []), (True, "em", ["age"], []), (True, "hk", ["dose"], ["dose"]), (False, "em", ["age"], ["age"])])
def test_one_and_two_loci_equal_plain_fits(cross, covar, binary, method, add, inter):
    trait = "b" if binary else "t"
    y = np.array([r.y for r in cross.pheno.where(f"trait = '{trait}'").orderBy("ind").collect()])
    z = {n: np.array([r.value for r in covar.where(f"name = '{n}'").orderBy("ind").collect()]) for n in ("age", "dose")}
    v = np.stack([z[n] for n in add], axis=1) if add else np.zeros((len(y), 0))
    u = np.stack([np.ones(len(y)), *(z[n] for n in inter)], axis=1)
    single, pairs = probabilities(cross)
    null = plain(np.ones((len(y), 1)), np.ones((1, 1)), y, u, v, binary, method)
    got = {r.locus: r.lod for r in lm.scanone_model(cross, trait, method, binary, covar, add, inter, tol=1e-7).collect()}
    for name in ("m1", "m4"):
        assert abs(got[name] - (plain(single[name], np.eye(3), y, u, v, binary, method) - null) / math.log(10)) < 1e-3
    two = {(r.locus1, r.locus2): r for r in lm.scantwo_model(cross, trait, method, binary, covar, add, inter, tol=1e-6).collect()}
    assert len(two) == 15
    for key in (("m0", "m2"), ("m2", "m5")):
        x, k1 = pairs[key]
        one = (plain(x, _collapse(3, 3)[2], y, u, v, binary, method) - null) / math.log(10)
        assert abs(two[key].lod_add - one) < 2e-3
        assert two[key].lod_full >= two[key].lod_add - 1e-2 and abs(two[key].lod_one1 - got[key[0]]) < 1e-3
        if not binary:
            assert abs(two[key].lod_full - (plain(x, np.eye(9), y, u, v, binary, method) - null) / math.log(10)) < 2e-2


def test_without_covariates_equals_the_earlier_scans(cross):
    for new, old in ((lm.scanone_model(cross, "t"), scan.scan_em(cross, "t", tol=1e-7, maxit=1000)), (lm.scanone_model(cross, "b", "em", True), scan.scan_binary(cross, "b", "em", tol=1e-7, maxit=1000)), (lm.scanone_model(cross, "b", "hk", True), scan.scan_binary(cross, "b", "hk"))):
        a, b = ({r.locus: r.lod for r in x.collect()} for x in (new, old))
        assert max(abs(a[k] - b[k]) for k in a) < 2e-3
    a, b = ({(r.locus1, r.locus2): (r.lod_full, r.lod_add) for r in x.collect()} for x in (lm.scantwo_model(cross, "t", "hk"), scan2.scantwo_hk(cross, "t")))
    assert max(abs(x - y) for k in a for x, y in zip(a[k], b[k], strict=True)) < 1e-6


def test_permutations(cross, covar, monkeypatch):
    a = lm.scanone_model_perm(cross, "t", 4, covar=covar, addcovar=["age"]).collect()
    again = lm.scanone_model_perm(cross, "t", 4, covar=covar, addcovar=["age"]).collect()
    assert a == again and [r.rep for r in a] == [1, 2, 3, 4] and len({round(r.maxlod, 6) for r in a}) == 4
    monkeypatch.setattr(scan, "BROADCAST_PEOPLE", 10)
    joined = lm.scanone_model_perm(cross, "t", 4, covar=covar, addcovar=["age"]).collect()
    assert all(abs(x.maxlod - y.maxlod) < 1e-6 for x, y in zip(a, joined, strict=True))
    monkeypatch.undo()
    two = lm.scantwo_model_perm(cross, "b", 2, "hk", True).collect()
    assert len(two) == 12 and all(r.value > -1e-6 for r in two if r.stat in ("full", "add", "one"))


def test_cases(spark, cross):
    none = cross.with_(pheno=cross.pheno.where("false"))
    assert lm.scanone_model(none, "t").count() == lm.scantwo_model(none, "t").count() == lm.scanone_model_perm(none, "t", 3).count() == 0
    with pytest.raises(ValueError):
        lm.scanone_model(cross, "t", "em", True)
    with pytest.raises(ValueError):
        lm.scanone_model(cross, "t", "other")
    assert chains.n_states("f2") == 3
