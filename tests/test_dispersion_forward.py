import math

import numpy as np
import pytest
from crossloom.functions import chains
from crossloom.functions.stats import t_sf2
from crossloom.model import Cross
from crossloom.operators import dispersion, forward, hmm

from tests.test_mixture import small


def plain(a_mean, a_disp, y, zm, zv):
    """Alternating fits by loops to the end: weighted least squares, then a gamma model with logarithmic link fitted by itself."""
    x, d = np.column_stack([np.ones(len(y)), a_mean, zm]), np.column_stack([np.ones(len(y)), a_disp, zv])
    w = np.full(len(y), 1 / y.var())
    for _ in range(300):
        m = np.linalg.inv((x * w[:, None]).T @ x)
        b = m @ (x.T @ (w * y))
        r = y - x @ b
        lever = w * np.einsum("na,ab,nb->n", x, m, x)
        y2, p = r * r / (1 - lever), (1 - lever) / 2
        g = np.linalg.lstsq(d, -np.log(w), rcond=None)[0]
        for _ in range(100):
            mu = np.exp(d @ g)
            c = np.linalg.inv((d * p[:, None]).T @ d)
            g = c @ (d.T @ (p * (d @ g + y2 / mu - 1)))
        w = np.exp(-d @ g)
    n = len(y)
    s2 = (w * r * r).sum() / (n - x.shape[1])
    phi = (p * (y2 * w - 1) ** 2).sum() / (n - d.shape[1])
    return -math.log10(t_sf2(b[1] / math.sqrt(s2 * m[1, 1]), n - x.shape[1])), -math.log10(t_sf2(g[1] / math.sqrt(phi * c[1, 1]), n - d.shape[1]))


def additive_by_locus(cross):
    t = hmm.tracks(cross)
    b = hmm.sequences(cross).orderBy("ind").toArrow().combine_chunks().to_batches()[0]
    out = {}
    for x in t.values():
        p = chains.posterior(chains.emissions(cross.crosstype, hmm.codes(b, x), 1e-4), chains.initial(cross.crosstype), x.steps((cross.crosstype, cross.scheme)))
        out |= {m: dispersion.additive(p)[:, j] for j, m in enumerate(x.names)}
    return out


def values(cross, covar=None, name=None):
    if name:
        return np.array([r.value for r in covar.where(f"name = '{name}'").orderBy("ind").collect()])[:, None]
    return np.array([r.y for r in cross.pheno.orderBy("ind").collect()])


def test_dispersion_equals_plain_fits(spark):
    cross = small(spark, "f2", n=90, markers=4, missing=0.2)
    r = np.random.default_rng(2)
    covar = spark.createDataFrame([(i, "age", float(r.normal())) for i in range(90)], "ind long, name string, value double")
    got = {x.locus: x for x in dispersion.scanone_var(cross, "t", covar, ["age"], ["age"], maxit=200, tol=1e-9).collect()}
    y, z, a = values(cross), values(cross, covar, "age"), additive_by_locus(cross)
    for m, x in a.items():
        want = plain(x, x, y, z, z)
        assert abs(got[m].neglogp_mean - want[0]) < 1e-5 and abs(got[m].neglogp_disp - want[1]) < 1e-5


@pytest.mark.parametrize("side", ["mean", "var"])
def test_one_side_is_permuted(spark, side):
    cross = small(spark, "bc", n=70, markers=4, missing=0.2)
    got = dispersion.scanone_var_perm(cross, "t", side, 3, seed=5, maxit=100, tol=1e-8).collect()
    assert got == dispersion.scanone_var_perm(cross, "t", side, 3, seed=5, maxit=100, tol=1e-8).collect() and len({round(r.max_neglogp, 8) for r in got}) == 3
    # One replicate by hand: who has whose genotype follows from the joined rows.
    rows, _ = dispersion._rows(cross, "t", None, None, None, 3, side, 5)
    y, a = values(cross), additive_by_locus(cross)
    geno = {r.ind: (tuple(r.m), tuple(r.g)) for r in hmm.sequences(cross).collect()}
    by = {}
    for i in range(70):
        by.setdefault(geno[i], i)
    at = {v: k for k, v in enumerate(y)}
    first = [(at[r.y], by[tuple(r.m), tuple(r.g)], by[tuple(r.m2), tuple(r.g2)]) for r in rows.where("rep = 1").collect()]
    assert len(first) == 70 and sorted(k for k, _, _ in first) == list(range(70))
    who, m, d = (np.array(x) for x in zip(*sorted(first), strict=True))
    kept = d if side == "mean" else m
    assert all(geno[i] == geno[j] for i, j in zip(who.tolist(), kept.tolist(), strict=True))
    best = max(plain(x[m], x[d], y, np.zeros((70, 0)), np.zeros((70, 0)))[0 if side == "mean" else 1] for x in a.values())
    assert abs(best - got[0].max_neglogp) < 1e-4


@pytest.mark.parametrize("kind,dominance", [("f2", True), ("f2", False), ("bc", True)])
def test_forward_selection_equals_stepwise_least_squares(spark, kind, dominance):
    r = np.random.default_rng(7)
    n, markers, k = 150, 200, chains.n_states(kind)
    step = chains.transition(kind, 0.1)
    g = np.zeros((n, markers), int)
    for i in range(n):
        g[i, 0] = r.choice(k, p=chains.initial(kind))
        for m in range(1, markers):
            g[i, m] = r.choice(k, p=step[g[i, m - 1]])
    g[:, 50] = g[:, 49]  # a marker that repeats its neighbour
    y = 0.8 * g[:, 20] - 0.7 * (g[:, 120] == 1) + 0.5 * g[:, 180] + r.normal(size=n)
    geno = spark.createDataFrame([(i, "1", f"m{m}", m + 1, int(g[i, m]) + 1) for i in range(n) for m in range(markers)], "ind long, chr string, marker string, ord int, g int")
    map_ = spark.createDataFrame([("1", "A", f"m{m}", m + 1, 10.0 * m, None) for m in range(markers)], "chr string, chrtype string, marker string, ord int, pos double, pos_male double")
    people = spark.createDataFrame([(i, str(i), None, None, None) for i in range(n)], "ind long, id string, sex int, pgm int, strata string")
    cross = Cross(geno, spark.createDataFrame([(i, "t", float(v)) for i, v in enumerate(y)], "ind long, trait string, y double"), map_, people, kind)
    got = forward.forward_selection(cross, "t", 8, dominance, error=1e-12).orderBy("step").collect()
    hot = forward.marker_columns(np.eye(k)[g], dominance)
    x, chosen = np.ones((n, 1)), []
    for s in range(8):
        rss = [np.inf if m in chosen else ((y - (z := np.column_stack([x, hot[:, m]])) @ np.linalg.lstsq(z, y, rcond=1e-10)[0]) ** 2).sum() for m in range(markers)]
        best = int(np.argmin(np.round(rss, 8)))
        assert got[s].marker == f"m{best}" and abs(got[s].rss - rss[best]) < 1e-6
        chosen.append(best)
        x = np.column_stack([x, hot[:, best]])
    assert forward.forward_selection(cross.with_(pheno=cross.pheno.where("false")), "t", 3).count() == 0
