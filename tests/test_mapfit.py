import itertools

import numpy as np
import pytest
from crossloom.functions import chains
from crossloom.functions.maps import np_mf_stahl
from crossloom.model import Cross
from crossloom.operators import hmm, mapfit, sim


def brute(codes, kind, d, m, p, error):
    """Sums over all paths of (allele, stage), of one gamete or two, with transitions by summing over the number of points."""
    size = m + 1

    def step(x):
        lam, other, out = 2 * size * (1 - p) * x / 100, 0.5 * (1 - np.exp(-2 * p * x / 100)), np.zeros((2 * size, 2 * size))
        for a, s, n in itertools.product(range(2), range(size), range(120)):
            prob = np.exp(-lam + n * np.log(lam) - np.sum(np.log(np.arange(1, n + 1))))
            chi, s2 = divmod(s + n, size)
            rec = 0.0 if chi == 0 else 0.5
            rec = rec * (1 - other) + (1 - rec) * other
            for b in range(2):
                out[a * size + s, b * size + s2] += prob * (rec if a != b else 1 - rec)
        return out

    steps, emit = [step(x) for x in d], chains.emissions(kind, codes, error)
    states = list(range(2 * size)) if kind == "bc" else list(itertools.product(range(2 * size), repeat=2))
    geno = (lambda v: v // size) if kind == "bc" else (lambda v: v[0] // size + v[1] // size)
    move = (lambda j, u, v: steps[j][u, v]) if kind == "bc" else (lambda j, u, v: steps[j][u[0], v[0]] * steps[j][u[1], v[1]])
    recs = (lambda u, v: float(u // size != v // size)) if kind == "bc" else (lambda u, v: ((u[0] // size != v[0] // size) + (u[1] // size != v[1] // size)) / 2)
    total, out = 0.0, np.zeros(len(d))
    for path in itertools.product(states, repeat=len(codes)):
        w = emit[0, geno(path[0])] / len(states)
        for j in range(len(d)):
            w *= move(j, path[j], path[j + 1]) * emit[j + 1, geno(path[j + 1])]
        total += w
        out += w * np.array([recs(path[j], path[j + 1]) for j in range(len(d))])
    return out / total, np.log(total)


@pytest.mark.parametrize("kind,m,p,codes", [("bc", 2, 0.0, [1, 0, 2, 2, 1]), ("bc", 3, 0.2, [2, 1, 0, 1, 0]), ("bc", 0, 0.0, [1, 2, 2, 0, 1]), ("f2", 1, 0.3, [1, 4, 0, 3]), ("f2", 0, 0.0, [2, 5, 1, 3])])
def test_sums_over_paths(kind, m, p, codes):
    d = np.array([12.0, 3.0, 25.0, 8.0])[: len(codes) - 1]
    steps, rec = mapfit.gamete_steps(d, m, p)
    assert np.allclose(steps.sum(2), 1)
    x, ll = mapfit.expected_recombinations(mapfit.gamete_emissions(kind, np.array([codes]), 0.01, "A", m), np.ones(1), steps, rec)
    want, want_ll = brute(np.array(codes), kind, d, m, p, 0.01)
    assert np.allclose(x, want, atol=1e-10) and abs(ll - want_ll) < 1e-9
    # A gamete's recombinant share over an interval is the model's map function.
    assert np.allclose(rec.sum(2).mean(1), np_mf_stahl(d, m, p), atol=1e-12)


def interfering(spark, kind, m, n=500, seed=1, markers=9, gap=9.0, missing=0.03):
    """A chromosome with chiasmata by the chi-square model, drawn point by point."""
    r = np.random.default_rng(seed)
    pos = gap * np.arange(markers)

    def gamete():
        at = np.cumsum(r.exponential(50 / (m + 1), 400)) - 50 / (m + 1) * r.random()
        at = at[r.integers(0, m + 1) :: m + 1]
        at = at[r.random(len(at)) < 0.5]
        return (r.integers(0, 2) + np.searchsorted(at, pos)) % 2

    rows = []
    for i in range(n):
        g = gamete() + 1 if kind == "bc" else gamete() + gamete() + 1
        rows += [(i, "1", f"m{k}", k + 1, int(x)) for k, x in enumerate(g) if r.random() > missing]
    geno = spark.createDataFrame(rows, "ind long, chr string, marker string, ord int, g int")
    map_ = spark.createDataFrame([("1", "A", f"m{k}", k + 1, float(x), None) for k, x in enumerate(pos)], "chr string, chrtype string, marker string, ord int, pos double, pos_male double")
    people = spark.createDataFrame([(i, str(i), None, None, None) for i in range(n)], "ind long, id string, sex int, pgm int, strata string")
    return Cross(geno, spark.createDataFrame([], "ind long, trait string, y double"), map_, people, kind)


def test_order_zero_is_the_plain_map(spark):
    for kind in ("bc", "f2"):
        cross = interfering(spark, kind, 1, n=80, markers=4)
        plain, ll = hmm.est_map(cross)
        new, ll2 = mapfit.est_map_interference(cross, 0, 0.0)
        a, b = ({r.marker: r.pos for r in x.collect()} for x in (plain, new))
        assert max(abs(a[k] - b[k]) for k in a) < 0.01 and abs(ll["1"] - ll2["1"]) < 1e-3


def test_interference_is_found(spark):
    """Orders are compared until the likelihood falls; chiasmata were drawn with m = 4."""
    cross = interfering(spark, "bc", 4, n=400)
    given = {r.m: r.loglik for r in mapfit.fit_stahl(cross, m=list(range(9)), p=0.0, tol=1e-3).collect()}
    top = max(given, key=given.get)
    assert 2 <= top <= 7 and given[top] > given[0] + 5
    best = mapfit.fit_stahl(cross, p=0.0, max_m=2, tol=1e-3).collect()
    assert [(r.m, r.p) for r in best] == [(2, 0.0)] and abs(best[0].loglik - given[2]) < 1e-6


def test_share_without_interference_and_error(spark):
    cross = interfering(spark, "bc", 3, n=200, markers=6)
    both = mapfit.fit_stahl(cross, m=3, error=None, precision=0.2, tol=1e-3).collect()[0]
    fixed = mapfit.fit_stahl(cross, m=3, p=0.0, error=1e-4, tol=1e-3).collect()[0]
    assert both.loglik >= fixed.loglik - 0.05 and both.error_prob < 0.02 and 0 <= both.p < 0.6


def test_maps_of_both_sexes(spark):
    map_ = spark.createDataFrame([("1", "A", f"m{k}", k + 1, 10.0 * k, 10.0 * k) for k in range(6)], "chr string, chrtype string, marker string, ord int, pos double, pos_male double")
    r = np.random.default_rng(4)
    rows, n = [], 600
    for i in range(n):
        walk = lambda q: np.concatenate([[x0 := r.integers(0, 2)], (x0 + np.cumsum(r.random(5) < q)) % 2])
        g = 1 + walk(0.05) + 2 * walk(0.2)
        rows += [(i, "1", f"m{k}", k + 1, int(x)) for k, x in enumerate(g) if r.random() > 0.05]
    geno = spark.createDataFrame(rows, "ind long, chr string, marker string, ord int, g int")
    people = spark.createDataFrame([(i, str(i), None, None, None) for i in range(n)], "ind long, id string, sex int, pgm int, strata string")
    cross = Cross(geno, spark.createDataFrame([], "ind long, trait string, y double"), map_, people, "4way")
    new, ll = hmm.est_map(cross)
    end = {x.marker: (x.pos, x.pos_male) for x in new.collect()}["m5"]
    assert abs(end[0] - 5 * 5.27) < 5 and abs(end[1] - 5 * 25.5) < 20 and ll["1"] < 0


def test_other_crosses_have_no_interference(spark):
    cross = sim.sim_cross(interfering(spark, "bc", 0, n=10).map, "riself", 10)
    with pytest.raises(ValueError):
        mapfit.est_map_interference(cross, 2)
