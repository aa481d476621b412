"""Effects of loci, MQM scans with cofactors, variance scans, marker orders."""

from __future__ import annotations

import itertools
import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossloom.functions import chains
from crossloom.functions.maps import np_imf
from crossloom.functions.stats import f_quantile, shapiro_wilk
from crossloom.model import Cross
from crossloom.operators.hmm import est_map
from crossloom.operators.linkage import calculate_density, score_missing
from crossloom.operators.qtl import Model, Qtl
from crossloom.operators.scan import design, locus_sums, moments
from crossloom.operators.sums import TaskSums, added, gram
from crossloom.runtime import materialise, prepare


def effect_plot(cross: Cross, trait: str, marker1: str, marker2: str | None = None) -> DataFrame:
    """Means and standard errors of the trait for each genotype of one or two markers."""
    side = lambda m, c: cross.geno.where(F.col("marker") == m).select("ind", F.col("g").alias(c))
    x = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull()).join(side(marker1, "g1"), "ind")
    keys = ["g1"]
    if marker2:
        x, keys = x.join(side(marker2, "g2"), "ind"), ["g1", "g2"]
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def effect_scan(cross: Cross, trait: str, **grid) -> DataFrame:
    """Additive (and dominance) effects at each locus, by regression on probabilities, with standard errors."""
    table, t = design(cross, trait, **grid)

    def equations(_, p, y, z, w):
        k = p.shape[2]
        cols = [np.ones((*p.shape[:2], 1)), (p @ (np.arange(k) - (k - 1) / 2))[:, :, None] * (1 if k == 3 else 2 / max(1, k - 1))]
        if k == 3:
            cols.append(p[:, :, [1]])
        x = np.concatenate([*cols, np.broadcast_to(y[:, None, None], (*p.shape[:2], 1))], axis=2)
        return gram(x).reshape(p.shape[1], -1)

    rows = []
    for (c, k), s in locus_sums(table, t, equations).items():
        d = math.isqrt(len(s))
        g = s.reshape(d, d)
        inv = np.linalg.pinv(g[:-1, :-1])
        b = inv @ g[:-1, -1]
        s2 = (g[-1, -1] - b @ g[:-1, -1]) / max(1.0, g[0, 0] - d + 1)
        se = np.sqrt(np.maximum(0, np.diag(inv) * s2))
        rows.append((c, float(t[c].pos[k]), k + 1, t[c].names[k], float(b[1]), float(se[1]), float(b[2]) if d > 3 else None, float(se[2]) if d > 3 else None))
    return cross.geno.sparkSession.createDataFrame(rows, "chr string, pos double, ord int, locus string, a double, se_a double, d double, se_d double")


# MQM


def mqm_set_cofactors(cross: Cross, each: int) -> DataFrame:
    """Every n-th marker of the map."""
    n = F.row_number().over(Window.orderBy("chr", "ord"))
    return cross.map.withColumn("k", n).where(F.col("k") % each == 0).select("marker")


def mqm_auto_cofactors(cross: Cross, num: int = 50, distance: float = 5.0) -> list[str]:
    """Greedily the marker with the most neighbours and the most missing data, away from those chosen."""
    m = cross.map.join(calculate_density(cross.map), "marker").join(score_missing(cross), "marker").select("chr", "marker", "pos", (F.col("density") * (F.col("missing") + 1e-9)).alias("score"))
    left, out = sorted(m.collect(), key=lambda r: (-r["score"], r["chr"], r["pos"])), []
    while left and len(out) < num:
        best = left[0]
        out.append(best["marker"])
        left = [r for r in left if r["chr"] != best["chr"] or abs(r["pos"] - best["pos"]) >= distance]
    return out


def cofactor_scan(cross: Cross, trait: str, cofactors: list[str] | None = None, significance: float = 0.02, window: float = 25.0, step: float = 5.0) -> tuple[DataFrame, list[str]]:
    """Regression scan with marker cofactors: backward elimination by F tests, then each locus with the cofactors that are left outside its window.
    ``mixture.mqm_scan`` fits the mixture."""
    model = Model(cross, trait, step=step)
    where = {x[2]: x for x in model.all_loci()}
    left = [where[c] for c in cofactors or []]
    while left:
        terms = frozenset(frozenset([f"Q{k + 1}"]) for k in range(len(left)))
        fit = model.fit(Qtl(tuple(left)), terms)
        name, d, _, _, f, _, _ = min(fit["dropone"], key=lambda r: r[4])
        if f >= f_quantile(1 - significance, d, max(1, model.n - fit["df"] - 1)):
            break
        left.pop(int(name[1:]) - 1)
    rows, groups = [], {}
    for x in model.all_loci():
        near = tuple(i for i, q in enumerate(left) if q[0] == x[0] and abs(q[1] - x[1]) <= window)
        groups.setdefault(near, []).append(x)
    for near, loci in groups.items():
        rest = Qtl(tuple(q for i, q in enumerate(left) if i not in near))
        rows += [(c, p, model.tracks[c].names.index(n) + 1, n, trait, max(0.0, lod)) for c, p, n, lod in model.add_qtl(rest, None, None, loci)]
    return model.spark.createDataFrame(rows, "chr string, pos double, ord int, locus string, trait string, lod double"), [x[2] for x in left]


def mqm_test_normal(cross: Cross, trait: str, significance: float = 0.05, most: int = 5000) -> bool | None:
    """Is the trait normal by the Shapiro-Wilk test? None outside 3 to 5000 individuals, for which the test isn't defined."""
    own = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull())
    n = own.count()
    return shapiro_wilk(own.select("y").toPandas()["y"].to_numpy())[1] > significance if 3 <= n <= most else None


# Mean and variance


def scanone_var(cross: Cross, trait: str, maxit: int = 25, tol: float = 1e-6, **grid) -> DataFrame:
    """lod_mean, lod_var, lod_both at each locus: normal mean and log-linear variance, fitted in turns from summed equations."""
    table, t = design(cross, trait, alike=True, **grid)
    k = {c: chains.n_states(cross.crosstype, x.chrtype) for c, x in t.items()}
    m = moments(table.where(F.col("chr") == sorted(t)[0]))

    def fit(mean_on: bool, var_on: bool) -> dict:
        params = {(c, j): np.concatenate([[m["m"]], np.zeros(k[c] - 1), [math.log(m["v"])], np.zeros(k[c] - 1)]) for c, x in t.items() for j in range(len(x.pos))}
        ll: dict = {}
        open_ = set(params)
        for _ in range(maxit):
            mine = {c: np.array([params[c, j] for j in range(len(x.pos))]) for c, x in t.items()}

            def sums(name, p, y, z, w, times, mine=mine):
                q = p.shape[2]
                x = np.concatenate([np.ones((*p.shape[:2], 1)), p[:, :, 1:]], axis=2)
                b, g = mine[name][:, :q], mine[name][:, q:]
                mu, lv = (x * b[None]).sum(2), np.clip((x * g[None]).sum(2), -50, 50)
                r2, v = (y[:, None] - mu) ** 2, np.exp(lv)
                n = times[:, None]
                a = gram(x * (n / v)[:, :, None], x).reshape(len(b), -1)
                u = np.einsum("nla,nl->la", x, n * y[:, None] / v)
                h = gram(x * n[:, :, None], x).reshape(len(b), -1) / 2
                s = np.einsum("nla,nl->la", x, n * (r2 / v - 1) / 2)
                loglik = -0.5 * (n * (math.log(2 * math.pi) + lv + r2 / v)).sum(0)
                return np.concatenate([a, u, h, s, loglik[:, None]], axis=1)

            got = locus_sums(table, t, sums)
            for key in list(open_):
                q = k[key[0]]
                s = got[key]
                a, u, h, d = s[: q * q].reshape(q, q), s[q * q : q * q + q], s[q * q + q : 2 * q * q + q].reshape(q, q), s[2 * q * q + q : -1]
                if key in ll and abs(s[-1] - ll[key]) < tol * abs(s[-1]):
                    open_.discard(key)
                ll[key] = s[-1]
                nb, ng = (q if mean_on else 1), (q if var_on else 1)
                new = params[key].copy()
                new[:nb] = np.linalg.lstsq(a[:nb, :nb], u[:nb], rcond=1e-12)[0]
                new[q : q + ng] += np.linalg.lstsq(h[:ng, :ng], d[:ng], rcond=1e-12)[0]
                params[key] = new
            if not open_:
                break
        if open_:
            warnings.warn(f"scanone_var: {len(open_)} of {len(params)} loci not settled after {maxit} rounds", stacklevel=3)
        return ll

    both, mean, var, none = fit(True, True), fit(True, False), fit(False, True), fit(False, False)
    rows = [(c, float(t[c].pos[j]), j + 1, t[c].names[j], *(float(max(0.0, x)) for x in ((both[c, j] - var[c, j]) / math.log(10), (both[c, j] - mean[c, j]) / math.log(10), (both[c, j] - none[c, j]) / math.log(10)))) for c, j in both]
    return cross.geno.sparkSession.createDataFrame(rows, "chr string, pos double, ord int, locus string, lod_mean double, lod_var double, lod_both double")


# Marker orders


def window_orders(n: int, window: int) -> list[tuple[int, ...]]:
    """Orders of n markers that differ within one sliding window only; a full permutation and its reverse are one order."""
    seen, out = set(), []
    for start in range(max(1, n - window + 1)):
        inside = range(start, min(n, start + window))
        for p in itertools.permutations(inside):
            o = (*range(start), *p, *range(start + len(p), n))
            if o not in seen and (window < n or o[::-1] not in seen):
                seen.add(o)
                out.append(o)
    return out


def _patterns(cross: Cross, chr_: str) -> DataFrame:
    """a (typed ord and g in order), k: genotype patterns of a chromosome and how many individuals have them."""
    one = cross.geno.where((F.col("chr") == chr_) & F.col("g").isNotNull()).groupBy("ind").agg(F.array_sort(F.collect_list(F.struct("ord", "g"))).alias("a"))
    return one.groupBy("a").agg(F.count(F.lit(1)).alias("k"))


def _matrix(pdf: pd.DataFrame, n: int) -> np.ndarray:
    out = np.zeros((len(pdf), n), np.int64)
    for row, a in zip(out, pdf["a"], strict=True):
        for x in a:
            row[x["ord"] - 1] = x["g"]
    return out


def _order_counts(patterns: DataFrame, n: int, orders: list[tuple[int, ...]], f2: bool) -> DataFrame:
    """k, n_xo: obligate crossovers between neighbours among the typed markers, for each of the orders (which may leave markers out)."""
    table = np.array(orders)

    def run(batches):
        total = np.zeros(len(orders), np.int64)
        for pdf in batches:
            for g, k in zip(_matrix(pdf, n), pdf["k"], strict=True):
                seq = g[table]
                last, xo = np.zeros(len(orders), np.int64), np.zeros(len(orders), np.int64)
                for j in range(table.shape[1]):
                    now = seq[:, j]
                    both = (now > 0) & (last > 0)
                    d = np.where((now <= 3) & (last <= 3), np.abs(now - last), ((now == 4) & (last == 3)) | ((now == 3) & (last == 4)) | ((now == 5) & (last == 1)) | ((now == 1) & (last == 5))) if f2 else (now != last).astype(int)
                    xo += np.where(both, d, 0)
                    last = np.where(now > 0, now, last)
                total += k * xo
        yield pd.DataFrame({"k": np.arange(len(orders), dtype=np.int32), "n": total})

    return patterns.mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n_xo"))


def ripple_count(cross: Cross, chr_: str, window: int = 4) -> DataFrame:
    """ord (array of old numbers from 1), n_xo: obligate crossovers of each order in a sliding window.

    Crossovers are counted between pairs of markers that are neighbours among an individual's typed ones; patterns of genotypes that repeat
    are counted once with their multiplicity, so individuals are reduced before any order is tried."""
    n = cross.map.where(F.col("chr") == chr_).count()
    orders = window_orders(n, min(window, n))
    sums = _order_counts(_patterns(cross, chr_), n, orders, cross.crosstype in ("f2", "bcsft"))
    names = cross.geno.sparkSession.createDataFrame([(k, [x + 1 for x in o]) for k, o in enumerate(orders)], "k int, ord array<int>")
    return names.join(sums, "k").select("ord", "n_xo")


def ripple_lik(cross: Cross, chr_: str, window: int = 4, error: float = 1e-4, map_function: str = "haldane", maxit: int = 4000, tol: float = 1e-6) -> DataFrame:
    """ord, lod (log10 likelihood over that of the present order), length (cM): each order in a sliding window with a map of its own by EM.

    A round is one pass over the distinct genotype patterns, for all orders that haven't settled; sums for each order and interval leave a task."""
    spark = cross.geno.sparkSession
    prepare(spark)
    n = cross.map.where(F.col("chr") == chr_).count()
    orders = window_orders(n, min(window, n))
    kind = cross.crosstype
    patterns = materialise(_patterns(cross, chr_), "patterns")
    r = {k: np.full(n - 1, 0.1) for k in range(len(orders))}
    ll: dict[int, float] = {}
    open_ = set(r)
    for _ in range(maxit):
        if not open_:
            break
        mine = {k: (np.array(orders[k]), r[k]) for k in sorted(open_)}

        def run(batches, mine=mine):
            sums = TaskSums()
            for pdf in batches:
                g, times = _matrix(pdf, n), pdf["k"].to_numpy(float)
                for k, (order, rr) in mine.items():
                    emit = chains.emissions(kind, g[:, order], error)
                    init, steps = chains.initial(kind, "A", cross_scheme), [chains.transition(kind, float(x), None, "A", cross_scheme) for x in rr]
                    loglik = (chains.forward(emit, init, steps)[1] * times).sum() / math.log(10)
                    pp = chains.pair_posterior(emit, init, steps)
                    expected = [float(((pp[:, j] * chains.crossings(kind, rr[j], pp.shape[2])).sum((1, 2)) * times).sum()) for j in range(n - 1)]
                    sums.add((k,), np.array([*expected, times.sum(), loglik]))
            yield pd.DataFrame([(k, list(v)) for k, v in sums.rows()], columns=["k", "s"])

        cross_scheme = cross.scheme
        for x in added(patterns.mapInPandas(run, "k int, s array<double>"), ["k"], "s").collect():
            k, s = x["k"], np.array(x["s"])
            new = np.clip(s[:-2] / s[-2], tol / 1000, 0.5 - tol / 1000)
            ll[k] = float(s[-1])
            if (np.abs(new - r[k]) <= tol * (np.abs(new) + 100 * tol)).all():
                open_.discard(k)
            r[k] = new
        open_ &= set(ll)
    if open_:
        warnings.warn(f"ripple_lik: {len(open_)} orders not settled after {maxit} rounds", stacklevel=2)
    base = ll.get(orders.index(tuple(range(n))), 0.0)
    rows = [([x + 1 for x in o], ll.get(k, 0.0) - base, float(np_imf(r[k], map_function).sum())) for k, o in enumerate(orders)]
    return spark.createDataFrame(rows, "ord array<int>, lod double, length double")


def summary_ripple(ripple: DataFrame, best: int = 10) -> DataFrame:
    """The present order and the best others: fewest crossovers, or highest LOD down to a tenth of a unit below the present order."""
    same = F.array_sort("ord") == F.col("ord")
    key = [F.col("n_xo"), F.col("ord")] if "n_xo" in ripple.columns else [F.desc("lod"), F.col("ord")]
    others = ripple.where(~same).orderBy(*key).limit(best)
    return ripple.where(same).unionByName(others).withColumn("initial", same)


def order_markers(cross: Cross, chr_: str, window: int = 7, ripple: bool = True) -> list[int]:
    """An order of a chromosome's markers by the fewest obligate crossovers: markers enter one by one, the most typed first, at the best of all
    places; then the best order of sliding windows is taken again and again until none is better. Up to ``window`` markers are only permuted.
    Ties go to the earlier place and to the present order."""
    n = cross.map.where(F.col("chr") == chr_).count()
    f2 = cross.crosstype in ("f2", "bcsft")
    if n < 3:
        return list(range(1, n + 1))
    patterns = materialise(_patterns(cross, chr_), "patterns")

    def counts(orders):
        got = {r["k"]: r["n_xo"] for r in _order_counts(patterns, n, orders, f2).collect()}
        return [got.get(k, 0) for k in range(len(orders))]

    order = tuple(range(n))
    if n > window or not ripple:
        typed = {r["ord"]: r["t"] for r in cross.geno.where((F.col("chr") == chr_) & F.col("g").isNotNull()).groupBy("ord").agg(F.count(F.lit(1)).alias("t")).collect()}
        queue = sorted(range(n), key=lambda k: (-typed.get(k + 1, 0), k))
        order = tuple(queue[:2])
        for m in queue[2:]:
            tries = [(*order[:k], m, *order[k:]) for k in range(len(order), -1, -1)]
            got = counts(tries)
            order = tries[int(np.argmin(got))]
    moving = ripple
    while moving:
        tries = [tuple(order[k] for k in o) for o in window_orders(n, min(window, n))]
        tries.sort(key=lambda o: o != order)
        got = counts(tries)
        best = int(np.argmin(got))
        moving = got[best] < got[0]
        order = tries[best] if moving else order
    if order[0] > order[-1]:
        order = order[::-1]
    return [k + 1 for k in order]


def compare_order(cross: Cross, chr_: str, order: list[int], **options) -> list[tuple[str, float, float]]:
    """(which, log10 likelihood, length in cM) of the present order and another one."""
    from crossloom.operators.edit import switch_order
    from crossloom.operators.meta import subset

    out = []
    for which, c in (("original", cross), ("new", switch_order(cross, chr_, order))):
        m, ll = est_map(subset(c, chr_), **options)
        span = m.agg(F.max("pos") - F.min("pos")).first()[0]
        out.append((which, ll.get(chr_, 0.0), span))
    return out


def drop_one_marker(cross: Cross, chr_: str, **options) -> list[tuple[str, float, float]]:
    """(marker, LOD of dropping it, change of the chromosome's length): positive LODs speak against the marker."""
    from crossloom.operators.edit import drop_markers, renumber
    from crossloom.operators.hmm import marker_loglik
    from crossloom.operators.meta import subset

    c = subset(cross, chr_)
    m0, ll0 = est_map(c, **options)
    span0 = m0.agg(F.max("pos") - F.min("pos")).first()[0]
    out = []
    for r in c.map.orderBy("ord").collect():
        rest = renumber(drop_markers(c, c.map.where(F.col("marker") == r["marker"]).select("marker")))
        m1, ll1 = est_map(rest, **options)
        out.append((r["marker"], ll1[chr_] + marker_loglik(c, r["marker"]) / math.log(10) - ll0[chr_], m1.agg(F.max("pos") - F.min("pos")).first()[0] - span0))
    return out


def try_all_positions(cross: Cross, marker: str, chr_: str, **options) -> list[tuple[float, float]]:
    """(position, LOD against being unlinked) of a marker at the middle of each interval of a chromosome and beyond its ends."""
    from crossloom.operators.edit import drop_markers, move_marker
    from crossloom.operators.hmm import marker_loglik
    from crossloom.operators.meta import subset

    rest = drop_markers(cross, cross.map.where(F.col("marker") == marker).select("marker"))
    _, ll0 = est_map(subset(rest, chr_), **options)
    base = ll0[chr_] + marker_loglik(cross, marker) / math.log(10)
    pos = [r["pos"] for r in rest.map.where(F.col("chr") == chr_).orderBy("pos").collect()]
    spots = [pos[0] - 10, *((a + b) / 2 for a, b in zip(pos, pos[1:], strict=False)), pos[-1] + 10]
    out = []
    for x in spots:
        _, ll = est_map(subset(move_marker(cross, marker, chr_, x), chr_), **options)
        out.append((x, ll[chr_] - base))
    return out


def all_chr_splits(cross: Cross, chr_: str, **options) -> list[tuple[str, str, float]]:
    """(left marker, right marker, LOD of keeping the chromosome together) for each interval."""
    from crossloom.operators.edit import renumber
    from crossloom.operators.meta import subset

    c = subset(cross, chr_)
    whole = est_map(c, **options)[1][chr_]
    markers = [r["marker"] for r in c.map.orderBy("ord").collect()]
    out = []
    for k in range(1, len(markers)):
        total = 0.0
        for part in (markers[:k], markers[k:]):
            own = renumber(c.with_(map=c.map.where(F.col("marker").isin(part)), geno=c.geno.where(F.col("marker").isin(part))))
            if len(part) > 1:
                total += est_map(own, **options)[1][chr_]
            else:
                from crossloom.operators.hmm import marker_loglik

                total += marker_loglik(own, part[0]) / math.log(10)
        out.append((markers[k - 1], markers[k], whole - total))
    return out


def scan_all(cross: Cross, scan_function, traits: list[str] | None = None) -> DataFrame:
    """A scan of every trait, one under the other. ``scan_function(cross, trait)`` gives a DataFrame."""
    out = None
    for t in traits or sorted(r["trait"] for r in cross.pheno.select("trait").distinct().collect()):
        one = scan_function(cross, t)
        out = one if out is None else out.unionByName(one)
    return out


def locate_traits(scans: DataFrame, locations: DataFrame) -> DataFrame:
    """Peaks of each trait beside the place of its own gene (name, chr, pos), with the distance if they share a chromosome."""
    from crossloom.operators.scan_results import max_scanone

    x = max_scanone(scans).join(locations.select(F.col("name").alias("trait"), F.col("chr").alias("own_chr"), F.col("pos").alias("own_pos")), "trait")
    return x.withColumn("distance", F.when(F.col("chr") == F.col("own_chr"), F.abs(F.col("pos") - F.col("own_pos"))))


def compare_crosses(a: Cross, b: Cross, tol: float = 1e-5) -> list[str]:
    """Names of what differs between two crosses; empty if nothing does."""
    out = [k for k in ("crosstype", "alleles", "scheme") if getattr(a, k) != getattr(b, k)]
    keys = {"geno": ["ind", "marker"], "pheno": ["ind", "trait"], "map": ["marker"]}
    value = {"geno": "g", "pheno": "y", "map": "pos"}
    for k, key in keys.items():
        v = value[k]
        x = getattr(a, k).select(*key, F.col(v).alias("_a")).join(getattr(b, k).select(*key, F.col(v).alias("_b")), key, "full_outer")
        if x.where(F.col("_a").isNull() != F.col("_b").isNull()).count() or x.where(F.abs(F.col("_a") - F.col("_b")) > tol).count():
            out.append(k)
    return out
