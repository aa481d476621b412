"""Marker quality, pairwise linkage, crossovers and comparison of individuals."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossloom.model import Cross
from crossloom.operators.graph import connected_components
from crossloom.operators.pair_cells import pair_cells


def geno_table(cross: Cross) -> DataFrame:
    """chr, marker, n_missing, counts n1..nK (and partial n4, n5 in an f2), chi2 of segregation over full codes, df."""
    expect = {"f2": (0.25, 0.5, 0.25), "4way": (0.25,) * 4, "bcsft": (0.25, 0.5, 0.25)}.get(cross.crosstype, (0.5, 0.5))
    k = len(expect)
    codes = range(1, 6) if cross.crosstype in ("f2", "bcsft") else range(1, k + 1)
    n_ind = cross.individual.agg(F.count(F.lit(1)).alias("n_ind"))
    got = cross.geno.groupBy("marker").agg(F.count("g").alias("typed"), *(F.sum((F.col("g") == c).cast("long")).alias(f"n{c}") for c in codes))
    x = cross.map.select("chr", "marker").join(got, "marker", "left").join(F.broadcast(n_ind)).fillna(0)
    full = sum((F.col(f"n{c}") for c in range(2, k + 1)), F.col("n1"))
    chi2 = sum((F.pow(F.col(f"n{c}") - F.col("full") * p, 2) / (F.col("full") * p) for c, p in enumerate(expect[1:], 2)), F.pow(F.col("n1") - F.col("full") * expect[0], 2) / (F.col("full") * expect[0]))
    return x.withColumn("full", full.cast("double")).select("chr", "marker", (F.col("n_ind") - F.col("typed")).alias("n_missing"), *(f"n{c}" for c in codes), F.when(F.col("full") > 0, chi2).alias("chi2"), F.lit(k - 1).alias("df"))


def geno_table_em(cross: Cross, tol: float = 1e-6, maxit: int = 1000) -> DataFrame:
    """marker, aa, ab, bb, stat, p: genotype shares of an intercross by EM where some genotypes are known in part only, and a likelihood
    ratio against the shares expected."""
    c = geno_table(cross).select("marker", *(f"n{k}" for k in range(1, 6)))
    expect = (0.25, 0.5, 0.25)

    def run(batches):
        import numpy as np
        import pandas as pd

        from crossloom.functions.stats import chi2_sf

        members = ((0,), (1,), (2,), (0, 1), (1, 2))
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, p = np.array(row[1:], float), np.array(expect)
                loglik = lambda q, n=n: sum(k * math.log(max(1e-300, sum(q[j] for j in s))) for k, s in zip(n, members, strict=True) if k)
                for _ in range(maxit if n.sum() else 0):
                    new = np.zeros(3)
                    for k, s in zip(n, members, strict=True):
                        for j in s:
                            new[j] += k * p[j] / max(1e-300, sum(p[i] for i in s))
                    new /= n.sum()
                    done = np.abs(new - p).max() < tol
                    p = new
                    if done:
                        break
                else:
                    if n.sum():
                        warnings.warn(f"geno_table_em: {row[0]} not settled after {maxit} rounds", stacklevel=2)
                stat = max(0.0, 2 * (loglik(p) - loglik(expect)))
                out.append((row[0], *map(float, p), stat, chi2_sf(stat, 2)))
            yield pd.DataFrame(out, columns=["marker", "aa", "ab", "bb", "stat", "p"])

    return c.mapInPandas(run, "marker string, aa double, ab double, bb double, stat double, p double")


def _pairs(cross: Cross) -> DataFrame:
    """m1, m2, g1, g2, n: counts over individuals for each pair of markers.

    Genotypes of an individual are gathered once; tasks count pairs by products of one-hot blocks (``pair_cells``), so the second
    shuffle carries a partial count for each task, pair and codes."""
    return pair_cells(cross.geno.where("g IS NOT NULL").groupBy("ind").agg(F.collect_list(F.struct("marker", "g")).alias("a")))


def est_rf(cross: Cross) -> DataFrame:
    """m1 < m2, rf, lod, n for every pair of markers. Two genotypes: closed form; an f2: EM on the nine counts."""
    counts = _pairs(cross)
    if cross.crosstype in ("bc", "riself", "risib", "dh", "haploid"):
        x = counts.groupBy("m1", "m2").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g1") != F.col("g2"), F.col("n")).otherwise(0)).alias("b"))
        a, b = F.col("n").cast("double"), F.col("b").cast("double")
        part = F.when(b > 0, b * F.log10(b / a)).otherwise(0.0) + F.when(b < a, (a - b) * F.log10(1 - b / a)).otherwise(0.0)
        r = F.col("b") / F.col("n")
        if cross.crosstype == "riself":
            r = r / (2 - 2 * r)
        elif cross.crosstype == "risib":
            r = r / (4 - 6 * r)
        return x.select("m1", "m2", r.alias("rf"), (part + a * math.log10(2)).alias("lod"), "n")
    wide = counts.groupBy("m1", "m2").agg(F.collect_list(F.struct("g1", "g2", "n")).alias("t"))
    return wide.mapInPandas(_em_rf(cross.crosstype), "m1 string, m2 string, rf double, lod double, n long")


def _em_rf(crosstype: str):
    def run(batches):
        import numpy as np
        import pandas as pd

        from crossloom.functions.chains import pair_rf

        for pdf in batches:
            out = []
            for m1, m2, t in zip(pdf["m1"], pdf["m2"], pdf["t"], strict=True):
                g = np.array([(x["g1"], x["g2"], x["n"]) for x in t])
                r, lod = pair_rf(crosstype, g[:, 0], g[:, 1], g[:, 2].astype(float))
                out.append((m1, m2, r, lod, int(g[:, 2].sum())))
            yield pd.DataFrame(out, columns=["m1", "m2", "rf", "lod", "n"])

    return run


def marker_lrt(cross: Cross) -> DataFrame:
    """LOD of association of each pair of markers: a likelihood ratio of their two-way table."""
    c = _pairs(cross)
    n1, n2 = Window.partitionBy("m1", "m2", "g1"), Window.partitionBy("m1", "m2", "g2")
    x = c.withColumns({"a": F.sum("n").over(n1), "b": F.sum("n").over(n2), "t": F.sum("n").over(Window.partitionBy("m1", "m2"))})
    return x.groupBy("m1", "m2").agg(F.sum(F.col("n") * (F.log10("n") + F.log10("t") - F.log10("a") - F.log10("b"))).alias("lod"), F.sum("n").alias("n"))


def check_alleles(rf: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Markers whose largest LOD with rf > 1/2 exceeds the largest with rf < 1/2 by ``threshold``."""
    both = rf.select("m1", "rf", "lod").unionByName(rf.select(F.col("m2").alias("m1"), "rf", "lod"))
    top = both.groupBy(F.col("m1").alias("marker")).agg(F.coalesce(F.max(F.when(F.col("rf") > 0.5, F.col("lod"))), F.lit(0.0)).alias("hi"), F.coalesce(F.max(F.when(F.col("rf") < 0.5, F.col("lod"))), F.lit(0.0)).alias("lo"))
    return top.select("marker", (F.col("hi") - F.col("lo")).alias("diff")).where(F.col("diff") >= threshold)


def form_linkage_groups(markers: DataFrame, rf: DataFrame, max_rf: float = 0.25, min_lod: float = 3.0) -> DataFrame:
    """marker, lg: groups linked by rf <= max_rf and lod > min_lod, numbered from the largest (ties: by first marker)."""
    ids = markers.select("marker").distinct().withColumn("k", F.row_number().over(Window.orderBy("marker")))
    near = rf.where((F.col("rf") <= max_rf) & (F.col("lod") > min_lod))
    e = near.join(ids.select(F.col("marker").alias("m1"), F.col("k").alias("a")), "m1").join(ids.select(F.col("marker").alias("m2"), F.col("k").alias("b")), "m2")
    comp = connected_components(e.select("a", "b"))
    x = ids.join(comp, ids.k == comp.node, "left").select("marker", F.coalesce("component", "k").alias("c"))
    size = x.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("lg", F.row_number().over(Window.orderBy(F.desc("n"), "c")))
    return x.join(size, "c").select("marker", "lg")


def _steps(cross: Cross) -> DataFrame:
    """Each typed genotype with the typed one before it on the chromosome."""
    w = Window.partitionBy("ind", "chr").orderBy("ord")
    g = cross.geno.where("g IS NOT NULL").join(cross.map.select("marker", "pos"), "marker")
    return g.withColumns({"g0": F.lag("g").over(w), "pos0": F.lag("pos").over(w), "ord0": F.lag("ord").over(w)})


def _crossings(crosstype: str):
    """Obligate crossovers between two neighbouring typed genotypes."""
    if crosstype in ("f2", "bcsft"):
        full = F.when((F.col("g") <= 3) & (F.col("g0") <= 3), F.abs(F.col("g") - F.col("g0")))
        code = lambda a, b: (F.col("g") == a) & (F.col("g0") == b) | (F.col("g") == b) & (F.col("g0") == a)
        return full.when(code(4, 3) | code(5, 1), 1).otherwise(0)
    if crosstype == "4way":
        a = lambda c: F.when(F.col(c).isin(1, 3, 5), 0).when(F.col(c).isin(2, 4, 6), 1)
        b = lambda c: F.when(F.col(c).isin(1, 2, 7), 0).when(F.col(c).isin(3, 4, 8), 1)
        return F.coalesce((a("g") != a("g0")).cast("int"), F.lit(0)) + F.coalesce((b("g") != b("g0")).cast("int"), F.lit(0))
    return (F.col("g") != F.col("g0")).cast("int")


def count_xo(cross: Cross, by_chr: bool = False) -> DataFrame:
    """n_xo of each individual (and chromosome), 0 included."""
    keys = ["ind", "chr"] if by_chr else ["ind"]
    n = _steps(cross).where("g0 IS NOT NULL").groupBy(*keys).agg(F.sum(_crossings(cross.crosstype)).cast("long").alias("n"))
    base = cross.individual.select("ind")
    if by_chr:
        base = base.join(F.broadcast(cross.map.select("chr").distinct()))
    return base.join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_xo"))


def locate_xo(cross: Cross) -> DataFrame:
    """ind, chr, location (midpoint), left, right, left and right genotype for each interval with crossovers."""
    x = _steps(cross).where("g0 IS NOT NULL").where(_crossings(cross.crosstype) > 0)
    return x.select("ind", "chr", ((F.col("pos") + F.col("pos0")) / 2).alias("location"), F.col("pos0").alias("left"), F.col("pos").alias("right"), F.col("g0").alias("gleft"), F.col("g").alias("gright"), (F.col("ord") - F.col("ord0") - 1).alias("n_between"))


def compare_geno(cross: Cross) -> DataFrame:
    """ind1 < ind2, n (typed in both), n_match, prop for all pairs of individuals that share a typed marker.

    The result has a row for each pair, so it grows with the square of the individuals. It is a pairwise comparison by definition.
    ``summary_compare_geno`` needs only close pairs."""
    one = cross.geno.where("g IS NOT NULL").groupBy("ind").agg(F.map_from_entries(F.collect_list(F.struct("marker", "g"))).alias("m"))
    a, b = one.select(F.col("ind").alias("ind1"), F.col("m").alias("m1")), one.select(F.col("ind").alias("ind2"), F.col("m").alias("m2"))
    x = a.join(b, F.col("ind1") < F.col("ind2"))
    both = F.array_intersect(F.map_keys("m1"), F.map_keys("m2"))
    same = F.size(F.filter(both, lambda k: F.element_at("m1", k) == F.element_at("m2", k)))
    return x.select("ind1", "ind2", F.size(both).alias("n"), same.alias("n_match")).where("n > 0").withColumn("prop", F.col("n_match") / F.col("n"))


def summary_compare_geno(pairs: DataFrame, thresh: float = 0.9) -> DataFrame:
    return pairs.where(F.col("prop") > thresh)


def geno_crosstab(cross: Cross, m1: str, m2: str) -> DataFrame:
    """g1, g2, n over all individuals; missing is null."""
    side = lambda m, c: cross.geno.where(F.col("marker") == m).select("ind", F.col("g").alias(c))
    x = cross.individual.select("ind").join(side(m1, "g1"), "ind", "left").join(side(m2, "g2"), "ind", "left")
    return x.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"))


def typing_gap(cross: Cross, terminal: bool = False) -> DataFrame:
    """Longest gap between typed markers of each individual and chromosome; terminal: also to the chromosome's ends."""
    span = cross.map.groupBy("chr").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    inner = _steps(cross).groupBy("ind", "chr").agg(F.max(F.col("pos") - F.col("pos0")).alias("g"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    x = cross.individual.select("ind").join(F.broadcast(span)).join(inner, ["ind", "chr"], "left")
    gap = F.greatest("g", F.col("a") - F.col("lo"), F.col("hi") - F.col("b")) if terminal else F.col("g")
    return x.select("ind", "chr", F.coalesce(gap, F.when(F.col("a").isNull(), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("gap"))


def calculate_density(map_: DataFrame, distance: float = 30) -> DataFrame:
    near = F.expr(f"count(1) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN {distance}D PRECEDING AND {distance}D FOLLOWING)")
    return map_.select("marker", near.alias("density"))


def score_missing(cross: Cross) -> DataFrame:
    """Share of missing genotypes of each marker."""
    n = cross.individual.agg(F.count(F.lit(1)).alias("n"))
    got = cross.geno.groupBy("marker").agg(F.count("g").alias("t"))
    return cross.map.select("marker").join(got, "marker", "left").join(F.broadcast(n)).select("marker", (1 - F.coalesce("t", F.lit(0)) / F.col("n")).alias("missing"))


def check_distances(map_: DataFrame, cofactors: DataFrame, dist: float = 5) -> DataFrame:
    """Cofactors (marker) that are at least ``dist`` away from every other one on their chromosome: of a pair that is closer, both go."""
    c = map_.join(cofactors.select("marker"), "marker").select("chr", "marker", "pos")
    w = Window.partitionBy("chr").orderBy("pos", "marker")
    gaps = c.withColumns({"before": F.col("pos") - F.lag("pos").over(w), "after": F.lead("pos").over(w) - F.col("pos")})
    return gaps.where(F.least(F.coalesce("before", F.lit(float("inf"))), F.coalesce("after", F.lit(float("inf")))) >= dist).select("chr", "marker", "pos")


def pick_marker_subset(map_: DataFrame, min_distance: float, weights: DataFrame | None = None) -> DataFrame:
    """marker: a subset of each chromosome with the largest total weight and spacing of at least ``min_distance``.

    Dynamic programming over a chromosome's markers, a task for each chromosome; ties go to the earlier marker."""
    w = map_.select("chr", "marker", "pos", F.lit(1.0).alias("weight")) if weights is None else map_.join(weights, "marker").select("chr", "marker", "pos", "weight")

    def best(pdf):
        import numpy as np

        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        pos, weight = pdf["pos"].to_numpy(), pdf["weight"].to_numpy()
        n = len(pos)
        total, back = weight.copy(), np.full(n, -1)
        lead = np.full(n, -1)  # best predecessor among 0..i
        for i in range(n):
            j = int(np.searchsorted(pos, pos[i] - min_distance + 1e-9, "right")) - 1
            if j >= 0 and (k := lead[min(j, i - 1)] if i else -1) >= 0:
                total[i], back[i] = weight[i] + total[k], k
            lead[i] = i if i == 0 or total[i] > total[lead[i - 1]] else lead[i - 1]
        at, out = lead[-1], []
        while at >= 0:
            out.append(at)
            at = back[at]
        return pdf.iloc[sorted(out)][["chr", "marker"]]

    return w.groupBy("chr").applyInPandas(best, "chr string, marker string")
