"""Registered queries of models that are fitted by iteration: interference, mixtures over sequences, one and two loci with covariates, dispersion, forward
selection. What SQL can't iterate has no oracle; tests compare these operators with plain versions in numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossloom.operators import dispersion, effects, forward, hmm, locus_models, mapfit, mixture, profiles, qtl, scan
from crossloom.plans.crosswalk import sales_cross
from crossloom.queries import INEXACT, ORACLES, QUERIES, _bc, _f2, query
from crossloom.queries_more import f2_prob


def _rank(cross):
    """The order's priority as a covariate."""
    return cross.individual.select("ind", F.lit("rank").alias("name"), F.substring("strata", 1, 1).cast("double").alias("value"))


@query()
def mqm_augment_on_cofactors(spark, d):
    return mixture.augment_on_cofactors(_bc(spark, d), ["M2", "M3", "M6"])


@query()
def mqm_scan_ml(spark, d):
    """By maximum likelihood, with dominance."""
    return mixture.mqm_scan(_f2(spark, d), "price", ["M2", "M6"], step=10.0, ml=True, dominance=True)[0]


@query()
def est_map_interference(spark, d):
    return hmm.est_map(_bc(spark, d), m=2, p=0.1)[0]


@query()
def fit_stahl(spark, d):
    return mapfit.fit_stahl(_bc(spark, d))


@query()
def est_map_sexes(spark, d):
    """Lines' flags make the mother's alleles, their status the father's."""
    return hmm.est_map(sales_cross(spark, d, "4way"))[0]


@query()
def scanone_em_covar(spark, d):
    c = _f2(spark, d)
    return locus_models.scanone_model(c, "price", covar=_rank(c), addcovar=["rank"])


@query()
def scanone_binary_em_covar(spark, d):
    c = _f2(spark, d)
    return locus_models.scanone_model(c, "done", binary=True, covar=_rank(c), addcovar=["rank"], intcovar=["rank"])


@query()
def scantwo_em(spark, d):
    return locus_models.scantwo_model(_f2(spark, d), "price")


@query()
def scantwo_em_covar(spark, d):
    c = _bc(spark, d)
    return locus_models.scantwo_model(c, "price", covar=_rank(c), addcovar=["rank"])


@query()
def scantwo_binary_hk(spark, d):
    return locus_models.scantwo_model(_bc(spark, d), "done", "hk", True)


@query()
def scantwo_binary_em(spark, d):
    return locus_models.scantwo_model(_bc(spark, d), "done", "em", True)


@query()
def scanone_perm_em(spark, d):
    return locus_models.scanone_model_perm(_bc(spark, d), "price", 20)


@query()
def scantwo_perm_binary(spark, d):
    return locus_models.scantwo_model_perm(_bc(spark, d), "done", 10, "hk", True)


@query()
def scanone_dispersion(spark, d):
    return dispersion.scanone_var(_f2(spark, d), "price")


@query()
def scanone_mean_perm(spark, d):
    return dispersion.scanone_var_perm(_bc(spark, d), "price", "mean", 2)


@query()
def scanone_var_perm(spark, d):
    return dispersion.scanone_var_perm(_bc(spark, d), "price", "var", 2)


@query()
def forward_markers(spark, d):
    return forward.forward_selection(_f2(spark, d), "price", 7)


@query()
def fit_qtl_binary_draws(spark, d):
    """Each term dropped from a logistic model on imputations."""
    c = _bc(spark, d)
    got = qtl.Model(c, "done", method="imp", n_draws=8).fit_binary(qtl.make_qtl(c, ["1", "2"], [10.0, 0.0]), "y~Q1*Q2")
    return spark.createDataFrame(got["dropone"], "term string, df int, lod double, p_chi2 double")


_SUMS = "regr_sxx(y, x) AS sxx, regr_sxx(y, z) AS szz, regr_sxy(z, x) AS sxz, regr_sxy(y, x) AS sxy, regr_sxy(y, z) AS szy, regr_syy(y, x) AS syy"
INEXACT["effect_scan_intercross"] = "a se_a d se_d"


@query(f2_prob(10) + f""", e AS (SELECT chr, pos, CAST(ord AS INT) AS ord, locus, count(*) AS n, {_SUMS} FROM (SELECT *, p3 - p1 AS x, p2 AS z FROM prob JOIN pheno USING (ind)) GROUP BY ALL),
b AS (SELECT *, sxx * szz - sxz * sxz AS det, (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS a, (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS d FROM e)
SELECT chr, pos, ord, locus, a, sqrt((syy - a * sxy - d * szy) / (n - 3) * szz / det) AS se_a, d, sqrt((syy - a * sxy - d * szy) / (n - 3) * sxx / det) AS se_d FROM b""")
def effect_scan_intercross(spark, d):
    return effects.effect_scan(_f2(spark, d), "price")


for _table in (QUERIES, ORACLES, INEXACT):
    _table["effect_scan"] = _table["effect_scan_intercross"]


def _by_priority(cross):
    """A trait for each priority: the prices of its orders."""
    own = cross.pheno.where("trait = 'price'").join(cross.individual.select("ind", "strata"), "ind")
    return cross.with_(pheno=own.select("ind", F.concat(F.lit("price"), F.substring("strata", 1, 1)).alias("trait"), "y"))


def _priority_scan(spark, d):
    c = _by_priority(_f2(spark, d))
    return scan.scan_mr(c, [f"price{k}" for k in range(1, 6)])


INEXACT["trait_distances"] = "distance"


@query(""", cell AS (SELECT 'price' || substr(strata, 1, 1) AS trait, marker, g, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM g2 JOIN pheno USING (ind) GROUP BY ALL),
l AS (SELECT trait, marker, greatest(0, sum(n) / 2.0 * log10((sum(q) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s * s / n)))) AS lod FROM cell GROUP BY ALL)
SELECT a.trait AS trait1, b.trait AS trait2, sqrt(sum((a.lod - b.lod) ** 2)) AS distance FROM l a JOIN l b ON a.marker = b.marker AND a.trait < b.trait GROUP BY ALL""")
def trait_distances(spark, d):
    names, far = profiles.trait_distances(_priority_scan(spark, d))
    return spark.createDataFrame([(a, b, float(far[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j], "trait1 string, trait2 string, distance double")


@query()
def cluster_traits(spark, d):
    return profiles.cluster_traits(_priority_scan(spark, d))[0]
