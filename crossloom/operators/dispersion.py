"""Loci that act on a trait's mean and on its dispersion: alternating weighted normal and gamma fits, and permutations of either side.

The mean is a weighted regression on a locus' additive probability and covariates. Squared residuals, divided by one less their leverage, follow a gamma
model with logarithmic link on the locus and covariates of its own, and the inverse of its fit is the next weight. A round is two passes over individuals for all loci and replicates that aren't settled:
equations of the means, then, with leverages known, one reweighted step of the dispersions. Sums are added up in tasks and in Spark and solved in executors.

A permutation gives each individual the genotype of another for the mean's side, or for the dispersion's side, and its own for the other one; an individual's two
genotypes then come together by a join. Trait and covariates stay with the individual. A replicate's deal is the same for all loci."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.functions import chains
from crossloom.functions.stats import t_sf2
from crossloom.model import Cross
from crossloom.operators import scan as one_locus
from crossloom.operators.hmm import codes, sequences, tracks
from crossloom.operators.sums import TaskSums, added
from crossloom.runtime import materialise, prepare


def additive(p: np.ndarray) -> np.ndarray:
    """The probability of the first homozygote, plus half that of the heterozygote in an intercross."""
    return p[..., 0] + p[..., 1] / 2 if p.shape[-1] == 3 else p[..., 0]


def _wide(own: DataFrame, covar: DataFrame | None, names: list[str], out: str) -> DataFrame:
    if not names:
        return own.withColumn(out, F.array().cast("array<double>"))
    wide = covar.where("value IS NOT NULL AND NOT isnan(value)").groupBy("ind").pivot("name", names).agg(F.first("value"))
    return own.join(wide.select("ind", F.array(*(F.col(f"`{x}`").cast("double") for x in names)).alias(out)), "ind").where(f"NOT exists({out}, x -> x IS NULL)")


def _rows(cross: Cross, trait: str, covar, mean_covar, var_covar, n_perm: int, side: str, seed: int) -> tuple[DataFrame, int]:
    """rep, y, zm, zv, and the genotypes for the mean (m, g) and for the dispersion (m2, g2)."""
    own = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull() & ~F.isnan("y")).join(cross.individual.select("ind"), "ind", "left_semi").select("ind", "y")
    own = materialise(_wide(_wide(own, covar, list(mean_covar or []), "zm"), covar, list(var_covar or []), "zv"), "trait")
    n, geno = own.count(), sequences(cross)
    if not n_perm:
        return materialise(geno.join(own, "ind").select(F.lit(1).alias("rep"), "y", "zm", "zv", "m", "g", F.col("m").alias("m2"), F.col("g").alias("g2")), "people"), n
    index, deal = one_locus.numbered(own.select("ind", "y"), None, seed)
    index = materialise(index.select("ind", "i"), "index")

    @F.pandas_udf("long")
    def place(i: pd.Series, rep: pd.Series) -> pd.Series:
        out = np.zeros(len(i), np.int64)
        for r in rep.unique():
            some = (rep == r).to_numpy()
            out[some] = deal(i[some].to_numpy(), int(r) - 1)
        return pd.Series(out)

    full = materialise(geno.join(own, "ind").join(index, "ind").select("i", "y", "zm", "zv", "m", "g"), "people")
    dealt = full.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).withColumn("j", place("i", "rep")).drop("i")
    other = full.select(F.col("i").alias("j"), F.col("m").alias("m2"), F.col("g").alias("g2"))
    both = dealt.join(other, "j").drop("j")
    if side == "mean":  # the other's genotype is the mean's
        both = both.select("rep", "y", "zm", "zv", F.col("m2").alias("m"), F.col("g2").alias("g"), F.col("m").alias("m2"), F.col("g").alias("g2"))
    return materialise(both.select("rep", "y", "zm", "zv", "m", "g", "m2", "g2"), "people"), n


def _design(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(n, loci, columns): one, the locus, covariates."""
    n, loci = a.shape
    return np.concatenate([np.ones((n, loci, 1)), a[:, :, None], np.broadcast_to(z[:, None, :], (n, loci, z.shape[1]))], axis=2)


def _cross_products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.matmul((x * w[:, :, None]).transpose(1, 2, 0), x.transpose(1, 0, 2))


def mean_equations(x, d, y, state) -> np.ndarray:
    """(loci, numbers): X'WX, X'Wy, y'Wy."""
    w = np.exp(-np.clip((d * state["gamma"][None]).sum(2), -700, 700))
    b = np.einsum("nla,nl->la", x, w * y[:, None])
    return np.concatenate([_cross_products(x, w).reshape(x.shape[1], -1), b, (w * y[:, None] ** 2).sum(0)[:, None]], axis=1)


def dispersion_equations(x, d, y, state) -> np.ndarray:
    """(loci, numbers): D'PD, D'Pz, and the Pearson statistic, where P are the gamma model's weights and z its working response."""
    eta = np.clip((d * state["gamma"][None]).sum(2), -700, 700)
    w = np.exp(-eta)
    r = y[:, None] - (x * state["beta"][None]).sum(2)
    lever = np.minimum(w * np.einsum("nla,lab,nlb->nl", x, state["inverse"], x), 1 - 1e-9)
    ratio = r * r / (1 - lever) * w
    p = (1 - lever) / 2
    return np.concatenate([_cross_products(d, p).reshape(x.shape[1], -1), np.einsum("nla,nl->la", d, p * (eta + ratio - 1)), (p * (ratio - 1) ** 2).sum(0)[:, None]], axis=1)


def _fit(cross: Cross, trait: str, covar, mean_covar, var_covar, n_perm: int, side: str, seed: int, step: float, error: float, map_function: str, maxit: int, tol: float):
    """(replicate, chr) -> (p of the mean, p of the dispersion, settled) for each locus, and the tracks."""
    if cross.crosstype not in ("bc", "dh", "f2", "haploid", "risib", "riself"):
        raise ValueError("dispersion models are for backcrosses, intercrosses, doubled haploids, haploids and two-way lines")
    prepare(cross.geno.sparkSession)
    t, kind = {c: x for c, x in tracks(cross, step).items() if x.chrtype != "X"}, (cross.crosstype, cross.scheme)
    rows, n = _rows(cross, trait, covar, mean_covar, var_covar, n_perm, side, seed)
    if not n:
        return {}, t
    a, c = 2 + len(mean_covar or []), 2 + len(var_covar or [])
    logvar = math.log(max(rows.where("rep = 1").agg(F.var_pop("y")).first()[0] or 0.0, 1e-300))
    keys = [(r, name) for r in range(1, max(1, n_perm) + 1) for name in t]
    state = {}
    for r, name in keys:
        loci = len(t[name].pos)
        gamma = np.zeros((loci, c))
        gamma[:, 0] = logvar
        state[r, name] = {"gamma": gamma, "beta": np.zeros((loci, a)), "inverse": np.zeros((loci, a, a)), "y": np.zeros(loci), "pearson": np.zeros(loci), "curve": np.zeros((loci, c, c))}

    def swept(open_, phase):
        now = {key: {k: state[key][k] for k in ("gamma", "beta", "inverse")} for key in open_}
        names, reps = sorted({x for _, x in open_}), sorted({r for r, _ in open_})

        def task(batches):
            sums = TaskSums()

            def out():
                held = list(sums.rows())
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held]), pa.array([x[2].ravel() for x in held], pa.list_(pa.float64()))], names=["rep", "chr", "s"])

            for b in batches:
                if not b.num_rows:
                    continue
                rep, y = b.column("rep").to_numpy(), b.column("y").to_numpy()
                zm, zv = (b.column(k).flatten().to_numpy().reshape(len(b), -1) for k in ("zm", "zv"))
                second = b.select(["m2", "g2"]).rename_columns(["m", "g"])
                for name in names:
                    p = []
                    for part in (b, second):
                        emit = chains.emissions(kind[0], codes(part, t[name]), error, t[name].chrtype)
                        p.append(additive(chains.posterior(emit, chains.initial(kind[0], t[name].chrtype, kind[1]), t[name].steps(kind, map_function))))
                    for r in reps:
                        some = rep == r
                        if (r, name) in now and some.any():
                            x, d = _design(p[0][some], zm[some]), _design(p[1][some], zv[some])
                            sums.add((int(r), name), (mean_equations if phase == "mean" else dispersion_equations)(x, d, y[some], now[r, name]))
                if sums.full:
                    yield from out()
            yield from out()

        k = a if phase == "mean" else c

        def solve(batches):
            for pdf in batches:
                out = []
                for r, name, s in zip(pdf["rep"], pdf["chr"], pdf["s"], strict=True):
                    s = np.asarray(s).reshape(-1, k * k + k + 1)
                    inverse = np.linalg.pinv(s[:, : k * k].reshape(-1, k, k), rcond=1e-12, hermitian=True)
                    b = np.einsum("lab,lb->la", inverse, s[:, k * k : -1])
                    out.append((r, name, np.concatenate([b, inverse.reshape(len(b), -1), s[:, k * k : -1], s[:, -1:]], axis=1).ravel()))
                yield pd.DataFrame(out, columns=["rep", "chr", "s"])

        part = rows.mapInArrow(task, "rep int, chr string, s array<double>")
        for x in added(part, ["rep", "chr"], "s").mapInPandas(solve, "rep int, chr string, s array<double>").collect():
            s = np.array(x["s"]).reshape(-1, k + k * k + k + 1)
            yield (x["rep"], x["chr"]), s[:, :k], s[:, k : k + k * k].reshape(-1, k, k), s[:, k + k * k : -1], s[:, -1]

    open_, turn = set(keys), 0
    settled = {key: np.zeros(len(t[key[1]].pos), bool) for key in keys}
    while open_ and turn < maxit:
        turn += 1
        moved = {}
        for key, b, inverse, right, yy in swept(open_, "mean"):
            s = state[key]
            moved[key] = np.abs(b - s["beta"]).max(1) / np.maximum(np.abs(b).max(1), 1e-12)
            s["beta"], s["inverse"], s["y"] = b, inverse, yy - (b * right).sum(1)
        for key, g, inverse, _, pearson in swept(open_, "dispersion"):
            s = state[key]
            settled[key] = np.maximum(moved[key], np.abs(g - s["gamma"]).max(1)) <= tol
            s["gamma"], s["curve"], s["pearson"] = g, inverse, pearson
            if settled[key].all():
                open_.discard(key)
    if open_:
        warnings.warn(f"scanone_var: {sum(int((~settled[k]).sum()) for k in open_)} loci not settled after {maxit} rounds", stacklevel=3)
    out = {}
    for key in keys:
        s = state[key]
        se = np.sqrt(np.maximum(s["y"] / max(1, n - a) * s["inverse"][:, 1, 1], 1e-300))
        se_d = np.sqrt(np.maximum(s["pearson"] / max(1, n - c) * s["curve"][:, 1, 1], 1e-300))
        neglog = lambda x, se, df: np.array([-math.log10(max(t_sf2(float(b / e), df), 1e-300)) for b, e in zip(x, se, strict=True)])
        out[key] = neglog(s["beta"][:, 1], se, n - a), np.where(settled[key], neglog(s["gamma"][:, 1], se_d, n - c), 0.0), settled[key]
    return out, t


def scanone_var(cross: Cross, trait: str, covar: DataFrame | None = None, mean_covar: list[str] | None = None, var_covar: list[str] | None = None, step: float = 0.0, error: float = 1e-4, map_function: str = "haldane", maxit: int = 25, tol: float = 1e-6) -> DataFrame:
    """chr, pos, ord, locus, neglogp_mean, neglogp_disp: -log10 of the p values of the locus' effects on mean and dispersion. A locus that
    isn't settled has 0 for its dispersion, and a warning counts them. The X chromosome is left out."""
    got, t = _fit(cross, trait, covar, mean_covar, var_covar, 0, "mean", 1, step, error, map_function, maxit, tol)
    rows = [(c, float(t[c].pos[j]), j + 1, t[c].names[j], float(m[j]), float(d[j])) for (_, c), (m, d, _) in got.items() for j in range(len(m))]
    return cross.geno.sparkSession.createDataFrame(rows, "chr string, pos double, ord int, locus string, neglogp_mean double, neglogp_disp double")


def scanone_var_perm(cross: Cross, trait: str, side: str, n_perm: int = 2, seed: int = 27517, covar: DataFrame | None = None, mean_covar: list[str] | None = None, var_covar: list[str] | None = None, step: float = 0.0, error: float = 1e-4, map_function: str = "haldane", maxit: int = 25, tol: float = 1e-6) -> DataFrame:
    """rep, max_neglogp: the largest -log10 p of the permuted side (``mean`` or ``var``) over all loci, for each replicate."""
    if side not in ("mean", "var"):
        raise ValueError("side is mean or var")
    got, _ = _fit(cross, trait, covar, mean_covar, var_covar, n_perm, side, seed, step, error, map_function, maxit, tol)
    best: dict[int, float] = {}
    for (r, _), (m, d, _) in got.items():
        best[r] = max(best.get(r, 0.0), float((m if side == "mean" else d).max()))
    return cross.geno.sparkSession.createDataFrame(sorted(best.items()), "rep int, max_neglogp double")
