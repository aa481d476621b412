"""Two-locus scans and their permutations, from one table with all of an individual's chromosomes in a row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.functions import chains
from crossloom.model import Cross
from crossloom.operators.hmm import Track, codes, sequences, tracks
from crossloom.operators.pair_cells import pair_cells
from crossloom.operators.scan import rss
from crossloom.operators.sums import TaskSums, added
from crossloom.runtime import materialise, prepare

_SCHEMA = "chr1 string, pos1 double, locus1 string, chr2 string, pos2 double, locus2 string, trait string, lod_full double, lod_add double, lod_one1 double, lod_one2 double"
STATS = ("full", "fv1", "int", "add", "av1", "one")


def people(cross: Cross, trait: str) -> DataFrame:
    """ind, m, g, y: see ``sequences``; individuals with the trait only."""
    y = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull() & ~F.isnan("y")).select("ind", "y")
    return sequences(cross).join(y, "ind")


def kinds(cross: Cross, trait: str) -> DataFrame:
    """m, g, n, s, q: for each genotype sequence, how many individuals with the trait have it, and sums of their trait and its squares. A normal
    model on probabilities needs no more of them."""
    return people(cross, trait).groupBy("m", "g").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))


def gram_of_kinds(x: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Gram matrix of columns and response, summed over the individuals of kinds."""
    b = x.T @ s
    return np.block([[(x * n[:, None]).T @ x, b[:, None]], [b[None], np.array([[q.sum()]])]])


def _loci(t: dict[str, Track]) -> list[tuple[str, int]]:
    return [(c, k) for c in sorted(t) for k in range(len(t[c].pos))]


def _chromosomes(b: pa.RecordBatch, t: dict[str, Track], kind: tuple, error: float, map_function: str) -> dict:
    """For each chromosome: posterior probabilities (n, loci, k) and conditional transitions (n, loci - 1, k, k)."""
    out = {}
    for c in sorted(t):
        emit = chains.emissions(kind[0], codes(b, t[c]), error, t[c].chrtype)
        init, steps = chains.initial(kind[0], t[c].chrtype, kind[1]), t[c].steps(kind, map_function)
        p = chains.posterior(emit, init, steps)
        q = chains.pair_posterior(emit, init, steps) if steps else np.zeros((len(b), 0, p.shape[2], p.shape[2]))
        out[c] = p, q / np.maximum(q.sum(3, keepdims=True), 1e-300)
    return out


def joint_designs(got: dict, loci: list, independent: bool = False):
    """(pair index, joint probabilities (n, k1 * k2)) for every pair of loci in order."""
    at = 0
    for i, (c1, a) in enumerate(loci):
        p1 = got[c1][0][:, a]
        run = None
        for c2, b in loci[i + 1 :]:
            if c1 == c2 and not independent:
                step = got[c1][1][:, b - 1]
                run = p1[:, :, None] * step if run is None else np.einsum("nuv,nvw->nuw", run, step)
                x = run
            else:
                x = p1[:, :, None] * got[c2][0][:, b][:, None, :]
            yield at, x.reshape(len(x), -1), p1.shape[1]
            at += 1


def _sent(sums: TaskSums, *names: str):
    """What a task has summed, as a batch of (pair, k1, arrays...)."""
    rows = list(sums.rows())
    if rows:
        arrays = [pa.array([r[k + 2].ravel() for r in rows], pa.list_(pa.float64())) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *arrays], names=["pair", "k1", *names])


def _collapse(k1: int, k2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maps from joint columns to: first locus, second locus, both additively."""
    one, two = np.kron(np.eye(k1), np.ones((k2, 1))), np.kron(np.ones((k1, 1)), np.eye(k2))
    return one, two, np.concatenate([one, two[:, 1:]], axis=1)


def _lods(g: np.ndarray, k1: int, k2: int) -> tuple[float, float, float, float]:
    """Full, additive and both single LODs from a Gram matrix of joint columns, response, ones."""
    q = k1 * k2
    n = g[-1, -1]
    r0 = g[q, q] - g[q, q + 1] ** 2 / n
    out = []
    for m in (None, _collapse(k1, k2)[2], *_collapse(k1, k2)[:2]):
        a = np.eye(q) if m is None else m
        full = np.zeros((q + 2, a.shape[1] + 1))
        full[:q, :-1], full[q, -1] = a, 1
        r = rss(full.T @ g @ full, a.shape[1])
        out.append(max(0.0, n / 2 * math.log10(r0 / r)) if r > 0 and r0 > 0 else 0.0)
    return tuple(out)


def scantwo_hk(cross: Cross, trait: str, step: float = 0.0, error: float = 1e-4, map_function: str = "haldane", independent: bool = False) -> DataFrame:
    """Full and additive LODs of every pair of loci by regression. Between chromosomes joint probabilities are products;
    within one they follow the chain (unless ``independent``). One pass; a pair is solved from its summed Gram matrix."""
    prepare(cross.geno.sparkSession)
    t, kind = tracks(cross, step), (cross.crosstype, cross.scheme)
    loci = _loci(t)

    def run(batches):
        sums = TaskSums()
        for b in batches:
            n, s, q = (b.column(c).to_numpy() for c in ("n", "s", "q"))
            for at, x, k1 in joint_designs(_chromosomes(b, t, kind, error, map_function), loci, independent):
                k = [*range(x.shape[1]), x.shape[1] + 1, x.shape[1]]  # the ones go last
                sums.add((at, k1), gram_of_kinds(np.concatenate([x, np.ones((len(n), 1))], axis=1), n, s, q)[np.ix_(k, k)])
            if sums.full:
                yield from _sent(sums, "s")
        yield from _sent(sums, "s")

    gram = materialise(added(kinds(cross, trait).mapInArrow(run, "pair int, k1 int, s array<double>"), ["pair", "k1"], "s"), "grams")
    pairs = [(a, b) for i, a in enumerate(loci) for b in loci[i + 1 :]]

    def solve(batches):
        for pdf in batches:
            out = []
            for pair, k1, s in zip(pdf["pair"], pdf["k1"], pdf["s"], strict=True):
                d = math.isqrt(len(s))
                (c1, a), (c2, b) = pairs[pair]
                out.append((c1, t[c1].pos[a], t[c1].names[a], c2, t[c2].pos[b], t[c2].names[b], trait, *_lods(np.asarray(s).reshape(d, d), k1, (d - 2) // k1)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    return gram.mapInPandas(solve, _SCHEMA)


def scantwo_mr(cross: Cross, trait: str) -> DataFrame:
    """Pairs of typed markers: cells of a two-way table are aggregates, additive fits are solved from the cells."""
    y = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull())
    k = chains.n_states(cross.crosstype)
    one = cross.geno.where(F.col("g").between(1, k)).join(y, "ind").groupBy("ind", "y").agg(F.collect_list(F.struct("marker", "g")).alias("a"))
    order = {r["marker"]: (r["chr"], r["ord"], r["marker"]) for r in cross.map.collect()}
    cell = pair_cells(one.select("a", F.col("y").alias("s"), (F.col("y") * F.col("y")).alias("v")), ("s", "v"), order.get).withColumn("n", F.col("n").cast("double"))
    wide = cell.groupBy("m1", "m2").agg(F.collect_list(F.struct("g1", "g2", "n", "s", "v")).alias("c"))
    place = {r["marker"]: (r["chr"], r["pos"]) for r in cross.map.collect()}

    def solve(batches):
        for pdf in batches:
            out = []
            for m1, m2, c in zip(pdf["m1"], pdf["m2"], pdf["c"], strict=True):
                g = np.zeros((k * k + 2, k * k + 2))
                for x in c:
                    j = (x["g1"] - 1) * k + x["g2"] - 1
                    g[j, j], g[j, -2], g[-2, j], g[j, -1], g[-1, j] = x["n"], x["s"], x["s"], x["n"], x["n"]
                    g[-2, -2] += x["v"]
                    g[-1, -1] += x["n"]
                    g[-1, -2] += x["s"]
                g[-2, -1] = g[-1, -2]
                out.append((*place[m1], m1, *place[m2], m2, trait, *_lods(g, k, k)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    return wide.mapInPandas(solve, _SCHEMA)


def pair_statistics(scan: DataFrame, keys: tuple[str, ...] = ("chr1", "chr2", "trait")) -> DataFrame:
    """For each pair of chromosomes: the six statistics from the maxima of full, additive and single LODs."""
    x = scan.groupBy(*keys).agg(F.max("lod_full").alias("full"), F.max("lod_add").alias("add"), F.greatest(F.max("lod_one1"), F.max("lod_one2")).alias("one"))
    return x.select(*keys, "full", (F.col("full") - F.col("one")).alias("fv1"), (F.col("full") - F.col("add")).alias("int"), "add", (F.col("add") - F.col("one")).alias("av1"), "one")


def summary_scantwo(scan: DataFrame, thresholds: tuple[float, float, float, float, float] = (0, 0, 0, 0, 0)) -> DataFrame:
    """Pairs of chromosomes with full >= T1 and (fv1 >= T2 or int >= T3), or add >= T4 and av1 >= T5, with the positions of the best
    full and additive pair."""
    a, b, c, d, e = thresholds
    best = lambda v: F.max(F.struct(v, (-F.col("pos1")).alias("p"), (-F.col("pos2")).alias("q")))
    at = scan.groupBy("chr1", "chr2", "trait").agg(best("lod_full").alias("f"), best("lod_add").alias("a"))
    at = at.select("chr1", "chr2", "trait", (-F.col("f.p")).alias("pos1f"), (-F.col("f.q")).alias("pos2f"), (-F.col("a.p")).alias("pos1a"), (-F.col("a.q")).alias("pos2a"))
    keep = (F.col("full") >= a) & ((F.col("fv1") >= b) | (F.col("int") >= c)) | (F.col("add") >= d) & (F.col("av1") >= e)
    return pair_statistics(scan).join(at, ["chr1", "chr2", "trait"]).where(keep)


def max_scantwo(scan: DataFrame, what: str = "lod_full") -> DataFrame:
    best = F.max(F.struct(F.col(what).alias("lod"), F.struct(*(c for c in scan.columns if c != "trait")).alias("x"))).alias("b")
    return scan.groupBy("trait").agg(best).select("trait", "b.x.*")


def clean_scantwo(scan: DataFrame, map_: DataFrame, n_mar: int = 1, distance: float = 0.0) -> DataFrame:
    """Zero LODs for pairs on a chromosome with fewer markers between them or closer than ``distance``; full at least additive."""
    m = map_.select(F.col("chr").alias("c"), F.col("pos").alias("mp"))
    near = scan.where("chr1 = chr2").join(m, (F.col("chr1") == F.col("c")) & (F.col("mp") > F.col("pos1")) & (F.col("mp") < F.col("pos2")), "left").groupBy("locus1", "locus2").agg(F.count("mp").alias("k"))
    x = scan.join(near, ["locus1", "locus2"], "left")
    bad = (F.col("chr1") == F.col("chr2")) & ((F.col("k") < n_mar) | (F.col("pos2") - F.col("pos1") < distance))
    fix = lambda v: F.when(bad | v.isNull() | F.isnan(v), 0.0).otherwise(F.greatest(v, F.lit(0.0)))
    x = x.withColumns({"lod_full": fix(F.col("lod_full")), "lod_add": fix(F.col("lod_add"))})
    return x.withColumn("lod_full", F.greatest("lod_full", "lod_add")).select(scan.columns)


def scantwo_perm(cross: Cross, trait: str, n_perm: int = 20, seed: int = 1, step: float = 0.0, error: float = 1e-4, map_function: str = "haldane", independent: bool = False, perm_xsp: bool = False, strata: DataFrame | None = None) -> DataFrame:
    """rep, trait, region, stat, value: maxima over pairs of chromosomes of the six statistics, all replicates in one pass.

    perm_xsp: apart for pairs of autosomes (AA), of an autosome and X (AX), within X (XX). ``strata`` (ind, strata): phenotypes are dealt within
    these, by sex where X is to keep its null. More individuals than ``scan.BROADCAST_PEOPLE`` are added up by shared genotype sequences (``scan.kinds_of``)
    or go through a join by index."""
    from crossloom.operators import scan as one_locus

    spark = cross.geno.sparkSession
    prepare(spark)
    t, kind = tracks(cross, step), (cross.crosstype, cross.scheme)
    loci = _loci(t)
    own = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull() & ~F.isnan("y")).join(cross.individual.select("ind"), "ind", "left_semi").select("ind", "y")
    index, deal = one_locus.numbered(own, strata, seed)
    n = index.count()
    m = index.agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).first()
    tss, total = m["q"] - m["s"] ** 2 / n, m["q"]
    small = n <= one_locus.BROADCAST_PEOPLE
    shared = None if small else one_locus.kinds_of(cross, index, deal, n, n_perm)
    y = index.orderBy("i").select("y").toPandas()["y"].to_numpy() if small else None

    def run(batches):
        sums = TaskSums()
        for b in batches:
            if small:
                i = b.column("i").to_numpy()
                yy, first = np.stack([y[deal(i, r)] for r in range(n_perm)], axis=1), slice(None)
            else:  # rows of single replicates
                rep = b.column("rep").to_numpy() - 1
                yy, first = np.zeros((len(rep), n_perm)), rep == 0
                yy[np.arange(len(rep)), rep] = b.column("y").to_numpy()
            for at, x, k1 in joint_designs(_chromosomes(b, t, kind, error, map_function), loci, independent):
                sums.add((at, k1), x[first].T @ x[first], x.T @ yy)
            if sums.full:
                yield from _sent(sums, "a", "b")
        yield from _sent(sums, "a", "b")

    def run_kinds(batches):
        sums = TaskSums()
        count, s = shared.sums(batches, deal, n_perm, lambda b: b.column("y").to_numpy()[:, None])
        if s is not None:
            for at, x, k1 in joint_designs(_chromosomes(shared.batch, t, kind, error, map_function), loci, independent):
                sums.add((at, k1), (x * count[:, None]).T @ x, x.T @ s[:, :, 0])
                if sums.full:
                    yield from _sent(sums, "a", "b")
        yield from _sent(sums, "a", "b")

    if shared:
        rows, run = index.select("i", "y"), run_kinds
    else:
        rows = sequences(cross).join(index.select("ind", "i") if small else one_locus.redealt(index, deal, n_perm), "ind")
    part = rows.mapInArrow(run, "pair int, k1 int, a array<double>, b array<double>")
    pairs = [(a, b) for i, a in enumerate(loci) for b in loci[i + 1 :]]

    def solve(batches):
        for pdf in batches:
            for pair, k1, a, b in zip(pdf["pair"], pdf["k1"], pdf["a"], pdf["b"], strict=True):
                q = math.isqrt(len(a))
                a, b = np.asarray(a).reshape(q, q), np.asarray(b).reshape(q, n_perm)
                out = {"rep": np.arange(1, n_perm + 1), "chr1": pairs[pair][0][0], "chr2": pairs[pair][1][0]}
                one, two, both = _collapse(k1, q // k1)
                for name, m in (("lod_full", np.eye(q)), ("lod_add", both), ("lod_one1", one), ("lod_one2", two)):
                    bb = m.T @ b
                    fit = (bb * np.linalg.lstsq(m.T @ a @ m, bb, rcond=1e-12)[0]).sum(0)
                    out[name] = np.maximum(0, n / 2 * np.log10(tss / np.maximum(total - fit, 1e-300)))
                yield pd.DataFrame(out)

    lods = added(part, ["pair", "k1"], "a", "b").mapInPandas(solve, "rep int, chr1 string, chr2 string, lod_full double, lod_add double, lod_one1 double, lod_one2 double")
    on_x = [c for c in t if t[c].chrtype == "X"]
    of = lambda c: F.when(F.col(c).isin(on_x), "X").otherwise("A")
    region = F.array_join(F.array_sort(F.array(of("chr1"), of("chr2"))), "") if perm_xsp else F.lit("all")
    stats = pair_statistics(lods.withColumn("region", region), ("rep", "region", "chr1", "chr2")).groupBy("rep", "region").agg(*(F.max(s).alias(s) for s in STATS))
    long = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS))).alias("x")
    return stats.select("rep", F.lit(trait).alias("trait"), "region", long).select("rep", "trait", "region", "x.*")


def scantwo_thresholds(perms: DataFrame, alphas: list[float] = (0.05, 0.10)) -> DataFrame:
    out = None
    for a in alphas:
        one = perms.groupBy("trait", "region", "stat").agg(F.percentile("value", F.lit(1 - a)).alias("threshold")).withColumn("alpha", F.lit(float(a)))
        out = one if out is None else out.unionByName(one)
    return out


def scantwoperm_to_scanoneperm(perms: DataFrame) -> DataFrame:
    return perms.where("stat = 'one'").select("rep", "trait", "region", F.col("value").alias("maxlod"))


def calc_penalties(perms: DataFrame, alpha: float = 0.05) -> dict[str, float]:
    """main = q(one), heavy = q(int), light = q(fv1) - q(one)."""
    q = {r["stat"]: r["threshold"] for r in scantwo_thresholds(perms, [alpha]).collect()}
    return {"main": q["one"], "heavy": q["int"], "light": q["fv1"] - q["one"]}


def calc_penalties_x(perms: DataFrame, alpha: float = 0.05) -> dict[str, float]:
    """Six penalties from replicates with regions AA, AX, XX: mainA, mainX, intH, intL, intAX, intXX."""
    q = {(r["region"], r["stat"]): r["threshold"] for r in scantwo_thresholds(perms, [alpha]).collect()}
    if missing := {"AA", "AX", "XX"} - {r for r, _ in q}:
        raise ValueError(f"no replicates of {sorted(missing)}: permute with perm_xsp")
    return {"mainA": q["AA", "one"], "mainX": q["XX", "one"], "intH": q["AA", "int"], "intL": q["AA", "fv1"] - q["AA", "one"], "intAX": q["AX", "int"], "intXX": q["XX", "int"]}


def scantwo_imp(cross: Cross, trait: str, n_draws: int = 8, step: float = 0.0, error: float = 1e-4, map_function: str = "haldane", seed: int = 1) -> DataFrame:
    """Pairs of loci by multiple imputation: counts and sums of each draw's cells are added up in one pass and their LODs combined."""
    from crossloom.operators.scan import weighted_average

    prepare(cross.geno.sparkSession)
    t, kind = tracks(cross, step), (cross.crosstype, cross.scheme)
    loci = _loci(t)
    k = {c: chains.n_states(kind[0], x.chrtype) for c, x in t.items()}

    def run(batches):
        sums = TaskSums()
        for b in batches:
            if not len(b):
                continue
            got, ids = {}, b.column("ind").to_numpy()
            for i, c in enumerate(sorted(t)):
                emit = chains.emissions(kind[0], codes(b, t[c]), error, t[c].chrtype)
                got[c] = chains.sample(emit, chains.initial(kind[0], t[c].chrtype, kind[1]), t[c].steps(kind, map_function), n_draws, [(seed, i, int(x)) for x in ids])
            y, at = b.column("y").to_numpy(), 0
            yy, draw = np.repeat(y, n_draws), np.tile(np.arange(n_draws), len(y))
            for i, (c1, u) in enumerate(loci):
                for c2, v in loci[i + 1 :]:
                    q = k[c1] * k[c2]
                    cell = ((got[c1][:, u].astype(np.int64) - 1) * k[c2] + got[c2][:, v] - 1).ravel() + draw * q
                    sums.add((at, k[c1]), np.bincount(cell, minlength=n_draws * q), np.bincount(cell, yy, n_draws * q), np.array([y @ y]))
                    at += 1
            if sums.full:
                yield from _sent(sums, "n", "s", "q")
        yield from _sent(sums, "n", "s", "q")

    whole = added(people(cross, trait).mapInArrow(run, "pair int, k1 int, n array<double>, s array<double>, q array<double>"), ["pair", "k1"], "n", "s", "q")
    pairs = [(a, b) for i, a in enumerate(loci) for b in loci[i + 1 :]]

    def solve(batches):
        for pdf in batches:
            out = []
            for pair, k1, n, s, q in zip(pdf["pair"], pdf["k1"], pdf["n"], pdf["s"], pdf["q"], strict=True):
                lods = []
                for cells, sums in zip(np.asarray(n).reshape(n_draws, -1), np.asarray(s).reshape(n_draws, -1), strict=True):
                    last = np.array([[q[0], sums.sum()], [sums.sum(), cells.sum()]])
                    lods.append(_lods(np.block([[np.diag(cells), np.column_stack([sums, cells])], [np.vstack([sums, cells]), last]]), k1, len(cells) // k1))
                lods = np.array(lods)
                (c1, a), (c2, b) = pairs[pair]
                out.append((c1, t[c1].pos[a], t[c1].names[a], c2, t[c2].pos[b], t[c2].names[b], trait, *(weighted_average(lods[:, j]) for j in range(4))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    return whole.mapInPandas(solve, _SCHEMA)


def scantwo_pvalues(summary: DataFrame, perms: DataFrame) -> DataFrame:
    """Share of replicates that reach each of the five statistics of a summary."""
    m = perms.groupBy("trait").pivot("stat", list(STATS)).agg(F.collect_list("value"))
    x = summary.join(m.withColumnsRenamed({s: f"_{s}" for s in STATS}), "trait")
    share = lambda s: F.size(F.filter(f"_{s}", lambda v: v >= F.col(s))) / F.size(f"_{s}")
    return x.withColumns({f"p_{s}": share(s) for s in STATS[:5]}).drop(*(f"_{s}" for s in STATS))


def replace_map_pairs(scan: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Both axes of a pair scan translated to another map."""
    from crossloom.operators.edit import interp_positions

    for c, p in (("chr1", "pos1"), ("chr2", "pos2")):
        at = scan.select(F.col(c).alias("chr"), F.col(p).alias("pos")).distinct()
        moved = interp_positions(old, new, at).select(F.col("chr").alias(c), F.col("pos").alias(p), "new_pos")
        scan = scan.join(moved, [c, p]).withColumn(p, F.col("new_pos")).drop("new_pos")
    return scan
