"""Scans for one or two loci by mixtures (EM) or probabilities (hk), of normal or binary traits, with covariates, and their permutations.

A model has a column for each genotype class of its locus or pair (or for what a smaller model makes of these), times one and the interactive
covariates, and additive covariates. Its state is a few numbers. A round is one pass over individuals, whose chromosomes are one row, for all models that aren't settled: of
every locus, pair and replicate. Tasks add up each model's equations, Spark adds the tasks' sums, executors solve them, and states come back. The null
model, single loci and pairs are models of the same kind, with one, k and k * k classes.

A normal mixture of many individuals doesn't read them again in each round: of those who share a genotype sequence and covariates, the traits in a
panel are Chebyshev sums, taken once (``Panels``)."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.functions import chains
from crossloom.model import SCANONE, Cross
from crossloom.operators import scan as one_locus
from crossloom.operators.hmm import sequences, tracks
from crossloom.operators.scan2 import _SCHEMA, STATS, _chromosomes, _collapse, _loci, joint_designs, pair_statistics
from crossloom.operators.sums import TaskSums, added
from crossloom.runtime import materialise, prepare

_FITS = "unit int, model int, rep int, lod double"
#: Individuals that are worked on at once: what is in hand stays in a core's cache.
SLICE = 1 << 14
#: A normal mixture of more individuals takes their traits by panels.
MOST_PEOPLE = 1 << 16
#: Chebyshev sums of a panel's traits: a panel has more individuals than that, else they stay rows.
NODES = 24
#: How often panels are cut in four before individuals stay rows; the error of a panel's sums, relative to their terms.
LEVELS, PANEL_ERROR = 8, 1e-14


@dataclass(frozen=True)
class Family:
    """``method``: em (classes are hidden) or hk (their probabilities are covariates); ``binary``: a logistic model instead of a normal one."""

    binary: bool
    method: str

    def start(self, d: int, share: float) -> np.ndarray | None:
        """A logistic model starts from the overall share, a normal one from prior weights."""
        return np.append(np.zeros(d), 1.0) if self.binary else None

    def equations(self, x, maps, y, u, v, state, times=None) -> np.ndarray:
        """What individuals add: the matrix, the right side, sums of squares, log likelihood. ``x``: (n, classes) probabilities, ``maps``:
        (classes, columns) of the model, ``times``: how many individuals a row stands for."""
        times = np.ones(len(x)) if times is None else times
        if self.method == "hk":
            c = np.concatenate([((x @ maps)[:, :, None] * u[:, None, :]).reshape(len(x), -1), v], axis=1)
            if not self.binary:
                return np.concatenate([(c.T @ (c * times[:, None])).ravel(), c.T @ (times * y), [(times * y) @ y, 0.0]])
            eta = np.clip(c @ state[:-1], -30, 30)
            p = 1 / (1 + np.exp(-eta))
            return np.concatenate([((c * (times * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ c).ravel(), c.T @ (times * (y - p)), [0.0, float(times @ (y * eta - np.logaddexp(0, eta)))]])
        a, n = u.shape[1], len(x)
        w, ll, residual, curve = x, 0.0, None, None
        if state is not None:
            b = state[: maps.shape[1] * a].reshape(maps.shape[1], a)
            eta = u @ (maps @ b).T + (v @ state[maps.shape[1] * a : -1])[:, None]
            if self.binary:
                eta = np.clip(eta, -30, 30)
                log_f = y[:, None] * eta - np.logaddexp(0, eta)
            else:
                log_f = -((y[:, None] - eta) ** 2) / (2 * state[-1]) - 0.5 * math.log(2 * math.pi * state[-1])
            top = log_f.max(1, keepdims=True)
            f = x * np.exp(log_f - top)
            total = np.maximum(f.sum(1, keepdims=True), 1e-300)
            w, ll = f / total, float(times @ (np.log(total) + top)[:, 0])
            if self.binary:
                p = 1 / (1 + np.exp(-eta))
                residual, curve = w * (y[:, None] - p) * times[:, None], w * np.maximum(p * (1 - p), 1e-12) * times[:, None]
        w = w * times[:, None]
        weight = w if curve is None else curve
        side = w * y[:, None] if residual is None else residual
        uu = (weight.T @ (u[:, :, None] * u[:, None, :]).reshape(n, a * a)).reshape(weight.shape[1], a, a)
        uv = (weight.T @ (u[:, :, None] * v[:, None, :]).reshape(n, a * v.shape[1])).reshape(weight.shape[1], a, v.shape[1])
        k = maps.shape[1] * a
        out = np.zeros((k + v.shape[1],) * 2)
        out[:k, :k] = np.einsum("gi,gj,gab->iajb", maps, maps, uu, optimize=True).reshape(k, k)
        out[:k, k:] = np.einsum("gi,gac->iac", maps, uv).reshape(k, v.shape[1])
        out[k:, :k] = out[:k, k:].T
        out[k:, k:] = v.T @ (v * weight.sum(1)[:, None])
        right = np.concatenate([np.einsum("gi,ga->ia", maps, side.T @ u).ravel(), v.T @ side.sum(1)])
        return np.concatenate([out.ravel(), right, [(times * y) @ y, ll]])

    def kind_equations(self, x, maps, y, k, state) -> np.ndarray:
        """As ``equations`` without covariates, of individuals whose class probabilities are those of their kind, ``x[k]``. In a normal mixture a
        class's log likelihood less that of the first one is linear in the trait, so it takes one exponential and each class two sums."""
        plain = lambda: self.equations(x[k], maps, y, np.ones((len(y), 1)), np.zeros((len(y), 0)), state)
        if self.binary or self.method == "hk":
            return plain()
        count, of = np.bincount(k, minlength=len(x)).astype(float), np.bincount(k, y, len(x))
        weight, side, ll, yy = count @ x, of @ x, 0.0, y @ y
        if state is not None:
            eta, v = maps @ state[:-1], state[-1]
            ratio = np.log(np.maximum(x[:, 1:], 1e-300) / np.maximum(x[:, :1], 1e-300))
            slope, shift = (eta[1:] - eta[0]) / v, (eta[0] ** 2 - eta[1:] ** 2) / (2 * v) + ratio
            if x.min() < 1e-200 or x.shape[1] > 1 and np.abs(y).max() * np.abs(slope).max() + np.abs(shift).max() > 600:
                return plain()
            weight, side = np.zeros(x.shape[1]), np.zeros(x.shape[1])
            for i in range(0, len(y), SLICE):
                own, at = y[i : i + SLICE], k[i : i + SLICE]
                d = own - eta[0]
                ll -= d @ d / (2 * v)
                if not len(slope):
                    continue
                f = [np.exp(slope[g] * own + shift[at, g]) for g in range(len(slope))]
                total = 1 + sum(f)
                ll += np.log(total).sum()
                for g, z in enumerate(f, 1):
                    z /= total
                    weight[g] += z.sum()
                    side[g] += z @ own
            weight[0], side[0] = len(y) - weight[1:].sum(), y.sum() - side[1:].sum()
            ll += count @ np.log(x[:, 0]) - len(y) / 2 * math.log(2 * math.pi * v)
        return np.concatenate([(maps.T @ (maps * weight[:, None])).ravel(), maps.T @ side, [yy, ll]])

    def solved(self, s: np.ndarray, d: int, n: int, state: np.ndarray | None) -> np.ndarray:
        a, b = s[: d * d].reshape(d, d), s[d * d : d * d + d]
        if self.binary:
            return np.append(state[:-1] + np.linalg.lstsq(a, b, rcond=1e-10)[0], 1.0)
        t = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        return np.append(t, max(float(s[-2] - 2 * t @ b + t @ a @ t) / n, 1e-300))

    @property
    def once(self) -> bool:
        return self.method == "hk" and not self.binary

    def steepness(self, maps: np.ndarray, state: np.ndarray | None, most: np.ndarray) -> float:
        """How fast log likelihoods of two classes of a normal mixture part, at most, as the trait grows; ``most``: bounds of one and the interactive
        covariates."""
        if state is None:
            return 0.0
        eta = maps @ state[: maps.shape[1] * len(most)].reshape(maps.shape[1], len(most))
        return float((eta.max(0) - eta.min(0)) @ most / state[-1])


def _points(steep: float) -> int | None:
    """How many Chebyshev points make up for a panel's individuals; None: ``NODES`` aren't enough. ``steep``: how far log likelihoods of two classes part
    over half a panel.

    In a strip about the real line where no two classes differ in phase by more than a right angle, a posterior is analytic and below 1.5. Interpolation
    in p points errs by 4 * 1.5 / (rho - 1) / rho ** (p - 1) at most, if the ellipse of rho is in the strip. One point more is for the trait's factor."""
    if not steep < 1e9:
        return None
    if steep <= 0:
        return 3  # squares of the trait
    reach = math.pi / 2 / steep
    rho = reach + math.hypot(reach, 1)
    p = 2 + math.ceil(max(1.0, math.log(6 / (rho - 1) / PANEL_ERROR) / math.log(rho)))
    return max(3, p) if p <= NODES else None


def _weights(p: int) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev points in (-1, 1), and the matrix that makes their weights of the first p sums: with these, any polynomial of a degree below p has the
    individuals' sum."""
    angle = (np.arange(p) + 0.5) * math.pi / p
    w = 2 * np.cos(np.arange(p)[:, None] * angle) / p
    w[0] = 1 / p
    return np.cos(angle), w


@dataclass
class Panels:
    """Tables of a trait for each level, made when a model needs them: of individuals with equal sequences and covariates and a trait in the same panel,
    the sums of Chebyshev polynomials, or their own rows if they are few. A level's panels are a fourth as wide as the last one's."""

    people: DataFrame
    mean: float
    width: float

    def __post_init__(self):
        self.made: dict[int, tuple[DataFrame, DataFrame | None]] = {}

    def place(self, steep: float) -> tuple[int, int]:
        """The first level that is fine enough, and how many points of its panels."""
        for level in range(LEVELS):
            p = _points(steep * self.width / 4**level / 2)
            if p:
                return level, p
        return LEVELS, 0

    def tables(self, level: int) -> tuple[DataFrame, DataFrame | None]:
        """m, g, y, z, times of individuals; m, g, z, panel, s of panels."""
        if level not in self.made:
            even = self.people.sparkSession.sparkContext.defaultParallelism
            rows, many = self.people, None
            if level < LEVELS:
                keys, at = ["m", "g", "z", "panel"], (F.col("y") - F.lit(self.mean)) / F.lit(self.width / 4**level)
                rows = rows.withColumn("panel", F.floor(at + 0.5).cast("long"))
                full = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODES).select(*keys), "panels")
                inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (at - F.col("panel"))))
                sums = rows.join(full, keys, "left_semi").withColumn("angle", F.acos(inside)).groupBy(*keys).agg(*(F.sum(F.cos(F.lit(k) * F.col("angle"))).alias(f"s{k}") for k in range(NODES)))
                many = materialise(sums.select(*keys, F.array(*(f"s{k}" for k in range(NODES))).alias("s")).repartition(even), "sums")
                rows = rows.join(full, keys, "left_anti")
            self.made[level] = materialise(_alike(rows).repartition(even), "people"), many
        return self.made[level]


def _traits(b: pa.RecordBatch, mean: float, width: float, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, p): the trait at the points of each panel, and how many individuals each stands for, which may be negative."""
    x, w = _weights(p)
    return mean + width * (b.column("panel").to_numpy()[:, None] + x / 2), b.column("s").flatten().to_numpy().reshape(len(b), NODES)[:, :p] @ w


def _alike(people: DataFrame) -> DataFrame:
    """m, g, y, z, times: individuals that are alike are one row."""
    return people.groupBy("m", "g", "y", "z").agg(F.count(F.lit(1)).cast("double").alias("times"))


def _units(got: dict, loci: list, pairs: bool):
    """(number, class probabilities, maps of its models): 0 is the null model, then loci, then pairs."""
    n = len(next(iter(got.values()))[0])
    yield 0, np.ones((n, 1)), (np.ones((1, 1)),)
    for k, (c, j) in enumerate(loci):
        p = got[c][0][:, j]
        yield 1 + k, p, (np.eye(p.shape[1]),)
    if pairs:
        for at, x, k1 in joint_designs(got, loci):
            q = x.shape[1]
            yield 1 + len(loci) + at, x, (np.eye(q), _collapse(k1, q // k1)[2])


def _matrices(t: dict, kind: str, loci: list, pairs: bool) -> dict[tuple[int, int], np.ndarray]:
    """(classes, columns) of each (unit, model), as ``_units`` has them."""
    k = [chains.n_states(kind, t[name].chrtype) for name, _ in loci]
    out = {(0, 0): np.ones((1, 1))} | {(1 + j, 0): np.eye(k[j]) for j in range(len(loci))}
    if pairs:
        both = {(i, j): (np.eye(i * j), _collapse(i, j)[2]) for i in set(k) for j in set(k)}
        at = 1 + len(loci)
        for i in range(len(loci)):
            for j in range(i + 1, len(loci)):
                out[at, 0], out[at, 1] = both[k[i], k[j]]
                at += 1
    return out


def _shared_rows(index: DataFrame, deal, shared: one_locus.Kinds, n_perm: int) -> DataFrame:
    """m, g, y, z, rep, times: a replicate's individuals with a genotype sequence and a trait of 0 or 1, counted without covariates."""

    def run(batches):
        count, s = shared.sums(batches, deal, n_perm, lambda b: np.stack([1 - b.column("y").to_numpy(), b.column("y").to_numpy()], axis=1))
        if s is not None:
            k, r, y = np.nonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(r + 1, pa.int32()), pa.array(y, pa.float64()), pa.array(s[k, r, y])], names=["k", "rep", "y", "times"])

    counted = index.select("i", "y").mapInArrow(run, "k int, rep int, y double, times double").groupBy("k", "rep", "y").agg(F.sum("times").alias("times"))
    of = index.sparkSession.createDataFrame([(k, m, g) for k, (m, g) in enumerate(zip(*(shared.batch.column(c).to_pylist() for c in ("m", "g")), strict=True))], "k int, m array<int>, g array<int>")
    return counted.join(of, "k").select("m", "g", "y", F.array().cast("array<double>").alias("z"), "rep", "times")


def _dealt_kinds(index: DataFrame, deal, shared: one_locus.Kinds, n_perm: int) -> DataFrame:
    """y, k: each individual's trait and the genotype sequences of the places it is dealt to, a 32-bit number for each replicate."""

    def run(batches):
        for i, y in one_locus.gathered(((b.column("i").to_numpy(), b.column("y").to_numpy()) for b in batches if b.num_rows), SLICE):
            k = np.stack([shared.of(deal(i, r)) for r in range(n_perm)], axis=1).astype(np.int32)
            ends = pa.py_buffer(np.arange(len(i) + 1, dtype=np.int32) * 4 * n_perm)
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.BinaryArray.from_buffers(pa.binary(), len(i), [None, ends, pa.py_buffer(k)])], names=["y", "k"])

    return index.select("i", "y").mapInArrow(run, "y double, k binary")


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """The 32-bit numbers of a binary column, a row for each value."""
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int32)[column.offset]
    return np.frombuffer(data, np.int32, len(column) * width, int(first)).reshape(-1, width)


def _fit(cross: Cross, trait: str, family: Family, pairs: bool, covar, addcovar, intcovar, n_perm: int, seed: int, strata, maxit: int, tol: float, step: float, off_end: float, stepwidth: str, error: float, map_function: str):
    """Log likelihood of each (unit, model, replicate), with loci and tracks. Replicate 0 is the trait as it is, unless there are permutations."""
    if family.method not in ("em", "hk"):
        raise ValueError("method is em or hk")
    spark = cross.geno.sparkSession
    prepare(spark)
    t, kind = tracks(cross, step, off_end, stepwidth), (cross.crosstype, cross.scheme)
    loci = _loci(t)
    inter = list(intcovar or [])
    names = [*dict.fromkeys([*(addcovar or []), *inter])]
    own = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull() & ~F.isnan("y")).join(cross.individual.select("ind"), "ind", "left_semi").select("ind", "y")
    if names:
        wide = covar.where("value IS NOT NULL AND NOT isnan(value)").groupBy("ind").pivot("name", names).agg(F.first("value"))
        own = own.join(wide, "ind").select("ind", "y", F.array(*(F.col(f"`{x}`").cast("double") for x in names)).alias("z")).where("NOT exists(z, x -> x IS NULL)")
    else:
        own = own.withColumn("z", F.array().cast("array<double>"))
    own = materialise(own, "trait")
    q, at_inter = len(names), [names.index(x) for x in inter]
    n, share, spread, *most = own.agg(F.count(F.lit(1)), F.avg("y"), F.stddev_pop("y"), *(F.max(F.abs(F.col("z")[j])) for j in at_inter)).first()
    if family.binary and n and own.where("y NOT IN (0, 1)").limit(1).count():
        raise ValueError("a binary trait is 0 or 1")
    if not n:
        return {}, loci, t, 0
    values = index = deal = shared = None
    if n_perm:
        index, deal = one_locus.numbered(own, strata, seed)
        if n <= one_locus.BROADCAST_PEOPLE:
            got = index.orderBy("i").select("y", "z").toPandas()
            values = spark.sparkContext.broadcast(np.column_stack([got["y"].to_numpy(float), np.array(got["z"].tolist(), float).reshape(n, q)]))
        elif not q:
            shared = one_locus.kinds_of(cross, index, deal, n, n_perm)
    summed = not n_perm and n > MOST_PEOPLE and family.method == "em" and not family.binary and 0 < spread < math.inf
    if summed:
        rows = sequences(cross).join(own, "ind").select("m", "g", "y", "z")
    elif not n_perm:
        rows = _alike(sequences(cross).join(own, "ind"))
    elif shared and family.binary:
        rows = _shared_rows(index, deal, shared, n_perm)
    elif shared:
        rows = _dealt_kinds(index, deal, shared, n_perm)
    elif values is not None:
        rows = sequences(cross).join(index.select("ind", "i"), "ind")
    else:
        rows = sequences(cross).join(one_locus.redealt(index, deal, n_perm), "ind")
    rows = materialise(rows, "people")
    panels = Panels(rows, share, 4 * spread) if summed else None
    reps = max(1, n_perm)
    matrices = _matrices(t, kind[0], loci, pairs)
    shapes = {key: x.shape[1] * (1 + len(inter)) + q for key, x in matrices.items()}
    most = np.array([1.0, *most])

    def dealt(b: pa.RecordBatch, r: int):
        """Which rows, trait, covariates of a replicate."""
        if n_perm and values is not None:
            x = values.value[deal(b.column("i").to_numpy(), r)]
            return slice(None), x[:, 0], x[:, 1:]
        y, z = b.column("y").to_numpy(), b.column("z").flatten().to_numpy().reshape(len(b), q)
        if not n_perm:
            return slice(None), y, z
        some = b.column("rep").to_numpy() == r + 1
        return some, y[some], z[some]

    grouped = not n_perm or shared is not None
    kinds = shared is not None and not family.binary

    state = {(*key, r): family.start(d, share) for key, d in shapes.items() for r in range(reps)}
    open_, ll = set(state), {}
    best: dict[tuple, np.ndarray] = {}
    for _ in range(maxit):
        if not open_:
            break
        now = spark.sparkContext.broadcast({key: state[key] for key in open_})
        places = {key: panels.place(family.steepness(matrices[key[:2]], state[key], most)) for key in open_} if panels else {}
        use = spark.sparkContext.broadcast(places)

        def out(sums):
            held = list(sums.rows())
            if held:
                yield pa.RecordBatch.from_arrays([*(pa.array([x[j] for x in held], pa.int32()) for j in range(3)), pa.array([x[3] for x in held], pa.list_(pa.float64()))], names=["unit", "model", "rep", "s"])

        def at_points(batches, level, mean, width, now=now, use=use):
            sums, mine = TaskSums(), {key: now.value[key] for key, x in use.value.items() if x[0] == level}
            for b in (b.slice(i, SLICE // NODES) for b in batches for i in range(0, len(b), SLICE // NODES)):
                got, z = _chromosomes(b, t, kind, error, map_function), b.column("z").flatten().to_numpy().reshape(len(b), q)
                points = {}
                for unit, x, maps in _units(got, loci, pairs):
                    for m, matrix in enumerate(maps):
                        if (unit, m, 0) not in mine:
                            continue
                        p = use.value[unit, m, 0][1]
                        if p not in points:
                            v = np.repeat(z, p, axis=0)
                            points[p] = *(a.ravel() for a in _traits(b, mean, width, p)), np.concatenate([np.ones((len(v), 1)), v[:, at_inter]], axis=1), v
                        y, times, u, v = points[p]
                        sums.add((unit, m, 0), family.equations(np.repeat(x, p, axis=0), matrix, y, u, v, mine[unit, m, 0], times))
                if sums.full:
                    yield from out(sums)
            yield from out(sums)

        def task(batches, level=None, now=now, use=use):
            sums, mine = TaskSums(), now.value if level is None else {key: now.value[key] for key, x in use.value.items() if x[0] == level}
            wanted = {key[0] for key in mine}

            if kinds:
                parts = ((b.column("y").to_numpy(), _numbers(b.column("k"), n_perm)) for b in batches if b.num_rows)
                got = _chromosomes(shared.batch, t, kind, error, map_function)
                for y, k in one_locus.gathered(parts, one_locus.KIND_ROWS):
                    k = np.ascontiguousarray(k.T)
                    for unit, x, maps in _units(got, loci, pairs):
                        for m, matrix in enumerate(maps):
                            for r in range(reps):
                                if (unit, m, r) in mine:
                                    sums.add((unit, m, r), family.kind_equations(x, matrix, y, k[r], mine[unit, m, r]))
                    if sums.full:
                        yield from out(sums)
            for b in batches:
                if not b.num_rows:
                    continue
                got = _chromosomes(b, t, kind, error, map_function)
                people = [(r, *dealt(b, r)) for r in range(reps)]
                times = b.column("times").to_numpy() if grouped else np.ones(len(b))
                for unit, x, maps in _units(got, loci, pairs):
                    if unit not in wanted:
                        continue
                    for m, matrix in enumerate(maps):
                        for r, some, y, z in people:
                            if (unit, m, r) in mine and len(y):
                                u = np.concatenate([np.ones((len(y), 1)), z[:, at_inter]], axis=1)
                                sums.add((unit, m, r), family.equations(x[some], matrix, y, u, z, mine[unit, m, r], times[some]))
                if sums.full:
                    yield from out(sums)
            yield from out(sums)

        def solve(batches, now=now):
            for pdf in batches:
                out = []
                for unit, m, r, s in zip(pdf["unit"], pdf["model"], pdf["rep"], pdf["s"], strict=True):
                    out.append((unit, m, r, family.solved(np.asarray(s), shapes[unit, m], n, now.value[unit, m, r]), float(s[-1])))
                yield pd.DataFrame(out, columns=["unit", "model", "rep", "state", "ll"])

        schema, parts = "unit int, model int, rep int, s array<double>", []
        for level in sorted({x[0] for x in places.values()}):
            alone, many = panels.tables(level)
            parts.append(alone.mapInArrow(partial(task, level=level), schema))
            if many is not None:
                parts.append(many.mapInArrow(partial(at_points, level=level, mean=panels.mean, width=panels.width / 4**level), schema))
        part = reduce(DataFrame.unionAll, parts) if panels else rows.mapInArrow(task, schema)
        got = added(part, ["unit", "model", "rep"], "s").mapInPandas(solve, "unit int, model int, rep int, state array<double>, ll double").collect()
        for x in got:
            key, new = (x["unit"], x["model"], x["rep"]), np.array(x["state"])
            if family.once:
                ll[key] = -n / 2 * (math.log(2 * math.pi * new[-1]) + 1)
                open_.discard(key)
                continue
            if state[key] is not None:
                if key in best and x["ll"] < ll[key] - 1e-9 and np.abs(state[key] - best[key]).max() > 1e-9:
                    state[key] = (state[key] + best[key]) / 2  # a Newton step too far: half of it
                    continue
                if abs(x["ll"] - ll.get(key, -1e300)) <= tol:
                    open_.discard(key)
                ll[key], best[key] = max(x["ll"], ll.get(key, -1e300)), state[key]
            state[key] = new
        now.unpersist()
        use.unpersist()
    if open_:
        warnings.warn(f"scan: {len(open_)} of {len(state)} models not settled after {maxit} rounds", stacklevel=3)
    return ll, loci, t, reps


def scanone_model(cross: Cross, trait: str, method: str = "em", binary: bool = False, covar: DataFrame | None = None, addcovar: list[str] | None = None, intcovar: list[str] | None = None, step: float = 0.0, off_end: float = 0.0, stepwidth: str = "fixed", error: float = 1e-4,
                  map_function: str = "haldane", maxit: int = 1000, tol: float = 1e-5) -> DataFrame:
    """chr, pos, ord, locus, trait, lod: each locus against the model without it, by EM or by regression on probabilities, of a normal or a
    binary trait, with additive and interactive covariates (long ``covar``: ind, name, value)."""
    ll, loci, t, _ = _fit(cross, trait, Family(binary, method), False, covar, addcovar, intcovar, 0, 1, None, maxit, tol, step, off_end, stepwidth, error, map_function)
    rows = [(c, float(t[c].pos[j]), j + 1, t[c].names[j], trait, max(0.0, (ll[1 + k, 0, 0] - ll[0, 0, 0]) / math.log(10))) for k, (c, j) in enumerate(loci)] if ll else []
    return cross.geno.sparkSession.createDataFrame(rows, SCANONE)


def scanone_model_perm(cross: Cross, trait: str, n_perm: int = 100, method: str = "em", binary: bool = False, covar: DataFrame | None = None, addcovar: list[str] | None = None, intcovar: list[str] | None = None, strata: DataFrame | None = None, perm_xsp: bool = False, seed: int = 1,
                       step: float = 0.0, error: float = 1e-4, map_function: str = "haldane", maxit: int = 1000, tol: float = 1e-4) -> DataFrame:
    """rep, trait, region (A or X; all), maxlod: permutations of ``scanone_model``; covariates go with the trait, within ``strata``."""
    ll, loci, t, reps = _fit(cross, trait, Family(binary, method), False, covar, addcovar, intcovar, n_perm, seed, strata, maxit, tol, step, 0.0, "fixed", error, map_function)
    best: dict[tuple, float] = {}
    for k, (c, _) in enumerate(loci if ll else []):
        region = ("X" if t[c].chrtype == "X" else "A") if perm_xsp else "all"
        for r in range(reps):
            lod = max(0.0, (ll[1 + k, 0, r] - ll[0, 0, r]) / math.log(10))
            best[r + 1, region] = max(lod, best.get((r + 1, region), 0.0))
    return cross.geno.sparkSession.createDataFrame([(r, trait, x, v) for (r, x), v in sorted(best.items())], "rep int, trait string, region string, maxlod double")


def _pair_rows(ll: dict, loci: list, t: dict, r: int):
    at, lod = 1 + len(loci), lambda u, m: max(0.0, (ll[u, m, r] - ll[0, 0, r]) / math.log(10))
    for i, (c1, a) in enumerate(loci):
        for j, (c2, b) in enumerate(loci[i + 1 :], i + 1):
            yield c1, float(t[c1].pos[a]), t[c1].names[a], c2, float(t[c2].pos[b]), t[c2].names[b], lod(at, 0), lod(at, 1), lod(1 + i, 0), lod(1 + j, 0)
            at += 1


def scantwo_model(cross: Cross, trait: str, method: str = "em", binary: bool = False, covar: DataFrame | None = None, addcovar: list[str] | None = None, intcovar: list[str] | None = None, step: float = 0.0, error: float = 1e-4, map_function: str = "haldane", maxit: int = 1000, tol: float = 1e-5) -> DataFrame:
    """Full and additive LODs of every pair of loci and those of single loci, as ``scan2.scantwo_hk`` has them, by EM over joint genotype classes or by
    regression on their probabilities, of a normal or a binary trait, with covariates."""
    ll, loci, t, _ = _fit(cross, trait, Family(binary, method), True, covar, addcovar, intcovar, 0, 1, None, maxit, tol, step, 0.0, "fixed", error, map_function)
    rows = [(*x[:6], trait, *x[6:]) for x in _pair_rows(ll, loci, t, 0)] if ll else []
    return cross.geno.sparkSession.createDataFrame(rows, _SCHEMA)


def scantwo_model_perm(cross: Cross, trait: str, n_perm: int = 20, method: str = "em", binary: bool = False, covar: DataFrame | None = None, addcovar: list[str] | None = None, intcovar: list[str] | None = None, strata: DataFrame | None = None, seed: int = 1, step: float = 0.0, error: float = 1e-4,
                       map_function: str = "haldane", maxit: int = 1000, tol: float = 1e-4) -> DataFrame:
    """rep, trait, region, stat, value: maxima over pairs of chromosomes of the six statistics of ``scantwo_model``, by permutations."""
    spark = cross.geno.sparkSession
    ll, loci, t, reps = _fit(cross, trait, Family(binary, method), True, covar, addcovar, intcovar, n_perm, seed, strata, maxit, tol, step, 0.0, "fixed", error, map_function)
    rows = [(r + 1, x[0], x[3], *x[6:]) for r in range(reps) for x in _pair_rows(ll, loci, t, r)] if ll else []
    lods = spark.createDataFrame(rows, "rep int, chr1 string, chr2 string, lod_full double, lod_add double, lod_one1 double, lod_one2 double")
    stats = pair_statistics(lods, ("rep", "chr1", "chr2")).groupBy("rep").agg(*(F.max(s).alias(s) for s in STATS))
    long = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS))).alias("x")
    return stats.select("rep", F.lit(trait).alias("trait"), F.lit("all").alias("region"), long).select("rep", "trait", "region", "x.*")
