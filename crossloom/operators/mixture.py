"""Mixtures over complete genotype sequences: exact augmentation of missing genotypes, and scans with marker cofactors by maximum likelihood.

*Augmentation.* An individual's sequences are built from left to right; the best completion of every beginning is known from a backward pass, so
exactly those beginnings are kept that some sequence of at least ``min_prob`` times the best one's probability has. Each has at least one such
sequence, so once there are more beginnings than ``max_per_ind`` there are more sequences too: such an individual is flagged, and a strategy says what becomes of it.

*Mixture.* A trait is a regression on cofactors (and a locus) with normal residuals, where an individual's likelihood is the sum over its
sequences and the genotypes at the locus. EM gives every sequence and genotype its posterior weight, then solves weighted normal equations. An
individual with its sequences is one row. All models of a step (loci of a scan, cofactors to drop) are fitted together: a round is one job that adds up
each open model's equations in tasks, then in Spark, and solves them in executors; coefficients come back."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.functions import chains
from crossloom.functions.maps import np_mf
from crossloom.functions.stats import f_quantile
from crossloom.model import Cross
from crossloom.operators.hmm import Track, codes, lists, sequences, tracks
from crossloom.operators.sums import TaskSums, added
from crossloom.runtime import materialise, prepare

MAX_PER_IND = 82


def likely_sequences(emit: np.ndarray, init: np.ndarray, steps: list[np.ndarray], min_prob: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """States (from 0) and log probabilities of all sequences of at least ``min_prob`` times the best one's probability, the likeliest first
    (ties: smaller states first); of ``min_prob`` 1, the first alone. None if there are more than ``most``. ``emit``: (loci, states)."""
    with np.errstate(divide="ignore"):
        e, t, first = np.log(emit), [np.log(s) for s in steps], np.log(init)
    rest = [np.zeros(emit.shape[1])]
    for j in range(len(steps) - 1, -1, -1):
        rest.append((t[j] + e[j + 1] + rest[-1]).max(1))
    rest.reverse()
    at_end = first + e[0] + rest[0]
    least = at_end.max() + math.log(min_prob) - 1e-9
    keep = np.flatnonzero(at_end >= least)
    paths, p = keep[:, None], (first + e[0])[keep]
    for j in range(len(steps)):
        if min_prob < 1 and len(paths) > most:
            return None
        new = p[:, None] + t[j][paths[:, -1]] + e[j + 1]
        if min_prob >= 1:  # one sequence: the smallest state that ends best
            k = int(np.argmax((new + rest[j + 1])[0] >= least))
            row, state = np.array([0]), np.array([k])
            paths, p = paths[:1], p[:1]
            new = new[:1]
        else:
            row, state = np.nonzero(new + rest[j + 1] >= least)
        paths, p = np.concatenate([paths[row], state[:, None]], axis=1), new[row, state]
    if min_prob >= 1:
        return paths[:1], p[:1]
    if len(paths) > most:
        return None
    order = np.lexsort((*paths.T[::-1], -np.round(p, 9)))
    return paths[order], p[order]


def augmented_sequences(emit: np.ndarray, init: np.ndarray, steps: list[np.ndarray], min_prob: float, most: int, strategy: str, seed: tuple) -> tuple[np.ndarray, np.ndarray, bool]:
    """(states, log probabilities, flag) of one individual. Flagged ones have more than ``most`` likely sequences: by ``default`` the best one
    stays alone, ``impute`` adds ``most`` - 1 draws from the posterior, ``drop`` leaves none."""
    got = likely_sequences(emit, init, steps, min_prob, most)
    if got is not None:
        return *got, False
    if strategy == "drop":
        return np.zeros((0, len(emit)), np.int64), np.zeros(0), True
    paths, p = likely_sequences(emit, init, steps, 1.0, most)
    if strategy == "impute" and most > 1:
        drawn = chains.sample(emit[None], init, steps, most - 1, [seed])[0].T.astype(np.int64) - 1
        with np.errstate(divide="ignore"):
            q = np.log(init)[drawn[:, 0]] + np.log(emit)[np.arange(len(emit)), drawn].sum(1) + sum(np.log(s)[drawn[:, j], drawn[:, j + 1]] for j, s in enumerate(steps))
        paths, p = np.concatenate([paths, drawn]), np.append(p, q)
    return paths, p, True


def _strategy(strategy: str) -> None:
    if strategy not in ("default", "impute", "drop"):
        raise ValueError("strategy is default, impute or drop")


def _weights(p: np.ndarray) -> np.ndarray:
    w = np.exp(p - p.max()) if len(p) else p
    return w / w.sum() if len(p) else w


#: Sequences that a task keeps the augmentation of; individuals whose equations are added up at once.
MOST_KEPT, ROWS = 1 << 16, 1 << 13


class _Kept:
    """What ``make(row)`` gives for rows of codes. Rows that are equal are worked out once (each for itself where ``own``: draws depend on the individual)."""

    def __init__(self):
        self.known: dict = {}

    def all(self, rows: np.ndarray, make, own=None) -> list:
        if len(self.known) > MOST_KEPT:
            self.known.clear()
        out = []
        for i, row in enumerate(rows):
            key = row.tobytes() if own is None else (row.tobytes(), own[i])
            if key not in self.known:
                self.known[key] = make(i)
            out.append(self.known[key])
        return out


def _copies(ind: np.ndarray, chr_: str, found: list) -> pa.RecordBatch:
    """The rows of ``augment``: ``found`` has (weights, flag, genotypes from 1) of each individual; equal ones are the same object."""
    distinct = {id(x): x for x in found}
    at = {k: j for j, k in enumerate(distinct)}
    kind = np.array([at[id(x)] for x in found])
    size = np.array([len(w) for w, _, _ in distinct.values()])
    n = size[kind]
    first = (np.cumsum(size) - size)[kind]
    row = np.repeat(np.arange(len(ind)), n)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = first[row] + copy
    weight = np.concatenate([w for w, _, _ in distinct.values()])[place]
    g = np.concatenate([x for _, _, x in distinct.values()])[place].astype(np.int32)
    over = np.array([o for _, o, _ in distinct.values()], bool)[kind][row]
    return pa.RecordBatch.from_arrays([pa.array(ind[row], pa.int64()), pa.array([chr_]).take(pa.array(np.zeros(len(row), np.int32))), pa.array((copy + 1).astype(np.int32)), pa.array(weight), pa.array(over), lists(g, pa.int32())], schema=_ARROW)


_COPIES = "ind long, chr string, copy int, weight double, over boolean, g array<int>"
_ARROW = pa.schema([("ind", pa.int64()), ("chr", pa.string()), ("copy", pa.int32()), ("weight", pa.float64()), ("over", pa.bool_()), ("g", pa.list_(pa.int32()))])


def augment(cross: Cross, max_per_ind: int = MAX_PER_IND, min_prob: float = 0.1, strategy: str = "default", error: float = 1e-4, seed: int = 1) -> DataFrame:
    """ind, chr, copy, weight, over, g: complete genotype sequences of each individual and chromosome that are at least ``min_prob`` times as
    likely as its best one, with weights that sum to one; ``over`` marks individuals with more than ``max_per_ind`` of them."""
    _strategy(strategy)
    spark = cross.geno.sparkSession
    prepare(spark)
    t, kind = tracks(cross), (cross.crosstype, cross.scheme)
    number = {c: k for k, c in enumerate(sorted(t))}

    def run(batches):
        kept = {c: _Kept() for c in t}
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("ind").to_numpy()
            for c, track in t.items():
                typed = codes(b, track)

                def one(i, c=c, track=track, typed=typed, ids=ids):
                    emit = chains.emissions(kind[0], typed[i : i + 1], error, track.chrtype)[0]
                    paths, p, over = augmented_sequences(emit, chains.initial(kind[0], track.chrtype, kind[1]), track.steps(kind), min_prob, max_per_ind, strategy, (seed, number[c], int(ids[i])))
                    return _weights(p), over, paths + 1

                yield _copies(ids, c, kept[c].all(typed, one, ids if strategy == "impute" else None))

    return sequences(cross).mapInArrow(run, _COPIES)


def augment_on_cofactors(cross: Cross, cofactors: list[str], max_per_ind: int = MAX_PER_IND, min_prob: float = 0.1, strategy: str = "default", error: float = 1e-4, seed: int = 1) -> DataFrame:
    """As ``augment``, but only the cofactors' missing genotypes are augmented (by the map of cofactors alone); other markers take their
    genotype of the likeliest sequence, with the whole map's loci in ``g``. A chromosome without cofactors has one sequence."""
    _strategy(strategy)
    prepare(cross.geno.sparkSession)
    named = set(cofactors)
    t, kind = tracks(cross), (cross.crosstype, cross.scheme)
    part = tracks(cross.with_(map=cross.map.where(F.col("marker").isin(sorted(named)))))
    places = {c: [k for k, m in enumerate(x.names) if m in named] for c, x in t.items()}
    number = {c: k for k, c in enumerate(sorted(part))}

    def run(batches):
        kept = {c: _Kept() for c in t}
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("ind").to_numpy()
            for c, track in t.items():
                typed = codes(b, track)

                def one(i, c=c, track=track, typed=typed, ids=ids):
                    emit = chains.emissions(kind[0], typed[i : i + 1], error, track.chrtype)
                    filled = chains.viterbi(emit, chains.initial(kind[0], track.chrtype, kind[1]), track.steps(kind))
                    if c not in part:
                        return np.ones(1), False, filled
                    emit = chains.emissions(kind[0], typed[i : i + 1, places[c]], error, part[c].chrtype)[0]
                    paths, p, over = augmented_sequences(emit, chains.initial(kind[0], part[c].chrtype, kind[1]), part[c].steps(kind), min_prob, max_per_ind, strategy, (seed, number[c], int(ids[i])))
                    g = np.repeat(filled, len(paths), axis=0)
                    g[:, places[c]] = paths + 1
                    return _weights(p), over, g

                yield _copies(ids, c, kept[c].all(typed, one, ids if strategy == "impute" else None))

    return sequences(cross).mapInArrow(run, _COPIES)


# Cofactor models


@dataclass(frozen=True)
class Place:
    """A locus to scan: its flanking markers' numbers in the genome (-1: none) and recombination fractions to them and between them."""

    chr: str
    pos: float
    name: str
    ord: int
    left: int
    right: int
    r_left: float
    r_right: float
    r_both: float


@dataclass(frozen=True)
class Model:
    """Cofactors by their markers' numbers; ``place``: the locus whose genotypes are part of the mixture, ``fitted``: whether it has an effect."""

    cofactors: tuple[int, ...]
    place: Place | None = None
    fitted: bool = True


@dataclass
class Genome:
    """Markers of the autosomes in order, and individuals with their sequences: ``rows`` has each (ind, y, w: prior weights, g: flat), ``alike``
    one row for those of equal genotypes and trait, with how many they are (times)."""

    kind: tuple
    tracks: dict[str, Track]
    number: dict[str, int]
    rows: DataFrame
    alike: DataFrame
    n: int

    @property
    def states(self) -> int:
        return chains.n_states(self.kind[0])


def genome(cross: Cross, trait: str, max_per_ind: int = MAX_PER_IND, min_prob: float = 0.1, strategy: str = "default", seed: int = 1) -> Genome:
    """Individuals with the trait and their complete sequences over all autosomes; typed genotypes are taken as they are."""
    _strategy(strategy)
    if cross.crosstype not in ("bc", "dh", "haploid", "riself", "f2"):
        raise ValueError("cofactor mixtures are for backcrosses, doubled haploids, selfed lines and intercrosses")
    prepare(cross.geno.sparkSession)
    kind = (cross.crosstype, cross.scheme)
    t = {c: x for c, x in tracks(cross).items() if x.chrtype != "X"}
    init = chains.initial(kind[0], "A", kind[1])
    steps: list[np.ndarray] = []
    for k, x in enumerate(t.values()):
        steps += ([np.broadcast_to(init, (len(init), len(init)))] if k else []) + x.steps(kind)
    number = {m: k for k, m in enumerate(m for x in t.values() for m in x.names)}
    people = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull() & ~F.isnan("y")).select("ind", "y")

    def run(batches):
        kept = _Kept()
        for b in batches:
            if not b.num_rows:
                continue
            typed = [codes(b, x) for x in t.values()]
            ids = b.column("ind").to_numpy() if "ind" in b.schema.names else None

            def one(i, typed=typed, ids=ids):
                emit = np.concatenate([chains.emissions(kind[0], x[i : i + 1], 0.0) for x in typed], axis=1)[0]
                paths, p, _ = augmented_sequences(emit, init, steps, min_prob, max_per_ind, strategy, (seed, 0 if ids is None else int(ids[i])))
                return _weights(p), paths.ravel().astype(np.int32)

            found = kept.all(np.concatenate(typed, axis=1), one, ids if strategy == "impute" else None)
            some = pa.array([len(w) > 0 for w, _ in found])
            w, g = pa.array([w for w, _ in found], pa.list_(pa.float64())), pa.array([g for _, g in found], pa.list_(pa.int32()))
            rest = [c for c in b.schema.names if c not in ("m", "g")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), w, g], names=[*rest, "w", "g"]).filter(some)

    both = sequences(cross).join(people, "ind")
    rows = both.select("m", "g", "ind", "y").mapInArrow(run, "ind long, y double, w array<double>, g array<int>")
    if strategy == "impute":  # an individual's draws are its own
        rows = materialise(rows, "augmented")
        alike = rows.select("y", F.lit(1.0).alias("times"), "w", "g")
    else:
        alike = materialise(both.groupBy("m", "g", "y").agg(F.count(F.lit(1)).cast("double").alias("times")).mapInArrow(run, "y double, times double, w array<double>, g array<int>"), "augmented")
    return Genome(kind, t, number, rows, alike, int(alike.agg(F.sum("times")).first()[0] or 0))


def _read(batches, per: int):
    """y, times, first row, prior, genotypes: of a few thousand individuals at a time; arrays of copies after those of individuals."""
    held, n = [], 0

    def out():
        y, times, copies, prior, geno = (np.concatenate(x) for x in zip(*held, strict=True))
        return np.repeat(y, copies), times, np.append(0, np.cumsum(copies))[:-1], prior, geno.reshape(-1, per)

    for b in batches:
        if b.num_rows:
            y = b.column("y").to_numpy() if "y" in b.schema.names else np.zeros(len(b))
            held.append((y, b.column("times").to_numpy(), np.diff(b.column("w").offsets.to_numpy()), b.column("w").flatten().to_numpy(), b.column("g").flatten().to_numpy()))
            n += len(b)
        if n >= ROWS:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def places(g: Genome, step: float, off_end: float, map_function: str = "haldane") -> list[Place]:
    """Markers and points every ``step`` cM of all chromosomes."""
    out = []
    for c, x in g.tracks.items():
        from crossloom.functions.maps import grid, locus_name

        markers = [g.number[m] for m in x.names]
        for k, (pos, at) in enumerate(grid(x.pos, step, off_end)):
            right = int(np.searchsorted(x.pos, pos, "right")) if at < 0 else at + 1
            left = right - 1
            r = lambda a, b: float(np_mf(np.array([abs(a - b)]), map_function)[0])
            has_left, has_right = left >= 0, right < len(markers)
            out.append(Place(c, pos, x.names[at] if at >= 0 else locus_name(c, pos), k + 1, markers[left] if has_left else -1, markers[right] if has_right else -1,
                             r(x.pos[left], pos) if has_left else 0.5, r(pos, x.pos[right]) if has_right else 0.5, r(x.pos[left], x.pos[right]) if has_left and has_right else 0.5))
    return out


def _columns(states: np.ndarray, k: int, dominance: bool) -> np.ndarray:
    """Additive codes -1, 0, 1 (two states: -1, 1), and heterozygosity."""
    add = states - 1.0 if k == 3 else 2.0 * states - 1
    return np.stack([add, (states == 1).astype(float)], axis=-1) if dominance and k == 3 else add[..., None]


def locus_given_flanks(genotypes: np.ndarray, place: Place, kind: tuple) -> np.ndarray:
    """(rows, states): probabilities at a locus given the genotypes at its flanking markers."""
    k = chains.n_states(kind[0])
    q = np.ones((len(genotypes), k))
    step = lambda r: chains.transition(kind[0], r, None, "A", kind[1])
    if place.left >= 0:
        q = q * step(place.r_left)[genotypes[:, place.left]]
    else:
        q = q * chains.initial(kind[0], "A", kind[1])
    if place.right >= 0:
        q = q * step(place.r_right).T[genotypes[:, place.right]]
    s = q.sum(1, keepdims=True)
    return np.where(s > 0, q / np.where(s > 0, s, 1), 1 / k)


def equations(y, first, prior, geno, model: Model, kind: tuple, dominance: bool, beta: np.ndarray | None, variance: float, times=None) -> np.ndarray:
    """What a batch adds to a model: normal equations of posterior weights (columns: intercept, cofactors, locus; trait last), then the log
    likelihood. ``first``: where each individual's rows begin; without ``beta`` the weights are prior ones; ``times``: how many individuals each one stands for."""
    k = chains.n_states(kind[0])
    n = len(geno)
    x = np.concatenate([np.ones((n, 1)), *(_columns(geno[:, m], k, dominance) for m in model.cofactors)], axis=1)
    q = np.ones((n, 1)) if model.place is None else locus_given_flanks(geno, model.place, kind)
    effect = model.place is not None and model.fitted
    own = _columns(np.arange(k), k, dominance) if effect else np.zeros((q.shape[1], 0))
    w = prior[:, None] * q
    ll = 0.0
    count = np.diff(np.append(first, n))
    if beta is not None:
        fit = (x @ beta[: x.shape[1]])[:, None] + (own @ beta[x.shape[1] :])[None, :]
        log_f = -((y[:, None] - fit) ** 2) / (2 * variance) - 0.5 * math.log(2 * math.pi * variance)
        top = np.repeat(np.maximum.reduceat(log_f.max(1), first), count)
        w = w * np.exp(log_f - top[:, None])
        total = np.add.reduceat(w.sum(1), first)
        each = np.log(total) + top[first]
        ll = float(each.sum() if times is None else each @ times)
    w = w * np.repeat((1 if times is None else times) / np.add.reduceat(w.sum(1), first), count)[:, None]
    d = x.shape[1] + own.shape[1] + 1
    out = np.zeros((d, d))
    for v in range(q.shape[1]):
        z = np.concatenate([x, np.broadcast_to(own[v], (n, own.shape[1])), y[:, None]], axis=1)
        out += z.T @ (z * w[:, v, None])
    return np.append(out.ravel(), ll)


def fit(g: Genome, models: list[Model], dominance: bool = False, variance: float | None = None, adjust: bool = False, maxit: int = 1000, tol: float = 1e-5) -> list[tuple[float, float]]:
    """(log likelihood, variance) of each model by EM. ``variance``: known and kept; ``adjust``: a last step divides by individuals less
    coefficients (REML). A warning says how many models aren't settled."""
    kind, per = g.kind, len(g.number)
    state: dict[int, tuple] = {k: (None, variance or 1.0) for k in range(len(models))}
    open_, closing, last, done = set(state), set(), {}, {}
    for _ in range(maxit + 2):
        if not open_:
            break
        now = {k: (models[k], *state[k]) for k in open_}

        def task(batches, now=now):
            sums = TaskSums()

            def out():
                rows = list(sums.rows())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], names=["k", "s"])

            for y, times, first, prior, geno in _read(batches, per):
                for k, (m, beta, var) in now.items():
                    sums.add((k,), equations(y, first, prior, geno, m, kind, dominance, beta, var, times))
                if sums.full:
                    yield from out()
            yield from out()

        def solve(batches):
            for pdf in batches:
                rows = []
                for k, s in zip(pdf["k"], pdf["s"], strict=True):
                    d = math.isqrt(len(s) - 1)
                    a = np.asarray(s[:-1]).reshape(d, d)
                    b = np.linalg.lstsq(a[:-1, :-1], a[:-1, -1], rcond=1e-12)[0]
                    rows.append((k, b, float(a[-1, -1] - 2 * b @ a[:-1, -1] + b @ a[:-1, :-1] @ b), float(s[-1])))
                yield pd.DataFrame(rows, columns=["k", "beta", "rss", "ll"])

        got = added(g.alike.select("y", "times", "w", "g").mapInArrow(task, "k int, s array<double>"), ["k"], "s").mapInPandas(solve, "k int, beta array<double>, rss double, ll double")
        for r in got.collect():
            k, beta, ll = r["k"], np.array(r["beta"]), r["ll"]
            if k in closing:
                done[k] = ll, state[k][1]
                open_.discard(k)
                continue
            if state[k][0] is not None and abs(ll - last.get(k, -1e300)) <= tol:
                if adjust and variance is None:
                    state[k] = beta, max(r["rss"] / max(1, g.n - len(beta)), 1e-300)
                    closing.add(k)
                else:
                    done[k] = ll, state[k][1]
                    open_.discard(k)
                continue
            if state[k][0] is not None:
                last[k] = ll
            state[k] = beta, max(r["rss"] / g.n, 1e-300) if variance is None else variance
        if not g.n:
            break
    if open_:
        warnings.warn(f"{len(open_)} mixture models aren't settled after {maxit} rounds", stacklevel=2)
    return [done.get(k, (last.get(k, 0.0), state[k][1])) for k in range(len(models))]


def mqm_scan(cross: Cross, trait: str, cofactors: list[str] | None = None, significance: float = 0.02, window: float = 25.0, step: float = 5.0, off_end: float = 0.0, ml: bool = False, dominance: bool = False,
             max_per_ind: int = MAX_PER_IND, min_prob: float = 0.1, strategy: str = "default", maxit: int = 1000, backward: bool = True, seed: int = 1) -> tuple[DataFrame, list[str]]:
    """chr, pos, ord, locus, trait, lod, info of every locus, and the cofactors that are left.

    Cofactors go one by one, the least likely first, as long as twice the loss of log likelihood is below twice the F quantile of 2 degrees of freedom; then each locus is
    fitted with those that are left and not within ``window`` cM of it. The LOD compares with the same cofactors without the locus. By REML
    (the default) the residual variance is that of the model with all cofactors, less bias, throughout; by ``ml`` each model has its own.
    ``info``: the mean over individuals of the largest probability of a genotype at the locus."""
    g = genome(cross, trait, max_per_ind, min_prob, strategy, seed)
    spark = cross.geno.sparkSession
    left = tuple(sorted(g.number[m] for m in cofactors or [] if m in g.number))
    columns = 2 if dominance and g.states == 3 else 1
    full, variance = fit(g, [Model(left)], dominance, None, not ml, maxit)[0]
    fixed = None if ml else variance
    if backward and left:
        most = 2 * f_quantile(1 - significance, 2, max(1, g.n - 1 - columns * len(left)))
        best = full
        while left:
            fits = fit(g, [Model(left[:k] + left[k + 1 :]) for k in range(len(left))], dominance, fixed, False, maxit)
            k = max(range(len(left)), key=lambda k: (fits[k][0], -k))
            if 2 * (best - fits[k][0]) >= most:
                break
            best, left = fits[k][0], left[:k] + left[k + 1 :]
    position = {g.number[m]: (c, float(p)) for c, x in g.tracks.items() for m, p in zip(x.names, x.pos, strict=True)}
    loci = places(g, step, off_end)
    near = lambda p: tuple(m for m in left if not (position[m][0] == p.chr and abs(position[m][1] - p.pos) < window))
    used = [near(p) for p in loci]
    bases = sorted(set(used))
    fits = fit(g, [*(Model(u) for u in bases), *(Model(u, p) for u, p in zip(used, loci, strict=True))], dominance, fixed, False, maxit)
    base = {u: fits[k][0] for k, u in enumerate(bases)}
    sure = information(g, loci)
    rows = [(p.chr, p.pos, p.ord, p.name, trait, max(0.0, (fits[len(bases) + k][0] - base[used[k]]) / math.log(10)), sure[k]) for k, p in enumerate(loci)]
    name = {k: m for m, k in g.number.items()}
    return spark.createDataFrame(rows, "chr string, pos double, ord int, locus string, trait string, lod double, info double"), [name[m] for m in left]


def information(g: Genome, loci: list[Place]) -> list[float]:
    """For each locus, the mean over individuals of the largest genotype probability under prior weights."""
    kind, per = g.kind, len(g.number)

    def task(batches):
        total = np.zeros(len(loci))
        for _, times, first, prior, geno in _read(batches, per):
            for k, p in enumerate(loci):
                total[k] += times @ np.add.reduceat(prior[:, None] * locus_given_flanks(geno, p, kind), first).max(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loci)), pa.int32()), pa.array(total)], names=["k", "s"])

    got = {r["k"]: r["s"] for r in g.alike.select("times", "w", "g").mapInArrow(task, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return [got.get(k, 0.0) / max(1, g.n) for k in range(len(loci))]
