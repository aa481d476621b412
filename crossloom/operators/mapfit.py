"""Maps under crossover interference, the fit of its parameters, and maps of either sex.

Under the Stahl model, points on the four-strand bundle advance a stage; every (m + 1)-th of them is a chiasma, a share p of chiasmata
comes without interference, and a chiasma has a gamete recombine with probability 1/2. So a gamete's chain has (allele, stage) as its
states, and an interval's transitions follow from the Poisson number of points in it: none of its chiasmata leaves the allele alone, any
other number makes both alleles alike likely. An intercross has two such gametes, whose chains run side by side: joint probabilities are
matrices with a gamete on either side, never a chain of squared states.

Individuals who agree on a chromosome are one row with a count (``patterns``). A round of EM is one Spark job for all settings of the parameters and all
chromosomes that aren't settled; its tasks add up expected recombinations and log likelihoods, so the driver sees a number for each interval."""

from __future__ import annotations

import itertools
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.functions import chains
from crossloom.functions.maps import np_imf, np_imf_stahl, np_mf
from crossloom.model import Cross
from crossloom.operators.hmm import by_chromosome, lists, sequences, tracks
from crossloom.operators.sums import TaskSums
from crossloom.runtime import materialise, prepare

#: Numbers that a kernel holds at once (64 MB).
MOST_NUMBERS = 8 << 20


def point_shares(mean: float, size: int) -> np.ndarray:
    """P(n = k modulo ``size``) and P(n = k) for k < size, of a Poisson number n: two rows."""
    top = int(mean + 12 * np.sqrt(mean + 1)) + 3 * size
    top += -top % size
    with np.errstate(divide="ignore"):
        log_p = np.arange(top) * np.log(mean) - mean if mean > 0 else np.where(np.arange(top) == 0, 0.0, -np.inf)
    p = np.exp(log_p - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top)))]))
    return np.array([p.reshape(-1, size).sum(0), p[:size]])


def gamete_steps(d: np.ndarray, m: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """For intervals of ``d`` cM: transitions of (allele, stage), allele by allele, and their recombinant part."""
    size = m + 1
    stage = np.arange(size)
    ahead = (stage[None, :] - stage[:, None]) % size
    free = stage[None, :] >= stage[:, None]  # without passing a chiasma
    out = np.zeros((len(d), 2, size, 2, size))
    for k, x in enumerate(np.asarray(d, float) / 100):
        all_, none = point_shares(2 * size * (1 - p) * x, size)
        same = np.where(free, none[ahead], 0.0)
        half = (all_[ahead] - same) / 2
        other = 0.5 * -np.expm1(-2 * p * x)
        stay, change = same + half, half
        out[k, 0, :, 0] = out[k, 1, :, 1] = (1 - other) * stay + other * change
        out[k, 0, :, 1] = out[k, 1, :, 0] = (1 - other) * change + other * stay
    rec = out.copy()
    rec[:, 0, :, 0] = rec[:, 1, :, 1] = 0
    return out.reshape(len(d), 2 * size, 2 * size), rec.reshape(len(d), 2 * size, 2 * size)


def _onward(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    return x @ t if x.ndim == 2 else t.T @ x @ t


def _recombined(x: np.ndarray, t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Weighted by the share of gametes that recombine."""
    return x @ r if x.ndim == 2 else (r.T @ x @ t + t.T @ x @ r) / 2


def _back(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    return y @ t.T if y.ndim == 2 else t @ y @ t.T


def expected_recombinations(emit: np.ndarray, weight: np.ndarray, steps: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over rows of (rows, loci, states) or (rows, loci, states, states): the expected recombinant share of each interval, and the
    natural log likelihood."""
    n, loci = emit.shape[:2]
    axes = tuple(range(1, emit.ndim - 1))
    scale = lambda x: x.sum(axes, keepdims=True)
    x = emit[:, 0] / np.prod(emit.shape[2:])
    s = scale(x)
    a, ll = [x / s], np.log(s).reshape(n)
    for j in range(1, loci):
        x = _onward(a[-1], steps[j - 1]) * emit[:, j]
        s = scale(x)
        a.append(x / s)
        ll += np.log(s).reshape(n)
    out, y = np.zeros(loci - 1), emit[:, -1]
    for j in range(loci - 2, -1, -1):
        whole = (_onward(a[j], steps[j]) * y).sum(axes)
        out[j] = weight @ ((_recombined(a[j], steps[j], rec[j]) * y).sum(axes) / whole)
        y = _back(y, steps[j])
        y = y / scale(y) * emit[:, j]
    return out, float(weight @ ll)


def gamete_emissions(crosstype: str, codes: np.ndarray, error: float, chrtype: str, m: int) -> np.ndarray:
    """P(code | alleles), for (allele, stage) of one gamete or of two."""
    e = chains.emissions(crosstype, codes, error, chrtype)
    allele = np.repeat([0, 1], m + 1)
    if e.shape[-1] == 2:
        return e[..., allele]
    return e[..., allele[:, None] + allele[None, :]]


def patterns(cross: Cross, t: dict) -> DataFrame:
    """chr, g (codes of its markers), n: how many individuals have them. Individuals with fewer than two typed markers on a chromosome say
    nothing of its map and are left out there."""
    schema = "chr string, g array<int>"

    def one(name, b, g):
        some = g[(g > 0).sum(1) > 1]
        return {"chr": [name] * len(some), "g": lists(some.astype(np.int32), pa.int32())} if len(some) else None

    rows = sequences(cross).mapInArrow(by_chromosome(one, t, schema), schema)
    return materialise(rows.groupBy("chr", "g").agg(F.count(F.lit(1)).alias("n")), "patterns")


@dataclass
class Setting:
    """Parameters, and the intervals (in cM) and natural log likelihoods that EM has come to, by chromosome."""

    m: int
    p: float
    error: float
    d: dict[str, np.ndarray]
    ll: dict[str, float] = field(default_factory=dict)

    @property
    def total(self) -> float:
        return sum(self.ll.values())


def _sums(rows: DataFrame, kind: str, t: dict, work: list[tuple[int, str, Setting]]) -> dict[tuple[int, str], tuple[np.ndarray, float, int]]:
    """For each (number, chromosome): expected recombinations, log likelihood, count of individuals."""
    by_chr: dict[str, list] = {}
    for k, c, s in work:
        steps, rec = gamete_steps(s.d[c], s.m, s.p)
        by_chr.setdefault(c, []).append((k, s.m, s.error, steps, rec))

    def run(batches):
        held = TaskSums()
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            for c, jobs in by_chr.items():
                own = b.filter(pa.array(names == c))
                if not own.num_rows:
                    continue
                g = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                n = own.column(2).to_numpy().astype(float)
                for k, m, error, steps, rec in jobs:
                    states = steps.shape[1] ** (1 if chains.n_states(kind, t[c].chrtype) == 2 else 2)
                    size = max(1, MOST_NUMBERS // (3 * states * g.shape[1]))
                    for at in range(0, len(g), size):
                        s, ll = expected_recombinations(gamete_emissions(kind, g[at : at + size], error, t[c].chrtype, m), n[at : at + size], steps, rec)
                        held.add((k, c), np.concatenate([s, [ll, n[at : at + size].sum()]]))
        found = [(k, c, j, x) for k, c, v in held.rows() for j, x in enumerate(v)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*found, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.float64()), strict=True)], names=["k", "chr", "j", "x"])

    got: dict[tuple[int, str], dict[int, float]] = {}
    for r in rows.mapInArrow(run, "k int, chr string, j int, x double").groupBy("k", "chr", "j").agg(F.sum("x").alias("x")).collect():
        got.setdefault((r["k"], r["chr"]), {})[r["j"]] = r["x"]
    out = {}
    for key, v in got.items():
        x = np.array([v[j] for j in range(len(v))])
        out[key] = (x[:-2], float(x[-2]), int(round(x[-1])))
    return out


def settle(rows: DataFrame, kind: str, t: dict, settings: list[Setting], maxit: int, tol: float) -> None:
    """EM for all settings at once, until each chromosome's intervals stay; log likelihoods are those of the last intervals. A warning says
    how many aren't settled after ``maxit`` rounds."""
    open_ = {(k, c) for k in range(len(settings)) for c in t if t[c].n_markers > 1}
    last: set[tuple[int, str]] = set()
    for turn in range(maxit + 1):
        if not open_:
            break
        got = _sums(rows, kind, t, [(k, c, settings[k]) for k, c in sorted(open_)])
        for k, c in sorted(open_):
            s = settings[k]
            if (k, c) not in got:  # nobody is typed at two markers
                open_.discard((k, c))
                continue
            x, s.ll[c], n = got[k, c]
            if (k, c) in last:
                open_.discard((k, c))
                continue
            if turn == maxit:
                continue
            r = np.clip(x / n, tol / 100, 0.5 - tol / 100)
            new = np_imf_stahl(r, s.m, s.p)
            if (np.abs(new - s.d[c]) <= tol * (s.d[c] + 100 * tol)).all():
                last.add((k, c))
            s.d[c] = new
    if open_ - last:
        warnings.warn(f"maps of {len(open_ - last)} chromosomes and settings aren't settled after {maxit} rounds", stacklevel=3)


def _checked(cross: Cross) -> None:
    if cross.crosstype not in ("bc", "f2"):
        raise ValueError("interference is for backcrosses and intercrosses")


def est_map_interference(cross: Cross, m: int, p: float = 0.0, error: float = 1e-4, maxit: int = 4000, tol: float = 1e-6) -> tuple[DataFrame, dict[str, float]]:
    """A new map under the Stahl model, and each chromosome's log10 likelihood."""
    _checked(cross)
    spark = cross.geno.sparkSession
    prepare(spark)
    t = tracks(cross)
    s = Setting(m, p, error, {c: np.maximum(np.diff(x.pos), 1e-8) for c, x in t.items()})
    settle(patterns(cross, t), cross.crosstype, t, [s], maxit, tol)
    pos = [(name, float(x)) for c, y in t.items() for name, x in zip(y.names, y.pos[0] + np.concatenate([[0], np.cumsum(s.d[c])]), strict=True)]
    new = spark.createDataFrame(pos, "marker string, pos double")
    return cross.map.drop("pos").join(new, "marker").select(cross.map.columns), {c: x / np.log(10) for c, x in s.ll.items()}


def fit_stahl(cross: Cross, m: int | list[int] | None = None, p: float | None = None, error: float | None = 1e-4, max_m: int = 15, maxit: int = 4000, tol: float = 1e-4, precision: float = 1e-3) -> DataFrame:
    """m, p, error_prob, loglik (natural): the Stahl model's parameters by maximum likelihood, of all chromosomes together.

    ``m``, where given, is one value or several, with a row for each; otherwise orders from 0 on are compared until the likelihood falls, up to ``max_m``. ``p`` and
    ``error`` that are None are searched in [0, 1] and [0, 0.5]: brackets of all orders shrink together, by a few inner points each, and a
    wave of points is fitted by the same EM jobs. A bracket's ends take part, so 0 is always tried. ``precision``: width of the last
    bracket of p (a tenth of it for the error)."""
    _checked(cross)
    spark = cross.geno.sparkSession
    prepare(spark)
    t = tracks(cross)
    rows = patterns(cross, t)
    orders = list(range(max_m + 1)) if m is None else [m] if isinstance(m, int) else list(m)
    start = {c: np.maximum(np.diff(x.pos), 1e-8) for c, x in t.items()}
    # The order 0 has no use for p.
    free_p, free_e = {k: p is None and k > 0 for k in orders}, error is None
    bracket = {k: [(0.0, 1.0) if free_p[k] else (p or 0.0,) * 2, (0.0, 0.5) if free_e else (error,) * 2] for k in orders}
    best: dict[int, Setting] = {}
    least = (precision, precision / 10)
    left = list(orders)
    while left:
        wave, own = [], {}
        for k in left:
            both = sum(lo < hi for lo, hi in bracket[k]) > 1
            axes = [np.linspace(lo, hi, 5 if both else 9) if lo < hi else np.array([lo]) for lo, hi in bracket[k]]
            base = best[k].d if k in best else start
            own[k] = axes, [Setting(k, float(x), float(y), dict(base)) for x, y in itertools.product(*axes)]
            wave += own[k][1]
        settle(rows, cross.crosstype, t, wave, maxit, tol)
        still = []
        for k in left:
            axes, tried = own[k]
            top = max(tried, key=lambda s: (s.total, -s.p, -s.error))
            if k not in best or top.total > best[k].total:
                best[k] = top
            for a, value in enumerate((top.p, top.error)):
                x = axes[a]
                if len(x) > 1:
                    at = int(np.argmin(np.abs(x - value)))
                    bracket[k][a] = (float(x[max(0, at - 1)]), float(x[min(len(x) - 1, at + 1)]))
            if any(hi - lo > w for (lo, hi), w in zip(bracket[k], least, strict=True)):
                still.append(k)
        left = still
    chosen = orders
    if m is None:
        at = 0
        while at + 1 < len(orders) and best[orders[at + 1]].total >= best[orders[at]].total:
            at += 1
        chosen = [orders[at]]
    return spark.createDataFrame([(k, best[k].p, best[k].error, best[k].total) for k in chosen], "m int, p double, error_prob double, loglik double")


def est_map_sexes(cross: Cross, error: float = 1e-4, map_function: str = "haldane", maxit: int = 4000, tol: float = 1e-6) -> tuple[DataFrame, dict[str, float]]:
    """Maps of both sexes of a four-way cross (pos: the mother's meioses, pos_male: the father's), and each chromosome's log10 likelihood."""
    if cross.crosstype != "4way":
        raise ValueError("maps of both sexes are for four-way crosses")
    spark = cross.geno.sparkSession
    prepare(spark)
    t = tracks(cross)
    rows = patterns(cross, t)
    clip = lambda r: np.clip(r, tol / 1000, 0.5 - tol / 1000)
    r = {c: (clip(np_mf(np.diff(x.pos), map_function)), clip(np_mf(np.diff(x.pos if x.pos_male is None else x.pos_male), map_function))) for c, x in t.items()}
    state = np.arange(4)
    masks = [(state[:, None] % 2 != state % 2).astype(float), (state[:, None] // 2 != state // 2).astype(float)]
    open_, ll = {c for c in t if t[c].n_markers > 1}, {}

    def sums(now):
        def run(batches):
            held = TaskSums()
            for b in batches:
                names = np.array(b.column(0).to_pylist(), object)
                for c, (female, male) in now.items():
                    own = b.filter(pa.array(names == c))
                    if not own.num_rows:
                        continue
                    g, n = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1), own.column(2).to_numpy().astype(float)
                    steps = [chains.transition("4way", float(f), float(x), t[c].chrtype) for f, x in zip(female, male, strict=True)]
                    emit, init = chains.emissions("4way", g, error, t[c].chrtype), chains.initial("4way", t[c].chrtype)
                    pair = chains.pair_posterior(emit, init, steps)
                    s = [np.einsum("n,njuv,uv->j", n, pair, mask) for mask in masks]
                    held.add((c,), np.concatenate([*s, [n @ chains.forward(emit, init, steps)[1], n.sum()]]))
            found = [(c, j, x) for c, v in held.rows() for j, x in enumerate(v)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.float64()), strict=True)], names=["chr", "j", "x"])

        got = {c: {} for c in now}
        for x in rows.mapInArrow(run, "chr string, j int, x double").groupBy("chr", "j").agg(F.sum("x").alias("x")).collect():
            got[x["chr"]][x["j"]] = x["x"]
        return {c: np.array([v[j] for j in range(len(v))]) for c, v in got.items() if v}

    for _ in range(maxit):
        if not open_:
            break
        got = sums({c: r[c] for c in open_})
        for c in sorted(open_):
            if c not in got:
                open_.discard(c)
                continue
            k = len(r[c][0])
            new = [clip(got[c][a * k : (a + 1) * k] / got[c][-1]) for a in range(2)]
            ll[c] = got[c][-2] / np.log(10)
            if all((np.abs(a - b) <= tol * (np.abs(a) + 100 * tol)).all() for a, b in zip(new, r[c], strict=True)):
                open_.discard(c)
            r[c] = tuple(new)
    if open_:
        warnings.warn(f"est_map: not settled after {maxit} rounds: chromosomes {', '.join(sorted(open_))}", stacklevel=2)
    pos = []
    for c, x in t.items():
        at = [np.concatenate([[0], np.cumsum(np_imf(v, map_function))]) for v in r[c]]
        first = x.pos[0] if x.pos_male is None else x.pos_male[0]
        pos += [(m, float(a), float(b)) for m, a, b in zip(x.names, x.pos[0] + at[0], first + at[1], strict=True)]
    new_pos = spark.createDataFrame(pos, "marker string, pos double, pos_male double")
    return cross.map.drop("pos", "pos_male").join(new_pos, "marker").select(cross.map.columns), ll
