"""Models with several loci: formulas, fits, scans in a model's context, stepwise search.

A fit is one pass over individuals that sums the Gram matrix of all columns a model could have; every sub-model (drop-one
tables, interactions) is solved from blocks of that matrix."""

from __future__ import annotations

import functools
import itertools
import math
import re
import warnings
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.functions import chains
from crossloom.functions.stats import chi2_sf, f_sf
from crossloom.model import Cross
from crossloom.operators.hmm import Track, codes, lists, tracks
from crossloom.operators.scan import rss, weighted_average
from crossloom.operators.scan2 import _chromosomes, gram_of_kinds, people
from crossloom.operators.sums import TaskSums, added
from crossloom.runtime import materialise, prepare

#: Penalties on the LOD scale (main, heavy, light) at the 5 % level.
PENALTIES = {"f2": (3.52, 4.28, 2.69), "bc": (2.69, 2.62, 1.19)}


# Formulas: a set of terms, each a frozenset of factor names


def parse_formula(text: str) -> frozenset[frozenset[str]]:
    """``y~Q1*Q2+sex`` to terms; a product brings its lower terms, so formulas are always hierarchical."""
    terms: set[frozenset[str]] = set()
    for part in text.split("~")[-1].replace(" ", "").split("+"):
        if not part or part == "1":
            continue
        factors = re.split(r"[*:]", part)
        for k in range(1, len(factors) + 1):
            terms |= {frozenset(c) for c in itertools.combinations(factors, k)}
    return frozenset(terms)


def _number(f: str) -> tuple:
    return (0, int(f[1:]), "") if re.fullmatch(r"Q\d+", f) else (1, 0, f)


def format_term(term: frozenset) -> str:
    return ":".join(sorted(term, key=_number))


def format_formula(terms: frozenset[frozenset[str]]) -> str:
    order = sorted((sorted(t, key=_number) for t in terms), key=lambda t: (len(t), [_number(f) for f in t]))
    return "y ~ " + " + ".join(":".join(t) for t in order) if order else "y ~ 1"


def renumber_formula(terms, table: dict[str, str]):
    return frozenset(frozenset(table.get(f, f) for f in t) for t in terms)


def drop_from_formula(terms, factor: str):
    return frozenset(t for t in terms if factor not in t)


def is_symmetric(terms, a: str, b: str) -> bool:
    return renumber_formula(terms, {a: b, b: a}) == terms


def count_terms(terms) -> tuple[int, int, int]:
    """(main, heavy, light): interactions of loci form a graph; in each of its components one edge for each new locus is
    light but the first, all others are heavy."""
    main = sum(len(t) == 1 and next(iter(t)).startswith("Q") for t in terms)
    edges = [tuple(t) for t in terms if len(t) == 2 and all(re.fullmatch(r"Q\d+", f) for f in t)]
    heavy = light = 0
    seen: set[str] = set()
    while left := [e for e in edges if not seen & set(e)]:
        comp = set(left[0])
        while more := {f for e in edges if comp & set(e) for f in e} - comp:
            comp |= more
        n = sum(set(e) <= comp for e in edges)
        heavy, light = heavy + n - 1, light + 1
        seen |= comp
    return main, heavy, light


def calc_plod(lod: float, terms, penalties=(3.52, 4.28, 2.69)) -> float:
    return lod - sum(n * p for n, p in zip(count_terms(terms), penalties, strict=True))


def count_terms_x(terms, on_x: set[str]) -> tuple[int, int, int, int, int, int]:
    """(mainA, mainX, intH, intL, intAX, intXX), where ``on_x`` names the loci on X: in each component of the graph of interactions, one of
    those between autosomes is light."""
    main = [next(iter(t)) for t in terms if len(t) == 1 and re.fullmatch(r"Q\d+", next(iter(t)))]
    edges = [tuple(t) for t in terms if len(t) == 2 and all(re.fullmatch(r"Q\d+", f) for f in t)]
    kinds = {e: len(on_x & set(e)) for e in edges}
    heavy = light = 0
    seen: set[str] = set()
    while left := [e for e in edges if not seen & set(e)]:
        comp = set(left[0])
        while more := {f for e in edges if comp & set(e) for f in e} - comp:
            comp |= more
        both = sum(set(e) <= comp and kinds[e] == 0 for e in edges)
        light, heavy = light + (both > 0), heavy + max(0, both - 1)
        seen |= comp
    x = sum(f in on_x for f in main)
    return len(main) - x, x, heavy, light, sum(k == 1 for k in kinds.values()), sum(k == 2 for k in kinds.values())


def calc_plod_x(lod: float, terms, penalties, on_x: set[str]) -> float:
    """Penalised LOD with six penalties; an infinite one forbids its terms."""
    return lod - sum(n * p for n, p in zip(count_terms_x(terms, on_x), penalties, strict=True) if n)


# Models


@dataclass(frozen=True)
class Qtl:
    """Loci of a model: chromosome, position, name of the locus; named Q1, Q2, ... in order."""

    loci: tuple[tuple[str, float, str], ...] = ()
    attributes: dict = field(default_factory=dict, compare=False)

    def __len__(self) -> int:
        return len(self.loci)


def _nearest(t: dict[str, Track], chr_: str, pos: float) -> tuple[str, float, str]:
    k = int(np.abs(t[chr_].pos - pos).argmin())
    return chr_, float(t[chr_].pos[k]), t[chr_].names[k]


def make_qtl(cross: Cross, chrs: list[str], pos: list[float], step: float = 0.0) -> Qtl:
    t = tracks(cross, step)
    return Qtl(tuple(_nearest(t, c, p) for c, p in zip(chrs, pos, strict=True)))


def add_to_qtl(cross: Cross, qtl: Qtl, chr_: str, pos: float, step: float = 0.0) -> Qtl:
    return Qtl((*qtl.loci, _nearest(tracks(cross, step), chr_, pos)))


def drop_from_qtl(qtl: Qtl, index: int) -> Qtl:
    return Qtl(tuple(x for k, x in enumerate(qtl.loci, 1) if k != index))


def replace_qtl(cross: Cross, qtl: Qtl, index: int, chr_: str, pos: float, step: float = 0.0) -> Qtl:
    new = _nearest(tracks(cross, step), chr_, pos)
    return Qtl(tuple(new if k == index else x for k, x in enumerate(qtl.loci, 1)))


def reorder_qtl(qtl: Qtl, order: list[int]) -> Qtl:
    return Qtl(tuple(qtl.loci[k - 1] for k in order))


def summary_qtl(spark, qtl: Qtl) -> DataFrame:
    return spark.createDataFrame([(f"Q{k}", *x) for k, x in enumerate(qtl.loci, 1)], "name string, chr string, pos double, locus string")


def lod_of(grams: list[np.ndarray], columns, n: int, rss0: float) -> float:
    """LOD of some columns (None: all) over the mean alone; of several imputations their average."""
    each = []
    for g in grams:
        keep = [0, *(range(1, len(g) - 1) if columns is None else columns), len(g) - 1]
        r = rss(g[np.ix_(keep, keep)], len(keep) - 1)
        each.append(n / 2 * math.log10(rss0 / r) if r > 0 else 0.0)
    return each[0] if len(each) == 1 else weighted_average(np.array(each))


class Model:
    """A cross's individuals with their probabilities, stored once, for any number of fits."""

    def __init__(self, cross: Cross, trait: str, covar: DataFrame | None = None, names: list[str] | None = None, step: float = 0.0, error: float = 1e-4, map_function: str = "haldane", method: str = "hk", n_draws: int = 16, seed: int = 1):
        spark = cross.geno.sparkSession
        prepare(spark)
        self.spark, self.trait, self.names, self.method, self.n_draws = spark, trait, names or [], method, n_draws
        self.tracks, self.crosstype = tracks(cross, step), cross.crosstype
        t, kind = self.tracks, (cross.crosstype, cross.scheme)
        self.chrs = sorted(t)
        rows = people(cross, trait)
        if names:
            wide = covar.where("value IS NOT NULL").groupBy("ind").pivot("name", names).agg(F.first("value"))
            rows = rows.join(wide, "ind").withColumn("z", F.array(*(F.col(f"`{n}`").cast("double") for n in names))).where("NOT exists(z, x -> x IS NULL)")
        else:
            rows = rows.withColumn("z", F.array().cast("array<double>"))

        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                if method == "hk":
                    got = [p for p, _ in _chromosomes(b, t, kind, error, map_function).values()]
                else:
                    got = []
                    for i, c in enumerate(sorted(t)):
                        emit = chains.emissions(kind[0], codes(b, t[c]), error, t[c].chrtype)
                        got.append(chains.sample(emit, chains.initial(kind[0], t[c].chrtype, kind[1]), t[c].steps(kind, map_function), n_draws, [(seed, i, int(x)) for x in b.column("ind").to_numpy()]).astype(float))
                flat = np.concatenate([x.reshape(len(b), -1) for x in got], axis=1)
                rest = [c for c in b.schema.names if c not in ("m", "g")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists(flat)], names=[*rest, "p"])

        self._people = lambda: rows.select("m", "g", "ind", "y", "z").mapInArrow(run, "ind long, y double, z array<double>, p array<double>")
        if method == "hk":
            alike = rows.groupBy("m", "g", "z").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
            self.kinds = materialise(alike.mapInArrow(run, "z array<double>, n double, s double, q double, p array<double>"), "model-kinds")
            m = self.kinds.agg(F.sum("n").cast("long").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
        else:
            m = self.table.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).first()
        self.n, self.rss0 = m["n"], m["q"] - m["s"] ** 2 / m["n"]

    @functools.cached_property
    def table(self) -> DataFrame:
        """A row for each individual. Normal models on probabilities read ``kinds`` instead: individuals of equal sequences and covariates."""
        return materialise(self._people(), "model")

    def _index(self, locus) -> tuple[int, int]:
        c, _, name = locus
        return self.chrs.index(c), self.tracks[c].names.index(name)

    def _gram_rows(self, loci: list, terms, scan: list | None = None, fold=None) -> tuple[DataFrame, list[dict]]:
        """(s, d, g): see ``grams``; and which loci of a scan stand for which Q."""
        k = {c: chains.n_states(self.crosstype, self.tracks[c].chrtype) for c in self.chrs}
        sizes = [len(self.tracks[c].pos) for c in self.chrs]
        where = [self._index(x) for x in loci]
        several = lambda x: x if isinstance(x[0], tuple) else (x,)
        scans = [{}] if scan is None else [{f"Q{len(loci) + 1 + k}": self._index(y) for k, y in enumerate(several(x))} for x in scan]
        names, chrs, draws, hk = self.names, self.chrs, self.n_draws, self.method == "hk"
        order = sorted(terms, key=lambda t: (len(t), sorted(t, key=_number)[0], sorted(t)))
        cuts = np.cumsum([sizes[c] * (k[x] if hk else draws) for c, x in enumerate(chrs)])[:-1]

        def factor(f, p, z, d, extra):
            if f in names:
                return z[:, [names.index(f)]]
            c, at = extra[f] if f in extra else where[int(f[1:]) - 1]
            x = p[c]
            if hk:
                return x[:, at, 1:]
            return (x[:, at, d][:, None] == np.arange(2, k[chrs[c]] + 1)).astype(float)

        def run(batches):
            sums = TaskSums()
            for pdf in batches:
                n = len(pdf)
                flat = np.stack(pdf["p"].to_numpy())
                p = [x.reshape(n, sizes[c], -1) for c, x in enumerate(np.split(flat, cuts, axis=1))]
                z = np.stack(pdf["z"].to_numpy()).reshape(n, -1)
                for s, extra in enumerate(scans):
                    for d in range(1 if hk else draws):
                        parts = [np.ones((n, 1))]
                        for term in order:
                            x = np.ones((n, 1))
                            for f in sorted(term, key=_number):
                                x = (x[:, :, None] * factor(f, p, z, d, extra)[:, None, :]).reshape(n, -1)
                            parts.append(x)
                        x = np.concatenate(parts, axis=1)
                        if fold is not None:
                            sums.add((s, d), fold(x, pdf["y"].to_numpy(), d))
                        elif hk:
                            sums.add((s, d), gram_of_kinds(x, *(pdf[c].to_numpy() for c in ("n", "s", "q"))))
                        else:
                            m = np.concatenate([x, pdf["y"].to_numpy()[:, None]], axis=1)
                            sums.add((s, d), m.T @ m)
                if sums.full:
                    yield sent(sums)
            yield sent(sums)

        def sent(sums):
            return pd.DataFrame([(s, d, g.ravel()) for s, d, g in sums.rows()], columns=["s", "d", "g"])

        rows = self.kinds if hk and fold is None else self.table
        return added(rows.mapInPandas(run, "s int, d int, g array<double>"), ["s", "d"], "g"), scans

    def grams(self, loci: list, terms, scan: list | None = None, fold=None) -> list[np.ndarray]:
        """Gram matrices (one for each imputation, or one) of the ones, the terms' columns and the response; for a scan, the loci in it
        (or tuples of loci) take the last Q (or the last ones) in turn and there is a list for each. ``fold(x, y, d)``: other sums of the columns and the response (of imputation d) instead."""
        rows, scans = self._gram_rows(loci, terms, scan, fold)
        out: list = [[] for _ in scans]
        for r in sorted(rows.collect(), key=lambda r: (r["s"], r["d"])):
            e = math.isqrt(len(r["g"]))
            out[r["s"]].append(np.array(r["g"]).reshape(e, e) if fold is None else np.array(r["g"]))
        return out if scan is not None else out[0]

    def _spans(self, loci, terms, new: tuple | None = None) -> dict[frozenset, range]:
        order = sorted(terms, key=lambda t: (len(t), sorted(t, key=_number)[0], sorted(t)))
        at, out = 1, {}
        for term in order:
            size = 1
            for f in term:
                if f not in self.names:
                    locus = new if int(f[1:]) > len(loci) else loci[int(f[1:]) - 1]
                    size *= chains.n_states(self.crosstype, self.tracks[locus[0]].chrtype) - 1
            out[term] = range(at, at + size)
            at += size
        return out

    def scan_lods(self, loci: list, terms, scan: list, subsets: dict[tuple, list] | None = None) -> list[list[float]]:
        """LODs of each scanned locus (or tuple), of all columns, or of each list of columns that ``subsets`` has for the chromosomes of the
        tuple. Equations are solved where they are summed; what comes back is a number for each."""
        rows, scans = self._gram_rows(loci, terms, scan)
        keys = [tuple(c for c, _ in extra.values()) for extra in scans]
        n, rss0 = self.n, self.rss0

        def solve(batches):
            for pdf in batches:
                out = []
                for s, x in zip(pdf["s"], pdf["x"], strict=True):
                    e = math.isqrt(len(x[0]["g"]))
                    grams = [np.array(r["g"]).reshape(e, e) for r in x]
                    out.append((s, [lod_of(grams, c, n, rss0) for c in (subsets[keys[s]] if subsets else [None])]))
                yield pd.DataFrame(out, columns=["s", "lods"])

        whole = rows.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("d", "g"))).alias("x"))
        got = {r["s"]: r["lods"] for r in whole.mapInPandas(solve, "s int, lods array<double>").collect()}
        return [got[s] for s in range(len(scans))]

    def lod(self, grams: list[np.ndarray], columns=None) -> float:
        return lod_of(grams, columns, self.n, self.rss0)

    def fit(self, qtl: Qtl, formula: str | frozenset | None = None) -> dict:
        """LOD, share of variance, P values, and a drop-one table."""
        terms = parse_formula(formula) if isinstance(formula, str) else formula if formula is not None else frozenset(frozenset([f]) for f in [*(f"Q{k + 1}" for k in range(len(qtl))), *self.names])
        grams = self.grams(list(qtl.loci), terms)
        spans = self._spans(qtl.loci, terms)
        full, df = self.lod(grams), sum(map(len, spans.values()))
        drop = []
        for term in terms:
            gone = {t for t in terms if term <= t}
            if len(term) == 1 or gone:
                cols = [c for t in terms - gone for c in spans[t]]
                d = sum(len(spans[t]) for t in gone)
                lod = full - self.lod(grams, sorted(cols))
                r1 = self.rss0 * 10 ** (-2 * full / self.n)
                r0 = r1 * 10 ** (2 * lod / self.n)
                f = (r0 - r1) / d / (r1 / max(1, self.n - df - 1))
                drop.append((":".join(sorted(term, key=_number)), d, lod, 100 * (r0 - r1) / self.rss0, f, chi2_sf(2 * math.log(10) * lod, d), f_sf(f, d, max(1, self.n - df - 1))))
        g = grams[0]
        est = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]
        return {"lod": full, "df": df, "n": self.n, "pvar": 100 * (1 - 10 ** (-2 * full / self.n)), "p_chi2": chi2_sf(2 * math.log(10) * full, df) if df else 1.0, "p_f": f_sf((self.rss0 / (self.rss0 * 10 ** (-2 * full / self.n)) - 1) * (self.n - df - 1) / max(1, df), max(1, df), self.n - df - 1), "dropone": sorted(drop), "estimates": est, "formula": format_formula(terms)}

    def fit_binary(self, qtl: Qtl, formula: str | frozenset | None = None, maxit: int = 50, tol: float = 1e-6) -> dict:
        """LOD of a logistic model, on probabilities or on each imputation (whose LODs are averaged as those of normal models), and a drop-one table
        (term, df, lod, p_chi2). All sub-models and imputations are reweighted together: a round is one pass that sums their equations. A warning says
        how many aren't settled after ``maxit`` rounds."""
        terms = parse_formula(formula) if isinstance(formula, str) else formula if formula is not None else frozenset(frozenset([f]) for f in [*(f"Q{k + 1}" for k in range(len(qtl))), *self.names])
        spans = self._spans(qtl.loci, terms)
        columns = lambda some: [0, *sorted(c for t in some for c in spans[t])]
        gone = {None: frozenset()} | {term: frozenset(t for t in terms if term <= t) for term in sorted(terms, key=format_term)}
        subs = {term: columns(terms - g) for term, g in gone.items()}
        draws = range(1 if self.method == "hk" else self.n_draws)
        share = min(max(self.table.agg(F.avg("y").alias("m")).first()["m"], 1e-12), 1 - 1e-12)
        null = self.n * (share * math.log(share) + (1 - share) * math.log(1 - share))
        b = {(t, d): np.append(math.log(share / (1 - share)), np.zeros(len(c) - 1)) for t, c in subs.items() for d in draws}
        ll: dict = {}
        best: dict = {}
        open_ = set(b)
        for _ in range(maxit):
            if not open_:
                break
            got = self._weighted(list(qtl.loci), terms, subs, b)
            for key in list(open_):
                s, q = got[key], len(b[key])
                if key in best and s[-1] < ll[key] - 1e-9 and np.abs(b[key] - best[key]).max() > 1e-9:
                    b[key] = (b[key] + best[key]) / 2  # a step too far: half of it
                    continue
                if key in ll and abs(s[-1] - ll[key]) < tol:
                    open_.discard(key)
                ll[key], best[key] = max(s[-1], ll.get(key, -np.inf)), b[key]
                if key in open_:
                    b[key] = b[key] + np.linalg.lstsq(s[: q * q].reshape(q, q), s[q * q : -1], rcond=1e-10)[0]
        if open_:
            warnings.warn(f"fit_binary: {len(open_)} of {len(b)} fits not settled after {maxit} rounds", stacklevel=2)

        def lod(term) -> float:
            each = np.array([(ll[term, d] - null) / math.log(10) for d in draws])
            return float(each[0]) if self.method == "hk" else weighted_average(each)

        full, drop = lod(None), []
        for term, g in gone.items():
            if term is not None:
                df, loss = sum(len(spans[t]) for t in g), full - lod(term)
                drop.append((format_term(term), df, loss, chi2_sf(2 * math.log(10) * max(0.0, loss), df)))
        return {"lod": full, "df": len(subs[None]) - 1, "n": self.n, "dropone": sorted(drop), "estimates": np.mean([best[None, d] for d in draws], axis=0), "formula": format_formula(terms)}

    def _weighted(self, loci: list, terms, subs: dict, b: dict) -> dict:
        """(sub-model, imputation) -> sums of x'wx, x'(y - mu) and the log likelihood of a logistic model of its columns."""

        def fold(x, y, d):
            out = []
            for term, cols in subs.items():
                z = x[:, cols]
                eta = np.clip(z @ b[term, d], -30, 30)
                mu = 1 / (1 + np.exp(-eta))
                w = np.maximum(mu * (1 - mu), 1e-12)
                out.append(np.concatenate([((z * w[:, None]).T @ z).ravel(), z.T @ (y - mu), [(y * eta - np.logaddexp(0, eta)).sum()]]))
            return np.concatenate(out)

        ends = np.cumsum([len(c) ** 2 + len(c) + 1 for c in subs.values()])[:-1]
        got = self.grams(loci, terms, None, fold)
        return {(term, d): s for d, whole in enumerate(got) for term, s in zip(subs, np.split(whole, ends), strict=True)}

    def all_loci(self, chrs: list[str] | None = None) -> list:
        return [(c, float(self.tracks[c].pos[k]), self.tracks[c].names[k]) for c in chrs or self.chrs for k in range(len(self.tracks[c].pos))]

    def add_qtl(self, qtl: Qtl, terms: frozenset | None = None, inter: str | None = None, loci: list | None = None) -> list[tuple]:
        """(chr, pos, locus, lod over the model without it) for one more locus everywhere, optionally interacting with a factor."""
        base = terms if terms is not None else frozenset(frozenset([f"Q{k + 1}"]) for k in range(len(qtl)))
        new = f"Q{len(qtl) + 1}"
        full = base | {frozenset([new])} | ({frozenset([new, inter])} if inter else frozenset())
        scan = loci or self.all_loci()
        null = self.lod(self.grams(list(qtl.loci), base)) if base else 0.0
        return [(*x, lod - null) for x, (lod,) in zip(scan, self.scan_lods(list(qtl.loci), full, scan), strict=True)]

    def add_int(self, qtl: Qtl, terms: frozenset) -> list[tuple]:
        """(interaction, LOD gained) for each pair of loci that doesn't interact yet: one pass with all of them."""
        pairs = [frozenset(p) for p in itertools.combinations([f"Q{k + 1}" for k in range(len(qtl))], 2) if frozenset(p) not in terms]
        if not pairs:
            return []
        every = terms | set(pairs)
        grams, spans = self.grams(list(qtl.loci), every), self._spans(qtl.loci, every)
        base = [c for t in terms for c in spans[t]]
        null = self.lod(grams, sorted(base))
        return [(p, self.lod(grams, sorted([*base, *spans[p]])) - null) for p in pairs]

    def add_covar_int(self, qtl: Qtl, terms: frozenset) -> list[tuple]:
        pairs = [frozenset([f"Q{k + 1}", z]) for k in range(len(qtl)) for z in self.names if frozenset([f"Q{k + 1}", z]) not in terms]
        every = terms | set(pairs) | {frozenset([z]) for z in self.names}
        grams, spans = self.grams(list(qtl.loci), every), self._spans(qtl.loci, every)
        base = [c for t in every - set(pairs) for c in spans[t]]
        null = self.lod(grams, sorted(base))
        return [(":".join(sorted(p, key=_number)), self.lod(grams, sorted([*base, *spans[p]])) - null) for p in pairs]

    def refine(self, qtl: Qtl, terms: frozenset, maxit: int = 10) -> Qtl:
        """Move each locus in turn to the best place on its chromosome until none moves. Attributes hold the LOD profiles."""
        loci, profiles = list(qtl.loci), {}
        for _ in range(maxit):
            before = list(loci)
            for k in range(len(loci)):
                others = [x for i, x in enumerate(loci) if i != k]
                table = {f"Q{i + 1}": f"Q{i + 1 - (i > k)}" for i in range(len(loci)) if i != k} | {f"Q{k + 1}": f"Q{len(loci)}"}
                taken = {x[2] for x in others}
                scan = [x for x in self.all_loci([loci[k][0]]) if x[2] not in taken]
                moved = renumber_formula(terms, table)
                lods = [lod for (lod,) in self.scan_lods(others, moved, scan)]
                loci[k], profiles[k] = scan[int(np.argmax(lods))], list(zip(scan, lods, strict=True))
            if loci == before:
                break
        else:
            warnings.warn(f"refine: loci still move after {maxit} rounds", stacklevel=2)
        return Qtl(tuple(loci), {"profiles": profiles})

    def add_pair(self, qtl: Qtl, terms: frozenset | None = None, chrs: list[str] | None = None) -> list[tuple]:
        """(chr1, pos1, locus1, chr2, pos2, locus2, lod_full, lod_add) for two more loci everywhere, with and without an interaction of
        them, over the model without them. All pairs go through in one pass."""
        base = terms if terms is not None else frozenset(frozenset([f"Q{k + 1}"]) for k in range(len(qtl)))
        a, b = f"Q{len(qtl) + 1}", f"Q{len(qtl) + 2}"
        every = base | {frozenset([a]), frozenset([b]), frozenset([a, b])}
        pairs = list(itertools.combinations(self.all_loci(chrs), 2))
        null = self.lod(self.grams(list(qtl.loci), base)) if base else 0.0
        first = {c: (c, float(self.tracks[c].pos[0]), self.tracks[c].names[0]) for c in self.chrs}
        subsets = {}
        for i, c1 in enumerate(self.chrs):  # which columns the interaction has depends on chromosomes only
            for j, c2 in enumerate(self.chrs):
                spans = self._spans([*qtl.loci, first[c1], first[c2]], every)
                subsets[i, j] = [None, sorted(c for t in every - {frozenset([a, b])} for c in spans[t])]
        return [(*x, *y, full - null, plain - null) for (x, y), (full, plain) in zip(pairs, self.scan_lods(list(qtl.loci), every, pairs, subsets), strict=True)]

    def _on_x(self, loci) -> set[str]:
        return {f"Q{k + 1}" for k, x in enumerate(loci) if self.tracks[x[0]].chrtype == "X"}

    def check_start(self, qtl: Qtl, terms: frozenset) -> None:
        """A start of a stepwise search must name its loci, each once as a main effect, and no others."""
        wanted = {f"Q{k + 1}" for k in range(len(qtl))}
        named = {f for t in terms for f in t}
        if unknown := named - wanted - set(self.names):
            raise ValueError(f"unknown factors: {sorted(unknown)}")
        if unused := wanted - {f for t in terms if len(t) == 1 for f in t}:
            raise ValueError(f"loci without a main effect: {sorted(unused)}")

    def stepwise(self, max_qtl: int = 5, penalties=None, additive_only: bool = False, refine: bool = True, start: tuple[Qtl, frozenset] | None = None) -> tuple[Qtl, frozenset, float]:
        """Forward selection to ``max_qtl`` loci, then backward deletion; the model with the best penalised LOD of all seen.

        Three penalties (main, heavy, light), or six for autosomes and X (see ``count_terms_x``). Covariates stay in all models, and LODs
        are over the model with these alone. ``start``: loci and terms to begin with."""
        pen = tuple(penalties.values()) if isinstance(penalties, dict) else penalties or PENALTIES["bc" if chains.n_states(self.crosstype) == 2 else "f2"]
        always = frozenset(frozenset([z]) for z in self.names)
        null = self.lod(self.grams([], always)) if always else 0.0

        def plod(lod, terms, loci):
            return calc_plod_x(lod - null, terms, pen, self._on_x(loci)) if len(pen) == 6 else calc_plod(lod - null, terms, pen)

        whole = lambda q, t: self.lod(self.grams(list(q.loci), t)) if t else 0.0
        qtl, terms = start or (Qtl(), frozenset())
        self.check_start(qtl, terms)
        terms = terms | always
        best = (plod(whole(qtl, terms), terms, qtl.loci), qtl, terms) if len(qtl) else (0.0, qtl, terms)
        while len(qtl) < max_qtl:
            taken = {x[2] for x in qtl.loci}
            free = [x for x in self.all_loci() if x[2] not in taken]
            if not free:
                break
            new, now = f"Q{len(qtl) + 1}", whole(qtl, terms)
            tries = []
            for inter in [None, *([] if additive_only else [f"Q{k + 1}" for k in range(len(qtl))])]:
                t = terms | {frozenset([new])} | ({frozenset([new, inter])} if inter else frozenset())
                gains = self.add_qtl(qtl, terms, inter, free)
                for kind in sorted({self.tracks[x[0]].chrtype for x in gains}):  # the best autosomal locus, and the best one on X
                    got = max((x for x in gains if self.tracks[x[0]].chrtype == kind), key=lambda x: (x[3], -x[1]))
                    tries.append((plod(now + got[3], t, [*qtl.loci, got[:3]]), got[:3], t))
            if not additive_only:
                for pair, gain in self.add_int(qtl, terms):
                    tries.append((plod(now + gain, terms | {pair}, qtl.loci), None, terms | {pair}))
            _, locus, terms = max(tries, key=lambda x: x[0])
            if locus is not None:
                qtl = Qtl((*qtl.loci, locus))
            if refine and len(qtl) > 1:
                qtl = self.refine(qtl, terms)
            score = plod(whole(qtl, terms), terms, qtl.loci)
            if score > best[0]:
                best = (score, qtl, terms)
        while len(qtl):
            weakest = None
            grams, spans = self.grams(list(qtl.loci), terms), self._spans(qtl.loci, terms)
            for term in terms - always:
                if any(term < t for t in terms):
                    continue
                rest = terms - {term}
                names = {f"Q{k + 1}" for k in range(len(qtl))} & {f for t in rest for f in t}
                s = self.lod(grams, sorted(c for t in rest for c in spans[t])) - null
                s = calc_plod_x(s, rest, pen, self._on_x(qtl.loci) & names) if len(pen) == 6 else calc_plod(s, rest, pen)
                if weakest is None or s > weakest[0]:
                    weakest = (s, term, rest)
            s, term, terms = weakest
            if len(term) == 1:
                k = int(next(iter(term))[1:])
                terms = renumber_formula(terms, {f"Q{i}": f"Q{i - 1}" for i in range(k + 1, len(qtl) + 1)})
                qtl = drop_from_qtl(qtl, k)
            if refine and len(qtl):
                qtl = self.refine(qtl, terms)
                s = plod(whole(qtl, terms), terms, qtl.loci)
            if s > best[0]:
                best = (s, qtl, terms)
        return best[1], best[2], best[0]

    def scan_qtl(self, positions: list[list[tuple]], terms: frozenset | None = None) -> list[tuple]:
        """LODs over the grid of several loci: ``positions`` has a list of loci for each Q. One pass for the whole grid."""
        terms = terms or frozenset(frozenset([f"Q{k + 1}"]) for k in range(len(positions)))
        places = list(itertools.product(*positions))
        return [(*x, lod) for x, (lod,) in zip(places, self.scan_lods([], terms, places), strict=True)]


def cim(cross: Cross, trait: str, n_marcovar: int = 3, window: float = 10.0) -> DataFrame:
    """Composite interval mapping: markers chosen by forward selection are covariates, but for those within half a window of the
    position scanned."""
    model = Model(cross, trait)
    chosen, terms = Qtl(), frozenset()
    for k in range(n_marcovar):
        taken = {x[2] for x in chosen.loci}
        free = [x for x in model.all_loci() if x[2] not in taken]
        if not free:
            break
        chosen = Qtl((*chosen.loci, max(model.add_qtl(chosen, terms, None, free), key=lambda x: x[3])[:3]))
        terms = terms | {frozenset([f"Q{k + 1}"])}
    groups: dict[tuple, list] = {}
    for x in model.all_loci():
        near = tuple(i for i, q in enumerate(chosen.loci) if q[0] == x[0] and abs(q[1] - x[1]) <= window / 2)
        groups.setdefault(near, []).append(x)
    rows = []
    for near, loci in groups.items():
        rest = Qtl(tuple(q for i, q in enumerate(chosen.loci) if i not in near))
        rows += [(c, p, model.tracks[c].names.index(n) + 1, n, trait, max(0.0, lod)) for c, p, n, lod in model.add_qtl(rest, None, None, loci)]
    return model.spark.createDataFrame(rows, "chr string, pos double, ord int, locus string, trait string, lod double")


def with_names(qtl: Qtl, **attributes) -> Qtl:
    return replace(qtl, attributes=qtl.attributes | attributes)
