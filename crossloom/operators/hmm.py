"""Genotype reconstruction along chromosomes.

An individual's typed genotypes are one row (one shuffle, by individual); kernels run over Arrow batches of such rows, chromosome
by chromosome, vectorised over individuals. Maps are metadata and go along with the code."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from crossloom.functions import chains
from crossloom.functions.maps import grid, locus_name, np_imf, np_mf, np_mf_stahl
from crossloom.model import PROB, Cross
from crossloom.runtime import materialise, prepare

SHORT_END = 5.0
#: Markers whose numbers go along with every task.
MOST_MARKERS = 200_000


@dataclass(frozen=True)
class Track:
    """A chromosome's loci: positions (and male ones), names, index of the marker or -1; its first marker's number in the whole map."""

    chrtype: str
    pos: np.ndarray
    pos_male: np.ndarray | None
    names: list
    marker: np.ndarray
    n_markers: int
    offset: int

    def steps(self, cross_: tuple, map_function: str = "haldane", r: np.ndarray | None = None, m: int = 0, p: float = 0.0) -> list[np.ndarray]:
        crosstype, scheme = cross_
        if r is None:
            d = np.diff(self.pos)
            r = np_mf_stahl(d, m, p) if m or p else np_mf(d, map_function)
        male = np_mf(np.diff(self.pos_male), map_function) if self.pos_male is not None and crosstype == "4way" else [None] * len(r)
        return [chains.transition(crosstype, float(x), None if y is None else float(y), self.chrtype, scheme) for x, y in zip(r, male, strict=True)]


def tracks(cross: Cross, step: float = 0.0, off_end: float = 0.0, stepwidth: str = "fixed") -> dict[str, Track]:
    """Loci of each chromosome. A chromosome with one marker gets at least 5 cM on both sides if there is a step."""
    out, offset = {}, 0
    rows = cross.map.orderBy("chr", "ord").toPandas()
    for name, m in rows.groupby("chr", sort=False):
        pos = m["pos"].to_numpy(float)
        end = max(off_end, SHORT_END) if len(pos) == 1 and step > 0 else off_end
        loci = grid(pos, step, end, stepwidth)
        at = np.array([x for x, _ in loci])
        index = np.array([k for _, k in loci])
        male = m["pos_male"].to_numpy(float)
        male = None if np.isnan(male).any() else np.interp(at, pos, male)
        out[name] = Track(m["chrtype"].iloc[0], at, male, [m["marker"].iloc[k] if k >= 0 else locus_name(name, x) for x, k in loci], index, len(pos), offset)
        offset += len(pos)
    return out


def sequences(cross: Cross) -> DataFrame:
    """ind, m (numbers of typed markers in the map's order, ascending), g: a row for every individual."""
    order = [(r["marker"], k) for k, r in enumerate(cross.map.orderBy("chr", "ord").select("marker").collect())]
    place = cross.map.sparkSession.createDataFrame(order, "marker string, m int")
    if len(order) <= MOST_MARKERS:  # else genotypes would be sorted by marker, in as many tasks as there are markers
        place = F.broadcast(place)
    typed = cross.geno.where("g IS NOT NULL").join(place, "marker").groupBy("ind").agg(F.array_sort(F.collect_list(F.struct("m", "g"))).alias("x"))
    return cross.individual.select("ind").join(typed, "ind", "left").select("ind", F.coalesce("x.m", F.array().cast("array<int>")).alias("m"), F.coalesce("x.g", F.array().cast("array<int>")).alias("g"))


def codes(batch: pa.RecordBatch, track: Track) -> np.ndarray:
    """(individuals, loci) of codes, 0 where nothing is typed; of rows with columns m and g."""
    m, g = batch.column("m"), batch.column("g")
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(m).to_numpy(zero_copy_only=False))
    m, g = m.flatten().to_numpy(zero_copy_only=False), g.flatten().to_numpy(zero_copy_only=False)
    own = (m >= track.offset) & (m < track.offset + track.n_markers)
    typed = np.zeros((len(batch), track.n_markers), np.int64)
    typed[row[own], m[own] - track.offset] = g[own]
    full = np.zeros((len(batch), len(track.pos)), np.int64)
    has = track.marker >= 0
    full[:, has] = typed[:, track.marker[has]]
    return full


def by_chromosome(fn, t: dict[str, Track], schema: str):
    """For ``mapInArrow``: ``fn(chromosome, batch, codes)`` gives a dict of columns for each batch of sequences."""

    def run(batches):
        kinds = to_arrow_schema(_parse(schema))
        for b in batches:
            if len(b):
                for name, track in t.items():
                    out = fn(name, b, codes(b, track))
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k.type) for x, k in ((out[k.name], k) for k in kinds)], schema=kinds)

    return run


def _parse(schema: str):
    from pyspark.sql import types as T

    simple = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    kind = lambda x: T.ArrayType(simple[x[6:-1]]) if x.startswith("array<") else simple[x]
    return T.StructType([T.StructField(*((n, kind(k)))) for n, k in (x.split(" ") for x in schema.split(", "))])


def lists(x: np.ndarray, kind=None) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column, without Python objects."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _long(b: pa.RecordBatch, name: str, track: Track, **columns) -> dict:
    n, loci = len(b), len(track.pos)
    names = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(loci, dtype=np.int32), n)), pa.array(track.names)).dictionary_decode()
    return {"ind": np.repeat(b.column("ind").to_numpy(), loci), "chr": pa.array([name]).take(pa.array(np.zeros(n * loci, np.int32))), "locus": names, "ord": np.tile(np.arange(1, loci + 1, dtype=np.int32), n), "pos": np.tile(track.pos, n), **columns}


def calc_genoprob(cross: Cross, step: float = 0.0, off_end: float = 0.0, error: float = 1e-4, map_function: str = "haldane", stepwidth: str = "fixed") -> DataFrame:
    """ind, chr, locus, ord, pos, p: probabilities of genotypes given all of a chromosome's markers."""
    prepare(cross.geno.sparkSession)
    t, kind = tracks(cross, step, off_end, stepwidth), (cross.crosstype, cross.scheme)

    def one(name, b, g):
        track = t[name]
        emit = chains.emissions(kind[0], g, error, track.chrtype)
        p = chains.posterior(emit, chains.initial(kind[0], track.chrtype, kind[1]), track.steps(kind, map_function))
        return _long(b, name, track, p=lists(p.reshape(-1, p.shape[2])))

    return sequences(cross).mapInArrow(by_chromosome(one, t, PROB), PROB)


def calc_pairprob(cross: Cross, step: float = 0.0, off_end: float = 0.0, error: float = 1e-4, map_function: str = "haldane", stepwidth: str = "fixed") -> DataFrame:
    """ind, chr, locus1, locus2, p: joint probabilities of each pair of loci of a chromosome, the second one's genotype running fastest."""
    prepare(cross.geno.sparkSession)
    t, kind = tracks(cross, step, off_end, stepwidth), (cross.crosstype, cross.scheme)
    schema = "ind long, chr string, locus1 string, locus2 string, p array<double>"

    def one(name, b, g):
        track = t[name]
        if len(track.pos) < 2:
            return None
        emit = chains.emissions(kind[0], g, error, track.chrtype)
        init, steps = chains.initial(kind[0], track.chrtype, kind[1]), track.steps(kind, map_function)
        joint = chains.pair_posterior(emit, init, steps)
        onward = joint / np.maximum(joint.sum(3, keepdims=True), 1e-300)
        parts, first, second = [], [], []
        for i in range(len(track.pos) - 1):
            x = joint[:, i]
            for j in range(i + 1, len(track.pos)):
                if j > i + 1:
                    x = np.matmul(x, onward[:, j - 1])
                parts.append(x.reshape(len(b), -1))
                first.append(track.names[i])
                second.append(track.names[j])
        n, m = len(b), len(parts)
        return {"ind": np.repeat(b.column("ind").to_numpy(), m), "chr": [name] * (n * m), "locus1": first * n, "locus2": second * n, "p": lists(np.stack(parts, axis=1).reshape(n * m, -1))}

    return sequences(cross).mapInArrow(by_chromosome(one, t, schema), schema)


def argmax_geno(cross: Cross, step: float = 0.0, off_end: float = 0.0, error: float = 1e-4, map_function: str = "haldane", stepwidth: str = "fixed") -> DataFrame:
    """ind, chr, locus, ord, pos, g: the most likely sequence (ties: the smaller genotype)."""
    prepare(cross.geno.sparkSession)
    t, kind = tracks(cross, step, off_end, stepwidth), (cross.crosstype, cross.scheme)

    schema = "ind long, chr string, locus string, ord int, pos double, g int"

    def one(name, b, g):
        track = t[name]
        emit = chains.emissions(kind[0], g, error, track.chrtype)
        path = chains.viterbi(emit, chains.initial(kind[0], track.chrtype, kind[1]), track.steps(kind, map_function))
        return _long(b, name, track, g=path.astype(np.int32).ravel())

    return sequences(cross).mapInArrow(by_chromosome(one, t, schema), schema)


def sim_geno(cross: Cross, n_draws: int = 16, step: float = 0.0, off_end: float = 0.0, error: float = 1e-4, map_function: str = "haldane", stepwidth: str = "fixed", seed: int = 1) -> DataFrame:
    """ind, chr, locus, ord, pos, g: array of joint draws. Streams depend on (seed, chromosome, individual) only."""
    prepare(cross.geno.sparkSession)
    t, kind = tracks(cross, step, off_end, stepwidth), (cross.crosstype, cross.scheme)
    number = {c: k for k, c in enumerate(sorted(t))}

    schema = "ind long, chr string, locus string, ord int, pos double, g array<int>"

    def one(name, b, g):
        track = t[name]
        emit = chains.emissions(kind[0], g, error, track.chrtype)
        x = chains.sample(emit, chains.initial(kind[0], track.chrtype, kind[1]), track.steps(kind, map_function), n_draws, [(seed, number[name], int(i)) for i in b.column("ind").to_numpy()])
        return _long(b, name, track, g=lists(x.reshape(-1, n_draws), pa.int32()))

    return sequences(cross).mapInArrow(by_chromosome(one, t, schema), schema)


def fill_geno(cross: Cross, method: str = "argmax", error: float = 1e-4, min_prob: float = 0.95, seed: int = 1) -> Cross:
    """Missing genotypes filled: argmax, imp (one draw), maxmarginal (where a probability reaches ``min_prob``), no_dbl_XO
    (between equal typed genotypes)."""
    cols = ["ind", "chr", "marker", "ord", "g"]
    if method == "argmax":
        new = argmax_geno(cross, error=error)
    elif method == "imp":
        new = sim_geno(cross, 1, error=error, seed=seed).withColumn("g", F.get("g", F.lit(0)))
    elif method == "maxmarginal":
        top = F.array_max("p")
        new = calc_genoprob(cross, error=error).where(top >= min_prob).withColumn("g", F.array_position("p", top).cast("int"))
    else:
        from pyspark.sql import Window

        w = Window.partitionBy("ind", "chr").orderBy("ord")
        full = cross.individual.select("ind").join(F.broadcast(cross.map.select("chr", "marker", "ord"))).join(cross.geno.select("ind", "marker", "g"), ["ind", "marker"], "left")
        left, right = F.last("g", True).over(w), F.first("g", True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return cross.with_(geno=full.withColumns({"l": left, "r": right}).withColumn("g", F.coalesce("g", F.when(F.col("l") == F.col("r"), F.col("l")))).where("g IS NOT NULL").select(cols))
    return cross.with_(geno=new.select("ind", "chr", F.col("locus").alias("marker"), "ord", F.col("g").cast("int").alias("g")))


def _special(t: dict, kind: tuple, name: str, g: np.ndarray, error: float, map_function: str) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors when only the marker itself may be wrong, and which states agree with its code."""
    track = t[name]
    init, steps = chains.initial(kind[0], track.chrtype, kind[1]), track.steps(kind, map_function)
    sure, noisy = chains.emissions(kind[0], g, 1e-12, track.chrtype), chains.emissions(kind[0], g, error, track.chrtype)
    a, back = chains.forward(sure, init, steps)[0], chains.backward(sure, steps)
    prior = np.empty_like(a)
    prior[:, 0] = init
    for j in range(1, a.shape[1]):
        prior[:, j] = a[:, j - 1] @ steps[j - 1]
    p = prior * noisy * back
    return p / p.sum(2, keepdims=True), sure > 0.5


def calc_genoprob_special(cross: Cross, error: float = 1e-4, map_function: str = "haldane") -> DataFrame:
    """As ``calc_genoprob`` at markers, but each marker's posterior takes all other markers as they are."""
    prepare(cross.geno.sparkSession)
    t, kind = tracks(cross), (cross.crosstype, cross.scheme)

    def one(name, b, g):
        p, _ = _special(t, kind, name, g, error, map_function)
        return _long(b, name, t[name], p=lists(p.reshape(-1, p.shape[2])))

    return sequences(cross).mapInArrow(by_chromosome(one, t, PROB), PROB)


def calc_errorlod(cross: Cross, error: float = 0.01, map_function: str = "haldane") -> DataFrame:
    """ind, chr, marker, errorlod: log10 odds that a typed genotype is wrong, given the other markers as they are."""
    prepare(cross.geno.sparkSession)
    t, kind = tracks(cross), (cross.crosstype, cross.scheme)
    schema = "ind long, chr string, locus string, errorlod double"

    def one(name, b, g):
        p, agree = _special(t, kind, name, g, error, map_function)
        right = (p * agree).sum(2)
        with np.errstate(divide="ignore"):
            lod = np.log10(np.maximum(1 - right, 0) / np.maximum(right, 1e-300)) + np.log10((1 - error) / error)
        lod = np.where(g > 0, np.maximum(lod, -12), 0.0)
        seen = pa.array((g > 0).ravel())
        return {k: pa.array(x).filter(seen) if isinstance(x, np.ndarray) else x.filter(seen) for k, x in _long(b, name, t[name], errorlod=lod.ravel()).items()}

    return sequences(cross).mapInArrow(by_chromosome(one, t, schema), schema).withColumnRenamed("locus", "marker")


def top_errorlod(errorlod: DataFrame, cutoff: float = 4.0) -> DataFrame:
    return errorlod.where(F.col("errorlod") > cutoff).orderBy(F.desc("errorlod"), "ind", "marker")


def _map_sums(seq: DataFrame, t: dict, kind: tuple, r: dict, error: float) -> dict:
    """Expected recombinant share summed over individuals for each interval, count of individuals, log10 likelihood. ``seq``: m, g, times."""

    schema = "chr string, k int, s double, n long"

    def one(name, b, g):
        track = t[name]
        emit = chains.emissions(kind[0], g, error, track.chrtype)
        init, steps = chains.initial(kind[0], track.chrtype, kind[1]), track.steps(kind, r=r[name])
        times = b.column("times").to_numpy()
        ll = float(times @ chains.forward(emit, init, steps)[1]) / np.log(10)
        pp = chains.pair_posterior(emit, init, steps)
        s = [float(times @ (pp[:, j] * chains.crossings(kind[0], r[name][j], pp.shape[2])).sum((1, 2))) for j in range(pp.shape[1])]
        n = len(s) + 1
        return {"chr": [name] * n, "k": np.arange(n, dtype=np.int32), "s": [*s, ll], "n": [int(times.sum())] * n}

    rows = seq.mapInArrow(by_chromosome(one, t, schema), schema).groupBy("chr", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # combined in each task first
    return {(x["chr"], x["k"]): (x["s"], x["n"]) for x in rows}


def est_map(cross: Cross, error: float = 1e-4, map_function: str = "haldane", maxit: int = 4000, tol: float = 1e-6, m: int = 0, p: float = 0.0, sex_specific: bool = True) -> tuple[DataFrame, dict[str, float]]:
    """A new map by EM, and each chromosome's log10 likelihood. A round is one Spark job whose partial sums are one row for each
    interval and batch; the driver keeps recombination fractions only. A warning names chromosomes that ``maxit`` rounds leave unsettled.

    ``m``, ``p``: interference by the Stahl model, in backcrosses and intercrosses (the map function has no use there). ``sex_specific``: a four-way
    cross gets a map of each sex. Both are in ``mapfit``."""
    from crossloom.operators import mapfit

    if m > 0 and p < 1:
        if cross.crosstype in ("bc", "f2"):
            return mapfit.est_map_interference(cross, m, p, error, maxit, tol)
        warnings.warn("est_map: m and p are for backcrosses and intercrosses only", stacklevel=2)
    if cross.crosstype == "4way" and sex_specific:
        return mapfit.est_map_sexes(cross, error, map_function, maxit, tol)
    spark = cross.geno.sparkSession
    prepare(spark)
    t, kind = tracks(cross), (cross.crosstype, cross.scheme)
    seq = materialise(sequences(cross).groupBy("m", "g").agg(F.count(F.lit(1)).alias("times")), "sequences")  # individuals that are alike are one row
    r = {c: np.clip(np_mf(np.diff(x.pos), map_function), tol / 1000, 0.5 - tol / 1000) for c, x in t.items()}
    open_, ll = {c for c in t if len(r[c])}, {}
    for _ in range(maxit):
        if not open_:
            break
        got = _map_sums(seq, {c: t[c] for c in open_}, kind, r, error)
        for c in sorted(open_):
            new = np.array([got[c, k][0] / got[c, k][1] for k in range(len(r[c]))])
            new = np.clip(new, tol / 1000, 0.5 - tol / 1000)
            ll[c] = got[c, len(r[c])][0]
            if (np.abs(new - r[c]) <= tol * (np.abs(new) + 100 * tol)).all():
                open_.discard(c)
            r[c] = new
    if open_:
        warnings.warn(f"est_map: not settled after {maxit} rounds: chromosomes {', '.join(sorted(open_))}", stacklevel=2)
    pos = []
    for c, x in t.items():
        rr = r[c]
        if kind[0] == "riself":
            rr = rr / (2 - 2 * rr)
        elif kind[0] == "risib":
            rr = rr / (4 - 6 * rr)
        pos += [(m, float(p)) for m, p in zip(x.names, x.pos[0] + np.concatenate([[0], np.cumsum(np_imf(rr, map_function))]), strict=True)]
    new_pos = spark.createDataFrame(pos, "marker string, pos double")
    return cross.map.drop("pos").join(new_pos, "marker").select(cross.map.columns), ll


def marker_loglik(cross: Cross, marker: str, error: float = 1e-4) -> float:
    """Natural log likelihood of one marker alone: counts of codes are all that is needed."""
    n = cross.geno.where(F.col("marker") == marker).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    g = np.array([x["g"] for x in n], np.int64)
    return float((np.array([x["n"] for x in n], float) * np.log(chains.emissions(cross.crosstype, g, error) @ chains.initial(cross.crosstype, "A", cross.scheme))).sum()) if n else 0.0


def info(prob: DataFrame) -> DataFrame:
    """chr, locus, pos, entropy and variance versions of missing information: 0 where all genotypes are known."""
    ent = F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    mean = F.aggregate(F.transform("p", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    sq = F.aggregate(F.transform("p", lambda x, i: x * i * i), F.lit(0.0), lambda a, x: a + x)
    k = F.max(F.size("p"))
    most = F.when(k == 3, 1.5 * np.log(2)).otherwise(F.log(k))
    var0 = F.when(k == 3, 0.5).otherwise((k * k - 1) / 12)
    return prob.groupBy("chr", "locus", "pos").agg((-F.avg(ent) / most).alias("entropy"), (F.avg(sq - mean * mean) / var0).alias("variance"))
