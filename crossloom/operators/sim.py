"""Simulated maps, crosses and founders. Every individual has its own random stream, so results don't depend on partitions."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.functions.maps import np_mf
from crossloom.model import MAP, Cross
from crossloom.runtime import prepare


def sim_map(spark: SparkSession, lengths: list[float], n_mar: int = 10, anchor: bool = True, include_x: bool = True, sex_specific: bool = False, eq_spacing: bool = False, seed: int = 1) -> DataFrame:
    """Chromosomes 1, 2, ... (the last one X) with markers at random or even positions."""
    rng, rows = np.random.default_rng(seed), []
    for k, length in enumerate(lengths):
        name = "X" if include_x and k == len(lengths) - 1 and len(lengths) > 1 else str(k + 1)
        pos = np.linspace(0, length, n_mar) if eq_spacing else np.sort(rng.uniform(0, length, n_mar))
        if anchor and n_mar > 1:
            pos[0], pos[-1] = 0, length
        male = np.sort(rng.uniform(0, length, n_mar)) if sex_specific and name != "X" else [None] * n_mar
        rows += [(name, "X" if name == "X" else "A", f"D{name}M{j + 1}", j + 1, float(p), None if m is None else float(m)) for j, (p, m) in enumerate(zip(pos, male, strict=True))]
    return spark.createDataFrame(rows, MAP)


def gamete(rng: np.random.Generator, pos: np.ndarray, m: int = 0, p: float = 0.0) -> np.ndarray:
    """0/1: which of two parental strands at each position. Without interference crossovers are independent between intervals;
    with it, chiasmata are every (m + 1)-th point of a random process (a share ``p`` of them free)."""
    if m == 0 or p >= 1:
        cross = rng.random(len(pos) - 1) < np_mf(np.diff(pos), "haldane")
        return (np.concatenate([[0], np.cumsum(cross)]) + rng.integers(2)) % 2
    length = pos[-1] - pos[0]
    free = rng.uniform(0, length, rng.poisson(2 * length / 100 * p))
    points = np.sort(rng.uniform(0, length, rng.poisson(2 * (m + 1) * length / 100 * (1 - p))))
    chiasmata = np.concatenate([free, points[rng.integers(m + 1) :: m + 1]])
    kept = np.sort(chiasmata[rng.random(len(chiasmata)) < 0.5])
    return (np.searchsorted(kept, pos - pos[0]) + rng.integers(2)) % 2


def inbred(rng: np.random.Generator, pos: np.ndarray, n_str: int, kind: str, limit: int = 60) -> np.ndarray:
    """Founder (from 1) at each position of a recombinant inbred line from 2, 4 or 8 strains by selfing or sib mating."""
    lines = [[np.full(len(pos), k + 1), np.full(len(pos), k + 1)] for k in rng.permutation(n_str)]

    def child(a, b):
        return [np.where(gamete(rng, pos), x[1], x[0]) for x in (a, b)]

    while len(lines) > 2:
        lines = [child(lines[k], lines[k + 1]) for k in range(0, len(lines), 2)]
    a = child(lines[0], lines[1])
    b = child(lines[0], lines[1])
    for _ in range(limit):
        a, b = (child(a, a), b) if kind == "selfing" else (child(a, b), child(a, b))
        if (a[0] == a[1]).all() and (kind == "selfing" or (a[0] == b[0]).all() and (a[0] == b[1]).all()):
            break
    return a[0]


def sim_cross(map_: DataFrame, crosstype: str = "f2", n_ind: int = 100, model: list[tuple] | None = None, error: float = 0.0, missing: float = 0.0, partial_missing: float = 0.0, m: int = 0, p: float = 0.0, scheme: tuple[int, int] = (0, 0), seed: int = 1) -> Cross:
    """A cross with a phenotype. ``model``: (chr, pos, effect, ...) of loci: a backcross adds half the effect to one or other
    genotype, an f2 has additive and dominance effects, a four-way cross one effect for each genotype but the first."""
    spark = map_.sparkSession
    prepare(spark)
    maps = {c: x.sort_values("ord") for c, x in map_.toPandas().groupby("chr", sort=False)}
    loci = [tuple(x) for x in model or []]

    def genotype(rng, pos, x):
        if crosstype == "bc":
            return 1 + gamete(rng, pos, m, p)
        if crosstype in ("riself", "risib"):
            return inbred(rng, pos, 2, "selfing" if crosstype == "riself" else "sibmating")
        if crosstype in ("dh", "haploid"):
            return 1 + gamete(rng, pos, m, p)
        if crosstype == "4way":
            return 1 + gamete(rng, pos, m, p) + 2 * gamete(rng, pos, m, p)
        if crosstype[:3] in ("ri4", "ri8"):
            return 1 << (inbred(rng, pos, int(crosstype[2]), "selfing" if crosstype.endswith("self") else "sibmating") - 1)
        if crosstype == "bcsft":
            strands = [np.zeros(len(pos), int), np.ones(len(pos), int)]
            for _ in range(scheme[0]):
                strands = [np.where(gamete(rng, pos), strands[1], strands[0]), np.zeros(len(pos), int)]
            for _ in range(scheme[1] - (scheme[0] == 0)):
                strands = [np.where(gamete(rng, pos), strands[1], strands[0]) for _ in range(2)]
            return 1 + strands[0] + strands[1]
        return 1 + gamete(rng, pos, m, p) + (0 if x else gamete(rng, pos, m, p))

    def run(batches):
        for pdf in batches:
            geno, pheno = [], []
            for ind in pdf["id"]:
                rng = np.random.default_rng((seed, int(ind)))
                y = rng.normal()
                for c, mp in maps.items():
                    q = [x for x in loci if str(x[0]) == c]
                    pos = np.concatenate([mp["pos"].to_numpy(), [float(x[1]) for x in q]])
                    order = np.argsort(pos, kind="stable")
                    g = np.empty(len(pos), int)
                    g[order] = genotype(rng, pos[order], c == "X")
                    for x, at in zip(q, g[len(mp) :], strict=True):
                        e = [float(v) for v in x[2:]]
                        if crosstype == "f2":
                            y += e[0] * (at - 2) + (e[1] * (at == 2) if len(e) > 1 else 0)
                        elif crosstype == "4way":
                            y += e[at - 2] if 1 < at <= len(e) + 1 else 0
                        else:
                            y += e[0] * (at - 1.5)
                    g = g[: len(mp)]
                    top = {"f2": 3, "4way": 4, "bcsft": 3}.get(crosstype, 2)
                    if error:
                        bad = rng.random(len(g)) < error
                        g = np.where(bad, 1 + (g - 1 + rng.integers(1, top, len(g))) % top if top > 1 else g, g)
                    if partial_missing and crosstype == "f2":
                        part = rng.random(len(g)) < partial_missing
                        g = np.where(part, np.where(g == 1, 4, np.where(g == 3, 5, rng.choice([4, 5], len(g)))), g)
                    seen = rng.random(len(g)) >= missing
                    geno.append(pd.DataFrame({"ind": ind, "chr": c, "marker": mp["marker"].to_numpy(), "ord": mp["ord"].to_numpy(), "g": g})[seen])
                pheno.append((ind, "", "y", 0, y))
            yield pd.concat([*geno, pd.DataFrame({"ind": [x[0] for x in pheno], "chr": "", "marker": "y", "ord": 0, "g": 0, "y": [x[4] for x in pheno]})])[["ind", "chr", "marker", "ord", "g", "y"]] if geno else pd.DataFrame()

    from crossloom.runtime import materialise

    rows = materialise(spark.range(1, n_ind + 1).mapInPandas(run, "ind long, chr string, marker string, ord int, g int, y double"), "simulated")
    people = spark.range(1, n_ind + 1).select(F.col("id").alias("ind"), F.col("id").cast("string").alias("id2")).select("ind", F.col("id2").alias("id"), F.lit(0).alias("sex"), F.lit(0).alias("pgm"), F.lit(None).cast("string").alias("strata"))
    return Cross(rows.where("chr <> ''").drop("y"), rows.where("chr = ''").select("ind", F.lit("phenotype").alias("trait"), "y"), map_, people, crosstype, ("A", "B", "C", "D") if crosstype == "4way" else ("A", "B"), scheme)


def sim_founder_snps(map_: DataFrame, n_str: int = 8, pattern_frequency: list[float] | None = None, seed: int = 1) -> DataFrame:
    """marker, founder, allele (0/1): the count of founders with the second allele follows the frequencies (default: even)."""
    freq = np.array(pattern_frequency or [1.0] * (n_str // 2))
    rows = []
    for r in map_.orderBy("chr", "ord").collect():
        rng = np.random.default_rng((seed, int.from_bytes(r["marker"].encode(), "little") % 2**32))
        k = 1 + rng.choice(len(freq), p=freq / freq.sum())
        have = set(rng.choice(n_str, k, replace=False).tolist())
        rows += [(r["marker"], f + 1, int(f in have)) for f in range(n_str)]
    return map_.sparkSession.createDataFrame(rows, "marker string, founder int, allele int")


def convert_mwril(cross: Cross, founders: DataFrame, error: float = 0.0, seed: int = 1) -> DataFrame:
    """Founder genotypes (bit masks of one founder) to observed SNP codes 0/1."""
    own = cross.geno.withColumn("founder", (F.round(F.log2("g")) + 1).cast("int"))
    u = F.pmod(F.xxhash64("ind", "marker", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return own.join(founders, ["marker", "founder"]).select("ind", "chr", "marker", "ord", F.when(u < error, 1 - F.col("allele")).otherwise(F.col("allele")).alias("g"))


# Crosses of several taxa


def all_partitions(taxa: str) -> list[str]:
    """All splits of the taxa into two groups, as ``AB|C``; the first taxon stands in the first group."""
    first, rest = taxa[0], taxa[1:]
    out = []
    for k in range(len(rest)):
        for extra in itertools.combinations(rest, k):
            left = first + "".join(extra)
            out.append(left + "|" + "".join(t for t in taxa if t not in left))
    return sorted(out, key=lambda s: (min(len(x) for x in s.split("|")), s))


def check_partition(partition: str, taxa: str) -> None:
    a, b = partition.split("|")
    if sorted(a + b) != sorted(taxa) or not a or not b:
        raise ValueError(f"{partition} doesn't split {taxa}")


def check_crosses(crosses: list[str], taxa: str) -> bool:
    """Are the crosses pairs of known taxa that connect all of them?"""
    if any(len(c) != 2 or c[0] == c[1] or not set(c) <= set(taxa) for c in crosses):
        return False
    seen = {crosses[0][0]} if crosses else set()
    while more := {t for c in crosses if set(c) & seen for t in c} - seen:
        seen |= more
    return seen == set(taxa)


def qtl_by_partition(crosses: list[str], partition: str) -> list[int]:
    """For each cross: 0 (no locus segregates), 1, or -1 (with the alleles the other way round)."""
    a, b = partition.split("|")
    return [0 if (c[0] in a) == (c[1] in a) else 1 if c[0] in a else -1 for c in crosses]


def flip_cross(cross: Cross) -> Cross:
    """Alleles A and B exchanged at all markers."""
    from crossloom.operators.edit import _recode, switch_codes

    return cross.with_(geno=cross.geno.withColumn("g", _recode(F.col("g"), switch_codes(cross.crosstype)).cast("int")))


def sim_phylo(map_: DataFrame, taxa: str, partition: str, crosses: list[str], n_ind: int = 100, model: list[tuple] | None = None, seed: int = 1, **options) -> dict[str, Cross]:
    check_partition(partition, taxa)
    out = {}
    for k, (c, sign) in enumerate(zip(crosses, qtl_by_partition(crosses, partition), strict=True)):
        own = [(x[0], x[1], *(sign * float(v) for v in x[2:3]), *x[3:]) for x in model or []] if sign else None
        out[c] = sim_cross(map_, "f2", n_ind, own, seed=seed + k, **options)
    return out


def scan_phylo(crosses: dict[str, Cross], partitions: list[str], trait: str = "phenotype", **grid) -> DataFrame:
    """partition, chr, pos, ord, locus, lod: sums over crosses of regression LODs, each with alleles in the partition's sense; crosses
    in which no locus segregates under a partition add nothing. Alleles' effects are shared, so designs are pooled by their Gram sums."""
    import math

    from crossloom.operators.scan import design, locus_sums, rss

    names = list(crosses)
    sums, tables = {}, {}
    for c in names:
        for sign in (1, -1):
            cross = crosses[c] if sign == 1 else flip_cross(crosses[c])
            table, t = design(cross, trait, **grid)

            def gram(_, p, y, z, w):
                x = np.concatenate([p[:, :, 1:], np.broadcast_to(y[:, None, None], (*p.shape[:2], 1)), np.ones((*p.shape[:2], 1))], axis=2)
                return np.matmul(x.transpose(1, 2, 0), x.transpose(1, 0, 2)).reshape(p.shape[1], -1)

            sums[c, sign], tables[c] = locus_sums(table, t, gram), t
    t = tables[names[0]]
    rows = []
    for part in partitions:
        signs = qtl_by_partition(names, part)
        for key in sums[names[0], 1]:
            n = r0 = 0.0
            blocks = []
            for c, s in zip(names, signs, strict=True):
                g = sums[c, s or 1][key]
                d = math.isqrt(len(g))
                g = g.reshape(d, d)
                n += g[-1, -1]
                r0 += g[-2, -2] - g[-2, -1] ** 2 / g[-1, -1]
                blocks.append((s, g, d))
            k = blocks[0][2] - 2
            size = k + len(names) + 1
            full = np.zeros((size, size))
            for i, (s, g, d) in enumerate(blocks):
                place = [*(range(k) if s else []), k + i, size - 1]
                take = [*(range(d - 2) if s else []), d - 1, d - 2]
                full[np.ix_(place, place)] += g[np.ix_(take, take)]
            lod = n / 2 * math.log10(r0 / rss(full, size - 1))
            rows.append((part, key[0], float(t[key[0]].pos[key[1]]), key[1] + 1, t[key[0]].names[key[1]], float(max(0.0, lod))))
    return crosses[names[0]].geno.sparkSession.createDataFrame(rows, "partition string, chr string, pos double, ord int, locus string, lod double")


def summary_phylo(scan: DataFrame) -> DataFrame:
    """chr, partition, pos, lod, postprob (10^LOD over all partitions), best: is it the chromosome's best partition?"""
    from pyspark.sql import Window

    top = scan.groupBy("chr", "partition").agg(F.max(F.struct("lod", (-F.col("pos")).alias("m"))).alias("b")).select("chr", "partition", (-F.col("b.m")).alias("pos"), F.col("b.lod").alias("lod"))
    w = Window.partitionBy("chr")
    e = F.pow(F.lit(10.0), F.col("lod") - F.max("lod").over(w))
    return top.withColumn("postprob", e).withColumn("postprob", F.col("postprob") / F.sum("postprob").over(w)).withColumn("best", F.col("lod") == F.max("lod").over(w))


def inferred_partitions(summary: DataFrame, chr_: str, threshold: float, prob: float = 0.9) -> list[str]:
    """The fewest partitions whose posterior probabilities reach ``prob``; none (``null``) if the chromosome's LOD is under the threshold."""
    rows = sorted(summary.where(F.col("chr") == chr_).collect(), key=lambda r: -r["postprob"])
    if not rows or rows[0]["lod"] < threshold:
        return ["null"]
    out, total = [], 0.0
    for r in rows:
        out.append(r["partition"])
        total += r["postprob"]
        if total >= prob:
            break
    return out
