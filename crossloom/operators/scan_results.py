"""What is done with scans and permutations: peaks, thresholds, p-values, intervals, arithmetic. Joins, windows, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_AT = ["chr", "pos", "ord", "locus"]


def summary_scanone(scan: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The highest locus of each chromosome and trait above the threshold (ties: the first position)."""
    best = F.max(F.struct("lod", (-F.col("pos")).alias("m"), "locus")).alias("b")
    return scan.groupBy("chr", "trait").agg(best).select("chr", (-F.col("b.m")).alias("pos"), F.col("b.locus").alias("locus"), "trait", F.col("b.lod").alias("lod")).where(F.col("lod") > threshold)


def max_scanone(scan: DataFrame) -> DataFrame:
    """The highest locus of each trait."""
    best = F.max(F.struct("lod", "chr", (-F.col("pos")).alias("m"), "locus")).alias("b")
    return scan.groupBy("trait").agg(best).select("trait", F.col("b.chr").alias("chr"), (-F.col("b.m")).alias("pos"), F.col("b.locus").alias("locus"), F.col("b.lod").alias("lod"))


def perm_thresholds(perms: DataFrame, alphas: list[float] = (0.05, 0.10), lengths: dict[str, float] | None = None, value: str = "maxlod") -> DataFrame:
    """trait, region, alpha, threshold: quantiles by linear interpolation. With lengths of the regions A and X, each has the level
    1 - (1 - alpha) ** (length / total)."""
    out = None
    for alpha in alphas:
        for region in lengths or {None: 1.0}:
            level = alpha if region is None else 1 - (1 - alpha) ** (lengths[region] / sum(lengths.values()))
            rows = perms if region is None else perms.where(F.col("region") == region)
            one = rows.groupBy("trait", "region").agg(F.percentile(value, F.lit(1 - level)).alias("threshold")).withColumn("alpha", F.lit(float(alpha)))
            out = one if out is None else out.unionByName(one)
    return out.select("trait", "region", "alpha", "threshold")


def perm_pvalues(peaks: DataFrame, perms: DataFrame) -> DataFrame:
    """Share of replicates whose maximum reaches a peak. Replicates are few and are gathered in one row."""
    m = perms.groupBy("trait").agg(F.collect_list("maxlod").alias("m"))
    return peaks.join(m, "trait").withColumn("pval", F.size(F.filter("m", lambda x: x >= F.col("lod"))) / F.size("m")).drop("m")


def combine_perms(*perms: DataFrame) -> DataFrame:
    """Replicates under each other, numbered on."""
    out = None
    for k, p in enumerate(perms):
        p = p.withColumn("rep", F.col("rep") + F.lit(k * 1_000_000))
        out = p if out is None else out.unionByName(p)
    w = Window.partitionBy("trait", "region").orderBy("rep")
    return out.withColumn("rep", F.row_number().over(w))


def bind_perms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Replicates side by side: rows that only one side has keep a null on the other."""
    return a.select("rep", "region", F.col("maxlod").alias("maxlod_1")).join(b.select("rep", "region", F.col("maxlod").alias("maxlod_2")), ["rep", "region"], "full_outer")


def arithmetic(a: DataFrame, b: DataFrame, sign: int = 1, keys: tuple[str, ...] = ("chr", "pos", "ord", "locus"), values: tuple[str, ...] = ("lod",)) -> DataFrame:
    """Position-wise sum or difference of scans, pair scans or permutation tables."""
    y = b.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    out = a.join(y, list(keys))
    return out.withColumns({v: F.col(v) + sign * F.col(f"_{v}") for v in values}).drop(*(f"_{v}" for v in values))


def bind_scans(*scans: DataFrame) -> DataFrame:
    """Scans as columns lod1, lod2, ... by position."""
    out = None
    for k, s in enumerate(scans, 1):
        s = s.select(*_AT, F.col("lod").alias(f"lod{k}"))
        out = s if out is None else out.join(s, _AT, "full_outer")
    return out


def lod_interval(scan: DataFrame, drop: float = 1.5) -> DataFrame:
    """lo, peak, hi of each chromosome and trait: rows above the maximum less ``drop``, and one more on each side."""
    all_ = Window.partitionBy("chr", "trait")
    w = all_.orderBy("pos")
    x = scan.withColumns({"top": F.max("lod").over(all_), "prev": F.lag("pos").over(w), "next": F.lead("pos").over(w)})
    best = F.max(F.struct("lod", (-F.col("pos")).alias("m")))
    inside = x.where(F.col("lod") > F.col("top") - drop)
    return inside.groupBy("chr", "trait").agg(F.min(F.coalesce("prev", "pos")).alias("lo"), (-best["m"]).alias("peak"), F.max(F.coalesce("next", "pos")).alias("hi"))


def bayes_interval(scan: DataFrame, prob: float = 0.95) -> DataFrame:
    """Credible interval: loci by decreasing LOD until their 10^LOD times width reach ``prob``. A locus is as wide as half the
    distance of its neighbours; at an end, the distance to the only one."""
    all_ = Window.partitionBy("chr", "trait")
    w = all_.orderBy("pos")
    prev, nxt = F.lag("pos").over(w), F.lead("pos").over(w)
    width = F.when(prev.isNull(), nxt - F.col("pos")).when(nxt.isNull(), F.col("pos") - prev).otherwise((nxt - prev) / 2)
    x = scan.withColumns({"width": F.coalesce(width, F.lit(1.0)), "top": F.max("lod").over(all_)})
    x = x.withColumn("area", F.pow(F.lit(10.0), F.col("lod") - F.col("top")) * F.col("width"))
    x = x.withColumn("area", F.col("area") / F.sum("area").over(all_))
    before = F.sum("area").over(all_.orderBy(F.desc("lod"), "pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("area")
    best = F.max(F.struct("lod", (-F.col("pos")).alias("m")))
    return x.withColumn("before", before).where(F.col("before") < prob).groupBy("chr", "trait").agg(F.min("pos").alias("lo"), (-best["m"]).alias("peak"), F.max("pos").alias("hi"))


def expand_to_markers(intervals: DataFrame, map_: DataFrame) -> DataFrame:
    """Interval ends moved out to the next markers."""
    m = map_.select(F.col("chr").alias("c"), F.col("pos").alias("mp"))
    x = intervals.join(m, F.col("chr") == F.col("c"))
    return x.groupBy("chr", "trait", "lo", "peak", "hi").agg(F.max(F.when(F.col("mp") <= F.col("lo"), F.col("mp"))).alias("a"), F.min(F.when(F.col("mp") >= F.col("hi"), F.col("mp"))).alias("b")).select("chr", "trait", F.coalesce("a", "lo").alias("lo"), "peak", F.coalesce("b", "hi").alias("hi"))


def boot_interval(boot: DataFrame, prob: float = 0.95) -> DataFrame:
    return boot.agg(F.percentile("pos", F.lit((1 - prob) / 2)).alias("lo"), F.percentile("pos", F.lit(1 - (1 - prob) / 2)).alias("hi"))


def x_axis(scan: DataFrame, gap: float = 25) -> DataFrame:
    """A cumulative genome coordinate, chromosomes by name with a gap between them. One row for each chromosome is ordered."""
    span = scan.groupBy("chr").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    w = Window.orderBy(F.expr("try_cast(chr AS INT)").asc_nulls_last(), "chr").rowsBetween(Window.unboundedPreceding, -1)
    off = span.withColumn("off", F.coalesce(F.sum(F.col("hi") - F.col("lo") + gap).over(w), F.lit(0.0)))
    return scan.join(F.broadcast(off.select("chr", "lo", "off")), "chr").withColumn("x", F.col("off") + F.col("pos") - F.col("lo")).drop("lo", "off")


def mqm_scan_fdr(real: DataFrame, permuted: DataFrame, thresholds: list[float] = (1, 2, 3, 4, 5, 7, 10, 15, 20)) -> DataFrame:
    """threshold, above, above_permuted (mean over replicates), fdr."""
    n = permuted.agg(F.count_distinct("rep").alias("r"))
    t = real.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    a = real.join(F.broadcast(t), F.col("lod") > F.col("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("above"))
    b = permuted.join(F.broadcast(t), F.col("lod") > F.col("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("p"))
    x = t.join(a, "threshold", "left").join(b, "threshold", "left").join(F.broadcast(n)).fillna(0, ["above", "p"])
    return x.select("threshold", "above", (F.col("p") / F.col("r")).alias("above_permuted"), F.when(F.col("above") > 0, F.col("p") / F.col("r") / F.col("above")).alias("fdr"))
