"""The tables behind plots: computed by Spark, small enough to be drawn on the host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.model import Cross
from crossloom.operators.hmm import calc_errorlod, info
from crossloom.operators.linkage import locate_xo
from crossloom.operators.scan_results import x_axis


def map_table(map_: DataFrame) -> DataFrame:
    return map_.select("chr", "pos", "marker")


def missing_table(cross: Cross) -> DataFrame:
    """chr, ord, marker, share of missing genotypes."""
    n = cross.individual.agg(F.count(F.lit(1)).alias("n"))
    got = cross.geno.groupBy("marker").agg(F.count("g").alias("t"))
    return cross.map.select("chr", "ord", "marker").join(got, "marker", "left").join(F.broadcast(n)).select("chr", "ord", "marker", (1 - F.coalesce("t", F.lit(0)) / F.col("n")).alias("missing"))


def geno_image(cross: Cross, chr_: str | None = None) -> DataFrame:
    """ind, chr, ord, g of typed genotypes."""
    g = cross.geno if chr_ is None else cross.geno.where(F.col("chr") == chr_)
    return g.select("ind", "chr", "ord", "g")


def geno_with_crossovers(cross: Cross, inds: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genotypes, crossovers and suspicious genotypes of a few individuals."""
    keep = F.col("ind").isin(inds)
    some = cross.with_(geno=cross.geno.where(keep), individual=cross.individual.where(keep))
    return geno_image(some), locate_xo(some), calc_errorlod(some).where("errorlod > 4")


def info_table(prob: DataFrame) -> DataFrame:
    return info(prob)


def pheno_by_geno(cross: Cross, trait: str, marker: str) -> DataFrame:
    return cross.pheno.where(F.col("trait") == trait).join(cross.geno.where(F.col("marker") == marker).select("ind", "g"), "ind").select("g", "y")


def histogram(values: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """bin (from 0), lo, n: counts of equal parts of the range."""
    r = values.where(F.col(col).isNotNull()).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    x = values.where(F.col(col).isNotNull()).join(F.broadcast(r))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    return x.select("lo", width.alias("w"), F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg((F.first("lo") + F.first("w") * F.col("bin")).alias("edge"), F.count(F.lit(1)).alias("n")).select("bin", F.col("edge").alias("lo"), "n")


def scan_table(scan: DataFrame, gap: float = 25) -> DataFrame:
    """A scan with a genome-wide x coordinate."""
    return x_axis(scan, gap)


def rf_table(rf: DataFrame, map_: DataFrame, most: float = 12.0) -> DataFrame:
    """chr1, ord1, chr2, ord2, value for both triangles of a heat map: LODs up to ``most`` above, recombination fractions on the scale of LODs
    below (0 at a half)."""
    m = lambda k: map_.select(F.col("marker").alias(f"m{k}"), F.col("chr").alias(f"chr{k}"), F.col("ord").alias(f"ord{k}"))
    x = rf.join(m(1), "m1").join(m(2), "m2")
    scaled = F.least(F.lit(most), F.greatest(F.lit(0.0), -4 * (F.log2(F.greatest("rf", F.lit(1e-12))) + 1) / 12 * most))
    low = x.select("chr1", "ord1", "chr2", "ord2", scaled.alias("value"))
    return low.unionByName(x.select(F.col("chr2").alias("chr1"), F.col("ord2").alias("ord1"), F.col("chr1").alias("chr2"), F.col("ord1").alias("ord2"), F.least("lod", F.lit(most)).alias("value")))


def errorlod_table(errorlod: DataFrame, breaks: tuple[float, ...] = (2.0, 3.0, 4.5)) -> DataFrame:
    """ind, chr, marker, level: in which class of error LODs a genotype is (0: below all breaks)."""
    return errorlod.select("ind", "chr", "marker", sum((F.col("errorlod") > b).cast("int") for b in breaks[1:]).alias("rest"), (F.col("errorlod") > breaks[0]).cast("int").alias("one")).select("ind", "chr", "marker", (F.col("one") + F.col("rest")).alias("level"))


def cis_trans_table(scans: DataFrame, locations: DataFrame, threshold: float = 3.0) -> DataFrame:
    """trait, own_chr, own_pos, chr, pos, lod: every locus above the threshold against the place of the trait's own gene (name, chr, pos)."""
    own = locations.select(F.col("name").alias("trait"), F.col("chr").alias("own_chr"), F.col("pos").alias("own_pos"))
    return scans.where(F.col("lod") >= threshold).join(own, "trait").select("trait", "own_chr", "own_pos", "chr", "pos", "lod")


def directed_table(scan: DataFrame, effects: DataFrame) -> DataFrame:
    """chr, pos, lod: LODs with the sign of the additive effect at the locus."""
    return scan.join(effects.select("chr", "locus", "a"), ["chr", "locus"]).select("chr", "pos", (F.col("lod") * F.signum("a")).alias("lod"))


def pair_table(scan: DataFrame, lower: str = "lod_full", upper: str = "int") -> DataFrame:
    """Both triangles of a pair scan: full, add, int, fv1 or av1 as value."""
    one = F.greatest("lod_one1", "lod_one2")
    value = {"lod_full": F.col("lod_full"), "lod_add": F.col("lod_add"), "int": F.col("lod_full") - F.col("lod_add"), "fv1": F.col("lod_full") - one, "av1": F.col("lod_add") - one}
    low = scan.select("chr1", "pos1", "chr2", "pos2", value[lower].alias("value"))
    return low.unionByName(scan.select(F.col("chr2").alias("chr1"), F.col("pos2").alias("pos1"), F.col("chr1").alias("chr2"), F.col("pos1").alias("pos2"), value[upper].alias("value")))


def lod_profiles(qtl) -> list[tuple[int, str, float, float]]:
    """(number of the locus, chr, pos, lod) from a refined model."""
    return [(k + 1, x[0], x[1], lod) for k, rows in sorted(qtl.attributes.get("profiles", {}).items()) for x, lod in rows]


def trait_groups(scans: DataFrame, min_correlation: float = 0.9) -> DataFrame:
    """trait, group: traits whose LOD profiles correlate at least so much, transitively; a group is named by its first trait.

    Correlations are aggregates over loci for pairs of traits."""
    from pyspark.sql import Window

    from crossloom.operators.graph import connected_components

    ids = scans.select("trait").distinct().withColumn("k", F.row_number().over(Window.orderBy("trait")))
    s = scans.join(ids, "trait").select("k", "locus", "lod")
    a, b = s.select(F.col("k").alias("a"), "locus", F.col("lod").alias("x")), s.select(F.col("k").alias("b"), "locus", F.col("lod").alias("y"))
    near = a.join(b, "locus").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r")).where(F.col("r") >= min_correlation)
    c = connected_components(near.select("a", "b"))
    first = ids.select(F.col("k").alias("component"), F.col("trait").alias("group"))
    x = ids.join(c, ids.k == c.node, "left").select("trait", F.coalesce("component", "k").alias("component"))
    return x.join(first, "component").select("trait", "group")
