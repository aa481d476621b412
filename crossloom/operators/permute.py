"""Permutations for any scan: phenotypes are dealt anew by keyed permutations of individuals' numbers, within strata if there are any."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossloom.model import Cross
from crossloom.operators.scan import _feistel
from crossloom.runtime import materialise, prepare


def permuted(cross: Cross, trait: str, rep: int, seed: int = 1, strata: DataFrame | None = None, simulate: bool = False) -> Cross:
    """The cross with one trait permuted (``strata``: ind, strata), or with a standard normal trait instead."""
    prepare(cross.geno.sparkSession)
    own = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull()).select("ind", "y")
    if simulate:
        rest = cross.pheno.where(F.col("trait") != trait)
        return cross.with_(pheno=rest.unionByName(own.select("ind", F.lit(trait).alias("trait"), _normal(F.col("ind"), seed, rep).alias("y"))))
    own = own.join(strata, "ind") if strata is not None else own.withColumn("strata", F.lit(""))
    w = Window.partitionBy("strata")
    index = materialise(own.withColumns({"i": F.row_number().over(w.orderBy("ind")) - 1, "n": F.count(F.lit(1)).over(w)}), "strata")

    @F.pandas_udf("long")
    def place(i: pd.Series, n: pd.Series) -> pd.Series:
        out = pd.Series(0, index=i.index, dtype="int64")
        for size in n.unique():
            out[n == size] = _feistel(i[n == size].to_numpy(), int(size), seed * 1_000_003 + rep)
        return out

    to = index.select("ind", "strata", place("i", "n").alias("j"))
    new = to.join(index.select("strata", F.col("i").alias("j"), "y"), ["strata", "j"]).select("ind", F.lit(trait).alias("trait"), "y")
    return cross.with_(pheno=cross.pheno.where(F.col("trait") != trait).unionByName(new))


def _normal(ind, seed: int, rep: int):
    """Standard normal numbers from two hashes of the individual."""
    u = lambda k: (F.pmod(F.xxhash64(ind, F.lit(seed), F.lit(rep), F.lit(k)), F.lit(2**40)) + 1) / F.lit(float(2**40 + 1))
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))


def permute_scan(cross: Cross, trait: str, scan_function: Callable[[Cross, str], DataFrame], n_perm: int = 10, seed: int = 1, strata: DataFrame | None = None, simulate: bool = False, value: str = "lod") -> DataFrame:
    """rep and the columns of each replicate's scan. ``scanone_perm`` is faster for the regression scan; this takes any function."""
    out = None
    for rep in range(1, n_perm + 1):
        one = materialise(scan_function(permuted(cross, trait, rep, seed, strata, simulate), trait), "replicate").withColumn("rep", F.lit(rep))
        out = one if out is None else out.unionByName(one)
    return out


def replicate_maxima(replicates: DataFrame, trait: str, value: str = "lod") -> DataFrame:
    """rep, trait, region, maxlod."""
    return replicates.groupBy("rep").agg(F.max(value).alias("maxlod")).select("rep", F.lit(trait).alias("trait"), F.lit("all").alias("region"), "maxlod")
