"""The X chromosome: sex and the direction of the cross enter the null model, and genotypes have effects of their own in each of these groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.model import Cross
from crossloom.operators import meta
from crossloom.operators.scan import scan_hk


def x_groups(cross: Cross) -> DataFrame:
    """ind, sex (1 male), reverse (1: a female of the reverse direction of an intercross), n of each group in ``group_sizes``."""
    sex = F.coalesce("sex", F.lit(0))
    back = F.coalesce("pgm", F.lit(0)) if cross.crosstype in ("f2", "bcsft") else F.lit(0)
    return cross.individual.select("ind", sex.alias("sex"), F.when(sex == 0, back).otherwise(0).alias("reverse"))


def x_null_covariates(cross: Cross) -> list[str]:
    """Which of sex and reverse vary among individuals, and so belong in the null model."""
    if cross.crosstype not in ("f2", "bc", "bcsft"):
        return []
    r = x_groups(cross).agg(F.min("sex").alias("a"), F.max("sex").alias("b"), F.min(F.when(F.col("sex") == 0, F.col("reverse"))).alias("c"), F.max(F.when(F.col("sex") == 0, F.col("reverse"))).alias("d")).first()
    return [*(["sex"] if r["a"] != r["b"] else []), *(["reverse"] if r["c"] is not None and r["c"] != r["d"] else [])]


def x_covariates(cross: Cross, names: list[str]) -> DataFrame:
    """ind, name, value."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")
    return x_groups(cross).select("ind", each).select("ind", "x.name", "x.value")


def drop_aliased(covar: DataFrame, cross: Cross) -> DataFrame:
    """Covariates that aren't a function of sex and direction on this cross: those that vary within a group."""
    varies = covar.join(x_groups(cross), "ind").groupBy("name", "sex", "reverse").agg((F.max("value") > F.min("value")).alias("v")).groupBy("name").agg(F.max("v").alias("v")).where("v").select("name")
    return covar.join(varies, "name", "left_semi").select("ind", "name", "value")


def scan_x(cross: Cross, trait: str, **grid) -> DataFrame:
    """Regression scan of the X chromosomes: LOD against a null with sex and direction as far as they vary; genotype effects by group."""
    own = cross.map.where("chrtype = 'X'")
    x = cross.with_(map=own, geno=cross.geno.join(own.select("marker"), "marker", "left_semi").select(cross.geno.columns))
    names = x_null_covariates(cross)
    return scan_hk(x, trait, covar=x_covariates(cross, names) if names else None, addcovar=names, intcovar=names, **grid)


def scan_genome(cross: Cross, trait: str, **grid) -> DataFrame:
    """Regression scan of autosomes and X."""
    has_x = bool(cross.map.where("chrtype = 'X'").limit(1).count())
    rest = scan_hk(meta.omit_x_chr(cross) if has_x else cross, trait, **grid)
    return rest.unionByName(scan_x(cross, trait, **grid)) if has_x else rest


def region_lengths(cross: Cross) -> dict[str, float]:
    """Lengths of autosomes and X, for region-specific levels."""
    rows = meta.chr_len(cross.map).join(cross.map.select("chr", "chrtype").distinct(), "chr").groupBy("chrtype").agg(F.sum("length").alias("l")).collect()
    return {r["chrtype"]: r["l"] for r in rows}


def strata_by_sex(cross: Cross) -> DataFrame:
    """ind, strata: groups within which phenotypes may be permuted so that X keeps its null."""
    return x_groups(cross).select("ind", F.concat_ws("-", "sex", "reverse").alias("strata"))
