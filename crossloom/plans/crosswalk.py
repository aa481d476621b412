"""A cross out of sales tables, so that every operator has rows at any scale.

Orders are individuals, line numbers 1..7 are markers on two chromosomes at 10 cM, the smallest return flag (or line
status; both in a four-way cross) of an order's line is its genotype, the order's price is a trait."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.model import Cross


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(n):
    return F.when(n <= 4, "1").otherwise("2"), F.when(n <= 4, n).otherwise(n - 4).cast("int")


def sales_map(spark: SparkSession) -> DataFrame:
    rows = [("1" if n <= 4 else "2", "A", f"M{n}", n if n <= 4 else n - 4, 10.0 * ((n if n <= 4 else n - 4) - 1), None) for n in range(1, 8)]
    return spark.createDataFrame(rows, "chr string, chrtype string, marker string, ord int, pos double, pos_male double")


def sales_cross(spark: SparkSession, sf_dir: str, crosstype: str = "f2") -> Cross:
    lines = _read(spark, sf_dir, "lineitem")
    chr_, ord_ = _place(F.col("l_linenumber"))
    flag, status = F.min("l_returnflag"), F.min("l_linestatus")
    g = {"f2": F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3), "4way": F.when(flag == "A", 1).otherwise(2) + F.when(status == "F", 0).otherwise(2)}.get(crosstype, F.when(status == "F", 1).otherwise(2))
    geno = (
        lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("ind"), "l_linenumber").agg(g.cast("int").alias("g"))
        .select("ind", chr_.alias("chr"), F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("marker"), ord_.alias("ord"), "g")
    )
    orders = _read(spark, sf_dir, "orders")
    traits = F.array(F.struct(F.lit("price").alias("trait"), F.col("o_totalprice").alias("y")), F.struct(F.lit("done").alias("trait"), (F.col("o_orderstatus") == "F").cast("double").alias("y")))
    pheno = orders.select(F.col("o_orderkey").alias("ind"), F.explode(traits).alias("t")).select("ind", "t.trait", "t.y")
    people = orders.select(F.col("o_orderkey").alias("ind"), F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("int").alias("sex"), F.lit(None).cast("int").alias("pgm"), F.col("o_orderpriority").alias("strata"))
    return Cross(geno, pheno, sales_map(spark), people, crosstype)


def part_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map with a marker for each part: sizes are chromosomes, part numbers are places, a twentieth of a centimorgan apart."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    return _read(spark, sf_dir, "part").select(
        F.col("p_size").cast("string").alias("chr"), F.lit("A").alias("chrtype"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("marker"), order.cast("int").alias("ord"),
        (F.col("p_partkey") * F.lit(0.05)).alias("pos"), F.lit(None).cast("double").alias("pos_male"),
    )


def part_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, pos): a place for each supplier, and one for every seventh part, at its marker."""
    s = _read(spark, sf_dir, "supplier").select((1 + F.col("s_suppkey") % 50).cast("string").alias("chr"), (F.abs(F.col("s_acctbal").cast("double")) / 100).alias("pos"))
    return s.unionByName(part_map(spark, sf_dir).where(F.col("ord") % 7 == 0).select("chr", "pos")).distinct()


_G = "CASE WHEN l_linenumber <= 4 THEN '1' ELSE '2' END AS chr, 'M' || l_linenumber AS marker, CAST(CASE WHEN l_linenumber <= 4 THEN l_linenumber ELSE l_linenumber - 4 END AS INT) AS ord"
#: The same tables in SQL, as common table expressions: g2 (f2), g1 (bc), map, pheno, ind.
CTE = f"""
g2 AS (SELECT l_orderkey AS ind, {_G}, CASE min(l_returnflag) WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS g FROM lineitem GROUP BY l_orderkey, l_linenumber),
g1 AS (SELECT l_orderkey AS ind, {_G}, CASE min(l_linestatus) WHEN 'F' THEN 1 ELSE 2 END AS g FROM lineitem GROUP BY l_orderkey, l_linenumber),
map AS (SELECT CASE WHEN n <= 4 THEN '1' ELSE '2' END AS chr, 'M' || n AS marker, CAST(CASE WHEN n <= 4 THEN n ELSE n - 4 END AS INT) AS ord, 10.0 * (CASE WHEN n <= 4 THEN n ELSE n - 4 END - 1) AS pos FROM range(1, 8) t(n)),
pmap AS (SELECT CAST(p_size AS VARCHAR) AS chr, 'A' AS chrtype, 'P' || p_partkey AS marker, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INT) AS ord, p_partkey * CAST(0.05 AS DOUBLE) AS pos, CAST(NULL AS DOUBLE) AS pos_male FROM part),
places AS (SELECT CAST(1 + s_suppkey % 50 AS VARCHAR) AS chr, abs(CAST(s_acctbal AS DOUBLE)) / 100 AS pos FROM supplier UNION SELECT chr, pos FROM pmap WHERE ord % 7 = 0),
pheno AS (SELECT o_orderkey AS ind, o_totalprice AS y, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS b, o_orderpriority AS strata FROM orders)
"""
