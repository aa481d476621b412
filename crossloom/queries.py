"""Registered queries over the cross of ``plans.crosswalk``, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.functions import maps as M
from crossloom.operators import edit, hmm, linkage, meta, scan, scan_results
from crossloom.plans.crosswalk import CTE, part_map, part_places, sales_cross, sales_map
from crossloom.runtime import prepare

#: Columns of queries with an oracle that depend on the order of sums: both sides round them.
INEXACT = {
    "rescale_map": "pos",
    "interp_positions": "new_pos",
    "convert_map": "pos",
    "transform_pheno": "y",
    "map_functions": "haldane kosambi imf_h imf_k imf_cf",
    "adjust_rf_ri": "self sib sib_x",
    "geno_table": "chi2",
    "est_rf_bc": "rf lod",
    "marker_lrt": "lod",
    "check_alleles": "diff",
    "score_missing": "missing",
    "calc_genoprob_bc": "p1",
    "info_content": "entropy variance",
    "scanone_mr": "lod",
    "scanone_mr_bc": "lod",
    "scanone_binary_mr": "lod",
    "scanone_hk_bc": "lod",
    "scanone_np": "lod",
    "summary_scanone": "lod",
    "max_scanone": "lod",
    "scan_difference": "lod",
    "perm_thresholds": "threshold",
    "perm_pvalues": "lod pval",
    "scantwo_mr_full": "lod_full",
    "effect_plot": "mean se",
    "effect_plot_pair": "mean se",
    "scan_all_traits": "lod",
    "plot_missing": "missing",
    "plot_pheno": "lo",
    "plot_scan": "lod",
    "pull_rf": "value",
    "pull_genoprob": "p",
    "form_marker_covar": "value",
    "marker_loglik": "loglik",
    "est_rf_intercross": "rf lod",
    "scanone_hk_grid": "lod",
    "scanone_hk_interactive": "lod",
    "scanone_hk_additive": "lod",
    "effect_scan_bc": "a se_a",
    "scanone_genome_x": "lod",
    "scantwo_mr_bc": "lod_full lod_add lod_one1 lod_one2",
    "summary_scantwo_bc": "full fv1 int add av1 one",
    "condense_scantwo": "full fv1 int add av1 one",
    "max_scantwo": "lod",
    "clean_scantwo": "lod_full lod_add lod_one1 lod_one2",
    "plot_scantwo": "value",
    "replace_map_pairs": "lod_full",
    "add_scantwo": "lod_full lod_add",
    "subset_scantwo": "lod_full lod_add lod_one1 lod_one2",
    "scantwo_mr_f2": "lod_full lod_add lod_one1",
    "fit_qtl_dropone": "lod pvar f",
    "add_qtl_scan": "lod",
    "add_int": "lod",
    "cim_one": "lod",
    "subset_scanone": "lod",
    "bind_scans": "lod1 lod2",
    "replace_map_scan": "lod",
    "estimate_marker_lod": "lod",
    "perm_thresholds_x": "threshold",
    "scantwo_thresholds": "threshold",
    "calc_penalties": "main heavy light",
    "boot_interval": "lo hi",
    "morgan_map_function": "r",
    "add_pair": "lod_full lod_add",
    "scan_qtl_grid": "lod",
    "geno_table_em": "aa ab bb stat p",
    "plot_rf": "value",
    "plot_cis_trans": "lod",
    "plot_directed": "lod",
    "errorlod_intercross": "errorlod",
    "scantwo_mr_intercross": "lod_full lod_add lod_one1 lod_one2",
    "summary_scantwo_intercross": "full fv1 int add av1 one",
    "fit_qtl_whole": "lod pvar f p_chi2 p_f",
}


def digits(query_: str, column: str) -> int:
    rough = ("lod", "diff", "mean", "se", "threshold", "y", "chi2", "full", "fv1", "int", "add", "av1", "one", "main", "heavy", "light", "pvar")
    return 9 if query_ == "rescale_map" else 4 if column.startswith(rough) or query_ == "plot_scantwo" else 6


def rounded(name: str, df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, digits(name, c)) + 0.0 for c in INEXACT.get(name, "").split()})


def rounded_sql(name: str, sql: str) -> str:
    cols = ", ".join(f'round("{c}", {digits(name, c)}) + 0.0 AS "{c}"' for c in INEXACT.get(name, "").split())
    return f"SELECT * REPLACE ({cols}) FROM ({sql})" if cols else sql


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_cte: bool = True):
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            df = fn(spark, sf_dir)
            return df if sql is None else rounded(fn.__name__, df)

        QUERIES[fn.__name__] = run
        if sql is not None:
            whole = f"WITH {CTE.strip()}{',' if sql.lstrip()[:1] == ',' else ''} {sql.lstrip().removeprefix(',')}" if with_cte else sql
            ORACLES[fn.__name__] = rounded_sql(fn.__name__, whole)
        return fn

    return add


def _f2(spark, d):
    return sales_cross(spark, d, "f2")


def _bc(spark, d):
    return sales_cross(spark, d, "bc")


def _places(spark, chrs=("1", "2")):
    return spark.createDataFrame([(c, x) for c in chrs for x in (0.0, 3.0, 5.0, 12.5, 19.9, 27.0, 45.0)], "chr string, pos double")


_PLACES = "(SELECT c AS chr, p AS pos FROM (VALUES ('1'), ('2')) a(c), (VALUES (0.0), (3.0), (5.0), (12.5), (19.9), (27.0), (45.0)) b(p))"

_MR = """, cell AS (SELECT chr, marker, ord, g, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM {g} JOIN pheno USING (ind) GROUP BY ALL),
mr AS (SELECT c.chr, m.pos, c.ord, c.marker AS locus, 'price' AS trait,
  greatest(0, sum(n) / 2.0 * log10((sum(q) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s * s / n)))) AS lod
  FROM cell c JOIN map m USING (marker) GROUP BY c.chr, m.pos, c.ord, c.marker)"""


# Metadata


@query("SELECT (SELECT count(*) FROM pheno) AS n_ind, 2 AS n_chr, 7 AS tot_mar, 2 AS n_phe")
def cross_sizes(spark, d):
    return meta.sizes(_f2(spark, d))


@query("SELECT chr, count(*) AS n_mar FROM map GROUP BY chr")
def n_mar(spark, d):
    return meta.n_mar(_f2(spark, d))


@query("SELECT ind, coalesce(n, 0) AS n_typed, 7 - coalesce(n, 0) AS n_missing FROM pheno LEFT JOIN (SELECT ind, count(g) AS n FROM g2 GROUP BY ind) USING (ind)")
def n_typed_ind(spark, d):
    return meta.n_typed(_f2(spark, d), "ind")


@query("SELECT marker, coalesce(n, 0) AS n_typed, (SELECT count(*) FROM pheno) - coalesce(n, 0) AS n_missing FROM map LEFT JOIN (SELECT marker, count(g) AS n FROM g2 GROUP BY marker) USING (marker)")
def n_typed_mar(spark, d):
    return meta.n_typed(_f2(spark, d), "mar")


@query("SELECT chr, marker, pos FROM map WHERE chr = '2'")
def pull_map(spark, d):
    return meta.pull_map(_f2(spark, d), "-1")


@query("SELECT chr, count(*) AS n_mar, max(l) AS length, sum(gap) / count(gap) AS ave_spacing, max(gap) AS max_spacing FROM (SELECT chr, pos - lag(pos) OVER (PARTITION BY chr ORDER BY ord) AS gap, max(pos) OVER (PARTITION BY chr) - min(pos) OVER (PARTITION BY chr) AS l FROM map) GROUP BY chr UNION ALL SELECT NULL, 7, 50.0, 10.0, 10.0")
def summary_map(spark, d):
    return meta.summary_map(_f2(spark, d).map)


@query("SELECT chr, max(pos) - min(pos) AS length FROM map GROUP BY chr")
def chr_len(spark, d):
    return meta.chr_len(_f2(spark, d).map)


@query("SELECT a.chr, a.marker AS left_marker, b.marker AS right_marker, b.pos - a.pos AS gap FROM map a JOIN map b ON a.chr = b.chr AND b.ord = a.ord + 1 WHERE b.pos - a.pos >= 10")
def find_large_intervals(spark, d):
    return meta.find_large_intervals(_f2(spark, d).map, 10)


@query("SELECT ind, max(g) FILTER (WHERE marker = 'M1') AS M1, max(g) FILTER (WHERE marker = 'M5') AS M5 FROM pheno LEFT JOIN g2 USING (ind) GROUP BY ind")
def pull_geno(spark, d):
    return meta.pull_geno(_f2(spark, d), ["M1", "M5"])


@query("SELECT ind, y AS price, b AS done FROM pheno")
def pull_pheno(spark, d):
    return meta.pull_pheno(_f2(spark, d), ["price", "done"])


@query(f"""SELECT p.chr, p.pos, arg_max(m.marker, (-abs(m.pos - p.pos), t.n)) AS marker FROM {_PLACES} p JOIN map m ON m.chr = p.chr JOIN (SELECT marker, count(*) AS n FROM g2 GROUP BY marker) t ON t.marker = m.marker GROUP BY p.chr, p.pos""")
def find_marker(spark, d):
    return meta.find_marker(_f2(spark, d), _places(spark))


@query(f"""SELECT p.chr, p.pos, (SELECT arg_max(marker, m.pos) FROM map m WHERE m.chr = p.chr AND m.pos <= p.pos) AS left_marker, (SELECT arg_min(marker, m.pos) FROM map m WHERE m.chr = p.chr AND m.pos >= p.pos) AS right_marker, (SELECT arg_min(marker, (abs(m.pos - p.pos), m.pos)) FROM map m WHERE m.chr = p.chr) AS close_marker FROM {_PLACES} p""")
def find_flanking(spark, d):
    return meta.find_flanking(_f2(spark, d).map, _places(spark))


@query("SELECT marker, chr, pos FROM map WHERE marker IN ('M2', 'M6')")
def find_markerpos(spark, d):
    return meta.find_markerpos(_f2(spark, d), spark.createDataFrame([("M2",), ("M6",), ("none",)], "marker string"))


@query("SELECT ind, chr, marker, ord, g FROM g2 JOIN pheno USING (ind) WHERE chr = '2' AND strata = '1-URGENT'")
def subset_cross(spark, d):
    return meta.subset(_f2(spark, d), "2", F.col("strata") == "1-URGENT").geno


@query("""SELECT x.* FROM (SELECT unnest([{'check': 'n_ind', 'value': CAST((SELECT count(*) FROM pheno) AS DOUBLE)}, {'check': 'n_chr', 'value': 2.0}, {'check': 'tot_mar', 'value': 7.0}, {'check': 'n_phe', 'value': 2.0}, {'check': 'positions_out_of_order', 'value': 0.0}, {'check': 'repeated_markers', 'value': 0.0},
 {'check': 'typed', 'value': CAST((SELECT count(*) FROM g2) AS DOUBLE)}, {'check': 'codes_out_of_range', 'value': 0.0}, {'check': 'share_typed', 'value': (SELECT count(*) FROM g2) / (7 * (SELECT count(*) FROM pheno))}]) AS x)""")
def summary_cross(spark, d):
    return meta.summary_cross(_f2(spark, d))


# Editing


@query("SELECT ind, chr, marker, CAST(CASE chr WHEN '1' THEN 5 - ord ELSE ord END AS INT) AS ord, g FROM g2")
def flip_order(spark, d):
    return edit.flip_order(_f2(spark, d), ["1"]).geno


@query("SELECT ind, chr, marker, ord, CASE WHEN marker = 'M3' THEN 4 - g ELSE g END AS g FROM g2")
def switch_alleles(spark, d):
    return edit.switch_alleles(_f2(spark, d), ["M3"]).geno


@query("SELECT ind, chr, marker, ord, g FROM g2 WHERE marker NOT IN ('M1', 'M7')")
def drop_markers(spark, d):
    return edit.drop_markers(_f2(spark, d), spark.createDataFrame([("M1",), ("M7",)], "marker string")).geno


@query("SELECT marker FROM map WHERE marker NOT IN (SELECT marker FROM g2)")
def null_markers(spark, d):
    return edit.null_markers(_f2(spark, d))


@query("SELECT marker, pos + 0.001 * (ord - 1) AS pos FROM map")
def jitter_map(spark, d):
    return edit.jitter_map(_f2(spark, d).map, 0.001).select("marker", "pos")


@query("SELECT marker, pos / 1e6 AS pos FROM map")
def rescale_map(spark, d):
    return edit.rescale_map(_f2(spark, d).map, 1e-6).select("marker", "pos")


@query("SELECT marker, pos - min(pos) OVER (PARTITION BY chr) + 7 AS pos FROM map")
def shift_map(spark, d):
    return edit.shift_map(_f2(spark, d).map, 7.0).select("marker", "pos")


@query("SELECT marker, (ord - 1) * 50 * atanh(2 * 0.5 * (1 - exp(-10.0 / 50))) AS pos FROM map")
def convert_map(spark, d):
    return edit.convert_map(_f2(spark, d).map, "haldane", "kosambi").select("marker", "pos")


@query("SELECT p.chr, p.pos, 2 * p.pos + 5 AS new_pos FROM places p JOIN (SELECT chr, min(pos) AS lo, max(pos) AS hi FROM pmap GROUP BY chr) m ON m.chr = p.chr AND p.pos BETWEEN lo AND hi")
def interp_positions(spark, d):
    old = part_map(spark, d)
    ends = old.groupBy("chr").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    p = part_places(spark, d).join(ends, "chr").where("pos BETWEEN lo AND hi").select("chr", "pos")
    return edit.interp_positions(old, old.withColumn("pos", F.col("pos") * 2 + 5), p)


@query("SELECT ind, 'price' AS trait, ln(y) AS y FROM pheno UNION ALL SELECT ind, 'done', b FROM pheno")
def transform_pheno(spark, d):
    return edit.transform_pheno(_f2(spark, d), "price").pheno


@query()
def nq_rank(spark, d):
    return edit.nq_rank(_f2(spark, d), "price").pheno.where("trait = 'price'")


@query("SELECT ind, chr, marker, ord, g FROM g2 UNION ALL SELECT ind, '2', 'new', 4, 1 FROM pheno")
def add_marker(spark, d):
    c = _f2(spark, d)
    return edit.add_marker(c, c.individual.select("ind", F.lit(1).alias("g")), "new", "2", 30.0).geno


@query("SELECT marker, CASE WHEN marker = 'M1' THEN '2' ELSE chr END AS chr, CAST(CASE WHEN marker = 'M1' THEN 2 WHEN chr = '1' THEN ord - 1 WHEN ord = 1 THEN 1 ELSE ord + 1 END AS INT) AS ord, CASE WHEN marker = 'M1' THEN 4.0 ELSE pos END AS pos FROM map")
def move_marker(spark, d):
    return edit.move_marker(_f2(spark, d), "M1", "2", 4.0).map.select("marker", "chr", "ord", "pos")


@query("SELECT marker, CAST(CASE marker WHEN 'M5' THEN 3 WHEN 'M6' THEN 1 WHEN 'M7' THEN 2 ELSE ord END AS INT) AS ord FROM map")
def switch_order(spark, d):
    return edit.switch_order(_f2(spark, d), "2", [2, 3, 1]).map.select("marker", "ord")


@query("""SELECT ind, chr, marker, ord, CASE WHEN g = 1 THEN 1 ELSE 2 END AS g FROM g2 WHERE g = 1 OR g = (SELECT CASE WHEN count(*) FILTER (WHERE g = 3) >= count(*) FILTER (WHERE g = 2) THEN 3 ELSE 2 END FROM g2)""")
def convert_2_ril(spark, d):
    return edit.convert_2_ril(_f2(spark, d)).geno


@query("SELECT ind * 2 AS ind, chr, marker, ord, g FROM g2 UNION ALL SELECT ind * 2 + 1, chr, marker, ord, g FROM g1")
def combine_crosses(spark, d):
    return edit.combine(_f2(spark, d), _bc(spark, d)).geno


@query("SELECT * FROM (VALUES ('M1', 'M1'), ('copy', 'M1')) t(marker, grp)")
def find_dup_markers(spark, d):
    """With a copy of a marker added to another chromosome."""
    c = _f2(spark, d)
    return edit.find_dup_markers(edit.add_marker(c, c.geno.where("marker = 'M1'").select("ind", "g"), "copy", "2", 33.0))


@query(""", a AS (SELECT ind, g.chr, g.ord, marker, g, pos, CASE WHEN g <> lag(g) OVER w OR lag(g) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM g2 g JOIN map USING (marker) WINDOW w AS (PARTITION BY ind, g.chr ORDER BY g.ord)),
b AS (SELECT *, sum(new) OVER (PARTITION BY ind, chr ORDER BY ord) AS run FROM a),
r AS (SELECT ind, chr, run, count(*) AS n, min(pos) AS lo, max(pos) AS hi, min(g) AS rg FROM b GROUP BY ALL),
x AS (SELECT *, lag(rg) OVER v AS pg, lead(rg) OVER v AS ng, lag(hi) OVER v AS ph, lead(lo) OVER v AS nl FROM r WINDOW v AS (PARTITION BY ind, chr ORDER BY run))
SELECT ind, chr, marker, ord, g FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.ind = b.ind AND x.chr = b.chr AND x.run = b.run AND pg = ng AND n <= 1 AND nl - ph <= 40)""")
def clean_geno(spark, d):
    return edit.clean_geno(_f2(spark, d), 20, 1).geno


# Map functions

_D = "(SELECT DISTINCT l_quantity AS d FROM lineitem)"


@query(f"SELECT d, 0.5 * (1 - exp(-d / 50)) AS haldane, 0.5 * tanh(d / 50) AS kosambi, least(d / 100, 0.5) AS morgan, -50 * ln(1 - 2 * (d / 200)) AS imf_h, 50 * atanh(2 * (d / 200)) AS imf_k, 12.5 * (ln(1 + d / 100) - ln(1 - d / 100)) + 25 * atan(d / 100) AS imf_cf FROM {_D}", with_cte=False)
def map_functions(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("d")).distinct()
    c, r = F.col("d"), F.col("d") / 200
    return x.select("d", M.mf_h(c).alias("haldane"), M.mf_k(c).alias("kosambi"), M.mf_m(c).alias("morgan"), M.imf_h(r).alias("imf_h"), M.imf_k(r).alias("imf_k"), M.imf_cf(r).alias("imf_cf"))


@query(f"SELECT d, d AS carter_falconer, d AS stahl FROM {_D}", with_cte=False)
def inverse_map_functions(spark, d):
    """Round trips through the functions that have no closed form."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("d")).distinct()
    return x.select("d", F.round(M.imf_cf(M.mf_cf(F.col("d"))), 6).alias("carter_falconer"), F.round(M.imf_stahl(M.mf_stahl(F.col("d"), 2, 0.1), 2, 0.1), 6).alias("stahl"))


@query(f"SELECT d, 2 * (d / 200) / (1 + 2 * (d / 200)) AS self, 4 * (d / 200) / (1 + 6 * (d / 200)) AS sib, (8 / 3.0) * (d / 200) / (1 + 4 * (d / 200)) AS sib_x FROM {_D}", with_cte=False)
def adjust_rf_ri(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("d")).distinct()
    r = F.col("d") / 200
    return x.select("d", M.adjust_rf_ri(r).alias("self"), M.adjust_rf_ri(r, "sib").alias("sib"), M.adjust_rf_ri(r, "sib", "X").alias("sib_x"))


# Quality and linkage


@query("""SELECT m.chr, m.marker, (SELECT count(*) FROM pheno) - count(g) AS n_missing, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 2) AS n2, count(*) FILTER (WHERE g = 3) AS n3, count(*) FILTER (WHERE g = 4) AS n4, count(*) FILTER (WHERE g = 5) AS n5,
 (count(*) FILTER (WHERE g = 1) - count(g) * 0.25) ** 2 / (count(g) * 0.25) + (count(*) FILTER (WHERE g = 2) - count(g) * 0.5) ** 2 / (count(g) * 0.5) + (count(*) FILTER (WHERE g = 3) - count(g) * 0.25) ** 2 / (count(g) * 0.25) AS chi2, 2 AS df
FROM map m LEFT JOIN g2 USING (marker) GROUP BY m.chr, m.marker""")
def geno_table(spark, d):
    return linkage.geno_table(_f2(spark, d))


@query("""SELECT m1, m2, b / n AS rf, CASE WHEN b > 0 THEN b * log10(b / n) ELSE 0 END + CASE WHEN b < n THEN (n - b) * log10(1 - b / n) ELSE 0 END + n * log10(2) AS lod, n FROM
(SELECT x.marker AS m1, y.marker AS m2, count(*) AS n, sum(CASE WHEN x.g <> y.g THEN 1.0 ELSE 0 END) AS b FROM g1 x JOIN g1 y ON x.ind = y.ind AND x.marker < y.marker GROUP BY x.marker, y.marker)""")
def est_rf_bc(spark, d):
    return linkage.est_rf(_bc(spark, d))


@query()
def est_rf_f2(spark, d):
    return linkage.est_rf(_f2(spark, d))


@query("""SELECT m1, m2, sum(n * log10(n * t / (a * b))) AS lod, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY m1, m2, ga) AS a, sum(n) OVER (PARTITION BY m1, m2, gb) AS b, sum(n) OVER (PARTITION BY m1, m2) AS t FROM
(SELECT x.marker AS m1, y.marker AS m2, x.g AS ga, y.g AS gb, CAST(count(*) AS DOUBLE) AS n FROM g2 x JOIN g2 y ON x.ind = y.ind AND x.marker < y.marker GROUP BY ALL)) GROUP BY m1, m2""")
def marker_lrt(spark, d):
    return linkage.marker_lrt(_f2(spark, d))


_RF = """, rf AS (SELECT m1, m2, b / n AS rf, CASE WHEN b > 0 THEN b * log10(b / n) ELSE 0 END + CASE WHEN b < n THEN (n - b) * log10(1 - b / n) ELSE 0 END + n * log10(2) AS lod FROM
(SELECT x.marker AS m1, y.marker AS m2, count(*) AS n, sum(CASE WHEN x.g <> y.g THEN 1.0 ELSE 0 END) AS b FROM g1 x JOIN g1 y ON x.ind = y.ind AND x.marker < y.marker GROUP BY x.marker, y.marker))"""


@query(_RF + """, links AS (SELECT m1 AS a, m2 AS b FROM rf WHERE rf <= 0.5 AND lod > 0.5 UNION SELECT m2, m1 FROM rf WHERE rf <= 0.5 AND lod > 0.5),
reach AS (WITH RECURSIVE r AS (SELECT marker AS m, marker AS t FROM map UNION SELECT r.m, links.b FROM r JOIN links ON links.a = r.t) SELECT m, min(t) AS c FROM r GROUP BY m),
lg AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS lg FROM reach GROUP BY c) SELECT m AS marker, CAST(lg AS INT) AS lg FROM reach JOIN lg USING (c)""")
def form_linkage_groups(spark, d):
    c = _bc(spark, d)
    return linkage.form_linkage_groups(c.map, linkage.est_rf(c), 0.5, 0.5)


@query(_RF + """, b AS (SELECT m1 AS marker, rf, lod FROM rf UNION ALL SELECT m2, rf, lod FROM rf), d AS (SELECT marker, coalesce(max(lod) FILTER (WHERE rf > 0.5), 0) - coalesce(max(lod) FILTER (WHERE rf < 0.5), 0) AS diff FROM b GROUP BY marker) SELECT * FROM d WHERE diff >= -1000""")
def check_alleles(spark, d):
    return linkage.check_alleles(linkage.est_rf(_bc(spark, d)), -1000.0)


_STEP = "SELECT ind, g.chr, g.ord, g, pos, lag(g) OVER w AS g0, lag(pos) OVER w AS pos0, lag(g.ord) OVER w AS ord0 FROM {g} g JOIN map USING (marker) WINDOW w AS (PARTITION BY ind, g.chr ORDER BY g.ord)"


@query(f"SELECT ind, CAST(coalesce(n, 0) AS BIGINT) AS n_xo FROM pheno LEFT JOIN (SELECT ind, sum(abs(g - g0)) AS n FROM ({_STEP.format(g='g2')}) GROUP BY ind) USING (ind)")
def count_xo(spark, d):
    return linkage.count_xo(_f2(spark, d))


@query(f"SELECT ind, chr, (pos + pos0) / 2 AS location, pos0 AS \"left\", pos AS \"right\", g0 AS gleft, g AS gright, ord - ord0 - 1 AS n_between FROM ({_STEP.format(g='g1')}) WHERE g <> g0")
def locate_xo(spark, d):
    return linkage.locate_xo(_bc(spark, d))


@query("SELECT a.g AS g1, b.g AS g2, count(*) AS n FROM pheno LEFT JOIN (SELECT ind, g FROM g2 WHERE marker = 'M1') a USING (ind) LEFT JOIN (SELECT ind, g FROM g2 WHERE marker = 'M2') b USING (ind) GROUP BY ALL")
def geno_crosstab(spark, d):
    return linkage.geno_crosstab(_f2(spark, d), "M1", "M2")


@query(f"SELECT ind, s.chr, coalesce(gap, CASE WHEN k.ind IS NULL THEN len END, 0) AS gap FROM pheno CROSS JOIN (SELECT chr, max(pos) - min(pos) AS len FROM map GROUP BY chr) s LEFT JOIN (SELECT ind, chr, max(pos - pos0) AS gap FROM ({_STEP.format(g='g2')}) GROUP BY ind, chr) k USING (ind, chr)")
def typing_gap(spark, d):
    return linkage.typing_gap(_f2(spark, d))


@query("SELECT marker, count(*) AS density FROM map a JOIN map b ON a.chr = b.chr AND abs(a.pos - b.pos) <= 10 GROUP BY a.marker".replace("SELECT marker", "SELECT a.marker AS marker"))
def calculate_density(spark, d):
    return linkage.calculate_density(_f2(spark, d).map, 10.0)


@query("SELECT marker, 1 - coalesce(n, 0) / (SELECT count(*) FROM pheno) AS missing FROM map LEFT JOIN (SELECT marker, count(*) AS n FROM g2 GROUP BY marker) USING (marker)")
def score_missing(spark, d):
    return linkage.score_missing(_f2(spark, d))


@query("SELECT chr, marker FROM map WHERE ord IN (1, 3)")
def pick_marker_subset(spark, d):
    return linkage.pick_marker_subset(_f2(spark, d).map, 15.0)


_NATIONS = ", n AS (SELECT s_nationkey AS ind, s_suppkey % 20 AS m, min(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 2 END) AS g FROM supplier GROUP BY ALL)"


@query(_NATIONS + " SELECT a.ind AS ind1, b.ind AS ind2, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (WHERE a.g = b.g) AS INT) AS n_match, count(*) FILTER (WHERE a.g = b.g) / count(*) AS prop FROM n a JOIN n b ON a.ind < b.ind AND a.m = b.m GROUP BY ALL")
def compare_geno(spark, d):
    """Nations as individuals, twenty supplier groups as markers."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    g = s.groupBy(F.col("s_nationkey").cast("long").alias("ind"), (F.col("s_suppkey") % 20).alias("m")).agg(F.min(F.when(F.col("s_acctbal") > 5000, 1).otherwise(2)).alias("g"))
    c = _bc(spark, d).with_(geno=g.select("ind", F.lit("1").alias("chr"), F.col("m").cast("string").alias("marker"), F.col("m").cast("int").alias("ord"), "g"))
    return linkage.compare_geno(c)


# Reconstruction


@query()
def calc_genoprob_f2(spark, d):
    return hmm.calc_genoprob(_f2(spark, d), step=5.0).select("ind", "chr", "locus", "pos", *(F.round(F.get("p", F.lit(k)), 9).alias(f"p{k + 1}") for k in range(3)))


_BC_PROB = """
, r AS (SELECT 0.5 * (1 - exp(-10.0 / 50)) AS r),
loci AS (SELECT ind, m.chr, m.marker, m.ord, m.pos, g, CASE WHEN g IS NULL THEN 1 WHEN g = 1 THEN 1 - 1e-4 ELSE 1e-4 END AS e1, CASE WHEN g IS NULL THEN 1 WHEN g = 2 THEN 1 - 1e-4 ELSE 1e-4 END AS e2 FROM pheno CROSS JOIN map m LEFT JOIN g1 USING (ind, marker)),
fw AS MATERIALIZED (WITH RECURSIVE f AS (SELECT ind, chr, 1 AS k, 0.5 * e1 AS a1, 0.5 * e2 AS a2 FROM loci WHERE ord = 1
  UNION ALL SELECT f.ind, f.chr, k + 1, (a1 * (1 - r) + a2 * r) * e1, (a1 * r + a2 * (1 - r)) * e2 FROM f JOIN loci l ON l.ind = f.ind AND l.chr = f.chr AND l.ord = f.k + 1, r) SELECT * FROM f),
bw AS MATERIALIZED (WITH RECURSIVE b AS (SELECT ind, chr, ord AS k, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM loci WHERE ord = CASE chr WHEN '1' THEN 4 ELSE 3 END
  UNION ALL SELECT b.ind, b.chr, k - 1, b1 * e1 * (1 - r) + b2 * e2 * r, b1 * e1 * r + b2 * e2 * (1 - r) FROM b JOIN loci l ON l.ind = b.ind AND l.chr = b.chr AND l.ord = b.k, r WHERE k > 1) SELECT * FROM b),
prob AS (SELECT l.ind, l.chr, l.marker AS locus, l.ord, l.pos, a1 * b1 / (a1 * b1 + a2 * b2) AS p1, a2 * b2 / (a1 * b1 + a2 * b2) AS p2 FROM loci l JOIN fw ON fw.ind = l.ind AND fw.chr = l.chr AND fw.k = l.ord JOIN bw ON bw.ind = l.ind AND bw.chr = l.chr AND bw.k = l.ord)
"""


@query(_BC_PROB + " SELECT ind, locus, round(p1, 8) AS p1 FROM prob")
def calc_genoprob_bc(spark, d):
    return hmm.calc_genoprob(_bc(spark, d)).select("ind", "locus", F.round(F.get("p", F.lit(0)), 8).alias("p1"))


@query()
def argmax_geno(spark, d):
    return hmm.argmax_geno(_f2(spark, d))


@query()
def sim_geno(spark, d):
    return hmm.sim_geno(_f2(spark, d))


@query(""", a AS (SELECT ind, m.chr, m.marker, m.ord, g, last_value(g IGNORE NULLS) OVER (PARTITION BY ind, m.chr ORDER BY m.ord) AS l, first_value(g IGNORE NULLS) OVER (PARTITION BY ind, m.chr ORDER BY m.ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
FROM pheno CROSS JOIN map m LEFT JOIN g2 USING (ind, marker)) SELECT ind, chr, marker, ord, coalesce(g, CASE WHEN l = r THEN l END) AS g FROM a WHERE coalesce(g, CASE WHEN l = r THEN l END) IS NOT NULL""")
def fill_geno(spark, d):
    return hmm.fill_geno(_f2(spark, d), "no_dbl_XO").geno


@query()
def calc_errorlod(spark, d):
    return hmm.calc_errorlod(_f2(spark, d))


@query()
def est_map(spark, d):
    return hmm.est_map(_bc(spark, d))[0]


@query(_BC_PROB + " SELECT chr, locus, pos, -avg(CASE WHEN p1 > 0 THEN p1 * ln(p1) ELSE 0 END + CASE WHEN p2 > 0 THEN p2 * ln(p2) ELSE 0 END) / ln(2) AS entropy, avg(p2 - p2 * p2) / 0.25 AS variance FROM prob GROUP BY ALL")
def info_content(spark, d):
    return hmm.info(hmm.calc_genoprob(_bc(spark, d)))


# Scans


@query(_MR.format(g="g2") + " SELECT * FROM mr")
def scanone_mr(spark, d):
    return scan.scan_mr(_f2(spark, d), ["price"])


@query(_MR.format(g="g1") + " SELECT * FROM mr")
def scanone_mr_bc(spark, d):
    return scan.scan_mr(_bc(spark, d), ["price"])


@query(", cell AS (SELECT chr, marker, ord, g, count(*) AS n, sum(b) AS s FROM g2 JOIN pheno USING (ind) GROUP BY ALL) SELECT c.chr, m.pos, c.ord, c.marker AS locus, 'done' AS trait, greatest(0, sum(CASE WHEN s > 0 AND s < n THEN s * log10(s / n) + (n - s) * log10(1 - s / n) ELSE 0 END) - (sum(s) * log10(sum(s) / sum(n)) + (sum(n) - sum(s)) * log10(1 - sum(s) / sum(n)))) AS lod FROM cell c JOIN map m USING (marker) GROUP BY c.chr, m.pos, c.ord, c.marker")
def scanone_binary_mr(spark, d):
    return scan.scan_binary_mr(_f2(spark, d), "done")


@query(_BC_PROB + """, hk AS (SELECT chr, pos, ord, locus, count(*) AS n, sum(p1 * p1) AS a, sum(p1 * p2) AS b, sum(p2 * p2) AS c, sum(p1 * y) AS u, sum(p2 * y) AS v, sum(y * y) - sum(y) * sum(y) / count(*) AS r0, sum(y * y) AS q FROM prob JOIN pheno USING (ind) GROUP BY ALL)
SELECT chr, pos, ord, locus, 'price' AS trait, round(greatest(0, n / 2 * log10(r0 / (q - (c * u * u - 2 * b * u * v + a * v * v) / (a * c - b * b)))), 6) AS lod FROM hk""")
def scanone_hk_bc(spark, d):
    return scan.scan_hk(_bc(spark, d), "price").withColumn("lod", F.round("lod", 6))


@query()
def scanone_hk_f2(spark, d):
    return scan.scan_hk(_f2(spark, d), "price", step=5.0)


@query()
def scanone_hk_covar(spark, d):
    c = _f2(spark, d)
    cov = c.individual.select("ind", F.lit("rank").alias("name"), F.substring("strata", 1, 1).cast("double").alias("value"))
    return scan.scan_hk(c, "price", covar=cov, addcovar=["rank"], intcovar=["rank"])


@query()
def scanone_imp(spark, d):
    return scan.scan_imp(_f2(spark, d), "price")


@query()
def scanone_em(spark, d):
    return scan.scan_em(_f2(spark, d), "price")


@query()
def scanone_ehk(spark, d):
    return scan.scan_ehk(_f2(spark, d), "price")


@query()
def scanone_binary_hk(spark, d):
    return scan.scan_binary(_f2(spark, d), "done", "hk")


@query()
def scanone_binary_em(spark, d):
    return scan.scan_binary(_f2(spark, d), "done", "em")


@query()
def scanone_2part(spark, d):
    return scan.scan_2part(_f2(spark, d), "price")


@query(""", rk AS (SELECT ind, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS r FROM pheno),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pheno), tie AS (SELECT 1 - sum(k ** 3 - k) / (max(n) ** 3 - max(n)) AS c FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM pheno GROUP BY y), n),
s AS (SELECT g.chr, pos, g.ord, marker AS locus, g, CAST(count(*) AS DOUBLE) AS sp, sum(r) AS sr FROM g2 g JOIN rk USING (ind) JOIN map USING (marker) GROUP BY ALL)
SELECT chr, pos, ord, locus, 'price' AS trait, sum((n - sp) * sp * sp * 6 * (sr / sp - (n + 1) / 2) ** 2 / (n * sp - sp * sp)) / (max(n) * (max(n) + 1) * ln(10) * max(c)) AS lod FROM s, n, tie GROUP BY chr, pos, ord, locus""")
def scanone_np(spark, d):
    c = _f2(spark, d)
    return scan.scan_np(c, "price", scan.observed_prob(c))


@query()
def scanone_perm(spark, d):
    return scan.scanone_perm(_f2(spark, d), "price", 50)


@query()
def scanone_boot(spark, d):
    return scan.scanone_boot(_f2(spark, d), "price", "1")


_PEAK = "arg_max(pos, (lod, -pos))"


@query(_MR.format(g="g2") + f" SELECT chr, {_PEAK} AS pos, arg_max(locus, (lod, -pos)) AS locus, trait, max(lod) AS lod FROM mr GROUP BY chr, trait HAVING max(lod) > 0.1")
def summary_scanone(spark, d):
    return scan_results.summary_scanone(scan.scan_mr(_f2(spark, d), ["price"]), 0.1)


@query(_MR.format(g="g2") + f" SELECT trait, arg_max(chr, lod) AS chr, {_PEAK} AS pos, arg_max(locus, lod) AS locus, max(lod) AS lod FROM mr GROUP BY trait")
def max_scanone(spark, d):
    return scan_results.max_scanone(scan.scan_mr(_f2(spark, d), ["price"]))


@query(_MR.format(g="g2") + f", x AS (SELECT *, max(lod) OVER (PARTITION BY chr) AS top, lag(pos) OVER (PARTITION BY chr ORDER BY pos) AS p, lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS q FROM mr) SELECT chr, trait, min(coalesce(p, pos)) AS lo, {_PEAK} AS peak, max(coalesce(q, pos)) AS hi FROM x WHERE lod > top - 0.1 GROUP BY chr, trait")
def lod_interval(spark, d):
    return scan_results.lod_interval(scan.scan_mr(_f2(spark, d), ["price"]), 0.1)


@query(_MR.format(g="g2") + f""", x AS (SELECT *, lag(pos) OVER w AS p, lead(pos) OVER w AS q FROM mr WINDOW w AS (PARTITION BY chr ORDER BY pos)),
a AS (SELECT *, 10 ** lod * CASE WHEN p IS NULL THEN q - pos WHEN q IS NULL THEN pos - p ELSE (q - p) / 2 END AS area FROM x),
b AS (SELECT *, (sum(area) OVER (PARTITION BY chr ORDER BY lod DESC, pos ROWS UNBOUNDED PRECEDING) - area) / sum(area) OVER (PARTITION BY chr) AS before FROM a)
SELECT chr, trait, min(pos) AS lo, {_PEAK} AS peak, max(pos) AS hi FROM b WHERE before < 0.6 GROUP BY chr, trait""")
def bayes_interval(spark, d):
    return scan_results.bayes_interval(scan.scan_mr(_f2(spark, d), ["price"]), 0.6)


@query(_MR.format(g="g2") + ", mb AS (" + _MR.format(g="g1").split("mr AS (")[1].rstrip()[:-1].replace("FROM cell c", "FROM (SELECT chr, marker, ord, g, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM g1 JOIN pheno USING (ind) GROUP BY ALL) c") + ") SELECT a.chr, a.pos, a.ord, a.locus, a.trait, a.lod - b.lod AS lod FROM mr a JOIN mb b USING (locus)")
def scan_difference(spark, d):
    return scan_results.arithmetic(scan.scan_mr(_f2(spark, d), ["price"]), scan.scan_mr(_bc(spark, d), ["price"]), -1)


_PERMS = "(SELECT o_orderpriority AS trait, 'all' AS region, (o_orderkey // 4) AS rep, o_totalprice AS maxlod FROM orders)"


@query(f"SELECT trait, region, 0.05 AS alpha, quantile_cont(maxlod, 0.95) AS threshold FROM {_PERMS} GROUP BY trait, region UNION ALL SELECT trait, region, 0.1, quantile_cont(maxlod, 0.9) FROM {_PERMS} GROUP BY trait, region", with_cte=False)
def perm_thresholds(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("trait"), F.lit("all").alias("region"), (F.col("o_orderkey") / 4).cast("long").alias("rep"), F.col("o_totalprice").alias("maxlod"))
    return scan_results.perm_thresholds(o)


@query(f"SELECT trait, lod, (SELECT count(*) FILTER (WHERE maxlod >= lod) / count(*) FROM {_PERMS} q WHERE q.trait = p.trait) AS pval FROM (SELECT trait, avg(maxlod) AS lod FROM {_PERMS} GROUP BY trait) p", with_cte=False)
def perm_pvalues(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("trait"), F.col("o_totalprice").alias("maxlod"))
    return scan_results.perm_pvalues(o.groupBy("trait").agg(F.avg("maxlod").alias("lod")), o)


# Pairs of loci and models


@query()
def scantwo_hk(spark, d):
    from crossloom.operators import scan2

    return scan2.scantwo_hk(_bc(spark, d), "price")


@query(""", cell AS (SELECT a.marker AS locus1, b.marker AS locus2, a.g AS ga, b.g AS gb, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM g2 a JOIN g2 b ON a.ind = b.ind AND a.marker < b.marker JOIN pheno p ON p.ind = a.ind GROUP BY ALL)
SELECT locus1, locus2, sum(n) / 2 * log10((sum(q) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s * s / n))) AS lod_full FROM cell GROUP BY locus1, locus2""")
def scantwo_mr_full(spark, d):
    from crossloom.operators import scan2

    return scan2.scantwo_mr(_f2(spark, d), "price").select("locus1", "locus2", "lod_full")


@query()
def scantwo_mr(spark, d):
    from crossloom.operators import scan2

    return scan2.scantwo_mr(_f2(spark, d), "price")


@query()
def summary_scantwo(spark, d):
    from crossloom.operators import scan2

    return scan2.summary_scantwo(scan2.scantwo_mr(_f2(spark, d), "price"))


@query()
def scantwo_perm(spark, d):
    from crossloom.operators import scan2

    return scan2.scantwo_perm(_bc(spark, d), "price")


@query()
def fit_qtl(spark, d):
    from crossloom.operators import qtl

    c = _f2(spark, d)
    got = qtl.Model(c, "price").fit(qtl.make_qtl(c, ["1", "2"], [10.0, 0.0]), "y~Q1*Q2")
    return spark.createDataFrame(got["dropone"], "term string, df int, lod double, pvar double, f double, p_chi2 double, p_f double")


@query()
def add_qtl(spark, d):
    from crossloom.operators import qtl

    c = _f2(spark, d)
    return spark.createDataFrame(qtl.Model(c, "price").add_qtl(qtl.make_qtl(c, ["1"], [10.0])), "chr string, pos double, locus string, lod double")


@query()
def stepwise_qtl(spark, d):
    from crossloom.operators import qtl

    best, terms, plod = qtl.Model(_f2(spark, d), "price").stepwise(3, (0.1, 0.2, 0.1))
    return spark.createDataFrame([(k, *x, qtl.format_formula(terms), plod) for k, x in enumerate(best.loci, 1)], "q int, chr string, pos double, locus string, formula string, plod double")


@query()
def cim(spark, d):
    from crossloom.operators import qtl

    return qtl.cim(_f2(spark, d), "price", 1)


# Effects, cofactors, orders, simulation


@query("SELECT g AS g1, count(*) AS n, avg(y) AS mean, stddev_samp(y) / sqrt(count(*)) AS se FROM g2 JOIN pheno USING (ind) WHERE marker = 'M2' GROUP BY g")
def effect_plot(spark, d):
    from crossloom.operators import effects

    return effects.effect_plot(_f2(spark, d), "price", "M2")


@query("SELECT a.g AS g1, b.g AS g2, count(*) AS n, avg(y) AS mean, stddev_samp(y) / sqrt(count(*)) AS se FROM g2 a JOIN g2 b USING (ind) JOIN pheno USING (ind) WHERE a.marker = 'M2' AND b.marker = 'M6' GROUP BY ALL")
def effect_plot_pair(spark, d):
    from crossloom.operators import effects

    return effects.effect_plot(_f2(spark, d), "price", "M2", "M6")


@query()
def effect_scan(spark, d):
    from crossloom.operators import effects

    return effects.effect_scan(_f2(spark, d), "price")


@query("SELECT marker FROM map WHERE marker IN ('M2', 'M4', 'M6')")
def mqm_set_cofactors(spark, d):
    from crossloom.operators import effects

    return effects.mqm_set_cofactors(_f2(spark, d), 2)


@query()
def mqm_scan(spark, d):
    from crossloom.operators import mixture

    return mixture.mqm_scan(_f2(spark, d), "price", ["M2", "M6"], step=10.0)[0]


@query()
def cofactor_scan(spark, d):
    from crossloom.operators import effects

    return effects.cofactor_scan(_f2(spark, d), "price", ["M2", "M6"], step=10.0)[0]


@query()
def mqm_augment(spark, d):
    from crossloom.operators import mixture

    return mixture.augment(_bc(spark, d))


@query()
def scanone_var(spark, d):
    from crossloom.operators import effects

    return effects.scanone_var(_bc(spark, d), "price")


@query()
def ripple_count(spark, d):
    from crossloom.operators import effects

    return effects.ripple_count(_bc(spark, d), "1", 4)


@query()
def sim_cross(spark, d):
    """As many individuals as there are customers."""
    from crossloom.operators import sim

    n = spark.read.parquet(f"{d}/customer.parquet").count()
    return sim.sim_cross(sales_map(spark), "f2", n, [("1", 15.0, 1.0, 0.0)], missing=0.1).geno


@query()
def scan_phylo(spark, d):
    """As many individuals in each cross as there are suppliers."""
    from crossloom.operators import sim

    n = spark.read.parquet(f"{d}/supplier.parquet").count()
    crosses = sim.sim_phylo(sales_map(spark), "ABC", "A|BC", ["AB", "AC", "BC"], n, [("1", 10.0, 1.0)])
    return sim.summary_phylo(sim.scan_phylo(crosses, sim.all_partitions("ABC")))


# More scans, permutations of any scan, tables behind plots


@query()
def scantwo_imp(spark, d):
    from crossloom.operators import scan2

    return scan2.scantwo_imp(_bc(spark, d), "price", 16)


@query()
def scantwo_pvalues(spark, d):
    from crossloom.operators import scan2

    c = _bc(spark, d)
    return scan2.scantwo_pvalues(scan2.summary_scantwo(scan2.scantwo_hk(c, "price")), scan2.scantwo_perm(c, "price", 20))


@query()
def fit_qtl_binary(spark, d):
    from crossloom.operators import qtl

    c = _bc(spark, d)
    got = qtl.Model(c, "done").fit_binary(qtl.make_qtl(c, ["1", "2"], [10.0, 0.0]))
    return spark.createDataFrame([(got["formula"], float(got["lod"]))], "formula string, lod double")


@query()
def permute_scan(spark, d):
    from crossloom.operators import permute

    return permute.replicate_maxima(permute.permute_scan(_f2(spark, d), "price", lambda c, t: scan.scan_mr(c, [t]), 3), "price")


@query(_MR.format(g="g2").replace("FROM g2 JOIN pheno USING (ind)", "FROM g2 JOIN pheno USING (ind)") + " SELECT * FROM mr UNION ALL SELECT chr, pos, ord, locus, 'done', lod FROM (" + _MR.format(g="g2").split("mr AS (")[1].rstrip()[:-1].replace("FROM cell c", "FROM (SELECT chr, marker, ord, g, count(*) AS n, sum(b) AS s, sum(b * b) AS q FROM g2 JOIN pheno USING (ind) GROUP BY ALL) c") + ")")
def scan_all_traits(spark, d):
    from crossloom.operators import effects

    return effects.scan_all(_f2(spark, d), lambda c, t: scan.scan_mr(c, [t]))


@query("SELECT m.chr, m.ord, m.marker, 1 - coalesce(n, 0) / (SELECT count(*) FROM pheno) AS missing FROM map m LEFT JOIN (SELECT marker, count(*) AS n FROM g2 GROUP BY marker) USING (marker)")
def plot_missing(spark, d):
    from crossloom.operators import plots

    return plots.missing_table(_f2(spark, d))


@query(", r AS (SELECT min(y) AS lo, max(y) AS hi, (max(y) - min(y)) / 20 AS w FROM pheno) SELECT CAST(least(floor((y - lo) / w), 19) AS BIGINT) AS bin, any_value(lo + w * least(floor((y - lo) / w), 19)) AS lo, count(*) AS n FROM pheno, r GROUP BY 1")
def plot_pheno(spark, d):
    from crossloom.operators import plots

    return plots.histogram(_f2(spark, d).pheno.where("trait = 'price'"), "y", 20)


@query("SELECT g, y FROM g2 JOIN pheno USING (ind) WHERE marker = 'M4'")
def plot_pheno_by_geno(spark, d):
    from crossloom.operators import plots

    return plots.pheno_by_geno(_f2(spark, d), "price", "M4")


@query("SELECT ind, chr, ord, g FROM g2 WHERE chr = '1'")
def plot_geno_image(spark, d):
    from crossloom.operators import plots

    return plots.geno_image(_f2(spark, d), "1")


@query(_MR.format(g="g2") + " SELECT *, pos + CASE chr WHEN '2' THEN 30 + 25 ELSE 0 END AS x FROM mr")
def plot_scan(spark, d):
    from crossloom.operators import plots

    return plots.scan_table(scan.scan_mr(_f2(spark, d), ["price"]))


@query(_RF + " SELECT m1, m2, lod AS value FROM rf UNION ALL SELECT m2, m1, lod FROM rf")
def pull_rf(spark, d):
    return meta.pull_rf(linkage.est_rf(_bc(spark, d)), "lod")


@query(_BC_PROB + " SELECT ind, chr, locus, pos, 2 AS genotype, round(p2, 8) AS p FROM prob")
def pull_genoprob(spark, d):
    return meta.pull_genoprob(hmm.calc_genoprob(_bc(spark, d)), omit_first=True).withColumn("p", F.round("p", 8))


@query(_BC_PROB + " SELECT ind, 'M2.2' AS name, round(p2, 8) AS value FROM prob WHERE locus = 'M2'")
def form_marker_covar(spark, d):
    return edit.form_marker_covar(_bc(spark, d), [("1", 11.0)]).withColumn("value", F.round("value", 8))


from crossloom import queries_more as _more  # noqa: E402, F401  (registers its queries)
from crossloom import queries_models as _models  # noqa: E402, F401, I001  (builds on those)
