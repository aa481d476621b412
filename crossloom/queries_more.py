"""More registered queries: models by nested regressions, reconstruction of intercrosses, X chromosomes, results of scans, editing."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossloom.operators import edit, effects, hmm, linkage, meta, plots, qtl, scan, scan2, scan_results, xchr
from crossloom.plans.crosswalk import part_map, part_places, sales_map
from crossloom.queries import _BC_PROB, _MR, _PLACES, INEXACT, ORACLES, QUERIES, _bc, _f2, _places, query

# Oracles of regressions: columns are made orthogonal one by one, so the residual sums of all models of a nested series fall off.


def nested(source: str, keys: str, columns: int) -> str:
    """``source``: keys, y, x1 .. xk. Gives keys, n, r0, r1, .. rk: residual sums of squares of the models with the first columns."""
    w = f"OVER (PARTITION BY {keys})"
    sql = f"SELECT {keys}, y - avg(y) {w} AS yc" + "".join(f", x{k} - avg(x{k}) {w} AS c{k}" for k in range(1, columns + 1)) + f" FROM ({source})"
    for k in range(1, columns + 1):
        less = "".join(f" - q{j} * CASE WHEN sum(q{j} * q{j}) {w} > 1e-9 * sum(c{j} * c{j}) {w} THEN sum(c{k} * q{j}) {w} / sum(q{j} * q{j}) {w} ELSE 0 END" for j in range(1, k))
        sql = f"SELECT *, c{k}{less} AS q{k} FROM ({sql})"
    gain = lambda j: f"CASE WHEN sum(q{j} * q{j}) > 1e-9 * sum(c{j} * c{j}) THEN sum(yc * q{j}) ** 2 / sum(q{j} * q{j}) ELSE 0 END"
    steps = "".join(", sum(yc * yc)" + "".join(f" - {gain(j)}" for j in range(1, k + 1)) + f" AS r{k}" for k in range(1, columns + 1))
    return f"SELECT {keys}, count(*) AS n, sum(yc * yc) AS r0{steps} FROM ({sql}) GROUP BY {keys}"


def lod(before: str, after: str) -> str:
    return f"greatest(0, n / 2.0 * log10({before} / {after}))"


def f2_prob(step: int, error: float = 1e-4) -> str:
    """Forward and backward recursions of an intercross on a grid of ``step`` cM."""
    a, b, c = (f"(SELECT {x} FROM tr)" for x in "abc")
    return f"""
, grid AS (SELECT c.chr, CAST(p.p AS DOUBLE) AS pos, row_number() OVER (PARTITION BY c.chr ORDER BY p.p) AS k, coalesce(m.marker, 'c' || c.chr || '.loc' || p.p) AS locus, m.marker FROM (VALUES ('1', 30), ('2', 20)) c(chr, top) JOIN range(0, 31, {step}) p(p) ON p.p <= c.top LEFT JOIN map m ON m.chr = c.chr AND m.pos = p.p),
tr AS (SELECT (1 - r) ** 2 AS a, 2 * r * (1 - r) AS b, r * r AS c FROM (SELECT 0.5 * (1 - exp(-{step}.0 / 50)) AS r)),
loci AS (SELECT p.ind, g.chr, g.k, g.pos, g.locus, {', '.join(f"CASE WHEN x.g IS NULL THEN 1 WHEN x.g = {s} THEN 1 - {error!r} ELSE {error / 2!r} END AS e{s}" for s in (1, 2, 3))} FROM pheno p CROSS JOIN grid g LEFT JOIN g2 x ON x.ind = p.ind AND x.marker = g.marker),
fw AS MATERIALIZED (WITH RECURSIVE f AS (SELECT ind, chr, k, 0.25 * e1 AS a1, 0.5 * e2 AS a2, 0.25 * e3 AS a3 FROM loci WHERE k = 1
  UNION ALL SELECT f.ind, f.chr, l.k, (a1 * {a} + a2 * {b} / 2 + a3 * {c}) * e1, (a1 * {b} + a2 * ({a} + {c}) + a3 * {b}) * e2, (a1 * {c} + a2 * {b} / 2 + a3 * {a}) * e3 FROM f JOIN loci l ON l.ind = f.ind AND l.chr = f.chr AND l.k = f.k + 1) SELECT * FROM f),
bw AS MATERIALIZED (WITH RECURSIVE b AS (SELECT ind, chr, k, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2, 1.0::DOUBLE AS b3 FROM loci JOIN (SELECT chr, max(k) AS k FROM grid GROUP BY chr) USING (chr, k)
  UNION ALL SELECT b.ind, b.chr, b.k - 1, {a} * e1 * b1 + {b} * e2 * b2 + {c} * e3 * b3, {b} / 2 * e1 * b1 + ({a} + {c}) * e2 * b2 + {b} / 2 * e3 * b3, {c} * e1 * b1 + {b} * e2 * b2 + {a} * e3 * b3 FROM b JOIN loci l ON l.ind = b.ind AND l.chr = b.chr AND l.k = b.k WHERE b.k > 1) SELECT * FROM b),
prob AS (SELECT ind, chr, k AS ord, pos, locus, a1 * b1 / s AS p1, a2 * b2 / s AS p2, a3 * b3 / s AS p3 FROM (SELECT *, a1 * b1 + a2 * b2 + a3 * b3 AS s FROM loci JOIN fw USING (ind, chr, k) JOIN bw USING (ind, chr, k)))
"""


@query(f2_prob(5) + " SELECT ind, chr, locus, pos, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM prob")
def calc_genoprob_grid(spark, d):
    return hmm.calc_genoprob(_f2(spark, d), step=5.0).select("ind", "chr", "locus", "pos", *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{k + 1}") for k in range(3)))


@query(f2_prob(10) + " SELECT ind, chr, locus AS marker, CAST(ord AS INT) AS ord, CASE WHEN p1 >= 0.95 THEN 1 WHEN p2 >= 0.95 THEN 2 ELSE 3 END AS g FROM prob WHERE greatest(p1, p2, p3) >= 0.95")
def fill_geno_maxmarginal(spark, d):
    return hmm.fill_geno(_f2(spark, d), "maxmarginal").geno


def _best(v: int) -> str:
    """Of the ways into state v: (score, path so far); ties go to the smaller state."""
    t = {(1, 1): "a", (1, 2): "b", (1, 3): "c", (2, 1): "b / 2", (2, 2): "a + c", (2, 3): "b / 2", (3, 1): "c", (3, 2): "b", (3, 3): "a"}
    s = [f"v{u} + (SELECT ln({t[u, v]}) FROM tr)" for u in (1, 2, 3)]
    at = f"CASE WHEN {s[0]} >= {s[1]} AND {s[0]} >= {s[2]} THEN w1 WHEN {s[1]} >= {s[2]} THEN w2 ELSE w3 END || '{v}'"
    return f"greatest({', '.join(s)}) + ln(e{v}), {at}"


@query(f2_prob(10).split("fw AS MATERIALIZED")[0].rstrip().rstrip(",") + f""", vit AS (WITH RECURSIVE x AS (SELECT ind, chr, k, ln(0.25) + ln(e1) AS v1, '1' AS w1, ln(0.5) + ln(e2) AS v2, '2' AS w2, ln(0.25) + ln(e3) AS v3, '3' AS w3 FROM loci WHERE k = 1
  UNION ALL SELECT x.ind, x.chr, l.k, {_best(1)}, {_best(2)}, {_best(3)} FROM x JOIN loci l ON l.ind = x.ind AND l.chr = x.chr AND l.k = x.k + 1) SELECT * FROM x),
ends AS (SELECT ind, chr, CASE WHEN v1 >= v2 AND v1 >= v3 THEN w1 WHEN v2 >= v3 THEN w2 ELSE w3 END AS path FROM vit JOIN (SELECT chr, max(k) AS k FROM grid GROUP BY chr) USING (chr, k))
SELECT e.ind, e.chr, g.locus, CAST(g.k AS INT) AS ord, g.pos, CAST(substr(path, CAST(g.k AS INT), 1) AS INT) AS g FROM ends e JOIN grid g USING (chr)""")
def viterbi_geno(spark, d):
    return hmm.argmax_geno(_f2(spark, d))


@query("""SELECT marker, sum(n * ln(CASE g WHEN 2 THEN 0.5 * (1 - 1e-4) + 0.5 * 5e-5 ELSE 0.25 * (1 - 1e-4) + 0.75 * 5e-5 END)) AS loglik FROM (SELECT marker, g, count(*) AS n FROM g2 GROUP BY ALL) GROUP BY marker""")
def marker_loglik(spark, d):
    c = _f2(spark, d)
    return spark.createDataFrame([(m, hmm.marker_loglik(c, m)) for m in [f"M{k}" for k in range(1, 8)]], "marker string, loglik double")


# Linkage


@query(""", c AS (SELECT x.marker AS m1, y.marker AS m2, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE abs(x.g - y.g) = 1) AS DOUBLE) AS d1, CAST(count(*) FILTER (WHERE abs(x.g - y.g) = 2) AS DOUBLE) AS d2, CAST(count(*) FILTER (WHERE x.g = 2 AND y.g = 2) AS DOUBLE) AS h,
 CAST(count(*) FILTER (WHERE x.g <> 2 AND y.g <> 2 AND x.g = y.g) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE x.g = 2 AND y.g <> 2) AS DOUBLE) AS ho, CAST(count(*) FILTER (WHERE x.g <> 2 AND y.g = 2) AS DOUBLE) AS oh FROM g2 x JOIN g2 y ON x.ind = y.ind AND x.marker < y.marker GROUP BY ALL),
em AS (WITH RECURSIVE e AS (SELECT m1, m2, 0 AS i, CAST(0.01 AS DOUBLE) AS r, false AS done FROM c
  UNION ALL SELECT m1, m2, i + 1, q, abs(q - r) < 1e-6 * (abs(q) + 1e-4) FROM (SELECT e.m1, e.m2, i, r, least(greatest((0.5 * d1 + d2 + h * r * r / ((1 - r) * (1 - r) + r * r)) / n, 1e-9), 1 - 1e-9) AS q FROM e JOIN c USING (m1, m2) WHERE NOT done AND i < 10000)) SELECT * FROM e)
SELECT m1, m2, r AS rf, s * log10((1 - r) ** 2 / 0.25) + d2 * log10(r * r / 0.25) + oh * log10(2 * r * (1 - r) / 0.5) + ho * log10(r * (1 - r) / 0.25) + h * log10(((1 - r) ** 2 + r * r) / 0.5) AS lod, CAST(n AS BIGINT) AS n FROM em JOIN c USING (m1, m2) WHERE done""")
def est_rf_intercross(spark, d):
    return linkage.est_rf(_f2(spark, d))


_COFACTORS = "(SELECT marker FROM pmap WHERE ord % 3 = 0)"


@query(f"SELECT a.chr, a.marker, a.pos FROM pmap a JOIN {_COFACTORS} f ON f.marker = a.marker WHERE NOT EXISTS (SELECT 1 FROM pmap b JOIN {_COFACTORS} f ON f.marker = b.marker WHERE b.chr = a.chr AND b.marker <> a.marker AND abs(b.pos - a.pos) < 6)")
def check_distances(spark, d):
    m = part_map(spark, d)
    return linkage.check_distances(m, m.where(F.col("ord") % 3 == 0).select("marker"), 6.0)


# Scans by nested regressions


_HK = "SELECT chr, pos, ord, locus, y, p2 AS x1, p3 AS x2 FROM prob JOIN pheno USING (ind)"


@query(f2_prob(5) + f" SELECT chr, pos, CAST(ord AS INT) AS ord, locus, 'price' AS trait, {lod('r0', 'r2')} AS lod FROM ({nested(_HK, 'chr, pos, ord, locus', 2)})")
def scanone_hk_grid(spark, d):
    return scan.scan_hk(_f2(spark, d), "price", step=5.0)


_COVAR = "SELECT chr, pos, ord, locus, y, z AS x1, p2 AS x2, p3 AS x3, z * p2 AS x4, z * p3 AS x5 FROM (SELECT *, CAST(substr(strata, 1, 1) AS DOUBLE) AS z FROM prob JOIN pheno USING (ind))"


def _rank_covar(c):
    return c.individual.select("ind", F.lit("rank").alias("name"), F.substring("strata", 1, 1).cast("double").alias("value"))


@query(f2_prob(10) + f" SELECT chr, pos, CAST(ord AS INT) AS ord, locus, 'price' AS trait, {lod('r1', 'r5')} AS lod FROM ({nested(_COVAR, 'chr, pos, ord, locus', 5)})")
def scanone_hk_interactive(spark, d):
    c = _f2(spark, d)
    return scan.scan_hk(c, "price", covar=_rank_covar(c), addcovar=["rank"], intcovar=["rank"])


@query(f2_prob(10) + f" SELECT chr, pos, CAST(ord AS INT) AS ord, locus, 'price' AS trait, {lod('r1', 'r3')} AS lod FROM ({nested(_COVAR, 'chr, pos, ord, locus', 3)})")
def scanone_hk_additive(spark, d):
    c = _f2(spark, d)
    return scan.scan_hk(c, "price", covar=_rank_covar(c), addcovar=["rank"])


@query(_BC_PROB + """, e AS (SELECT chr, pos, ord, locus, count(*) AS n, regr_slope(y, p2 - p1) AS a, regr_sxx(y, p2 - p1) AS sxx, regr_syy(y, p2 - p1) AS syy, regr_sxy(y, p2 - p1) AS sxy FROM prob JOIN pheno USING (ind) GROUP BY ALL)
SELECT chr, pos, ord, locus, a, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se_a FROM e""")
def effect_scan_bc(spark, d):
    return effects.effect_scan(_bc(spark, d), "price").select("chr", "pos", "ord", "locus", "a", "se_a")


@query(_BC_PROB + ", x AS (SELECT *, o_custkey % 2 AS sex FROM prob JOIN pheno USING (ind) JOIN orders ON o_orderkey = ind) SELECT chr, pos, ord, locus, 'price' AS trait, " + lod("r0", "r1") + " AS lod FROM (" + nested("SELECT chr, pos, ord, locus, y, p2 AS x1 FROM x WHERE chr = '1'", "chr, pos, ord, locus", 1) + ") UNION ALL SELECT chr, pos, ord, locus, 'price', " + lod("r1", "r3") + " FROM (" + nested("SELECT chr, pos, ord, locus, y, sex AS x1, p2 AS x2, sex * p2 AS x3 FROM x WHERE chr = '2'", "chr, pos, ord, locus", 3) + ")")
def scanone_genome_x(spark, d):
    """The second chromosome as X: sex is in the null model, and effects are those of each sex."""
    return xchr.scan_genome(_x(spark, d), "price")


def _x(spark, d, crosstype="bc"):
    from crossloom.plans.crosswalk import sales_cross

    c = sales_cross(spark, d, crosstype)
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ind"), (F.col("o_custkey") % 2).cast("int").alias("sex"), (F.col("o_custkey") % 3 % 2).cast("int").alias("pgm"))
    return c.with_(map=c.map.withColumn("chrtype", F.when(F.col("chr") == "2", "X").otherwise("A")), individual=c.individual.drop("sex", "pgm").join(o, "ind").select("ind", "id", "sex", "pgm", "strata"))


@query("SELECT o_orderkey AS ind, (o_custkey % 2) || '-0' AS strata FROM orders")
def strata_by_sex(spark, d):
    return xchr.strata_by_sex(_x(spark, d))


@query("SELECT ind, chr, marker, ord, g FROM g1 WHERE chr = '1'")
def omit_x_chr(spark, d):
    return meta.omit_x_chr(_x(spark, d)).geno


@query("""SELECT ind, chr, marker, ord, CAST(n AS INT) AS g FROM (SELECT g2.*, CASE WHEN chr = '1' THEN g WHEN sex = 1 THEN CASE g WHEN 1 THEN 1 WHEN 3 THEN 2 END WHEN pgm = 1 THEN CASE g WHEN 3 THEN 1 WHEN 2 THEN 2 END WHEN g < 3 THEN g END AS n
FROM g2 JOIN (SELECT o_orderkey AS ind, o_custkey % 2 AS sex, o_custkey % 3 % 2 AS pgm FROM orders) USING (ind)) WHERE n IS NOT NULL""")
def fix_x_geno(spark, d):
    return edit.fix_x_geno(_x(spark, d, "f2")).geno


@query("SELECT 'A' AS chrtype, 30.0 AS length UNION ALL SELECT 'X', 20.0")
def region_lengths(spark, d):
    return spark.createDataFrame(list(xchr.region_lengths(_x(spark, d)).items()), "chrtype string, length double")


# Pairs of loci


_BOTH = "SELECT a.chr AS chr1, a.pos AS pos1, a.locus AS locus1, b.chr AS chr2, b.pos AS pos2, b.locus AS locus2, y, {x} FROM t a JOIN t b ON a.ind = b.ind AND a.locus < b.locus JOIN pheno p ON p.ind = a.ind"
_TYPED = ", t AS (SELECT ind, g1.chr, pos, marker AS locus, CASE g WHEN 2 THEN 1.0 ELSE 0.0 END AS u FROM g1 JOIN map USING (marker))"
_PAIR_KEYS = "chr1, pos1, locus1, chr2, pos2, locus2"
PAIRS = (
    _TYPED + f", pa AS ({nested(_BOTH.format(x='a.u AS x1, b.u AS x2, a.u * b.u AS x3'), _PAIR_KEYS, 3)}), pb AS ({nested(_BOTH.format(x='b.u AS x1'), _PAIR_KEYS, 1)})"
    + f", pairs AS (SELECT {_PAIR_KEYS}, 'price' AS trait, {lod('pa.r0', 'pa.r3').replace('n /', 'pa.n /')} AS lod_full, {lod('pa.r0', 'pa.r2').replace('n /', 'pa.n /')} AS lod_add, {lod('pa.r0', 'pa.r1').replace('n /', 'pa.n /')} AS lod_one1, {lod('pa.r0', 'pb.r1').replace('n /', 'pa.n /')} AS lod_one2 FROM pa JOIN pb USING ({_PAIR_KEYS}))"
)


def _pairs(spark, d):
    return scan2.scantwo_mr(_bc(spark, d), "price")


@query(PAIRS + " SELECT * FROM pairs")
def scantwo_mr_bc(spark, d):
    return _pairs(spark, d)


_STATS = ", st AS (SELECT chr1, chr2, trait, f AS \"full\", f - o AS fv1, f - a AS \"int\", a AS \"add\", a - o AS av1, o AS \"one\" FROM (SELECT chr1, chr2, trait, max(lod_full) AS f, max(lod_add) AS a, greatest(max(lod_one1), max(lod_one2)) AS o FROM pairs GROUP BY ALL))"


@query(PAIRS + _STATS + ", b AS (SELECT chr1, chr2, trait, arg_max(pos1, (lod_full, -pos1, -pos2)) AS pos1f, arg_max(pos2, (lod_full, -pos1, -pos2)) AS pos2f, arg_max(pos1, (lod_add, -pos1, -pos2)) AS pos1a, arg_max(pos2, (lod_add, -pos1, -pos2)) AS pos2a FROM pairs GROUP BY ALL) SELECT * FROM st JOIN b USING (chr1, chr2, trait)")
def summary_scantwo_bc(spark, d):
    return scan2.summary_scantwo(_pairs(spark, d))


@query(PAIRS + _STATS + " SELECT * FROM st")
def condense_scantwo(spark, d):
    return scan2.pair_statistics(_pairs(spark, d))


@query(PAIRS + " SELECT trait, max(lod_full) AS lod, arg_max(locus1, lod_full) AS locus1, arg_max(locus2, lod_full) AS locus2 FROM pairs GROUP BY trait")
def max_scantwo(spark, d):
    return scan2.max_scantwo(_pairs(spark, d)).select("trait", F.col("lod_full").alias("lod"), "locus1", "locus2")


@query(PAIRS + """, z AS (SELECT *, chr1 = chr2 AND ((SELECT count(*) FROM map m WHERE m.chr = chr1 AND m.pos > pos1 AND m.pos < pos2) < 1 OR pos2 - pos1 < 15) AS bad FROM pairs)
SELECT chr1, pos1, locus1, chr2, pos2, locus2, trait, CASE WHEN bad THEN 0 ELSE greatest(lod_full, lod_add) END AS lod_full, CASE WHEN bad THEN 0 ELSE lod_add END AS lod_add, lod_one1, lod_one2 FROM z""")
def clean_scantwo(spark, d):
    return scan2.clean_scantwo(_pairs(spark, d), sales_map(spark), 1, 15.0)


@query(PAIRS + " SELECT chr1, pos1, chr2, pos2, lod_full AS value FROM pairs UNION ALL SELECT chr2, pos2, chr1, pos1, lod_full - lod_add FROM pairs")
def plot_scantwo(spark, d):
    return plots.pair_table(_pairs(spark, d))


@query(PAIRS + " SELECT chr1, 2 * pos1 + 5 AS pos1, locus1, chr2, 2 * pos2 + 5 AS pos2, locus2, lod_full FROM pairs")
def replace_map_pairs(spark, d):
    old = sales_map(spark)
    return scan2.replace_map_pairs(_pairs(spark, d), old, old.withColumn("pos", F.col("pos") * 2 + 5)).select("chr1", "pos1", "locus1", "chr2", "pos2", "locus2", "lod_full")


@query(PAIRS + " SELECT locus1, locus2, 2 * lod_full AS lod_full, 2 * lod_add AS lod_add FROM pairs")
def add_scantwo(spark, d):
    p = _pairs(spark, d)
    return scan_results.arithmetic(p, p, 1, ("locus1", "locus2"), ("lod_full", "lod_add")).select("locus1", "locus2", "lod_full", "lod_add")


@query(PAIRS + " SELECT * FROM pairs WHERE chr1 = '1' AND chr2 = '1'")
def subset_scantwo(spark, d):
    return meta.subset_rows(_pairs(spark, d), "1")


_F2_TYPED = ", t AS (SELECT ind, g2.chr, pos, marker AS locus, CASE g WHEN 2 THEN 1.0 ELSE 0.0 END AS u, CASE g WHEN 3 THEN 1.0 ELSE 0.0 END AS v FROM g2 JOIN map USING (marker))"


@query(_F2_TYPED + f" SELECT locus1, locus2, {lod('r0', 'r8')} AS lod_full, {lod('r0', 'r4')} AS lod_add, {lod('r0', 'r2')} AS lod_one1 FROM ({nested(_BOTH.format(x='a.u AS x1, a.v AS x2, b.u AS x3, b.v AS x4, a.u * b.u AS x5, a.u * b.v AS x6, a.v * b.u AS x7, a.v * b.v AS x8'), _PAIR_KEYS, 8)})")
def scantwo_mr_f2(spark, d):
    return scan2.scantwo_mr(_f2(spark, d), "price").select("locus1", "locus2", "lod_full", "lod_add", "lod_one1")


# Models with several loci


def _two(first: str, second: str, columns: int) -> str:
    x = {1: f"{first}.p2 AS x1, {first}.p3 AS x2, {second}.p2 AS x3, {second}.p3 AS x4" + "".join(f", {first}.p{i} * {second}.p{j} AS x{5 + 2 * (i - 2) + j - 2}" for i in (2, 3) for j in (2, 3))}[1]
    return nested(f"SELECT 1 AS one, y, {x} FROM prob a JOIN prob b ON a.ind = b.ind AND a.locus = 'M2' AND b.locus = 'M5' JOIN pheno p ON p.ind = a.ind", "one", columns)


_DROP = ", ab AS (" + _two("a", "b", 8) + "), ba AS (" + _two("b", "a", 2) + ")"


def _dropped(term: str, df: int, rest: str) -> str:
    return f"SELECT '{term}' AS term, {df} AS df, ab.n / 2.0 * log10({rest} / ab.r8) AS lod, 100 * ({rest} - ab.r8) / ab.r0 AS pvar, ({rest} - ab.r8) / {df} / (ab.r8 / (ab.n - 9)) AS f FROM ab, ba"


@query(f2_prob(10) + _DROP + " " + " UNION ALL ".join((_dropped("Q1", 6, "ba.r2"), _dropped("Q2", 6, "ab.r2"), _dropped("Q1:Q2", 4, "ab.r4"))))
def fit_qtl_dropone(spark, d):
    c = _f2(spark, d)
    got = qtl.Model(c, "price").fit(qtl.make_qtl(c, ["1", "2"], [10.0, 0.0]), "y~Q1*Q2")
    return spark.createDataFrame([x[:5] for x in got["dropone"]], "term string, df int, lod double, pvar double, f double")


_ADD = "SELECT b.chr, b.pos, b.locus, y, a.p2 AS x1, a.p3 AS x2, b.p2 AS x3, b.p3 AS x4 FROM prob a JOIN prob b ON a.ind = b.ind AND a.locus = 'M2' JOIN pheno p ON p.ind = a.ind"


@query(f2_prob(10) + f" SELECT chr, pos, locus, {lod('r2', 'r4')} AS lod FROM ({nested(_ADD, 'chr, pos, locus', 4)})")
def add_qtl_scan(spark, d):
    c = _f2(spark, d)
    rows = qtl.Model(c, "price").add_qtl(qtl.make_qtl(c, ["1"], [10.0]))
    return spark.createDataFrame(rows, "chr string, pos double, locus string, lod double")


@query(f2_prob(10) + _DROP + " SELECT 'Q1:Q2' AS pair, ab.n / 2.0 * log10(ab.r4 / ab.r8) AS lod FROM ab")
def add_int(spark, d):
    c = _f2(spark, d)
    q = qtl.make_qtl(c, ["1", "2"], [10.0, 0.0])
    rows = qtl.Model(c, "price").add_int(q, qtl.parse_formula("y~Q1+Q2"))
    return spark.createDataFrame([(":".join(sorted(p)), x) for p, x in rows], "pair string, lod double")


_CIM = ", best AS (SELECT arg_max(locus, l) AS locus, arg_max(chr, l) AS chr, arg_max(pos, l) AS pos FROM (SELECT chr, pos, locus, " + lod("r0", "r2") + f" AS l FROM ({nested('SELECT chr, pos, locus, y, p2 AS x1, p3 AS x2 FROM prob JOIN pheno USING (ind)', 'chr, pos, locus', 2)})))"
_CIM_X = "SELECT b.chr, b.pos, b.ord, b.locus, y, CASE WHEN near THEN 0 ELSE a.p2 END AS x1, CASE WHEN near THEN 0 ELSE a.p3 END AS x2, b.p2 AS x3, b.p3 AS x4 FROM (SELECT *, chr = (SELECT chr FROM best) AND abs(pos - (SELECT pos FROM best)) <= 5 AS near FROM prob) b JOIN prob a ON a.ind = b.ind AND a.locus = (SELECT locus FROM best) JOIN pheno p ON p.ind = a.ind"


@query(f2_prob(10) + _CIM + f" SELECT chr, pos, CAST(ord AS INT) AS ord, locus, 'price' AS trait, {lod('r2', 'r4')} AS lod FROM ({nested(_CIM_X, 'chr, pos, ord, locus', 4)})")
def cim_one(spark, d):
    return qtl.cim(_f2(spark, d), "price", 1)


@query("SELECT 'Q1' AS name, '1' AS chr, 10.0 AS pos, 'M2' AS locus UNION ALL SELECT 'Q2', '2', 0.0, 'M5' UNION ALL SELECT 'Q3', '2', 20.0, 'M7'")
def make_qtl(spark, d):
    """Made, replaced, dropped, reordered and added."""
    c = _f2(spark, d)
    q = qtl.make_qtl(c, ["2", "1", "1"], [1.0, 9.0, 29.0])
    q = qtl.drop_from_qtl(qtl.replace_qtl(c, q, 3, "1", 0.0), 3)
    return qtl.summary_qtl(spark, qtl.add_to_qtl(c, qtl.reorder_qtl(q, [2, 1]), "2", 18.0))


# Results of scans and permutations


@query(_MR.format(g="g2") + " SELECT * FROM mr WHERE chr = '2'")
def subset_scanone(spark, d):
    return meta.subset_rows(scan.scan_mr(_f2(spark, d), ["price"]), "2")


@query(_MR.format(g="g2") + " SELECT chr, pos, ord, locus, lod AS lod1, 2 * lod AS lod2 FROM mr")
def bind_scans(spark, d):
    s = scan.scan_mr(_f2(spark, d), ["price"])
    return scan_results.bind_scans(s, s.withColumn("lod", F.col("lod") * 2))


@query(_MR.format(g="g2") + " SELECT chr, 2 * pos + 5 AS pos, ord, locus, trait, lod FROM mr")
def replace_map_scan(spark, d):
    old = sales_map(spark)
    return edit.replace_map_scan(scan.scan_mr(_f2(spark, d), ["price"]), old, old.withColumn("pos", F.col("pos") * 2 + 5))


@query(_MR.format(g="g2") + " SELECT a.chr, a.pos, a.ord, a.locus, a.trait, CASE WHEN a.ord = 2 THEN (b.lod + c.lod) / 2 ELSE a.lod END AS lod FROM mr a LEFT JOIN mr b ON b.chr = a.chr AND b.ord = a.ord - 1 LEFT JOIN mr c ON c.chr = a.chr AND c.ord = a.ord + 1")
def estimate_marker_lod(spark, d):
    s = scan.scan_mr(_f2(spark, d), ["price"])
    return edit.estimate_marker_lod(s.withColumn("lod", F.when(F.col("ord") != 2, F.col("lod"))))


@query(f2_prob(5) + " SELECT DISTINCT chr, pos, locus FROM prob WHERE locus NOT LIKE '%.loc%'")
def extract_markers(spark, d):
    return edit.extract_markers(hmm.calc_genoprob(_f2(spark, d), step=5.0).select("chr", "pos", "locus").distinct())


@query(f2_prob(5) + " SELECT DISTINCT chr, pos, locus FROM prob WHERE locus LIKE '%.loc%'")
def extract_pseudomarkers(spark, d):
    return edit.extract_markers(hmm.calc_genoprob(_f2(spark, d), step=5.0).select("chr", "pos", "locus").distinct(), True)


@query(f2_prob(5) + " SELECT chr, pos, locus, count(*) AS n FROM prob WHERE pos IN (0, 10, 20, 30) GROUP BY ALL")
def reduce_to_grid(spark, d):
    return edit.reduce_to_grid(hmm.calc_genoprob(_f2(spark, d), step=5.0), 10.0).groupBy("chr", "pos", "locus").agg(F.count(F.lit(1)).alias("n"))


_REPS = "(SELECT o_orderpriority AS trait, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'X' END AS region, o_orderkey AS rep, o_totalprice AS maxlod FROM orders)"


def _reps(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("trait"), F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("X").alias("region"), F.col("o_orderkey").alias("rep"), F.col("o_totalprice").alias("maxlod"))


@query(f"SELECT trait, region, CAST(row_number() OVER (PARTITION BY trait, region ORDER BY k, rep) AS INT) AS rep, maxlod FROM (SELECT *, 0 AS k FROM {_REPS} UNION ALL SELECT *, 1 FROM {_REPS})", with_cte=False)
def combine_perms(spark, d):
    p = _reps(spark, d).withColumn("rep", F.col("rep") / 1e6)
    return scan_results.combine_perms(p, p)


@query(f"SELECT rep, region, a.maxlod AS maxlod_1, b.maxlod AS maxlod_2 FROM (SELECT * FROM {_REPS} WHERE rep % 2 = 0) a FULL JOIN (SELECT * FROM {_REPS} WHERE rep % 3 = 0) b USING (rep, region)", with_cte=False)
def bind_perms(spark, d):
    p = _reps(spark, d)
    return scan_results.bind_perms(p.where("rep % 2 = 0"), p.where("rep % 3 = 0"))


@query(f"SELECT trait, region, rep, 0.0 AS maxlod FROM {_REPS}", with_cte=False)
def subtract_perms(spark, d):
    p = _reps(spark, d)
    return scan_results.arithmetic(p, p, -1, ("trait", "region", "rep"), ("maxlod",))


@query(f"SELECT * FROM {_REPS} WHERE trait IN ('1-URGENT', '2-HIGH')", with_cte=False)
def subset_perms(spark, d):
    return meta.subset_rows(_reps(spark, d), traits=["1-URGENT", "2-HIGH"])


@query(f"SELECT trait, region, CAST(0.05 AS DOUBLE) AS alpha, CASE region WHEN 'A' THEN quantile_cont(maxlod, 0.95 ** 0.6) ELSE quantile_cont(maxlod, 0.95 ** 0.4) END AS threshold FROM {_REPS} GROUP BY trait, region", with_cte=False)
def perm_thresholds_x(spark, d):
    return scan_results.perm_thresholds(_reps(spark, d), [0.05], {"A": 30.0, "X": 20.0})


_STAT = "['full', 'fv1', 'int', 'add', 'av1', 'one']"
_TWO = f"(SELECT 'price' AS trait, 'all' AS region, o_orderkey // 6 AS rep, {_STAT}[CAST(o_orderkey % 6 AS INT) + 1] AS stat, o_totalprice AS value FROM orders)"


def _two_reps(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    names = F.array(*(F.lit(s) for s in scan2.STATS))
    return o.select(F.lit("price").alias("trait"), F.lit("all").alias("region"), F.floor(F.col("o_orderkey") / 6).alias("rep"), F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("stat"), F.col("o_totalprice").alias("value"))


@query(f"SELECT trait, region, stat, quantile_cont(value, 0.9) AS threshold, CAST(0.1 AS DOUBLE) AS alpha FROM {_TWO} GROUP BY ALL", with_cte=False)
def scantwo_thresholds(spark, d):
    return scan2.scantwo_thresholds(_two_reps(spark, d), [0.1])


@query(f"SELECT quantile_cont(value, 0.95) FILTER (WHERE stat = 'one') AS main, quantile_cont(value, 0.95) FILTER (WHERE stat = 'int') AS heavy, quantile_cont(value, 0.95) FILTER (WHERE stat = 'fv1') - quantile_cont(value, 0.95) FILTER (WHERE stat = 'one') AS light FROM {_TWO}", with_cte=False)
def calc_penalties(spark, d):
    p = scan2.calc_penalties(_two_reps(spark, d))
    return spark.createDataFrame([(p["main"], p["heavy"], p["light"])], "main double, heavy double, light double")


@query(f"SELECT rep, trait, region, value AS maxlod FROM {_TWO} WHERE stat = 'one'", with_cte=False)
def scantwo_to_scanone_perms(spark, d):
    return scan2.scantwoperm_to_scanoneperm(_two_reps(spark, d))


@query("SELECT quantile_cont(o_totalprice, 0.025) AS lo, quantile_cont(o_totalprice, 0.975) AS hi FROM orders", with_cte=False)
def boot_interval(spark, d):
    return scan_results.boot_interval(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_totalprice").alias("pos")))


@query(_MR.format(g="g2") + ", th AS (SELECT unnest([0.01, 0.05, 0.1]) AS threshold), a AS (SELECT threshold, count(*) FILTER (WHERE lod > threshold) AS above FROM mr, th GROUP BY threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, above, CAST(above AS DOUBLE) AS above_permuted, CASE WHEN above > 0 THEN 1.0 END AS fdr FROM a")
def mqm_scan_fdr(spark, d):
    """Of a scan against two replicates that equal it."""
    s = scan.scan_mr(_f2(spark, d), ["price"])
    reps = s.withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2))))
    return scan_results.mqm_scan_fdr(s, reps, [0.01, 0.05, 0.1])


# Metadata and editing


@query("SELECT chr, chrtype, marker, ord, pos, pos_male FROM pmap")
def table_to_map(spark, d):
    return meta.table_to_map(part_map(spark, d).select("chr", "marker", "pos"))


@query("SELECT CASE WHEN k = 1 THEN name ELSE name || '.' || (k - 1) END AS name, s_suppkey FROM (SELECT 'n' || s_nationkey AS name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)", with_cte=False)
def make_unique(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"), "s_suppkey")
    return meta.make_unique(s, "name", "s_suppkey")


@query("SELECT ind, chr, marker, ord, g FROM g2 WHERE marker IN ('M1', 'M5')")
def pull_markers(spark, d):
    return meta.pull_markers(_f2(spark, d), spark.createDataFrame([("M1",), ("M5",)], "marker string")).geno


@query("SELECT chr, ord, marker FROM map")
def marker_names(spark, d):
    return meta.marker_names(_f2(spark, d))


@query("SELECT 'price' AS trait UNION ALL SELECT 'done'")
def phe_names(spark, d):
    return meta.phe_names(_f2(spark, d))


@query("SELECT CAST(n AS INT) AS k, chr FROM (VALUES (1, '1'), (2, '2')) t(n, chr)")
def chr_names(spark, d):
    return spark.createDataFrame(list(enumerate(meta.chr_names(_f2(spark, d)), 1)), "k int, chr string")


@query("SELECT o_orderkey, CAST(CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INT) AS sex FROM orders", with_cte=False)
def get_sex(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    raw = o.select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, " Male").when(F.col("o_custkey") % 3 == 1, "f").otherwise("?").alias("sex"))
    return meta.get_sex(raw)


@query("SELECT p.chr, p.pos, arg_min(m.marker, (abs(m.pos - p.pos), m.pos)) AS locus, arg_min(m.pos, (abs(m.pos - p.pos), m.pos)) AS locus_pos FROM places p JOIN pmap m ON m.chr = p.chr GROUP BY p.chr, p.pos")
def find_pseudomarker(spark, d):
    return meta.find_pseudomarker(part_map(spark, d).select("chr", F.col("marker").alias("locus"), "pos"), part_places(spark, d))


@query("SELECT ind, chr, marker, ord, g FROM g2")
def drop_null_markers(spark, d):
    """A marker that nobody is typed at comes and goes."""
    c = _f2(spark, d)
    return edit.drop_null_markers(edit.add_marker(c, c.geno.where("false").select("ind", "g"), "empty", "2", 50.0)).geno


@query("SELECT ind, chr, marker, ord, g FROM g2 WHERE marker <> 'M1' UNION ALL SELECT ind, chr, marker, ord, g FROM g2 WHERE marker = 'M1' AND g <> 2")
def drop_dup_markers(spark, d):
    """M1 is on both chromosomes, with other codes for heterozygotes: these conflict and go."""
    c = _f2(spark, d)
    again = c.geno.where("marker = 'M1'").select("ind", F.lit("2").alias("chr"), "marker", F.lit(9).alias("ord"), F.when(F.col("g") == 2, 3).otherwise(F.col("g")).cast("int").alias("g"))
    m = c.map.unionByName(c.map.where("marker = 'M1'").withColumns({"chr": F.lit("2"), "ord": F.lit(9), "pos": F.lit(99.0)}))
    return edit.drop_dup_markers(c.with_(map=m, geno=c.geno.unionByName(again))).geno


@query("SELECT ind, chr, marker, ord, g FROM g2 WHERE NOT (g = 2 AND ind % 5 = 0)")
def strip_partials(spark, d):
    c = _f2(spark, d)
    return edit.strip_partials(c.with_(geno=c.geno.withColumn("g", F.when((F.col("g") == 2) & (F.col("ind") % 5 == 0), 4).otherwise(F.col("g")).cast("int")))).geno


@query("SELECT marker, (pos + 3 * pos) / 2 AS pos, CAST(NULL AS DOUBLE) AS pos_male FROM pmap")
def convert_2_sex_averaged(spark, d):
    return edit.sex_averaged(part_map(spark, d).withColumn("pos_male", F.col("pos") * 3)).select("marker", "pos", "pos_male")


@query("SELECT marker, pos, pos AS pos_male FROM pmap")
def make_sex_specific(spark, d):
    return edit.sex_specific(part_map(spark, d)).select("marker", "pos", "pos_male")


@query("SELECT ind, chr, marker, CAST(CASE chr WHEN '1' THEN 5 - ord ELSE ord END AS INT) AS ord, g FROM g2")
def replace_map(spark, d):
    """With a map that runs the other way on the first chromosome."""
    c = _f2(spark, d)
    return edit.replace_map(c, c.map.withColumn("pos", F.when(F.col("chr") == "1", 90 - F.col("pos")).otherwise(F.col("pos")))).geno


@query("SELECT o_orderkey AS ind FROM orders WHERE o_custkey % 4 <> 0 AND o_custkey % 7 <> 0", with_cte=False)
def complete_cases(spark, d):
    c = _f2(spark, d)
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ind"), F.col("o_custkey").alias("k"))
    pheno = c.pheno.join(o, "ind").withColumn("y", F.when((F.col("trait") != "price") | (F.col("k") % 4 != 0), F.col("y"))).select(c.pheno.columns)
    covar = o.select("ind", F.lit("z").alias("name"), F.when(F.col("k") % 7 != 0, F.lit(1.0)).alias("value"))
    return edit.complete_cases(c.with_(pheno=pheno), ["price"], covar)


@query("SELECT ind, chr, marker, ord, CASE WHEN g = 1 THEN 1 ELSE 2 END AS g FROM g2 WHERE g = 1 OR g = (SELECT CASE WHEN count(*) FILTER (WHERE g = 3) >= count(*) FILTER (WHERE g = 2) THEN 3 ELSE 2 END FROM g2)")
def convert_2_risib(spark, d):
    return edit.convert_2_ril(_f2(spark, d), "risib").geno


@query("SELECT d, d / 100 AS r, d AS back FROM (SELECT DISTINCT l_quantity AS d FROM lineitem) WHERE d <= 50", with_cte=False)
def morgan_map_function(spark, d):
    from crossloom.functions import maps as M

    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("d")).distinct().where("d <= 50")
    r = M.mf_m(F.col("d"))
    return x.select("d", r.alias("r"), F.round(M.imf_m(r), 9).alias("back"))


@query("SELECT chr, pos, marker FROM pmap")
def plot_map(spark, d):
    return plots.map_table(part_map(spark, d))


# Joint probabilities, pairs in a model's context, partly known genotypes, tables behind plots


_JOINT = _BC_PROB + """, adj AS (SELECT ind, chr, k, l1, l2, j11 / s AS j11, j12 / s AS j12, j21 / s AS j21, j22 / s AS j22 FROM (SELECT *, j11 + j12 + j21 + j22 AS s FROM (SELECT fw.ind, fw.chr, fw.k, a.marker AS l1, l.marker AS l2, a1 * (1 - r) * e1 * b1 AS j11, a1 * r * e2 * b2 AS j12, a2 * r * e1 * b1 AS j21, a2 * (1 - r) * e2 * b2 AS j22
  FROM fw JOIN loci l ON l.ind = fw.ind AND l.chr = fw.chr AND l.ord = fw.k + 1 JOIN map a ON a.chr = fw.chr AND a.ord = fw.k JOIN bw ON bw.ind = fw.ind AND bw.chr = fw.chr AND bw.k = fw.k + 1, r))),
joint AS (WITH RECURSIVE h AS (SELECT ind, chr, k + 1 AS k, l1, l2, j11, j12, j21, j22 FROM adj
  UNION ALL SELECT h.ind, h.chr, h.k + 1, h.l1, n.l2, h.j11 * n.j11 / m1 + h.j12 * n.j21 / m2, h.j11 * n.j12 / m1 + h.j12 * n.j22 / m2, h.j21 * n.j11 / m1 + h.j22 * n.j21 / m2, h.j21 * n.j12 / m1 + h.j22 * n.j22 / m2 FROM (SELECT *, j11 + j21 AS m1, j12 + j22 AS m2 FROM h) h JOIN adj n ON n.ind = h.ind AND n.chr = h.chr AND n.k = h.k) SELECT * FROM h)"""


@query(_JOINT + " SELECT ind, chr, l1 AS locus1, l2 AS locus2, round(j11, 6) AS p11, round(j12, 6) AS p12, round(j21, 6) AS p21, round(j22, 6) AS p22 FROM joint")
def calc_pairprob(spark, d):
    p = hmm.calc_pairprob(_bc(spark, d))
    return p.select("ind", "chr", "locus1", "locus2", *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{n}") for k, n in enumerate((11, 12, 21, 22))))


_HK_PAIRS = "SELECT a.locus AS locus1, b.locus AS locus2, y, a.p2 AS x1, b.p2 AS x2, a.p2 * b.p2 AS x3 FROM prob a JOIN prob b ON a.ind = b.ind AND a.locus < b.locus JOIN pheno p ON p.ind = a.ind"


@query(_BC_PROB + f" SELECT locus1, locus2, {lod('r0', 'r3')} AS lod_full, {lod('r0', 'r2')} AS lod_add FROM ({nested(_HK_PAIRS, 'locus1, locus2', 3)})")
def add_pair(spark, d):
    rows = qtl.Model(_bc(spark, d), "price").add_pair(qtl.Qtl())
    return spark.createDataFrame([(x[2], x[5], float(x[6]), float(x[7])) for x in rows], "locus1 string, locus2 string, lod_full double, lod_add double")


@query(_BC_PROB + f" SELECT locus1, locus2, {lod('r0', 'r2')} AS lod FROM ({nested(_HK_PAIRS, 'locus1, locus2', 2)}) WHERE locus1 <= 'M4' AND locus2 >= 'M5'")
def scan_qtl_grid(spark, d):
    m = qtl.Model(_bc(spark, d), "price")
    rows = m.scan_qtl([m.all_loci(["1"]), m.all_loci(["2"])])
    return spark.createDataFrame([(a[2], b[2], float(x)) for a, b, x in rows], "locus1 string, locus2 string, lod double")


@query(""", n AS (SELECT marker, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE g = 1) / count(*) AS a, count(*) FILTER (WHERE g = 2) / count(*) AS b, count(*) FILTER (WHERE g = 3) / count(*) AS c FROM g2 GROUP BY marker),
s AS (SELECT *, 2 * n * (CASE WHEN a > 0 THEN a * ln(a / 0.25) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / 0.5) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / 0.25) ELSE 0 END) AS stat FROM n)
SELECT marker, a AS aa, b AS ab, c AS bb, stat, exp(-stat / 2) AS p FROM s""")
def geno_table_em(spark, d):
    return linkage.geno_table_em(_f2(spark, d))


@query(""", rf AS (SELECT m1, m2, b / n AS rf, CASE WHEN b > 0 THEN b * log10(b / n) ELSE 0 END + CASE WHEN b < n THEN (n - b) * log10(1 - b / n) ELSE 0 END + n * log10(2) AS lod FROM
(SELECT x.marker AS m1, y.marker AS m2, count(*) AS n, sum(CASE WHEN x.g <> y.g THEN 1.0 ELSE 0 END) AS b FROM g1 x JOIN g1 y ON x.ind = y.ind AND x.marker < y.marker GROUP BY x.marker, y.marker)),
z AS (SELECT a.chr AS c1, a.ord AS o1, b.chr AS c2, b.ord AS o2, least(12, greatest(0, -4 * (log2(rf) + 1))) AS low, least(12, lod) AS high FROM rf JOIN map a ON a.marker = m1 JOIN map b ON b.marker = m2)
SELECT c1 AS chr1, o1 AS ord1, c2 AS chr2, o2 AS ord2, low AS value FROM z UNION ALL SELECT c2, o2, c1, o1, high FROM z""")
def plot_rf(spark, d):
    c = _bc(spark, d)
    return plots.rf_table(linkage.est_rf(c), c.map)


@query(_MR.format(g="g2") + " SELECT trait, '1' AS own_chr, 12.0 AS own_pos, chr, pos, lod FROM mr WHERE lod >= 0.05")
def plot_cis_trans(spark, d):
    places = spark.createDataFrame([("price", "1", 12.0)], "name string, chr string, pos double")
    return plots.cis_trans_table(scan.scan_mr(_f2(spark, d), ["price"]), places, 0.05)


@query(_BC_PROB + f", h AS (SELECT chr, pos, locus, {lod('r0', 'r1')} AS lod FROM ({nested('SELECT chr, pos, locus, y, p2 AS x1 FROM prob JOIN pheno USING (ind)', 'chr, pos, locus', 1)})), e AS (SELECT locus, sign(regr_slope(y, p2 - p1)) AS s FROM prob JOIN pheno USING (ind) GROUP BY locus) SELECT chr, pos, lod * s AS lod FROM h JOIN e USING (locus)")
def plot_directed(spark, d):
    c = _bc(spark, d)
    return plots.directed_table(scan.scan_hk(c, "price"), effects.effect_scan(c, "price"))


@query("SELECT chr, chrtype, marker, ord, pos, pos_male FROM pmap WHERE chr = '2'")
def subset_map(spark, d):
    return meta.subset_map(part_map(spark, d), "2")


@query("SELECT ind, CAST(ind AS VARCHAR) AS id FROM pheno")
def get_id(spark, d):
    return meta.get_id(_f2(spark, d))


@query("SELECT 'price' AS trait, 2 AS number UNION ALL SELECT 'none', NULL")
def find_pheno(spark, d):
    return meta.find_pheno(_f2(spark, d), ["price", "none"])


@query("SELECT marker, CAST(substr(marker, 2) AS INT) AS number FROM map WHERE marker IN ('M3', 'M6')")
def find_marker_index(spark, d):
    return meta.find_marker_index(_f2(spark, d), spark.createDataFrame([("M3",), ("M6",)], "marker string"))


@query("SELECT p.chr, p.pos, arg_min(m.marker, (m.ord, m.marker)) AS marker FROM places p LEFT JOIN pmap m ON m.chr = p.chr AND m.pos = p.pos GROUP BY p.chr, p.pos")
def locate_marker(spark, d):
    return meta.locate_marker(part_map(spark, d), part_places(spark, d))


@query()
def ripple_lik(spark, d):
    return effects.ripple_lik(_bc(spark, d), "1", 3)


@query()
def order_markers(spark, d):
    return spark.createDataFrame(list(enumerate(effects.order_markers(_bc(spark, d), "1", 3), 1)), "k int, old int")


@query()
def scanone_perm_strata(spark, d):
    """Within strata, with a covariate that goes with the trait."""
    c = _f2(spark, d)
    return scan.scanone_perm(c, "price", 20, covar=_rank_covar(c), addcovar=["rank"], strata=c.individual.select("ind", "strata"))


@query()
def scantwo_perm_x(spark, d):
    c = _x(spark, d)
    return scan2.scantwo_perm(c, "price", 10, perm_xsp=True, strata=xchr.strata_by_sex(c))


@query()
def stepwise_qtl_x(spark, d):
    """Six penalties, sex in all models."""
    c = _x(spark, d)
    m = qtl.Model(c, "price", covar=xchr.x_covariates(c, ["sex"]), names=["sex"])
    best, terms, plod = m.stepwise(2, (0.1, 0.1, 0.3, 0.2, 0.2, 0.2))
    return spark.createDataFrame([(k, *x, qtl.format_formula(terms), float(plod)) for k, x in enumerate(best.loci, 1)], "q int, chr string, pos double, locus string, formula string, plod double")


# Whole tables of intercrosses, and the same oracles for queries of an earlier name


def _noisy(k: int) -> str:
    return f"a{k} / e{k} * b{k} * CASE WHEN g = {k} THEN 0.99 ELSE 0.005 END"


@query(f2_prob(10, 1e-12) + f""", typed AS (SELECT l.ind, l.chr, l.locus, g, {', '.join(f'{_noisy(k)} AS t{k}' for k in (1, 2, 3))} FROM loci l JOIN g2 x ON x.ind = l.ind AND x.marker = l.locus JOIN fw ON fw.ind = l.ind AND fw.chr = l.chr AND fw.k = l.k JOIN bw ON bw.ind = l.ind AND bw.chr = l.chr AND bw.k = l.k),
w AS (SELECT *, CASE g WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END / (t1 + t2 + t3) AS sure FROM typed)
SELECT ind, chr, locus AS marker, greatest(-12, log10(greatest(1 - sure, 0) / sure) + log10(99)) AS errorlod FROM w""")
def errorlod_intercross(spark, d):
    return hmm.calc_errorlod(_f2(spark, d))


_F2_PAIRS = _F2_TYPED + f", pa AS ({nested(_BOTH.format(x='a.u AS x1, a.v AS x2, b.u AS x3, b.v AS x4, a.u * b.u AS x5, a.u * b.v AS x6, a.v * b.u AS x7, a.v * b.v AS x8'), _PAIR_KEYS, 8)}), pb AS ({nested(_BOTH.format(x='b.u AS x1, b.v AS x2'), _PAIR_KEYS, 2)}), pairs AS (SELECT {_PAIR_KEYS}, 'price' AS trait, {lod('pa.r0', 'pa.r8').replace('n /', 'pa.n /')} AS lod_full, {lod('pa.r0', 'pa.r4').replace('n /', 'pa.n /')} AS lod_add, {lod('pa.r0', 'pa.r2').replace('n /', 'pa.n /')} AS lod_one1, {lod('pa.r0', 'pb.r2').replace('n /', 'pa.n /')} AS lod_one2 FROM pa JOIN pb USING ({_PAIR_KEYS}))"


@query(_F2_PAIRS + " SELECT * FROM pairs")
def scantwo_mr_intercross(spark, d):
    return scan2.scantwo_mr(_f2(spark, d), "price")


@query(_F2_PAIRS + _STATS + ", b AS (SELECT chr1, chr2, trait, arg_max(pos1, (lod_full, -pos1, -pos2)) AS pos1f, arg_max(pos2, (lod_full, -pos1, -pos2)) AS pos2f, arg_max(pos1, (lod_add, -pos1, -pos2)) AS pos1a, arg_max(pos2, (lod_add, -pos1, -pos2)) AS pos2a FROM pairs GROUP BY ALL) SELECT * FROM st JOIN b USING (chr1, chr2, trait)")
def summary_scantwo_intercross(spark, d):
    return scan2.summary_scantwo(scan2.scantwo_mr(_f2(spark, d), "price"))


def _with_p(term: str, df: int, rest: str) -> str:
    """P values have closed forms where the degrees of freedom of the numerator are even."""
    chi = "1 + h" + (" + h * h / 2" if df == 6 else "")
    f = "1 + a * (1 - x)" + (" + a * (a + 1) / 2 * (1 - x) ** 2" if df == 6 else "")
    inner = f"SELECT *, lod * ln(10) AS h, (n - 9) / 2.0 AS a, (n - 9) / (n - 9 + {df} * f) AS x FROM ({_dropped(term, df, rest).replace(' AS f FROM', ' AS f, ab.n AS n FROM')})"
    return f"SELECT term, df, lod, pvar, f, exp(-h) * ({chi}) AS p_chi2, x ** a * ({f}) AS p_f FROM ({inner})"


@query(f2_prob(10) + _DROP + " " + " UNION ALL ".join((_with_p("Q1", 6, "ba.r2"), _with_p("Q2", 6, "ab.r2"), _with_p("Q1:Q2", 4, "ab.r4"))))
def fit_qtl_whole(spark, d):
    c = _f2(spark, d)
    got = qtl.Model(c, "price").fit(qtl.make_qtl(c, ["1", "2"], [10.0, 0.0]), "y~Q1*Q2")
    return spark.createDataFrame(got["dropone"], "term string, df int, lod double, pvar double, f double, p_chi2 double, p_f double")


#: Earlier names of the same calls.
for _old, _new in {
    "calc_genoprob_f2": "calc_genoprob_grid", "argmax_geno": "viterbi_geno", "calc_errorlod": "errorlod_intercross", "est_rf_f2": "est_rf_intercross", "scanone_hk_f2": "scanone_hk_grid", "scanone_hk_covar": "scanone_hk_interactive",
    "scantwo_mr": "scantwo_mr_intercross", "summary_scantwo": "summary_scantwo_intercross", "fit_qtl": "fit_qtl_whole", "add_qtl": "add_qtl_scan", "cim": "cim_one",
}.items():
    QUERIES[_old], ORACLES[_old] = QUERIES[_new], ORACLES[_new]
    if _new in INEXACT:
        INEXACT[_old] = INEXACT[_new]
