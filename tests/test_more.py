"""Permutations with strata and covariates, X penalties, pairs in a model's context, orders, joint probabilities, small helpers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossloom.operators import edit, effects, hmm, linkage, meta, plots, qtl, scan, scan2, scan_results, sim, xchr
from crossloom.operators.sums import TaskSums, added


@pytest.fixture(scope="module")
def small(spark):
    rows = [(c, "X" if c == "3" else "A", f"D{c}M{k}", k, 12.0 * (k - 1), None) for c in ("1", "2", "3") for k in range(1, 5)]
    m = spark.createDataFrame(rows, "chr string, chrtype string, marker string, ord int, pos double, pos_male double")
    c = sim.sim_cross(m.withColumn("chrtype", F.lit("A")), "bc", 160, [("1", 12.0, 1.4), ("3", 24.0, 1.2)], missing=0.05, seed=4)
    sex = (F.col("ind") % 2).cast("int")
    return c.with_(map=m, individual=c.individual.withColumn("sex", sex))


def table(c, trait="phenotype"):
    y = {r.ind: r.y for r in c.pheno.where(F.col("trait") == trait).collect()}
    ids = sorted(y)
    p = {}
    for r in hmm.calc_genoprob(c).collect():
        p.setdefault(r.locus, {})[r.ind] = r.p
    return ids, np.array([y[i] for i in ids]), {k: np.array([v[i] for i in ids]) for k, v in p.items()}


def left(y, *x):
    x = np.column_stack([np.ones(len(y)), *x])
    return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()


def test_permutations_with_covariates_and_strata(small, monkeypatch):
    covar = small.individual.select("ind", F.lit("z").alias("name"), (F.col("ind") % 7).cast("double").alias("value"))
    strata = small.individual.select("ind", F.col("sex").cast("string").alias("strata"))
    run = lambda: {r.rep: r.maxlod for r in scan.scanone_perm(small, "phenotype", 3, covar=covar, addcovar=["z"], strata=strata).collect()}
    got = run()
    ids, y, p = table(small)
    by = sorted(range(len(ids)), key=lambda k: (str(ids[k] % 2), ids[k]))
    i = np.empty(len(ids), int)
    i[by] = np.arange(len(ids))
    z, ys = np.array([x % 7.0 for x in ids]), y[by]
    zs = z[by]
    deal = scan.Dealing([sum(x % 2 == 0 for x in ids), sum(x % 2 for x in ids)], 1)
    for rep in (1, 2, 3):
        to = deal(i, rep - 1)
        assert sorted(to) == list(range(len(ids))) and all((ids[by[t]] - ids[k]) % 2 == 0 for k, t in enumerate(to))
        yy, zz = ys[to], zs[to]
        want = max(len(y) / 2 * math.log10(left(yy, zz) / left(yy, zz, q[:, 1:])) for q in p.values())
        assert abs(want - got[rep]) < 1e-8
    monkeypatch.setattr(scan, "BROADCAST_PEOPLE", 0)
    again = run()
    assert all(abs(again[k] - v) < 1e-8 for k, v in got.items())


def test_pair_permutations_by_region(small, monkeypatch):
    run = lambda: {(r.rep, r.region, r.stat): r.value for r in scan2.scantwo_perm(small, "phenotype", 3, perm_xsp=True, strata=xchr.strata_by_sex(small)).collect()}
    got = run()
    assert {k[1] for k in got} == {"AA", "AX", "XX"} and len(got) == 3 * 3 * 6
    monkeypatch.setattr(scan, "BROADCAST_PEOPLE", 0)
    again = run()
    assert all(abs(again[k] - v) < 1e-8 for k, v in got.items())
    perms = small.map.sparkSession.createDataFrame([(r, "phenotype", g, s, v) for (r, g, s), v in got.items()], "rep int, trait string, region string, stat string, value double")
    pen = scan2.calc_penalties_x(perms, 0.3)
    assert list(pen) == ["mainA", "mainX", "intH", "intL", "intAX", "intXX"] and all(math.isfinite(v) for v in pen.values())
    with pytest.raises(ValueError):
        scan2.calc_penalties_x(perms.where("region = 'AA'"))


def test_terms_and_penalties_with_x():
    f = qtl.parse_formula
    assert qtl.count_terms_x(f("y~Q1+Q2+Q3"), {"Q3"}) == (2, 1, 0, 0, 0, 0)
    assert qtl.count_terms_x(f("y~Q1*Q2+Q2*Q3+Q1*Q3"), {"Q3"}) == (2, 1, 0, 1, 2, 0)
    assert qtl.count_terms_x(f("y~Q1*Q2+Q2*Q3+Q1*Q3"), set()) == (3, 0, 2, 1, 0, 0)
    assert qtl.count_terms_x(f("y~Q1*Q2+Q3*Q4"), {"Q3", "Q4"}) == (2, 2, 0, 1, 0, 1)
    assert qtl.calc_plod_x(9, f("y~Q1*Q2"), (1, 2, 9, 9, 3, 9), {"Q2"}) == 3
    assert qtl.calc_plod_x(9, f("y~Q1+Q2"), (1, math.inf, 9, 9, 3, 9), {"Q2"}) == -math.inf


def test_stepwise_with_x(small):
    names = xchr.x_null_covariates(small)
    assert names == ["sex"]
    m = qtl.Model(small, "phenotype", covar=xchr.x_covariates(small, names), names=names)
    best, terms, plod = m.stepwise(2, (2.0, 2.0, 4.0, 3.0, 3.0, 3.0), refine=False)
    assert {x[0] for x in best.loci} == {"1", "3"} and frozenset(["sex"]) in terms and plod > 0
    none = m.stepwise(2, (2.0, math.inf, 4.0, 3.0, 3.0, 3.0), refine=False)
    assert {x[0] for x in none[0].loci} <= {"1", "2"}
    again = m.stepwise(2, (2.0, 2.0, 4.0, 3.0, 3.0, 3.0), refine=False, start=(best, terms))
    assert again[2] == pytest.approx(plod)
    with pytest.raises(ValueError):
        m.check_start(best, qtl.parse_formula("y~Q1+Q9"))


def test_pairs_and_grids_in_context(small):
    ids, y, p = table(small)
    m = qtl.Model(small, "phenotype")
    base = qtl.make_qtl(small, ["1"], [12.0])
    q = p["D1M2"][:, 1:]
    rows = m.add_pair(base, None, ["2", "3"])
    assert len(rows) == 8 * 7 // 2
    for r in rows[::5]:
        a, b = p[r[2]][:, 1:], p[r[5]][:, 1:]
        lod = lambda *x: len(y) / 2 * math.log10(left(y, q) / left(y, q, *x))  # noqa: E731, B023
        assert abs(r[6] - lod(a, b, a * b)) < 1e-8 and abs(r[7] - lod(a, b)) < 1e-8
    loci = [m.all_loci(["1"]), m.all_loci(["3"])]
    for x in m.scan_qtl(loci)[::3]:
        assert abs(x[2] - len(y) / 2 * math.log10(left(y) / left(y, p[x[0][2]][:, 1:], p[x[1][2]][:, 1:]))) < 1e-8


def test_orders(small):
    right = effects.order_markers(small, "1")
    assert right == [1, 2, 3, 4]
    mixed = edit.switch_order(small, "1", [3, 1, 4, 2])
    names = [r.marker for r in mixed.map.where("chr = '1'").orderBy("ord").collect()]
    for window in (2, 7):
        got = [names[k - 1] for k in effects.order_markers(mixed, "1", window)]
        assert got in ([f"D1M{k}" for k in (1, 2, 3, 4)], [f"D1M{k}" for k in (4, 3, 2, 1)])
    rip = {tuple(r.ord): r for r in effects.ripple_lik(small, "1", 3).collect()}
    assert max(rip, key=lambda o: rip[o].lod) == (1, 2, 3, 4) and rip[1, 2, 3, 4].lod == 0
    new, ll = hmm.est_map(meta.subset(small, "1"))
    span = new.agg(F.max("pos") - F.min("pos")).first()[0]
    assert abs(rip[1, 2, 3, 4].length - span) < 1e-3 * span
    other = hmm.est_map(meta.subset(edit.switch_order(small, "1", [2, 1, 3, 4]), "1"))[1]
    assert abs(rip[2, 1, 3, 4].lod - (other["1"] - ll["1"])) < 1e-3
    s = effects.summary_ripple(effects.ripple_count(small, "1", 3), 2).collect()
    assert len(s) == 3 and sum(r.initial for r in s) == 1


def test_joint_probabilities_have_the_right_margins(small):
    one = {(r.ind, r.locus): np.array(r.p) for r in hmm.calc_genoprob(small).collect()}
    rows = hmm.calc_pairprob(small).collect()
    assert len(rows) == 160 * 3 * 6
    for r in rows[::37]:
        x = np.array(r.p).reshape(2, 2)
        assert np.allclose(x.sum(1), one[r.ind, r.locus1]) and np.allclose(x.sum(0), one[r.ind, r.locus2])


def test_partly_known_genotypes(spark, small):
    c = small.with_(crosstype="f2", geno=small.geno.withColumn("g", F.when(F.col("ind") % 4 == 0, 4).when(F.col("ind") % 4 == 1, 3).otherwise(F.col("g")).cast("int")))
    for r in linkage.geno_table_em(c).collect():
        assert abs(r.aa + r.ab + r.bb - 1) < 1e-9 and 0 <= r.p <= 1 and r.stat >= 0
    done = edit.convert_2_bcsft(small, 1, 0)
    assert done.crosstype == "bcsft" and done.scheme == (1, 0)


def test_sums_by_task(spark):
    sums = TaskSums(most=5)
    for k in range(4):
        sums.add((k % 2,), np.ones(2), np.full(1, k))
    assert sums.full and sorted((k, a.tolist(), b.tolist()) for k, a, b in sums.rows()) == [(0, [2, 2], [2]), (1, [2, 2], [4])]
    df = spark.createDataFrame([("a", 1, [1.0, 2.0], [5.0]), ("a", 1, [3.0, 4.0], [6.0]), ("b", 1, [1.0, 1.0], [1.0])], "chr string, k int, a array<double>, b array<double>")
    got = {r.chr: (r.a, r.b) for r in added(df, ["chr", "k"], "a", "b").collect()}
    assert got == {"a": ([4, 6], [11]), "b": ([1, 1], [1])}


def test_helpers(spark, small):
    assert [r.chr for r in meta.subset_map(small.map, "-2").select("chr").distinct().orderBy("chr").collect()] == ["1", "3"]
    assert {r.ind for r in meta.get_id(small).where("id IS NOT NULL").collect()} == {r.ind for r in small.individual.collect()}
    assert {r.trait: r.number for r in meta.find_pheno(small, ["phenotype", "none"]).collect()} == {"phenotype": 1, "none": None}
    ask = spark.createDataFrame([("D2M3",), ("none",)], "marker string")
    assert {r.marker: r.number for r in meta.find_marker_index(small, ask).collect()} == {"D2M3": 7, "none": None}
    at = spark.createDataFrame([("1", 12.0), ("1", 13.0)], "chr string, pos double")
    assert {r.pos: r.marker for r in meta.locate_marker(small.map, at).collect()} == {12.0: "D1M2", 13.0: None}
    assert meta.round_text(-0.0001, 2) == "0.00" and meta.round_text(-1.25, 1) in ("-1.2", "-1.3")
    text = meta.describe(scan_results.max_scanone(scan.scan_hk(meta.subset(small, "1"), "phenotype")))
    assert "D1M2" in text and len(text.splitlines()) == 2
    rf = linkage.est_rf(small)
    assert plots.rf_table(rf, small.map).count() == 12 * 11
    lod = hmm.calc_errorlod(small)
    assert plots.errorlod_table(lod).where("level < 0 OR level > 3").count() == 0
    s = scan.scan_hk(small, "phenotype")
    e = effects.effect_scan(small, "phenotype")
    assert plots.directed_table(s, e).where("abs(lod) > 2").count() > 0
    places = spark.createDataFrame([("phenotype", "1", 10.0)], "name string, chr string, pos double")
    assert plots.cis_trans_table(s, places, 2.0).where("own_chr = '1'").count() > 0


def test_bootstraps_draw_as_many_as_there_are(small):
    b = scan.scanone_boot(meta.subset(small, "1"), "phenotype", "1", 6).collect()
    assert len(b) == 6 and all(r.pos in (0, 12, 24, 36) and r.lod >= 0 for r in b) and len({r.lod for r in b}) > 1


def test_written_crosses_are_read_by_name(spark, small, tmp_path):
    from crossloom.sources.readers import read_cross
    from crossloom.sources.writers import write_cross

    c = small.with_(map=small.map.withColumn("chrtype", F.lit("A")))
    write_cross(c, "csv", str(tmp_path / "c"))
    back = read_cross(spark, "csv", str(tmp_path / "c"))
    assert back.geno.count() == c.geno.count() and len(list(itertools.islice(back.map.collect(), 99))) == 12
