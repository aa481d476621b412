"""Operators of crosses: oracles on the sales tables, numpy versions, algebra."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from crossloom import queries as core
from crossloom.functions import chains, maps, stats
from crossloom.operators import edit, effects, graph, hmm, linkage, meta, mixture, qtl, scan, scan2, scan_results, sim

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v


@needs_data
@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    want = con.sql(core.ORACLES[name])
    at = [want.columns.index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(x), abs(y)), (a, b)


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def f2(spark):
    m = sim.sim_map(spark, [60.0, 40.0, 30.0], 6, seed=3)
    return sim.sim_cross(m, "f2", 150, [("1", 30.0, 1.0, 0.0)], missing=0.1, partial_missing=0.05, seed=4)


@pytest.fixture(scope="module")
def bc(spark):
    m = sim.sim_map(spark, [60.0, 40.0], 6, include_x=False, seed=5)
    return sim.sim_cross(m, "bc", 150, [("1", 30.0, 1.5), ("2", 10.0, 1.5)], missing=0.1, seed=6)


@pytest.mark.parametrize("kind", ["bc", "f2", "4way", "riself", "ri4self", "ri4sib", "ri8self", "ri8sib", "ri8selfIRIP1", "bgmagic16"])
def test_chains_are_stochastic_and_keep_their_start(kind):
    for r in (1e-9, 0.1, 0.4999):
        t, p = chains.transition(kind, r), chains.initial(kind)
        assert np.allclose(t.sum(1), 1, atol=1e-9) and np.allclose(p.sum(), 1)
        assert np.allclose(p @ t, p, atol=1e-9)


def test_generations_agree_with_f2():
    assert np.allclose(chains.transition("bcsft", 0.2, scheme=(0, 2)), chains.transition("f2", 0.2))


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 6, (5, 4))
    emit, init = chains.emissions("f2", codes, 0.01), chains.initial("f2")
    steps = [chains.transition("f2", r) for r in (0.1, 0.2, 0.05)]
    p = chains.posterior(emit, init, steps)
    for n in range(5):
        total = np.zeros((4, 3))
        for s in np.ndindex(3, 3, 3, 3):
            w = init[s[0]] * math.prod(emit[n, j, s[j]] for j in range(4)) * math.prod(steps[j][s[j], s[j + 1]] for j in range(3))
            for j in range(4):
                total[j, s[j]] += w
        assert np.allclose(p[n], total / total.sum(1, keepdims=True))
    best = chains.viterbi(emit, init, steps)
    assert best.shape == (5, 4) and best.min() >= 1


def test_map_functions_are_inverse():
    d = np.array([0.5, 5, 20, 60])
    for kind in ("haldane", "kosambi", "c-f"):
        assert np.allclose(maps.np_imf(maps.np_mf(d, kind), kind), d)
    assert np.allclose(maps.np_imf_stahl(maps.np_mf_stahl(d, 3, 0.2), 3, 0.2), d)
    assert [k for _, k in maps.grid(np.array([0.0, 7, 20]), 5)] == [0, -1, 1, -1, -1, 2]


def test_distributions():
    assert abs(stats.chi2_sf(3.841459, 1) - 0.05) < 1e-6 and abs(stats.f_sf(4.351244, 1, 20) - 0.05) < 1e-6
    assert abs(stats.t_sf2(2.085963, 20) - 0.05) < 1e-6 and abs(stats.f_quantile(0.95, 2, 30) - 3.31583) < 1e-4
    x = np.random.default_rng(1).normal(size=200)
    assert stats.shapiro_wilk(x)[1] > 0.05 > stats.shapiro_wilk(np.exp(x))[1]


def test_flip_twice_and_switch_twice(f2):
    once = edit.flip_order(f2, ["1", "2"])
    assert effects.compare_crosses(once, f2) and not effects.compare_crosses(edit.flip_order(once, ["1", "2"]), f2)
    names = [r.marker for r in f2.map.collect()]
    assert not effects.compare_crosses(edit.switch_alleles(edit.switch_alleles(f2, names), names), f2)


def test_probabilities_sum_to_one_and_scans_agree_with_numpy(f2):
    p = hmm.calc_genoprob(f2, step=10.0)
    assert p.where(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    y = {r.ind: r.y for r in f2.pheno.collect()}
    rows = p.where("chr = '1'").collect()
    got = {r.locus: r.lod for r in scan.scan_hk(f2, "phenotype", step=10.0).where("chr = '1'").collect()}
    for locus in got:
        mine = sorted((r.ind, r.p) for r in rows if r.locus == locus)
        x, v = np.array([q for _, q in mine]), np.array([y[i] for i, _ in mine])
        r1 = ((v - x @ np.linalg.lstsq(x, v, rcond=None)[0]) ** 2).sum()
        assert abs(got[locus] - len(v) / 2 * math.log10(((v - v.mean()) ** 2).sum() / r1)) < 1e-8
    top = max(got, key=got.get)
    assert got[top] > 3


@pytest.mark.parametrize("method", ["em", "imp", "ehk"])
def test_methods_find_the_locus(bc, method):
    rows = scan.scanone(bc, "phenotype", "normal", method).collect()
    hk = {r.locus: r.lod for r in scan.scan_hk(bc, "phenotype").collect()}
    assert all(r.lod >= 0 for r in rows) and max(abs(r.lod - hk[r.locus]) for r in rows) < 0.35 * max(hk.values()) + 0.5
    assert max(rows, key=lambda r: r.lod).chr in ("1", "2")


def test_binary_and_two_part_and_variance(bc):
    b = bc.with_(pheno=bc.pheno.withColumn("y", (F.col("y") > 0).cast("double")))
    hk = {r.locus: r.lod for r in scan.scan_binary(b, "phenotype", "hk").collect()}
    em = {r.locus: r.lod for r in scan.scan_binary(b, "phenotype", "em").collect()}
    assert max(abs(hk[k] - em[k]) for k in hk) < 1.0 and max(hk.values()) > 2
    spiked = bc.with_(pheno=bc.pheno.withColumn("y", F.least("y", F.lit(0.5))))
    for r in scan.scan_2part(spiked, "phenotype").collect():
        assert r.lod_p_mu >= max(r.lod_p, r.lod_mu) - 0.05
    assert effects.scanone_var(bc, "phenotype", maxit=6).where("lod_mean > 2").count() > 0


def test_permutations(bc, monkeypatch):
    n = 137
    assert sorted(scan._feistel(np.arange(n), n, 5)) == list(range(n))
    a = {r.rep: r.maxlod for r in scan.scanone_perm(bc, "phenotype", 8).collect()}
    monkeypatch.setattr(scan, "BROADCAST_PEOPLE", 0)
    b = {r.rep: r.maxlod for r in scan.scanone_perm(bc, "phenotype", 8).collect()}
    assert len(a) == 8 and all(abs(a[k] - b[k]) < 1e-8 for k in a)
    q = scan2.scantwo_perm
    monkeypatch.setattr(scan, "BROADCAST_PEOPLE", 10**6)
    t = q(bc, "phenotype", 4).collect()
    by = {(r.rep, r.stat): r.value for r in t}
    assert all(by[k, "full"] >= by[k, "add"] - 1e-9 for k in range(1, 5))


def test_pair_scan_against_numpy(bc):
    rows = scan2.scantwo_hk(bc, "phenotype").where("chr1 <> chr2").limit(5).collect()
    p = {(r.ind, r.locus): r.p for r in hmm.calc_genoprob(bc).collect()}
    y = {r.ind: r.y for r in bc.pheno.collect()}
    ids = sorted(y)
    v = np.array([y[i] for i in ids])
    for r in rows:
        a, b = np.array([p[i, r.locus1] for i in ids]), np.array([p[i, r.locus2] for i in ids])
        full = (a[:, :, None] * b[:, None, :]).reshape(len(v), -1)
        add = np.concatenate([a, b[:, 1:]], axis=1)
        for x, lod in ((full, r.lod_full), (add, r.lod_add), (a, r.lod_one1), (b, r.lod_one2)):
            res = ((v - x @ np.linalg.lstsq(x, v, rcond=None)[0]) ** 2).sum()
            assert abs(lod - len(v) / 2 * math.log10(((v - v.mean()) ** 2).sum() / res)) < 1e-6


def test_models(bc):
    m = qtl.Model(bc, "phenotype")
    q = qtl.make_qtl(bc, ["1", "2"], [30.0, 10.0])
    fit = m.fit(q, "y~Q1*Q2")
    assert fit["lod"] > 5 and [r[0] for r in fit["dropone"]] == ["Q1", "Q1:Q2", "Q2"] and 0 < fit["pvar"] < 100
    added = {x[2]: x[3] for x in m.add_qtl(qtl.Qtl())}
    hk = {r.locus: r.lod for r in scan.scan_hk(bc, "phenotype").collect()}
    assert all(abs(added[k] - hk[k]) < 1e-8 for k in hk)
    best, terms, plod = m.stepwise(3, (1.5, 2.0, 1.8), refine=True)
    assert {x[0] for x in best.loci} == {"1", "2"} and plod > 0
    assert qtl.count_terms(qtl.parse_formula("y~Q1*Q2+Q2*Q3+Q1*Q3")) == (3, 2, 1)
    assert qtl.format_formula(qtl.parse_formula("y~Q2*Q1")) == "y ~ Q1 + Q2 + Q1:Q2"
    assert qtl.is_symmetric(qtl.parse_formula("y~Q1+Q2"), "Q1", "Q2")
    assert qtl.cim(bc, "phenotype", 2).where("lod > 2").count() > 0
    assert effects.cofactor_scan(bc, "phenotype", ["D1M3", "D2M2"])[0].where("lod > 2").count() > 0


def test_intervals_and_arithmetic(bc):
    s = scan.scan_hk(bc, "phenotype", step=2.0)
    for r in scan_results.lod_interval(s).unionByName(scan_results.bayes_interval(s)).collect():
        assert r.lo <= r.peak <= r.hi
    zero = scan_results.arithmetic(scan_results.arithmetic(s, s), s, -1)
    assert scan_results.arithmetic(zero, s, -1).where(F.abs("lod") > 1e-9).count() == 0


def test_linkage_and_order(spark, bc, f2):
    rf = linkage.est_rf(bc)
    groups = {r.marker: r.lg for r in linkage.form_linkage_groups(bc.map, rf, 0.35, 3.0).collect()}
    assert len({groups[m] for m in groups if m.startswith("D1")} & {groups[m] for m in groups if m.startswith("D2")}) == 0
    em = {(r.m1, r.m2): r.rf for r in linkage.est_rf(f2).collect()}
    assert em["D1M1", "D1M2"] < 0.4
    even = sim.sim_cross(sim.sim_map(spark, [75.0], 6, include_x=False, eq_spacing=True), "bc", 150, seed=8)
    mixed = edit.switch_order(even, "1", [2, 1, 3, 4, 6, 5])
    order = effects.order_markers(mixed, "1", 4)
    found = [mixed.map.where(f"chr = '1' AND ord = {k}").first().marker for k in order]
    assert found in ([f"D1M{k}" for k in range(1, 7)], [f"D1M{k}" for k in range(6, 0, -1)])


def test_map_by_em(bc):
    one = meta.subset(bc, "2")
    new, ll = hmm.est_map(one, tol=1e-4, maxit=60)
    span = new.agg(F.max("pos") - F.min("pos")).first()[0]
    assert 20 < span < 70 and ll["2"] < 0


def test_errors_stand_out(bc):
    g = bc.geno.withColumn("g", F.when((F.col("ind") == 7) & (F.col("marker") == "D1M3"), 3 - F.col("g")).otherwise(F.col("g")))
    top = hmm.calc_errorlod(bc.with_(geno=g), 0.01).where("ind = 7 AND chr = '1'").collect()
    assert max(top, key=lambda r: r.errorlod).marker in ("D1M2", "D1M3", "D1M4") or not any(r.marker == "D1M3" for r in top)


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (200, 200), (None, 3), (102, 100)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == got[102] == 100 and got[200] == 200
    assert graph.connected_components(e.where("false")).count() == 0


def test_taxa():
    assert sim.all_partitions("ABC") == ["A|BC", "AB|C", "AC|B"] or len(sim.all_partitions("ABC")) == 3
    assert sim.qtl_by_partition(["AB", "BC", "CA"], "A|BC") == [1, 0, -1]
    assert sim.check_crosses(["AB", "BC"], "ABC") and not sim.check_crosses(["AB"], "ABC")


def test_augment_weights(bc):
    w = mixture.augment(bc).groupBy("ind", "chr").agg(F.sum("weight").alias("w"))
    assert w.where(F.abs(F.col("w") - 1) > 1e-9).count() == 0


def test_founders(spark, bc):
    from crossloom.operators import founders

    m = sim.sim_map(spark, [50.0], 20, include_x=False, seed=9)
    lines = sim.sim_cross(m, "ri4self", 20, seed=2)
    snps = sim.sim_founder_snps(m, 4, seed=3)
    seen = lines.with_(geno=sim.convert_mwril(lines, snps))
    got = founders.infer_founder_hap(seen, snps, 15).join(lines.geno.select("ind", "marker", F.round(F.log2("g") + 1).alias("f")), ["ind", "marker"])
    n = got.count()
    assert n > 100 and got.where("founder = f").count() > 0.8 * n
    o = spark.createDataFrame([(i, [2, 1]) for i in range(1, 151)], "ind long, founders array<int>")
    p = hmm.calc_genoprob(bc)
    twice = founders.reorder_prob(founders.reorder_prob(p, o), o)
    assert twice.join(p.withColumnRenamed("p", "q"), ["ind", "locus"]).where("p <> q").count() == 0
    v = hmm.argmax_geno(bc)
    assert founders.reorder_states(v, o).join(v.withColumnRenamed("g", "h"), ["ind", "locus"]).where("g + h <> 3").count() == 0


def test_x_chromosome(spark):
    from crossloom.operators import xchr

    m = sim.sim_map(spark, [40.0, 40.0], 5, include_x=True, seed=21)
    c = sim.sim_cross(m, "f2", 160, [("X", 20.0, 1.0)], seed=22)
    people = c.individual.withColumns({"sex": (F.col("ind") % 2).cast("int"), "pgm": (F.col("ind") % 4 > 1).cast("int")})
    c = c.with_(individual=people, pheno=c.pheno.withColumn("y", F.col("y") + 5 * (F.col("ind") % 2)))
    assert xchr.x_null_covariates(c) == ["sex", "reverse"]
    lods = xchr.scan_genome(c, "phenotype").collect()
    assert max(lods, key=lambda r: r.lod).chr == "X" and {r.chr for r in lods} == {"1", "X"}
    cov = c.individual.select("ind", F.lit("a").alias("name"), F.col("sex").cast("double").alias("value")).unionByName(c.individual.select("ind", F.lit("b").alias("name"), F.col("ind").cast("double").alias("value")))
    assert {r.name for r in xchr.drop_aliased(cov, c).select("name").distinct().collect()} == {"b"}
    assert set(xchr.region_lengths(c)) == {"A", "X"} and xchr.strata_by_sex(c).select("strata").distinct().count() == 3


def test_plot_tables(bc):
    from crossloom.operators import plots

    assert plots.histogram(bc.pheno, "y", 10).agg(F.sum("n")).first()[0] == 150
    assert plots.missing_table(bc).where("missing < 0 OR missing > 1").count() == 0
    s = scan.scan_hk(bc, "phenotype")
    assert plots.scan_table(s).where("x < 0").count() == 0
    two = s.unionByName(s.withColumns({"trait": F.lit("copy"), "lod": F.col("lod") * 2}))
    assert plots.trait_groups(two).select("group").distinct().count() == 1
    assert plots.pheno_by_geno(bc, "phenotype", "D1M1").count() > 100


def test_permuted_phenotypes(bc):
    from crossloom.operators import permute

    strata = bc.individual.select("ind", (F.col("ind") % 2).cast("string").alias("strata"))
    new = permute.permuted(bc, "phenotype", 1, strata=strata)
    a, b = ({r.ind: r.y for r in c.pheno.collect()} for c in (bc, new))
    for k in (0, 1):
        assert sorted(a[i] for i in a if i % 2 == k) == sorted(b[i] for i in b if i % 2 == k)
    assert a != b
    reps = permute.permute_scan(bc, "phenotype", lambda c, t: scan.scan_mr(c, [t]), 3)
    assert permute.replicate_maxima(reps, "phenotype").count() == 3
    z = [r.y for r in permute.permuted(bc, "phenotype", 1, simulate=True).pheno.collect()]
    assert abs(np.mean(z)) < 0.4 and 0.7 < np.std(z) < 1.3


def test_more_models(bc):
    b = bc.with_(pheno=bc.pheno.withColumn("y", (F.col("y") > 0).cast("double")))
    hk = {r.locus: r.lod for r in scan.scan_binary(b, "phenotype", "hk").collect()}
    m = qtl.Model(b, "phenotype")
    q = qtl.Qtl((next(x for x in m.all_loci() if x[2] == "D1M3"),))
    assert abs(m.fit_binary(q)["lod"] - hk["D1M3"]) < 0.01
    two = {(r.locus1, r.locus2): r for r in scan2.scantwo_imp(bc, "phenotype", 4).collect()}
    ref = {(r.locus1, r.locus2): r for r in scan2.scantwo_hk(bc, "phenotype").collect()}
    assert two.keys() == ref.keys() and all(abs(two[k].lod_full - ref[k].lod_full) < 0.4 * ref[k].lod_full + 1 for k in ref)
    cov = edit.form_marker_covar(bc, [("1", 30.0)])
    assert cov.count() == 150
    names = [r.name for r in cov.select("name").distinct().collect()]
    with_cov = scan.scan_hk(bc, "phenotype", covar=cov, addcovar=names).where("chr = '1'")
    assert with_cov.agg(F.min("lod")).first()[0] < 0.2
    p = hmm.calc_genoprob_special(bc)
    assert p.where(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    s = scan2.scantwo_hk(bc, "phenotype")
    moved = scan2.replace_map_pairs(s, bc.map, edit.shift_map(bc.map, 100.0))
    assert moved.where("pos1 < 99.9 OR pos2 < 99.9").count() == 0 and moved.count() == s.count()
    perms = scan2.scantwo_perm(bc, "phenotype", 3)
    assert scan2.scantwo_pvalues(scan2.summary_scantwo(s), perms).where("p_full BETWEEN 0 AND 1").count() == 3
    assert effects.scan_all(bc, lambda c, t: scan.scan_mr(c, [t])).count() == 12


def test_chromosome_splits(bc):
    rows = effects.all_chr_splits(bc, "2", tol=1e-3, maxit=15)
    assert len(rows) == 5 and all(x[2] > 0 for x in rows)


def test_running_totals(spark):
    from crossloom.operators import order

    x = spark.range(500).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    rows = sorted((r.k, r.v) for r in x.collect())
    got = {r.k: r.t for r in order.running_total(x, "k", "v", "t").collect()}
    assert [got[k] for k, _ in rows] == np.cumsum([v for _, v in rows]).tolist()
    assert {r.k: r.i for r in order.row_numbers(x, "k", "i").collect()} == {k: i for i, (k, _) in enumerate(rows)}
    assert order.row_numbers(x.where("false"), "k", "i").count() == 0


def test_unsettled_maps_are_reported(bc):
    with pytest.warns(UserWarning, match="est_map: not settled after 2 rounds: chromosomes 2"):
        hmm.est_map(meta.subset(bc, "2"), maxit=2)


def test_registered_map_is_settled(spark, monkeypatch):
    """The registered query leaves the operator's rounds and tolerance as they are."""
    got = []
    monkeypatch.setattr(core, "_bc", lambda s, d: None)
    monkeypatch.setattr(hmm, "est_map", lambda cross, **options: [got.append(options)])
    core.est_map(spark, "")
    assert got == [{}]
