"""What only shows in larger tables: no rows for draws, groups of equal individuals, places and markers that meet by position."""

import math

import numpy as np
from pyspark.sql import functions as F

from crossloom.operators import edit, effects, hmm, meta, mixture, qtl, scan, scan2, sim
from crossloom.operators import locus_models as lm
from tests.test_more import left, small, table  # noqa: F401


def test_bootstraps_have_no_row_for_a_draw(small, monkeypatch):  # noqa: F811
    monkeypatch.setattr(scan, "BOOT_BLOCK", 50)
    monkeypatch.setattr(scan, "BOOT_REPS", 3)
    start = np.array([0, 40, 90, 120, 160])
    times = np.stack([np.concatenate([scan._block_draws(start, b, 1, r) for b in range(4)]) for r in range(1, 401)])
    assert (times.sum(1) == 160).all() and abs(times.var() - 1) < 0.05 and abs(times.mean(0) - 1).max() < 0.25
    ids, y, p = table(small)
    blocks = {r.ind: r.b for r in small.individual.select("ind", F.pmod(F.xxhash64("ind"), F.lit(4)).alias("b")).collect()}
    members = [[k for k, i in enumerate(ids) if blocks[i] == b] for b in range(4)]
    start = np.append(0, np.cumsum([len(x) for x in members]))
    boot = scan.scanone_boot(small, "phenotype", "1", 5, seed=3)
    assert "xplode(sequence" not in boot._jdf.queryExecution().toString()
    loci = {12.0 * k: p[f"D1M{k + 1}"] for k in range(4)}
    for r in boot.collect():
        drawn = np.concatenate([np.repeat(x, scan._block_draws(start, b, 3, r.rep)) for b, x in enumerate(members)]).astype(int)
        lods = {at: 80 * math.log10(left(y[drawn]) / left(y[drawn], q[drawn, 1:])) for at, q in loci.items()}
        assert r.pos == max(lods, key=lods.get) and abs(r.lod - lods[r.pos]) < 1e-8


def few_kinds(spark, n=3000, strata=2):
    """Two chromosomes of two markers: at most 81 sequences."""
    m = spark.createDataFrame([(c, "A", f"D{c}M{k}", k, 15.0 * (k - 1), None) for c in ("1", "2") for k in (1, 2)], "chr string, chrtype string, marker string, ord int, pos double, pos_male double")
    c = sim.sim_cross(m, "bc", n, [("1", 15.0, 1.0)], missing=0.1, seed=6)
    return c.with_(individual=c.individual.withColumn("strata", (F.col("ind") % strata).cast("string")))


def dealt_to_places(c, rep, strata, seed=1):
    """By hand: who (by number) goes to the place of whom, places ordered by stratum and sequence."""
    seq = {r.ind: (list(r.m), list(r.g)) for r in hmm.sequences(c).collect()}
    of = {r.ind: r.strata if strata else "" for r in c.individual.collect()}
    ids = sorted(seq, key=lambda i: (of[i], i))
    holders = sorted(seq, key=lambda i: (of[i], seq[i]))
    deal = scan.Dealing([sum(of[i] == s for i in ids) for s in sorted(set(of.values()))], seed)
    to = deal(np.arange(len(ids)), rep - 1)
    assert sorted(to) == list(range(len(ids))) and all(of[ids[k]] == of[holders[t]] for k, t in enumerate(to))
    return [(ids[k], holders[t]) for k, t in enumerate(to)]


def test_permutations_by_shared_sequences(spark, monkeypatch):
    c = few_kinds(spark)
    strata = c.individual.select("ind", "strata")
    covar = c.individual.select("ind", F.lit("z").alias("name"), (F.col("ind") % 7).cast("double").alias("value"))
    monkeypatch.setattr(scan, "BROADCAST_PEOPLE", 0)
    monkeypatch.setattr(scan, "KIND_ROWS", 100)
    monkeypatch.setattr(scan, "redealt", None)  # no replicate is shuffled
    got = {r.rep: r.maxlod for r in scan.scanone_perm(c, "phenotype", 3, covar=covar, addcovar=["z"], strata=strata).collect()}
    two = {(r.rep, r.stat): r.value for r in scan2.scantwo_perm(c, "phenotype", 3).collect()}
    ids, y, p = table(c)
    at = {i: k for k, i in enumerate(ids)}
    for rep in (1, 2, 3):
        pairs = dealt_to_places(c, rep, True)
        who, whose = ([at[x[k]] for x in pairs] for k in (0, 1))
        z = np.array([ids[k] % 7.0 for k in who])
        want = max(1500 * math.log10(left(y[who], z) / left(y[who], z, q[whose, 1:])) for q in p.values())
        assert abs(want - got[rep]) < 1e-8
        who, whose = ([at[x[k]] for x in dealt_to_places(c, rep, False)] for k in (0, 1))
        want = max(1500 * math.log10(left(y[who]) / left(y[who], q[whose, 1:])) for q in p.values())
        assert abs(want - two[rep, "one"]) < 1e-8 and two[rep, "full"] >= two[rep, "add"] >= two[rep, "one"] - 1e-9


def test_places_meet_their_neighbours_only(spark):
    loci = [("1", f"A{k:02d}", 3.0 * k) for k in range(8)] + [("1", "A00b", 0.0), ("2", "B", 5.0)]
    at = [("1", x) for x in (-4.0, 0.0, 1.5, 1.6, 10.4, 10.5, 10.6, 99.0, 1.5)] + [("2", 1.0), ("3", 1.0)]
    got = meta.find_pseudomarker(spark.createDataFrame(loci, "chr string, locus string, pos double"), spark.createDataFrame(at, "chr string, pos double"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = {(c, p): min((abs(q - p), q, n) for d, n, q in loci if d == c) for c, p in at if c != "3"}
    assert {(r.chr, r.pos): (abs(r.locus_pos - r.pos), r.locus_pos, r.locus) for r in got.collect()} == want and got.count() == 9


def test_markers_are_at_exactly_a_place(spark):
    m = spark.createDataFrame([("1", 1, "a", 3 * 0.05), ("1", 2, "b", 2.0), ("1", 3, "c", 2.0)], "chr string, ord int, marker string, pos double")
    at = spark.createDataFrame([("1", 0.15), ("1", 3 * 0.05), ("1", 2.0), ("2", 2.0)], "chr string, pos double")
    run = lambda *tol: {(r.chr, r.pos): r.marker for r in meta.locate_marker(m, at, *tol).collect()}
    assert run() == {("1", 0.15): None, ("1", 3 * 0.05): "a", ("1", 2.0): "b", ("2", 2.0): None}
    assert run(1e-8)["1", 0.15] == "a" and run(1e-8)["2", 2.0] is None


def test_models_count_individuals_that_are_alike(spark, monkeypatch):
    c = few_kinds(spark)
    c = c.with_(pheno=c.pheno.unionByName(c.pheno.select("ind", F.lit("b").alias("trait"), (F.col("y") > 0).cast("double").alias("y"))))
    seen = []
    store = lm.materialise
    monkeypatch.setattr(lm, "materialise", lambda df, name: (seen.append((name, df.count())), store(df, name))[1])
    one = {r.locus: r.lod for r in lm.scanone_model(c, "b", "em", True).collect()}
    assert dict(seen)["people"] <= 162
    assert all(abs(one[r.locus] - r.lod) < 2e-3 for r in scan.scan_binary(c, "b", "em", tol=1e-7, maxit=1000).collect())
    monkeypatch.setattr(scan, "BROADCAST_PEOPLE", 0)
    monkeypatch.setattr(scan, "redealt", None)
    two = {(r.rep, r.stat): r.value for r in lm.scantwo_model_perm(c, "b", 2, "hk", True).collect()}
    assert dict(seen)["people"] <= 2 * 162
    for rep in (1, 2):
        to = spark.createDataFrame(dealt_to_places(c, rep, False), "ind long, whose long")
        dealt = c.pheno.where("trait = 'b'").join(to, "ind").select(F.col("whose").alias("ind"), "trait", "y")
        want = max(r.lod for r in lm.scanone_model(c.with_(pheno=dealt), "b", "hk", True).collect())
        assert abs(two[rep, "one"] - want) < 1e-3


def test_maps_count_sequences_that_are_alike(spark, monkeypatch):
    c = few_kinds(spark)
    seen, store = [], hmm.materialise
    monkeypatch.setattr(hmm, "materialise", lambda df, name: (seen.append(df.count()), store(df, name))[1])
    m, ll = hmm.est_map(c, maxit=40)
    assert max(seen) <= 81 and abs({r.marker: r.pos for r in m.collect()}["D1M2"] - 15) < 3 and ll["1"] < 0


def test_normal_mixtures_are_permuted_by_shared_sequences(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y, k = rng.dirichlet(np.ones(4), 7), rng.normal(1e5, 2e4, 500), rng.integers(0, 7, 500)
    family = lm.Family(False, "em")
    for maps in (np.eye(4), np.array([[1.0, 0, 0], [1, 0, 1], [0, 1, 0], [0, 1, 1]])):
        for state in (None, np.append(rng.normal(6e4, 2e4, maps.shape[1]), 3e8), np.append(rng.normal(1e5, 1e4, maps.shape[1]), 5.0)):
            want = family.equations(x[k], maps, y, np.ones((500, 1)), np.zeros((500, 0)), state)
            assert np.allclose(family.kind_equations(x, maps, y, k, state), want, rtol=1e-9)
    c = few_kinds(spark)
    monkeypatch.setattr(scan, "BROADCAST_PEOPLE", 0)
    monkeypatch.setattr(scan, "KIND_ROWS", 700)
    monkeypatch.setattr(lm, "SLICE", 300)
    monkeypatch.setattr(scan, "redealt", None)  # no replicate is shuffled
    got = {r.rep: r.maxlod for r in lm.scanone_model_perm(c, "phenotype", 2, tol=1e-6).collect()}
    for rep in (1, 2):
        to = spark.createDataFrame(dealt_to_places(c, rep, False), "ind long, whose long")
        dealt = c.pheno.where("trait = 'phenotype'").join(to, "ind").select(F.col("whose").alias("ind"), "trait", "y")
        assert abs(got[rep] - max(r.lod for r in lm.scanone_model(c.with_(pheno=dealt), "phenotype", tol=1e-6).collect())) < 1e-5


def test_iterated_scans_count_individuals_that_are_alike(spark, monkeypatch):
    c = few_kinds(spark, 400)
    c = c.with_(pheno=c.pheno.withColumn("y", F.least(F.round("y", 1), F.lit(1.0))))
    copies = spark.range(1, 4).withColumnRenamed("id", "copy")
    again = lambda df: df.crossJoin(copies).withColumn("ind", F.col("ind") * 10 + F.col("copy")).drop("copy")
    three = c.with_(geno=again(c.geno), pheno=again(c.pheno), individual=again(c.individual))
    seen, store = [], scan.materialise
    monkeypatch.setattr(scan, "materialise", lambda df, name: (seen.append(df.count()), store(df, name))[1])
    for fn in (lambda c, n: scan.scan_2part(c, "phenotype", tol=n * 1e-7), lambda c, n: effects.scanone_var(c, "phenotype", 60, 1e-13), lambda c, n: scan.scan_em(c, "phenotype", tol=n * 1e-8)):
        one, all_ = ({r.locus: r.asDict() for r in fn(x, n).collect()} for x, n in ((c, 1), (three, 3)))
        assert max(seen) <= 800  # rows of two chromosomes
        for locus, r in one.items():
            assert all(abs(3 * r[k] - all_[locus][k]) < 0.02 for k in r if k.startswith("lod"))


def test_no_genotypes_are_sorted_by_marker(spark):
    """a marker's genotypes aren't sent to one task."""
    c = edit.add_marker(few_kinds(spark, 60), few_kinds(spark, 60).geno.where("false").select("ind", "g"), "empty", "2", 50.0)
    for df in (edit.drop_null_markers(c).geno, hmm.sequences(c)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [marker" in plan and "SortMergeJoin [marker" not in plan.split("LeftAnti")[0]
    assert edit.drop_null_markers(c).geno.select("marker").distinct().count() == 4


def test_regressions_read_sequences_not_individuals(spark, monkeypatch):
    c = few_kinds(spark, 500)
    model = qtl.Model(c, "phenotype")
    assert model.kinds.count() <= 81 and model.n == 500 and "table" not in vars(model)
    ids, y, p = table(c)
    lod = model.scan_lods([], frozenset([frozenset(["Q1"])]), [("1", 15.0, "D1M2")])[0][0]
    assert abs(lod - 250 * math.log10(left(y) / left(y, p["D1M2"][:, 1:]))) < 1e-8
    assert scan2.kinds(c, "phenotype").count() <= 81
    two = {(r.locus1, r.locus2): r for r in scan2.scantwo_hk(c, "phenotype").collect()}
    assert abs(two["D1M1", "D2M1"].lod_add - 250 * math.log10(left(y) / left(y, np.column_stack([p["D1M1"][:, 1:], p["D2M1"][:, 1:]])))) < 1e-8


def test_equal_codes_are_augmented_once(spark):
    kept, made = mixture._Kept(), []
    rows = np.array([[1, 0], [2, 1], [1, 0], [1, 0]])
    found = kept.all(rows, lambda i: made.append(i) or (np.ones(1 + i) / (1 + i), False, np.tile(rows[i] + 1, (1 + i, 1))))
    assert made == [0, 1] and found[2] is found[0]
    got = mixture._copies(np.array([7, 8, 9, 10]), "1", found).to_pylist()
    assert [(r["ind"], r["copy"], r["weight"], r["g"]) for r in got] == [(7, 1, 1.0, [2, 1]), (8, 1, 0.5, [3, 2]), (8, 2, 0.5, [3, 2]), (9, 1, 1.0, [2, 1]), (10, 1, 1.0, [2, 1])]
    c = few_kinds(spark, 500)
    c = c.with_(pheno=c.pheno.withColumn("y", F.round("y")))
    g = mixture.genome(c, "phenotype")
    assert g.n == 500 and g.alike.count() < 400 and g.rows.count() == 500
