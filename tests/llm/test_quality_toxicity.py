import numpy as np
from pyspark.sql import functions as F

from crossloom.llm import quality, toxicity


def labelled(spark):
    good = [(k, f"a calm report about topic{k % 17} and the weather in region{k % 5}", 1, 0) for k in range(120)]
    bad = [(1000 + k, f"buy buy buy $$$ now item{k % 9} $$$ !!! !!!", 0, 0) for k in range(60)]
    rude = [(2000 + k, f"a calm report about topic{k % 17} and that awfulword person{k % 7}", 1, 1) for k in range(60)]
    rows = good + bad + rude
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_ordinal_model_separates_grades(spark):
    docs, labels = labelled(spark)
    m = quality.fit(docs, quality.graded(labels))
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1]
    got = quality.score(docs, m).join(labels, "doc_id").groupBy(quality.graded(labels).columns and F.col("quality"), "toxic").agg(F.avg("expected_grade").alias("g")).collect()
    g = {(r.quality, r.toxic): r.g for r in got}
    assert g[0, 0] < g[1, 1] < g[1, 0]
    kept = quality.select_labelled(docs, labels)
    assert kept.where("doc_id BETWEEN 1000 AND 1999").count() == 0 and kept.where("doc_id < 1000").count() == 120


def test_quality_without_labels_keeps_all(spark, odd_docs, none):
    _, labels = labelled(spark)
    assert quality.select_labelled(odd_docs, labels.where("false")).count() == odd_docs.count()
    docs, _ = labelled(spark)
    m = quality.fit(docs, quality.graded(labels))
    out = quality.score(odd_docs, m)
    assert out.count() == odd_docs.count() and quality.score(none, m).count() == 0
    assert set(quality.select(odd_docs, m).columns) == set(odd_docs.columns)


def differences(value, p, step=1e-5):
    return np.array([(value(p + step * e)[0] - value(p - step * e)[0]) / (2 * step) for e in np.eye(len(p))])


def test_ordinal_gradient_against_differences():
    rng = np.random.default_rng(1)
    n, size = 60, 8
    x = quality.Sparse(np.repeat(np.arange(n), 3), rng.integers(0, size, 3 * n), rng.random(3 * n), n)
    grade = rng.integers(0, 3, n)
    value, _ = quality.objective(x, grade, size, 0.1)
    for _ in range(5):
        p = rng.normal(size=size + 2)
        assert np.abs(value(p)[1] - differences(value, p)).max() < 1e-7
    m = quality.fit_arrays(x, grade, size, ridge=0.1)
    p = m.tails(x.dot(m.weights.astype(float)))
    assert (p[:, 0] >= p[:, 1]).all()
    own = np.where(grade == 0, 1 - p[:, 0], np.where(grade == 1, p[:, 0] - p[:, 1], p[:, 1]))
    base = np.bincount(grade) / n
    assert np.log(own).sum() > np.log(base[grade]).sum()


def descended(loss, p, step):
    """A brute-force fit: each number by itself goes up or down while that helps, by ever smaller steps."""
    best = loss(p)
    while step > 1e-6:
        better = False
        for k in range(len(p)):
            for d in (step, -step):
                q = p.copy()
                q[k] += d
                if (v := loss(q)) < best - 1e-15:
                    p, best, better = q, v, True
        step = step if better else step / 2
    return p


def test_ordinal_fit_against_a_brute_force_fit():
    rng = np.random.default_rng(2)
    n = 80
    dense = rng.random((n, 3))
    grade = np.clip((dense @ [3.0, -2.0, 1.0] + rng.normal(size=n)).round(), 0, 2).astype(int)

    def loss(p):
        t = [p[3], p[3] + np.exp(p[4])]
        s = dense @ p[:3]
        tail = [np.ones(n), *(1 / (1 + np.exp(-(s - x))) for x in t), np.zeros(n)]
        own = np.array([tail[g][i] - tail[g + 1][i] for i, g in enumerate(grade)])
        return -np.log(own).sum() + 0.5 * (p[:3] @ p[:3])

    p = descended(loss, np.zeros(5), 0.5)
    m = quality.fit_arrays(quality.Sparse(np.repeat(np.arange(n), 3), np.tile(np.arange(3), n), dense.ravel(), n), grade, 3)
    assert np.abs(m.weights - p[:3]).max() < 0.02 and np.abs(m.thresholds - [p[3], p[3] + np.exp(p[4])]).max() < 0.02


def test_toxicity_gradient_and_fit_against_brute_force():
    rng = np.random.default_rng(3)
    n = 60
    sparse = lambda d: toxicity.Sparse(np.repeat(np.arange(len(d)), 3), np.tile(np.arange(3), len(d)), d.ravel(), len(d))
    dense, a, b = rng.random((n, 3)), rng.random((7, 3)), rng.random((7, 3))
    y = (dense @ [4.0, -3.0, 0.5] + rng.normal(size=n) > 0.5).astype(float)
    value = toxicity.objective(sparse(dense), y, sparse(a), sparse(b), 3, 1.0, 5.0)
    for _ in range(5):
        p = rng.normal(size=4)
        assert np.abs(value(p)[1] - differences(value, p)).max() < 1e-7
    scale = toxicity.strength(sparse(dense), y, 3)

    def loss(p):
        w = p[:3] / scale
        s = dense @ p[:3] + p[3]
        return (np.logaddexp(0, s) - y * s).sum() + 0.5 * (w @ w) + 2.5 * (((a - b) @ p[:3]) ** 2).sum()

    p = descended(loss, np.zeros(4), 0.5)
    w, bias = toxicity.weigh(sparse(dense), y, sparse(a), sparse(b), 3, 1.0, 5.0)
    assert np.abs(np.append(w, bias) - p).max() < 0.02


def test_every_feature_seen_has_a_weight(spark):
    """No cut: as many weights as the fitted texts have distinct features."""
    rows = [(k, " ".join(f"word{(k * 7 + j * j) % 4000}" for j in range(60)) + (" awfulword" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = {f for r in toxicity.features(docs).collect() for f in r.feature}
    m = toxicity.fit(docs, labels)
    assert len(seen) > 2000 and set(np.flatnonzero(m.weights)) == seen


def test_one_grade_only(spark):
    docs, labels = labelled(spark)
    bad, good = labels.withColumn("quality", F.lit(0)), labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)})
    assert quality.select_labelled(docs, bad).count() == 0
    assert quality.select_labelled(docs, good).count() == docs.count()
    assert quality.select_labelled(docs, labels.withColumn("quality", F.lit(None).cast("int"))).count() == docs.count()
    m = quality.fit(docs, quality.graded(bad))
    assert m.labelled and quality.score(docs, m).where("expected_grade <> 0").count() == 0
    rude = labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})
    m = quality.fit(docs, quality.graded(rude))
    got = quality.score(docs, m).select(quality.tail(m, 1).alias("a"), quality.tail(m, 2).alias("b")).distinct().collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0)]


def test_toxicity_learns_words_and_ignores_groups(spark, odd_docs, none):
    docs, labels = labelled(spark)
    m = toxicity.fit(docs, labels)
    s = toxicity.score(docs, m).join(labels, "doc_id").groupBy("toxic").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    by = {r.toxic: r for r in s}
    assert by[1].lo > 0.5 > by[0].hi
    x = toxicity.score(spark.createDataFrame([(1, "a calm report about muslim women in region1"), (2, "a calm report about christian men in region1")], "doc_id long, text string"), m).collect()
    assert all(r.predicted == 0 for r in x) and abs(x[0].score - x[1].score) < 0.05
    out = toxicity.score(odd_docs.select("doc_id", "text"), m)
    assert out.count() == odd_docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score(none.select("doc_id", "text"), m).count() == 0


def test_counterfactual_penalty_shrinks_group_weights(spark):
    """A group's name goes with toxic labels in the sample; the penalised model gives it less weight than one without penalty."""
    rows = []
    for k in range(300):
        bad = k % 3 == 0
        group = "muslim" if bad and k % 4 else "christian"
        rows.append((k, f"report on {group} people, topic{k % 7}" + (" with awfulword" if bad else ""), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    pair = spark.createDataFrame([(1, "report on muslim people, topic3"), (2, "report on christian people, topic3")], "doc_id long, text string")
    gap = []
    for penalty in (0.0, 5.0):
        m = toxicity.fit(docs, labels, penalty=penalty)
        s = {r.doc_id: r.score for r in toxicity.score(pair, m).collect()}
        gap.append(s[1] - s[2])
        assert penalty == 0 or max(s.values()) < 0.5
    assert abs(gap[1]) < gap[0] / 2
    assert toxicity.swapped("Muslim women") == "Christian men"


def test_held_out_follows_crc32(spark):
    rows = {r.id: r.h for r in spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert all(h == (toxicity.crc_mod(i, 5) == 0) for i, h in rows.items())


def test_no_labels_or_one_class(spark):
    docs, labels = labelled(spark)
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        m = toxicity.fit(docs, some)
        assert toxicity.score(docs, m).where("predicted = 1").count() == 0


def test_few_labels_and_repeated_ids(spark):
    docs, labels = labelled(spark)
    for n in range(1, 7):
        some = labels.where("doc_id IN (0, 1, 2) AND toxic = 0").limit(n - n // 2).unionByName(labels.where("doc_id IN (2000, 2001, 2002)").limit(n // 2))
        got = toxicity.score(docs, toxicity.fit(docs, some)).where("score BETWEEN 0 AND 1").count()
        assert got == docs.count()
        assert quality.score(docs, quality.fit(docs, quality.graded(some))).count() == docs.count()
    again = docs.unionByName(docs.where("doc_id < 50").withColumn("text", F.concat(F.lit("zz muslim women "), F.col("text"))))
    model = toxicity.fit(again, labels)
    rows = toxicity.features(again).where("other IS NOT NULL").collect()
    assert len(rows) == 50 and all(2 * len(set(r.feature) & set(r.other)) > len(r.feature) != 0 for r in rows)
    assert model.pairs == 0  # of each id the smaller text is fitted, and that one has no terms


def test_held_out_ranks(spark):
    """Texts of the given tables that the fit hasn't seen: toxic ones rank above others, good ones above junk."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        import pytest

        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    seen = ~toxicity.held_out(F.col("doc_id"))

    def auc(rows):
        s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        return (s[y == 1][:, None] > s[y == 0][None, :]).mean() + (s[y == 1][:, None] == s[y == 0][None, :]).mean() / 2

    tox = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, among=seen)).join(labels.where(~seen), "doc_id").where("toxic IS NOT NULL").select("score", "toxic").collect()
    model = quality.fit(docs, quality.graded(labels.where(seen)))
    good = quality.score(docs.select("doc_id", "text"), model).join(labels.where(~seen), "doc_id").where("quality IS NOT NULL").select(F.col("tails")[0], "quality").collect()
    assert auc(tox) > 0.9 and auc(good) > 0.9


def test_bounded_features(spark, monkeypatch):
    docs, labels = labelled(spark)
    from crossloom.llm import _labelled

    held = quality.features(docs.where("doc_id < 20")).withColumn("order", F.xxhash64("doc_id"))
    whole = _labelled.gathered(held, ["feature"])
    most = sum(len(x) for x in whole.column("feature").to_pylist()[:7])
    assert _labelled.gathered(held, ["feature"], most).to_pylist() == whole.to_pylist()[:7]
    assert _labelled.gathered(held, ["feature"], 0).num_rows == 0
