import numpy as np
import pytest
from crossloom.operators import profiles


def plain(d, method):
    """Merge the two closest groups again and again."""
    group, heights, sets = {k: [k] for k in range(len(d))}, [], []
    how = {"complete": np.max, "single": np.min, "average": np.mean}[method]
    while len(group) > 1:
        h, a, b = min((how(d[np.ix_(group[a], group[b])]), a, b) for a in group for b in group if a < b)
        group[a] = group[a] + group.pop(b)
        heights.append(h)
        sets.append(frozenset(group[a]))
    return heights, sets


@pytest.mark.parametrize("method", profiles.METHODS)
def test_heights_equal_plain_merging(method):
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 40):
        x = r.normal(size=(n, 6))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        tree = profiles.merges(d, method)
        heights, sets = plain(d, method)
        assert np.allclose([h for _, _, h, _ in tree], heights) and len(tree) == n - 1
        own = {}
        for step, (a, b, _, size) in enumerate(tree, 1):
            own[step] = frozenset().union(*(own[y] if y > 0 else {-y - 1} for y in (a, b)))
            assert len(own[step]) == size
        assert set(own.values()) == set(sets)
    with pytest.raises(ValueError):
        profiles.merges(np.zeros((2, 2)), "other")


def test_equal_profiles_are_at_no_distance(spark):
    r = np.random.default_rng(1)
    base = r.random((3, 20))
    which = [0, 0, 1, 1, 2, 0]
    rows = [(str(1 + j % 2), float(j), j, f"l{j}", f"t{k}", float(base[w, j])) for k, w in enumerate(which) for j in range(20)]
    scan = spark.createDataFrame(rows, "chr string, pos double, ord int, locus string, trait string, lod double").repartition(3)
    names, d = profiles.trait_distances(scan)
    assert names == [f"t{k}" for k in range(6)] and np.allclose(d, np.sqrt(((base[which][:, None] - base[which][None]) ** 2).sum(2)))
    tree, cut = profiles.cluster_traits(scan, height=1e-9)
    assert [r.cluster for r in cut.orderBy("item").collect()] == [1, 1, 2, 2, 3, 1] and tree.where("height < 1e-9").count() == 3
    assert {r.cluster for r in profiles.cluster_traits(scan)[1].collect()} == {1}
    three = profiles.cluster_traits(scan, k=3)[1].orderBy("item").collect()
    assert [r.cluster for r in three] == [1, 1, 2, 2, 3, 1]
    sign = spark.createDataFrame([("t0", f"l{j}", -1.0) for j in range(20)], "trait string, locus string, sign double")
    assert profiles.trait_distances(scan, sign)[1][0, 1] > 1
    none = scan.where("false")
    assert profiles.cluster_traits(none)[1].count() == 0 and profiles.cluster_traits(none)[0].count() == 0
