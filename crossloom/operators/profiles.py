"""Traits grouped by their LOD profiles: agglomerative merges with heights, which are cut at a height or to a number of groups.

Loci are rows: a task adds up the products of all traits' LODs over its loci, so what reaches the driver is one number for each pair of traits, whatever the
number of loci. Merging goes along chains of nearest neighbours, which needs each distance a few times only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.operators.sums import TaskSums, added
from crossloom.runtime import prepare

METHODS = ("complete", "single", "average")


def trait_distances(scan: DataFrame, effects: DataFrame | None = None) -> tuple[list[str], np.ndarray]:
    """Traits in order of their names, and Euclidean distances of their profiles over the loci of ``scan`` (a missing LOD is 0). ``effects``
    (trait, locus, sign): LODs take these signs first."""
    prepare(scan.sparkSession)
    names = [r["trait"] for r in scan.select("trait").distinct().orderBy("trait").collect()]
    if effects is not None:
        scan = scan.join(effects.select("trait", "locus", "sign"), ["trait", "locus"], "left").withColumn("lod", F.col("lod") * F.coalesce("sign", F.lit(1.0)))
    place = {n: k for k, n in enumerate(names)}
    loci = scan.where("lod IS NOT NULL").groupBy("chr", "locus").agg(F.collect_list("trait").alias("t"), F.collect_list("lod").alias("v"))

    def task(batches):
        sums = TaskSums(1 << 62)
        for b in batches:
            x = np.zeros((len(b), len(names)))
            for row, (t, v) in enumerate(zip(b.column("t").to_pylist(), b.column("v").to_pylist(), strict=True)):
                x[row, [place[n] for n in t]] = v
            # Differences, not products: equal profiles are exactly 0 apart.
            for k in range(len(names)):
                sums.add((k,), ((x[:, [k]] - x) ** 2).sum(0))
        held = list(sums.rows())
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int32()), pa.array([v for _, v in held], pa.list_(pa.float64()))], names=["k", "s"])

    out = np.zeros((len(names), len(names)))
    for r in added(loci.select("t", "v").mapInArrow(task, "k int, s array<double>"), ["k"], "s").collect():
        out[r["k"]] = r["s"]
    return names, np.sqrt(out)


def merges(distance: np.ndarray, method: str = "complete") -> list[tuple[int, int, float, int]]:
    """(a, b, height, size) by height: a and b are -1, -2, ... for single items and 1, 2, ... for earlier merges, the smaller first."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    n = len(distance)
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, found = np.ones(n), np.ones(n, bool), [], []
    while len(found) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            at = chain[-1]
            row = np.where(alive, d[at], np.inf)
            near = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        found.append((a, b, float(d[a, b])))
        new = {"complete": np.maximum, "single": np.minimum}.get(method, lambda x, y, a=a, b=b: (size[a] * x + size[b] * y) / (size[a] + size[b]))(d[a], d[b])
        alive[b], size[a] = False, size[a] + size[b]
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
    # Chains find merges out of order: by height, items stand for the group they are in by then.
    group, count, out = {k: -k - 1 for k in range(n)}, {k: 1 for k in range(n)}, []
    top = list(range(n))

    def root(k):
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for step, k in enumerate(sorted(range(n - 1), key=lambda k: (found[k][2], k)), 1):
        a, b = root(found[k][0]), root(found[k][1])
        first, second = sorted((group[a], group[b]), key=lambda x: (x > 0, abs(x)))
        top[b] = a
        group[a], count[a] = step, count[a] + count[b]
        out.append((first, second, found[k][2], count[a]))
    return out


def groups(n: int, tree: list[tuple[int, int, float, int]], height: float | None = None, k: int | None = None) -> list[int]:
    """Group of each item, numbered from 1 in order of first items: merges up to ``height``, or as many as leave ``k`` groups."""
    most = n - k if k is not None else sum(h <= height for _, _, h, _ in tree)
    members: dict[int, list[int]] = {}
    label = list(range(n))
    for step, (a, b, _, _) in enumerate(tree[: max(0, most)], 1):
        own = [x for y in (a, b) for x in (members[y] if y > 0 else [-y - 1])]
        members[step] = own
        for x in own:
            label[x] = min(own)
    number = {x: j for j, x in enumerate(dict.fromkeys(label), 1)}
    return [number[x] for x in label]


def cluster_traits(scan: DataFrame, method: str = "complete", height: float | None = None, k: int | None = None, effects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(step, a, b, height, size) of the merges, and (trait, item, cluster) by a cut at ``height`` or to ``k`` groups (one of them, else all are one)."""
    names, d = trait_distances(scan, effects)
    tree = merges(d, method) if names else []
    label = groups(len(names), tree, height, 1 if height is None and k is None else k)
    spark = scan.sparkSession
    rows = spark.createDataFrame([(s, *x) for s, x in enumerate(tree, 1)], "step int, a int, b int, height double, size int")
    return rows, spark.createDataFrame([(t, j + 1, c) for j, (t, c) in enumerate(zip(names, label, strict=True))], "trait string, item int, cluster int")
