"""Forward selection of markers as covariates, with all columns of a marker at once.

One pass over individuals sums the products of all markers' columns, a block of markers at a time, into a table with a row for each marker.
Selection is a pivoted Cholesky factorisation of that matrix, of which it reads the diagonal once and then the row of each marker it takes: no other pass, and never the whole matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.functions import chains
from crossloom.model import Cross
from crossloom.operators.hmm import codes, tracks
from crossloom.operators.scan2 import people
from crossloom.operators.sums import TaskSums, added
from crossloom.runtime import materialise, prepare

#: Markers of a block.
BLOCK = 64


def marker_columns(p: np.ndarray, dominance: bool = True) -> np.ndarray:
    """(n, loci, 1 or 2): the additive code (expected copies of the second allele less one, or the share of the second genotype), and heterozygosity of an
    intercross."""
    if p.shape[2] == 3:
        add = p[:, :, 2] - p[:, :, 0]
        return np.stack([add, p[:, :, 1]], axis=2) if dominance else add[:, :, None]
    return p[:, :, 1:]


def products(cross: Cross, trait: str, dominance: bool = True, error: float = 1e-4, map_function: str = "haldane") -> tuple[DataFrame, list[str], int, int]:
    """(k, s): for each marker the products of its columns with one, all columns and the trait, row by row; markers' names, columns of a
    marker, individuals. Row -1 has those of one and the trait."""
    prepare(cross.geno.sparkSession)
    t, kind = {c: x for c, x in tracks(cross).items() if x.chrtype != "X"}, (cross.crosstype, cross.scheme)
    names = [m for x in t.values() for m in x.names]
    width = chains.n_states(kind[0]) - 1 if dominance or chains.n_states(kind[0]) != 3 else 1
    rows = materialise(people(cross, trait), "people")

    def task(batches):
        sums = TaskSums()

        def out():
            held = list(sums.rows())
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int32()), pa.array([v.ravel() for _, v in held], pa.list_(pa.float64()))], names=["block", "s"])

        for b in batches:
            if not b.num_rows:
                continue
            parts = []
            for x in t.values():
                emit = chains.emissions(kind[0], codes(b, x), error, x.chrtype)
                p = chains.posterior(emit, chains.initial(kind[0], x.chrtype, kind[1]), x.steps(kind, map_function))
                parts.append(marker_columns(p, dominance).reshape(len(b), -1))
            y = b.column("y").to_numpy()[:, None]
            z = np.concatenate([np.ones_like(y), *parts, y], axis=1)
            ends = z[:, [0, -1]]
            sums.add((-1,), ends.T @ ends)
            for k in range(0, len(names), BLOCK):
                sums.add((k // BLOCK,), z[:, 1 + k * width : 1 + min(len(names), k + BLOCK) * width].T @ z)
                if sums.full:
                    yield from out()
        yield from out()

    columns = len(names) * width + 2

    def split(batches):
        for pdf in batches:
            for block, s in zip(pdf["block"], pdf["s"], strict=True):
                s = np.asarray(s)
                if block < 0:
                    yield pd.DataFrame({"k": [-1], "s": [s]})
                else:
                    s = s.reshape(-1, width * columns)
                    yield pd.DataFrame({"k": np.arange(len(s)) + block * BLOCK, "s": list(s)})

    table = added(rows.mapInArrow(task, "block int, s array<double>"), ["block"], "s").mapInPandas(split, "k int, s array<double>")
    return materialise(table, "products"), names, width, rows.count()


def forward_selection(cross: Cross, trait: str, most: int, dominance: bool = True, error: float = 1e-4, map_function: str = "haldane") -> DataFrame:
    """step, marker, rss, lod: the marker that lowers the residual sum of squares most, with all of its columns, given those before
    (ties: the first of the map). It ends early where nothing is left to explain."""
    table, names, width, n = products(cross, trait, dominance, error, map_function)
    spark, columns = cross.geno.sparkSession, len(names) * width + 2
    schema = "step int, marker string, rss double, lod double"
    if not n or not names:
        return spark.createDataFrame([], schema)
    place = F.col("k") * width + 1  # of a marker's first column
    cells = [F.get("s", F.lit(a * columns) + place + b) for a in range(width) for b in range(width)]
    ends = [F.get("s", F.lit(a * columns + x)) for a in range(width) for x in (0, columns - 1)]
    small = table.where("k >= 0").select("k", *(x.alias(f"c{i}") for i, x in enumerate(cells)), *(x.alias(f"e{i}") for i, x in enumerate(ends))).orderBy("k").toPandas()
    own = small[[f"c{i}" for i in range(len(cells))]].to_numpy().reshape(-1, width, width)
    with_ends = small[[f"e{i}" for i in range(len(ends))]].to_numpy().reshape(-1, width, 2)
    both = np.array(table.where("k = -1").first()["s"])
    # The factor's columns so far, for all markers' columns and for the trait; the first pivot is the column of ones.
    factor = (with_ends[:, :, 0] / math.sqrt(n)).reshape(-1, 1)
    of_y = [both[1] / math.sqrt(n)]
    total = float(both[3])
    start = total - of_y[0] ** 2
    variance = np.einsum("kaa->ka", own).copy()
    taken: list[tuple] = []
    used = np.zeros(len(names), bool)
    while len(taken) < min(most, len(names)):
        f = factor.reshape(len(names), width, -1)
        left = own - np.einsum("kar,kbr->kab", f, f)
        right = with_ends[:, :, 1] - f @ np.array(of_y)
        # Columns that those taken explain already (but for rounding) add nothing.
        dead = np.einsum("kaa->ka", left) <= 1e-9 * np.maximum(variance, 1e-300)
        right[dead] = 0
        left[dead[:, :, None] | dead[:, None, :]] = 0
        gain = np.einsum("ka,kab,kb->k", right, np.linalg.pinv(left, rcond=1e-9, hermitian=True), right)
        gain[used] = -1
        k = int(np.argmax(gain >= gain.max() * (1 - 1e-12)))
        if gain[k] <= 1e-12 * max(total, 1e-300):
            break
        row = np.array(table.where(F.col("k") == k).first()["s"]).reshape(width, columns)
        used[k] = True
        for a in range(width):
            at = k * width + a
            rest = row[a, 1:-1] - factor @ factor[at]
            if rest[at] <= 1e-9 * variance[k, a]:
                continue
            root = math.sqrt(rest[at])
            y_part = (row[a, -1] - factor[at] @ np.array(of_y)) / root
            factor = np.concatenate([factor, (rest / root)[:, None]], axis=1)
            of_y.append(y_part)
        rss = max(0.0, total - float(np.sum(np.square(of_y))))
        taken.append((len(taken) + 1, names[k], rss, n / 2 * math.log10(start / max(rss, 1e-300))))
    return spark.createDataFrame(taken, schema)
