"""Multi-parent lines: founder haplotypes from SNPs, and founders put in each line's own order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.model import Cross
from crossloom.runtime import prepare


def infer_founder_hap(cross: Cross, founders: DataFrame, max_markers: int = 15) -> DataFrame:
    """ind, chr, marker, ord, founder: a centred window of SNPs grows until all founders differ in it; a line gets the founder whose alleles it
    has there, if exactly one fits. ``founders``: marker, founder (from 1), allele; genotypes are SNP codes."""
    prepare(cross.geno.sparkSession)
    own = founders.join(cross.map.select("marker", "chr", "ord"), "marker").toPandas()
    tables = {c: x.pivot(index="ord", columns="founder", values="allele").sort_index().to_numpy() for c, x in own.groupby("chr")}
    names = {c: x.sort_values("ord").drop_duplicates("ord")["marker"].to_numpy() for c, x in own.groupby("chr")}

    def span(t: np.ndarray, j: int) -> tuple[int, int] | None:
        for half in range(max_markers // 2 + 1):
            lo, hi = max(0, j - half), min(len(t), j + half + 1)
            if len({tuple(x) for x in t[lo:hi].T}) == t.shape[1]:
                return lo, hi
        return None

    spans = {c: [span(t, j) for j in range(len(t))] for c, t in tables.items()}
    rows = cross.geno.groupBy("ind", "chr").agg(F.collect_list(F.struct("ord", "g")).alias("a"))

    def run(batches):
        for pdf in batches:
            out = []
            for ind, c, a in zip(pdf["ind"], pdf["chr"], pdf["a"], strict=True):
                if c not in tables:
                    continue
                t = tables[c]
                g = np.full(len(t), -1)
                for x in a:
                    g[x["ord"] - 1] = x["g"]
                for j, s in enumerate(spans[c]):
                    if s is not None:
                        part, seen = t[s[0] : s[1]], g[s[0] : s[1]]
                        typed = seen >= 0
                        fits = np.flatnonzero((part[typed] == seen[typed][:, None]).all(0)) if typed.any() else []
                        if len(fits) == 1:
                            out.append((ind, c, names[c][j], j + 1, int(fits[0]) + 1))
            yield pd.DataFrame(out, columns=["ind", "chr", "marker", "ord", "founder"])

    return rows.mapInPandas(run, "ind long, chr string, marker string, ord int, founder int")


def reorder_prob(prob: DataFrame, orders: DataFrame) -> DataFrame:
    """Probabilities by founder instead of by place in the cross. ``orders``: ind, founders (array: which founder stood at each place)."""
    x = prob.join(orders, "ind")
    p = F.transform(F.sequence(F.lit(1), F.size("founders")), lambda f: F.element_at("p", F.array_position("founders", f).cast("int")))
    return x.withColumn("p", p).select(prob.columns)


def reorder_states(states: DataFrame, orders: DataFrame, col: str = "g") -> DataFrame:
    """The same for states: a number (a path) or an array of numbers (draws)."""
    x = states.join(orders, "ind")
    many = dict(states.dtypes)[col].startswith("array")
    new = F.transform(col, lambda g: F.element_at("founders", g.cast("int"))) if many else F.element_at("founders", F.col(col).cast("int"))
    return x.withColumn(col, new).select(states.columns)
