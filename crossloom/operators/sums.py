"""Sums over individuals: kept in a task while its batches go by, then added up in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task sends its sums on when they hold so many numbers (32 MB), and goes on with none.
MOST_NUMBERS = 1 << 22


class TaskSums:
    """Arrays by key. ``add`` returns nothing; ``full`` says that ``rows`` should be sent on."""

    def __init__(self, most: int = MOST_NUMBERS):
        self.most, self.size = most, 0
        self.held: dict[tuple, list[np.ndarray]] = {}

    def add(self, key: tuple, *arrays: np.ndarray) -> None:
        known = self.held.get(key)
        if known is None:
            self.held[key] = [np.array(a, float) for a in arrays]
            self.size += sum(a.size for a in arrays)
        else:
            for s, a in zip(known, arrays, strict=True):
                s += a

    @property
    def full(self) -> bool:
        return self.size >= self.most

    def rows(self) -> Iterator[tuple]:
        held, self.held, self.size = self.held, {}, 0
        for key, arrays in held.items():
            yield (*key, *arrays)


def gram(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """(loci, a, b): products of the columns of (individuals, loci, a) and (individuals, loci, b), summed over individuals."""
    return np.matmul(x.transpose(1, 2, 0), (x if y is None else y).transpose(1, 0, 2))


def added(parts: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Array columns added up element by element for each key. The parts have a row for each key and task, so few rows are exploded."""
    entries = lambda k, c: F.transform(c, lambda v, i: F.struct(F.lit(k).alias("_array"), i.alias("_at"), v.alias("_v")))
    each = parts.select(*keys, F.explode(F.concat(*(entries(k, c) for k, c in enumerate(columns)))).alias("_x")).groupBy(*keys, "_x._array", "_x._at").agg(F.sum("_x._v").alias("_v"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_array", "_at", "_v"))).alias("_all"))
    own = lambda k: F.transform(F.filter("_all", lambda x: x["_array"] == k), lambda x: x["_v"])
    return whole.select(*keys, *(own(k).alias(c) for k, c in enumerate(columns)))
