"""Connected components of an edge table, by label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.runtime import materialise, partitions

MAX_ROUNDS = 100


ROWS_PER_TASK = 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", first_tasks: int | None = None) -> DataFrame:
    """node, component (its smallest node) for every node of an edge; edges with a null end are left out.

    Each round a node takes the smallest label among itself and its neighbours, tells that label to the label it had
    (hooking), and then takes its label's label. Neighbours' labels are reduced by a partial aggregate before they are shuffled, so a node
    with very many edges is no hot group; joins are plain equi-joins that AQE can split. Rounds grow with
    the logarithm of a component's diameter; a forest of stars around their smallest nodes needs one. Each round's labels are
    written to the shared folder. Small tables use few tasks; ``first_tasks``: how many write the distinct edges.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    links = pairs.select(F.explode(both).alias("e")).select("e.u", "e.v").distinct()
    links = materialise(links.coalesce(first_tasks) if first_tasks else links, "links")
    tasks = max(3, min(partitions(edges.sparkSession), -(-links.count() // ROWS_PER_TASK)))
    labels = materialise(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")).coalesce(tasks), "labels")
    for _ in range(MAX_ROUNDS):
        near = links.join(labels, links.v == labels.node).select("u", "component").coalesce(tasks)
        best = near.groupBy("u").agg(F.min("component").alias("c")).coalesce(tasks)
        held = materialise(labels.join(best, labels.node == best.u).select("node", "component", F.least("c", "component").alias("c")).coalesce(tasks), "labels")
        if not held.where("c < component").count():
            return labels
        hooks = held.where("c < component").groupBy(F.col("component").alias("u")).agg(F.min("c").alias("h")).coalesce(tasks)
        hooked = held.join(hooks, held.node == hooks.u, "left").select("node", F.least("c", F.coalesce("h", "c")).alias("c")).coalesce(tasks)
        hooked = materialise(hooked, "labels")
        up = hooked.select(F.col("node").alias("k"), F.col("c").alias("cc"))
        labels = materialise(hooked.join(up, hooked.c == up.k, "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component")).coalesce(tasks), "labels")
    raise RuntimeError("connected components did not settle")
