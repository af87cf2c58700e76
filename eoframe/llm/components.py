"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, materialise


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(v, component) for every vertex of ``edges(a, b)``: component is the least vertex
    reachable. Loops, repeated edges and either direction are fine; nulls are left out.

    A round gives every vertex the least label among its neighbours (aggregated before
    the shuffle, so a star with a huge centre is cheap) and then that label's own label,
    which halves the distance to the least vertex. Each round is cut by a checkpoint.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = compact(materialise(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    labels = compact(materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least"))
                                 .select("v", F.least("v", "least").alias("component"))))
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("v").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near")))
        step = labels.join(near, "v").select("v", F.least("component", "near").alias("to"), "component")
        jump = labels.select(F.col("v").alias("to"), F.col("component").alias("further"))
        new = materialise(step.join(jump, "to").select("v", F.least("to", "further").alias("component"),
                                                       (F.least("to", "further") != F.col("component")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = compact(new.select("v", "component"))
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
