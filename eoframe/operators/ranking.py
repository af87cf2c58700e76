"""Consecutive numbering without a single-partition window.

``row_number() over (order by k)`` with no partition (or over one hot
partition key) moves every row of the window into one task. Instead: range-
partition by (keys, order), number rows inside each range partition, count
rows per (partition, key) -- one small row each -- turn the counts into
offsets and add them back. A hot key spans many range partitions, so every
step stays parallel; the only global object is the per-partition count table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def consecutive_index(df: DataFrame, order_cols, name: str = "idx", partition_cols=(),
                      partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order within ``partition_cols``
    (ties broken by all remaining columns)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(partition_cols)
    order = ([F.col(c) for c in order_cols]
             + [F.col(c) for c in df.columns if c not in order_cols and c not in keys])
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id())
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)) - 1)
    # Counts and rows must come from the same partition assignment: write the
    # numbered rows once to the shared checkpoint folder (reliable, lineage cut).
    local = cut_lineage(local)
    counts = local.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    off = offsets.select("_pid", *keys, "_off")
    return (local.join(off, ["_pid", *keys])
                 .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
                 .drop("_pid", "_local", "_off"))
