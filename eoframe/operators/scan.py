"""Blocked prefix scans: running values whose hottest key is spread over many tasks.

A running window over one key is one task's work. Here the rows are range-partitioned by
(keys, order), so a hot key covers several blocks; each block runs its own values, the
blocks' totals (one row per block and key) are run in block order, and what came before
a block is added to its rows. Every running value is an associative operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: op -> (window aggregate of a column, combination of what came before with the own value).
#: Null values count as absent everywhere.
OPS = {
    "sum": (F.sum, lambda before, own: F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)),
    "count": (F.count, lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "min": (F.min, lambda before, own: F.least(before, own)),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda before, own: F.coalesce(before, own)),
}


def prefix_scan(df: DataFrame, order: list, values: dict[str, tuple[str, Column | str]], keys=(),
                inclusive: bool = True, descending: bool = False, partitions: int | None = None) -> DataFrame:
    """df with running columns ``{name: (op, column)}`` per ``keys`` in ``order``, ties of the
    order broken by the remaining columns; ``inclusive`` counts the row itself.

    Rows before the first one with a value have null (a count has 0). Null keys are a key.
    """
    clash = {n.lower() for n in values} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, columns = list(keys), df.columns
    inputs = {name: f"_in_{i}" for i, name in enumerate(values)}
    rest = [c for c in columns if c not in order and c not in keys
            and df.schema[c].dataType.typeName() not in ("map", "variant")]
    turn = [F.desc(c) if descending else F.asc(c) for c in (*order, *rest)]
    df = df.withColumns({inputs[name]: F.col(c) if isinstance(c, str) else c for name, (_, c) in values.items()})
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *turn).withColumn("_block", F.spark_partition_id())
    inside = Window.partitionBy("_block", *keys).orderBy(*turn)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ran = {name: OPS[op][0](F.col(inputs[name])).over(upto) for name, (op, _) in values.items()}
    totals = {f"_all_{name}": OPS[op][0](F.col(inputs[name])).over(whole) for name, (op, _) in values.items()}
    # Blocks and their totals must come from one assignment of rows: written once.
    ranged = cut_lineage(ranged.withColumns(ran | totals | {"_first": F.row_number().over(inside) == 1}))
    blocks = ranged.filter("_first").select("_block", *keys, *totals)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("_block", *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
                           *[OPS[op][0](F.col(f"_all_{name}")).over(earlier).alias(f"_before_{name}") if op != "count"
                             else F.sum(f"_all_{name}").over(earlier).alias(f"_before_{name}")
                             for name, (op, _) in values.items()])
    on = F.col("_r._block") == F.col("_b._block")
    for i, k in enumerate(keys):
        on = on & F.col(f"_r.`{k}`").eqNullSafe(F.col(f"_key_{i}"))
    out = ranged.alias("_r").join(before.alias("_b"), on)
    return out.select(*[F.col(f"_r.`{c}`") for c in columns],
                      *[OPS[op][1](F.col(f"_before_{name}"), F.col(name)).alias(name) for name, (op, _) in values.items()])

