"""Reductions along time: solar-day mosaics, fusers, first/last/nearest valid values.

All of these are keyed aggregations (``groupBy`` + ``min_by``/``max_by``/
``bit_or``), which Spark computes with map-side partial aggregation: a hot
cell or day is pre-reduced in every task before the shuffle, so no group is
ever collected whole into one task.
"""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import epoch_micros, ntz
from .cube import time_index


def _valid_key(value: Column, order_cols) -> Column:
    """Ordering struct that is null where the value is null (min_by/max_by skip nulls)."""
    return F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order_cols], value.alias("_v")))


def with_solar_day(df: DataFrame, time_col: str = "t", lon_col: str = "lon") -> DataFrame:
    """F26 applied as a column ``solar_day``."""
    return df.withColumn("solar_day", geo.solar_day(F.col(time_col), F.col(lon_col)))


def mosaic(df: DataFrame, keys, bands, order_cols, time_col: str = "t") -> DataFrame:
    """A4: first valid value per band in scene order within each group.

    ``order_cols`` give the total scene order (e.g. time, scene id, sequence);
    the value itself breaks any remaining tie. ``time_col`` of the result is
    the earliest time in the group.
    """
    aggs = [F.min_by(F.col(b), _valid_key(F.col(b), order_cols)).alias(b) for b in bands]
    return df.groupBy(*keys).agg(F.min(time_col).alias(time_col), *aggs)


def solar_day_mosaic(df: DataFrame, bands, order_cols=("t", "scene_id", "seq", "lon"),
                     cell=("y", "x"), extra_keys=()) -> DataFrame:
    """A4 + F26: group observations by (solar day, cell) and mosaic them."""
    return mosaic(with_solar_day(df), [*extra_keys, "solar_day", *cell], bands, order_cols)


def water_fuse(df: DataFrame, keys, value: str = "wofs",
               order_cols=("t", "scene_id", "seq", "lon")) -> DataFrame:
    """A5: closed form of the pairwise water-flag fuser folded in scene order.

    Bit 0 marks an empty observation. Folding replaces an empty result by the
    next value, ORs two non-empty ones and keeps a non-empty one over an empty
    one; so: the OR of all non-empty values if any exist, else the last value.
    Both parts are partial aggregates (no ordered collect).
    """
    v = F.col(value)
    non_empty_or = F.bit_or(F.when(v.bitwiseAND(F.lit(1)) == 0, v))
    last_value = F.max_by(v, _valid_key(v, order_cols))
    return df.groupBy(*keys).agg(F.coalesce(non_empty_or, last_value).alias(value))


def wofs_fuser_np(held, new):
    """A5 on whole arrays: where ``held`` lacks data take ``new``, where both have data
    their union, else keep ``held``. The lowest bit means no data."""
    return np.select([held % 2 == 1, new % 2 == 0], [new, held | new], held)


def custom_fuse(df: DataFrame, keys, value: str, order_cols, fuser, value_type: str = "long") -> DataFrame:
    """User fuser ``f(held, new)`` on arrays, folded in scene order per group.

    Rows are hash-partitioned by the group key and sorted by (key, order) inside each
    partition. Within an Arrow batch the k-th rows of all groups are folded in one call;
    a group that goes on in the next batch carries its value over. Null values don't take
    part (a group of nulls only gives null), and null keys form a group like any other.
    A group is folded inside one task (a user fuser need not be associative), so this
    suits groups of bounded size, such as the scenes covering one cell on one solar day;
    associative fusers belong in a partial aggregate (A5).
    """
    keys, order_cols = list(keys), list(order_cols)
    part = (df.select(*keys, *order_cols, value).repartition(*keys)
              .sortWithinPartitions(*keys, *order_cols, value))
    out_schema = df.select(*keys, F.col(value).cast(value_type).alias(value)).schema

    def run(batches):
        open_key, open_value = None, None  # the last group so far: a one-row frame and its value (None: no value yet)
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[keys]
            before = k.shift()
            same = ((k == before) | (k.isna() & before.isna())).all(axis=1).to_numpy()
            goes_on = False
            if open_key is not None:
                a, b = k.iloc[0], open_key.iloc[0]
                goes_on = all((pd.isna(x) and pd.isna(y)) or x == y for x, y in zip(a, b))
            same[0] = False
            group = np.cumsum(~same) - 1
            heads = k[~same].reset_index(drop=True)
            if open_key is not None and not goes_on:
                yield open_key.assign(**{value: pd.array([open_value], dtype="Int64" if value_type == "long" else "Float64")})
            there = pdf[value].notna().to_numpy()
            g, v = group[there], pdf[value].to_numpy()[there]
            v = v.astype(np.int64 if value_type == "long" else float)
            held, has = np.zeros(len(heads), v.dtype), np.zeros(len(heads), bool)
            if goes_on and open_value is not None:
                held[0], has[0] = open_value, True
            rank = np.arange(len(g)) - np.searchsorted(g, g)
            for r in range(int(rank.max()) + 1 if len(rank) else 0):
                at, x = g[rank == r], v[rank == r]
                held[at] = np.where(has[at], fuser(held[at], x), x)
                has[at] = True
            done = pd.array(held, dtype="Int64" if value_type == "long" else "Float64")
            done[~has] = pd.NA
            out = heads.assign(**{value: done})
            yield out.iloc[:-1]
            open_key = heads.iloc[-1:].reset_index(drop=True)
            open_value = held[-1] if has[-1] else None
        if open_key is not None:
            yield open_key.assign(**{value: pd.array([open_value], dtype="Int64" if value_type == "long" else "Float64")})

    return part.mapInPandas(run, out_schema)


def _time_scalars(df: DataFrame, time_col: str):
    """Global first/last time and number of time steps: one struct-valued scalar subquery."""
    s = df.agg(F.struct(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"),
                        F.count_distinct(time_col).alias("n"))).scalar()
    return s["lo"], s["hi"], s["n"]


def _with_rank(reduced: DataFrame, df: DataFrame, time_col: str) -> DataFrame:
    """The time index of each reduced row's ``_f.t``: the cube is reduced first, so only one
    row a cell meets the table of time steps."""
    ranks = time_index(df.select(time_col).distinct(), time_col, "_idx").withColumnRenamed(time_col, "_t")
    return reduced.join(ranks, F.col("_f.t") == F.col("_t"), "left")


def first_valid(df: DataFrame, value: str, cell=("y", "x"), time_col: str = "t",
                index_name: str | None = "idx") -> DataFrame:
    """First non-null value along time per cell, its time and 0-based index.

    An all-null cell yields a null value with the first time of the cube and
    index 0 (the position an all-false argmax gives).
    """
    key = _valid_key(F.col(value), [time_col])
    g = df.groupBy(*cell).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(time_col).alias("t")), key).alias("_f"))
    tmin, _, _ = _time_scalars(df, time_col)
    out = _with_rank(g, df, time_col).withColumn("_tmin", tmin).select(*cell, F.col("_f.v").alias(value),
                   F.coalesce(F.col("_f.t"), F.col("_tmin")).alias(time_col),
                   F.coalesce(F.col("_idx"), F.lit(0)).cast("long").alias("_i"))
    return out.withColumnRenamed("_i", index_name) if index_name else out.drop("_i")


def last_valid(df: DataFrame, value: str, cell=("y", "x"), time_col: str = "t",
               index_name: str | None = "idx") -> DataFrame:
    """Last non-null value along time per cell; index counts from the end (-1 = last).

    An all-null cell yields a null value with the last time and index -1.
    """
    key = _valid_key(F.col(value), [time_col])
    g = df.groupBy(*cell).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(time_col).alias("t")), key).alias("_f"))
    s = df.agg(F.struct(F.max(time_col).alias("hi"), F.count_distinct(time_col).alias("n"))).scalar()
    out = _with_rank(g, df, time_col).withColumn("_ts", s).select(*cell, F.col("_f.v").alias(value),
                   F.coalesce(F.col("_f.t"), F.col("_ts.hi")).alias(time_col),
                   F.coalesce(F.col("_idx") - F.col("_ts.n"), F.lit(-1)).cast("long").alias("_i"))
    return out.withColumnRenamed("_i", index_name) if index_name else out.drop("_i")


def nearest_valid(df: DataFrame, value: str, target: datetime, cell=("y", "x"),
                  time_col: str = "t") -> DataFrame:
    """Non-null value nearest in time to ``target`` per cell (as-of in both directions).

    Ties in distance go to the later side (observations at or after the
    target). Cells without any non-null value get null value and time.
    """
    tgt = epoch_micros(ntz(target))
    t_us = epoch_micros(F.col(time_col))
    dist = F.abs(t_us - tgt)
    before = (t_us < tgt).cast("int")          # 0 = at/after target wins a tie
    key = F.when(F.col(value).isNotNull(), F.struct(dist.alias("d"), before.alias("b"), F.col(time_col)))
    g = df.groupBy(*cell).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(time_col).alias("t")),
                                       key).alias("_n"))
    return g.select(*cell, F.col("_n.v").alias(value), F.col("_n.t").alias(time_col))


def weekly_stats(df: DataFrame, value: str, cell=("y", "x"), time_col: str = "t") -> DataFrame:
    """Per Monday-start week and cell, min / mean / max of ``value``."""
    wk = F.date_trunc("week", F.col(time_col)).alias("week")
    return (df.groupBy(wk, *cell)
              .agg(F.min(value).alias(f"{value}_min"), F.avg(value).alias(f"{value}_mean"),
                   F.max(value).alias(f"{value}_max")))
