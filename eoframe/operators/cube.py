"""Pixel-cube operators on the long layout ``(time, y, x, band...)``.

A cube is a DataFrame with one row per cell and time step and one column per
band. Masks are boolean Columns on the same row, so masking never joins.
Axis-wide decisions (drop a time step, trim a coordinate) aggregate a small
per-axis table and semi-join it back with a size-checked broadcast, so the
pixel rows themselves are never shuffled by a low-cardinality key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TILE = 512  # chunk edge in cells (x, y)


def require_columns(df: DataFrame, cols, what: str = "input") -> None:
    """Fail before planning when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns {missing}")


def any_not_null(bands) -> Column:
    return reduce(lambda a, b: a | b, [F.col(b).isNotNull() for b in bands])


def mask_bands(df: DataFrame, bad: Column, bands) -> DataFrame:
    """Set ``bands`` to null where ``bad`` holds (``ds.where(~mask)``)."""
    require_columns(df, bands)
    return df.withColumns({b: F.when(~bad, F.col(b)) for b in bands})


def keep_good_only(df: DataFrame, good: Column, nodata: dict) -> DataFrame:
    """P10: data bands -> float, null where not good or equal to the band's nodata."""
    require_columns(df, list(nodata))
    return df.withColumns({
        b: F.when(good & (F.col(b) != F.lit(nd)) & ~F.isnan(F.col(b).cast("double")),
                  F.col(b).cast("float"))
        for b, nd in nodata.items()})


def hide_nodata(df: DataFrame, bands, nodata) -> DataFrame:
    """Null every band where the first band equals the product's nodata."""
    first = F.col(bands[0])
    keep = F.coalesce(first != F.lit(nodata), F.lit(True))
    return df.withColumns({b: F.when(keep, F.col(b)) for b in bands})


def within_range(df: DataFrame, bands, lo, hi) -> DataFrame:
    """P11 (values): null out band values outside [lo, hi]."""
    return df.withColumns({b: F.when(F.col(b).between(lo, hi), F.col(b)) for b in bands})


def _axis_with_data(df: DataFrame, axis: str, bands) -> DataFrame:
    return df.filter(any_not_null(bands)).select(axis).distinct()


def drop_empty(df: DataFrame, bands, axes=("t",)) -> DataFrame:
    """P12 / P11 ``drop=True``: remove coordinates of ``axes`` whose every value is null.

    The coordinates holding data are found for all axes in one pass (one
    aggregation over GROUPING SETS ((axis1), (axis2), ...)); each axis table is
    bounded by the axis length and semi-joined back.
    """
    axes = list(axes)
    if len(axes) == 1:
        keeps = {axes[0]: _axis_with_data(df, axes[0], bands)}
    else:
        sets = (df.filter(any_not_null(bands))
                  .groupingSets([[a] for a in axes], *axes).agg(F.grouping_id().alias("_g")))
        full = (1 << len(axes)) - 1
        keeps = {a: sets.filter(F.col("_g") == full - (1 << (len(axes) - 1 - i))).select(a)
                 for i, a in enumerate(axes)}
    out = df
    for axis in axes:
        out = out.join(keeps[axis], axis, "left_semi")
    return out


def valid_range(df: DataFrame, bands, lo, hi, drop: bool = False, axes=("t", "y", "x")) -> DataFrame:
    """Values outside [lo, hi] -> null; with ``drop`` trim all-null coordinates."""
    out = within_range(df, bands, lo, hi)
    return drop_empty(out, bands, axes) if drop else out


def good_fraction(df: DataFrame, good: Column, cells: Column, time_col: str = "t") -> DataFrame:
    """A1: per time step, good cells over all ``cells`` of the grid (missing rows count as
    bad). ``cells`` is a number or a scalar subquery."""
    return (df.groupBy(time_col).agg(F.sum(good.cast("long")).cast("double").alias("_good"))
              .select(time_col, (F.col("_good") / cells.cast("double")).alias("good_frac")))


def min_gooddata(df: DataFrame, good: Column, threshold: float, cells: Column,
                 time_col: str = "t") -> DataFrame:
    """Keep time steps whose good fraction reaches ``threshold``.

    Late materialisation: the fraction is computed from the mask column only,
    then the kept times are semi-joined onto the full rows.
    """
    frac = good_fraction(df.select(time_col, good.alias("_good")), F.col("_good"), cells, time_col)
    keep = frac.filter(F.col("good_frac") >= threshold).select(time_col)
    return df.join(keep, time_col, "left_semi")


def time_index(df: DataFrame, time_col: str = "t", name: str = "idx") -> DataFrame:
    """0-based position of each row's time step among all time steps.

    The ranking runs on the distinct-time table (one row per step), never on
    pixel rows, then joins back.
    """
    times = df.select(time_col).distinct()
    ranked = times.withColumn(name, F.dense_rank().over(Window.orderBy(time_col)) - 1)
    return df.join(ranked, time_col)


def isel_time(df: DataFrame, idx, time_col: str = "t") -> DataFrame:
    """Positional time slice ``isel(time=i)`` or ``isel(time=[i, j])``."""
    idxs = idx if isinstance(idx, (list, tuple)) else [idx]
    if any(not isinstance(i, int) or isinstance(i, bool) for i in idxs):
        raise TypeError("time index must be an integer")
    out = time_index(df, time_col, "_idx")
    n = out.select(F.max("_idx") + 1).first()[0] if any(i < 0 for i in idxs) else None
    want = [i + n if i < 0 else i for i in idxs] if n is not None else idxs
    return out.filter(F.col("_idx").isin(want)).drop("_idx")


def with_tile(df: DataFrame, size: int = TILE) -> DataFrame:
    """Chunk id of each cell, ``floor(x/size), floor(y/size)``."""
    return df.withColumns({"tile_x": F.floor(F.col("x") / size).cast("long"),
                           "tile_y": F.floor(F.col("y") / size).cast("long")})


def repartition_by_tile(df: DataFrame, size: int = TILE, time_col: str = "t") -> DataFrame:
    """Co-locate each (time, tile) chunk; AQE coalesces small ones."""
    return with_tile(df, size).repartition(time_col, "tile_y", "tile_x")


def mask_from(data: DataFrame, mask_cube: DataFrame, keys=("t", "y", "x")) -> DataFrame:
    """Attach another product's mask bands by coordinates (left equi-join)."""
    return data.join(mask_cube, list(keys), "left")


def merge_cubes(a: DataFrame, b: DataFrame, keys=("t", "y", "x")) -> DataFrame:
    """``xr.merge`` = full outer join on coordinates."""
    return a.join(b, list(keys), "full_outer")
