"""Neighbourhood and grid operators: hillshade, disk dilation, regridding, tile export.

Neighbourhoods work on tiles with a halo: a grid is cut into square tiles in both
directions, cells within reach of a tile's edge are also sent to the tiles beyond it, and
each tile with its halo is one small dense array. A task holds one tile whatever the
grid's size, and what is shuffled beside the grid itself is the halo. Global rescales use
scalar subqueries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

TILE = 256  # cells along a tile's side

# Target grids: cells that are made at once, cells that a task makes, and tasks that Spark can hold.
RUN = 8192
CELLS_A_TASK = 1 << 24
MOST_TASKS = 1 << 16


# Light source and terrain defaults of the elevation notebook.
HILLSHADE_AZDEG = 315.0
HILLSHADE_ALTDEG = 45.0
HILLSHADE_VERT_EXAG = 0.5
HILLSHADE_DX = 30.0
HILLSHADE_DY = 30.0
HILLSHADE_FRACTION = 1.0
RESCALE_MIN_RANGE = 1e-6
DILATION_DEFAULT = 10


def light_vector(azdeg: float = HILLSHADE_AZDEG, altdeg: float = HILLSHADE_ALTDEG) -> tuple[float, float, float]:
    az = math.radians(90.0 - azdeg)
    alt = math.radians(altdeg)
    return (math.cos(az) * math.cos(alt), math.sin(az) * math.cos(alt), math.sin(alt))


def on_tiles(cells: DataFrame, names: list[str], compute: Callable, out: str, kind: str, halo: int, keys=(),
             tile: int = TILE) -> DataFrame:
    """``cells`` with a column ``out``, computed tile by tile on dense arrays.

    ``compute(present, *arrays)`` gets a boolean array of the cells that have a row, and one
    array per name (doubles, NaN for null and where there is no cell), each the tile and
    ``halo`` cells around it; it returns an array of the same shape. Every row of a cell gets the
    cell's value; of several rows of one cell the arrays hold any one. Rows without a
    coordinate get null. Grids are told apart by ``keys``.
    """
    keys, columns = list(keys), cells.columns
    if out.lower() in (c.lower() for c in columns):
        raise ValueError(f"column {out} exists already")
    tile = max(tile, 2 * halo, 1)  # so that a halo reaches the next tile only
    at = {c: F.col(c).cast("long") for c in ("x", "y")}
    own = {c: F.floor(at[c] / tile).cast("long") for c in ("x", "y")}

    def reach(c):
        inside = F.pmod(at[c], F.lit(tile))
        return F.array_compact(F.array(F.lit(0), F.when(inside < halo, F.lit(-1)), F.when(inside >= tile - halo, F.lit(1))))
    spread = cells.withColumn("_dx", F.explode(reach("x"))).withColumn("_dy", F.explode(reach("y")))
    spread = spread.withColumns({"_tx": own["x"] + F.col("_dx"), "_ty": own["y"] + F.col("_dy"),
                                 "_own": (F.col("_dx") == 0) & (F.col("_dy") == 0)}).drop("_dx", "_dy")
    dtype = {"double": np.float64, "boolean": np.bool_}[kind]

    def run(table):
        import pyarrow as pa

        own = table.column("_own").to_numpy()
        side = tile + 2 * halo
        x, y = (table.column(c).to_numpy().astype(np.int64) - table.column(f"_t{c}")[0].as_py() * tile + halo for c in ("x", "y"))
        arrays = [np.zeros((side, side), bool)] + [np.full((side, side), np.nan) for _ in names]
        arrays[0][y, x] = True
        for a, n in zip(arrays[1:], names, strict=True):
            a[y, x] = table.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)
        got = np.asarray(compute(*arrays), dtype)[y[own], x[own]]
        kept = table.select(columns).filter(pa.array(own))
        return kept.append_column(out, pa.array(got))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields) + f", `{out}` {kind}"
    done = spread.filter(placed).groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)
    return done.unionByName(cells.filter(~placed).withColumn(out, F.lit(None).cast(kind)))


def gradient(z: np.ndarray, axis: int, h: float) -> np.ndarray:
    """Along an axis: central inside, one-sided beside a gap (NaN), 0 between two gaps."""
    gap = np.full_like(np.take(z, [0], axis), np.nan)
    prev = np.concatenate([gap, np.delete(z, -1, axis)], axis)
    nxt = np.concatenate([np.delete(z, 0, axis), gap], axis)
    out = np.where(np.isnan(prev), (nxt - z) / h, np.where(np.isnan(nxt), (z - prev) / h, (nxt - prev) / (2.0 * h)))
    return np.where(np.isnan(prev) & np.isnan(nxt), 0.0, out)


def hillshade(dem: DataFrame, value: str = "elevation", keys=(), azdeg: float = HILLSHADE_AZDEG,
              altdeg: float = HILLSHADE_ALTDEG, vert_exag: float = HILLSHADE_VERT_EXAG,
              dx: float = HILLSHADE_DX, dy: float = HILLSHADE_DY,
              fraction: float = HILLSHADE_FRACTION, tile: int = TILE) -> DataFrame:
    """Illumination of a dense elevation grid in [0, 1] (column ``shade``).

    Rows are grid lines ordered by ``y`` (row index), columns by ``x``. The
    row spacing enters as ``-dy`` (image rows run southwards); a missing cell or
    value is a gap, beside which the gradient is one-sided, and has no shade itself. Intensity
    is the normal . light; when its range exceeds 1e-6 it is stretched to [0, 1]
    over the whole grid, then clipped.
    """
    keys = list(keys)
    lx, ly, lz = light_vector(azdeg, altdeg)

    def light(_, elevation):
        z = elevation * vert_exag
        gx, gy = gradient(z, 1, dx), gradient(z, 0, -dy)
        norm = np.sqrt(gx * gx + gy * gy + 1.0)
        inten = (-gx / norm) * lx + (-gy / norm) * ly + (1.0 / norm) * lz
        return np.where(np.isnan(z), np.nan, inten)

    # Written once: the bounds and the rescale read the same intensities.
    g = cut_lineage(on_tiles(dem, [value], light, "_i", "double", 1, keys, tile)
                    .withColumn("_i", F.when(~F.isnan("_i"), F.col("_i"))))
    if keys:  # one (min, max) per grid, joined back; the table has one row per key
        rng = g.groupBy(*keys).agg(F.min("_i").alias("_imin"), F.max("_i").alias("_imax"))
        g = g.join(rng, keys)
        imin, imax = F.col("_imin"), F.col("_imax")
    else:
        rng = g.agg(F.struct(F.min("_i").alias("lo"), F.max("_i").alias("hi"))).scalar()
        # Bound to a column once: every later reference reads it, the subquery runs once.
        g = g.withColumn("_imm", rng)
        imin, imax = F.col("_imm.lo"), F.col("_imm.hi")
    scaled = F.col("_i") * F.lit(fraction)
    stretched = F.when(imax - imin > RESCALE_MIN_RANGE, (scaled - imin) / (imax - imin)).otherwise(scaled)
    shade = F.when(stretched.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), stretched)))
    return g.withColumn("shade", shade).drop("_i", "_imin", "_imax", "_imm")


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    """Kernel offsets with dx^2 + dy^2 <= (radius + 0.5)^2 ((2r+1)^2 at most)."""
    r2 = (radius + 0.5) ** 2
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)
            if dx * dx + dy * dy <= r2]


def disk_half_widths(radius: int) -> list[tuple[int, int]]:
    """Per row offset dy, the half width w of the disk row: w^2 + dy^2 <= (r + 0.5)^2,
    i.e. w = isqrt(r^2 + r - dy^2) (exact integer arithmetic)."""
    return [(dy, math.isqrt(radius * radius + radius - dy * dy)) for dy in range(-radius, radius + 1)]


def disk_reach(source: np.ndarray, radius: int) -> np.ndarray:
    """Cells within the disk of some source cell: per row offset a run of 2w + 1 cells,
    found by a difference of running sums."""
    h, w = source.shape
    run = np.zeros((h, w + 2 * radius + 1), np.int32)
    run[:, radius + 1:radius + 1 + w] = np.cumsum(source, axis=1, dtype=np.int32)
    run[:, radius + 1 + w:] = run[:, radius + w:radius + w + 1]
    out = np.zeros((h, w), bool)
    x = np.arange(w)
    for dy, half in disk_half_widths(radius):
        near = run[:, x + radius + 1 + half] > run[:, x + radius - half]
        to, of = slice(max(0, dy), h + min(0, dy)), slice(max(0, -dy), h + min(0, -dy))
        out[to] |= near[of]
    return out


def dilate(cells: DataFrame, flag: str, radius: int = DILATION_DEFAULT, invert: bool = True,
           keys=(), tile: int = TILE) -> DataFrame:
    """Disk dilation of a boolean grid; returns ``cells`` with ``flag`` replaced.

    With ``invert`` the False cells are dilated (e.g. growing a cloud mask
    around bad pixels); either way the result is negated, as the array form
    is. Shifts that leave the grid are ignored, a null flag is no source.

    The disk is a union of horizontal runs, one per row offset, computed on tiles
    with a halo of the radius.
    """
    def grow(present, value):
        return ~disk_reach(present & (value == (0.0 if invert else 1.0)), radius)

    out = on_tiles(cells, [flag], grow, "_grown", "boolean", radius, keys, tile)
    return out.select(*[F.coalesce("_grown", F.lit(True)).alias(c) if c == flag else F.col(f"`{c}`") for c in cells.columns])


def dilate_by_kernel(cells: DataFrame, flag: str, radius: int = DILATION_DEFAULT, invert: bool = True,
                     keys=()) -> DataFrame:
    """J14 reference form: explode each source cell by every disk offset (tests)."""
    keys = list(keys)
    src = cells.filter(~F.col(flag) if invert else F.col(flag))
    kern = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disk_offsets(radius)])
    shifted = (src.select(*keys, "x", "y", F.explode(kern).alias("_k"))
                  .select(*keys, (F.col("x") + F.col("_k.dx")).alias("x"), (F.col("y") + F.col("_k.dy")).alias("y"))
                  .distinct().withColumn("_hit", F.lit(True)))
    out = cells.join(shifted, [*keys, "x", "y"], "left")
    return out.withColumn(flag, ~F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def regrid_nearest(df: DataFrame, x: Column, y: Column, value: str, x0: float, y0: float, res: float,
                   keys=(), src_order=("y", "x")) -> DataFrame:
    """assign projected source cells to a target grid, nearest to the target centre.

    Target cell ``col = floor((X - x0) / res)``, ``row = floor((y0 - Y) / res)``;
    the value is the source nearest the cell centre, ties by source order.
    """
    keys = list(keys)
    p = df.select(*keys, *src_order, F.col(value).alias("_v"), x.alias("_X"), y.alias("_Y"))
    p = p.withColumns({"col": F.floor((F.col("_X") - x0) / res).cast("long"),
                       "row": F.floor((F.lit(y0) - F.col("_Y")) / res).cast("long")})
    cx = F.lit(x0) + (F.col("col") + 0.5) * res
    cy = F.lit(y0) - (F.col("row") + 0.5) * res
    d2 = (F.col("_X") - cx) * (F.col("_X") - cx) + (F.col("_Y") - cy) * (F.col("_Y") - cy)
    order = F.struct(d2.alias("d2"), *[F.col(c) for c in src_order])
    return (p.groupBy(*keys, "row", "col")
             .agg(F.min_by("_v", order).alias(value), F.count(F.lit(1)).alias("n_src")))


def target_extent(x: Column, y: Column, x0: float, y0: float, res: float) -> list[Column]:
    """Aggregates: first and last line, first and last column of the target grid that hold a
    projected cell centre ``(x, y)``."""
    return [F.floor(c / res).cast("long") for c in (F.lit(y0) - F.max(y), F.lit(y0) - F.min(y), F.min(x) - x0, F.max(x) - x0)]


def cell_runs(spark: SparkSession, row0: int | None, row1: int | None, col0: int | None, col1: int | None) -> DataFrame:
    """(row, _c0, _c1): the cells of a grid as runs of neighbours in one line, ``RUN`` at most;
    none if the grid has no extent.

    A run is made from its number, by the task that makes its cells: no task lists the lines
    and nothing moves. Numbers go down the lines, so a task's cells are of few columns (files
    of them are small), and there are as many tasks as the cells need.
    """
    if None in (row0, row1, col0, col1):
        row0, row1, col0, col1 = 0, -1, 0, -1
    lines, width = row1 - row0 + 1, col1 - col0 + 1
    runs = lines * -(-width // RUN)
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), lines * width // CELLS_A_TASK)
    first = F.lit(col0) + F.expr(f"id div {max(1, lines)}") * RUN
    return (spark.range(0, runs, 1, max(1, min(parts, runs, MOST_TASKS)))
            .select((F.col("id") % max(1, lines) + row0).alias("row"), first.alias("_c0"), F.least(first + (RUN - 1), F.lit(col1)).alias("_c1")))


def cells_of(runs: DataFrame) -> DataFrame:
    """One row a cell: ``col`` in place of ``_c0`` and ``_c1``."""
    return runs.select(*[c for c in runs.columns if c not in ("_c0", "_c1")], F.explode(F.sequence("_c0", "_c1")).alias("col"))


def target_cells(x: Column, y: Column, source: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """(row, col) of every cell of the target grid inside the extent of the source's
    projected cell centres ``(x, y)``."""
    return cells_of(cell_runs(source.sparkSession, *source.agg(*target_extent(x, y, x0, y0, res)).first()))


def regrid(source: DataFrame, values: list[str], forward: Callable, inverse: Callable, lon0: float, lat0: float,
           step: float, x0: float, y0: float, res: float, line: Callable | None = None) -> DataFrame:
    """(row, col, values...) of a target grid, nearest source cell to each target centre.

    The source is a geographic grid whose cell (x, y) is centred at ``lon0 + step * x``,
    ``lat0 - step * y``. Target cell (row, col) is centred at ``x0 + (col + 0.5) * res``,
    ``y0 - (row + 0.5) * res`` in the projection that ``forward(lon, lat)`` gives; its centre goes
    through ``inverse(x, y)`` to the source cell around it, which is gathered by an
    equi-join. So every target cell over the source has a value, however fine the target
    is. Cells of the source's extent that it does not cover have nulls; those beyond the
    source's lines and columns (most of a grid that bends in the projection) are not joined.

    ``line(y)`` names what the inverse takes from y alone: these columns are made once a run of
    cells, and ``inverse(x, y, columns)`` gets them as well.
    """
    px, py = forward(F.lit(lon0) + F.lit(step) * F.col("x"), F.lit(lat0) - F.lit(step) * F.col("y"))
    src = source.select(F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), *values)
    *extent, x1, x2, y1, y2 = source.agg(*target_extent(px, py, x0, y0, res), *[f(F.col(c).cast("long")) for c in ("x", "y") for f in (F.min, F.max)]).first()
    ty = F.lit(y0) - (F.col("row") + 0.5) * res
    shared = {f"_line_{name}": c for name, c in line(ty).items()} if line else {}
    cells = cells_of(cell_runs(source.sparkSession, *extent).withColumns(shared))
    lon, lat = inverse(F.lit(x0) + (F.col("col") + 0.5) * res, ty, *([{name.removeprefix("_line_"): F.col(name) for name in shared}] if line else []))
    placed = cells.withColumns({"_lon": lon, "_lat": lat}).select(
        "row", "col", F.floor((F.col("_lon") - lon0) / step + 0.5).cast("long").alias("_x"),
        F.floor((F.lit(lat0) - F.col("_lat")) / step + 0.5).cast("long").alias("_y"), F.monotonically_increasing_id().alias("_n"))
    near = F.coalesce(F.col("_x").between(x1, x2) & F.col("_y").between(y1, y2), F.lit(False))
    # The number keeps the filters above the projection, whose long series they would repeat.
    over = placed.filter("_n >= 0")
    nulls = [F.lit(None).cast(src.schema[v].dataType).alias(v) for v in values]
    joined = over.filter(near).join(src, ["_x", "_y"], "left").select("row", "col", *values)
    return joined.unionByName(over.filter(~near).select("row", "col", *nulls))


def tile_rows(df: DataFrame, bands, nodata: dict, tile: int, keys=(), x: str = "x", y: str = "y") -> DataFrame:
    """K4: one row per (keys, tile, band): the values of the tile's cells and, beside
    them, each cell's row-major place in the tile (``y % tile * tile + x % tile``), so a
    sparse tile can be put back on its grid.

    Nulls become the band's nodata value. A tile holds at most tile^2
    values, so the per-tile collect is bounded by the tile size.
    """
    keys = list(keys)
    t = df.withColumns({"tile_y": F.floor(F.col(y) / tile).cast("long"),
                        "tile_x": F.floor(F.col(x) / tile).cast("long")})
    lb = t.select(*keys, "tile_y", "tile_x", y, x,
                  F.explode(F.array(*[F.struct(F.lit(b).alias("band"),
                                               F.coalesce(F.col(b).cast("float"),
                                                          F.lit(float(nodata[b])).cast("float")).alias("v"))
                                      for b in bands])).alias("_b"))
    grouped = lb.groupBy(*keys, "tile_y", "tile_x", F.col("_b.band").alias("band")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(y).alias("y"), F.col(x).alias("x"),
                                             F.col("_b.v").alias("v")))).alias("_cells"))
    return grouped.select(*keys, "tile_y", "tile_x", "band",
                          F.transform("_cells", lambda c: c["v"]).alias("values"),
                          F.transform("_cells", lambda c: (c["y"] - F.col("tile_y") * tile) * tile
                                      + c["x"] - F.col("tile_x") * tile).alias("places"),
                          F.size("_cells").cast("long").alias("n_cells"))


def with_grid(tiles: DataFrame, tile: int, x0: float, y0: float, res: float, projection: str, nodata: dict) -> DataFrame:
    """K4: tiles with what places them: the six numbers of a north-up grid (left edge, cell
    width, 0, top edge, 0, minus cell height), the projection and the band's nodata value.
    The cube's cell (0, 0) has its upper left corner at (x0, y0)."""
    place = F.array(F.lit(float(x0)) + F.col("tile_x") * float(tile * res), F.lit(float(res)), F.lit(0.0),
                    F.lit(float(y0)) - F.col("tile_y") * float(tile * res), F.lit(0.0), F.lit(-float(res)))
    values = F.create_map(*[F.lit(x) for b, v in nodata.items() for x in (b, float(v))])
    return tiles.withColumns({"geo_transform": place, "projection": F.lit(projection), "nodata": values[F.col("band")],
                              "tile": F.lit(tile)})


def untile(tiles: DataFrame, keys=()) -> DataFrame:
    """The cells of tiles with a grid: (keys, band, y, x, px, py, value), px and py the
    centre of the cell; nodata becomes null."""
    cells = tiles.select(*keys, "band", "tile_y", "tile_x", "tile", "geo_transform", "nodata",
                         F.explode(F.arrays_zip("values", "places")).alias("_c"))
    inner = F.col("_c.places")
    g = F.col("geo_transform")
    row, col = F.floor(inner / F.col("tile")), inner % F.col("tile")
    value = F.col("_c.values")
    return cells.select(*keys, "band", (F.col("tile_y") * F.col("tile") + row).cast("long").alias("y"),
                        (F.col("tile_x") * F.col("tile") + col).cast("long").alias("x"), (g[0] + (col + 0.5) * g[1]).alias("px"),
                        (g[3] + (row + 0.5) * g[5]).alias("py"), F.when(value != F.col("nodata"), value).alias("value"))


def write_tiles(tiles: DataFrame, path: str, partition_cols=("product", "t")) -> None:
    """K4 sink: tiled Parquet, partitioned for pruning by product and time."""
    cols = [c for c in partition_cols if c in tiles.columns]
    tiles.write.mode("overwrite").partitionBy(*cols).parquet(path)
