"""Stored pixel cubes: the on-disk layout that makes area/time loads cheap at scale.

Layout: Parquet partitioned by ``product / year / month``; inside each
partition rows are clustered by chunk (``tile_y, tile_x``) and sorted by
``y, x``. A load then
* prunes directories from the product and the time range (partition filters),
* skips row groups from the bbox (Parquet min/max statistics on ``y``/``x``),
* reads only the requested band columns.
This is the metadata-first search of the catalogue applied to pixels.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import in_range
from ..operators.cube import TILE


def write_cube(df: DataFrame, path: str, product: str | None = None, time_col: str = "t", tile: int = TILE,
               max_records_per_file: int = 5_000_000) -> None:
    out = df if product is None else df.withColumn("product", F.lit(product))
    out = out.withColumns({"year": F.year(time_col), "month": F.month(time_col),
                           "tile_y": F.floor(F.col("y") / tile).cast("long"),
                           "tile_x": F.floor(F.col("x") / tile).cast("long")})
    (out.repartition("product", "year", "month", "tile_y", "tile_x")
        .sortWithinPartitions("tile_y", "tile_x", "y", "x", time_col)
        .write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("product", "year", "month").parquet(path))


def _month_key(dt: datetime) -> int:
    return dt.year * 100 + dt.month


def load_cube(spark: SparkSession, path: str, product: str | None = None, time=None, bbox=None, bands=None,
              time_col: str = "t") -> DataFrame:
    """Load bands of one product inside a half-open time range and a cell bbox
    ``(x1, y1, x2, y2)`` (inclusive cell indices)."""
    df = spark.read.parquet(path)
    if product is not None:
        df = df.filter(F.col("product") == product)
    if time is not None:
        b, e = time
        # Partition predicate on (year, month): prunes whole directories.
        key = F.col("year") * 100 + F.col("month")
        df = df.filter((key >= _month_key(b)) & (key <= _month_key(e))).filter(in_range(time_col, time))
    if bbox is not None:
        x1, y1, x2, y2 = bbox
        df = df.filter(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))
    cols = [time_col, "y", "x"] + (list(bands) if bands else [c for c in df.columns if c not in (
        time_col, "y", "x", "product", "year", "month", "tile_y", "tile_x")])
    return df.select(*cols)
