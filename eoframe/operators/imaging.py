"""User image functions applied per (time, tile) on dense arrays (Arrow path).

Rows are dealt and sorted by chunk; each chunk is made a 2-D numpy array, the user's
functions run in order, and the result is written back to the rows that existed. A task
holds one batch and the chunk it ends in (at most tile^2 cells), so what it holds is
bounded by the tile, never by the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cube import TILE


def apply_image_funcs(df: DataFrame, band: str, funcs, keys=("t",), tile: int = TILE, clip=(0.0, 1.0),
                      x: str = "x", y: str = "y") -> DataFrame:
    keys = list(keys)
    t = df.select(*keys, x, y, F.col(band).cast("double").alias(band)).withColumns(
        {"tile_y": F.floor(F.col(y) / tile).cast("long"), "tile_x": F.floor(F.col(x) / tile).cast("long")})

    chunk = [*keys, "tile_y", "tile_x"]
    schema = t.select(*keys, x, y, band).schema

    def image(ys, xs, values):
        y0, x0 = ys.min(), xs.min()
        img = np.full((ys.max() - y0 + 1, xs.max() - x0 + 1), np.nan)
        img[ys - y0, xs - x0] = values
        for f in funcs:
            img = f(img)
        if clip is not None:
            img = np.clip(img, clip[0], clip[1])
        return img[ys - y0, xs - x0]

    def run(batches):
        import pyarrow as pa

        def starts(last, b):
            """Rows of a batch that begin a chunk, after the ``last`` row before it."""
            cells = pa.Table.from_batches([last, b]).select(chunk).combine_chunks()
            new = np.zeros(b.num_rows, bool)
            for c in cells.columns:
                code = c.combine_chunks().dictionary_encode("encode").indices.to_numpy()
                new |= code[1:] != code[:-1]
            return np.flatnonzero(new)

        def finish(parts, bounds):
            cells = pa.Table.from_batches(parts)
            placed = ~(cells.column(y).is_null().to_numpy() | cells.column(x).is_null().to_numpy())
            ys, xs = (cells.column(c).fill_null(0).to_numpy().astype(np.int64) for c in (y, x))
            values = cells.column(band).to_numpy()
            out = np.full(len(values), np.nan)
            with np.errstate(invalid="ignore", divide="ignore"):
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    if placed[lo]:  # rows without a coordinate are a chunk of their own
                        out[lo:hi] = image(ys[lo:hi], xs[lo:hi], values[lo:hi])
            cells = cells.select([*keys, x, y]).append_column(band, pa.array(out, mask=~np.isfinite(out)))
            yield from cells.combine_chunks().to_batches()

        held: list = []  # the rows so far of the chunk that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            at = starts(held[-1].slice(held[-1].num_rows - 1) if held else b.slice(0, 1), b)
            if len(at):
                before = sum(h.num_rows for h in held)
                yield from finish([*held, b.slice(0, at[-1])], [0, *(before + at)])
                held = [b.slice(at[-1])]
            else:
                held.append(b)
        if held:
            yield from finish(held, [0, sum(h.num_rows for h in held)])

    return t.repartition(*chunk).sortWithinPartitions(*chunk).mapInArrow(run, schema)


def tile_stretch(img: np.ndarray) -> np.ndarray:
    """Example image function: stretch a chunk to its own min-max range."""
    lo, hi = np.nanmin(img), np.nanmax(img)
    return (img - lo) / (hi - lo)


def gamma(g: float):
    def f(img: np.ndarray) -> np.ndarray:
        return np.power(img, g)
    return f


def map_blocks(df: DataFrame, fn, schema) -> DataFrame:
    """Apply ``fn(pandas.DataFrame) -> pandas.DataFrame`` to every Arrow batch
    (``mapInPandas``); the fallback when no Column expression fits."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)
