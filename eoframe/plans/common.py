"""Small helpers shared by the plan modules (Spark side and oracle side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.temporal import iso_key
from ..sources.products import PRODUCTS


def r9(c):
    """Round aggregates of scaled values: finer than their exact decimals, so
    engines never meet a rounding tie, coarser than summation-order noise."""
    return F.round(c, 9)


def iso_day(c):
    return F.col(c).cast("date").cast("string")


def iso_ts(c):
    return iso_key(c)


def sql_iso_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"


def sql_str(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def bands_values_sql() -> str:
    """Product band table as a DuckDB VALUES list (oracle side of S11/P2)."""
    rows = []
    for p, (_, _, _, bands) in PRODUCTS.items():
        for i, (b, dt, nd, units, al) in enumerate(bands):
            rows.append(f"({sql_str(p)}, {i}, {sql_str(b)}, {sql_str(dt)}, {float(nd)!r}, {sql_str(units)}, "
                        f"{sql_str(','.join(al))})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows)
            + ") AS v(product, pos, band, dtype, nodata, units, aliases)")
