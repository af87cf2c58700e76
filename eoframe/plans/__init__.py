"""Registered queries: each is a Spark plan builder plus its DuckDB oracle.

A query reads the driver tables (through the derived views), so its work
grows with the data. ``operators`` lists the inventory IDs it exercises.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}

MODULES = ("landsat", "catalog", "timeseries", "stats", "terrain", "harvest", "explore", "documents", "streams",
           "outcomes")


def register(name: str, oracle: str | None = None, operators=()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, tuple(operators))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
