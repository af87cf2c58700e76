"""Versioned tables: a new version is written beside the old one and becomes current when
it is complete, so readers always see a whole version.

Layout under ``root``: ``data/v=N`` holds the rows that version N wrote, partitioned by
one column; ``parts/v=N`` lists, for every partition value of version N, the version whose
data it uses. The list is written last, and a version without its success mark does not
count. A merge rewrites the partitions that change and lists the others from where they are.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

_PART = "_part"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class VersionedTable:
    """Rows partitioned by ``partition_col``, which has few enough values to list."""

    def __init__(self, spark: SparkSession, root: str, partition_col: str):
        self.spark, self.root, self.partition_col = spark, root, partition_col

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        jvm, p, fs = _files(self.spark, os.path.join(self.root, "parts"))
        if not fs.exists(p):
            return []
        found = [str(s.getPath().getName()) for s in fs.listStatus(p)]
        done = [n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, f"{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done if n.startswith("v="))

    def _next(self) -> int:
        """A number that no version, complete or not, has used."""
        used = [0]
        for sub in ("data", "parts"):
            _, p, fs = _files(self.spark, os.path.join(self.root, sub))
            if fs.exists(p):
                used += [int(str(s.getPath().getName())[2:]) for s in fs.listStatus(p)]
        return max(used) + 1

    def _parts(self, version: int) -> DataFrame:
        return self.spark.read.schema(f"{_PART} string, source int").parquet(os.path.join(self.root, f"parts/v={version}"))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default the latest complete one. Each folder is read for
        the partitions that still use it only."""
        known = self.versions()
        if not known:
            raise ValueError(f"no complete version under {self.root}")
        if version is None:
            version = known[-1]
        if version not in known:
            raise ValueError(f"version {version} is not one of {known}")
        by_source: dict[int, list] = {}
        for r in self._parts(version).collect():  # a row per partition value
            by_source.setdefault(r["source"], []).append(r[_PART])
        schema = self._schema(version)
        parts = [self.spark.read.schema(schema).parquet(os.path.join(self.root, f"data/v={v}"))
                 .filter(F.coalesce(F.col(_PART), F.lit("")).isin(values)) for v, values in sorted(by_source.items())]
        if not parts:
            return self.spark.createDataFrame([], schema).drop(_PART)
        return reduce(lambda a, b: a.unionByName(b), parts).drop(_PART)

    def _schema(self, version: int) -> str:
        path = os.path.join(self.root, f"schemas/v={version}")
        return self.spark.read.text(path).first()["value"]

    def _write(self, rows: DataFrame, kept: DataFrame | None) -> int:
        """Writes rows, then the list of them and of the ``kept`` partitions."""
        v = self._next()
        part = F.coalesce(F.col(f"`{self.partition_col}`").cast("string"), F.lit(""))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {_PART} string"
        data = os.path.join(self.root, f"data/v={v}")
        rows.withColumn(_PART, part).write.partitionBy(_PART).parquet(data)
        self.spark.createDataFrame([(schema,)], "value string").coalesce(1).write.text(os.path.join(self.root, f"schemas/v={v}"))
        wrote = (self.spark.read.schema(schema).parquet(data).groupBy(F.coalesce(F.col(_PART), F.lit("")).alias(_PART))
                 .agg(F.lit(v).cast("int").alias("source")))
        parts = wrote if kept is None else wrote.unionByName(kept)
        parts.coalesce(1).write.parquet(os.path.join(self.root, f"parts/v={v}"))
        return v

    def replace(self, rows: DataFrame) -> int:
        """A new version of these rows alone; returns its number."""
        return self._write(rows, None)

    def replace_partitions(self, rows: DataFrame, values: list) -> int:
        """A new version in which the partitions named have these rows (or are gone, without
        any) and all others are as they were."""
        known = self.versions()
        if not known:
            return self.replace(rows)
        names = ["" if x is None else str(x) for x in values]
        part = F.coalesce(F.col(f"`{self.partition_col}`").cast("string"), F.lit(""))
        return self._write(rows.filter(part.isin(names)), self._parts(known[-1]).filter(~F.col(_PART).isin(names)))

    def merge(self, rows: DataFrame, key: str) -> int:
        """A new version in which rows with a known key replace the old ones and the others
        are added. ``rows`` has one row a key. Partitions without a change are kept."""
        if not self.versions():
            return self.replace(rows)
        rows, old = cut_lineage(rows), self.read()
        part = F.coalesce(F.col(f"`{self.partition_col}`").cast("string"), F.lit("")).alias(_PART)
        keys = rows.select(key)
        changed = rows.select(part).unionByName(old.join(keys, key, "left_semi").select(part)).distinct()
        names = [r[_PART] for r in changed.collect()]  # partition values
        stays = old.filter(F.coalesce(F.col(f"`{self.partition_col}`").cast("string"), F.lit("")).isin(names)).join(keys, key, "left_anti")
        return self._write(stays.unionByName(rows.select(*stays.columns)),
                           self._parts(self.versions()[-1]).filter(~F.col(_PART).isin(names)))
