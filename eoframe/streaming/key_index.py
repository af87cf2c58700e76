"""An index of documents by key whose look-ups read few files.

Documents lie in ``buckets`` folders by the hash of their key. Beside them lie Bloom
filters, one per bucket, cut into slices of 32,768 bits; each batch adds the bits of its
keys. A key whose bits are not all set is new without a look at the index; only the buckets
of the other keys are read, and of those only the key column.

Bits are written before documents. If a job dies between the two, the bits stand for
nothing yet; the batch, run again, finds no document and adds them. If it dies after both,
every document is found again. So each key is added once.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.documents import upsert_outcomes
from ..session import cut_lineage
from ..sources.versions import _files

SLICE_BITS = 32_768  # of Spark's bitmap aggregates
PROBES = 4


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _files(spark, path)
    return fs.exists(p)


@dataclass
class KeyIndex:
    """``slices`` filter slices a bucket hold some 3,000 keys each at ten bits a key; more
    keys make the filters report more buckets than needed, never fewer."""

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str = "id"
    buckets: int = 64
    slices: int = 8

    @property
    def data(self) -> str:
        return os.path.join(self.root, "documents")

    @property
    def filters(self) -> str:
        return os.path.join(self.root, "filters")

    def bucket(self):
        return F.pmod(F.xxhash64(F.lit(1), F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _probes(self):
        """(slice, bit) of each probe of a key."""
        bits = self.slices * SLICE_BITS
        at = [F.pmod(F.xxhash64(F.lit(2 + i), F.col(self.key)), F.lit(bits)) for i in range(PROBES)]
        return F.array(*[F.struct(F.floor(p / SLICE_BITS).cast("int").alias("slice"), (p % SLICE_BITS).cast("int").alias("bit")) for p in at])

    def read(self) -> DataFrame:
        if not exists(self.spark, self.data):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self._stored()).parquet(self.data).drop("bucket")

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])

    def suspects(self, keys: DataFrame) -> DataFrame:
        """(key, bucket) of the keys that the index may hold."""
        keys = keys.select(self.key).distinct().withColumn("bucket", self.bucket())
        if not exists(self.spark, self.filters):
            return keys.limit(0)
        stored = self.spark.read.schema("slice int, bits binary, bucket int").parquet(self.filters)
        merged = stored.groupBy("bucket", "slice").agg(F.bitmap_or_agg("bits").alias("bits"))
        probes = keys.withColumn("_p", F.explode(self._probes())).select(self.key, "bucket", "_p.slice", "_p.bit")
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) > 0
        hits = probes.join(merged, ["bucket", "slice"]).filter(is_set)
        return hits.groupBy(self.key, "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == PROBES).drop("n")

    def add(self, docs: DataFrame, valid=None) -> dict:
        """Adds the documents that are new and valid; ``docs`` has one row a key. Returns
        outcome counts, how many keys the filters could not rule out and the buckets read."""
        docs = cut_lineage(docs.select(*self.schema.fieldNames()))
        hits = self.suspects(docs).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``buckets`` rows
        touched = [r["bucket"] for r in hits]
        if touched and exists(self.spark, self.data):
            present = (self.spark.read.schema(self._stored()).parquet(self.data).filter(F.col("bucket").isin(touched))
                       .select(self.key))
        else:
            present = docs.select(self.key).limit(0)
        out = cut_lineage(upsert_outcomes(docs, present, self.key, valid))
        added = out.filter("status = 'added'").select(*self.schema.fieldNames()).withColumn("bucket", self.bucket())
        bits = (added.select("bucket", F.explode(self._probes()).alias("_p")).select("bucket", "_p.slice", "_p.bit")
                .groupBy("bucket", "slice").agg(F.bitmap_construct_agg("bit").alias("bits")))
        bits.write.mode("append").partitionBy("bucket").parquet(self.filters)
        added.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.data)
        counts = {r["status"]: r["n"] for r in out.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {**counts, "suspects": sum(r["n"] for r in hits), "buckets_read": len(touched)}
