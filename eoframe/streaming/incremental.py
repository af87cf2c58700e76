"""Incremental indexing as a Structured Streaming job.

Dataset documents land as JSON files in a folder; a file-source stream picks
up new files, and each micro-batch is de-duplicated on the document id and
upserted against the index table (``foreachBatch``). The upsert only appends
ids that are not in the index yet, so replaying a micro-batch after a failure
adds nothing twice: with the stream checkpoint this gives exactly-once index
contents. ``trigger(availableNow=True)`` drains what has landed and stops.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .key_index import KeyIndex


def first_per_id(batch: DataFrame, key: str = "id", order: str = "t") -> DataFrame:
    """One document per id inside a micro-batch: the earliest by ``order`` (ties by the
    whole row). The index keeps what arrived first and reports later ones as already
    there, so within a batch the first wins too. A partial aggregate chooses it."""
    cols = [c for c in batch.columns if c != key]
    pick = F.min_by(F.struct(*cols), F.struct(F.col(order), *[F.col(c) for c in cols if c != order]))
    return batch.groupBy(key).agg(pick.alias("_d")).select(key, "_d.*")


def run_incremental_index(spark: SparkSession, landing: str, index: KeyIndex, checkpoint: str,
                          valid: Column | None = None, order: str = "t", max_files_per_trigger: int | None = None) -> list[dict]:
    """Drain the landing folder into the index; returns per-epoch outcome counts.
    ``max_files_per_trigger`` splits a backlog into batches; by default it is one batch."""
    log: list[dict] = []

    def upsert_batch(batch: DataFrame, epoch_id: int) -> None:
        log.append({"epoch": epoch_id, **index.add(first_per_id(batch, index.key, order), valid)})

    reader = spark.readStream.schema(index.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(os.path.join(landing, "*"))
    q = (stream.writeStream.foreachBatch(upsert_batch)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return log


def new_run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for one streaming run."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def land(docs: DataFrame, landing: str, batch_col: str) -> None:
    """Write documents as JSON files, one folder per ``batch_col`` value, in one job."""
    docs.write.mode("overwrite").partitionBy(batch_col).json(landing)
