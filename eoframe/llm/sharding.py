"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table whose size is prime: it
starts at ``offset`` and advances by ``skip``, which visits every slot once. The shards
take turns, each claiming the next slot of its order that is still free, until the
table is full. A key is hashed to a slot, so placement is one lookup; when a shard
comes or goes, few keys move and the shares stay within one slot of each other.

The table has ``size`` rows, a parameter that does not depend on the data, so it is
broadcast: rows are placed without a shuffle and a hot key costs nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed_rows, table
from .registry import register

SHARDS = 32
SIZE = 3217  # prime, about 100 slots a shard


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime and at least the number of shards")
    at = [_digest(f"{s}:offset") % size for s in shards]
    skip = [_digest(f"{s}:skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key, size: int):
    """Slot of a key column; a null key has the slot of the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % F.lit(size)


def assign_shards(df: DataFrame, key_col: str, shards: list[str], size: int = SIZE,
                  slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """df with its slot and shard. Every row is kept, repeated rows and null keys too.

    Extra columns stay, whatever they are called; if df has a column called like one of
    the two new ones (in any case), a ValueError names it. An empty df gives an empty result.
    """
    clash = {c for c in df.columns if c.lower() in (slot_name.lower(), shard_name.lower())}
    if clash or slot_name.lower() == shard_name.lower():
        raise ValueError(f"columns {sorted(clash) or [slot_name, shard_name]} clash; pass other names")
    owner = lookup_table(shards, size)
    rows = df.sparkSession.createDataFrame(list(enumerate(owner)), "slot_ bigint, shard_ int")
    names = F.array(*[F.lit(s) for s in shards])
    placed = packed_rows(df).withColumn("slot_", slot_of(F.col(f"row_.`{key_col}`"), size))
    return (placed.join(F.broadcast(rows), "slot_", "left")
            .select("row_.*", F.col("slot_").alias(slot_name), names[F.col("shard_")].alias(shard_name)))


def write_shards(df: DataFrame, path: str, shard_name: str = "shard", files_per_shard: int = 8) -> None:
    """One folder per shard. A shard's rows go to several tasks, so a heavy shard is
    written by as many."""
    spread = F.pmod(F.hash(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    df.repartition(F.col(shard_name), spread).write.mode("overwrite").partitionBy(shard_name).parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


_HEX = "CAST(concat('0x', substr(md5({}), 1, 15)) AS BIGINT)"
ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%03d', i) AS shard,
         {_HEX.format("printf('shard-%03d:offset', i)")} % {SIZE} AS off,
         {_HEX.format("printf('shard-%03d:skip', i)")} % {SIZE - 1} + 1 AS skip
  FROM range({SHARDS}) t(i)),
orders AS (
  SELECT list(list_transform(range({SIZE}), lambda j: (off + j * skip) % {SIZE}) ORDER BY i) AS prefs FROM shards),
turns AS (
  SELECT 0 AS n, CAST([] AS BIGINT[]) AS slots, list_transform(range({SIZE}), lambda x: true) AS free,
         list_transform(range({SHARDS}), lambda x: 0) AS pos, -1::BIGINT AS took
  UNION ALL
  SELECT n + 1, slots, list_concat(list_concat(free[:slot], [false]), free[slot + 2:]),
         list_concat(list_concat(pos[:n % {SHARDS}], [nxt]), pos[n % {SHARDS} + 2:]), slot
  FROM (SELECT *, prefs[n % {SHARDS} + 1][nxt] AS slot
        FROM (SELECT t.*, prefs,
                     pos[n % {SHARDS} + 1] + list_position(
                       list_transform(prefs[n % {SHARDS} + 1][pos[n % {SHARDS} + 1] + 1:], lambda s: free[s + 1]), true) AS nxt
              FROM turns t, orders WHERE n < {SIZE}) a) b),
lookup AS (SELECT took AS slot, printf('shard-%03d', (n - 1) % {SHARDS}) AS shard FROM turns WHERE n > 0)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, {_HEX.format("coalesce(doc_id::VARCHAR, '')")} % {SIZE} AS slot FROM documents) d
LEFT JOIN lookup USING (slot)
"""


@register("op10_sharding", ORACLE)
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, "doc_id", shard_names(), SIZE)
