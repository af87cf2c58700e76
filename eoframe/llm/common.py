"""Shared helpers of the text operators: reading inputs and vectorised word arrays.

The array helpers work on the UTF-8 bytes of a whole Arrow batch at once, so a task
never loops over words in Python. A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; those separators are single bytes in UTF-8, so byte words and
character words are the same.
"""

from __future__ import annotations

import gc
import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

_U = np.uint64
_R = _U(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2^64
_POWER_BLOCK = 1 << 16
FILTER_ROWS = 1024  # texts that filter_rows looks at together


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names: other columns of the caller,
    whatever they are called, never meet an operator's own columns."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def packed_rows(df: DataFrame) -> DataFrame:
    """df's rows as one struct column `row_`: an operator's own columns stand beside it and
    never meet the caller's, whatever those are called. ``select("row_.*")`` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"))


def held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; later steps read it, not the lineage."""
    return cut_lineage(df)


def compact(df: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """A checkpointed df of narrow rows, read by as many tasks as its rows need: small
    tables then cost few files in the shuffles that follow."""
    return df.coalesce(max(1, -(-df.count() // rows_per_task)))


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage: the shuffle files of steps that are checkpointed
    by now, and checkpoints that nothing refers to any more, then go from the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new place in the shared folder, and read from there:
    like a checkpoint, but compressed. Whoever owns the shared folder clears it."""
    path = os.path.join(scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}"))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits (multiply and xor-shift)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = _U(1)
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of a batch of documents, flat. ``first[d]:first[d + 1]`` are document d's."""

    data: np.ndarray      # all bytes, uint8
    start: np.ndarray     # byte where each word starts
    end: np.ndarray       # byte after each word
    first: np.ndarray     # per document, its first word; one more at the end
    offsets: np.ndarray   # per document, its first byte; one more at the end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null text counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column if pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_large_binary(a.type) else "")
    n = len(a)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=a.offset + n + 1)[a.offset:].copy()
    if data is None or n == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    inside = np.ones(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data - np.uint8(9)) < 5))
    # A word may not run over the end of its document.
    is_start = inside[1:-1] & ~inside[:-2]
    is_end = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    is_start[edges] |= inside[1:-1][edges]
    is_end[edges - 1] |= inside[1:-1][edges - 1]
    start = np.flatnonzero(is_start)
    end = np.flatnonzero(is_end) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def word_hashes(w: Words) -> np.ndarray:
    """One 64-bit hash per word, a function of the word's bytes alone.

    Horner sums over blocks of the batch: sum(byte * R^i) between two bytes, scaled
    back by R^-start (R is odd), then mixed.
    """
    n = len(w.data)
    if not len(w.start):
        return np.zeros(0, np.uint64)
    out = np.empty(len(w.start), np.uint64)
    inv = _U(pow(int(_R), -1, 1 << 64))
    # Blocks of whole words keep the power tables in cache.
    cuts = np.searchsorted(w.start, np.arange(0, n, _POWER_BLOCK))
    cuts = np.unique(np.append(cuts, len(w.start)))
    pw = iv = np.zeros(0, np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s0, e0 = int(w.start[a]), int(w.end[b - 1])
        if len(pw) < e0 - s0 + 1:
            pw, iv = _powers(e0 - s0, _R), _powers(e0 - s0, inv)
        acc = np.zeros(e0 - s0 + 1, np.uint64)
        np.cumsum((w.data[s0:e0].astype(np.uint64) + _U(1)) * pw[:e0 - s0], out=acc[1:])
        s, e = w.start[a:b] - s0, w.end[a:b] - s0
        out[a:b] = (acc[e] - acc[s]) * iv[s]
    return mix(out)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries (runs may cross documents; callers
    keep those inside one): doubling, so log k passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, done = None, h, 0
    bit = 1
    while bit <= k:
        if k & bit:
            part = have[done:done + n]
            out = part.copy() if out is None else mix(out * _U(0x9FB21C651E98DF25) + part)
            done += bit
        bit *= 2
        if bit <= k:
            half = bit // 2
            have = mix(have[:len(have) - half] * _U(0xD1342543DE82EF95) + have[half:])
    return out


def inside_windows(first: np.ndarray, k: int) -> np.ndarray:
    """True for each window start whose k words lie in one document."""
    total = int(first[-1])
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for back in range(1, k):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def slices(offsets: np.ndarray, most: int = 1 << 21, docs: int = 1 << 30):
    """Ranges of at most ``docs`` documents of about ``most`` bytes together; a longer
    document is a range of its own. Keeps the arrays of one step in cache and a task's memory bounded."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), a + docs, n)
        yield a, b
        a = b


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with each text as compressed bytes, for shuffles that move
    whole texts; ``unpack`` gives them back."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), *[f.dataType.simpleString() for f in others]]
    names = ["doc_id", *[f.name for f in others]]

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for b in batches:
            text = [None if t is None else press.compress(t) for t in b.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), *b.columns[1:]], ["text", *names])
    return docs.select("text", *names).mapInArrow(
        run, "text binary, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def unpack(column):
    """Arrow array of texts as bytes from an array of packed texts."""
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else press.decompress(t) for t in column.to_pylist()], pa.large_binary())


def filter_rows(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """Whole rows of docs, all columns as they are, for which ``keep`` holds. ``keep()`` is
    called once in a task and gives a function from an Arrow array of texts to booleans; it
    is handed a part of a batch at a time, which bounds what it and the result hold."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        wanted = keep()
        for whole in batches:
            for first in range(0, whole.num_rows, FILTER_ROWS):
                b = whole.slice(first, FILTER_ROWS)
                yield b.filter(pa.array(np.asarray(wanted(b.column(at)), bool)))
    return docs.mapInArrow(run, docs.schema)
