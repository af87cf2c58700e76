"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a compact hash table, broadcast: the number of tokens of each frequent
pre-token. A pre-token is frequent when it makes up at least one part in ``TABLE`` of all
pre-tokens of the corpus, so the table has at most ``TABLE`` entries at any size. Its keys
are the pre-tokens' own bytes (at most 16), so a hit is exact. Tier two is a bounded
cache in each worker process; what it lacks, the tokenizer library encodes. No pre-token
of a text is shuffled: a document's count is a sum over its own pre-tokens.

The frequent ones are found in a pass over all documents: each task keeps a mergeable
summary of bounded size (counts of the heaviest pre-tokens, the count of the lightest
taken off all when it is full), and only the summaries meet. They can miss a pre-token
near the border, which costs time and never changes a count. ``count_tokens`` also takes
the table of an earlier run.

Null and empty texts have no tokens and no bytes. Strings of the file's special tokens
count as the library counts them by default, as one token. Repeated rows are each
counted; an empty table gives an empty result; other columns are ignored, whatever their
names. Texts of any length are counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_table, slices, table, text_bytes, two_columns
from .pretokens import KEY_BYTES, PreTokenizer, keys, kept_pretokenizer, slot_hash
from .registry import register

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LIMIT = 1024
TABLE = 65_536      # most entries of the broadcast table
SUMMARY = 16_384    # pre-tokens that a task reports

_U = np.uint64


@dataclass
class LengthTable:
    """Open addressing with linear probing; a slot of size 0 is free."""

    k1: np.ndarray
    k2: np.ndarray
    size: np.ndarray
    tokens: np.ndarray
    reach: int = 0      # most steps from a key's own slot

    @classmethod
    def build(cls, pretokens: list[bytes], lengths) -> LengthTable:
        slots = 16
        while slots < 2 * len(pretokens):
            slots *= 2
        t = cls(np.zeros(slots, _U), np.zeros(slots, _U), np.zeros(slots, np.uint8), np.zeros(slots, np.uint8))
        size = np.array([len(p) for p in pretokens], np.int64)
        start = np.cumsum(size) - size
        k1, k2 = keys(np.frombuffer(b"".join(pretokens), np.uint8), start, size)
        own = (slot_hash(k1, k2, size) & _U(slots - 1)).astype(np.int64)
        for i, at in enumerate(own.tolist()):
            step = 0
            while t.size[(at + step) % slots]:
                step += 1
            s = (at + step) % slots
            t.k1[s], t.k2[s], t.size[s], t.tokens[s] = k1[i], k2[i], size[i], lengths[i]
            t.reach = max(t.reach, step)
        return t

    def lookup(self, k1: np.ndarray, k2: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each key, 0 where the table has none."""
        mask = len(self.size) - 1
        slot = (slot_hash(k1, k2, size) & _U(mask)).astype(np.int64)
        out = np.zeros(len(k1), np.int64)
        open_ = np.arange(len(k1))
        for _ in range(self.reach + 1):
            s = slot[open_]
            hit = (self.k1[s] == k1[open_]) & (self.k2[s] == k2[open_]) & (self.size[s] == size[open_])
            out[open_[hit]] = self.tokens[s[hit]]
            open_ = open_[~hit & (self.size[s] > 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & mask
        return out


def source_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _pieces(batches, column: int):
    """(lo, hi, data, offsets, batch) of slices of texts."""
    for b in batches:
        data, offsets = text_bytes(b.column(column))
        for lo, hi in slices(offsets):
            yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], b


def merge_summary(total: dict[bytes, int], more: dict[bytes, int], most: int) -> dict[bytes, int]:
    """Counts of both; when more than ``most`` are held, the largest count left out is
    taken off every other, so a kept count is too low by at most all counts / most."""
    for p, n in more.items():
        total[p] = total.get(p, 0) + n
    if len(total) <= most:
        return total
    off = sorted(total.values(), reverse=True)[most]
    return {p: n - off for p, n in total.items() if n > off}


def frequent_pretokens(docs: DataFrame, tokenizer_path: str = TOKENIZER, text_col: str = "text",
                       most: int = TABLE, summary: int = SUMMARY) -> list[bytes]:
    """At most ``most`` pre-tokens, each at least one part in ``most`` of all."""
    source = source_of(tokenizer_path)

    def run(batches):
        import pyarrow as pa

        pre, held, seen = kept_pretokenizer(source), {}, 0
        for _, _, data, offsets, _ in _pieces(batches, 0):
            start, end, _ = pre.split(data, offsets)
            seen += len(start)
            short = end - start <= KEY_BYTES
            start, end = start[short], end[short]
            h = slot_hash(*keys(data, start, end - start), end - start)
            _, at, n = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            held = merge_summary(held, {raw[s:e]: x for s, e, x in
                                        zip(start[at].tolist(), end[at].tolist(), n.tolist(), strict=True)}, 4 * summary)
        held = merge_summary({}, held, summary)
        yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.binary()),
                                          pa.array([seen, *held.values()], pa.int64())], ["pretoken", "n"])

    found = scratch_table(docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "pretoken binary, n bigint")
                          .groupBy("pretoken").agg(F.sum("n").alias("n")), "pretokens")
    # The row without a pre-token has the number of all.
    every = found.where("pretoken is null").first()
    if every is None:
        return []
    rows = found.where(F.col("pretoken").isNotNull() & (F.col("n") * most >= F.lit(every["n"])))
    return sorted(bytes(r["pretoken"]) for r in rows.select("pretoken").collect())


def length_table(pretokens: list[bytes], tokenizer_path: str = TOKENIZER) -> LengthTable:
    lengths = [len(x) for x in PreTokenizer(source_of(tokenizer_path), True).encode_each(pretokens)]
    return LengthTable.build(pretokens, lengths)


def count_tokens(docs: DataFrame, tokenizer_path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, frequent: list[bytes] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_pretokens, n_looked_up) per row; the last
    is the number of pre-tokens that tier one answered."""
    docs = two_columns(docs, id_col, text_col)
    if frequent is None:
        frequent = frequent_pretokens(docs, tokenizer_path)
    source = source_of(tokenizer_path)
    # Some megabytes at most, whatever the data: TABLE entries and the tokenizer file.
    shipped = docs.sparkSession.sparkContext.broadcast((source, length_table(frequent, tokenizer_path)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        source, lengths = shipped.value
        pre = kept_pretokenizer(source)
        for lo, hi, data, offsets, b in _pieces(batches, 1):
            start, end, first = pre.split(data, offsets)
            size = end - start
            k1, k2 = keys(data, start, size)
            n = np.where(size <= KEY_BYTES, lengths.lookup(k1, k2, size), 0)
            missed = np.flatnonzero(n == 0)
            if len(missed):
                raw = data.tobytes()
                n[missed] = pre.lengths([raw[s:e] for s, e in
                                         zip(start[missed].tolist(), end[missed].tolist(), strict=True)])
            tokens = np.diff(np.concatenate([[0], np.cumsum(n)])[first])
            known = np.diff(np.concatenate([[0], np.cumsum(size <= KEY_BYTES)])[first])
            known -= np.diff(np.searchsorted(missed[size[missed] <= KEY_BYTES], first))
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit),
                pa.array(np.diff(first)), pa.array(known),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_pretokens", "n_looked_up"])
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, "
                                "n_pretokens bigint, n_looked_up bigint")


@register("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
