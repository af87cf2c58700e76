"""Removal of long repeated word spans by De Bruijn graph compaction.

Each run of ``window`` words is an edge of the De Bruijn graph over (window - 1)-word
nodes; an edge is repeated when its words also start earlier (smaller doc_id, or the
same document and an earlier start). Edges one after the other in a text form paths.

A path is cut where its anchor changes: the anchor of an edge is the least hashed
``ANCHOR``-word run in it, so equal edges have equal anchors wherever they stand, and
some eight consecutive edges share one. Such a piece is a nonbranching path that is
known by one hash, and a graph of pieces is an eighth of the graph of edges.

1. Anchors that occur once are in no repeated edge. They are counted (aggregated before
   the shuffle), and only pieces of repeated anchors go on.
2. Equal pieces compact to one: every occurrence but the first is repeated as a whole.
   A batch settles the copies that it holds itself, so a piece that a third of the
   corpus has costs a row per batch.
3. An anchor with several pieces is a branching point. Only there the edges are looked
   at one by one: the first occurrence of each piece is read again from its source
   coordinates, and an edge is repeated when another piece has it earlier.
4. Each document's repeated edges come back to it, at most one entry a word of the
   document; the words they cover are removed.

Null texts have no words. Documents of fewer words than a window lose nothing. Rows
with the same doc_id are told apart by their text (ordered by its hash); equal rows are
one occurrence, so none of them is earlier than the other. Null ids come first. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (inside_windows, materialise, mix, packed_texts, scratch_table, slices, split_words, table, text_bytes, two_columns,
                     unpack, window_hashes, word_hashes)
from .registry import register

WINDOW = 20
ANCHOR = 6

_U = np.uint64
_ROW = 40  # a position is the row's 16 bits and, below them, the word


def _sliding_min(g: np.ndarray, size: int) -> np.ndarray:
    n, have, out = len(g) - size + 1, 1, g
    while have * 2 <= size:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[size - have:size - have + n])


def pieces(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """(anchor, piece, document, first word, edges) of some texts, in text order."""
    none = np.zeros(0, np.int64)
    w = split_words(data, offsets)
    if len(w.start) < window:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    h = word_hashes(w)
    inside = inside_windows(w.first, window)
    edge = window_hashes(h, window)
    least = _sliding_min(window_hashes(h, anchor), window - anchor + 1)[:len(edge)]
    new = np.ones(len(edge), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | ~inside[1:]
    run = np.cumsum(new) - 1
    # A run that repeats an edge in itself (its words are periodic) goes edge by edge.
    span = window - anchor + 1
    odd = np.bincount(run) > span
    for p in range(1, min(span, len(edge))):
        same = edge[:-p] == edge[p:]
        if same.any():
            odd[run[:-p][same]] = odd[run[p:][same]] = True
    new |= odd[run]
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(edge)))
    ok = inside[start]
    start, n = start[ok], n[ok]
    # The first and last edge together hold all words of a piece of at most `window` edges.
    piece = mix(edge[start] * _U(0x9E3779B97F4A7C55) + mix(edge[start + n - 1]) + n.astype(np.uint64))
    doc = np.searchsorted(w.first, start, side="right") - 1
    return least[start], piece, doc, start - w.first[doc], n


def _with_row(docs: DataFrame) -> DataFrame:
    """16 bits of the text tell apart rows with one id (position order stays word order)."""
    return docs.withColumn("row", F.pmod(F.xxhash64("text"), F.lit(1 << 16)))


def _anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_bytes(b.column(0))
            got = [pieces(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], window)[0]
                   for lo, hi in slices(offsets)]
            if got:
                key, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])
    return (docs.where("text is not null").select("text").mapInArrow(run, "anchor bigint, n int")
            .groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, piece, doc_id, at, edges, later); later: the batch has it earlier."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = text_bytes(b.column(1))
            row = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) << _ROW
            place = pc.rank(b.column(0), tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
            got = []
            for lo, hi in slices(offsets):
                anchor, piece, doc, first, n = pieces(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], window)
                got.append((anchor, piece, doc + lo, first + row[doc + lo], n))
            anchor, piece, doc, at, n = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((at, place[doc], piece))
            p, d, x = piece[order], place[doc[order]], at[order]
            first = np.ones(len(p), bool)
            first[1:] = p[1:] != p[:-1]
            lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(p) else order
            later = np.zeros(len(p), bool)
            later[order] = (d != d[lead]) | (x != x[lead])
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), b.column(0).take(pa.array(doc)),
                pa.array(at), pa.array(n.astype(np.int32)), pa.array(later),
            ], ["anchor", "piece", "doc_id", "at", "edges", "later"])
    return docs.where("text is not null").select("doc_id", "text", "row").mapInArrow(
        run, f"anchor bigint, piece bigint, doc_id {kind}, at bigint, edges int, later boolean")


def _edges_of(sources: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, at, edge): the edges of the pieces (doc_id, row, at, edges), read again
    from their texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = sources.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "edges")).alias("wanted"))
    docs = packed_texts(docs)
    both = (docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["row"] == wanted["row"]))
            .select(docs["doc_id"], docs["text"], docs["row"], "wanted"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_bytes(unpack(b.column(1)))
            row = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) << _ROW
            lists = b.column(3)
            ends = np.append(lists.offsets.to_numpy()[:1], lists.offsets.to_numpy()[1:])
            flat_at, flat_n = (lists.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for lo, hi in slices(offsets):
                w = split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                edge = window_hashes(word_hashes(w), window)
                s, e = ends[lo], ends[hi]
                doc = np.repeat(np.arange(lo, hi), np.diff(ends[lo:hi + 1]))
                n = flat_n[s:e]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, doc = np.repeat(flat_at[s:e], n) + step, np.repeat(doc, n)
                where = at - row[doc] + w.first[doc - lo]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(at),
                                                  pa.array(edge[where].view(np.int64))], ["doc_id", "at", "edge"])
    return both.mapInArrow(run, f"doc_id {kind}, at bigint, edge bigint")


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, at, edges): runs of repeated windows; `at & (2^40 - 1)` is the first
    word of the first of `edges` consecutive windows."""
    docs = _with_row(two_columns(docs, id_col, text_col))
    repeated = materialise(_anchor_counts(docs, window)).select(F.col("anchor").alias("key"), F.lit(True).alias("repeated"))
    # Copies that their batch has settled need no partner: they are spread, not sent to
    # their anchor's task.
    key = F.when(F.col("later"), F.xxhash64("doc_id", "at")).otherwise(F.col("anchor"))
    found = _occurrences(docs, window).withColumns({"key": key, "piece": F.when(~F.col("later"), F.col("piece"))}).drop("anchor")
    kept = scratch_table(found.join(repeated, "key", "left").where("later or repeated")
                         .select(F.col("key").alias("anchor"), "piece", "doc_id", "at", "edges", "later"), "paths")
    open_ = kept.where(~F.col("later"))
    paths = scratch_table(open_.groupBy("anchor", "piece").agg(F.min(F.struct("doc_id", "at")).alias("first"),
                                                               F.max("edges").alias("edges")), "first-paths")
    branching = paths.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    branching = materialise(branching)
    row = F.shiftright("at", _ROW).alias("row")
    sources = paths.join(branching, "anchor").select("first.doc_id", "first.at", "edges").select("doc_id", row, "at", "edges")
    edges = scratch_table(_edges_of(sources, docs, window), "edges")
    least = materialise(edges.groupBy("edge").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
                        .where("n > 1").drop("n"))
    single = (edges.join(least, "edge").where(F.struct("doc_id", "at") > F.col("first"))
              .select("doc_id", "at", F.lit(1).alias("edges")))
    copies = (open_.join(paths.select("anchor", "piece", "first"), ["anchor", "piece"])
              .where(F.struct("doc_id", "at") > F.col("first")).select("doc_id", "at", "edges"))
    inside = kept.where("later").select("doc_id", "at", "edges")
    return single.unionAll(copies).unionAll(inside).select("doc_id", row, "at", "edges")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): per row of docs, its words outside repeated
    windows, joined by one space."""
    spans = repeated_spans(docs, window, id_col, text_col)
    docs = packed_texts(_with_row(two_columns(docs, id_col, text_col)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # At most one entry a word of the document.
    per_doc = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "edges")).alias("spans"))
    both = (docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["doc_id"]) & (docs["row"] == per_doc["row"]), "left")
            .select(docs["doc_id"], docs["text"], "spans"))
    mask = (1 << _ROW) - 1

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n_words, n_removed, kept = [], [], []
            lists = b.column(2)
            ends = lists.offsets.to_numpy()
            at, n = (lists.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            # Not str.split: that would also split at other kinds of white space.
            for i, text in enumerate(unpack(b.column(1)).to_pylist()):
                words = (text or b"").split()
                cut = np.zeros(len(words) + 1, np.int64)
                s, e = ends[i], ends[i + 1]
                if e > s and lists[i].is_valid:
                    first = at[s:e] & mask
                    np.add.at(cut, first, 1)
                    np.add.at(cut, first + n[s:e] + window - 1, -1)
                    keep = np.cumsum(cut[:-1]) == 0
                    left = [x for x, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept"])
    return both.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


_W = "regexp_split_to_array(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ')"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL OR trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') = '' THEN []
                 ELSE {_W} END AS w FROM documents),
e AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM e),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM r WHERE n > 1),
per AS (SELECT doc_id, list(i) AS cuts FROM cut GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS text FROM words k
         ANTI JOIN cut c ON c.doc_id = k.doc_id AND c.i = k.i GROUP BY k.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(cuts), 0)::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@register("op8_substring_dedup", ORACLE)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
