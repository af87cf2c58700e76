"""Alignment of two tokenizers' tokens over the bytes of the same text.

A (a byte-level BPE file) and B (a SentencePiece model, which puts a space before the
text) both cut the bytes of space + text into tokens. Interval coalescing: all tokens of
a batch are sorted by where they start, the running maximum of their ends is taken, and
a group breaks where a start reaches it; that is where a token of A and one of B end
together. Inside a group the overlaps are expanded: every stretch between two
neighbouring token ends lies in one token of A and one of B, so a group of m and n tokens
has at most m + n - 1 overlaps and never m * n.

A link is an overlap whose two tokens end together. How often two ids are linked in the
whole corpus is counted in Spark. Ids that are linked often would make hot join keys;
those that hold at least one part in ``FREQUENT`` of all links are at most ``FREQUENT``
and are broadcast, the others are joined by a shuffle, in which no key is hot.

A text has no tokens if it is null or empty, or if the joined bytes of either tokenizer
differ from space + text. Strings of special tokens are plain text. Repeated rows, also
of one id, are each aligned; an empty table gives an empty result; other columns are
ignored, whatever their names. Texts of any length are aligned whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_table, slices, table, text_bytes, two_columns
from .pretokens import PreTokenizer, kept, kept_pretokenizer
from .registry import register
from .sentencepiece import MODEL, SPACE
from .token_counts import TOKENIZER, source_of

FREQUENT = 262_144


def flat_bytes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' bytes in a row, and the end of each (0 before the first)."""
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])


def byte_level_pieces(pre: PreTokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level file: printable Latin-1 characters stand for their
    own byte, the other bytes in turn for the characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
    out = [b""] * pre.tok.get_vocab_size(with_added_tokens=True)
    for piece, i in pre.tok.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(back[c] for c in piece)
    return out


class Tokenizers:
    """Both tokenizers in a worker process, with the bytes of their ids."""

    def __init__(self, source: str, proto: bytes):
        import sentencepiece

        self.a = kept_pretokenizer(source, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.b.get_piece_size()
        self.a_bytes, self.a_end = flat_bytes(byte_level_pieces(self.a))
        self.b_bytes, self.b_end = flat_bytes(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
             for i, p in enumerate(map(self.b.id_to_piece, range(n)))])

    def tile(self, data: np.ndarray, offsets: np.ndarray, texts: list) -> Tiles:
        """Tokens of texts; none for those whose bytes either tokenizer does not give back."""
        size = np.diff(offsets)
        spaced = np.insert(data, offsets[:-1][size > 0], 32)
        ends = offsets + np.concatenate([[0], np.cumsum(size > 0)])
        a, a_first = self.a.token_ids(spaced, ends)
        lists = self.b.encode([t or "" for t in texts], num_threads=1)
        b_first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        b = np.fromiter((i for x in lists for i in x), np.int64, b_first[-1])
        good = gives_back(a, a_first, self.a_bytes, self.a_end, spaced, ends)
        good &= gives_back(b, b_first, self.b_bytes, self.b_end, spaced, ends)
        if not good.all():
            a, a_first = only(a, a_first, good)
            b, b_first = only(b, b_first, good)
        return Tiles(a, a_first, np.diff(self.a_end)[a], b, b_first, np.diff(self.b_end)[b])


def gives_back(ids, first, piece_bytes, piece_end, data, offsets) -> np.ndarray:
    """Per text: do the ids' bytes make up the text's?"""
    n = np.diff(piece_end)[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    same = np.diff(total[first]) == np.diff(offsets)
    joined = piece_bytes[np.repeat(piece_end[ids] - total[:-1], n) + np.arange(total[-1])]
    if same.all():
        wrong = np.concatenate([[0], np.cumsum(joined != data)])[offsets]
        return np.diff(wrong) == 0
    at = total[first]
    return same & np.array([bytes(joined[a:z]) == bytes(data[c:d]) for a, z, c, d in
                            zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)], bool)


def only(ids, first, good):
    """The ids of the good texts; the others have none."""
    n = np.diff(first)
    return ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(np.where(good, n, 0))])


@dataclass
class Tiles:
    """Tokens of both kinds for a run of texts: ids, per text its first one, bytes of each."""

    a: np.ndarray
    a_first: np.ndarray
    a_size: np.ndarray
    b: np.ndarray
    b_first: np.ndarray
    b_size: np.ndarray


class Alignment:
    """Groups and overlaps of Tiles."""

    def __init__(self, t: Tiles):
        self.t = t
        a_end, b_end = np.cumsum(t.a_size), np.cumsum(t.b_size)
        start = np.concatenate([a_end - t.a_size, b_end - t.b_size])
        end = np.concatenate([a_end, b_end])
        order = np.lexsort((np.repeat([0, 1], [len(t.a), len(t.b)]), start))
        reach = np.maximum.accumulate(end[order])
        breaks = np.ones(len(order), bool)
        breaks[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        self.a_group, self.b_group = group[:len(t.a)], group[len(t.a):]
        #: Per text, its first group; one more at the end.
        ends = np.append(self.a_group, self.a_group[-1] + 1 if len(t.a) else 0)
        self.first_group = ends[t.a_first]
        # Every stretch between neighbouring ends is the overlap of one token of each.
        stops = np.sort(end, kind="stable")
        self.stop = stops[np.append(stops[1:] != stops[:-1], True)] if len(stops) else stops
        self.over_a, self.over_b = np.searchsorted(a_end, self.stop), np.searchsorted(b_end, self.stop)
        self.together = (a_end[self.over_a] == self.stop) & (b_end[self.over_b] == self.stop)
        self.over_size = np.diff(np.concatenate([[0], self.stop]))

    def links(self):
        """(text, token of A, token of B) of the overlaps whose tokens end together."""
        a, b = self.over_a[self.together], self.over_b[self.together]
        return np.searchsorted(self.t.a_first, a, side="right") - 1, a, b

    def group_texts(self) -> list[bytes]:
        """Per text ``a1,a2|b1;a3|b2,b3``: the ids of its groups in order."""
        t = self.t
        n_a, n_b = np.bincount(self.a_group), np.bincount(self.b_group)
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        a_at = np.arange(len(t.a)) + (upto_b - n_b)[self.a_group]
        b_at = np.arange(len(t.b)) + upto_a[self.b_group]
        mark_a, mark_b = np.full(len(t.a), ord(","), np.uint64), np.full(len(t.b), ord(","), np.uint64)
        mark_a[upto_a - 1] = ord("|")
        mark_b[upto_b - 1] = ord(";")
        last = t.b_first[1:][np.diff(t.b_first) > 0] - 1
        mark_b[last] = 0
        digits = kept("digits", decimal_table)
        cells = np.empty(len(t.a) + len(t.b), np.uint64)
        cells[a_at] = digits[t.a] | mark_a << np.uint64(56)
        cells[b_at] = digits[t.b] | mark_b << np.uint64(56)
        flat = cells.view(np.uint8)
        used = flat != 0
        ends = np.concatenate([[0], np.cumsum(used.reshape(-1, 8).sum(axis=1))])[t.a_first + t.b_first]
        out = flat[used].tobytes()
        return [out[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decimal_table(most: int = 1 << 18) -> np.ndarray:
    """Each number's decimal digits as the bytes of an integer, zeros after them."""
    return np.array([int.from_bytes(str(i).encode(), "little") for i in range(most)], np.uint64)


def _alignments(batches, shipped):
    """(batch, lo, hi, alignment) of slices of a batch whose last column holds the texts."""
    source, proto = shipped.value
    name = hashlib.sha256(source.encode() + proto).hexdigest()
    both = kept(f"tokenizers-{name}", lambda: Tokenizers(source, proto))
    for b in batches:
        column = b.column(b.num_columns - 1)
        data, offsets = text_bytes(column)
        for lo, hi in slices(offsets, most=1 << 20):
            tiles = both.tile(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo],
                              column.slice(lo, hi - lo).to_pylist())
            yield b, lo, hi, Alignment(tiles)


def _ship(spark: SparkSession, tokenizer_path: str, model_path: str):
    with open(model_path, "rb") as f:
        proto = f.read()
    return spark.sparkContext.broadcast((source_of(tokenizer_path), proto))  # the two files, 2 MB


def align(docs: DataFrame, tokenizer_path: str = TOKENIZER, model_path: str = MODEL,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_group, b_group, overlaps): the ids of both tokenizers, the
    group of each token, and the overlaps (positions of the two tokens, their common
    bytes, whether they end together)."""
    docs = two_columns(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shipped = _ship(docs.sparkSession, tokenizer_path, model_path)

    def run(batches):
        import pyarrow as pa

        def lists(values, first):
            return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))
        for b, lo, hi, al in _alignments(batches, shipped):
            t = al.t
            text = np.searchsorted(t.a_first, al.over_a, side="right") - 1
            first = np.searchsorted(text, np.arange(hi - lo + 1))
            overlaps = pa.StructArray.from_arrays(
                [pa.array((al.over_a - t.a_first[text]).astype(np.int32)), pa.array((al.over_b - t.b_first[text]).astype(np.int32)),
                 pa.array(al.over_size.astype(np.int32)), pa.array(al.together)], ["a", "b", "n_bytes", "together"])
            base_a = np.repeat(al.first_group[:-1], np.diff(t.a_first))
            base_b = np.repeat(al.first_group[:-1], np.diff(t.b_first))
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(lo, hi - lo), lists(t.a, t.a_first), lists(t.b, t.b_first),
                lists(al.a_group - base_a, t.a_first), lists(al.b_group - base_b, t.b_first),
                pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), overlaps),
            ], ["doc_id", "a_ids", "b_ids", "a_group", "b_group", "overlaps"])
    return docs.mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_group array<int>, "
                                "b_group array<int>, overlaps array<struct<a: int, b: int, n_bytes: int, together: boolean>>")


def linked_documents(docs: DataFrame, tokenizer_path: str = TOKENIZER, model_path: str = MODEL,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_no, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a_ids, b_ids, times) as a
    written table: the last three list a document's linked id pairs and how often it has each."""
    docs = two_columns(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shipped = _ship(docs.sparkSession, tokenizer_path, model_path)

    def run(batches):
        import pyarrow as pa

        for b, lo, hi, al in _alignments(batches, shipped):
            t = al.t
            text, a, z = al.links()
            # One sort per slice: text, id of A and id of B in 64 bits.
            pair, times = np.unique(text << 40 | t.a[a] << 20 | t.b[z], return_counts=True)
            first = np.searchsorted(pair >> 40, np.arange(hi - lo + 1)).astype(np.int32)
            shas = [hashlib.sha256(x).hexdigest() if x else "" for x in al.group_texts()]
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                pa.array(np.diff(t.a_first)), pa.array(np.diff(t.b_first)), pa.array(np.diff(al.first_group)),
                pa.array(np.bincount(text, minlength=hi - lo)), pa.array(shas, pa.string()),
                *[pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32)))
                  for x in (pair >> 20 & 0xFFFFF, pair & 0xFFFFF, times)],
            ], ["row_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ids", "b_ids", "times"])
    return scratch_table(docs.mapInArrow(
        run, f"row_no bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
             "groups_sha256 string, a_ids array<int>, b_ids array<int>, times array<int>"), "aligned")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, n, best): corpus-wide links of two ids; best: no other id of A is linked to b
    more often. An id of B has at most as many rows as A has ids."""
    pairs = linked.select(F.explode(F.arrays_zip("a_ids", "b_ids", "times")).alias("p"))
    n = pairs.groupBy(F.col("p.a_ids").alias("a"), F.col("p.b_ids").alias("b")).agg(F.sum("p.times").alias("n"))
    top = F.max("n").over(Window.partitionBy("b"))
    return scratch_table(n.select("a", "b", "n", (F.col("n") == top).alias("best")), "pairs")


def link_statistics(linked: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """linked without its lists, with n_best and count_sum: a document's links that are
    best for their id of B, and the sum of its links' counts."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_frequent = F.col("n") * frequent >= total
    rows = counts.where(is_frequent).collect()  # at most ``frequent`` rows
    key = np.array([r["a"] << 20 | r["b"] for r in rows], np.int64)
    order = np.argsort(key)
    shipped = linked.sparkSession.sparkContext.broadcast(
        (key[order], np.array([r["n"] for r in rows], np.int64)[order], np.array([r["best"] for r in rows], bool)[order]))
    plain = ["row_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = [linked.schema[c].dataType.simpleString() for c in plain]

    def run(batches):
        import pyarrow as pa

        key, n, best = shipped.value
        for b in batches:
            first = b.column("times").offsets.to_numpy().astype(np.int64)
            a, z, times = (b.column(c).values.to_numpy()[first[0]:first[-1]].astype(np.int64) for c in ("a_ids", "b_ids", "times"))
            first = first - first[0]
            at = np.minimum(np.searchsorted(key, a << 20 | z), max(len(key) - 1, 0))
            hit = key[at] == (a << 20 | z) if len(key) else np.zeros(len(a), bool)
            at = np.where(hit, at, 0)
            sums = [np.concatenate([[0], np.cumsum(np.where(hit, times * x[at], 0) if len(key) else times * 0)])[first]
                    for x in (best, n)]
            kept_first = np.concatenate([[0], np.cumsum(~hit)])[first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                *[b.column(c) for c in plain], pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1])),
                *[pa.ListArray.from_arrays(pa.array(kept_first), pa.array(x[~hit].astype(np.int32))) for x in (a, z, times)],
            ], [*plain, "n_best", "count_sum", "a_ids", "b_ids", "times"])
    partly = scratch_table(linked.mapInArrow(
        run, ", ".join(f"{c} {k}" for c, k in zip(plain, kinds, strict=True))
        + ", n_best bigint, count_sum bigint, a_ids array<int>, b_ids array<int>, times array<int>"), "partly")
    rare = partly.select("row_no", F.explode(F.arrays_zip("a_ids", "b_ids", "times")).alias("p"))
    rare = rare.select("row_no", F.col("p.a_ids").alias("a"), F.col("p.b_ids").alias("b"), F.col("p.times").alias("times"))
    sums = (rare.join(counts.where(~is_frequent), ["a", "b"]).groupBy("row_no")
            .agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    return partly.join(sums, "row_no", "left").select(
        *plain[1:], (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


@register("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = linked_documents(table(spark, sf_dir, "documents"))
    return link_statistics(linked, pair_counts(linked)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
