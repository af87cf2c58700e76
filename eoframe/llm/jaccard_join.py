"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct k-word shingles (hashed to 52 bits). Two
documents link when ``100 * |A & B| >= t * |A | B|``, so their sets differ in at most
``T = (100 - t) * (|A| + |B|) / (100 + t)`` shingles. Shingles are hashed into groups;
the numbers of shingles per group are the document's point, and the summed coordinate
minima of two points bound the overlap of the two sets from above. Long documents have
more groups, or the bound would let all pairs of them pass; for a pair with points of two
widths the wider one is folded.

In as many dimensions as are needed to tell unrelated documents apart, boxes of an
R-tree over all points overlap nearly everywhere. The tree's top level is therefore
made of cells that cannot miss a pair: the groups are dealt into more than T blocks, so
two linked sets agree in at least one whole block, and documents that agree in a block
(the same sum of hashes) share its cell. Sizes come in levels that share a number of
blocks; a document near a level's edge is put into both.

1. Equal sets are one vertex from the start.
2. Cells: one shuffle of (cell, vertex) rows. Within a batch only a cell's first vertex
   has to meet those of other batches, so a cell of any size costs its task a row a batch.
3. The vertex that shares the most cells is a cell's centre. Edges (centre, member) that
   pass the bound are verified on the words of the two texts: first one edge a member,
   then only edges between different components.
4. Cells whose other members still lie in different components (one cell of those with
   the same members) are packed into leaves of at most LEAF points, whose points are
   compared where they are packed; in cells of several leaves those whose boxes' summed
   minima allow a link are paired, points likewise, and the surviving pairs of different
   components are verified.

Steps are checkpointed, and what a later step does not need is let go as soon as it is
replaced, so that the disks hold the cells or the points of the cells, not both.

The result is exact but for collisions of hashes inside a pair: no link between different
components is left out, and edges inside a component are not expanded.

Null texts and texts without words have the empty set and link with nothing. Documents
with fewer than k words have their whole sequence as their only shingle. Repeated rows
are reported each; rows with a null id take part and are never anyone's component id
unless the whole component has none. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (compact, inside_windows, let_go, lower_ascii, materialise, mix, packed_rows, packed_texts, slices, split_words, table, text_bytes,
                     two_columns, unpack, window_hashes, word_hashes)
from .components import connected_components
from .registry import register

GROUPS = 256    # least coordinates of a point, a power of two
FULL = 4        # most shingles per coordinate, on average, of a longer document's point
LEAF = 256      # points in a leaf of a cell's tree

_U = np.uint64
_DOC_BITS = 12


@dataclass(frozen=True)
class Threshold:
    """Link when 100 * overlap >= percent * union."""

    k: int = 5
    percent: int = 80

    def differ(self, total):
        """Most shingles that two linked sets of ``total`` together can differ in."""
        return (100 - self.percent) * total // (100 + self.percent)

    def overlap(self, total):
        """Fewest shingles that they can share."""
        return -(-self.percent * total // (100 + self.percent))

    def levels(self) -> np.ndarray:
        """Largest difference of each level: 0, then growing by half."""
        out = [0]
        while out[-1] < 1 << 30:
            out.append(out[-1] * 3 // 2 + 1)
        return np.array(out, np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """(document, hash), sorted by both and without repeats: the shingles of at most
    2^_DOC_BITS texts."""
    w = split_words(lower_ascii(data), offsets)
    h, n = word_hashes(w), np.diff(w.first)
    at = np.flatnonzero(inside_windows(w.first, k))
    doc, value = w.doc[at], window_hashes(h, k)[at]
    for size in range(1, k):  # short documents: their whole sequence
        short = np.flatnonzero(n == size)
        if len(short):
            whole = mix(window_hashes(h, size)[w.first[short]] + _U(size))
            doc, value = np.concatenate([doc, short]), np.concatenate([value, whole])
    # One sort of whole numbers: the document above 52 bits of the hash.
    key = np.sort((doc.astype(np.uint64) << _U(64 - _DOC_BITS)) | (value >> _U(_DOC_BITS)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> _U(64 - _DOC_BITS)).astype(np.int64), key << _U(_DOC_BITS)


def _sums(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Per document, the wrapping sum of its values (documents in order)."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    first = np.searchsorted(doc, np.arange(n + 1))
    return total[first[1:]] - total[first[:-1]]


def signatures(doc: np.ndarray, value: np.ndarray, n: int):
    """(vertex, check, size) of each set: two independent 64-bit sums."""
    size = np.bincount(doc, minlength=n).astype(np.int64)
    vertex = mix(_sums(doc, mix(value ^ _U(0x5851F42D4C957F2D)), n) + size.astype(np.uint64))
    check = _sums(doc, mix(value ^ _U(0x14057B7EF767814F)), n)
    return vertex, check, size


def widths(size: np.ndarray) -> np.ndarray:
    """Coordinates of the points of sets of these sizes: powers of two."""
    least = np.maximum(GROUPS, -(-np.asarray(size, np.int64) // FULL))
    return np.left_shift(1, np.ceil(np.log2(least)).astype(np.int64))


def points(doc: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    """Shingles per group, a byte each (255 stands for that or more), of each document."""
    wide = widths(np.bincount(doc, minlength=n))
    start = np.concatenate([[0], np.cumsum(wide)])
    shift = (64 - np.log2(wide)).astype(np.uint64)
    group = ((value * _U(0x9E3779B97F4A7C15)) >> shift[doc]).astype(np.int64)
    return np.split(np.bincount(start[doc] + group, minlength=start[-1]).clip(max=255).astype(np.uint8), start[1:-1]) if n else []


def folded(raw: list[bytes], width: int) -> np.ndarray:
    """Points at a width that is theirs or less: groups that begin alike are one group."""
    out = np.empty((len(raw), width), np.uint8)
    size = np.array([len(x) for x in raw], np.int64)
    for k in np.unique(size).tolist():
        of = np.flatnonzero(size == k)
        p = np.frombuffer(b"".join(raw[i] for i in of), np.uint8).reshape(len(of), width, k // width)
        out[of] = p[:, :, 0] if k == width else p.sum(-1, dtype=np.int64).clip(max=255)
    return out


def far_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the number of shingles in which sets with these points differ.
    |A| + |B| - 2 * (summed minima) is the summed distance; capping coordinates can
    only make it smaller, so it stays a bound."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(-1, dtype=np.int64)


def near_points(i: np.ndarray, j: np.ndarray, p: list[bytes], n: np.ndarray, q: list[bytes], m: np.ndarray, t: Threshold) -> np.ndarray:
    """Which pairs of p[i] (sizes n) and q[j] (sizes m) may link by their points."""
    out = np.zeros(len(i), bool)
    width = np.minimum(widths(n).take(i), widths(m).take(j))
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        (of_a, a), (of_b, b) = (np.unique(x.take(at), return_inverse=True) for x in (i, j))
        one, two = (folded([raw[k] for k in of], w) for raw, of in ((p, of_a), (q, of_b)))
        step = max(1, (1 << 21) // w)
        for s in range(0, len(at), step):
            x, y, of = a[s:s + step], b[s:s + step], at[s:s + step]
            out[of] = far_apart(one.take(x, axis=0), two.take(y, axis=0)) <= t.differ(n.take(i[of]) + m.take(j[of]))
    return out


def cells(doc: np.ndarray, value: np.ndarray, size: np.ndarray, t: Threshold):
    """(cell, document): the cells that each set is put into."""
    levels = t.levels()
    most = size * 100 // t.percent  # the largest partner
    low = np.searchsorted(levels, t.differ(2 * size))
    # A pair's level is that of its larger set: its own, or up to its largest partner's.
    high = np.searchsorted(levels, t.differ(2 * most))
    first = np.searchsorted(doc, np.arange(len(size) + 1))
    spread, out_cell, out_doc = mix(value ^ _U(0x2545F4914F6CDD1D)), [], []
    for level in range(int(low.min(initial=1)), int(high.max(initial=0)) + 1):
        if not level:
            continue  # no difference is allowed: equal sets are one vertex already
        docs = np.flatnonzero((low <= level) & (level <= high) & (size > 0))
        if not len(docs):
            continue
        need = int(levels[level]) + 1
        # More, as a block can be empty: a set with too few filled blocks would share cells
        # with all others that leave the same block empty. A block gets 2.4 shingles or more
        # of a set on average, so at most a tenth are empty, give or take a root.
        blocks = need + 3 + need // 8 + math.isqrt(need)
        n = size[docs]
        at = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        d = np.repeat(np.arange(len(docs)), n)
        block = ((value[at] >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)  # sorted within a document
        start = np.ones(len(at), bool)
        start[1:] = (d[1:] != d[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(start)
        total = np.add.reduceat(spread[at], start)
        salt = (block[start].astype(np.uint64) << _U(8)) + _U(level)
        cell = mix(total + mix(salt)) >> _U(16)  # 48 bits: a collision is a candidate too many
        out_cell.append(cell)
        out_doc.append(docs[d[start]])
        # A set that fills too few blocks may agree with its like in empty blocks only.
        filled = np.bincount(d[start], minlength=len(docs))
        for poor in np.flatnonzero(filled < need):
            empty = np.setdiff1d(np.arange(blocks), block[start][d[start] == poor])
            out_cell.append(mix(mix((empty.astype(np.uint64) << _U(8)) + _U(level)) ^ _U(0x6A09E667F3BCC909)) >> _U(16))
            out_doc.append(np.full(len(empty), docs[poor]))
    if not out_cell:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_cell), np.concatenate(out_doc)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _vertices(docs: DataFrame, t: Threshold) -> DataFrame:
    """(doc_id, row, n_shingles, vertex, check) per row; `row` is a hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets, docs=1 << _DOC_BITS):
                doc, value = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], t.k)
                vertex, check, size = signatures(doc, value, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(size), pa.array(_signed(vertex)),
                    pa.array(_signed(check))], ["doc_id", "row", "n_shingles", "vertex", "check"])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(
        run, f"doc_id {kind}, row bigint, n_shingles bigint, vertex bigint, check bigint")


def _texts(docs: DataFrame, wanted: DataFrame, t: Threshold) -> DataFrame:
    """(vertex, text, n_shingles, point) of the wanted (vertex, doc_id, row); texts packed."""
    rows = packed_texts(docs.withColumn("row", F.xxhash64("text")))
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["row"] == wanted["row"])
    one = Window.partitionBy(wanted["doc_id"], wanted["row"]).orderBy(F.lit(1))  # equal rows once
    both = rows.join(wanted, same).withColumn("n", F.row_number().over(one)).where("n = 1").select("vertex", "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_bytes(unpack(b.column(1)))
            for lo, hi in slices(offsets, docs=1 << _DOC_BITS):
                doc, value = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], t.k)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.bincount(doc, minlength=hi - lo)),
                    pa.array([p.tobytes() for p in points(doc, value, hi - lo)], pa.binary()),
                ], ["vertex", "text", "n_shingles", "point"])
    return both.mapInArrow(run, "vertex bigint, text binary, n_shingles bigint, point binary")


def _members(docs: DataFrame, t: Threshold) -> DataFrame:
    """(cell, vertex, other) of every cell with at least two vertices: each of its vertices
    is in one of the two columns of one of its rows."""
    schema = "cell bigint, vertex bigint, other bigint"

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_bytes(b.column(1))
            got_cell, got_vertex = [], []
            for lo, hi in slices(offsets, docs=1 << _DOC_BITS):
                doc, value = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], t.k)
                vertex, _, size = signatures(doc, value, hi - lo)
                cell, of = cells(doc, value, size, t)
                got_cell.append(cell)
                got_vertex.append(vertex[of])
            if not got_cell:
                continue
            cell, vertex = _signed(np.concatenate(got_cell)), _signed(np.concatenate(got_vertex))
            order = np.lexsort((vertex, cell))
            cell, vertex = cell[order], vertex[order]
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (vertex[1:] != vertex[:-1])
            cell, vertex = cell[new], vertex[new]
            first = np.ones(len(cell), bool)
            first[1:] = cell[1:] != cell[:-1]
            lead = vertex[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(cell) else vertex
            # A cell's first vertex in the batch goes on to meet those of other batches; the
            # rest have met it here and only pass through.
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(vertex), pa.array(lead, mask=first)],
                                             ["cell", "vertex", "other"])

    def meet(batches):
        """Rows come sorted by cell; those without another vertex yet meet the first such
        row of their cell, which may be in an earlier batch."""
        import pyarrow as pa

        at, lead = None, 0
        for b in batches:
            cell, vertex, other = (b.column(i) for i in range(3))
            is_open = other.is_null().to_numpy(zero_copy_only=False)
            done = ~is_open
            c, v = cell.to_numpy()[is_open], vertex.to_numpy()[is_open]
            o = other.fill_null(0).to_numpy()[done]
            out = [(cell.to_numpy()[done], vertex.to_numpy()[done], o)]
            if len(c):
                new = np.ones(len(c), bool)
                new[1:] = c[1:] != c[:-1]
                new[0] = at is None or c[0] != at
                leads = np.concatenate([[lead], v[new]])[np.cumsum(new)]
                met = v != leads
                out.append((c[met], v[met], leads[met]))
                at, lead = c[-1], leads[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                             ["cell", "vertex", "other"])

    dealt = docs.where("text is not null").select("doc_id", "text").mapInArrow(deal, schema)
    # Only open rows have to go to their cell's task; the others are spread.
    route = F.when(F.col("other").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "vertex"))
    return (dealt.repartition(route).sortWithinPartitions("cell").mapInArrow(meet, schema))


def _verified(pairs: DataFrame, texts: DataFrame, t: Threshold) -> DataFrame:
    """Those pairs (a, b) that link, by the sets of the two vertices' texts."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            da, oa = text_bytes(unpack(b.column(2)))
            db, ob = text_bytes(unpack(b.column(3)))
            for lo, hi in slices(oa + ob, docs=1 << _DOC_BITS):
                sets = [shingle_sets(d[o[lo]:o[hi]], o[lo:hi + 1] - o[lo], t.k) for d, o in ((da, oa), (db, ob))]
                size = [np.bincount(doc, minlength=hi - lo) for doc, _ in sets]
                doc, value = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                both = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
                shared = np.bincount(doc[1:][both], minlength=hi - lo)
                keep[lo:hi] = 100 * shared >= t.percent * (size[0] + size[1] - shared)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    one = pairs.join(texts.select(F.col("vertex").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("vertex").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _within_bound(pairs: DataFrame, points_of: DataFrame, t: Threshold) -> DataFrame:
    """Those pairs (a, b) whose sizes and points allow a link."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            each = np.arange(b.num_rows)
            ok = near_points(each, each, b.column(3).to_pylist(), b.column(2).to_numpy(), b.column(5).to_pylist(), b.column(4).to_numpy(), t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    side = [points_of.select(F.col("vertex").alias(v), F.col("n_shingles").alias(f"n_{v}"),
                             F.col("point").alias(f"point_{v}")) for v in ("a", "b")]
    both = pairs.join(side[0], "a").join(side[1], "b")
    near = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * t.percent)
    return both.where(near).select("a", "b", "n_a", "point_a", "n_b", "point_b").mapInArrow(run, "a bigint, b bigint")


def _leaf_pairs(residual: DataFrame, points_of: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b) of different components in one cell that the tree cannot rule out.

    residual(cell, rows, vertex, component, n_shingles), rows being the cell's;
    points_of(vertex, point). A cell of at most LEAF points is a leaf. A larger one is cut
    by size, and each size evenly, so that a cell of any size is spread over tasks. The
    points of a leaf are compared where it is packed, and those of two leaves of a cell,
    if their boxes allow a link, in one numpy step.
    """
    # Number the rows of a cell without gathering a large cell in one task: first within
    # slices of the cell by size, then slices in order. Points come last: they move once.
    whole = F.col("rows") <= LEAF
    sliced = residual.withColumn("slice", F.when(whole, -1).otherwise(F.floor(F.log2("n_shingles") * 8)).cast("int"))
    counts = sliced.where(~whole).groupBy("cell", "slice").agg(F.count("*").alias("of_slice"))
    leaf = F.pmod(F.pmod(F.xxhash64("vertex"), F.lit(1 << 16)), F.ceil(F.col("of_slice") / LEAF))
    leaves = (sliced.join(counts, ["cell", "slice"], "left").withColumn("leaf", F.coalesce(leaf, F.lit(0)))
              .join(points_of, "vertex"))

    def pack(batches):
        """Leaf rows arrive together. Out go the pairs (a, b) inside leaves, many in a row,
        and a row per leaf, with its box, where its cell has others."""
        import pyarrow as pa

        names = ["a", "b", "cell", "slice", "leaf", "vertices", "components", "sizes", "points", "low", "high", "least", "most"]
        longs = pa.list_(pa.int64())
        types = [longs, longs, pa.int64(), pa.int32(), pa.int64(), longs, longs, longs,
                 pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*rows, strict=True), types, strict=True)], names)

        def emit(key, parts):
            """The leaf's pairs, and its row if there is one."""
            vertex, component, n = (np.concatenate([x[c] for x in parts]) for c in range(3))
            p = [raw for x in parts for raw in x[3]]
            i, j = np.triu_indices(len(vertex), 1)
            fit = ((component.take(i) != component.take(j))
                   & (np.minimum(n.take(i), n.take(j)) * 100 >= np.maximum(n.take(i), n.take(j)) * t.percent))
            i, j = i[fit], j[fit]
            hit = near_points(i, j, p, n, p, n, t)
            v, w = vertex.take(i[hit]), vertex.take(j[hit])
            row = None
            if key[1] >= 0:
                box = folded(p, GROUPS)
                row = (None, None, *key, vertex, component, n, p, box.min(0).tobytes(), box.max(0).tobytes(), int(n.min()), int(n.max()))
            return np.stack([np.minimum(v, w), np.maximum(v, w)], 1), row

        def unique(found):
            both = np.unique(np.concatenate(found), axis=0)
            return [(both[s:s + (1 << 12), 0], both[s:s + (1 << 12), 1], *[None] * 11) for s in range(0, len(both), 1 << 12)]

        # Two documents can meet in many cells; what a task finds goes out once at a time.
        key, parts, found, held, out = None, [], [], 0, []

        def close():
            nonlocal held
            pairs, row = emit(key, parts)
            found.append(pairs)
            held += len(pairs)
            out.extend([row] if row else [])
            if held >= 1 << 20:
                out.extend(unique(found))
                found.clear()
                held = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in range(6)]
            point = b.column(6).to_pylist()
            new = np.ones(b.num_rows, bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            cuts = np.append(np.flatnonzero(new), b.num_rows).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(int(c[lo]) for c in cols[:3])
                if here != key:
                    if parts:
                        close()
                    key, parts = here, []
                parts.append((*[c[lo:hi] for c in cols[3:]], point[lo:hi]))
                if len(out) >= 64:
                    yield batch(out)
                    out.clear()
        if parts:
            close()
        if held:
            out.extend(unique(found))
        if out:
            yield batch(out)

    packed = materialise(
        leaves.select("cell", "slice", "leaf", "vertex", "component", "n_shingles", "point")
        .repartition("cell", "slice", "leaf").sortWithinPartitions("cell", "slice", "leaf", "vertex")
        .mapInArrow(pack, "a array<bigint>, b array<bigint>, cell bigint, slice int, leaf bigint, vertices array<bigint>, "
                          "components array<bigint>, sizes array<bigint>, points array<binary>, low binary, high binary, "
                          "least bigint, most bigint"))
    let_go(residual.sparkSession)

    def meet(batches):
        import pyarrow as pa

        def unique(found):
            both = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        found, held = [], 0
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                one, two = ({k: r[f"{k}_{s}"] for k in ("vertices", "components", "sizes", "points", "low", "high", "most")}
                            for s in "ab")
                box = [[np.frombuffer(x[k], np.uint8).astype(np.int32) for k in ("low", "high")] for x in (one, two)]
                # Sets inside the two boxes differ in at least the gaps between them.
                gap = np.maximum(0, np.maximum(box[0][0] - box[1][1], box[1][0] - box[0][1])).sum()
                if gap > t.differ(one["most"] + two["most"]):
                    continue
                p, q = one["points"], two["points"]
                v, w = (np.array(x["vertices"], np.int64) for x in (one, two))
                c, d = (np.array(x["components"], np.int64) for x in (one, two))
                n, m = (np.array(x["sizes"], np.int64) for x in (one, two))
                i, j = np.nonzero((c[:, None] != d) & (np.minimum(n[:, None], m) * 100 >= np.maximum(n[:, None], m) * t.percent))
                hit = near_points(i, j, p, n, q, m, t)
                v, w = v[i[hit]], w[j[hit]]
                found.append(np.stack([np.minimum(v, w), np.maximum(v, w)], 1))
                held += len(v)
                if held >= 1 << 20:
                    yield unique(found)
                    found, held = [], 0
        if held:
            yield unique(found)

    inside = packed.where("a is not null").select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
    boxed = packed.where("a is null").drop("a", "b")
    sides = [boxed.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in boxed.columns if c != "cell"]) for s in "ab"]
    order = ((F.col("slice_a") < F.col("slice_b"))
             | ((F.col("slice_a") == F.col("slice_b")) & (F.col("leaf_a") < F.col("leaf_b"))))
    fits = F.col("least_b") * t.percent <= F.col("most_a") * 100
    between = sides[0].join(sides[1], "cell").where(order & fits).mapInArrow(meet, "a bigint, b bigint")
    return inside.unionAll(between).distinct()


def jaccard_components(docs: DataFrame, t: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_shingles, component_id, first), a row per row of docs: `row` is the
    hash of the text, and `first` marks the row (and its equals) with the component's least
    (doc_id, row)."""
    docs = two_columns(docs, id_col, text_col)
    spark = docs.sparkSession
    nodes = compact(materialise(_vertices(docs, t)))
    real = nodes.where("n_shingles > 0")
    vertices = real.groupBy("vertex").agg(
        F.min(F.struct("doc_id", "row")).alias("rep"), F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n_shingles"), F.max("n_shingles").alias("n_max"),
        F.min("check").alias("check"), F.max("check").alias("check_max"))
    vertices = compact(materialise(vertices))
    if vertices.where("n_shingles <> n_max or check <> check_max").limit(1).count():
        raise RuntimeError("two different shingle sets have one 64-bit signature")
    let_go(spark)
    members = compact(materialise(_members(docs, t)))
    let_go(spark)
    here = compact(materialise(members.select("cell", "vertex")
                       .unionAll(members.select("cell", F.col("other").alias("vertex"))).distinct()))
    del members
    let_go(spark)
    # The text that others are copies of shares the most cells: it is the best centre.
    shared = here.groupBy("vertex").agg(F.count("*").alias("cells"))
    centres = here.join(shared, "vertex").groupBy("cell").agg(F.max(F.struct("cells", "vertex")).alias("centre"))
    spokes = compact(materialise(here.join(centres, "cell").where(F.col("vertex") != F.col("centre.vertex"))
                                 .select("cell", "vertex", F.col("centre.vertex").alias("centre"), "centre.cells")))
    # Texts and points of the vertices that any pair may need.
    wanted = vertices.join(here, "vertex", "left_semi").select("vertex", "rep.doc_id", "rep.row")
    texts = materialise(_texts(docs, wanted, t))
    del here, shared, centres, wanted
    let_go(spark)
    stars = spokes.groupBy(F.col("centre").alias("a"), F.col("vertex").alias("b")).agg(F.max("cells").alias("cells"))
    near = compact(materialise(_within_bound(stars, texts, t).join(stars, ["a", "b"])))
    del stars
    let_go(spark)
    # One edge a member first: most others then lie inside a component.
    first = near.groupBy("b").agg(F.max(F.struct("cells", "a")).alias("c")).select("c.a", "b")
    linked = compact(materialise(_verified(first, texts, t)))
    labels = connected_components(linked)
    del linked
    let_go(spark)
    rest = _across(near.select("a", "b").join(first, ["a", "b"], "left_anti"), labels)
    labels = _joined(labels, compact(materialise(_verified(rest, texts, t))))
    del first, rest
    let_go(spark)
    # Cells that still hold different components, besides their centre, which has met all;
    # of cells with the same vertices one is enough.
    left = _labelled(spokes.select("cell", "vertex"), labels)
    mixed = (left.groupBy("cell").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("rows"),
                                      F.bit_xor(F.xxhash64("vertex")).alias("x"), F.bit_xor(F.xxhash64("vertex", F.lit(1))).alias("y"))
             .where("c0 <> c1").groupBy("rows", "x", "y").agg(F.min("cell").alias("cell")))
    residual = compact(materialise(left.join(mixed.select("cell", "rows"), "cell").join(vertices.select("vertex", "n_shingles"), "vertex")
                                   .select("cell", "rows", "vertex", "component", "n_shingles")))
    del spokes, left, mixed
    let_go(spark)
    tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = compact(materialise(_leaf_pairs(residual, texts.select("vertex", "point"), t).join(tried, ["a", "b"], "left_anti")))
    del residual, tried, near
    let_go(spark)
    labels = _joined(labels, compact(materialise(_verified(pairs, texts, t))))
    del pairs, texts
    let_go(spark)
    of_vertex = (vertices.join(labels.withColumnRenamed("v", "vertex"), "vertex", "left")
                 .select("vertex", "rep", "least_id", F.coalesce("component", "vertex").alias("component")))
    least = of_vertex.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("rep").alias("lead"))
    ids = of_vertex.join(least, "component").select("vertex", "component_id", "lead")
    alone = F.col("n_shingles") == 0
    return (nodes.select("doc_id", "row", "n_shingles", "vertex").join(ids, "vertex", "left")
            .select("doc_id", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    (alone | (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("row") == F.col("lead.row")))).alias("first")))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return (rows.join(labels.withColumnRenamed("v", "vertex"), "vertex", "left")
            .withColumn("component", F.coalesce("component", "vertex")))


def _ends(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs(a, b) with the components c_a and c_b of their ends."""
    side = [labels.select(F.col("v").alias(s), F.col("component").alias(f"c_{s}")) for s in "ab"]
    both = pairs.join(side[0], "a", "left").join(side[1], "b", "left")
    return both.select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    return _ends(pairs, labels).where("c_a <> c_b").select("a", "b")


def _joined(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """labels (v, component) with the links (a, b) that were found after them: only the
    components that these touch are joined anew."""
    if not linked.limit(1).count():
        return labels
    merged = connected_components(_ends(linked, labels).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    to = merged.select(F.col("v").alias("component"), F.col("component").alias("to"))
    moved = labels.join(to, "component", "left").select("v", F.coalesce("to", "component").alias("component"))
    return compact(materialise(moved.unionAll(merged.join(labels, "v", "left_anti"))))


def keep_one(docs: DataFrame, t: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without near copies: of each component the row with the least id
    (of rows with one id, that with the least hash of its text; of equal rows one). Rows
    without words all stay, but equal rows of one id once."""
    def known(ident, text_hash):
        """Columns without nulls that tell rows apart: the join and the window share them."""
        return {"id_": F.coalesce(ident.cast("string"), F.lit("")), "none_": ident.isNull(), "hash_": text_hash}

    key = ["id_", "none_", "hash_"]
    kept = (jaccard_components(docs, t, id_col, text_col).where("first")
            .withColumns(known(F.col("doc_id"), F.col("row"))).select(*key).distinct())
    rows = packed_rows(docs).withColumns(known(F.col(f"row_.`{id_col}`"), F.xxhash64(F.col(f"row_.`{text_col}`"))))
    one = Window.partitionBy(*key).orderBy(F.lit(1))
    return (rows.join(kept, key).withColumn("n_", F.row_number().over(one)).where("n_ = 1").select("row_.*"))


@register("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), Threshold(k=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id")
