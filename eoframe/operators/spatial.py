"""Which boxes of two tables overlap, by an adaptive space partition.

Many scenes share one footprint, so each side is first reduced to its distinct boxes
with their number of rows. A quadtree over a bounded sample of the boxes cuts the plane
where they are dense; a box goes to every leaf it meets. Inside a leaf a plane sweep
along x finds the overlaps, and a pair counts only in the leaf that holds the lower left
corner of its intersection. A leaf that the tree could not split (boxes around one point)
is cut into blocks, so no task holds more than a block of each side.

Edges are closed. A box with a null or NaN edge, or one whose edges are in the wrong
order, overlaps nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ("minx", "miny", "maxx", "maxy")
SAMPLE_BOXES = 100_000   # bound of the sample the tree is built from
MOST_LEAVES = 16_384     # bound of the tree, which every task holds
LEAF_BOXES = 4_096       # boxes of a leaf, and of a block of a leaf that cannot be split
MAX_DEPTH = 40
_PAIRS_AT_ONCE = 1 << 20


@dataclass
class QuadTree:
    """Inner nodes split the plane at (x, y) into four children; leaves have child -1.

    West of a split is ``< x``, south is ``< y``, so every point has exactly one leaf.
    """

    x: np.ndarray
    y: np.ndarray
    child: np.ndarray  # of the south-west; south-east, north-west, north-east follow it

    @classmethod
    def build(cls, boxes: np.ndarray, per_leaf: int, most_leaves: int = MOST_LEAVES) -> QuadTree:
        """From an (n, 4) array: nodes with the most boxes split first, at the middle of
        their cell. A split that would send each box into most children is not made."""
        import heapq

        x, y, child, leaves = [0.0], [0.0], [-1], 1
        if len(boxes):
            cell = (boxes[:, 0].min(), boxes[:, 1].min(), boxes[:, 2].max(), boxes[:, 3].max())
            heap = [(-len(boxes), 0, 0, cell, boxes)]
            while heap and leaves + 3 <= most_leaves:
                n, node, depth, (x0, y0, x1, y1), inside = heapq.heappop(heap)
                if -n <= per_leaf or depth >= MAX_DEPTH:
                    continue
                mx, my = (x0 + x1) / 2, (y0 + y1) / 2
                west, east = inside[:, 0] < mx, inside[:, 2] >= mx
                south, north = inside[:, 1] < my, inside[:, 3] >= my
                parts = [inside[a & b] for b in (south, north) for a in (west, east)]
                if sum(map(len, parts)) > 2 * len(inside):
                    continue
                x[node], y[node], child[node] = mx, my, len(x)
                cells = [(x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)]
                for c, p in zip(cells, parts, strict=True):
                    heapq.heappush(heap, (-len(p), len(x), depth + 1, c, p))
                    x.append(0.0)
                    y.append(0.0)
                    child.append(-1)
                leaves += 3
        return cls(np.array(x), np.array(y), np.array(child))

    def leaves(self, minx, miny, maxx, maxy) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) for every leaf that each box meets."""
        box, node = np.arange(len(minx)), np.zeros(len(minx), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(box):
            at_leaf = self.child[node] < 0
            done.append((box[at_leaf], node[at_leaf]))
            box, node = box[~at_leaf], node[~at_leaf]
            west, east = minx[box] < self.x[node], maxx[box] >= self.x[node]
            south, north = miny[box] < self.y[node], maxy[box] >= self.y[node]
            into = [(a & b, 2 * j + i) for j, b in enumerate((south, north)) for i, a in enumerate((west, east))]
            first = self.child[node]
            box, node = (np.concatenate([box[m] for m, _ in into]),
                         np.concatenate([first[m] + k for m, k in into]))
        return (np.concatenate([b for b, _ in done]), np.concatenate([n for _, n in done])) if done else (box, node)

    def leaf_of(self, x, y) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.child[node] >= 0)
        while len(inner):
            n = node[inner]
            node[inner] = self.child[n] + (x[inner] >= self.x[n]) + 2 * (y[inner] >= self.y[n])
            inner = inner[self.child[node[inner]] >= 0]
        return node


def distinct_boxes(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(minx, miny, maxx, maxy, first_id, n): each different box once."""
    ok = F.lit(True)
    for c in BOX:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    boxes = df.filter(ok & (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")))
    return (boxes.groupBy(*[F.col(c).cast("double").alias(c) for c in BOX])
                 .agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")))


def sample_tree(boxes: DataFrame, per_leaf: int = LEAF_BOXES, sample_boxes: int = SAMPLE_BOXES,
                most_leaves: int = MOST_LEAVES) -> QuadTree:
    """The quadtree of about ``sample_boxes`` boxes chosen by their hash. Leaves hold about
    ``per_leaf`` boxes of the whole table, more where that would need over ``most_leaves``."""
    n = boxes.count()
    sample = boxes.select(*BOX)
    if n > sample_boxes:
        share = int((1 << 30) * sample_boxes / n)
        sample = sample.filter(F.pmod(F.xxhash64(*BOX), F.lit(1 << 30)) < share)
    rows = np.array([tuple(r) for r in sample.collect()], float).reshape(-1, 4)
    return QuadTree.build(rows, max(1, per_leaf * len(rows) // max(1, n)), most_leaves)


def sweep(a: np.ndarray, b: np.ndarray):
    """Plane sweep along x over two (n, 4) arrays, blocks of (index in a, index in b).

    A pair is met once: at the box that starts later, or at b's when both start together.
    """
    for one, two, flip, side in ((a, b, False, "left"), (b, a, True, "right")):
        order = np.argsort(two[:, 0], kind="stable")
        start = two[order, 0]
        lo, hi = np.searchsorted(start, one[:, 0], side), np.searchsorted(start, one[:, 2], "right")
        n = np.maximum(hi - lo, 0)
        stop = np.cumsum(n)
        at = 0
        while at < len(one):
            z = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + _PAIRS_AT_ONCE, "right")))
            i = np.repeat(np.arange(at, z), n[at:z])
            j = order[np.arange(len(i)) - np.repeat(stop[at:z] - n[at:z] - (stop[at - 1] if at else 0), n[at:z]) + lo[i]]
            meets = (one[i, 1] <= two[j, 3]) & (two[j, 1] <= one[i, 3])
            yield (j[meets], i[meets]) if flip else (i[meets], j[meets])
            at = z


def _in_leaves(boxes: DataFrame, tree: QuadTree, side: int) -> DataFrame:
    """(leaf, side, minx, miny, maxx, maxy, first_id, n): a row for each leaf a box meets."""
    kind = boxes.schema["first_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            edges = [b.column(c).to_numpy(zero_copy_only=False) for c in BOX]
            box, leaf = tree.leaves(*edges)
            rows = b.take(pa.array(box))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(np.full(len(leaf), side, np.int32)),
                                              *rows.columns], ["leaf", "side", *b.schema.names])
    return boxes.select(*BOX, "first_id", "n").mapInArrow(
        run, f"leaf int, side int, minx double, miny double, maxx double, maxy double, first_id {kind}, n bigint")


def _sweep_leaves(a: DataFrame, b: DataFrame, emit: Callable, schema: str, per_leaf: int) -> DataFrame:
    """``emit(rows of a, rows of b, index pairs)`` for the overlaps of distinct boxes, leaf
    by leaf, each pair once."""
    from ..session import cut_lineage

    a, b = cut_lineage(a), cut_lineage(b)
    both = a.select(*BOX).unionByName(b.select(*BOX))
    tree = sample_tree(both, per_leaf)
    rows = _in_leaves(a, tree, 0).unionByName(_in_leaves(b, tree, 1))
    # Blocks of a leaf, by its number of boxes: at most one row per leaf of the tree.
    size = rows.groupBy("leaf").agg(*[F.ceil(F.count_if(F.col("side") == s) / F.lit(2 * per_leaf)).alias(f"_blocks{s}")
                                      for s in (0, 1)])
    rows = rows.join(size.filter("_blocks0 > 0 and _blocks1 > 0"), "leaf")
    own = F.pmod(F.xxhash64(*BOX), F.when(F.col("side") == 0, F.col("_blocks0")).otherwise(F.col("_blocks1")))
    other = F.explode(F.sequence(F.lit(0).cast("long"),
                                 F.when(F.col("side") == 0, F.col("_blocks1")).otherwise(F.col("_blocks0")) - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", other)
    first = F.when(F.col("side") == 0, F.col("_own")).otherwise(F.col("_other")).alias("_i")
    second = F.when(F.col("side") == 0, F.col("_other")).otherwise(F.col("_own")).alias("_j")
    rows = rows.select("leaf", first, second, "side", *BOX, "first_id", "n")

    def run(table):
        import pyarrow as pa

        leaf = table.column("leaf")[0].as_py()
        sides = [table.filter(pa.compute.equal(table.column("side"), s)) for s in (0, 1)]
        x, y = (np.stack([t.column(c).to_numpy() for c in BOX], axis=1) for t in sides)
        out = []
        for i, j in sweep(x, y):
            here = tree.leaf_of(np.maximum(x[i, 0], y[j, 0]), np.maximum(x[i, 1], y[j, 1])) == leaf
            out.append(emit(sides[0], sides[1], i[here], j[here]))
        return pa.concat_tables(out)
    return rows.groupBy("leaf", "_i", "_j").applyInArrow(run, schema)


def overlapping_distinct_boxes(a: DataFrame, b: DataFrame, per_leaf: int = LEAF_BOXES) -> DataFrame:
    """(id_a, id_b, n_a, n_b, both boxes, minx, miny, maxx, maxy) of every two different
    boxes that overlap: the least id of each, how many rows have it, and the intersection."""
    a, b = distinct_boxes(a), distinct_boxes(b)
    kinds = [d.schema["first_id"].dataType.simpleString() for d in (a, b)]

    def emit(ta, tb, i, j):
        import pyarrow as pa

        xa, xb = (pa.Table.take(t, pa.array(k)) for t, k in ((ta, i), (tb, j)))
        cut = [np.maximum, np.maximum, np.minimum, np.minimum]
        return pa.table([xa["first_id"], xb["first_id"], xa["n"], xb["n"], *[xa[c] for c in BOX], *[xb[c] for c in BOX],
                         *[pa.array(f(xa[c].to_numpy(), xb[c].to_numpy())) for c, f in zip(BOX, cut, strict=True)]],
                        names=names)
    names = ["id_a", "id_b", "n_a", "n_b", *[f"{c}_a" for c in BOX], *[f"{c}_b" for c in BOX], *BOX]
    schema = (f"id_a {kinds[0]}, id_b {kinds[1]}, n_a bigint, n_b bigint, "
              + ", ".join(f"{c} double" for c in names[4:]))
    return _sweep_leaves(a, b, emit, schema, per_leaf)


def overlapping_boxes(a: DataFrame, b: DataFrame, per_leaf: int = LEAF_BOXES) -> DataFrame:
    """(id_a, id_b, minx, miny, maxx, maxy) of all overlapping rows: the pairs of
    different boxes, joined with the rows that have them. Grows with the number of pairs;
    ``overlap_counts`` and ``overlapping_distinct_boxes`` do not."""
    pairs = overlapping_distinct_boxes(a, b, per_leaf).drop("id_a", "id_b", "n_a", "n_b")
    for df, tag in ((a, "a"), (b, "b")):
        own = df.select(F.col("id").alias(f"id_{tag}"), *[F.col(c).cast("double").alias(f"{c}_{tag}") for c in BOX])
        pairs = pairs.join(own, [f"{c}_{tag}" for c in BOX])
    return pairs.select("id_a", "id_b", *BOX)


def overlap_counts(a: DataFrame, b: DataFrame, per_leaf: int = LEAF_BOXES) -> DataFrame:
    """(id, n_overlaps, first_overlap) for every row of ``a``: how many rows of ``b``
    overlap it and the least id of those (null and 0 where none does). Leaves report sums
    per box, so nothing grows with the number of pairs."""
    boxes = distinct_boxes(a)
    other = distinct_boxes(b)
    kind = other.schema["first_id"].dataType.simpleString()

    def emit(ta, tb, i, j):
        import pyarrow as pa

        found = pa.table([*[ta[c].take(pa.array(i)) for c in BOX], tb["n"].take(pa.array(j)), tb["first_id"].take(pa.array(j))],
                         names=[*BOX, "n", "first_id"])
        sums = found.group_by(list(BOX)).aggregate([("n", "sum"), ("first_id", "min")])
        return sums.select([*BOX, "n_sum", "first_id_min"]).rename_columns([*BOX, "_n", "_first"])
    part = _sweep_leaves(boxes, other, emit, ", ".join(f"{c} double" for c in BOX) + f", _n bigint, _first {kind}", per_leaf)
    sums = part.groupBy(*BOX).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    rows = a.select(F.col("id").alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX])
    return rows.join(sums, list(BOX), "left").select(
        "id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_overlaps"), F.col("_first").alias("first_overlap"))
