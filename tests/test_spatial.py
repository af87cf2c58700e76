"""Box overlaps: tree, sweep and counts against all pairs, with odd boxes."""

import numpy as np
import pytest

from eoframe.operators import spatial

NAN = float("nan")


def made(n, seed):
    r = np.random.default_rng(seed)
    at, size = np.round(r.normal(0, 10, (n, 2)), 1), np.round(r.exponential(2, (n, 2)), 1)
    boxes = np.concatenate([at, at + size], 1)
    boxes[:n // 5] = [1, 1, 3, 3]          # one footprint of many scenes
    boxes[n // 5] = [-500, -500, 500, 500]  # meets every leaf
    return boxes


def truth(a, b):
    return sorted((i, j) for i in range(len(a)) for j in range(len(b))
                  if a[i, 0] <= b[j, 2] and b[j, 0] <= a[i, 2] and a[i, 1] <= b[j, 3] and b[j, 1] <= a[i, 3])


def frame(spark, boxes, odd=()):
    rows = [(i, *map(float, r), "kept") for i, r in enumerate(boxes)] + [(900 + i, *r, "odd") for i, r in enumerate(odd)]
    return spark.createDataFrame(rows, "id long, minx double, miny double, maxx double, maxy double, leaf string")


def test_sweep_meets_each_pair_once():
    a, b = made(150, 1), made(170, 2)
    got = sorted((int(i), int(j)) for x, y in spatial.sweep(a, b) for i, j in zip(x, y))
    assert got == truth(a, b)
    assert sum(len(x) for x, _ in spatial.sweep(a[:0], b)) == 0 == sum(len(x) for x, _ in spatial.sweep(a, b[:0]))


def test_leaves_hold_their_points():
    boxes = made(400, 3)
    tree = spatial.QuadTree.build(boxes, 8)
    assert len(tree.x) > 20
    held = set(zip(*(x.tolist() for x in tree.leaves(*boxes.T))))
    for x, y in ((boxes[:, 0], boxes[:, 1]), (boxes[:, 2], boxes[:, 3]), (boxes[:, 0], boxes[:, 3])):
        assert {(i, n) for i, n in enumerate(tree.leaf_of(x, y).tolist())} <= held
    same = spatial.QuadTree.build(np.tile([1.0, 1, 2, 2], (500, 1)), 8)
    assert len(same.x) == 1 or len(same.leaves(*np.tile([1.0, 1, 2, 2], (1, 1)).T)[0]) <= 4  # copies are not cut apart


@pytest.mark.parametrize("per_leaf", [6, 4096])  # 6: leaves are also cut into blocks
def test_overlaps_equal_all_pairs(spark, per_leaf):
    a, b = made(120, 1), made(140, 2)
    odd = [(None, 0.0, 1.0, 1.0), (NAN, 0.0, 1.0, 1.0), (3.0, 0.0, 1.0, 1.0), (0.0, 0.0, None, 1.0)]
    da, db = frame(spark, a, odd), frame(spark, b, odd)
    want = truth(a, b)
    assert sorted((r.id_a, r.id_b) for r in spatial.overlapping_boxes(da, db, per_leaf).collect()) == want
    met = {}
    for i, j in want:
        met.setdefault(i, []).append(j)
    got = {r.id: (r.n_overlaps, r.first_overlap) for r in spatial.overlap_counts(da, db, per_leaf).collect()}
    assert got == {i: (len(met[i]), min(met[i])) if i in met else (0, None) for i in [*range(120), 900, 901, 902, 903]}


def test_empty_sides(spark):
    some, none = frame(spark, made(20, 1)), frame(spark, made(20, 1)).limit(0)
    assert spatial.overlapping_boxes(some, none).count() == 0 == spatial.overlapping_boxes(none, some).count()
    assert {r.n_overlaps for r in spatial.overlap_counts(some, none).collect()} == {0}


def test_pairs_of_footprints_do_not_grow_with_their_scenes(spark):
    rows = frame(spark, np.tile([0.0, 0, 1, 1], (300, 1)))
    pairs = spatial.overlapping_distinct_boxes(rows, rows).collect()
    assert [(r.id_a, r.id_b, r.n_a, r.n_b) for r in pairs] == [(0, 0, 300, 300)]
