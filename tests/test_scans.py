"""Blocked scans, interval joins and exact percentiles against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from eoframe.operators import overlay, stats
from eoframe.operators.scan import prefix_scan


@pytest.mark.parametrize("inclusive, descending", [(True, False), (False, False), (True, True), (False, True)])
def test_scan_equals_loops(spark, inclusive, descending):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randint(0, 40), i, rng.choice([None, rng.randint(-9, 9)]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    got = prefix_scan(df, ["t", "id"], {"n": ("count", "v"), "total": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"),
                                       "latest": ("last", "v"), "one": ("first", "v")}, ["k"], inclusive, descending, 7)
    got = {r.id: tuple(r)[4:] for r in got.collect()}
    assert len(got) == 400
    for k in ("hot", "cold", None):
        seen = []
        for _, _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]), reverse=descending):
            before = list(seen)
            seen += [v] if v is not None else []
            s = seen if inclusive else before
            assert got[i] == ((len(s), sum(s), min(s), max(s), s[-1], s[0]) if s else (0, None, None, None, None, None))


def test_scan_of_one_hot_key_uses_many_blocks(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id")
    got = prefix_scan(df, ["id"], {"n": ("count", "id")}, ["k"], partitions=8)
    assert sorted(map(tuple, got.select("id", "n").collect())) == [(i, i + 1) for i in range(5000)]
    assert prefix_scan(df.limit(0), ["id"], {"n": ("count", "id")}, ["k"]).count() == 0
    with pytest.raises(ValueError):
        prefix_scan(df, ["id"], {"ID": ("count", "id")})


def day(n, hours=0):
    return datetime(2020, 1, 1) + timedelta(days=n, hours=hours)


def made_features(spark, n=150):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, day(rng.randint(-20, 90), rng.randint(0, 23))]),
             rng.choice([None, day(rng.randint(-20, 90), rng.randint(0, 23))])) for i in range(n)]
    rows += [(n, day(5), day(5)), (n + 1, day(60), day(3)), (n + 2, None, None), (n + 3, day(-9), day(-1)), (n + 2, None, None)]
    return rows, spark.createDataFrame(rows, "fid int, start_time timestamp_ntz, end_time timestamp_ntz")


@pytest.mark.parametrize("levels", [3, 16, None])
def test_active_features_equal_all_pairs(spark, levels):
    rows, feats = made_features(spark)
    times = [day(3 * i, i) for i in range(25)] + [day(5)]
    frames = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    lo, hi = min(times), max(times)
    want = sorted((t, f) for t in times for f, s, e in rows if (s or lo) <= t <= (e or hi))
    got = overlay.active_features(frames, feats, levels=levels).collect()
    assert sorted((r.t, r.fid) for r in got) == want
    assert set(got[0].asDict()) == {"t", "fid", "start_time", "end_time"}
    n = {r.t: r.n_active for r in overlay.active_counts(frames, feats).collect()}
    # An end before the start makes a feature that is never active.
    assert n == {t: sum(x == t for x, _ in want) for t in times}
    assert overlay.active_features(frames.limit(0), feats).count() == 0


def test_a_feature_goes_to_few_nodes(spark):
    spans = [(0, 0), (0, 65535), (1, 65534), (12345, 54321), (7, 65535), (32767, 32768)]
    df = spark.createDataFrame(spans, "lo long, hi long").withColumn("nodes", overlay.dyadic_nodes(F.col("lo"), F.col("hi"), 16))
    for r in df.collect():
        steps = sorted((n.place << n.level, (n.place + 1) << n.level) for n in r.nodes)
        assert steps[0][0] == r.lo and steps[-1][1] == r.hi + 1 and all(a[1] == b[0] for a, b in zip(steps, steps[1:]))
        assert len(steps) <= 32 and (len(steps) == 1 or (r.lo, r.hi) != (0, 65535))


def test_series_up_to_frames_of_a_hot_series(spark):
    rng = random.Random(8)
    pts = [("hot" if i % 10 else "cold", day(rng.randint(0, 30), rng.randint(0, 23)) + timedelta(seconds=i),
            rng.choice([None, float("nan"), float(rng.randint(0, 99))])) for i in range(600)]
    frames = [day(n, 5) for n in (0, 1, 7, 8, 20, 45)]
    got = overlay.series_up_to_frames(spark.createDataFrame([(t,) for t in frames], "t timestamp_ntz"),
                                      spark.createDataFrame(pts, "series string, t timestamp_ntz, value double"))
    got = {(r.t, r.series): (r.n_points, r.value_sum, r.last_time, r.last_value) for r in got.collect()}
    want = {}
    for t in frames:
        cut = t.replace(hour=23, minute=59)
        for s in ("hot", "cold"):
            up = sorted((p, v) for k, p, v in pts if k == s and p <= cut and v is not None and v == v)
            if up:
                want[t, s] = (len(up), sum(v for _, v in up), *up[-1])
    assert got == want


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [("float", float(x)) for x in rng.normal(size=6000)] + [("ties", float(x)) for x in rng.integers(0, 4, 3000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 7.5), ("odd", None), ("odd", float("inf")), ("odd", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    q = (0.0, 0.02, 0.5, 0.98, 1.0)
    for accuracy in (50, 10_000):  # 50: brackets leave most rows out
        got = {r.k: tuple(r)[1:] for r in stats.percentiles(df, "v", q, ["k"], accuracy).collect()}
        assert set(got) == {"float", "ties", "one", "two", None}
        for k, p in got.items():
            np.testing.assert_allclose(p, np.quantile([v for x, v in rows if x == k], q), rtol=0, atol=1e-12)
    got = tuple(stats.percentiles(df.filter("k = 'float'"), "v", q, accuracy=100).first())
    np.testing.assert_allclose(got, np.quantile([v for x, v in rows if x == "float"], q), rtol=0, atol=1e-12)
    assert stats.percentiles(df.limit(0), "v", q, ["k"]).count() == 0
