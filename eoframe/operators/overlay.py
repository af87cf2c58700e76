"""Frames, captions and vector overlays joined to time or space.

Frame tables have one row per distinct time step, numbered in parallel; running values
are blocked scans. No step orders a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import CAPTION_DATE_FORMAT
from .ranking import consecutive_index
from .scan import prefix_scan
from .spatial import overlap_counts, overlapping_boxes, overlapping_distinct_boxes  # noqa: F401


def frame_table(df: DataFrame, time_col: str = "t") -> DataFrame:
    """Frame number per distinct time, the midway flag and a date caption."""
    ranked = consecutive_index(df.select(time_col).distinct(), [time_col], "frame")
    n = ranked.agg(F.count(F.lit(1))).scalar()
    return (ranked.withColumn("is_midway", F.col("frame") == F.floor(n / 2))
                  .withColumn("caption", F.date_format(F.col(time_col), CAPTION_DATE_FORMAT)))


def frame_caption(t, texts=None) -> "F.Column":
    """date caption, then the per-frame text, joined by a newline; empty parts skipped."""
    date = F.date_format(t, CAPTION_DATE_FORMAT)
    return F.concat_ws("\n", date, texts) if texts is not None else date


MOST_LEVELS = 20      # the frames' span is cut into 2^20 steps at most
SPREAD = 32           # tasks over which the pairs of a node near the root are dealt


def dyadic_nodes(lo, hi, levels: int):
    """The fewest dyadic intervals that make up the steps lo..hi: an array of
    ``struct(level, place)``, a node of level k covering 2^k steps; at most two a level."""
    def at(k):
        left = F.ceil(lo / F.pow(F.lit(2.0), k)).cast("long")
        right = F.floor((hi + 1) / F.pow(F.lit(2.0), k)).cast("long")
        both = F.array(F.when((left < right) & (left % 2 == 1), left), F.when((left < right) & (right % 2 == 1), right - 1))
        return F.transform(F.array_compact(both), lambda p: F.struct(k.alias("level"), p.alias("place")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def _steps(frames: DataFrame, time_col: str, levels: int):
    """(first, last, step of a time): the frames' span in 2^levels equal steps."""
    span = frames.agg(F.struct(F.min(time_col).alias("first"), F.max(time_col).alias("last"))).scalar()

    def step(t, bounds):
        width = F.greatest(F.timestamp_diff("MICROSECOND", bounds["first"], bounds["last"]) + 1, F.lit(1))
        return F.floor(F.timestamp_diff("MICROSECOND", bounds["first"], t) * F.lit(float(1 << levels)) / width).cast("long")
    return span, step


def active_features(frames: DataFrame, features: DataFrame, time_col: str = "t",
                    levels: int | None = None) -> DataFrame:
    """(frame, feature) pairs where ``start <= t <= end``.

    Missing starts/ends take the first/last frame time. The frames' span is cut into
    2^levels steps, by default about one a frame. A feature goes to the dyadic intervals that make up its own (at most
    two a level, whatever it spans; one, if it is open at both ends), a frame to the
    intervals above its step, and they meet by an equi-join; the exact predicate decides
    within the first and the last step. Nodes near the root, where long features meet
    all frames, are dealt over several tasks.
    """
    if levels is None:
        levels = min(MOST_LEVELS, max(1, frames.select(time_col).distinct().count().bit_length()))
    span, step = _steps(frames, time_col, levels)
    fr = frames.withColumn("_span", span)
    fr = fr.withColumn("_step", step(F.col(time_col), F.col("_span"))).drop("_span")
    f = features.withColumn("_span", span)
    f = f.withColumns({"_s": F.coalesce("start_time", "_span.first"), "_e": F.coalesce("end_time", "_span.last")})
    f = f.filter((F.col("_s") <= F.col("_e")) & (F.col("_e") >= F.col("_span.first")) & (F.col("_s") <= F.col("_span.last")))
    lo = step(F.greatest("_s", "_span.first"), F.col("_span"))
    hi = step(F.least("_e", "_span.last"), F.col("_span"))
    f = f.withColumns({"_lo": lo, "_hi": hi}).withColumn("_node", F.explode(dyadic_nodes(F.col("_lo"), F.col("_hi"), levels)))
    # Level by level towards the root twice the tasks, SPREAD at the root.
    tasks = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.col("_level") - levels) * SPREAD)).cast("int")
    f = (f.withColumns({"_level": F.col("_node.level"), "_place": F.col("_node.place")})
          .withColumn("_deal", F.pmod(F.xxhash64("_s", "_e", *[c for c in features.columns if c not in ("start_time", "end_time")
                                                               and features.schema[c].dataType.typeName() != "map"]), tasks)))
    fr = fr.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    fr = (fr.withColumn("_place", F.floor(F.col("_step") / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
            .withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), (tasks - 1).cast("long")))))
    j = fr.join(f.drop("_span", "_node", "_lo", "_hi"), ["_level", "_place", "_deal"])
    j = j.filter((F.col("_s") <= F.col(time_col)) & (F.col(time_col) <= F.col("_e")))
    return j.drop("_level", "_place", "_deal", "_s", "_e", "_step")


def active_counts(frames: DataFrame, features: DataFrame, time_col: str = "t") -> DataFrame:
    """(frame time, n_active) without any pair: starts up to a frame less ends before
    it, by one blocked scan over frames, starts and ends in time order."""
    span = frames.agg(F.struct(F.min(time_col).alias("first"), F.max(time_col).alias("last"))).scalar()
    f = features.withColumn("_span", span)
    f = f.select(F.coalesce("start_time", "_span.first").alias("_s"), F.coalesce("end_time", "_span.last").alias("_e"))
    f = f.filter(F.col("_s") <= F.col("_e"))
    # At one moment starts come before the frame and ends after it.
    kind = frames.schema[time_col].dataType.simpleString()
    marks = F.array(F.struct(F.col("_s").cast(kind).alias("t"), F.lit(0).alias("turn"), F.lit(1).alias("n")),
                    F.struct(F.col("_e").cast(kind).alias("t"), F.lit(2).alias("turn"), F.lit(-1).alias("n")))
    events = f.select(F.inline(marks)).groupBy("t", "turn").agg(F.sum("n").alias("n"))
    rows = events.unionByName(frames.select(F.col(time_col).alias("t"), F.lit(1).alias("turn"), F.lit(0).cast("long").alias("n")).distinct())
    return (prefix_scan(rows, ["t", "turn"], {"n_active": ("sum", "n")}).filter("turn = 1")
            .select(F.col("t").alias(time_col), "n_active"))


def clip_box(minx, miny, maxx, maxy, box) -> list:
    """Intersection of box columns with a fixed box (null-free only where they overlap)."""
    x1, y1, x2, y2 = box

    def keep_null(c, clipped):  # least/greatest would replace a null bound by the box edge
        return F.when(F.col(c).isNotNull(), clipped)
    return [keep_null(minx, F.greatest(F.col(minx), F.lit(x1))).alias("minx"),
            keep_null(miny, F.greatest(F.col(miny), F.lit(y1))).alias("miny"),
            keep_null(maxx, F.least(F.col(maxx), F.lit(x2))).alias("maxx"),
            keep_null(maxy, F.least(F.col(maxy), F.lit(y2))).alias("maxy")]


def pair_by_position(a: DataFrame, b: DataFrame, order_a, order_b) -> DataFrame:
    """Pair the i-th row of ``a`` with the i-th row of ``b`` (stops at the shorter).

    Positions come from a parallel consecutive numbering (no single-task
    window); ties in the order are broken by the remaining columns.
    """
    return consecutive_index(a, list(order_a), "pos").join(consecutive_index(b, list(order_b), "pos"), "pos")


def series_up_to_frames(frames: DataFrame, series: DataFrame, time_col: str = "t", key: str = "series",
                        value: str = "value") -> DataFrame:
    """Per frame and series, the points up to the end of the frame's day
    (23:59:00 inclusive), NaN and null skipped: count, sum, last time and value.

    Each point is assigned to the first frame cut-off at or after it by an
    equi-join on the calendar day (every cut-off interval is exploded over
    the days it spans, a table bounded by the covered date range), then
    partially aggregated per (series, frame). The running values are a blocked
    scan over one row per (series, frame): a hot series is spread over tasks.
    """
    cut = F.timestamp_add("MINUTE", F.lit(23 * 60 + 59), F.to_date(F.col(time_col)).cast("timestamp_ntz"))
    fr = frames.select(time_col, cut.alias("_cut")).distinct()
    cuts = consecutive_index(fr.select("_cut").distinct(), ["_cut"], "_k")
    earlier = cuts.select(F.col("_cut").alias("_prev"), (F.col("_k") + 1).alias("_k"))
    cuts = cuts.join(earlier, "_k", "left")
    pts = series.filter(F.col(value).isNotNull() & ~F.isnan(value))
    first_pt = pts.agg(F.min(time_col)).scalar()
    start = F.to_date(F.coalesce(F.col("_prev"), F.least(first_pt, F.col("_cut"))))
    days = cuts.withColumn("_d", F.explode(F.sequence(start, F.to_date("_cut"))))
    b = (pts.withColumn("_d", F.to_date(time_col))
            .join(days, "_d")
            .filter((F.col("_prev").isNull() | (F.col(time_col) > F.col("_prev"))) & (F.col(time_col) <= F.col("_cut"))))
    agg = b.groupBy(key, "_k").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"),
                                   F.max_by(F.struct(F.col(time_col).alias("lt"), F.col(value).alias("lv")),
                                            F.struct(time_col, value)).alias("_l"))
    n_cuts = cuts.agg(F.count(F.lit(1))).scalar()
    keys = pts.select(key).distinct()
    per = keys.select(key, F.explode(F.sequence(F.lit(0).cast("long"), n_cuts - 1)).alias("_k"))
    per = per.join(agg, [key, "_k"], "left")
    run = prefix_scan(per, ["_k"], {"n_points": ("sum", "_n"), "value_sum": ("sum", "_s"), "_last": ("last", "_l")}, [key])
    frame_k = fr.join(cuts.select("_cut", "_k"), "_cut").select(time_col, "_k")
    out = run.join(frame_k, "_k").filter(F.col("n_points") > 0)
    return out.select(time_col, key, "n_points", "value_sum", F.col("_last.lt").alias("last_time"),
                      F.col("_last.lv").alias("last_value"))
