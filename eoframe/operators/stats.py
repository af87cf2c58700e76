"""Band statistics, histograms, percentile stretches, legends and class codes.

Bands are unpivoted (``unpivot``) to (band, value) so one aggregation serves
every band. Per-band or per-time parameter tables (min/max, percentiles) are
tiny aggregates joined back with a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .scan import prefix_scan

HIST_BINS = 50
ROBUST_PERCENTILES = (0.02, 0.98)
SKETCH_ACCURACY = 10_000


def long_bands(df: DataFrame, bands, keys=(), value: str = "value") -> DataFrame:
    """(keys..., band, value) rows; bands cast to double so they share a column."""
    wide = df.select(*keys, *[F.col(b).cast("double").alias(b) for b in bands])
    return wide.unpivot(list(keys), list(bands), "band", value)


def band_stats(df: DataFrame, bands, keys=()) -> DataFrame:
    """Population variance (ddof 0), min, max and count per band, nulls skipped."""
    lb = long_bands(df, bands, keys).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return lb.groupBy(*keys, "band").agg(F.var_pop("value").alias("var"), F.min("value").alias("min"),
                                         F.max("value").alias("max"), F.count("value").alias("n"))


def histogram(df: DataFrame, bands, bins: int = HIST_BINS, keys=()) -> DataFrame:
    """Equal-width bins between each band's min and max; the last bin is closed.

    Only non-empty bins appear (a count of zero has no row).
    """
    lb = long_bands(df, bands, keys).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rng = lb.groupBy(*keys, "band").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = lb.join(rng, [*keys, "band"])
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width * bins), F.lit(bins - 1)))
    return (j.withColumn("bin", b.cast("int"))
             .groupBy(*keys, "band", "bin")
             .agg(F.count(F.lit(1)).alias("n"), F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
             .withColumn("bin_lo", F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins)
             .drop("_lo", "_hi"))


def percentiles(df: DataFrame, value: str, q, keys=(), accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """(keys..., q_0, q_1, ...): exact percentiles of a column, linear interpolation, null and
    non-finite values excluded.

    A mergeable quantile sketch (its state bounded by ``accuracy``, whatever the type)
    brackets each percentile between two values. The second pass counts what lies below a
    bracket and the values inside it, about 8 / accuracy of the rows, and a blocked scan
    of these counts finds the two values at the percentile's rank. There is no map of all
    values, and a key that holds most rows is spread over tasks.
    """
    q = [float(x) for x in q]
    keys, slack = list(keys), 4.0 / accuracy
    v = df.select(*keys, F.col(value).cast("double").alias("_v"))
    v = v.filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    at = [min(1.0, max(0.0, x + d)) for x in q for d in (-slack, slack)]
    brackets = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", at, accuracy).alias("_b"),
                                    F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def edge(i, k):
        # The extremes themselves at the ends, and where the slack is but a few rows.
        end, outer = F.col("_hi" if k else "_lo"), at[2 * i + k]
        return end if outer in (0.0, 1.0) else F.when(F.col("_n") <= 4 * accuracy, end).otherwise(F.col("_b")[2 * i + k])
    ranks = brackets.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), edge(i, 0).alias("lo"), edge(i, 1).alias("hi"), ((F.col("_n") - 1) * F.lit(x)).alias("h"))
        for i, x in enumerate(q)])).alias("_r")).select(*keys, "_r.*")
    ranks = cut_lineage(ranks)  # a row per key and percentile
    pairs = ranks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("_brackets"))
    if keys:
        on = [F.col(f"_v_.`{k}`").eqNullSafe(F.col(f"_p_.`{k}`")) for k in keys]
        coded = v.alias("_v_").join(pairs.alias("_p_"), on).select(*[F.col(f"_v_.`{k}`") for k in keys], "_v", "_brackets")
    else:
        coded = v.withColumn("_brackets", pairs.scalar())
    # Below a bracket: null, one row per task. Above it: not counted.
    coded = coded.select(*keys, "_v", F.explode("_brackets").alias("_x")).filter(F.col("_v") <= F.col("_x.hi"))
    counts = (coded.select(*keys, F.col("_x.i").alias("i"), F.when(F.col("_v") >= F.col("_x.lo"), F.col("_v")).alias("val"))
              .groupBy(*keys, "i", "val").agg(F.count(F.lit(1)).alias("n")))
    ran = prefix_scan(counts, ["val"], {"upto": ("sum", "n")}, [*keys, "i"])
    on = [F.col(f"_c_.`{k}`").eqNullSafe(F.col(f"_k_.`{k}`")) for k in [*keys, "i"]]
    k = F.floor("h")
    found = (ran.alias("_c_").join(ranks.alias("_k_"), on)
             .select(*[F.col(f"_k_.`{c}`") for c in [*keys, "i"]], "val", "upto", "n", "h")
             .filter((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k + 1))
             .groupBy(*keys, "i", "h").agg(F.min(F.struct("upto", "val"))["val"].alias("low"),
                                           F.min(F.when(F.col("upto") > k + 1, F.struct("upto", "val")))["val"].alias("high")))
    low = F.when(F.col("low").isNull(), F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")).otherwise(F.col("low"))
    rest = F.col("h") - k
    found = found.withColumn("p", F.when(rest == 0, low).otherwise(low + rest * (F.col("high") - low)))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("p"))).alias(f"q_{i}") for i in range(len(q))])


def percentile_bounds(df: DataFrame, bands, q=ROBUST_PERCENTILES, keys=(), accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """A10: two percentiles of all bands pooled, exact for every type."""
    p = percentiles(long_bands(df, bands, keys), "value", q, keys, accuracy)
    return p.select(*keys, F.col("q_0").alias("p_low"), F.col("q_1").alias("p_high"))


def rescale_clip(v, lo, hi) -> Column:
    """``(v - lo) / (hi - lo)`` clipped to [0, 1]; null for a null value or lo == hi.

    (least/greatest skip nulls, so the null case is kept explicitly.)
    """
    v = F.col(v) if isinstance(v, str) else v
    r = F.try_divide(v - lo, hi - lo)
    return F.when(r.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)))


def stretch(df: DataFrame, bands, bounds: DataFrame, keys=()) -> DataFrame:
    """F12 with A10 bounds joined per key (a broadcast of one row per key)."""
    if keys:
        j, lo, hi = df.join(bounds, list(keys)), F.col("p_low"), F.col("p_high")
    else:  # one global pair of bounds: a single struct-valued scalar subquery, no join
        j = df.withColumn("_bounds", bounds.select(F.struct("p_low", "p_high")).scalar())
        lo, hi = F.col("_bounds.p_low"), F.col("_bounds.p_high")
    return j.withColumns({b: rescale_clip(F.col(b).cast("double"), lo, hi) for b in bands}).drop("_bounds")


def extent(df: DataFrame, keys=(), x: str = "x", y: str = "y", cell: float | None = None) -> DataFrame:
    """Coordinate extent; with ``cell`` the cell edges instead of centres."""
    if cell is None:
        return df.groupBy(*keys).agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"),
                                     F.min(y).alias("ymin"), F.max(y).alias("ymax"))
    return with_edges(extent(df, keys, x, y), cell)


def with_edges(e: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    """An extent of cell centres moved out to (or, with a prefix, joined by) the edges."""
    h = cell / 2
    return e.withColumns({f"{prefix}{c}": F.col(c) + (h if c.endswith("max") else -h)
                          for c in ("xmin", "xmax", "ymin", "ymax")})


def legend_table(spark: SparkSession, legend) -> DataFrame:
    """Legend (value, (r, g, b), label) -> table with the value's legend index."""
    rows = [(i, v, c[0], c[1], c[2], lab) for i, (v, c, lab) in enumerate(legend)]
    schema = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("value", T.IntegerType()),
                           T.StructField("r", T.IntegerType()), T.StructField("g", T.IntegerType()),
                           T.StructField("b", T.IntegerType()), T.StructField("label", T.StringType())])
    return spark.createDataFrame(rows, schema).coalesce(1)


def apply_legend(df: DataFrame, value_col: str, legend: DataFrame) -> DataFrame:
    """Left join on the class value; unmapped codes get null index/colour/label."""
    lg = legend.withColumnRenamed("value", "_lv")
    return df.join(lg, df[value_col] == lg["_lv"], "left").drop("_lv")


def class_codes(df: DataFrame, attr: str, order: str, name: str = "code") -> DataFrame:
    """Dense codes for an attribute's classes in order of first appearance.

    Classes are ranked by first appearance with the parallel numbering (no
    single-task window, even for a high-cardinality attribute), then joined back.
    """
    from .ranking import consecutive_index
    firsts = df.groupBy(attr).agg(F.min(order).alias("_first"))
    codes = consecutive_index(firsts, ["_first", attr], name).withColumn(name, F.col(name).cast("int"))
    return df.join(codes.drop("_first"), attr, "left")
