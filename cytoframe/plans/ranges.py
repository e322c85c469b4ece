"""Interval plans that Catalyst has no operator for: containment joins by bins, and runs of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An interval covers this many bins of its level at most, about; each level's bins are 16 times as wide.
SPREAD = 16


def bin_plan(intervals: DataFrame) -> tuple[int, int]:
    """(bin size, number of levels) for a table of intervals: the median length, and what the longest needs. Two numbers go to the driver."""
    size = F.col("stop") - F.col("start")
    r = intervals.where("stop > start").agg(F.percentile_approx(size, 0.5, 100).alias("mid"), F.max(size).alias("most")).first()
    if r["mid"] is None:
        return 1, 1
    size, levels = max(1, int(r["mid"])), 1
    while size * SPREAD**levels < r["most"]:
        levels += 1
    return size, levels


def point_in_interval(points: DataFrame, intervals: DataFrame, plan: tuple[int, int] | None = None, how: str = "inner") -> DataFrame:
    """Points (chrom, pos) joined with the intervals (chrom, start, stop) that hold them: an equi-join on chrom, level and bin.

    An interval is exploded over the bins of the level that fits its length, a point has one bin of each level, so no pair
    comes twice. Columns of intervals other than chrom must not clash with those of points. ``how``: inner or left_semi (for disjoint intervals or not).
    """
    size, levels = plan or bin_plan(intervals)
    length = F.col("stop") - F.col("start")
    step = F.when(length <= size * SPREAD, F.lit(size))
    fit = F.when(length <= size * SPREAD, F.lit(0))
    for k in range(1, levels):
        step, fit = step.when(length <= size * SPREAD ** (k + 1), F.lit(size * SPREAD**k)), fit.when(length <= size * SPREAD ** (k + 1), F.lit(k))
    right = intervals.where("stop > start").withColumn("_level", fit).withColumn("_step", step.cast("long"))
    right = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / F.col("_step")), F.floor((F.col("stop") - 1) / F.col("_step"))))).drop("_step").withColumnRenamed("chrom", "_chrom")
    if levels > 1:
        steps = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("pos") / (size * SPREAD**k)).alias("b")) for k in range(levels)])
        left = points.withColumn("_at", F.explode(steps)).withColumn("_l", F.col("_at.k")).withColumn("_b", F.col("_at.b")).drop("_at")
    else:
        left = points.withColumn("_l", F.lit(0)).withColumn("_b", F.floor(F.col("pos") / size))
    on = (F.col("chrom") == F.col("_chrom")) & (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_bin")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    out = left.join(right, on, how).drop("_l", "_b")
    return out if how == "left_semi" else out.drop("_chrom", "_level", "_bin")


def narrowed(points: DataFrame, intervals: DataFrame, most: int = 64) -> DataFrame:
    """Points with a filter that reaches their scan, where there are ``most`` intervals at most; else all points. No point inside an interval is lost."""
    few = intervals.select("chrom", "start", "stop").limit(most + 1).collect()
    if len(few) > most:
        return points
    near = F.lit(False)
    for r in few:
        near = near | ((F.col("chrom") == r["chrom"]) & (F.col("pos") >= r["start"]) & (F.col("pos") < r["stop"]))
    return points.where(near)


def merge_touching(intervals: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("chrom",), aggs: tuple[Column, ...] = ()) -> DataFrame:
    """Union of intervals that overlap, touch or lie within ``gap``: islands by the running maximum of stops."""
    line = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0)
    islands = intervals.withColumn("_new", new).withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *aggs).drop("_island")


def overlaps(a: DataFrame, b: DataFrame, plan: tuple[int, int] | None = None) -> DataFrame:
    """Pairs of intervals with a base in common, as (chrom, a_start, a_stop, b_start, b_stop); each pair once, in its first shared bin."""
    size = (plan or bin_plan(a))[0]
    spread = lambda x, s: x.where("stop > start").select(F.col("chrom"), F.col("start").alias(f"{s}_start"), F.col("stop").alias(f"{s}_stop"), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("_bin"))
    both = spread(a, "a").join(spread(b, "b"), ["chrom", "_bin"]).where((F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop")))
    return both.where(F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / size)).drop("_bin")


def intersect(a: DataFrame, b: DataFrame, plan: tuple[int, int] | None = None) -> DataFrame:
    both = overlaps(a, b, plan)
    return both.select("chrom", F.greatest("a_start", "b_start").alias("start"), F.least("a_stop", "b_stop").alias("stop"))


def complement(intervals: DataFrame) -> DataFrame:
    """Gaps of each chromosome from 0 to its last stop."""
    merged = merge_touching(intervals)
    before = F.coalesce(F.lag("stop").over(Window.partitionBy("chrom").orderBy("start")), F.lit(0))
    return merged.select("chrom", before.alias("_from"), F.col("start").alias("_to")).where("_from < _to").select("chrom", F.col("_from").alias("start"), F.col("_to").alias("stop"))


def islands(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], state: str) -> DataFrame:
    """Add ``island``: runs of equal ``state`` in order within ``keys``."""
    line = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(state).over(line).eqNullSafe(F.col(state)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def deserts(rows: DataFrame, keys: tuple[str, ...], gap: int) -> DataFrame:
    """Add ``segment``: runs of positions of which none is more than ``gap`` from the one before."""
    line = Window.partitionBy(*keys).orderBy("pos")
    far = F.when(F.col("pos") - F.lag("pos").over(line) > gap, 1).otherwise(0)
    return rows.withColumn("_far", far).withColumn("segment", F.sum("_far").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")
