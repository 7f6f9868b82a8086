"""Interval algebra on DataFrames: runs, merge, complement, difference, overlap and as-of joins, chunks.

Intervals are two columns, lo and hi; keys name the columns of a job. Overlap and as-of joins and runs are partitioned by
buckets of time beside the keys, so that a long job is not one task's work; merge and complement need all that came before, and are
partitioned by their keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import snap


def runs(rows: DataFrame, keys: list[str], position: str = "i", stretch: int = 4096) -> DataFrame:
    """Maximal runs of consecutive positions: keys, first, last.

    Runs of each stretch of positions first; then those that touch a border of their stretch, two for each at most, are joined.
    """
    at = F.floor(F.col(position) / stretch)
    order = Window.partitionBy(*keys, "_stretch").orderBy(position)
    marked = rows.select(*keys, position, at.cast("long").alias("_stretch"))
    marked = marked.withColumn("_run", F.col(position) - F.row_number().over(order))
    parts = marked.groupBy(*keys, "_stretch", "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"))
    inner = (F.col("first") > F.col("_stretch") * stretch) & (F.col("last") < (F.col("_stretch") + 1) * stretch - 1)
    # A run inside its stretch is a group of its own, and the others are in order of all that touch a border.
    border = Window.partitionBy(*keys, "_inner").orderBy("first")
    parts = parts.withColumn("_inner", F.when(inner, F.col("first")))
    parts = parts.withColumn("_new", F.coalesce((F.lag("last").over(border) + 1 != F.col("first")).cast("int"), F.lit(1)))
    parts = parts.withColumn("_group", F.sum("_new").over(border))
    return parts.groupBy(*keys, "_inner", "_group").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_inner", "_group")


def merge(rows: DataFrame, keys: list[str], slack: float = 0.0) -> DataFrame:
    """Union of intervals: those that are less than or exactly slack apart become one."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("lo") > before + F.lit(slack))).cast("int")
    marked = rows.select(*keys, "lo", "hi", new.alias("_new"))
    marked = marked.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_group")


def complement(gaps: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """What the gaps leave of each frame (keys, a, b): keys, a, b, lo, hi with hi above lo.

    Each frame goes in with its gaps as an empty gap at its end, so that one shuffle brings both together.
    """
    none = F.lit(None).cast("double")
    ends = frames.select(*keys, F.col("b").alias("lo"), F.col("b").alias("hi"), "a", "b")
    points = gaps.select(*keys, "lo", "hi", none.alias("a"), none.alias("b")).unionByName(ends)
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumns({"a": F.max("a").over(whole), "b": F.max("b").over(whole), "before": F.max("hi").over(order)})
    cursor = points.withColumn("cursor", F.greatest("a", F.coalesce("before", "a")))
    return cursor.where("lo > cursor").select(*keys, "a", "b", F.col("cursor").alias("lo"), F.least("lo", "b").alias("hi")).where("hi > lo")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, extra: Column | None = None) -> DataFrame:
    """Pairs with left.lo < right.hi and right.lo < left.hi; right's lo and hi come out as rlo and rhi.

    Both sides go to the buckets of `width` that they touch, and a pair is kept in the first bucket they share.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    spread = lambda df, lo, hi, name: df.withColumn(name, bucket(lo)).withColumn("_bucket", F.explode(F.sequence(F.col(name), F.greatest(bucket(hi), F.col(name)))))
    one = spread(left, "lo", "hi", "_first")
    two = spread(right.withColumnsRenamed({"lo": "rlo", "hi": "rhi"}), "rlo", "rhi", "_second")
    pairs = one.join(two, [*keys, "_bucket"])
    pairs = pairs.where((F.col("lo") < F.col("rhi")) & (F.col("rlo") < F.col("hi")) & (F.col("_bucket") == F.greatest("_first", "_second")))
    return (pairs if extra is None else pairs.where(extra)).drop("_bucket", "_first", "_second")


def difference(gaps: DataFrame, protected: DataFrame, keys: list[str], width: float) -> DataFrame:
    """What is left of each gap (keys, gap, lo, hi) outside the protected intervals: keys, gap, lo, hi."""
    hit = overlap_join(gaps.select(*keys, "gap", "lo", "hi"), protected.select(*keys, "lo", "hi"), keys, width)
    frames = gaps.select(*keys, "gap", F.col("lo").alias("a"), F.col("hi").alias("b"))
    inner = hit.select(*keys, "gap", F.col("rlo").alias("lo"), F.col("rhi").alias("hi"))
    return complement(inner, frames, [*keys, "gap"]).drop("a", "b")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, edge: str, reach: float, forward: bool = False) -> DataFrame:
    """left with `nearest`: the last edge of right at or before left's instant (or the first at or after it), within reach.

    One sorted pass over both sides together instead of a range join, in buckets as wide as the reach: an edge goes to its own and the next.
    """
    sign = -1.0 if forward else 1.0
    bucket = lambda t: F.floor(t / F.lit(float(reach))).cast("long")
    ours = left.withColumns({"_t": F.col(at) * sign, "_edge": F.lit(None).cast("double"), "_side": F.lit(1)}).withColumn("_bucket", bucket(F.col("_t")))
    theirs = right.select(*keys, (F.col(edge) * sign).alias("_t"), F.col(edge).alias("_edge"), F.lit(0).alias("_side"))
    theirs = theirs.select("*", F.explode(F.array(bucket(F.col("_t")), bucket(F.col("_t")) + 1)).alias("_bucket"))
    order = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_last", F.last("_edge", ignorenulls=True).over(order))
    near = F.when(F.abs(F.col(at) - F.col("_last")) <= F.lit(reach), F.col("_last"))
    return both.where("_side = 1").withColumn("nearest", near).drop("_t", "_edge", "_side", "_last", "_bucket")


def islands(
    windows: DataFrame, silences: DataFrame, keys: list[str], *, interval: float, origin: float = 0.0, margin: float = P.PAUSE_MARGIN,
    min_silence: float = P.MIN_SILENCE, min_island: float = P.MIN_ISLAND, min_edge: float = P.MIN_EDGE_ISLAND, width: float = 60.0,
) -> DataFrame:
    """Spans of each window (keys, cut, a, b) that stay when its pauses go, on the frame grid: keys, cut, lo, hi."""
    by = [*keys, "cut"]
    frames = windows.select(*by, F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    hit = overlap_join(frames.withColumnsRenamed({"a": "lo", "b": "hi"}), silences.select(*keys, "lo", "hi"), keys, width)
    quiet = hit.select(*by, F.greatest("lo", "rlo").alias("lo"), F.least("hi", "rhi").alias("hi")).where(F.col("hi") - F.col("lo") >= F.lit(min_silence - P.EPSILON))
    gaps = quiet.select(*by, (F.col("lo") + F.lit(margin)).alias("lo"), (F.col("hi") - F.lit(margin)).alias("hi")).where("hi > lo")
    spans = complement(gaps, frames, by).where(F.col("hi") - F.col("lo") >= F.lit(min_island - P.EPSILON))
    order = Window.partitionBy(*by).orderBy("lo")
    spans = spans.withColumn("_n", F.row_number().over(order))
    long = F.when(F.col("hi") - F.col("lo") >= F.lit(min_edge - P.EPSILON), F.col("_n"))
    whole = Window.partitionBy(*by)
    spans = spans.withColumns({"_from": F.min(long).over(whole), "_to": F.max(long).over(whole)}).where("_n between _from and _to")
    spans = spans.select(*by, snap(F.col("lo"), interval, origin).alias("lo"), snap(F.col("hi"), interval, origin).alias("hi"))
    spans = spans.where(F.col("hi") - F.col("lo") >= F.lit(interval - P.EPSILON))
    new = F.coalesce((F.col("lo") - F.lag("hi").over(order) >= F.lit(interval - P.EPSILON)).cast("int"), F.lit(1))
    spans = spans.withColumn("_new", new).withColumn("_group", F.sum("_new").over(order))
    return spans.groupBy(*by, "_group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_group")


def chunks(spans: DataFrame, keys: list[str], totals: DataFrame, fps: float, speed: float, rate: float, most: int = P.MAX_SPANS) -> DataFrame:
    """Parts of at most `most` spans with exact frames and samples: each part's own rounding, the last takes what is left.

    totals: keys, frames, samples.
    """
    order = Window.partitionBy(*keys).orderBy("lo")
    parts = spans.withColumn("part", F.floor((F.row_number().over(order) - 1) / F.lit(most)).cast("long"))
    parts = parts.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("hi") - F.col("lo")).alias("length"))
    parts = parts.join(totals, keys)
    own = F.floor(F.col("length") * F.lit(float(fps)) / F.lit(float(speed)) + F.lit(0.5)).cast("long")
    by = Window.partitionBy(*keys).orderBy("part")
    parts = parts.withColumns({"_own": own, "_last": F.lead("part").over(by).isNull()})
    taken = F.coalesce(F.sum("_own").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.col("frames") - taken, F.lit(0))
    parts = parts.withColumn("part_frames", F.when(F.col("_last"), left).otherwise(F.least("_own", left)))
    sound = F.floor(F.col("part_frames").cast("double") / F.lit(float(fps)) * F.lit(float(rate)) + F.lit(0.5)).cast("long")
    parts = parts.withColumn("_sound", sound)
    heard = F.coalesce(F.sum("_sound").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("part_samples", F.when(F.col("_last"), F.col("samples") - heard).otherwise(F.col("_sound"))).select(
        *keys, "part", F.col("n_spans").cast("long").alias("n_spans"), F.col("part_frames").alias("frames"), F.col("part_samples").alias("samples")
    )
