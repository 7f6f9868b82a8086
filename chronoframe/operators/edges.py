"""Cut edges moved out of speech: to a silence near by, else between two words, else left with a note."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import half_up
from chronoframe.operators.intervals import asof
from chronoframe.operators.signal import index_bounds
from chronoframe.operators.transcript import word_edges

NOTE = "borde_en_voz"


def _around(points: DataFrame, levels: DataFrame, lo, hi, step: float) -> DataFrame:
    """The levels of each point's window [lo, hi), one row each, found by their index."""
    first, after = index_bounds(F.greatest(F.lit(0.0), lo), hi, step)
    spread = points.select("*", F.explode(F.sequence(first, F.greatest(after - 1, first))).alias("i")).where(F.col("i") < after)
    return spread.join(levels, ["job", "i"])


def nearest_silences(points: DataFrame, levels: DataFrame, threshold: float, step: float = P.LEVEL_STEP) -> DataFrame:
    """Points (job, id, side, x, limit) with `found`: the nearest admissible edge of a silence before (side -1) or after x.

    limit is the neighbouring word's edge on that side; the result keeps a margin from it.
    """
    reach = P.EDGE_WINDOW + P.EDGE_SILENCE
    before = F.col("side") < 0
    lo = F.when(before, F.greatest(F.lit(0.0), F.col("x") - reach)).otherwise(F.col("x"))
    hi = F.when(before, F.col("x")).otherwise(F.col("x") + reach)
    keys = ["job", "id", "side"]
    quiet = _around(points, levels, lo, hi, step).where(F.col("db") < threshold)
    order = Window.partitionBy(*keys).orderBy("i")
    runs = quiet.withColumn("_run", F.col("i") - F.row_number().over(order)).groupBy(*keys, "x", "limit", "_run").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    runs = runs.withColumns({"lo": half_up(F.greatest(lo, F.col("first") * step), 6), "hi": half_up(F.least(hi, (F.col("last") + 1) * step), 6)})
    runs = runs.where(F.col("hi") - F.col("lo") >= P.EDGE_SILENCE - P.EPSILON)
    near = F.when(before, F.col("hi")).otherwise(F.col("lo"))
    margin = F.when(before, F.greatest(near, F.col("limit") + P.WORD_MARGIN)).otherwise(F.least(near, F.col("limit") - P.WORD_MARGIN))
    candidate = F.when(F.col("limit").isNull(), near).otherwise(margin)
    beyond = F.when(before, candidate < F.col("x")).otherwise(candidate > F.col("x"))
    fits = runs.withColumn("candidate", candidate).where((F.abs(near - F.col("x")) <= P.EDGE_WINDOW) & beyond)
    # The candidate grows with the silence, so the nearest one is the greatest before x and the least after it.
    best = fits.groupBy(*keys).agg(F.max("candidate").alias("up"), F.min("candidate").alias("down"))
    best = best.select(*keys, half_up(F.when(before, F.col("up")).otherwise(F.col("down")), 6).alias("found"))
    return points.join(best, keys, "left")


def adjust_edges(cuts: DataFrame, levels: DataFrame, words: DataFrame, threshold: float = P.SILENCE_DB, step: float = P.LEVEL_STEP) -> DataFrame:
    """Cuts (job, id, a, b) with both edges out of speech: job, id, a, b, lo, hi, note."""
    sides = F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("a").alias("x")), F.struct(F.lit(1).alias("side"), F.col("b").alias("x"))))
    points = cuts.select("job", "id", sides.alias("s")).select("job", "id", "s.side", "s.x")
    before = F.col("side") < 0
    look = _around(points, levels, F.when(before, F.col("x") - P.EDGE_LOOK).otherwise(F.col("x")), F.when(before, F.col("x")).otherwise(F.col("x") + P.EDGE_LOOK), step)
    voiced = look.groupBy("job", "id", "side").agg(F.bool_or(F.col("db") >= threshold).alias("voiced"))
    points = points.join(voiced, ["job", "id", "side"], "left").withColumn("voiced", F.coalesce("voiced", F.lit(False)))
    far = 1e12
    past = asof(points, words, ["job"], "x", "hi", far).withColumnRenamed("nearest", "past")
    both = asof(past, words, ["job"], "x", "lo", far, forward=True).withColumnRenamed("nearest", "next")
    limited = both.withColumn("limit", F.when(before, F.col("past")).otherwise(F.col("next"))).drop("past", "next")
    found = nearest_silences(limited.where("voiced"), levels, threshold, step)
    has_words = words.select("job").distinct().withColumn("worded", F.lit(True))
    found = found.join(has_words, "job", "left")
    moved = word_edges(found.where("found is null and worded").select("job", F.col("x").alias("edge"), "side").distinct(), words)
    found = found.join(moved.select("job", F.col("edge").alias("x"), "side", "moved"), ["job", "x", "side"], "left")
    placed = found.select("job", "id", "side", F.coalesce("found", "moved").alias("to"), (F.col("found").isNull() & F.col("moved").isNotNull() & (F.col("moved") != F.col("x"))).alias("by_word"))
    at = lambda side, to, by: placed.where(F.col("side") == side).select("job", "id", F.col("to").alias(to), F.col("by_word").alias(by), F.lit(True).alias(to + "_voiced"))
    rows = cuts.select("job", "id", "a", "b").join(at(-1, "start", "start_by"), ["job", "id"], "left").join(at(1, "end", "end_by"), ["job", "id"], "left")
    lost = (F.col("start_voiced").isNotNull() & F.col("start").isNull()) | (F.col("end_voiced").isNotNull() & F.col("end").isNull())
    rows = rows.select("job", "id", "a", "b", F.coalesce("start", "a").alias("lo"), F.coalesce("end", "b").alias("hi"), lost.alias("lost"), F.coalesce("start_by", F.lit(False)).alias("start_by"), F.coalesce("end_by", F.lit(False)).alias("end_by"))
    closed = (F.col("start_by") | F.col("end_by")) & (F.col("hi") - F.col("lo") < 2 * P.WORD_PAD)
    return rows.select(
        "job", "id", "a", "b", F.when(closed & F.col("start_by"), F.col("a")).otherwise(F.col("lo")).alias("lo"),
        F.when(closed & F.col("end_by"), F.col("b")).otherwise(F.col("hi")).alias("hi"), F.when(F.col("lost") | closed, F.lit(NOTE)).alias("note"),
    )
