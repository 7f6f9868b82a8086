"""Level series: derivation, silences, voice, percentiles, quiet cuts, blocks, resampling and alignment.

A series is rows (keys, i, db), dense in i; instants are i times the step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import half_up
from chronoframe.operators.intervals import overlap_join, runs


def levels_of(samples: DataFrame, keys: list[str], window: int, full_scale: float = 32768.0) -> DataFrame:
    """Levels of whole windows of PCM samples (keys, n, x); an incomplete last window is left out."""
    grouped = samples.groupBy(*keys, F.floor(F.col("n") / window).cast("long").alias("i"))
    energy = grouped.agg(F.sum(F.col("x").cast("long") * F.col("x")).alias("s"), F.count(F.lit(1)).alias("m")).where(F.col("m") == window)
    db = F.when(F.col("s") > 0, F.greatest(F.lit(P.FLOOR_DB), F.log10(F.col("s") / F.lit(window) / F.lit(full_scale**2)) * 10)).otherwise(F.lit(P.FLOOR_DB))
    return energy.select(*keys, "i", db.cast("float").alias("db"))


def index_bounds(a, b, step: float = P.LEVEL_STEP):
    """First index and the index after the last of [a, b), with the slack of the grid."""
    return F.greatest(F.lit(0), F.floor(a / step + P.EPSILON)).cast("long"), F.ceil(b / step - P.EPSILON).cast("long")


def silences(levels: DataFrame, keys: list[str], threshold: float = P.SILENCE_DB, least: float = P.MIN_SILENCE, step: float = P.LEVEL_STEP) -> DataFrame:
    """Maximal runs below the threshold that last at least `least`: keys, lo, hi."""
    quiet = runs(levels.where(F.col("db") < F.lit(threshold)), keys)
    spans = quiet.select(*keys, half_up(F.col("first") * F.lit(step), 6).alias("lo"), half_up((F.col("last") + 1) * F.lit(step), 6).alias("hi"))
    return spans.where(F.col("hi") - F.col("lo") >= F.lit(least - P.EPSILON))


def voiced(levels: DataFrame, keys: list[str], block: int, threshold: float = P.SILENCE_DB) -> DataFrame:
    """Whether any level of a block reaches the threshold: keys, block, voiced, loud."""
    loud = F.col("db") >= F.lit(threshold)
    return levels.groupBy(*keys, F.floor(F.col("i") / block).cast("long").alias("block")).agg(
        F.bool_or(loud).alias("voiced"), F.count_if(loud).alias("loud")
    )


def percentile(levels: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """The sorted level at index least(n - 1, int(share * n)) of each group: keys, n, level. Equal levels are counted together first."""
    counts = levels.groupBy(*keys, "db").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy(*keys).orderBy("db").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"upto": F.sum("m").over(upto), "n": F.sum("m").over(Window.partitionBy(*keys))})
    reached = F.col("upto") >= F.least(F.col("n"), F.floor(F.col("n") * F.lit(share)) + 1)
    return counts.groupBy(*keys).agg(F.first("n").alias("n"), F.min(F.when(reached, F.col("db"))).alias("level"))


def quiet_windows(levels: DataFrame, keys: list[str], width: int, scale: int = 10_000) -> DataFrame:
    """Energy of each whole window of width levels, as an integer: keys, i, total.

    A series is summed in stretches; each also gets the levels after it that its last windows reach into.
    """
    stretch = max(4096, 16 * width)
    own = F.floor(F.col("i") / stretch).cast("long")
    rows = levels.select(*keys, "i", F.round(F.col("db") * scale).cast("long").alias("units"), own.alias("_own"))
    both = F.when(F.col("i") - F.col("_own") * stretch < width - 1, F.array(F.col("_own"), F.col("_own") - 1)).otherwise(F.array("_own"))
    rows = rows.withColumn("_stretch", F.explode(both))
    order = Window.partitionBy(*keys, "_stretch").orderBy("i").rowsBetween(0, width - 1)
    summed = rows.withColumns({"total": F.sum("units").over(order), "_n": F.count(F.lit(1)).over(order)})
    return summed.where((F.col("_n") == width) & (F.col("_own") == F.col("_stretch"))).select(*keys, "i", "total")


def quiet_cut(levels: DataFrame, keys: list[str], low: int, high: int, width: int, step: float) -> DataFrame:
    """The centre of the quietest window that starts and ends in [low, high): keys, at; the first of equal ones."""
    near = quiet_windows(levels.where(F.col("i").between(low, high - 1)), keys, width)
    best = near.groupBy(*keys).agg(F.min(F.struct("total", "i")).alias("best"))
    return best.select(*keys, half_up((F.col("best.i") + F.lit(width / 2)) * F.lit(step), 3).alias("at"))


def speech_blocks(levels: DataFrame, keys: list[str], length: int, slack: int, width: int, step: float) -> DataFrame:
    """Blocks of about `length` levels, each cut at the quietest window within slack of its nominal end: keys, block, lo, hi.

    The edges depend on each other, so they are folded over each series' packed window sums; edges are in half levels.
    """
    sums = quiet_windows(levels, keys, width)
    total = levels.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    packed = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda x: x["total"]).alias("sums"))
    rows = packed.join(total, keys)
    # An edge is a count of half levels: a window's centre may lie between two levels.
    last = lambda edges: F.element_at(edges, -1)
    nominal = lambda edges: last(edges) + F.lit(2 * length)

    def step_once(edges, _):
        low = F.floor((nominal(edges) - 2 * slack) / 2 + 0.5).cast("int")
        high = F.least(F.floor((nominal(edges) + 2 * slack) / 2 + 0.5).cast("int"), F.col("n").cast("int"))
        part = F.slice(F.col("sums"), low + 1, F.greatest(high - low - width + 1, F.lit(0)))
        centre = (low + F.array_position(part, F.array_min(part)).cast("int") - 1) * 2 + width
        more = (F.col("n") * 2 - last(edges)) > 2 * (length + slack)
        return F.when(more, F.concat(edges, F.array(centre.cast("long")))).otherwise(edges)

    turns = F.sequence(F.lit(0), F.floor(F.col("n") / F.lit(max(1, length - slack))).cast("int"))
    edges = F.aggregate(turns, F.array(F.lit(0).cast("long")), step_once)
    full = rows.select(*keys, F.concat(edges, F.array(F.col("n") * 2)).alias("edges"))
    pairs = full.select(*keys, "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("block"))
    at = lambda k: F.get("edges", k) * F.lit(step / 2)
    return pairs.select(*keys, F.col("block").cast("long").alias("block"), at(F.col("block")).alias("lo"), at(F.col("block") + 1).alias("hi"))


def uncovered(segments: DataFrame, frames: DataFrame, levels: DataFrame, keys: list[str], *, threshold: float, least: float, step: float, width: float) -> DataFrame:
    """Stretches of each frame (keys, a, b) of at least `least` without a segment but with sound for half of that: keys, lo, hi."""
    from chronoframe.operators.intervals import complement

    empty = complement(segments, frames, keys).where(F.col("hi") - F.col("lo") >= F.lit(least)).select(*keys, "lo", "hi")
    loud = levels.where(F.col("db") > F.lit(threshold)).select(*keys, (F.col("i") * F.lit(step)).alias("lo"), ((F.col("i") + 0.5) * F.lit(step)).alias("hi"))
    hit = overlap_join(empty, loud, keys, width)
    first, after = (F.floor(F.col(c) / F.lit(step) + 0.5) for c in ("lo", "hi"))
    inside = hit.where((F.col("rlo") >= first * F.lit(step)) & (F.col("rlo") < after * F.lit(step)))
    return inside.groupBy(*keys, "lo", "hi").agg((F.count(F.lit(1)) * F.lit(step)).alias("loud")).where(F.col("loud") >= F.lit(least / 2)).select(*keys, "lo", "hi")


def stretched(levels: DataFrame, keys: list[str], speed: float, count: int | None = None) -> DataFrame:
    """The series read at multiples of speed, linear between levels, clamped at its end: keys, i, db. As long as the series lasts, or count values."""
    last = levels.groupBy(*keys).agg(F.max("i").alias("last"))
    end = F.lit(count) if count else F.ceil((F.col("last") + 1) / F.lit(speed))
    at = last.select(*keys, "last", F.explode(F.sequence(F.lit(0).cast("long"), (end - 1).cast("long"))).alias("k"))
    place = F.least(F.col("k") * F.lit(speed), F.col("last").cast("double"))
    at = at.select(*keys, "k", F.floor(place).cast("long").alias("i"), (place - F.floor(place)).alias("share"), "last")
    one = levels.select(*keys, "i", F.col("db").alias("x"))
    two = levels.select(*keys, (F.col("i") - 1).alias("i"), F.col("db").alias("y"))
    found = at.join(one, [*keys, "i"]).join(two, [*keys, "i"], "left")
    value = F.col("x") + (F.coalesce("y", "x") - F.col("x")) * F.col("share")
    return found.select(*keys, F.col("k").alias("i"), half_up(value, 4).alias("db"))


def align(produced: DataFrame, reference: DataFrame, keys: list[str], reach: int = P.ENVELOPE_LAG + 2) -> DataFrame:
    """The lag of least mean difference (the first of equal ones), with that difference and the correlation there.

    produced[i] is held against reference[i - lag].
    """
    lagged = produced.select(*keys, F.col("db").alias("x"), "i", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"))
    lagged = lagged.withColumn("i", F.col("i") - F.col("lag"))
    pairs = lagged.join(reference.select(*keys, "i", F.col("db").alias("y")), [*keys, "i"])
    scored = pairs.groupBy(*keys, "lag").agg(
        half_up(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("difference"),
        F.count(F.lit(1)).alias("blocks"),
        F.corr("x", "y").alias("corr"),
    )
    correlation = half_up(F.when(F.col("blocks") < 4, F.lit(0.0)).otherwise(F.coalesce(F.nanvl("corr", F.lit(0.0)), F.lit(0.0))), 4)
    best = scored.groupBy(*keys).agg(F.min(F.struct("difference", "lag", correlation.alias("correlation"))).alias("b"))
    return best.select(*keys, F.col("b.lag").cast("long").alias("lag"), F.col("b.difference").alias("difference"), F.col("b.correlation").alias("correlation"))


def spread(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation, 0 for fewer than two levels: keys, spread."""
    return levels.groupBy(*keys).agg(F.coalesce(F.stddev_pop("db"), F.lit(0.0)).alias("spread"))
