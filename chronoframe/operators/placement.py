"""Where source time lands in the output: offsets, the time map, labels and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import clock


def placements(cuts: DataFrame, fps: float, speed: float) -> DataFrame:
    """Cuts (job, id, start, end, frames, spans) with offset, length and stretches (a, b, out), in order of start and id."""
    before = Window.partitionBy("job").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("frames").over(before), F.lit(0)) / F.lit(fps)
    rows = cuts.withColumns({"offset": offset, "length": F.col("frames") / F.lit(fps)})
    done = lambda i: F.aggregate(F.slice("spans", 1, i), F.lit(0.0), lambda a, s: a + (s["hi"] - s["lo"]))
    stretch = lambda s, i: F.struct(s["lo"].alias("a"), s["hi"].alias("b"), (F.col("offset") + done(i) / F.lit(speed)).alias("out"))
    return rows.withColumn("stretches", F.transform("spans", stretch))


def output_at(instants: DataFrame, placed: DataFrame, speed: float) -> DataFrame:
    """Instants (job, t) with `out`: inside a stretch, at the next stretch from a removed pause, at the cut's end after the last;
    null outside all cuts. Bounds are closed; the first cut in order wins.

    Instants are often exploded, which their estimated size does not show: the hint keeps them from being broadcast."""
    cuts = placed.select(F.col("job").alias("of"), "start", "id", F.col("end"), "stretches", "offset", "length")
    times = instants.groupBy("job", "t").agg(F.count(F.lit(1)).alias("n"))
    hit = times.hint("merge").join(cuts, F.expr("job = of and start <= t and t <= end"), "left")
    t = F.col("t")
    after = F.filter("stretches", lambda s: t <= s["b"])
    first = F.get(after, F.lit(0))
    out = F.when(F.size(after) == 0, F.col("offset") + F.col("length")).when(t < first["a"], first["out"]).otherwise(first["out"] + (t - first["a"]) / F.lit(speed))
    best = hit.groupBy("job", "t", "n").agg(F.min(F.when(F.col("of").isNotNull(), F.struct("start", "id", out.alias("o")))).alias("best"))
    return best.select("job", "t", F.col("best.o").alias("out"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def moment(t: Column, out: Column) -> Column:
    return F.when(out.isNull(), F.concat(clock(t), F.lit(" (no incluido en el resumen)"))).otherwise(F.concat(clock(t), F.lit(" (resumen "), clock(out), F.lit(")")))


def span_label(a: Column, b: Column, first: Column, last: Column) -> Column:
    label = F.concat(clock(a), F.lit("–"), clock(b))
    return (
        F.when(first.isNotNull() & last.isNotNull(), F.concat(label, F.lit(" (resumen "), clock(first), F.lit("–"), clock(last), F.lit(")")))
        .when(first.isNull() & last.isNull(), F.concat(label, F.lit(" (no incluido en el resumen)")))
        .otherwise(F.concat(label, F.lit(" (incluido en parte en el resumen)")))
    )


def bar(cuts: DataFrame, width: int, full: str, empty: str) -> DataFrame:
    """Per job (cuts: job, start, end, total) a line of `width` signs, full where a cut touches the slot."""
    slot = lambda x: F.floor(F.col(x) / F.col("total") * F.lit(width)).cast("int")
    last = F.least(F.lit(width - 1), F.greatest(slot("start"), F.ceil(F.col("end") / F.col("total") * F.lit(width)).cast("int") - 1))
    touched = cuts.withColumn("s", F.explode(F.sequence(F.least(slot("start"), F.lit(width - 1)), last)))
    marked = touched.groupBy("job").agg(F.collect_set("s").alias("s"))
    signs = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.array_contains("s", i), F.lit(full)).otherwise(F.lit(empty)))
    return marked.select("job", F.array_join(signs, "").alias("bar"))
