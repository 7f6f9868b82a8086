"""Transcripts: subtitles, words, edges at words, search with context, word coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import cue_time, half_up, normal
from chronoframe.operators.intervals import overlap_join

# The grammar of a cue and of styling tags.
CUE = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
TAG = r"<[^>]*>|\{\\[^}]*\}"


def subtitles(files: DataFrame) -> DataFrame:
    """Cues of SRT or WebVTT texts (job, text): job, lo, hi, text. A cue's body ends at a blank line, at the next cue, or at
    a number alone before a cue; tags go; cues without text or that end before they begin are left out."""
    clean = F.regexp_replace(F.regexp_replace("text", "﻿", ""), "\r\n?", "\n")
    lines = files.select("job", F.posexplode(F.split(clean, "\n", -1)).alias("n", "line"))
    order = Window.partitionBy("job").orderBy("n")
    lines = lines.withColumn("cue", F.col("line").rlike(CUE))
    lines = lines.withColumns({"after": F.coalesce(F.lead("cue").over(order), F.lit(False)), "c": F.sum(F.col("cue").cast("int")).over(order)})
    stop = ~F.col("cue") & ((F.trim("line") == "") | (F.trim("line").rlike(r"^\d+$") & F.col("after")))
    within = Window.partitionBy("job", "c").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.where("c > 0").withColumn("stopped", F.max(stop.cast("int")).over(within))
    said = F.trim(F.regexp_replace("line", TAG, ""))
    body = F.when(~F.col("cue") & (F.col("stopped") == 0) & (said != ""), F.struct("n", said.alias("said")))
    cues = lines.groupBy("job", "c").agg(F.max(F.when(F.col("cue"), F.col("line"))).alias("head"), F.array_sort(F.collect_list(body)).alias("body"))
    part = lambda k: F.regexp_extract("head", CUE, k)
    found = cues.select(
        "job", cue_time(*[part(k) for k in (1, 2, 3, 4)]).alias("lo"), cue_time(*[part(k) for k in (5, 6, 7, 8)]).alias("hi"),
        F.trim(F.array_join(F.transform("body", lambda x: x["said"]), " ")).alias("text"),
    )
    return found.where("text <> '' and hi > lo")


def word_edges(edges: DataFrame, words: DataFrame, width: float = 30.0) -> DataFrame:
    """Edges (job, edge, side and what else) moved to the gap next to the word they split: with moved, null if no gap is near enough.

    side is -1 for a start and 1 for an end. A word that is at least half inside the cut is kept, else dropped. Words of a
    job do not overlap, so an edge meets one at most.
    """
    order = Window.partitionBy("job").orderBy("lo", "hi")
    around = words.select("job", F.col("lo").alias("wlo"), F.col("hi").alias("whi"), F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = around.withColumn("_b", F.explode(F.sequence(bucket("wlo"), bucket("whi")))).withColumnRenamed("job", "_job")
    here = (F.col("job") == F.col("_job")) & (F.col("_at") == F.col("_b")) & (F.col("wlo") < F.col("edge")) & (F.col("edge") < F.col("whi"))
    hit = edges.withColumn("_at", bucket("edge")).join(spread, here, "left")
    ahead = F.when(F.col("before").isNull(), F.col("wlo") - P.WORD_PAD).otherwise(F.greatest((F.col("before") + F.col("wlo")) / 2, F.col("wlo") - P.WORD_PAD))
    behind = F.when(F.col("after").isNull(), F.col("whi") + P.WORD_PAD).otherwise(F.least((F.col("whi") + F.col("after")) / 2, F.col("whi") + P.WORD_PAD))
    start = F.col("side") < 0
    kept = F.when(start, F.col("whi") - F.col("edge")).otherwise(F.col("edge") - F.col("wlo"))
    keep = 2 * kept >= F.col("whi") - F.col("wlo")
    wide, narrow = F.when(start, F.greatest(F.lit(0.0), ahead)).otherwise(behind), F.when(start, behind).otherwise(ahead)
    first, second = F.when(keep, wide).otherwise(narrow), F.when(keep, narrow).otherwise(wide)
    near = lambda c: F.abs(c - F.col("edge")) <= P.WORD_SHIFT
    moved = F.when(F.col("wlo").isNull(), F.col("edge")).when(near(first), half_up(first, 6)).when(near(second), half_up(second, 6))
    return hit.select(*edges.columns, moved.alias("moved"))


def clamp(rows: DataFrame) -> DataFrame:
    """Cuts (job, id, lo, hi, start) in order: an end goes no further than the next start, a start not before the last end.

    lo and hi are the adjusted edges, start is the original one.
    """
    order = Window.partitionBy("job").orderBy("start", "id")
    rows = rows.withColumn("hi", F.least("hi", F.lead("start").over(order)))
    return rows.withColumn("lo", F.greatest("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))))


def coverage(cuts: DataFrame, words: DataFrame, width: float = 30.0) -> DataFrame:
    """Per cut (job, id, lo, hi, spans) the words that touch it and those wholly inside a span: job, id, words, covered, share, lost."""
    pairs = overlap_join(cuts.select("job", "id", "lo", "hi", "spans"), words.select("job", "lo", "hi", "text", "seg", "w"), ["job"], width)
    slack = P.COVERAGE_SLACK
    whole = F.exists("spans", lambda s: (s["lo"] - slack <= F.col("rlo")) & (F.col("rhi") <= s["hi"] + slack))
    place = ["rlo", "rhi", "seg", "w"]
    pairs = pairs.withColumn("_whole", whole)
    # Lost words are ranked before they are collected, so that a list has ten at most.
    pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("job", "id").orderBy("_whole", *place)))
    lost = F.when(~F.col("_whole") & (F.col("_n") <= 10), F.struct(*place, "text"))
    found = pairs.groupBy("job", "id").agg(F.count(F.lit(1)).alias("words"), F.count_if("_whole").alias("covered"), F.array_sort(F.collect_list(lost)).alias("lost"))
    rows = cuts.select("job", "id").join(found, ["job", "id"], "left")
    n, c = F.coalesce("words", F.lit(0)), F.coalesce("covered", F.lit(0))
    share = F.when(n > 0, half_up(c / n, 3)).otherwise(F.lit(1.0))
    return rows.select("job", "id", n.alias("words"), c.alias("covered"), share.alias("share"), F.coalesce(F.transform("lost", lambda x: x["text"]), F.array().cast("array<string>")).alias("lost"))


def coverage_summary(per_cut: DataFrame) -> DataFrame:
    """Per job the micro mean and the least share, and whether they call for a warning."""
    sums = per_cut.groupBy("job").agg(F.sum("words").alias("words"), F.sum("covered").alias("covered"), F.min("share").alias("least"))
    mean = F.when(F.col("words") > 0, half_up(F.col("covered") / F.col("words"), 3)).otherwise(F.lit(1.0))
    return sums.select("job", "words", "covered", mean.alias("mean"), "least", ((mean < P.LOW_MEAN) | (F.col("least") < P.LOW_CUT)).alias("low"))


def recovered(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Segments (job, lo, hi, text) and those that a second pass found, marked and numbered in one order."""
    both = segments.select("job", "lo", "hi", "text", F.lit(False).alias("recovered")).unionByName(found.select("job", "lo", "hi", "text", F.lit(True).alias("recovered")))
    order = Window.partitionBy("job").orderBy("lo", "hi", "recovered")
    return both.withColumn("seg", F.row_number().over(order).cast("long") - 1)


def frozen(blocks: DataFrame, value: str) -> DataFrame:
    """Blocks (job, block) with what the job's first one that knows it says, for all of them."""
    first = blocks.where(F.col(value).isNotNull()).groupBy("job").agg(F.min_by(value, "block").alias("frozen"))
    return blocks.join(first, "job", "left")


def hits(segments: DataFrame, needle: Column) -> DataFrame:
    """Places of a needle in segments (text column `text`): all columns with nth and at, 0-based in the normalised text; no two overlap.

    The text is cut at the needle; each piece but the last is followed by one place.
    """
    size = F.length("_needle")
    rows = segments.withColumns({"_hay": normal(F.col("text")), "_needle": normal(needle)}).where("_needle <> ''")
    quoted = F.concat(F.lit(r"\Q"), F.col("_needle"), F.lit(r"\E"))
    pieces = F.transform(F.split("_hay", quoted, -1), lambda p: F.length(p))
    rows = rows.withColumn("_pieces", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
    found = rows.select("*", F.posexplode("_pieces").alias("nth", "_length"))
    before = F.aggregate(F.slice("_pieces", 1, F.col("nth") + 1), F.lit(0), lambda a, b: a + b)
    return found.withColumn("at", before + F.col("nth") * size).drop("_hay", "_needle", "_pieces", "_length")


def search_totals(found: DataFrame, limit: int) -> DataFrame:
    """Per job its hits, and how many of them a search shows that stops after `limit` in scan order: job, total, shown.

    Only counts of jobs are put in order, not the hits.
    """
    totals = found.groupBy("job").agg(F.count(F.lit(1)).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("job").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.select("job", "total", F.least("total", F.greatest(F.lit(0), limit - before)).cast("long").alias("shown"))


def context(segments: DataFrame, around: int = 1) -> DataFrame:
    """Segments with the trimmed texts of those up to `around` before and after, joined."""
    order = Window.partitionBy("job").orderBy("seg").rowsBetween(-around, around)
    return segments.withColumn("context", F.array_join(F.collect_list(F.trim("text")).over(order), " "))


def haystack(words: DataFrame) -> DataFrame:
    """Words with their place in the segment's normalised text (words joined by one space); words that normalise to nothing go."""
    rows = words.withColumn("norm", normal(F.col("text"))).where("norm <> ''")
    before = Window.partitionBy("job", "seg").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("norm") + 1).over(before), F.lit(0)))


def owners(found: DataFrame, places: DataFrame) -> DataFrame:
    """Hits (job, seg, nth, at) with the word that owns their first character: w, lo."""
    pairs = found.join(places.select("job", "seg", "w", "lo", "offset", "norm"), ["job", "seg"])
    return pairs.where((F.col("at") >= F.col("offset")) & (F.col("at") < F.col("offset") + F.length("norm") + 1)).drop("offset", "norm")
