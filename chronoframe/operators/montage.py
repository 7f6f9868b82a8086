"""The relational side of a montage: parts, cache keys, hits, estimates, distances and validation marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import half_up


def canonical(**fields: Column) -> Column:
    """Compact JSON with sorted keys of integers and strings."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(text: Column, size: int = 64) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, size)


def ends_digest(content: Column, most: int = 8 << 20, part: int = 4 << 20) -> Column:
    """SHA-256 of bytes, or of their first and last `part` if they are more than `most`."""
    ends = F.concat(F.substring(content, 1, part), F.substring(content, -part, part))
    return F.sha2(F.when(F.octet_length(content) <= most, content).otherwise(ends), 256)


def render_key(source: Column, track: Column, spans: Column, speed: Column, rate: Column, encoder: Column, index: Column, total: Column, release: Column) -> Column:
    """The key of a rendered part, over all that changes it: source (size, mtime_ns, sha256), spans as pairs of seconds, settings, encoder and release."""
    three = F.transform(spans, lambda s: F.transform(s, lambda x: x.cast("decimal(18,3)")))
    mark = F.struct(source["mtime_ns"].alias("mtime_ns"), source["sha256"].alias("sha256"), source["size"].alias("size"))
    fields = [("cadencia", rate), ("codificador", encoder), ("ffmpeg", release), ("huella", mark), ("pista", track), ("subcorte", F.array(index, total)), ("tramos", three), ("velocidad", speed.cast("decimal(10,6)"))]
    return digest(F.to_json(F.struct(*[c.alias(n) for n, c in fields])), 32)


def cached(parts: DataFrame, notes: DataFrame) -> DataFrame:
    """Parts (key, frames, samples) with `hit`: a note of the same key and counts exists."""
    known = notes.select("key", "frames", "samples", F.lit(True).alias("_hit")).distinct()
    return parts.join(known, ["key", "frames", "samples"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def eta(parts: DataFrame, notes: DataFrame, keys: list[str], prior: float = 0.5, assembly: float = 0.25, fps: float = 25.0) -> DataFrame:
    """Per job reused and new parts and the seconds the new ones need; by the notes with both seconds and frames, else a prior."""
    measured = notes.where("seconds is not null and frames > 0").groupBy(*keys).agg((F.sum("seconds_ms") / F.sum("frames") / 1000.0).alias("cost"))
    sums = cached(parts, notes).groupBy(*keys).agg(
        F.count_if("hit").alias("reused"), F.count_if(~F.col("hit")).alias("new"),
        F.coalesce(F.sum(F.when(~F.col("hit"), F.col("frames"))), F.lit(0)).alias("frames"), F.sum("frames").alias("all_frames"),
    )
    rows = sums.join(measured, keys, "left")
    cost = F.coalesce("cost", F.lit(prior / fps))
    return rows.select(*keys, "reused", "new", half_up(F.col("frames") * cost + F.col("all_frames") / fps * assembly, 3).alias("eta"))


def image_distance(left: Column, right: Column, scale: float = 255.0) -> Column:
    """Mean absolute difference of two vectors over the scale; null if their sizes differ."""
    total = F.aggregate(F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(left) == F.size(right), total / F.size(left) / F.lit(scale))


def image_mark(distance: Column) -> Column:
    return F.when(distance > P.IMAGE_FAIL, "fail").when(distance > P.IMAGE_OK, "mark").otherwise("ok")


def envelope_mark(difference: Column, lag: Column, correlation: Column, spread: Column) -> Column:
    poor = (F.abs(lag) > P.ENVELOPE_LAG) | (difference > P.ENVELOPE_FAIL)
    unlike = (spread >= P.ENVELOPE_SPREAD) & (correlation < P.ENVELOPE_CORRELATION)
    return F.when(poor, "fail").when((difference > P.ENVELOPE_OK) | unlike, "mark").otherwise("ok")
