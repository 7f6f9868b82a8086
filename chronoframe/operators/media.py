"""Facts of a recording from its probe document: lengths, rates, kind and the frame grid that a job shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import half_up, rate_of

PROBE = (
    "format struct<duration:string,start_time:string,format_name:string>, audio_stream int, "
    "streams array<struct<index:int,codec_type:string,r_frame_rate:string,avg_frame_rate:string,start_time:string,duration:string,"
    "sample_rate:string,color_transfer:string,tags:map<string,string>,disposition:struct<attached_pic:int>>>"
)
# Demuxers that can only be read forward, and transfer functions of high dynamic range.
FORWARD_ONLY = ("mpegts", "mpeg", "asf", "flv")
HIGH_RANGE = ("smpte2084", "arib-std-b67")


def finite(text: Column) -> Column:
    """The number in a text; null for none, infinity and what is no number."""
    value = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def duration() -> Column:
    value = finite(F.col("format.duration"))
    return F.when(value > 0, value)


def start() -> Column:
    return F.coalesce(finite(F.col("format.start_time")), F.lit(0.0))


def tag_seconds(stream: Column) -> Column:
    """Seconds of a tag DURATION of the form HH:MM:SS.fraction."""
    found = F.map_values(F.map_filter(stream["tags"], lambda k, v: F.upper(k).startswith("DURATION")))
    parts = F.split(F.get(found, F.lit(0)), ":")
    value = parts[0].try_cast("double") * 3600 + parts[1].try_cast("double") * 60 + parts[2].try_cast("double")
    return F.when(F.size(parts) == 3, value)


def stream_duration(stream: Column) -> Column:
    own = finite(stream["duration"])
    return F.least(F.coalesce(F.when(own > 0, own), tag_seconds(stream), duration()), duration())


def stream_end(stream: Column) -> Column:
    late = F.greatest(F.coalesce(finite(stream["start_time"]), F.lit(0.0)) - start(), F.lit(0.0))
    return F.least(late + stream_duration(stream), duration())


def seek_margin() -> Column:
    return F.when(F.arrays_overlap(F.split("format.format_name", ","), F.array(*map(F.lit, FORWARD_ONLY))), 10.0).otherwise(3.0)


def pictures() -> Column:
    """Picture streams that are not cover art."""
    return F.filter("streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0))


def sounds() -> Column:
    return F.filter("streams", lambda s: s["codec_type"] == "audio")


def kind() -> Column:
    return F.when(F.size(sounds()) == 0, F.lit(None)).when(F.size(pictures()) > 0, "video").otherwise("audio")


def output_rate(stream: Column) -> Column:
    """The first of the two declared rates that is plausible, else `30`."""
    fine = lambda c: F.when(rate_of(c) <= 120, c)
    return F.coalesce(fine(stream["r_frame_rate"]), fine(stream["avg_frame_rate"]), F.lit("30"))


def timeline(probes: DataFrame) -> DataFrame:
    """Probe documents with kind, start, origin, rate, fps, interval, sample_rate; the grid is null for sound alone."""
    rows = probes.withColumns({"_picture": F.get(pictures(), F.lit(0)), "_sounds": sounds()})
    chosen = F.coalesce(F.get(F.filter("_sounds", lambda s: s["index"] == F.col("audio_stream")), F.lit(0)), F.get("_sounds", F.lit(0)))
    rows = rows.withColumns({"kind": kind(), "start": start(), "_sound": chosen})
    rows = rows.withColumn("rate", F.when(F.col("_picture").isNotNull(), output_rate(F.col("_picture"))))
    rows = rows.withColumn("interval", 1.0 / rate_of(F.col("rate")))
    late = F.coalesce(finite(F.col("_picture.start_time")), F.lit(0.0)) - F.col("start")
    origin = F.when(F.col("rate").isNull() | (late < 0), 0.0).otherwise(half_up(late % F.col("interval"), 9))
    rows = rows.withColumns({"origin": origin, "fps": half_up(1.0 / F.col("interval"), 9), "sample_rate": F.coalesce(F.col("_sound.sample_rate").try_cast("int"), F.lit(0))})
    return rows.drop("_picture", "_sounds", "_sound")


def packet_gaps(packets: DataFrame, factor: float = 1.5, most: int = 600) -> DataFrame:
    """Of each job's first packets (job, stamp, interval) the steps longer than factor intervals: job, packets, gaps, longest."""
    order = Window.partitionBy("job").orderBy("stamp")
    known = packets.where(F.col("stamp").try_cast("double").isNotNull()).withColumn("stamp", F.col("stamp").cast("double"))
    first = known.withColumns({"_n": F.row_number().over(order), "_gap": F.col("stamp") - F.lag("stamp").over(order)}).where(F.col("_n") <= most)
    wide = F.when(F.col("_gap") > F.col("interval") * factor, half_up(F.col("_gap"), 6))
    return first.groupBy("job").agg(F.count(F.lit(1)).alias("packets"), F.count(wide).alias("gaps"), F.max(wide).alias("longest"))


# The texts of warnings on a source.
VARIABLE = ("fuente_vfr", "La cadencia declarada no es constante (r_frame_rate ", ", avg_frame_rate ", "): el montaje fija F y normaliza con el filtro fps.")
GAPS = ("huecos_pts", "El sondeo de los primeros ", " paquetes encuentra ", " saltos mayores de un fotograma (el mayor, ", " s): puede faltar imagen en el original.")


def packet_warnings(probes: DataFrame, packets: DataFrame) -> DataFrame:
    """Of recordings with pictures and sound, whether the declared rate is not constant and whether first packets (job, stamp) are missing:
    job, code, message, blocking."""
    rows = timeline(probes).where("kind = 'video'")
    rows = rows.select("job", "interval", F.get(pictures(), F.lit(0)).alias("picture"))
    rates = [F.col("picture.r_frame_rate"), F.col("picture.avg_frame_rate")]
    varies = F.concat(F.lit(VARIABLE[1]), rates[0], F.lit(VARIABLE[2]), rates[1], F.lit(VARIABLE[3]))
    uneven = rows.where(~rates[0].eqNullSafe(rates[1])).select("job", F.lit(VARIABLE[0]).alias("code"), varies.alias("message"))
    found = packet_gaps(packets.join(rows.select("job", "interval"), "job")).where("gaps > 0")
    missing = F.concat(F.lit(GAPS[1]), "packets", F.lit(GAPS[2]), "gaps", F.lit(GAPS[3]), F.format_string("%.3f", "longest"), F.lit(GAPS[4]))
    return uneven.unionByName(found.select("job", F.lit(GAPS[0]).alias("code"), missing.alias("message"))).withColumn("blocking", F.lit(False))
