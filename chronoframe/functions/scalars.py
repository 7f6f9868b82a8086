"""Scalar rules as column expressions: three roundings, grids, counts, clocks, targets and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe import parameters as P

# Latin letters and the letters without their accents; the letter n with tilde keeps it.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycAAAAAAEEEEIIIIOOOOOUUUUYC"


def number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounded to digits, halves upwards."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale


def snap(instant: Column, interval, origin=0.0) -> Column:
    """The nearest instant of a grid, ties upwards."""
    steps = F.floor((instant - number(origin)) / number(interval) + F.lit(0.5)).cast("double")
    return half_up(number(origin) + steps * number(interval), 6)


def frames_for(length: Column, fps, speed=1.0) -> Column:
    return F.greatest(F.lit(0), F.floor(length * number(fps) / number(speed) + F.lit(0.5))).cast("long")


def samples_for(frames: Column, fps, rate) -> Column:
    return F.greatest(F.lit(0), F.floor(frames.cast("double") / number(fps) * number(rate) + F.lit(0.5))).cast("long")


def frame_count(start: Column, end: Column, step) -> Column:
    """Samples of a half-open range, one at least."""
    return F.greatest(F.lit(1), F.ceil(half_up((end - start) / number(step), 9))).cast("long")


def tolerance(target: Column) -> Column:
    return F.when(target.isNotNull(), F.greatest(target * F.lit(P.TOLERANCE_RATIO), F.lit(P.TOLERANCE_FLOOR)))


def clock(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; truncated."""
    whole = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def stamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.floor(seconds * 1000 + 0.5).cast("long")
    part = lambda size, of: F.floor(ms / size).cast("long") % of
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("long"), part(60000, 60), part(1000, 60), ms % 1000)


def comma(value: Column, digits: int = 1) -> Column:
    return F.translate(F.format_string(f"%.{digits}f", half_up(value, digits)), ".", ",")


def cell(text: Column) -> Column:
    """Text that can stand in a table's cell."""
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"[\r\n]+", " ")


def ellipsis(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def normal(text: Column) -> Column:
    """Without accents, in lower case, white space made one."""
    return F.trim(F.regexp_replace(F.replace(F.lower(strip_accents(text)), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def rate_of(text: Column) -> Column:
    """Frames a second of `num/den`; null unless finite and positive."""
    parts = F.split(text, "/")
    value = F.try_divide(parts[0].try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))
    return F.when(value > 0, value)


def tempo_factors(speed: Column) -> Column:
    """Equal factors between a half and two whose product is the speed; none for a speed of one."""
    n = F.greatest(F.lit(1), F.ceil(F.log2(speed) - P.EPSILON)).cast("int")
    return F.when(speed == 1.0, F.array().cast("array<double>")).otherwise(F.array_repeat(F.pow(speed, F.lit(1.0) / n), n))


def parse_target(text: Column, total: Column) -> Column:
    """Seconds of `10%`, `720s`, `12min`, `0.5h`, `M:SS` or `H:MM:SS`; null unless above 0 and below the total."""
    plain = F.lower(F.trim(F.translate(text, ",", ".")))
    found = lambda pattern, group: F.nullif(F.regexp_extract(plain, pattern, group), F.lit("")).try_cast("double")
    amount = r"^(\d+(?:\.\d+)?)\s*"
    percent = found(amount + r"(?:%|por\s*ciento)$", 1) * total / 100
    seconds = found(amount + r"s$", 1)
    minutes = found(amount + r"min$", 1) * 60
    hours = found(amount + r"h$", 1) * 3600
    three = r"^(\d+):([0-5]\d):([0-5]\d)$"
    two = r"^(\d+):([0-5]\d)$"
    clock3 = found(three, 1) * 3600 + found(three, 2) * 60 + found(three, 3)
    clock2 = found(two, 1) * 60 + found(two, 2)
    value = F.coalesce(percent, seconds, minutes, hours, clock3, clock2)
    # A lambda's argument is computed once, however often it is used.
    return F.get(F.filter(F.array(value), lambda v: (v > 0) & (half_up(v, 3) < half_up(total, 3))), F.lit(0))


def cue_time(hours: Column, minutes: Column, seconds: Column, millis: Column) -> Column:
    whole = F.coalesce(F.nullif(hours, F.lit("")).cast("long"), F.lit(0)) * 3600 + minutes.cast("long") * 60 + seconds.cast("long")
    return whole.cast("double") + F.rpad(millis, 3, "0").cast("double") / 1000.0


def block_name(start: Column) -> Column:
    return F.concat(F.lit("b"), F.lpad(F.floor(start).cast("long").cast("string"), 5, "0"))


def percent(part: Column, whole: Column) -> Column:
    return F.concat(comma(part * 100 / whole), F.lit(" %"))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def factor(speed: Column) -> Column:
    """A speed as `×1,25`, without zeros at its end."""
    return F.concat(F.lit("×"), F.translate(F.regexp_replace(F.format_string("%.5f", speed), r"\.?0+$", ""), ".", ","))


def part_label(cut: Column, index: Column, total: Column) -> Column:
    return F.concat(F.lit("corte "), cut.cast("string"), F.lit(" subcorte "), (index + 1).cast("string"), F.lit("/"), total.cast("string"))


def space_needed(frames: Column) -> Column:
    """Bytes to keep free for so many views."""
    return frames.cast("long") * 1_000_000
