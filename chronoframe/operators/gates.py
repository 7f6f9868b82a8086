"""Checks that let a plan pass: settings, parents, acceptance, digests, sources, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import half_up, parse_target, tolerance
from chronoframe.operators.media import HIGH_RANGE, finite

SPEEDS = (1.0, 2.0)


def effective_settings(drafts: DataFrame, speed: float = 1.25) -> DataFrame:
    """Settings in effect: those of the call, else of the draft, else the usual ones.

    drafts: job, total, and for each of target, speed, pauses, silence_db the draft's value and that of the call (call_...).
    Gives job, target, seconds, tolerance, speed, remove_pauses, silence_db and problem, null if they may be used.
    """
    either = lambda name, usual: F.coalesce(F.col(f"call_{name}"), F.col(name), F.lit(usual))
    target = F.coalesce("call_target", "target")
    rows = drafts.select("job", "total", target.alias("target"), either("speed", speed).alias("speed"), either("pauses", True).alias("remove_pauses"), either("silence_db", P.SILENCE_DB).alias("silence_db"))
    rows = rows.withColumn("seconds", parse_target(F.col("target"), F.col("total")))
    bad = F.isnan("speed") | ~F.col("speed").between(*SPEEDS)
    problem = F.when(bad, "speed").when(F.isnan("silence_db") | (F.abs("silence_db") == float("inf")), "silence_db").when(F.col("target").isNotNull() & F.col("seconds").isNull(), "target")
    return rows.select("job", "target", "seconds", tolerance(F.col("seconds")).alias("tolerance"), half_up(F.col("speed"), 3).alias("speed"), "remove_pauses", "silence_db", problem.alias("problem"))


def unknown_parents(drafts: DataFrame, versions: DataFrame) -> DataFrame:
    """Drafts (job, draft, parent) whose parent is no published version (job, version): job, draft, parent."""
    known = versions.select("job", F.col("version").alias("parent")).distinct()
    return drafts.where("parent is not null").join(known, ["job", "parent"], "left_anti").select("job", "draft", "parent")


def accepted(asked: DataFrame, warnings: DataFrame) -> DataFrame:
    """Jobs (job, phrase, direct) with state, detail, cuts and, if accepted, the phrase: blocking warnings (job, id, code, message, blocking)
    stop all; else a phrase or direct is needed."""
    entry = F.struct("code", "message")
    listed = warnings.where("blocking").groupBy("job").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("ids"))
    text = F.array_join(F.transform("entries", lambda x: F.concat(x["code"], F.lit(": "), x["message"])), "; ")
    rows = asked.join(listed.select("job", text.alias("detail"), F.nullif(F.array_join("ids", ", "), F.lit("")).alias("cuts")), "job", "left")
    state = F.when(F.col("detail").isNotNull(), "bloqueado").when(~F.col("direct") & F.col("phrase").isNull(), "sin_aceptar").otherwise("aceptado")
    return rows.select("job", state.alias("state"), "detail", "cuts", F.when(state == "aceptado", F.col("phrase")).alias("phrase"))


def outline_accepted(stored: Column, computed: Column, phrase: Column) -> Column:
    """Null for an outline that is untouched and comes with a phrase, else what is wrong."""
    return F.when(F.coalesce(F.trim(phrase) == "", F.lit(True)), "phrase").when(~stored.eqNullSafe(computed), "sha256")


def sources_agree(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Per job the parts of the fingerprint (job, path, size, mtime_ns, sha256) that differ, and whether the file has only moved."""
    now = current.select("job", *[F.col(c).alias(f"_{c}") for c in ("path", "size", "mtime_ns", "sha256")])
    rows = planned.join(now, "job", "left")
    wrong = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("size", "mtime_ns", "sha256")]), lambda x: x.isNotNull())
    return rows.select("job", wrong.alias("differ"), ((F.size(wrong) == 0) & ~F.col("path").eqNullSafe(F.col("_path"))).alias("moved"))


def high_range(stream: Column) -> Column:
    """Whether a picture has a transfer function of high dynamic range, which a montage would not keep."""
    return F.coalesce(stream["color_transfer"].isin(*HIGH_RANGE), F.lit(False))


def mark_seconds(text: Column, total: Column) -> Column:
    """The seconds of a mark, null unless a finite number within the recording."""
    value = finite(text)
    return F.when(value.between(F.lit(0.0), total), value)


def merged_settings(usual: Column, own: Column) -> Column:
    """Settings (maps) with one's own over the usual ones."""
    return F.map_concat(F.map_filter(usual, lambda k, v: ~F.map_contains_key(own, k)), own)


def complete(fields: Column, needed: tuple[str, ...]) -> Column:
    """Whether all needed names are among the fields (an array)."""
    return F.size(F.array_except(F.array(*map(F.lit, needed)), fields)) == 0
