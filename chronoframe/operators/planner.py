"""Decisions of a plan: measures, estimates, states, what-if runs, suggestions, warnings, validation, versions.

Cuts are rows (job, id, start_ms, end_ms, kept_ms, priority, included, pinned, remove_pauses, depends_on); jobs are rows (job,
total, target, speed) in seconds. Times are added up as integers, so results do not depend on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import comma, frames_for, half_up, samples_for, tolerance

FPS, SAMPLE_RATE = 25.0, 48000.0


def measure(cuts: DataFrame, speed: Column, pauses: Column | None = None) -> DataFrame:
    """Cuts with frames, samples, output, length, empty. pauses: whether the job removes pauses at all."""
    removes = F.col("remove_pauses") if pauses is None else F.col("remove_pauses") & pauses
    kept = F.when(removes, F.col("kept_ms")).otherwise(F.col("end_ms") - F.col("start_ms"))
    length = kept / 1000.0
    frames = frames_for(length, FPS, speed)
    return cuts.withColumns({"length_ms": kept, "frames": frames, "samples": samples_for(frames, FPS, SAMPLE_RATE), "empty": length < speed / FPS - P.EPSILON}).withColumn("output", F.col("frames") / FPS)


def band(target: Column) -> tuple[Column, Column]:
    margin = tolerance(target)
    return F.when(target.isNotNull(), F.greatest(F.lit(0.0), target - margin)), target + margin


# The names of states and warnings below are fixed values.


def state_of(output: Column, essentials: Column, target: Column, top: Column) -> Column:
    low, high = band(target)
    return (
        F.when(target.isNull(), "sin_objetivo")
        .when(target > top + tolerance(target), "inalcanzable")
        .when(essentials > high, "inviable")
        .when(output > high, "por_encima")
        .when(output < low, "por_debajo")
        .otherwise("ok")
    )


def estimate(cuts: DataFrame, jobs: DataFrame, keys: tuple = ("job",), pauses: Column | None = None) -> DataFrame:
    """One row per job (and further keys of jobs) with everything that is shown about length, and the state.

    The cuts of a job that has none of its own rows in jobs are left out; both sides meet on the job alone.
    """
    rows = measure(cuts.join(jobs, "job"), F.col("speed"), pauses)
    kept = F.col("included") & ~F.col("empty")
    source = F.col("end_ms") - F.col("start_ms")
    sums = rows.groupBy(*keys).agg(
        F.first("total").alias("total"), F.first("target").alias("target"), F.first("speed").alias("speed"),
        F.count_if(kept).alias("cuts"),
        F.coalesce(F.sum(F.when(kept, source)), F.lit(0)).alias("source_ms"),
        F.coalesce(F.sum(F.when(kept, F.col("length_ms"))), F.lit(0)).alias("after_ms"),
        F.coalesce(F.sum(F.when(kept, F.col("frames"))), F.lit(0)).alias("frames"),
        F.coalesce(F.sum(F.when(kept & (F.col("priority") == 1), F.col("frames"))), F.lit(0)).alias("essential_frames"),
        F.sum(source).alias("all_ms"), F.sum("length_ms").alias("all_kept_ms"),
    )
    ratio = half_up(F.col("all_kept_ms") / F.col("all_ms"), 6)
    share = F.when(F.col("all_ms") <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), ratio)))
    sums = sums.withColumns({"retention": share, "output": F.col("frames") / FPS, "essentials": F.col("essential_frames") / FPS})
    top = F.col("total") * F.col("retention") / F.col("speed")
    low, high = band(F.col("target"))
    return sums.select(
        *keys, "cuts", "total", "target", "speed", "output", "retention", "essentials",
        half_up(F.col("source_ms") / 1000.0, 3).alias("source"), half_up(F.col("after_ms") / 1000.0, 3).alias("after_pauses"),
        half_up(100 * F.col("output") / F.col("total"), 2).alias("percent"), half_up(low, 3).alias("low"), half_up(high, 3).alias("high"),
        half_up(F.col("target") * F.col("speed") / F.col("retention"), 3).alias("budget"),
        half_up(100 * F.col("essentials") / F.col("total"), 2).alias("minimum"), half_up(top, 3).alias("maximum"),
        state_of(F.col("output"), F.col("essentials"), F.col("target"), top).alias("state"),
    )


def alternatives(cuts: DataFrame, jobs: DataFrame, speeds=(1.0, 1.25), pauses=(True, False)) -> DataFrame:
    """The estimate for each speed with and without pauses: job, speed, pauses, output, state."""
    settings = F.explode(F.array(*[F.struct(F.lit(s).alias("speed"), F.lit(p).alias("pauses")) for s in speeds for p in pauses]))
    tried = jobs.drop("speed").select("*", settings.alias("s")).select("job", "total", "target", "s.speed", "s.pauses")
    found = estimate(cuts, tried.withColumn("tried", F.col("speed")), ("job", "tried", "pauses"), F.col("pauses"))
    return found.select("job", "speed", "pauses", half_up(F.col("output"), 3).alias("output"), "state")


def movable(cuts: DataFrame) -> DataFrame:
    """Cuts with `free`: not pinned and no included cut depends on it. Essential cuts are the caller's."""
    needed = cuts.where("included and depends_on is not null").select("job", F.col("depends_on").alias("id"), F.lit(True).alias("needed")).distinct()
    return cuts.join(needed, ["job", "id"], "left").withColumn("free", ~F.col("pinned") & F.col("needed").isNull()).drop("needed")


def take_until(rows: DataFrame, excess: Column, order: list[Column]) -> DataFrame:
    """Rows in order, each taken while the outputs taken before it are less than the excess."""
    along = Window.partitionBy("job").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("frames").over(along), F.lit(0)) / FPS
    return rows.withColumn("_before", before).where(F.col("_before") < excess).drop("_before")


def _listed(rows: DataFrame, order: list) -> DataFrame:
    return rows.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "id"))), lambda x: x["id"]).alias("cuts"))


def suggest_drop(cuts: DataFrame, jobs: DataFrame) -> DataFrame:
    """For jobs above their band: the cuts that would go to reserves, least important and longest first."""
    report = estimate(cuts, jobs).where("state = 'por_encima'").select("job", (half_up(F.col("output"), 3) - F.col("high")).alias("excess"), F.col("speed"))
    rows = measure(movable(cuts).join(report, "job"), F.col("speed")).where("included and not empty and free and priority > 1")
    rank = [(-F.col("priority")).alias("p"), (-F.col("frames")).alias("f")]
    taken = take_until(rows, F.col("excess"), [*rank, F.col("id")])
    return _listed(taken, rank)


def suggest_sacrifice(cuts: DataFrame, jobs: DataFrame) -> DataFrame:
    """For infeasible jobs: a speed that would do, the essential cuts to give up, the least percentage."""
    report = estimate(cuts, jobs).where("state = 'inviable'")
    needed = F.col("speed") * half_up(F.col("essentials"), 3) / F.col("high")
    faster = F.when(needed <= P.FAST_SPEED, F.ceil(needed * 20) / 20.0)
    report = report.select("job", "speed", faster.alias("faster"), "minimum", (half_up(F.col("essentials"), 3) - F.col("high")).alias("excess"))
    rows = measure(movable(cuts).join(report, "job"), F.col("speed")).where("included and not empty and free and priority = 1")
    rank = [(-F.col("frames")).alias("f")]
    taken = _listed(take_until(rows, F.col("excess"), [*rank, F.col("id")]), rank)
    return report.select("job", "faster", "minimum").join(taken, "job", "left")


def suggest_add(cuts: DataFrame, jobs: DataFrame) -> DataFrame:
    """For jobs below their band: reserves that fit, by importance and length; each may need one chosen before it.

    Whether a cut fits depends on the ones chosen before, so each job's reserves are folded in order.
    """
    report = estimate(cuts, jobs).where("state = 'por_debajo'").select("job", "speed", (F.col("high") - half_up(F.col("output"), 3)).alias("room"))
    inside = cuts.where("included").groupBy("job").agg(F.collect_set("id").alias("inside"))
    rows = measure(cuts.join(report, "job"), F.col("speed")).where("not included and not empty")
    packed = rows.groupBy("job").agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct("priority", "frames", "id", "depends_on"))).alias("reserves"))
    packed = packed.join(inside, "job", "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<bigint>")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("cuts"))

    def step(state, cut):
        met = cut["depends_on"].isNull() | F.array_contains("inside", cut["depends_on"]) | F.array_contains(state["cuts"], cut["depends_on"])
        fits = cut["frames"] / FPS <= F.col("room") - state["used"] / FPS
        more = F.struct((state["used"] + cut["frames"]).alias("used"), F.concat(state["cuts"], F.array(cut["id"])).alias("cuts"))
        return F.when(F.coalesce(met, F.lit(False)) & fits, more).otherwise(state)

    return packed.select("job", F.aggregate("reserves", start, step)["cuts"].alias("cuts")).where(F.size("cuts") > 0)


# The texts of warnings.
SAID = {
    "corte_vacio": "El corte {cut} se queda sin tramos tras quitar pausas; vuelve a las reservas.",
    "borde_en_voz": "El corte {cut} no encuentra silencio en los 0,6 s del borde ni hueco entre palabras: la unión puede partir una palabra.",
    "visual_breve": "El corte visual {cut} dura {output} s de salida; cuesta leerlo.",
    "corte_breve": "El corte {cut} dura {output} s de salida; puede quedar descontextualizado.",
    "pausas_excesivas": "En el corte {cut} se elimina el {removed} % por pausas.",
    "sin_pausas_detectadas": "El fondo del corte {cut} supera {quiet} dBFS: revisa el umbral de silencio.",
    "velocidad_alta": "Velocidad ×{speed}: por encima de ×1,5 la voz técnica cuesta de seguir.",
    "objetivo_muy_bajo": "El objetivo ({target} s) es menor que el 5 % del original ({low} s).",
    "objetivo_muy_alto": "Ni conservando todo el material se llega a {target} s: el máximo es {top} s.",
    "esenciales_superan_objetivo": "Los cortes de prioridad 1 suman {essentials} s, por encima de la banda.",
    "sin_marcas_por_palabra": "La transcripción procede de subtítulos sin palabras: los bordes usan límites de segmento.",
    "dependencia_excluida": "El corte {cut} depende del {other}, que no está incluido.",
    "tema_sin_cubrir": "El tema «{topic}» se marcó imprescindible y no tiene ningún corte incluido.",
}


def said(code: str, **values: Column) -> Column:
    """The text of a warning with its values."""
    parts = re.split(r"\{(\w+)\}", SAID[code])
    return F.concat(*[values[part].cast("string") if at % 2 else F.lit(part) for at, part in enumerate(parts)])


def whole(value: Column) -> Column:
    return half_up(value).cast("long")


def _warned(rows: DataFrame, keys: list[str], rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """A row for each rule (condition, code, text) that holds: keys, code, message, blocking."""
    found = F.array(*[F.when(rule, F.struct(F.lit(code).alias("code"), text.alias("message"))) for rule, code, text in rules])
    rows = rows.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("w")).select(*keys, "w.code", "w.message")
    return rows.withColumn("blocking", F.col("code").isin(*P.BLOCKING))


def _having(rows: DataFrame, **defaults) -> DataFrame:
    """rows with columns that are missing or null at their defaults."""
    return rows.withColumns({name: F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value) for name, value in defaults.items()})


def untouched(visual_only: Column, remove_pauses: Column) -> Column:
    """Whether a cut's sound is kept whole: a visual one, or one that keeps its pauses."""
    return visual_only | ~remove_pauses


def cut_warnings(cuts: DataFrame, jobs: DataFrame, silence_db: float = P.SILENCE_DB) -> DataFrame:
    """Warnings of included cuts: job, id, code, message, blocking. An empty cut has that one alone.

    Cuts may have note (an edge stayed in speech), visual_only and quiet, the tenth percentile of their levels; jobs pauses,
    whether the job removes them at all.
    """
    rows = _having(cuts.where("included"), note=False, visual_only=False, quiet=-1e9).join(_having(jobs, pauses=True), "job")
    rows = measure(rows, F.col("speed"), F.col("pauses"))
    removed = 1 - F.col("length_ms") / (F.col("end_ms") - F.col("start_ms"))
    full, cut, visual = ~F.col("empty"), F.col("id"), F.col("visual_only")
    pauses = full & F.col("pauses") & ~untouched(visual, F.col("remove_pauses"))
    floor = silence_db - P.QUIET_MARGIN
    shown = F.translate(whole(F.lit(floor)).cast("string"), "-", "−")
    return _warned(rows, ["job", "id"], [
        (F.col("empty"), "corte_vacio", said("corte_vacio", cut=cut)),
        (full & F.col("note"), "borde_en_voz", said("borde_en_voz", cut=cut)),
        (full & visual & (F.col("output") < P.SHORT_VISUAL), "visual_breve", said("visual_breve", cut=cut, output=comma(F.col("output")))),
        (full & ~visual & (F.col("output") < P.SHORT_CUT), "corte_breve", said("corte_breve", cut=cut, output=comma(F.col("output")))),
        (pauses & (removed > P.PAUSE_SHARE), "pausas_excesivas", said("pausas_excesivas", cut=cut, removed=whole(100 * removed))),
        (pauses & (F.col("quiet") > floor), "sin_pausas_detectadas", said("sin_pausas_detectadas", cut=cut, quiet=shown)),
    ])


def global_warnings(cuts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Warnings of jobs: job, code, message, blocking. jobs may have worded: whether words have times of their own."""
    report = estimate(cuts, jobs).join(_having(jobs, worded=True).select("job", "worded"), "job")
    target, total = F.col("target"), F.col("total")
    return _warned(report, ["job"], [
        (F.col("speed") > P.FAST_SPEED, "velocidad_alta", said("velocidad_alta", speed=comma(F.col("speed"), 2))),
        (target < P.LOW_TARGET * total, "objetivo_muy_bajo", said("objetivo_muy_bajo", target=whole(target), low=whole(P.LOW_TARGET * total))),
        (F.col("state") == "inalcanzable", "objetivo_muy_alto", said("objetivo_muy_alto", target=whole(target), top=whole(F.col("maximum")))),
        (F.col("state") == "inviable", "esenciales_superan_objetivo", said("esenciales_superan_objetivo", essentials=whole(F.col("essentials")))),
        (~F.col("worded"), "sin_marcas_por_palabra", said("sin_marcas_por_palabra")),
    ])


def dependency_warnings(cuts: DataFrame) -> DataFrame:
    """Included cuts that depend on a cut that is not: job, id, depends_on, message."""
    wanted = cuts.where("included and depends_on is not null").select("job", "id", "depends_on")
    inside = cuts.where("included").select("job", F.col("id").alias("depends_on"))
    text = said("dependencia_excluida", cut=F.col("id"), other=F.col("depends_on"))
    return wanted.join(inside, ["job", "depends_on"], "left_anti").select("job", "id", "depends_on", text.alias("message"))


def topic_warnings(topics: DataFrame, cuts: DataFrame) -> DataFrame:
    """Essential topics (job, topic, id) without any included cut: job, topic, n (their cuts), message.

    A cut that an included one absorbed (cuts.absorbed, ids) is inside it.
    """
    inside = cuts.where("included").select("job", F.explode(F.concat(F.array("id"), F.col("absorbed") if "absorbed" in cuts.columns else F.array().cast("array<bigint>"))).alias("id"))
    rows = topics.join(inside.distinct().withColumn("inside", F.lit(True)), ["job", "id"], "left")
    found = rows.groupBy("job", "topic").agg(F.coalesce(F.bool_or("inside"), F.lit(False)).alias("covered"), F.count(F.lit(1)).alias("n"))
    return found.where("not covered").select("job", "topic", "n", said("tema_sin_cubrir", topic=F.col("topic")).alias("message"))


def violations(draft: DataFrame, texts: tuple = ("title",), flags: tuple = ()) -> DataFrame:
    """Broken rules of a draft (job, id, start_ms, end_ms, priority, depends_on: ids or one; and if known total_ms): job, id, rule, n.

    texts and flags name the columns that must not be blank or null.
    """
    own = [
        (F.coalesce(F.col("id") <= 0, F.lit(True)), "id"), (F.col("start_ms").isNull() | F.col("end_ms").isNull(), "number"), (F.col("end_ms") <= F.col("start_ms"), "empty"),
        (F.coalesce(~F.col("priority").isin(1, 2, 3), F.lit(True)), "priority"), (F.col("start_ms") < F.coalesce("_before", F.lit(0)), "order"),
        *[(F.coalesce(F.trim(name) == "", F.lit(True)), name) for name in texts], *[(F.col(name).isNull(), name) for name in flags],
        (F.exists("_refs", lambda x: F.coalesce(x == F.col("id"), F.lit(False))), "self"), (F.exists("_refs", lambda x: x.isNull()), "dependency"),
        (F.size(F.array_distinct("_refs")) < F.size("_refs"), "repeated"),
    ]
    if "total_ms" in draft.columns:
        own.append((F.col("end_ms") > F.col("total_ms"), "range"))
    listed = draft.schema["depends_on"].dataType.typeName() == "array"
    refs = F.col("depends_on") if listed else F.filter(F.array("depends_on"), lambda x: x.isNotNull())
    order = Window.partitionBy("job").orderBy("start_ms", "end_ms", "id")
    rows = draft.withColumns({"_before": F.lag("end_ms").over(order), "_refs": F.coalesce(refs, F.array().cast("array<bigint>"))})
    codes = F.filter(F.array(*[F.when(rule, F.lit(code)) for rule, code in own]), lambda x: x.isNotNull())
    single = rows.select("job", "id", F.explode(codes).alias("rule")).groupBy("job", "id", "rule").agg(F.count(F.lit(1)).alias("n"))
    twice = draft.groupBy("job", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("job", "id", F.lit("duplicate").alias("rule"), "n")
    named = rows.select("job", "id", F.explode("_refs").alias("ref")).where("ref is not null")
    known = draft.select("job", F.col("id").alias("ref")).distinct()
    lost = named.join(known, ["job", "ref"], "left_anti").groupBy("job", "id").agg(F.count(F.lit(1)).alias("n"))
    return single.unionByName(twice).unionByName(lost.select("job", "id", F.lit("reference").alias("rule"), "n"))


def topic_violations(topics: DataFrame, draft: DataFrame) -> DataFrame:
    """Broken rules of topics (job, topic, name, cuts: ids, essential): job, topic, rule."""
    known = draft.select("job", F.col("id").alias("cut")).distinct()
    cited = topics.select("job", "topic", F.explode("cuts").alias("cut")).where("cut is not null")
    lost = cited.join(known, ["job", "cut"], "left_anti").select("job", "topic").distinct().withColumn("lost", F.lit(True))
    rows = topics.join(lost, ["job", "topic"], "left")
    rules = [
        (F.coalesce(F.trim("name") == "", F.lit(True)), "name"), (F.exists("cuts", lambda x: x.isNull()) | (F.size(F.array_distinct("cuts")) < F.size("cuts")), "cuts"),
        (F.col("lost").isNotNull(), "reference"), (F.col("essential").isNull(), "essential"),
    ]
    codes = F.filter(F.array(*[F.when(rule, F.lit(code)) for rule, code in rules]), lambda x: x.isNotNull())
    return rows.select("job", "topic", F.explode(codes).alias("rule"))


def exclusion_violations(excluded: DataFrame) -> DataFrame:
    """Exclusions (job, position, title, reason) that lack a text: job, position."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return excluded.where(blank("title") | blank("reason")).select("job", "position")


def version_diff(old: DataFrame, new: DataFrame, slack_ms: int = 50) -> DataFrame:
    """Cuts (job, id, length_ms, title) that were added, removed or changed: job, id, change, before_ms, after_ms."""
    a = old.select("job", "id", F.col("length_ms").alias("before_ms"), F.col("title").alias("_old"))
    b = new.select("job", "id", F.col("length_ms").alias("after_ms"), F.col("title").alias("_new"))
    both = a.join(b, ["job", "id"], "full_outer")
    changed = (F.abs(F.col("before_ms") - F.col("after_ms")) > slack_ms) | (F.col("_old") != F.col("_new"))
    change = F.when(F.col("before_ms").isNull(), "added").when(F.col("after_ms").isNull(), "removed").when(changed, "changed")
    return both.withColumn("change", change).where("change is not null").select("job", "id", "change", "before_ms", "after_ms")


def fuse(rows: DataFrame, interval: float) -> DataFrame:
    """Neighbours (job, id, lo, hi, included, priority, pinned, text) nearer than a frame and alike in `included` as one.

    id and priority are the least, pinned is any, texts are joined where the next differs from all so far; absorbed lists ids.
    Of further columns visual_only and remove_pauses hold if they do for all, and depends_on (ids) lists those outside.
    """
    further = [c for c in ("visual_only", "remove_pauses") if c in rows.columns]
    leans = "depends_on" in rows.columns
    order = Window.partitionBy("job").orderBy("lo", "hi", "id")
    gap = F.col("lo") - F.lag("hi").over(order)
    new = F.lag("hi").over(order).isNull() | (gap >= F.lit(interval - P.EPSILON)) | (F.col("included") != F.lag("included").over(order))
    marked = rows.withColumn("_new", new.cast("int")).withColumn("_group", F.sum("_new").over(order))
    grouped = marked.groupBy("job", "_group").agg(
        F.min("id").alias("id"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("included").alias("included"),
        F.min("priority").alias("priority"), F.bool_or("pinned").alias("pinned"),
        F.array_sort(F.collect_list(F.struct("lo", "hi", "id", "text"))).alias("_parts"), *[F.bool_and(c).alias(c) for c in further],
        *([F.flatten(F.collect_list("depends_on")).alias("_refs")] if leans else []),
    )

    def joined(text, part):
        same = (text == part["text"]) | (F.trim(text) == "") | (F.trim(part["text"]) == "")
        return F.when(same, text).otherwise(F.concat(text, F.lit(" · "), part["text"]))

    text = F.aggregate(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), F.col("_parts")[0]["text"], joined)
    ids = F.array_sort(F.transform("_parts", lambda x: x["id"]))
    return grouped.select("job", "id", "lo", "hi", "included", "priority", "pinned", text.alias("text"), F.array_except(ids, F.array("id")).alias("absorbed"),
                          *further, *([F.array_sort(F.array_except("_refs", ids)).alias("depends_on")] if leans else []))


def remap(edges: DataFrame, fused: DataFrame) -> DataFrame:
    """Dependencies (job, id, depends_on) after fusion: ends follow the survivors, loops fall away."""
    kept = fused.select("job", F.explode(F.concat(F.array("id"), "absorbed")).alias("old"), F.col("id").alias("new"))
    one = edges.join(kept.select("job", F.col("old").alias("id"), F.col("new").alias("from")), ["job", "id"])
    two = one.join(kept.select("job", F.col("old").alias("depends_on"), F.col("new").alias("to")), ["job", "depends_on"])
    return two.where(F.col("from") != F.col("to")).select("job", F.col("from").alias("id"), F.col("to").alias("depends_on")).distinct()
