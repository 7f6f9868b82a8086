"""Queries on candidate cuts and their jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import frame_count, frames_for, half_up, parse_target as target_of, samples_for, snap, tolerance
from chronoframe.operators import blocks, gates, intervals, planner, reports
from chronoframe.sources import bindings as B


def _cuts(spark, sf_dir):
    return B.cuts(B.table(spark, sf_dir, "lineitem"))


def _jobs(spark, sf_dir):
    cuts = _cuts(spark, sf_dir)
    return cuts, B.jobs(cuts, B.table(spark, sf_dir, "orders"))


def frame_snap(spark, sf_dir):
    cuts = _cuts(spark, sf_dir)
    lo, hi = snap(F.col("start_ms") / 1000.0, 0.04, 0.032), snap(F.col("end_ms") / 1000.0, 0.04, 0.032)
    rows = cuts.select("job", "id", lo.alias("lo"), hi.alias("hi"), frames_for(F.col("kept_ms") / 1000.0, 25.0, 1.25).alias("frames"))
    return rows.withColumn("samples", samples_for(F.col("frames"), 25.0, 48000.0))


def plan_estimate(spark, sf_dir):
    cuts, jobs = _jobs(spark, sf_dir)
    found = planner.estimate(cuts, jobs)
    return found.select("job", "cuts", "source", "after_pauses", half_up(F.col("output"), 3).alias("output"), "percent", "low", "high", "retention", half_up(F.col("essentials"), 3).alias("essentials"), "budget", "minimum", "maximum", "state")


def plan_state(spark, sf_dir):
    cuts, jobs = _jobs(spark, sf_dir)
    return planner.estimate(cuts, jobs).groupBy("state").agg(F.count(F.lit(1)).alias("jobs"), F.sum("cuts").alias("cuts"))


def plan_alternatives(spark, sf_dir):
    return planner.alternatives(*_jobs(spark, sf_dir))


def suggest_drop(spark, sf_dir):
    found = planner.suggest_drop(*_jobs(spark, sf_dir))
    return found.select("job", F.array_join("cuts", ",").alias("cuts"))


def suggest_add(spark, sf_dir):
    found = planner.suggest_add(*_jobs(spark, sf_dir))
    return found.select("job", F.array_join("cuts", ",").alias("cuts"))


def suggest_infeasible(spark, sf_dir):
    found = planner.suggest_sacrifice(*_jobs(spark, sf_dir))
    return found.select("job", "faster", "minimum", F.array_join("cuts", ",").alias("cuts"))


def _warned_cuts(spark, sf_dir):
    cuts, jobs = _jobs(spark, sf_dir)
    return planner.cut_warnings(cuts, jobs.withColumn("pauses", F.col("job") % 10 != 0))


def _warned_jobs(spark, sf_dir):
    cuts, jobs = _jobs(spark, sf_dir)
    return planner.global_warnings(cuts, jobs.withColumn("worded", F.col("job") % 6 != 0))


def cut_warnings(spark, sf_dir):
    return _warned_cuts(spark, sf_dir)


def global_warnings(spark, sf_dir):
    return _warned_jobs(spark, sf_dir)


def dependency_warnings(spark, sf_dir):
    return planner.dependency_warnings(_cuts(spark, sf_dir))


def topic_warnings(spark, sf_dir):
    cuts, part = _cuts(spark, sf_dir), B.table(spark, sf_dir, "part")
    cuts = cuts.withColumn("absorbed", F.when(F.col("id") % 2 == 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<bigint>")))
    topics = cuts.join(part, F.col("part") == F.col("p_partkey")).where("p_type in ('ECONOMY', 'PROMO')").select("job", F.col("p_type").alias("topic"), "id")
    return planner.topic_warnings(topics, cuts)


def _draft(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber").cast("long")
    other = F.when(F.col("l_partkey") % 17 == 0, F.array(line - 2, line - 2)).otherwise(F.array(line - 2))
    return rows.select(
        F.col("l_orderkey").alias("job"), line.alias("id"), (line * 30000).alias("start_ms"), (line * 30000 + F.round(F.col("l_quantity") * 1000)).cast("long").alias("end_ms"),
        F.when(F.col("l_discount") > 0.09, 4).otherwise(1).alias("priority"), F.when(line % 3 == 0, other).otherwise(F.array().cast("array<bigint>")).alias("depends_on"),
        F.col("l_returnflag").alias("title"), F.when(F.col("l_suppkey") % 7 == 0, " ").otherwise("said").alias("phrase"),
        F.when(F.col("l_partkey") % 13 > 0, F.col("l_tax") > 0.04).alias("pinned"), F.lit(230000).cast("long").alias("total_ms"),
    )


def draft_violations(spark, sf_dir):
    return planner.violations(_draft(spark, sf_dir), ("title", "phrase"), ("pinned",))


def topic_violations(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("long") % 9, F.col("p_partkey")
    topics = part.select(
        key.alias("job"), F.lit(1).alias("topic"), F.when(key % 10 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("name"),
        F.array(size, F.when(key % 7 == 0, size).otherwise(size + 1)).alias("cuts"), F.when(key % 11 > 0, key % 2 == 0).alias("essential"),
    )
    return planner.topic_violations(topics, _draft(spark, sf_dir))


def exclusion_violations(spark, sf_dir):
    customer = B.table(spark, sf_dir, "customer")
    reason = F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).when(F.col("c_custkey") % 8 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return planner.exclusion_violations(customer.select(F.col("c_nationkey").alias("job"), F.col("c_custkey").alias("position"), F.col("c_name").alias("title"), reason.alias("reason")))


def plan_acceptance(spark, sf_dir):
    both = _warned_cuts(spark, sf_dir).unionByName(_warned_jobs(spark, sf_dir), allowMissingColumns=True)
    _, jobs = _jobs(spark, sf_dir)
    asked = jobs.select("job", F.when(F.col("job") % 3 == 0, F.concat(F.lit("sí, la "), "job")).when(F.col("job") % 3 == 1, " ").alias("phrase"), (F.col("job") % 5 == 0).alias("direct"))
    return gates.accepted(asked, both)


def _versions(spark, sf_dir):
    cuts = _cuts(spark, sf_dir)
    old = cuts.where("included").select("job", "id", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"), F.concat(F.lit("cut "), "id").alias("title"))
    new = cuts.where("(included and (pinned or priority < 3)) or (not included and priority = 1)")
    less = F.when(F.col("remove_pauses") & F.col("depends_on").isNotNull(), 1000).when(F.col("pinned"), 40).otherwise(0)
    title = F.concat(F.lit("cut "), "id", F.when(F.col("pinned") & (F.col("priority") == 2), F.lit(" b")).otherwise(F.lit("")))
    return old, new.select("job", "id", (F.col("end_ms") - F.col("start_ms") - less).alias("length_ms"), title.alias("title"))


def version_diff(spark, sf_dir):
    return planner.version_diff(*_versions(spark, sf_dir))


def import_draft(spark, sf_dir):
    cuts = _cuts(spark, sf_dir)
    return cuts.select("job", "id", "start_ms", "end_ms", F.lit(1).alias("priority"), F.lit(True).alias("included"), F.lit(False).alias("pinned"))


def revert_draft(spark, sf_dir):
    cuts = _cuts(spark, sf_dir).select("job", "id", "start_ms", "end_ms", "included")
    segments, reserves = cuts.where("included"), cuts.where("not included")
    return segments.drop("included").withColumn("included", F.lit(True)).unionByName(reserves.drop("included").withColumn("included", F.lit(False)))


def _neighbours(spark, sf_dir):
    cuts = _cuts(spark, sf_dir)
    return cuts.select("job", "id", (F.col("start_ms") / 1000.0).alias("lo"), (F.col("end_ms") / 1000.0).alias("hi"), "included", "priority", "pinned", F.concat(F.lit("t"), F.floor(F.col("id") / 2)).alias("text"), "visual_only", "remove_pauses",
                       F.filter(F.array("depends_on"), lambda x: x.isNotNull()).alias("depends_on"))


def fused_cuts(spark, sf_dir):
    found = planner.fuse(_neighbours(spark, sf_dir), 0.04)
    return found.withColumns({c: F.array_join(c, ",") for c in ("absorbed", "depends_on")})


def dependency_remap(spark, sf_dir):
    edges = _cuts(spark, sf_dir).where("depends_on is not null").select("job", "id", "depends_on")
    return planner.remap(edges, planner.fuse(_neighbours(spark, sf_dir), 0.04))


def _pieces(spark, sf_dir):
    """Many short spans per supplier, so that parts of 40 arise."""
    rows = B.table(spark, sf_dir, "lineitem")
    spans = rows.select(F.col("l_suppkey").alias("job"), F.col("l_orderkey").cast("double").alias("lo"), F.col("l_quantity").alias("q")).groupBy("job", "lo").agg(F.max("q").alias("q"))
    return spans.select("job", "lo", (F.col("lo") + F.floor(F.col("q")) / 64.0).alias("hi"))


def subcut_split(spark, sf_dir):
    spans = _pieces(spark, sf_dir)
    totals = spans.groupBy("job").agg(F.sum(F.col("hi") - F.col("lo")).alias("length"))
    totals = totals.select("job", frames_for(F.col("length"), 25.0, 1.25).alias("frames")).withColumn("samples", samples_for(F.col("frames"), 25.0, 48000.0))
    return intervals.chunks(spans, ["job"], totals, 25.0, 1.25, 48000.0)


def part_checks(spark, sf_dir):
    spans, parts = _pieces(spark, sf_dir), subcut_split(spark, sf_dir)
    whole = spans.groupBy("job").agg(F.count(F.lit(1)).alias("n_spans"), frames_for(F.sum(F.col("hi") - F.col("lo")), 25.0, 1.25).alias("frames"))
    sums = parts.groupBy("job").agg(F.sum("n_spans").alias("part_spans"), F.sum("frames").alias("part_frames"), F.max("n_spans").alias("most"))
    return whole.join(sums, "job").select("job", "n_spans", "frames", ((F.col("n_spans") == F.col("part_spans")) & (F.col("frames") == F.col("part_frames")) & (F.col("most") <= 40)).alias("agree"))


def _blocks(spark, sf_dir):
    _, jobs = _jobs(spark, sf_dir)
    rows = blocks.blocks(jobs.select("job", F.lit(0.0).alias("a"), F.col("total").alias("b")), ["job"], 60.0)
    return rows.withColumn("frames", frame_count(F.col("lo"), F.col("hi"), 15.0))


def sweep_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).withColumn("sheets", F.greatest(F.lit(1), F.ceil(F.col("frames") / float(P.SHEET_VIEWS))).cast("long"))


def sweep_budget(spark, sf_dir):
    found = blocks.within_budget(_blocks(spark, sf_dir), ["job"], ["block"], "frames", 10)
    return found.select("job", "block", "frames", F.col("now").alias("done"))


def resume_blocks(spark, sf_dir):
    planned = _blocks(spark, sf_dir)
    # The first two minutes are done, but short blocks were left damaged.
    done = planned.where("lo < 120").withColumn("frames", F.when(F.col("hi") - F.col("lo") < 60, 0).otherwise(F.col("frames")))
    left = blocks.pending(planned, done, ["job", "block", "frames"])
    return blocks.within_budget(left, ["job"], ["block"], "frames", 8).select("job", "block", "frames", "now")


def proposal_text(spark, sf_dir):
    return reports.proposal(planner.estimate(*_jobs(spark, sf_dir)))


def parse_target(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 97 + 1
    kind = F.col("o_orderkey") % 7
    text = (
        F.when(kind == 0, F.concat(n, F.lit("%"))).when(kind == 1, F.concat(n, F.lit(" s"))).when(kind == 2, F.concat(n % 40, F.lit(",5 min")))
        .when(kind == 3, F.concat(F.lit("0:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":30"))).when(kind == 4, F.concat(n % 60, F.lit(":15")))
        .when(kind == 5, F.concat(n % 3, F.lit(".5h"))).otherwise(F.concat(n, F.lit(" mucho")))
    )
    rows = orders.select(F.col("o_orderkey").alias("job"), text.alias("text"), (F.col("o_orderkey") % 50 * 60.0 + 600.0).alias("total"))
    rows = rows.withColumn("value", target_of(F.col("text"), F.col("total")))
    return rows.select("job", "text", half_up(F.col("value"), 6).alias("seconds"), half_up(tolerance(F.col("value")), 6).alias("tolerance"))


def labels_fallback(spark, sf_dir):
    cuts = _cuts(spark, sf_dir).where("included")
    named = F.when(F.col("p_size") > 20, F.col("p_name"))
    labels = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), named.alias("label"))
    title = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Title "), "id")).otherwise(F.lit(" "))
    rows = cuts.withColumn("title", title).join(labels, "part", "left")
    named = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Corte "), "id"))
    return rows.select("job", "id", named.alias("label"))


def version_reserve(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("job")).agg((F.coalesce(F.max(F.col("o_orderkey") % 1000), F.lit(0)) + 1).alias("version"))


_C, _J = "with " + B.CUTS_SQL, "with " + B.JOBS_SQL
_R3 = lambda x: f"(floor(({x}) * 1000.0::double + 0.5::double) / 1000.0::double)"

MEASURED_SQL = """,
me as (select c.*, j.total, j.target, j.speed, case when remove_pauses then kept_ms else end_ms - start_ms end as length_ms from cuts c join jobs j using (job)),
ms as (select *, cast(greatest(0, floor(length_ms / 1000.0::double * 25 / speed + 0.5)) as bigint) as frames, length_ms / 1000.0::double < speed / 25 - 1e-9 as empty from me),
su as (select job, any_value(total) as total, any_value(target) as target, any_value(speed) as speed, count(*) filter (where included and not empty) as cuts,
         coalesce(sum(end_ms - start_ms) filter (where included and not empty), 0) as source_ms, coalesce(sum(length_ms) filter (where included and not empty), 0) as after_ms,
         coalesce(sum(frames) filter (where included and not empty), 0) / 25.0::double as output, coalesce(sum(frames) filter (where included and not empty and priority = 1), 0) / 25.0::double as essentials,
         greatest(1e-6, least(1, floor(sum(length_ms) / sum(end_ms - start_ms)::double * 1000000.0::double + 0.5::double) / 1000000.0::double)) as retention from ms group by job),
es as (select *, greatest(target * 0.05::double, 10) as margin, case when target is not null then greatest(0, target - greatest(target * 0.05::double, 10)) end as low0, target + greatest(target * 0.05::double, 10) as high0, total * retention / speed as top from su),
st as (select *, case when target is null then 'sin_objetivo' when target > top + margin then 'inalcanzable' when essentials > high0 then 'inviable'
                      when output > high0 then 'por_encima' when output < low0 then 'por_debajo' else 'ok' end as state from es),
mv as (select m.*, not pinned and not exists (select 1 from cuts d where d.job = m.job and d.included and d.depends_on = m.id) as free from ms m)"""
_M = _J + MEASURED_SQL

QUERIES = {f.__name__: f for f in (
    frame_snap, plan_estimate, plan_state, plan_alternatives, suggest_drop, suggest_add, suggest_infeasible, cut_warnings, global_warnings, dependency_warnings,
    topic_warnings, draft_violations, topic_violations, exclusion_violations, plan_acceptance, version_diff, import_draft, revert_draft, fused_cuts, dependency_remap, subcut_split, part_checks, sweep_blocks,
    sweep_budget, resume_blocks, proposal_text, parse_target, labels_fallback, version_reserve,
)}

_COMMA = lambda x, n=1: f"replace(printf('%.{n}f', floor(({x}) * {10**n}.0::double + 0.5::double) / {10**n}.0::double), '.', ',')"
_WHOLE = lambda x: f"cast(floor(({x}) + 0.5::double) as bigint)"
_WARNED_SQL = _M + f""",
wm as (select c.*, speed, job % 10 <> 0 as pauses, case when remove_pauses and job % 10 <> 0 then kept_ms else end_ms - start_ms end as length_ms from cuts c join jobs using (job) where included),
wr as (select *, greatest(0, floor(length_ms / 1000.0::double * 25 / speed + 0.5)) / 25.0::double as output, length_ms / 1000.0::double < speed / 25 - 1e-9 as empty, 1 - length_ms / (end_ms - start_ms)::double as removed,
              pauses and not visual_only and remove_pauses as measured from wm),
cw as (select job, id, 'corte_vacio' as code, 'El corte ' || id || ' se queda sin tramos tras quitar pausas; vuelve a las reservas.' as message, true as blocking from wr where empty
 union all select job, id, 'borde_en_voz', 'El corte ' || id || ' no encuentra silencio en los 0,6 s del borde ni hueco entre palabras: la unión puede partir una palabra.', false from wr where not empty and note
 union all select job, id, 'visual_breve', 'El corte visual ' || id || ' dura ' || {_COMMA('output')} || ' s de salida; cuesta leerlo.', false from wr where not empty and visual_only and output < 4
 union all select job, id, 'corte_breve', 'El corte ' || id || ' dura ' || {_COMMA('output')} || ' s de salida; puede quedar descontextualizado.', false from wr where not empty and not visual_only and output < 3
 union all select job, id, 'pausas_excesivas', 'En el corte ' || id || ' se elimina el ' || {_WHOLE('100 * removed')} || ' % por pausas.', false from wr where not empty and measured and removed > 0.45::double
 union all select job, id, 'sin_pausas_detectadas', 'El fondo del corte ' || id || ' supera −53 dBFS: revisa el umbral de silencio.', false from wr where not empty and measured and quiet > -53),
gw as (select job, 'velocidad_alta' as code, 'Velocidad ×' || {_COMMA('speed', 2)} || ': por encima de ×1,5 la voz técnica cuesta de seguir.' as message, false as blocking from st where speed > 1.5
 union all select job, 'objetivo_muy_bajo', 'El objetivo (' || {_WHOLE('target')} || ' s) es menor que el 5 % del original (' || {_WHOLE('0.05::double * total')} || ' s).', false from st where target < 0.05::double * total
 union all select job, 'objetivo_muy_alto', 'Ni conservando todo el material se llega a ' || {_WHOLE('target')} || ' s: el máximo es ' || {_WHOLE(_R3('top'))} || ' s.', false from st where state = 'inalcanzable'
 union all select job, 'esenciales_superan_objetivo', 'Los cortes de prioridad 1 suman ' || {_WHOLE('essentials')} || ' s, por encima de la banda.', true from st where state = 'inviable'
 union all select job, 'sin_marcas_por_palabra', 'La transcripción procede de subtítulos sin palabras: los bordes usan límites de segmento.', false from st where job % 6 = 0)"""
_DRAFT_SQL = """with d as (select l_orderkey as job, l_linenumber::bigint as id, l_linenumber * 30000::bigint as start_ms, cast(l_linenumber * 30000 + round(l_quantity * 1000) as bigint) as end_ms,
case when l_discount > 0.09 then 4 else 1 end as priority, case when l_linenumber % 3 <> 0 then [] when l_partkey % 17 = 0 then [l_linenumber - 2, l_linenumber - 2] else [l_linenumber - 2] end as refs,
l_suppkey % 7 = 0 as silent, l_partkey % 13 = 0 as undecided from lineitem)"""
_PIECES_SQL = """with p0 as (select l_suppkey as job, l_orderkey::double as lo, max(l_quantity) as q from lineitem group by all),
sp as (select job, lo, lo + floor(q) / 64.0::double as hi from p0),
tt as (select job, count(*) as n, cast(floor(sum(hi - lo) * 25 / 1.25::double + 0.5) as bigint) as frames from sp group by job),
pp as (select job, (row_number() over (partition by job order by lo) - 1) // 40 as part, hi - lo as len from sp),
pa as (select job, part, count(*) as n_spans, cast(floor(sum(len) * 25 / 1.25::double + 0.5) as bigint) as own from pp group by all),
pb as (select pa.*, tt.frames as total, cast(floor(tt.frames / 25.0::double * 48000 + 0.5) as bigint) as samples, part = max(part) over (partition by job) as last,
       coalesce(sum(own) over (partition by job order by part rows between unbounded preceding and 1 preceding), 0) as taken from pa join tt using (job)),
pc as (select *, case when last then greatest(total - taken, 0) else least(own, greatest(total - taken, 0)) end as f from pb),
pd as (select *, cast(floor(f / 25.0::double * 48000 + 0.5) as bigint) as s from pc),
pe as (select job, part, n_spans, f as frames, case when last then samples - coalesce(sum(s) over (partition by job order by part rows between unbounded preceding and 1 preceding), 0) else s end as samples from pd)"""

ORACLES = {
    "frame_snap": _C + """ select job, id, floor((0.032::double + floor((start_ms / 1000.0::double - 0.032::double) / 0.04::double + 0.5) * 0.04::double) * 1000000.0::double + 0.5::double) / 1000000.0::double as lo,
floor((0.032::double + floor((end_ms / 1000.0::double - 0.032::double) / 0.04::double + 0.5) * 0.04::double) * 1000000.0::double + 0.5::double) / 1000000.0::double as hi, f as frames, cast(floor(f / 25.0::double * 48000 + 0.5) as bigint) as samples
from (select *, cast(floor(kept_ms / 1000.0::double * 25 / 1.25::double + 0.5) as bigint) as f from cuts)""",
    "plan_estimate": _M + f""" select job, cast(cuts as bigint) as cuts, {_R3('source_ms / 1000.0::double')} as source, {_R3('after_ms / 1000.0::double')} as after_pauses, {_R3('output')} as output,
floor(100 * output / total * 100.0::double + 0.5::double) / 100.0::double as percent, {_R3('low0')} as low, {_R3('high0')} as high, retention, {_R3('essentials')} as essentials,
{_R3('target * speed / retention')} as budget, floor(100 * essentials / total * 100.0::double + 0.5::double) / 100.0::double as minimum, {_R3('top')} as maximum, state from st""",
    "plan_state": _M + " select state, cast(count(*) as bigint) as jobs, cast(sum(cuts) as bigint) as cuts from st group by state",
    "plan_alternatives": _J + f""",
al as (select c.*, total, target, s.speed, p.pauses, case when remove_pauses and p.pauses then kept_ms else end_ms - start_ms end as length_ms from cuts c join jobs j using (job), (values (1.0::double), (1.25::double)) s(speed), (values (true), (false)) p(pauses)),
af as (select *, cast(floor(length_ms / 1000.0::double * 25 / speed + 0.5) as bigint) as frames, length_ms / 1000.0::double < speed / 25 - 1e-9 as empty from al),
ag as (select job, speed, pauses, any_value(total) as total, any_value(target) as target, coalesce(sum(frames) filter (where included and not empty), 0) / 25.0::double as output,
       coalesce(sum(frames) filter (where included and not empty and priority = 1), 0) / 25.0::double as essentials,
       greatest(1e-6, least(1, floor(sum(length_ms) / sum(end_ms - start_ms)::double * 1000000.0::double + 0.5::double) / 1000000.0::double)) as retention from af group by all),
ah as (select *, greatest(target * 0.05::double, 10) as m, total * retention / speed as top from ag)
select job, speed, pauses, {_R3('output')} as output, case when target is null then 'sin_objetivo' when target > top + m then 'inalcanzable' when essentials > target + m then 'inviable'
 when output > target + m then 'por_encima' when output < greatest(0, target - m) then 'por_debajo' else 'ok' end as state from ah""",
    "suggest_drop": _M + f""",
ca as (select m.job, m.id, m.priority, m.frames, {_R3('s.output')} - {_R3('s.high0')} as excess from mv m join st s using (job) where s.state = 'por_encima' and included and not empty and free and priority > 1),
cb as (select *, coalesce(sum(frames) over (partition by job order by priority desc, frames desc, id rows between unbounded preceding and 1 preceding), 0) / 25.0::double as before from ca)
select job, string_agg(cast(id as varchar), ',' order by priority desc, frames desc, id) as cuts from cb where before < excess group by job""",
    "suggest_add": _J.replace("with ", "with recursive ", 1) + MEASURED_SQL + f""",
rs as (select m.job, m.id, m.frames, {_R3('s.high0')} - {_R3('s.output')} as room, m.depends_on is null or exists (select 1 from cuts d where d.job = m.job and d.id = m.depends_on and d.included) as met, m.depends_on,
       row_number() over (partition by m.job order by m.priority, m.frames, m.id) as n from ms m join st s using (job) where s.state = 'por_debajo' and not m.included and not empty),
fo as (select distinct job, 0::bigint as n, 0::bigint as used, []::bigint[] as chosen from rs union all
       select f.job, r.n, case when (met or list_contains(chosen, depends_on)) and frames / 25.0::double <= room - used / 25.0::double then used + frames else used end,
              case when (met or list_contains(chosen, depends_on)) and frames / 25.0::double <= room - used / 25.0::double then list_append(chosen, id) else chosen end
       from fo f join rs r on r.job = f.job and r.n = f.n + 1)
select job, array_to_string(arg_max(chosen, n), ',') as cuts from fo group by job having len(arg_max(chosen, n)) > 0""",
    "suggest_infeasible": _M + f""",
iv as (select job, floor(100 * essentials / total * 100.0::double + 0.5::double) / 100.0::double as minimum, {_R3('essentials')} - {_R3('high0')} as excess,
       case when speed * {_R3('essentials')} / {_R3('high0')} <= 1.5::double then ceil(speed * {_R3('essentials')} / {_R3('high0')} * 20) / 20.0::double end as faster from st where state = 'inviable'),
ca as (select m.job, m.id, m.frames, excess, coalesce(sum(frames) over (partition by m.job order by frames desc, id rows between unbounded preceding and 1 preceding), 0) / 25.0::double as before
       from mv m join iv using (job) where included and not empty and free and priority = 1),
cb as (select job, string_agg(cast(id as varchar), ',' order by frames desc, id) as cuts from ca where before < excess group by job)
select iv.job, faster, minimum, cuts from iv left join cb using (job)""",
    "cut_warnings": _WARNED_SQL + " select job, id, code, message, blocking from cw",
    "global_warnings": _WARNED_SQL + " select job, code, message, blocking from gw",
    "plan_acceptance": _WARNED_SQL + """,
bw as (select job, id, code, message from cw where blocking union all select job, null, code, message from gw where blocking),
bl as (select job, string_agg(code || ': ' || message, '; ' order by code, message) as detail, array_to_string(list_sort(list(distinct cast(id as varchar)) filter (where id is not null)), ', ') as cuts from bw group by job),
aj as (select job, case job % 3 when 0 then 'sí, la ' || job when 1 then ' ' end as phrase, job % 5 = 0 as direct from jobs)
select aj.job, case when bl.job is not null then 'bloqueado' when not direct and phrase is null then 'sin_aceptar' else 'aceptado' end as state, detail, nullif(cuts, '') as cuts,
       case when bl.job is null and (direct or phrase is not null) then phrase end as phrase from aj left join bl using (job)""",
    "dependency_warnings": _C + " select job, id, depends_on, 'El corte ' || id || ' depende del ' || depends_on || ', que no está incluido.' as message from cuts c where included and depends_on is not null and not exists (select 1 from cuts d where d.job = c.job and d.id = c.depends_on and d.included)",
    "topic_warnings": _C + """, tp as (select job, p_type as topic, id from cuts join part on part = p_partkey where p_type in ('ECONOMY', 'PROMO')),
ic as (select job, id from cuts where included union select job, id - 1 from cuts where included and id % 2 = 0)
select tp.job, topic, cast(count(*) as bigint) as n, 'El tema «' || topic || '» se marcó imprescindible y no tiene ningún corte incluido.' as message
from tp left join ic on ic.job = tp.job and ic.id = tp.id group by tp.job, topic having not bool_or(ic.id is not null)""",
    "draft_violations": _DRAFT_SQL + """, o as (select *, lag(end_ms) over (partition by job order by start_ms, end_ms, id) as before from d),
x as (select job, id, unnest(refs) as ref from d)
select job, id, 'order' as rule, cast(count(*) as bigint) as n from o where start_ms < before group by all
union all select job, id, 'id', count(*) from d where id <= 0 group by all
union all select job, id, 'priority', count(*) from d where priority = 4 group by all
union all select job, id, 'phrase', count(*) from d where silent group by all
union all select job, id, 'pinned', count(*) from d where undecided group by all
union all select job, id, 'range', count(*) from d where end_ms > 230000 group by all
union all select job, id, 'repeated', count(*) from d where len(refs) = 2 group by all
union all select job, id, 'duplicate', count(*) from d group by job, id having count(*) > 1
union all select job, id, 'reference', count(*) from x where not exists (select 1 from d e where e.job = x.job and e.id = x.ref) group by job, id""",
    "topic_violations": _DRAFT_SQL + """, t as (select p_partkey as job, p_partkey % 10 = 0 as nameless, p_partkey % 11 = 0 as undecided, [p_size % 9, case when p_partkey % 7 = 0 then p_size % 9 else p_size % 9 + 1 end] as cuts from part),
u as (select *, exists (select 1 from d where d.job = t.job and d.id = cuts[1]) and exists (select 1 from d where d.job = t.job and d.id = cuts[2]) as fine from t)
select job, 1 as topic, 'name' as rule from u where nameless union all select job, 1, 'cuts' from u where cuts[1] = cuts[2]
union all select job, 1, 'reference' from u where not fine union all select job, 1, 'essential' from u where undecided""",
    "exclusion_violations": "select c_nationkey as job, c_custkey as position from customer where c_custkey % 9 = 0 or c_custkey % 8 = 0",
    "version_diff": _C + """,
o as (select job, id, end_ms - start_ms as before_ms from cuts where included),
n as (select job, id, end_ms - start_ms - case when remove_pauses and depends_on is not null then 1000 when pinned then 40 else 0 end as after_ms, pinned and priority = 2 as renamed
      from cuts where (included and (pinned or priority < 3)) or (not included and priority = 1)),
b as (select coalesce(o.job, n.job) as job, coalesce(o.id, n.id) as id, before_ms, after_ms, renamed from o full join n on o.job = n.job and o.id = n.id),
c as (select *, case when before_ms is null then 'added' when after_ms is null then 'removed' when abs(before_ms - after_ms) > 50 or renamed then 'changed' end as change from b)
select job, id, change, before_ms, after_ms from c where change is not null""",
    "import_draft": _C + " select job, id, start_ms, end_ms, 1 as priority, true as included, false as pinned from cuts",
    "revert_draft": _C + " select job, id, start_ms, end_ms, included from cuts",
    "fused_cuts": _C + """,
r as (select job, id, start_ms / 1000.0::double as lo, end_ms / 1000.0::double as hi, included, priority, pinned, 't' || (id // 2) as text, visual_only, remove_pauses, depends_on from cuts),
m as (select *, case when lag(hi) over w is null or lo - lag(hi) over w >= 0.04 - 1e-9 or included <> lag(included) over w then 1 else 0 end as new from r window w as (partition by job order by lo, hi, id)),
g as (select *, sum(new) over (partition by job order by lo, hi, id) as grp from m),
t as (select *, case when row_number() over (partition by job, grp order by lo, hi, id) = 1 then text
        when text = lag(text) over (partition by job, grp order by lo, hi, id) and row_number() over (partition by job, grp order by lo, hi, id) = 2 then '' else ' · ' || text end as said from g)
select job, min(id) as id, min(lo) as lo, max(hi) as hi, any_value(included) as included, min(priority) as priority, bool_or(pinned) as pinned,
       string_agg(said, '' order by lo, hi, id) as text, coalesce(string_agg(cast(id as varchar), ',' order by id) filter (where id <> first), '') as absorbed,
       bool_and(visual_only) as visual_only, bool_and(remove_pauses) as remove_pauses,
       coalesce(array_to_string(list_sort(list(distinct depends_on) filter (where depends_on is not null and not list_contains(ids, depends_on))), ','), '') as depends_on
from (select *, min(id) over (partition by job, grp) as first, list(id) over (partition by job, grp) as ids from t) group by job, grp""",
    "dependency_remap": _C + """,
m as (select job, id, start_ms, end_ms, depends_on, case when lag(end_ms) over w is null or start_ms / 1000.0::double - lag(end_ms) over w / 1000.0::double >= 0.04 - 1e-9 or included <> lag(included) over w then 1 else 0 end as new from cuts window w as (partition by job order by start_ms, end_ms, id)),
g as (select *, sum(new) over (partition by job order by start_ms, end_ms, id) as grp from m),
k as (select job, id, depends_on, min(id) over (partition by job, grp) as kept from g)
select distinct a.job, a.kept as id, b.kept as depends_on from k a join k b on b.job = a.job and b.id = a.depends_on where a.kept <> b.kept""",
    "subcut_split": _PIECES_SQL + " select job, cast(part as bigint) as part, cast(n_spans as bigint) as n_spans, cast(frames as bigint) as frames, cast(samples as bigint) as samples from pe",
    "part_checks": _PIECES_SQL + ", s as (select job, sum(n_spans) as n, sum(frames) as f, max(n_spans) as most from pe group by job) select tt.job, cast(tt.n as bigint) as n_spans, tt.frames, s.n = tt.n and s.f = tt.frames and most <= 40 as agree from tt join s on s.job = tt.job",
    "sweep_blocks": _J + """, b as (select job, total, unnest(range(0, cast(ceil(total / 60) as bigint))) as block from jobs),
c as (select job, block, block * 60.0::double as lo, least(total, block * 60.0::double + 60) as hi from b),
d as (select *, cast(greatest(1, ceil(floor((hi - lo) / 15.0::double * 1e9::double + 0.5::double) / 1e9::double)) as bigint) as frames from c)
select job, block, lo, hi, frames, cast(greatest(1, ceil(frames / 25.0::double)) as bigint) as sheets from d""",
    "sweep_budget": _J + """, b as (select job, total, unnest(range(0, cast(ceil(total / 60) as bigint))) as block from jobs),
d as (select job, block, cast(greatest(1, ceil(floor((least(total, block * 60.0::double + 60) - block * 60.0::double) / 15.0::double * 1e9::double + 0.5::double) / 1e9::double)) as bigint) as frames from b)
select job, block, frames, sum(frames) over (partition by job order by block) <= 10 as done from d""",
    "resume_blocks": _J + """, b as (select job, total, unnest(range(0, cast(ceil(total / 60) as bigint))) as block from jobs),
d as (select job, block, cast(greatest(1, ceil(floor((least(total, block * 60.0::double + 60) - block * 60.0::double) / 15.0::double * 1e9::double + 0.5::double) / 1e9::double)) as bigint) as frames from b),
l as (select d.* from d join jobs using (job) where not (block < 2 and total >= (block + 1) * 60))
select job, block, frames, sum(frames) over (partition by job order by block) <= 8 as now from l""",
    "proposal_text": _M + """,
k as (select *, floor(100 * output / total * 100.0::double + 0.5::double) / 100.0::double as percent from st),
c as (select *, cast(floor(total) as bigint) as t, cast(floor(output) as bigint) as o, cast(floor(target) as bigint) as g, cast(floor(percent * 10.0::double + 0.5::double) as bigint) as p from k)
select job, cuts || case when cuts = 1 then ' corte, ' else ' cortes, ' end || (t // 60) || ':' || lpad((t % 60)::varchar, 2, '0') || ' → ' || (o // 60) || ':' || lpad((o % 60)::varchar, 2, '0')
 || ' (' || (p // 10) || ',' || (p % 10) || ' %), ' || case when target is null then 'sin objetivo' else 'objetivo ' || (g // 60) || ':' || lpad((g % 60)::varchar, 2, '0') end || ': ' || state as text from c""",
    "parse_target": """with o as (select o_orderkey as job, o_orderkey % 97 + 1 as n, o_orderkey % 7 as k, o_orderkey % 50 * 60.0::double + 600 as total from orders),
t as (select *, case k when 0 then n || '%' when 1 then n || ' s' when 2 then (n % 40) || ',5 min' when 3 then '0:' || lpad((n % 60)::varchar, 2, '0') || ':30'
  when 4 then (n % 60) || ':15' when 5 then (n % 3) || '.5h' else n || ' mucho' end as text,
  case k when 0 then n * total / 100 when 1 then n::double when 2 then (n % 40 + 0.5::double) * 60 when 3 then (n % 60) * 60.0::double + 30 when 4 then (n % 60) * 60.0::double + 15 when 5 then (n % 3 + 0.5::double) * 3600 end as s from o),
v as (select *, case when s > 0 and s < total then s end as x from t)
select job, text, floor(x * 1000000.0::double + 0.5::double) / 1000000.0::double as seconds, case when x is not null then floor(greatest(x * 0.05::double, 10) * 1000000.0::double + 0.5::double) / 1000000.0::double end as tolerance from v""",
    "labels_fallback": _C + " select job, id, coalesce(case when p_size > 20 then nullif(trim(p_name), '') end, case when id % 2 = 0 then 'Title ' || id end, 'Corte ' || id) as label from cuts left join part on part = p_partkey where included",
    "version_reserve": "select o_custkey as job, cast(max(o_orderkey % 1000) + 1 as bigint) as version from orders group by o_custkey",
}
