"""Queries that give whole documents, cache keys and search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions.scalars import half_up
from chronoframe.operators import montage, placement, planner, reports, transcript
from chronoframe.plans.planner_queries import _COMMA, _R3, _WARNED_SQL, _WHOLE, _cuts, _jobs, _warned_cuts, _warned_jobs
from chronoframe.plans.text_queries import _HITS_SQL, _LONG_CLOCK, _PLACED_SQL, NEEDLE, _placed, _segments
from chronoframe.sources import bindings as B


def _report(spark, sf_dir):
    return planner.estimate(*_jobs(spark, sf_dir)).withColumns({"version": (F.col("job") % 4 + 1), "name": F.concat(F.lit("clase "), "job", F.lit(".mp4"))})


def _shown(spark, sf_dir):
    """Cuts that are not empty, numbered, with the place of those included in the output."""
    cuts, jobs = _jobs(spark, sf_dir)
    rows = planner.measure(cuts.join(jobs.select("job", "speed"), "job"), F.col("speed")).where("not empty")
    rows = rows.withColumns({"start": F.col("start_ms") / 1000.0, "end": F.col("end_ms") / 1000.0, "spans": F.array(F.struct((F.col("start_ms") / 1000.0).alias("lo"), (F.col("end_ms") / 1000.0).alias("hi")))})
    placed = placement.placements(rows.where("included"), planner.FPS, 1.25).select("job", "id", F.col("offset").alias("out"), "length")
    rows = rows.join(placed, ["job", "id"], "left")
    words = {"phrase": F.concat(F.lit("dice "), "id", F.lit(" | fin")), "reason": F.concat(F.lit("aporta "), "part")}
    return reports.numbered(rows.withColumns(words))


def proposal_document(spark, sf_dir):
    warned = _warned_cuts(spark, sf_dir).unionByName(_warned_jobs(spark, sf_dir), allowMissingColumns=True)
    cuts, jobs = _jobs(spark, sf_dir)
    tried = planner.alternatives(cuts, jobs).join(jobs.select("job", "total"), "job").withColumn("percent", half_up(100 * F.col("output") / F.col("total"), 2))
    excluded = jobs.where("job % 3 = 0").select("job", F.lit(1).alias("position"), F.lit("saludo").alias("title"), F.lit("no aporta").alias("reason"))
    hints = jobs.where("job % 5 = 0").select("job", F.lit(1).alias("n"), F.lit("baja la velocidad").alias("text"))
    totals = cuts.groupBy("job").agg((F.max("end_ms") + 5000).alias("total"))
    bars = placement.bar(_shown(spark, sf_dir).where("included").join(totals, "job").select("job", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "total"), 60, "#", "·")
    return reports.proposal_document(_report(spark, sf_dir), _shown(spark, sf_dir), warned, excluded, tried, hints, bars)


def cut_rows(spark, sf_dir):
    """A published cut's row: its number, times, exact counts and place in the output."""
    rows = _shown(spark, sf_dir).where("included")
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["lo"].cast("decimal(12,3)").cast("string"), F.lit("-"), x["hi"].cast("decimal(12,3)").cast("string"))), ";")
    return rows.select(
        "job", "id", "number", "phrase", "reason", "priority", "pinned", "visual_only", "remove_pauses", "depends_on", half_up(F.col("start"), 6).alias("start"), half_up(F.col("end"), 6).alias("end"),
        spans.alias("spans"), "frames", "samples", half_up(F.col("out"), 6).alias("out_from"), half_up(F.col("out") + F.col("length"), 6).alias("out_to"),
    )


def outline_document(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    heads = segments.groupBy("job").agg(F.max("hi").alias("total")).withColumns({"version": F.col("job") % 3 + 1, "name": F.concat(F.lit("charla "), "job")})
    first = F.substring(F.regexp_replace("text", "\n", " "), 1, 12)
    ideas = segments.where("role = 'assistant'").select("job", F.col("seg").alias("number"), F.col("lo").alias("start"), F.col("hi").alias("end"), (F.col("seg") % 3 + 1).alias("priority"), first.alias("phrase"))
    asked = segments.where("role = 'user' and job % 2 = 0").select("job", F.col("seg").alias("number"), F.col("lo").alias("start"), F.col("hi").alias("end"), first.alias("question"), F.lit("sí | no").alias("answer"))
    warned = heads.where("job % 4 = 0").select("job", F.lit("tema_sin_cubrir").alias("code"), F.lit("falta").alias("message"), F.lit(True).alias("blocking"))
    left = heads.where("job % 5 = 0").select("job", F.lit(1).alias("position"), F.lit("saludo").alias("title"), F.lit("no aporta").alias("reason"))
    return reports.outline_document(heads, ideas, asked, warned, left)


def data_sheet(spark, sf_dir):
    report = _report(spark, sf_dir)
    key = F.col("job")
    words = reports.transcriber(F.when(key % 3 == 0, "large").when(key % 3 == 1, ""), F.when(key % 4 == 0, "srt"), F.when(key % 5 > 0, "es"), key % 7 > 0)
    rows = report.select("job", "name", "total", "output", "cuts", (key % 2 == 0).alias("pauses"), "speed", words.alias("transcriber"), "version")
    return reports.data_sheet(rows, F.lit("2024-05-06").cast("date"))


def validation_table(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = orders.select(
        k.alias("job"), F.when(k % 5 > 0, k * 3).alias("frames"), F.when(k % 7 > 0, k * 3).alias("expected"), (k % 40 / 1000.0).alias("drift"), (k % 6).alias("places"), (k % 150 / 1000.0).alias("image"), (k % 90 * 1.0).alias("lag"),
        (k % 3).alias("marks"), (k % 5).alias("joins"),
    )
    return reports.validation_table(rows)


def render_keys(spark, sf_dir):
    """Cache keys over all that changes a rendered part."""
    parts = _placed(spark, sf_dir).select("job", "id", F.transform("spans", lambda s: F.array(s["lo"], s["hi"])).alias("spans"), "frames")
    source = F.struct((F.col("job") * 7).alias("size"), F.col("job").alias("mtime_ns"), montage.digest(F.col("job").cast("string")).alias("sha256"))
    key = montage.render_key(source, F.lit(1), F.col("spans"), F.lit(1.25), F.lit("25/1"), F.lit("x264 -crf 18"), F.lit(0), F.lit(1), F.concat(F.lit("r"), F.col("job") % 3))
    note = F.struct("id", "frames")
    return parts.select("job", "id", key.alias("key"), F.to_json(note).alias("note"))


def search_totals(spark, sf_dir):
    """How often the needle is found in each job, and how many of the hits a search of 20 shows."""
    found = transcript.hits(_segments(spark, sf_dir), F.lit(NEEDLE))
    return transcript.search_totals(found, 20)


QUERIES = {f.__name__: f for f in (proposal_document, cut_rows, outline_document, data_sheet, validation_table, render_keys, search_totals)}

_CELL = lambda x: f"replace({x}, '|', '\\|')"
_SPAN = lambda a, b: f"{_LONG_CLOCK(a)} || '–' || {_LONG_CLOCK(b)}"
_R2 = lambda x: f"(floor(({x}) * 100.0::double + 0.5::double) / 100.0::double)"
_SHOWN_SQL = _WARNED_SQL + """,
sa as (select m.*, m.start_ms / 1000.0::double as s, m.end_ms / 1000.0::double as e from ms m where not empty),
sb as (select *, row_number() over (partition by job order by included desc, s, id) as number,
              case when included then coalesce(sum(case when included then frames end) over (partition by job order by start_ms, id rows between unbounded preceding and 1 preceding), 0) / 25.0::double end as o,
              frames / 25.0::double as len from sa)"""
_ANSWERS = lambda rows: " || chr(10) || ".join(f"'{r}'" for r in rows)
_LINES = lambda *rows: " || chr(10) || ".join(rows)
_HEAD = lambda title, *rows: _LINES("''", f"'## {title}'", "''", *[f"'{r}'" for r in rows])

ORACLES = {
    "proposal_document": _SHOWN_SQL + f""",
lc as (select job, string_agg('| ' || number || ' | ' || {_SPAN('s', 'e')} || ' | ' || {_SPAN('o', '(o + len)')} || ' (' || {_WHOLE('len')} || ' s) | ' || priority || ' | dice ' || id || ' \\| fin |', chr(10) order by number) as t from sb where included group by job),
lr as (select job, string_agg('| ' || number || ' | ' || {_SPAN('s', 'e')} || ' | aporta ' || part || ' |', chr(10) order by number) as t from sb where not included group by job),
wa as (select job, id, code, message, blocking from cw union all select job, null, code, message, blocking from gw),
lw as (select job, string_agg('- ' || case when blocking then '**bloquea** · ' else '' end || '`' || code || '`' || coalesce(' · corte ' || id, '') || ' · ' || message, chr(10) order by coalesce(id, 1099511627776), code) as t from wa group by job),
al as (select c.job, j.total, j.target, x.speed, y.pauses, included, priority, case when remove_pauses and y.pauses then kept_ms else end_ms - start_ms end as length_ms, end_ms - start_ms as whole_ms from cuts c join jobs j using (job), (values (1.0::double), (1.25::double)) x(speed), (values (true), (false)) y(pauses)),
af as (select *, cast(floor(length_ms / 1000.0::double * 25 / speed + 0.5) as bigint) as frames, length_ms / 1000.0::double < speed / 25 - 1e-9 as empty from al),
ag as (select job, speed, pauses, any_value(total) as total, any_value(target) as target, coalesce(sum(frames) filter (where included and not empty), 0) / 25.0::double as output, coalesce(sum(frames) filter (where included and not empty and priority = 1), 0) / 25.0::double as essentials,
       greatest(1e-6, least(1, floor(sum(length_ms) / sum(whole_ms)::double * 1000000.0::double + 0.5::double) / 1000000.0::double)) as retention from af group by all),
ah as (select *, greatest(target * 0.05::double, 10) as m, total * retention / speed as top, {_R3('output')} as shown from ag),
ai as (select *, case when target is null then 'sin_objetivo' when target > top + m then 'inalcanzable' when essentials > target + m then 'inviable' when output > target + m then 'por_encima' when output < greatest(0, target - m) then 'por_debajo' else 'ok' end as state from ah),
lt as (select job, string_agg('| ×' || {_COMMA('speed', 2)} || ' | ' || case when pauses then 'sí' else 'no' end || ' | ' || {_LONG_CLOCK('shown')} || ' | ' || {_COMMA(_R2('100 * shown / total'))} || ' % | ' || state || ' |', chr(10) order by speed, not pauses) as t from ai group by job),
tt as (select job, max(end_ms) + 5000 as whole from cuts group by job),
bs as (select sb.job, least(cast(floor(start_ms / whole * 60) as int), 59) as f, least(59, greatest(cast(floor(start_ms / whole * 60) as int), cast(ceil(end_ms / whole * 60) as int) - 1)) as l from sb join tt on tt.job = sb.job where included),
bm as (select distinct job, unnest(range(f, l + 1)) as i from bs), bj as (select distinct job from bs),
ba as (select bj.job, string_agg(case when bm.i is null then '·' else '#' end, '' order by r.i) as bar from bj cross join range(0, 60) r(i) left join bm on bm.job = bj.job and bm.i = r.i group by bj.job),
hd as (select *, {_R2('100 * output / total')} as percent from st)
select hd.job, {_LINES("'# Propuesta v' || (hd.job % 4 + 1) || ' · resumen de «clase ' || hd.job || '.mp4»'", "''",
    f"'Original ' || {_LONG_CLOCK('hd.total')} || ' · ' || case when target is null then 'sin objetivo · ' else 'objetivo ' || {_LONG_CLOCK('target')} || ' (banda ' || {_SPAN(_R3('low0'), _R3('high0'))} || ') · ' end || 'estimación ' || {_LONG_CLOCK('output')} || ' (' || {_COMMA('percent')} || ' %) · estado **' || state || '**'", "''",
    f"hd.cuts || ' cortes · ' || {_LONG_CLOCK(_R3('source_ms / 1000.0::double'))} || ' → sin pausas ' || {_LONG_CLOCK(_R3('after_ms / 1000.0::double'))} || ' → ×' || {_COMMA('speed', 2)} || ' → ' || {_LONG_CLOCK('output')}",
    _HEAD('Avisos'), "coalesce(lw.t, '- ninguno')")} || chr(10) || {_HEAD('Cortes', '| # | Origen | Salida estimada | Prioridad | Qué se dice |', '| --- | --- | --- | --- | --- |')} || coalesce(chr(10) || lc.t, '')
 || chr(10) || {_HEAD('Reservas', '| # | Origen | Qué aportaría |', '| --- | --- | --- |')} || coalesce(chr(10) || lr.t, '') || chr(10) || {_HEAD('Exclusiones deliberadas', '| Qué | Por qué |', '| --- | --- |')} || case when hd.job % 3 = 0 then chr(10) || '| saludo | no aporta |' else '' end
 || chr(10) || {_HEAD('Alternativas', '| Velocidad | Pausas | Salida | % | Estado |', '| --- | --- | --- | --- | --- |')} || coalesce(chr(10) || lt.t, '') || chr(10) || {_HEAD('Sugerencias')}
 || chr(10) || case when hd.job % 5 = 0 then '- baja la velocidad' when state = 'ok' then '- ninguna: el plan está dentro de la banda' else '- ninguna aplicable: no hay ajuste disponible para el estado «' || state || '».' end
 || chr(10) || {_HEAD('Recorrido')} || chr(10) || '`' || coalesce(bar, repeat('·', 60)) || '`' || chr(10) || chr(10) || '0:00 ← cada carácter son ' || {_COMMA('hd.total / 60')} || ' s → ' || {_LONG_CLOCK('hd.total')}
 || chr(10) || {_HEAD('Cómo responder')} || chr(10) || {_ANSWERS(reports.ANSWERS)} || chr(10) as text
from hd left join lc on lc.job = hd.job left join lr on lr.job = hd.job left join lw on lw.job = hd.job left join lt on lt.job = hd.job left join ba on ba.job = hd.job""",
    "cut_rows": _SHOWN_SQL + f""" select job, id, cast(number as int) as number, 'dice ' || id || ' | fin' as phrase, 'aporta ' || part as reason, priority, pinned, visual_only, remove_pauses, depends_on, s as start, e as "end",
printf('%.3f', s) || '-' || printf('%.3f', e) as spans, frames, cast(floor(frames / 25.0::double * 48000 + 0.5) as bigint) as samples, floor(o * 1000000.0::double + 0.5::double) / 1000000.0::double as out_from, floor((o + len) * 1000000.0::double + 0.5::double) / 1000000.0::double as out_to from sb where included""",
    "outline_document": "with " + B.TRANSCRIPT_SQL + f""",
hd as (select job, max(hi) as total from segments group by job),
sx as (select *, substr(replace(text, chr(10), ' '), 1, 12) as said from segments),
li as (select job, count(*) as n, string_agg('| ' || seg || ' | ' || {_SPAN('lo', 'hi')} || ' | ' || (seg % 3 + 1) || ' | ' || {_CELL('said')} || ' |', chr(10) order by seg) as t from sx where role = 'assistant' group by job),
lq as (select job, count(*) as n, string_agg('| ' || seg || ' | ' || {_SPAN('lo', 'hi')} || ' | ' || {_CELL('said')} || ' | sí \\| no |', chr(10) order by seg) as t from sx where role = 'user' and job % 2 = 0 group by job)
select hd.job, {_LINES("'# Esquema v' || (hd.job % 3 + 1) || ' · documento de «charla ' || hd.job || '»'", "''", f"'Original ' || {_LONG_CLOCK('total')} || ' · ' || coalesce(li.n, 0) || ' ideas · ' || coalesce(lq.n, 0) || ' preguntas · sin montaje (entrada de solo audio)'", "''",
    "'En modo audio se ignoran objetivo, velocidad y pausas: la entrega es el documento.'", _HEAD('Avisos'), "case when hd.job % 4 = 0 then '- **bloquea** · `tema_sin_cubrir` · falta' else '- ninguno' end")}
 || chr(10) || {_HEAD('Ideas', '| # | Origen | Prioridad | Qué se dice |', '| --- | --- | --- | --- |')} || coalesce(chr(10) || li.t, '') || chr(10) || {_HEAD('Preguntas', '| # | Origen | Pregunta | Respuesta |', '| --- | --- | --- | --- |')} || chr(10) || coalesce(lq.t, '| — | — | No se registraron preguntas en la sesión. | — |')
 || chr(10) || {_HEAD('Exclusiones deliberadas', '| Qué | Por qué |', '| --- | --- |')} || case when hd.job % 5 = 0 then chr(10) || '| saludo | no aporta |' else '' end || chr(10) || {_HEAD('Cómo responder')} || chr(10) || {_ANSWERS(reports.OUTLINE_ANSWERS)} || chr(10) as text
from hd left join li on li.job = hd.job left join lq on lq.job = hd.job""",
    "data_sheet": _WARNED_SQL + f""" select job, {_LINES("'| Campo | Valor |'", "'| --- | --- |'", "'| Archivo | clase ' || job || '.mp4 |'", f"'| Duración original | ' || {_LONG_CLOCK('total')} || ' |'",
    f"'| Duración del resumen | ' || {_LONG_CLOCK('output')} || ' (' || {_COMMA('output * 100 / total')} || ' % del original) |'", "'| Técnicas | ' || cuts || case when cuts = 1 then ' corte' else ' cortes' end || ' · ' || case when job % 2 = 0 then 'pausas eliminadas' else 'pausas conservadas' end || ' · velocidad ×1,25 |'",
    "'| Transcripción | ' || case when job % 7 = 0 then 'sin transcripción' else case when job % 3 = 0 then 'large' when job % 4 = 0 then 'srt' else 'subtítulos del medio' end || ' (' || case when job % 5 > 0 then 'es' else 'idioma sin declarar' end || ')' end || ' |'", "'| Versión | v' || (job % 4 + 1) || ' · 2024-05-06 |'")} as text from st""",
    "validation_table": f"""with o as (select o_orderkey as job, o_orderkey as k from orders)
select job, {_LINES("'| Comprobación | Resultado |'", "'| --- | --- |'", "'| Fotogramas | ' || case when k % 5 > 0 then cast(k * 3 as varchar) else '?' end || ' de ' || case when k % 7 > 0 then cast(k * 3 as varchar) else '?' end || ' esperados |'",
    f"'| Desfase vídeo/audio | ' || {_COMMA('k % 40 / 1000.0::double', 3)} || ' s |'", f"'| Colocación de los cortes | ' || k % 6 || case when k % 6 = 1 then ' corte comprobado' else ' cortes comprobados' end || ' · imagen máx. ' || {_COMMA('k % 150 / 1000.0::double', 3)} || ' · envolvente máx. ' || k % 90 || ' ms |'",
    "'| Ventanas marcadas | ' || k % 3 || case when k % 3 = 1 then ' ventana' else ' ventanas' end || ' |'", "'| Hojas de uniones | ' || k % 5 || case when k % 5 = 1 then ' unión' else ' uniones' end || ' |'")} as text from o""",
    "render_keys": _PLACED_SQL + """,
n as (select job, id, cast(round(len * 25) as bigint) as frames, '[' || cast(cast(a1 as decimal(18,3)) as varchar) || ',' || cast(cast(b1 as decimal(18,3)) as varchar) || ']' || case when two then ',[' || cast(cast(a2 as decimal(18,3)) as varchar) || ',' || cast(cast(b2 as decimal(18,3)) as varchar) || ']' else '' end as spans from pl)
select job, id, substr(sha256('{"cadencia":"25/1","codificador":"x264 -crf 18","ffmpeg":"r' || job % 3 || '","huella":{"mtime_ns":' || job || ',"sha256":"' || sha256(cast(job as varchar)) || '","size":' || job * 7 || '},"pista":1,"subcorte":[0,1],"tramos":[' || spans || '],"velocidad":1.250000}'), 1, 32) as key,
       '{"id":' || id || ',"frames":' || frames || '}' as note from n""",
    "search_totals": _HITS_SQL + """, o as (select job, row_number() over (order by job, seg, place) as n from hits)
select job, cast(count(*) as bigint) as total, cast(count(*) filter (where n <= 20) as bigint) as shown from o group by job""",
}
