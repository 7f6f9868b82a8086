"""Queries on transcripts, documents, placements, vectors and the montage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import ACCENTED, PLAIN, ellipsis, frames_for, half_up, samples_for, stamp
from chronoframe.operators import documents, montage, placement, reports, transcript
from chronoframe.sources import bindings as B
from chronoframe.streaming import levels as streams

NEEDLE = "de la"


def _segments(spark, sf_dir):
    return B.transcript(B.table(spark, sf_dir, "conversations"))


def _coverage(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    length = F.col("hi") - F.col("lo")
    one = F.struct(F.col("lo").alias("lo"), (F.col("lo") + length * 0.45).alias("hi"))
    two = F.struct((F.col("lo") + length * 0.5).alias("lo"), F.col("hi").alias("hi"))
    cuts = segments.where("role = 'assistant'").select("job", F.col("seg").alias("id"), "lo", "hi", F.array(one, two).alias("spans"))
    return transcript.coverage(cuts, B.words(segments))


def word_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).withColumn("lost", F.array_join("lost", " "))


def coverage_summary(spark, sf_dir):
    return transcript.coverage_summary(_coverage(spark, sf_dir))


def words_flatten(spark, sf_dir):
    return B.words(_segments(spark, sf_dir)).select("job", "seg", "w", "text", half_up(F.col("lo"), 6).alias("lo"), half_up(F.col("hi"), 6).alias("hi"))


def subtitle_parse(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    cue = F.concat_ws("\n", (F.col("seg") + 1).cast("string"), F.concat(F.translate(stamp(F.col("lo")), ".", ","), F.lit(" --> "), F.translate(stamp(F.col("hi")), ".", ",")), F.concat(F.lit("<i>"), "text", F.lit("</i>")), F.lit(""))
    files = segments.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", cue.alias("cue")))), lambda x: x["cue"]), "\n").alias("text"))
    return transcript.subtitles(files)


def _edges(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    length = F.col("hi") - F.col("lo")
    starts = segments.select("job", (F.col("lo") + length * 0.37).alias("edge"), F.lit(-1).alias("side"))
    ends = segments.select("job", (F.col("lo") + length * 0.61).alias("edge"), F.lit(1).alias("side"))
    return transcript.word_edges(starts.unionByName(ends).distinct(), B.words(segments))


def word_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("job", half_up(F.col("edge"), 6).alias("edge"), "side", half_up(F.col("moved"), 6).alias("moved"))


def adjusted_edges(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    length = F.col("hi") - F.col("lo")
    ends = F.array(F.struct(F.lit(-1).alias("side"), (F.col("lo") + length * 0.37).alias("edge")), F.struct(F.lit(1).alias("side"), (F.col("lo") + length * 0.61).alias("edge")))
    edges = segments.select("job", F.col("seg").alias("id"), F.explode(ends).alias("e")).select("job", "id", "e.side", "e.edge")
    moved = transcript.word_edges(edges, B.words(segments)).withColumn("to", F.coalesce("moved", "edge"))
    at = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    rows = moved.groupBy("job", "id").agg(at(-1, "edge").alias("start"), at(-1, "to").alias("lo"), at(1, "to").alias("hi"))
    return transcript.clamp(rows).select("job", "id", half_up(F.col("lo"), 6).alias("lo"), half_up(F.col("hi"), 6).alias("hi"))


def word_hit_offset(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    found = transcript.hits(segments, F.lit(NEEDLE)).select("job", "seg", "nth", "at")
    owned = transcript.owners(found, transcript.haystack(B.words(segments)))
    return owned.select("job", "seg", F.col("nth").cast("long").alias("nth"), F.col("at").cast("long").alias("place"), "w", half_up(F.col("lo"), 3).alias("start"))


def transcript_search(spark, sf_dir):
    """The first 20 hits in scan order, with their context; the limit is the feature."""
    segments = transcript.context(_segments(spark, sf_dir))
    found = transcript.hits(segments, F.lit(NEEDLE))
    first = found.orderBy("job", "seg", "at").limit(20)
    return first.select("job", "seg", F.col("nth").cast("long").alias("nth"), F.col("at").cast("long").alias("place"), half_up(F.col("hi"), 3).alias("end"), "context")


def search_context(spark, sf_dir):
    return transcript.context(_segments(spark, sf_dir), 2).select("job", "seg", "context")


def question_validation(spark, sf_dir):
    rows = _segments(spark, sf_dir).where("role = 'user'")
    order = Window.partitionBy("job").orderBy("seg")
    late = F.coalesce(F.col("lo") > F.lag("lo").over(order), F.lit(True))
    return rows.select("job", F.col("seg").alias("id"), F.trim("text").alias("question"), (late & (F.trim("text") != "") & (F.col("hi") > F.col("lo"))).alias("ok"))


def document_lint(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").select("page_id", F.replace(F.col("html"), F.lit("</p>"), F.lit("</p>\n")).alias("text"))
    rules = {"absolute_path": r"""(^|[\s"'(=])/[A-Za-z][A-Za-z0-9_./-]*""", "pending": r"(?i)\b(todo|tbd|pendiente)\b", "email": r"[A-Za-z0-9.]+@[A-Za-z0-9.]+"}
    return documents.lint(documents.lines(pages, ["page_id"]), ["page_id"], rules)


def tag_strip(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", documents.strip_tags(F.col("html")).alias("text"))


def fingerprint(spark, sf_dir):
    content = F.encode("text", "UTF-8")
    return B.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), montage.ends_digest(content).alias("digest"))


def tree_digest(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("name"), F.col("text").alias("content"))
    return documents.tree_digest(docs, ["source"])


def history_log(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    payload = F.from_json("props", "k int")
    said = F.concat_ws(" ", "event_type", F.repeat(F.lit("payload "), F.coalesce(payload["k"], F.lit(0))))
    return events.select("event_id", F.col("event_type").alias("event"), payload["k"].alias("k"), ellipsis(said, 300).alias("text"))


def _parts(spark, sf_dir):
    cuts = B.cuts(B.table(spark, sf_dir, "lineitem")).where("included")
    rows = cuts.withColumn("frames", frames_for(F.col("kept_ms") / 1000.0, 25.0, 1.25))
    rows = rows.withColumn("samples", samples_for(F.col("frames"), 25.0, 48000.0))
    key = montage.digest(montage.canonical(frames=F.col("frames"), id=F.col("id"), job=F.col("job"), samples=F.col("samples")), 32)
    return rows.select("job", "id", "frames", "samples", key.alias("key"), "priority", "pinned", "remove_pauses")


def _notes(spark, sf_dir):
    """Notes of the parts that are not pinned; some are out of date, some lack the seconds."""
    rows = _parts(spark, sf_dir).where("not pinned").withColumn("frames", F.col("frames") + (F.col("priority") == 3).cast("int"))
    seconds = F.when(F.col("remove_pauses"), F.col("frames") * 8 + F.col("id"))
    return rows.withColumns({"seconds_ms": seconds, "seconds": seconds / 1000.0})


def cut_key(spark, sf_dir):
    return _parts(spark, sf_dir).select("job", "id", "key")


def plan_digest(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    rows = _parts(spark, sf_dir).groupBy("job").agg(ids.alias("cuts"))
    return rows.select("job", montage.digest(montage.canonical(cuts=F.col("cuts"), job=F.col("job"), version=F.lit(1))).alias("sha256"))


def cache_hits(spark, sf_dir):
    return montage.cached(_parts(spark, sf_dir), _notes(spark, sf_dir)).select("job", "id", "hit")


def montage_eta(spark, sf_dir):
    return montage.eta(_parts(spark, sf_dir), _notes(spark, sf_dir), ["job"])


def _placed(spark, sf_dir):
    cuts = B.cuts(B.table(spark, sf_dir, "lineitem")).where("included")
    half = F.floor(F.col("kept_ms") / 2)
    s = lambda ms: ms / 1000.0
    whole = F.array(F.struct(s(F.col("start_ms")).alias("lo"), s(F.col("end_ms")).alias("hi")))
    two = F.array(
        F.struct(s(F.col("start_ms")).alias("lo"), s(F.col("start_ms") + half).alias("hi")),
        F.struct(s(F.col("end_ms") - (F.col("kept_ms") - half)).alias("lo"), s(F.col("end_ms")).alias("hi")),
    )
    spans = F.when(F.col("kept_ms") < F.col("end_ms") - F.col("start_ms"), two).otherwise(whole)
    rows = cuts.select("job", "id", s(F.col("start_ms")).alias("start"), s(F.col("end_ms")).alias("end"), frames_for(s(F.col("kept_ms")), 25.0, 1.25).alias("frames"), spans.alias("spans"))
    return placement.placements(rows, 25.0, 1.25)


def placements(spark, sf_dir):
    rows = _placed(spark, sf_dir).select("job", "id", F.posexplode("stretches").alias("k", "s"))
    return rows.select("job", "id", F.col("k").cast("long").alias("k"), F.col("s.a").alias("a"), F.col("s.b").alias("b"), half_up(F.col("s.out"), 6).alias("out"))


def index_table(spark, sf_dir):
    return reports.index_table(_placed(spark, sf_dir))


def _instants(spark, sf_dir):
    jobs = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"))
    return jobs.select("job", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("job", (F.col("k") * 7.25).alias("t"))


def output_time_map(spark, sf_dir):
    return placement.output_at(_instants(spark, sf_dir), _placed(spark, sf_dir), 1.25).select("job", "t", half_up(F.col("out"), 6).alias("out"))


def time_mark_labels(spark, sf_dir):
    found = placement.output_at(_instants(spark, sf_dir), _placed(spark, sf_dir), 1.25)
    return found.select("job", "t", placement.moment(F.col("t"), half_up(F.col("out"), 6)).alias("label"))


def mark_expand(spark, sf_dir):
    jobs = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"))
    rows = jobs.select("job", F.lit(1).cast("long").alias("n"), F.lit("At [[t=14.5]], then [[r=0-7.25]] and [[r=7.25-14.5]]; [[t=14.5]].").alias("line"))
    return documents.expand_marks(rows, _placed(spark, sf_dir), 1.25)


def timeline_bar(spark, sf_dir):
    cuts = B.cuts(B.table(spark, sf_dir, "lineitem"))
    totals = cuts.groupBy("job").agg((F.max("end_ms") + 5000).alias("total"))
    rows = cuts.where("included").join(totals, "job").select("job", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "total")
    return placement.bar(rows, 60, "#", "·")


def image_distance(spark, sf_dir):
    vectors = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nexts = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(nexts, "vec_id").select("vec_id", half_up(montage.image_distance(F.col("embedding"), F.col("other"), 1.0), 5).alias("distance"))


def _marks(spark, sf_dir):
    vectors = B.table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    distance = montage.image_distance(F.col("embedding"), F.col("first"), 10.0)
    return vectors.join(first, "label").select("vec_id", "label", half_up(distance, 5).alias("distance")).withColumn("mark", montage.image_mark(F.col("distance")))


def image_placement_checks(spark, sf_dir):
    return _marks(spark, sf_dir)


def validation_marks(spark, sf_dir):
    lag = F.col("vec_id") % 7 - 3
    sound = montage.envelope_mark(F.col("vec_id") % 10 * 1.0, lag + F.when(F.col("vec_id") % 11 == 0, 5).otherwise(0), 1.0 - F.col("vec_id") % 5 / 20.0, F.col("vec_id") % 13 * 1.0)
    rows = _marks(spark, sf_dir).select("label", "mark", sound.alias("sound"))
    worst = lambda c: F.when(F.bool_or(F.col(c) == "fail"), "fail").when(F.bool_or(F.col(c) == "mark"), "mark").otherwise("ok")
    return rows.groupBy("label").agg(worst("mark").alias("image"), worst("sound").alias("sound"), F.count_if((F.col("mark") != "ok") | (F.col("sound") != "ok")).alias("marks"))


def montage_report(spark, sf_dir):
    return reports.montage_report(_marks(spark, sf_dir).withColumnRenamed("label", "cut"))


def level_stream(spark, sf_dir):
    stream = streams.hourly(streams.event_stream(spark, f"{sf_dir}/events.parquet"))
    found = streams.run_available(stream, "level-stream")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("hours"), F.sum("n").alias("n"), F.sum("energy").alias("energy"))


_T = "with " + B.TRANSCRIPT_SQL
_NORMAL = f"trim(regexp_replace(replace(lower(translate(text, '{ACCENTED}', '{PLAIN}')), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_R6 = lambda x: f"(floor(({x}) * 1000000.0::double + 0.5::double) / 1000000.0::double)"
_EDGES_SQL = _T + f""",
wl as (select *, lag(hi) over (partition by job order by lo, hi) as before, lead(lo) over (partition by job order by lo, hi) as after from words),
ed as (select distinct job, lo + (hi - lo) * 0.37::double as edge, -1 as side from segments union select job, lo + (hi - lo) * 0.61::double, 1 from segments),
ew as (select e.*, w.lo as wlo, w.hi as whi, case when before is null then w.lo - 0.15::double else greatest((before + w.lo) / 2, w.lo - 0.15::double) end as ahead,
       case when after is null then w.hi + 0.15::double else least((w.hi + after) / 2, w.hi + 0.15::double) end as behind
       from ed e left join wl w on w.job = e.job and w.lo < e.edge and e.edge < w.hi),
eo as (select *, 2 * (case when side < 0 then whi - edge else edge - wlo end) >= whi - wlo as keep, case when side < 0 then greatest(0.0::double, ahead) else behind end as wide, case when side < 0 then behind else ahead end as narrow from ew),
ef as (select *, case when keep then wide else narrow end as one, case when keep then narrow else wide end as two from eo),
mo as (select job, edge, side, case when wlo is null then edge when abs(one - edge) <= 1 then {_R6('one')} when abs(two - edge) <= 1 then {_R6('two')} end as moved from ef)"""
_HITS_SQL = _T + f""",
hp as (select job, seg, c, hi, text, string_split({_NORMAL}, '{NEEDLE}') as p from segments),
hh as (select *, unnest(range(1, len(p))) as k from hp),
hits as (select job, seg, hi, k - 1 as nth, cast(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * {len(NEEDLE)} as bigint) as place from hh)"""
_CONTEXT = "(select job, seg, string_agg(trim(text), ' ') over (partition by job order by seg rows between {0} preceding and {0} following) as context from segments)"
_PLACED_SQL = "with " + B.CUTS_SQL + """,
pf as (select *, cast(floor(kept_ms / 1000.0::double * 25 / 1.25::double + 0.5) as bigint) as frames, kept_ms // 2 as half, kept_ms < end_ms - start_ms as two from cuts where included),
po as materialized (select *, coalesce(sum(frames) over (partition by job order by start_ms, id rows between unbounded preceding and 1 preceding), 0) / 25.0::double as off from pf),
pl as materialized (select job, id, start_ms / 1000.0::double as s, end_ms / 1000.0::double as e, off, frames / 25.0::double as len, two,
       start_ms / 1000.0::double as a1, case when two then (start_ms + half) / 1000.0::double else end_ms / 1000.0::double end as b1, (end_ms - (kept_ms - half)) / 1000.0::double as a2, end_ms / 1000.0::double as b2 from po)"""
_MAP_SQL = _PLACED_SQL + """,
ti as materialized (select o_orderkey as job, k * 7.25::double as t from orders, range(0, 10) r(k)),
th as (select ti.job, t, s, id, case when t <= b1 then off + (t - a1) / 1.25::double when two and t < a2 then off + (b1 - a1) / 1.25::double when two and t <= b2 then off + (b1 - a1) / 1.25::double + (t - a2) / 1.25::double else off + len end as o
       from ti join pl on pl.job = ti.job and s <= t and t <= e),
tb as materialized (select job, t, arg_min(o, id) as o from th group by job, t),
tm as materialized (select ti.job, ti.t, """ + _R6("o") + """ as o from ti left join tb on tb.job = ti.job and tb.t = ti.t)"""
_CLOCK = lambda x: f"(cast(floor({x}) as bigint) // 60 || ':' || lpad(cast(cast(floor({x}) as bigint) % 60 as varchar), 2, '0'))"
_LONG_CLOCK = lambda x: f"(case when {x} >= 3600 then cast(floor({x}) as bigint) // 3600 || ':' || lpad(cast(cast(floor({x}) as bigint) % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor({x}) as bigint) % 60 as varchar), 2, '0') else {_CLOCK(x)} end)"
_PARTS_SQL = "with " + B.CUTS_SQL + """,
pq as (select job, id, cast(floor(kept_ms / 1000.0::double * 25 / 1.25::double + 0.5) as bigint) as frames, priority, pinned, remove_pauses from cuts where included),
parts as (select *, cast(floor(frames / 25.0::double * 48000 + 0.5) as bigint) as samples from pq),
keyed as (select *, substr(sha256('{"frames":' || frames || ',"id":' || id || ',"job":' || job || ',"samples":' || samples || '}'), 1, 32) as key from parts),
notes as (select job, id, frames + case when priority = 3 then 1 else 0 end as frames, samples, key, case when remove_pauses then (frames + case when priority = 3 then 1 else 0 end) * 8 + id end as ms from keyed where not pinned),
hit as (select k.*, exists (select 1 from notes n where n.key = k.key and n.frames = k.frames and n.samples = k.samples) as hit from keyed k)"""
_DISTANCE = "list_sum(list_transform(list_zip({0}, {1}), lambda z: abs(cast(z[1] as double) - cast(z[2] as double)))) / len({0}) / {2}::double"
_MARKS_SQL = "with f as (select label, arg_min(embedding, vec_id) as first from embeddings group by label), d as (select vec_id, e.label, floor((" + _DISTANCE.format("embedding", "first", "10.0") + ") * 100000.0::double + 0.5::double) / 100000.0::double as distance from embeddings e join f on f.label = e.label), m as (select *, case when distance > 0.15::double then 'fail' when distance > 0.08::double then 'mark' else 'ok' end as mark from d)"

QUERIES = {f.__name__: f for f in (
    word_coverage, coverage_summary, words_flatten, subtitle_parse, word_edges, adjusted_edges, word_hit_offset, transcript_search, search_context, question_validation,
    document_lint, tag_strip, fingerprint, tree_digest, history_log, cut_key, plan_digest, cache_hits, montage_eta, placements, index_table, montage_report, output_time_map, time_mark_labels,
    mark_expand, timeline_bar, image_distance, image_placement_checks, validation_marks, level_stream,
)}

_COVER_SQL = _T + """,
cc as (select job, seg as id, lo, hi, lo + (hi - lo) * 0.45::double as m1, lo + (hi - lo) * 0.5::double as m2 from segments where role = 'assistant'),
cp as (select c.job, c.id, w.text, w.lo, w.hi, w.seg, w.w, (c.lo - 0.02::double <= w.lo and w.hi <= m1 + 0.02::double) or (m2 - 0.02::double <= w.lo and w.hi <= c.hi + 0.02::double) as ok
       from cc c join words w on w.job = c.job and w.hi > c.lo and w.lo < c.hi),
cv as (select cc.job, cc.id, cast(count(cp.w) as bigint) as words, cast(count(*) filter (where ok) as bigint) as covered, list(text order by cp.lo, cp.hi, seg, w) filter (where not ok) as lost from cc left join cp on cp.job = cc.job and cp.id = cc.id group by cc.job, cc.id),
cs as (select *, case when words > 0 then floor(covered / words * 1000.0::double + 0.5::double) / 1000.0::double else 1.0::double end as share from cv)"""

ORACLES = {
    "word_coverage": _COVER_SQL + " select job, id, words, covered, share, coalesce(array_to_string(lost[1:10], ' '), '') as lost from cs",
    "coverage_summary": _COVER_SQL + """, su as (select job, cast(sum(words) as bigint) as words, cast(sum(covered) as bigint) as covered, min(share) as least from cs group by job),
me as (select *, case when words > 0 then floor(covered / words * 1000.0::double + 0.5::double) / 1000.0::double else 1.0::double end as mean from su)
select job, words, covered, mean, least, mean < 0.9::double or least < 0.85::double as low from me""",
    "words_flatten": _T + f" select job, seg, w, text, {_R6('lo')} as lo, {_R6('hi')} as hi from words",
    "subtitle_parse": _T + """ select job, floor(lo * 1000 + 0.5::double) / 1000.0::double as lo, floor(hi * 1000 + 0.5::double) / 1000.0::double as hi,
array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') as text from segments where trim(text) <> '' and hi > lo""",
    "word_edges": _EDGES_SQL + f" select job, {_R6('edge')} as edge, side, {_R6('moved')} as moved from mo",
    "adjusted_edges": _EDGES_SQL + f""",
cu as (select s.job, s.seg as id, a.edge as start, coalesce(a.moved, a.edge) as lo, coalesce(b.moved, b.edge) as hi from segments s
       join mo a on a.job = s.job and a.side = -1 and a.edge = s.lo + (s.hi - s.lo) * 0.37::double join mo b on b.job = s.job and b.side = 1 and b.edge = s.lo + (s.hi - s.lo) * 0.61::double),
ch as (select *, least(hi, lead(start) over (partition by job order by start, id)) as h from cu),
cl as (select *, greatest(lo, coalesce(lag(h) over (partition by job order by start, id), 0)) as l from ch)
select job, id, {_R6('l')} as lo, {_R6('h')} as hi from cl""",
    "word_hit_offset": _HITS_SQL + f""",
wn as (select job, seg, w, lo, {_NORMAL} as norm from words), wo as (select * from wn where norm <> ''),
wf as (select *, coalesce(sum(length(norm) + 1) over (partition by job, seg order by w rows between unbounded preceding and 1 preceding), 0) as off from wo)
select h.job, h.seg, nth, place, w, floor(lo * 1000.0::double + 0.5::double) / 1000.0::double as start from hits h join wf on wf.job = h.job and wf.seg = h.seg and place >= off and place < off + length(norm) + 1""",
    "transcript_search": _HITS_SQL + " select h.job, h.seg, nth, place, floor(hi * 1000.0::double + 0.5::double) / 1000.0::double as \"end\", context from hits h join " + _CONTEXT.format(1) + " c on c.job = h.job and c.seg = h.seg order by h.job, h.seg, place limit 20",
    "search_context": _T + " select * from " + _CONTEXT.format(2),
    "question_validation": _T + " select job, seg as id, trim(text) as question, coalesce(lo > lag(lo) over (partition by job order by seg), true) and trim(text) <> '' and hi > lo as ok from segments where role = 'user'",
    "document_lint": r"""with l as (select page_id, string_split(replace(html, '</p>', '</p>' || chr(10)), chr(10)) as p from pages),
n as (select page_id, unnest(range(1, len(p) + 1)) as n, unnest(p) as line from l)
select page_id, 'absolute_path' as code, cast(count(*) as bigint) as hits, min(n) as first from n where regexp_matches(line, '(^|[\s"''(=])/[A-Za-z][A-Za-z0-9_./-]*') group by page_id
union all select page_id, 'pending', count(*), min(n) from n where regexp_matches(line, '(?i)\b(todo|tbd|pendiente)\b') group by page_id
union all select page_id, 'email', count(*), min(n) from n where regexp_matches(line, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') group by page_id""",
    "tag_strip": "select page_id, regexp_replace(html, '<[^>]*>', '', 'g') as text from pages",
    "fingerprint": "select doc_id, octet_length(encode(text))::bigint as size, sha256(case when octet_length(encode(text)) <= 8388608 then encode(text) else encode(text)[1:4194304] || encode(text)[-4194304:] end) as digest from documents",
    "tree_digest": """with e as (select source, doc_id || ':' || sha256(text) as entry from documents),
p as (select source, substr(md5(entry), 1, 4) as part, sha256(string_agg(entry, chr(10) order by entry)) as d, count(*) as n from e group by all),
u as (select source, substr(part, 1, 2) as up, sha256(string_agg(d, chr(10) order by part)) as d, sum(n) as n from p group by all)
select source, sha256(string_agg(d, chr(10) order by up)) as digest, cast(sum(n) as bigint) as files from u group by source""",
    "history_log": """with t as (select event_id, event_type, cast(json_extract(props, '$.k') as int) as k from events), u as (select *, event_type || ' ' || repeat('payload ', coalesce(k, 0)) as said from t)
select event_id, event_type as event, k, case when length(said) > 300 then substr(said, 1, 299) || '…' else said end as text from u""",
    "cut_key": _PARTS_SQL + " select job, id, key from keyed",
    "plan_digest": _PARTS_SQL + """ select job, sha256('{"cuts":"' || string_agg(cast(id as varchar), ',' order by id) || '","job":' || job || ',"version":1}') as sha256 from parts group by job""",
    "cache_hits": _PARTS_SQL + " select job, id, hit from hit",
    "montage_eta": _PARTS_SQL + """,
co as (select job, sum(ms) / sum(frames)::double / 1000.0::double as cost from notes where ms is not null and frames > 0 group by job),
su as (select job, count(*) filter (where hit) as reused, count(*) filter (where not hit) as new, coalesce(sum(frames) filter (where not hit), 0) as f, sum(frames) as a from hit group by job)
select su.job, cast(reused as bigint) as reused, cast(new as bigint) as new, floor((f * coalesce(cost, 0.5::double / 25) + a / 25.0::double * 0.25::double) * 1000.0::double + 0.5::double) / 1000.0::double as eta from su left join co on co.job = su.job""",
    "placements": _PLACED_SQL + f" select job, id, 0::bigint as k, a1 as a, b1 as b, {_R6('off')} as out from pl union all select job, id, 1, a2, b2, {_R6('off + (b1 - a1) / 1.25::double')} from pl where two",
    "index_table": _PLACED_SQL + f""", r as (select job, s, id, '| ' || id || ' | ' || {_LONG_CLOCK('s')} || '–' || {_LONG_CLOCK('e')} || ' | ' || {_LONG_CLOCK('off')} || '–' || {_LONG_CLOCK('(off + len)')} || ' |' as line from pl)
select job, '| Corte | Original | Resumen |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) order by s, id) as text from r group by job""",
    "montage_report": _MARKS_SQL + " select label as cut, max(distance) as distance, cast(count(*) as bigint) as ends, cast(count(*) filter (where mark <> 'ok') as bigint) as bad from m group by label",
    "output_time_map": _MAP_SQL + " select job, t, o as out from tm",
    "time_mark_labels": _MAP_SQL + f" select job, t, case when o is null then {_LONG_CLOCK('t')} || ' (no incluido en el resumen)' else {_LONG_CLOCK('t')} || ' (resumen ' || {_LONG_CLOCK('o')} || ')' end as label from tm",
    "mark_expand": _MAP_SQL + f""",
x as (select job, max(o) filter (where t = 0) as o0, max(o) filter (where t = 7.25) as o7, max(o) filter (where t = 14.5) as o14 from tm group by job),
lb as (select job, case when o14 is null then '0:14 (no incluido en el resumen)' else '0:14 (resumen ' || {_CLOCK('o14')} || ')' end as t14,
 '0:00–0:07 ' || case when o0 is not null and o7 is not null then '(resumen ' || {_CLOCK('o0')} || '–' || {_CLOCK('o7')} || ')' when o0 is null and o7 is null then '(no incluido en el resumen)' else '(incluido en parte en el resumen)' end as r1,
 '0:07–0:14 ' || case when o7 is not null and o14 is not null then '(resumen ' || {_CLOCK('o7')} || '–' || {_CLOCK('o14')} || ')' when o7 is null and o14 is null then '(no incluido en el resumen)' else '(incluido en parte en el resumen)' end as r2 from x)
select job, 1::bigint as n, 'At ' || t14 || ', then ' || r1 || ' and ' || r2 || '; ' || t14 || '.' as line from lb""",
    "timeline_bar": "with " + B.CUTS_SQL + """,
tt as (select job, max(end_ms) + 5000 as total from cuts group by job),
s as (select c.job, least(cast(floor(start_ms / total * 60) as int), 59) as f, least(59, greatest(cast(floor(start_ms / total * 60) as int), cast(ceil(end_ms / total * 60) as int) - 1)) as l from cuts c join tt on tt.job = c.job where included),
m as (select distinct job, unnest(range(f, l + 1)) as i from s), j as (select distinct job from s)
select j.job, string_agg(case when m.i is null then '·' else '#' end, '' order by r.i) as bar from j cross join range(0, 60) r(i) left join m on m.job = j.job and m.i = r.i group by j.job""",
    "image_distance": "select a.vec_id, floor((" + _DISTANCE.format("a.embedding", "b.embedding", "1.0") + ") * 100000.0::double + 0.5::double) / 100000.0::double as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "image_placement_checks": _MARKS_SQL + " select vec_id, label, distance, mark from m",
    "validation_marks": _MARKS_SQL + """, v as (select *, vec_id % 10 * 1.0::double as diff, vec_id % 7 - 3 + case when vec_id % 11 = 0 then 5 else 0 end as lag, 1.0::double - vec_id % 5 / 20.0::double as c, vec_id % 13 * 1.0::double as sp from m),
s as (select *, case when abs(lag) > 4 or diff > 8 then 'fail' when diff > 4 or (sp >= 6 and c < 0.9::double) then 'mark' else 'ok' end as sound from v)
select label, case when bool_or(mark = 'fail') then 'fail' when bool_or(mark = 'mark') then 'mark' else 'ok' end as image, case when bool_or(sound = 'fail') then 'fail' when bool_or(sound = 'mark') then 'mark' else 'ok' end as sound,
cast(count(*) filter (where mark <> 'ok' or sound <> 'ok') as bigint) as marks from s group by label""",
    "level_stream": """with w as (select event_type, date_trunc('hour', ts) as h, count(*) as n, sum(cast(round(value * 100) as bigint) * cast(round(value * 100) as bigint)) as energy from events group by all)
select event_type, cast(count(*) as bigint) as hours, cast(sum(n) as bigint) as n, cast(sum(energy) as bigint) as energy from w group by event_type""",
}
