"""Queries on level series and event times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe import parameters as P
from chronoframe.functions.scalars import half_up
from chronoframe.operators import intervals, signal
from chronoframe.sources import bindings as B

HOUR = 1.0
QUIET_DB = -18.0


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hourly_levels(B.table(spark, sf_dir, "events"))


def _silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.silences(_levels(spark, sf_dir), ["track"], QUIET_DB, 3.0, HOUR)


def level_series(spark, sf_dir):
    return _levels(spark, sf_dir)


def silences(spark, sf_dir):
    return _silences(spark, sf_dir)


def voiced_blocks(spark, sf_dir):
    return signal.voiced(_levels(spark, sf_dir), ["track"], 24, QUIET_DB)


def level_percentile(spark, sf_dir):
    days = _levels(spark, sf_dir).withColumn("day", F.floor(F.col("i") / 24).cast("long"))
    return signal.percentile(days, ["track", "day"])


def _weeks(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    weeks = levels.select("track", F.floor(F.col("i") / 168).cast("long").alias("cut")).distinct()
    return weeks.select("track", "cut", (F.col("cut") * 168.0).alias("a"), (F.col("cut") * 168.0 + 168.0).alias("b"))


def _islands(spark, sf_dir):
    return intervals.islands(
        _weeks(spark, sf_dir), _silences(spark, sf_dir), ["track"], interval=1.0, margin=0.75, min_silence=3.0, min_island=2.0, min_edge=3.0, width=168.0
    )


def speech_islands(spark, sf_dir):
    return _islands(spark, sf_dir)


def spoken_difference(spark, sf_dir):
    segments = B.transcript(B.table(spark, sf_dir, "conversations"))
    protected = B.words(segments).select("job", (F.col("lo") - P.WORD_MARGIN).alias("lo"), (F.least(F.col("hi"), F.col("lo") + P.WORD_ONSET) + P.WORD_MARGIN).alias("hi"))
    gaps = segments.select("job", F.col("seg").alias("gap"), "lo", "hi")
    left = intervals.difference(gaps, protected, ["job"], 30.0)
    return left.select("job", "gap", half_up(F.col("lo"), 6).alias("lo"), half_up(F.col("hi"), 6).alias("hi"))


def nearest_silence_asof(spark, sf_dir):
    edges = _levels(spark, sf_dir).select("track", (F.col("i") + 0.5).alias("edge"))
    quiet = _silences(spark, sf_dir)
    before = intervals.asof(edges, quiet, ["track"], "edge", "hi", 24.0).withColumnRenamed("nearest", "before").select("track", "edge", "before")
    after = intervals.asof(edges, quiet, ["track"], "edge", "lo", 24.0, forward=True).withColumnRenamed("nearest", "after").select("track", "edge", "after")
    return before.join(after, ["track", "edge"])


def quiet_cut(spark, sf_dir):
    return signal.quiet_cut(_levels(spark, sf_dir), ["track"], 0, 1 << 40, 30, HOUR)


def speech_blocks(spark, sf_dir):
    return signal.speech_blocks(_levels(spark, sf_dir), ["track"], 100, 20, 30, HOUR)


def uncovered_loud_gaps(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    loud = intervals.runs(levels.where("db >= -9"), ["track"])
    heard = loud.select("track", F.col("first").cast("double").alias("lo"), (F.col("last") + 1.0).alias("hi"))
    frames = levels.groupBy("track").agg(F.lit(0.0).alias("a"), (F.max("i") + 1.0).alias("b"))
    return signal.uncovered(heard, frames, levels, ["track"], threshold=QUIET_DB, least=2.0, step=HOUR, width=48.0)


def pts_gaps(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = B.table(spark, sf_dir, "events").select("user_id", F.lag("ts").over(order).alias("before"), "ts")
    gap = events.select("user_id", F.expr("timestampdiff(MICROSECOND, before, ts)").alias("gap"))
    return gap.groupBy("user_id").agg(
        F.count_if(F.col("gap") > 21_600_000_000).alias("gaps"), F.max("gap").alias("longest_us"), F.count("gap").alias("steps")
    )


def event_sessions(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), cents.alias("cents"))
    sessions = rows.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.sum("cents").alias("cents"))
    return sessions.select("user_id", "first_event", "n", "cents")


def envelope_stretch(spark, sf_dir):
    return signal.stretched(_levels(spark, sf_dir), ["track"], 1.25)


def _shifted(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    lag = F.length("track") % 5 - 2
    return levels, levels.select("track", (F.col("i") + lag).alias("i"), "db")


def envelope_align(spark, sf_dir):
    reference, produced = _shifted(spark, sf_dir)
    return signal.align(produced, reference, ["track"])


_L = "with " + B.LEVELS_SQL
_S = "with " + B.SILENCES_SQL

QUERIES = {f.__name__: f for f in (
    level_series, silences, voiced_blocks, level_percentile, speech_islands, spoken_difference, nearest_silence_asof, quiet_cut, speech_blocks,
    uncovered_loud_gaps, pts_gaps, event_sessions, envelope_stretch, envelope_align,
)}

ORACLES = {
    "level_series": _L + " select track, i, db from levels",
    "silences": _S + " select track, lo, hi from silences",
    "voiced_blocks": _L + " select track, cast(i // 24 as bigint) as block, bool_or(db >= -18) as voiced, cast(count(*) filter (where db >= -18) as bigint) as loud from levels group by all",
    "level_percentile": _L + """, g as (select track, cast(i // 24 as bigint) as day, list_sort(list(db)) as l from levels group by all)
select track, day, cast(len(l) as bigint) as n, l[least(len(l), cast(floor(0.1::double * len(l)) as bigint) + 1)] as level from g""",
    "speech_islands": _S + """,
wk as (select distinct track, cast(i // 168 as bigint) as cut from levels),
win as (select track, cut, cut * 168.0::double as a, cut * 168.0::double + 168 as b from wk),
q as (select w.track, cut, a, b, greatest(a, lo) as lo, least(b, hi) as hi from win w join silences s on s.track = w.track and s.lo < w.b and s.hi > w.a),
gap as (select track, cut, a, b, lo + 0.75 as lo, hi - 0.75 as hi from q where hi - lo >= 3),
pts as (select track, cut, a, b, lo, hi from gap union all select track, cut, a, b, b, b from win),
cur as (select *, greatest(a, coalesce(max(hi) over (partition by track, cut order by lo, hi rows between unbounded preceding and 1 preceding), a)) as c from pts),
sp as (select track, cut, c as lo, lo as hi, row_number() over (partition by track, cut order by c) as n from cur where lo - c >= 2 - 1e-9),
lim as (select *, min(case when hi - lo >= 3 - 1e-9 then n end) over (partition by track, cut) as f, max(case when hi - lo >= 3 - 1e-9 then n end) over (partition by track, cut) as l from sp),
sn as (select track, cut, floor(lo + 0.5) as lo, floor(hi + 0.5) as hi from lim where n between f and l),
ok as (select *, coalesce(cast(lo - lag(hi) over (partition by track, cut order by lo) >= 1 - 1e-9 as int), 1) as new from sn where hi - lo >= 1 - 1e-9),
gr as (select *, sum(new) over (partition by track, cut order by lo) as g from ok)
select track, cut, min(lo)::double as lo, max(hi)::double as hi from gr group by track, cut, g""",
    "spoken_difference": "with " + B.TRANSCRIPT_SQL + """,
pr as (select job, lo - 0.02::double as lo, least(hi, lo + 0.5::double) + 0.02::double as hi from words),
gp as (select job, seg as gap, lo as a, hi as b from segments),
pt as (select g.job, gap, a, b, p.lo, p.hi from gp g join pr p on p.job = g.job and p.lo < b and p.hi > a union all select job, gap, a, b, b, b from gp),
cu as (select *, greatest(a, coalesce(max(hi) over (partition by job, gap order by lo, hi rows between unbounded preceding and 1 preceding), a)) as c from pt)
select job, gap, floor(c * 1000000.0::double + 0.5::double) / 1000000.0::double as lo, floor(least(lo, b) * 1000000.0::double + 0.5::double) / 1000000.0::double as hi from cu where lo > c and least(lo, b) > c""",
    "nearest_silence_asof": _S + """,
e as (select track, i + 0.5::double as edge from levels)
select track, edge, (select max(hi) from silences s where s.track = e.track and s.hi <= edge and s.hi >= edge - 24) as before,
       (select min(lo) from silences s where s.track = e.track and s.lo >= edge and s.lo <= edge + 24) as after from e""",
    "quiet_cut": _L + """,
w as (select track, i, sum(cast(round(db * 10000) as bigint)) over (partition by track order by i rows between current row and 29 following) as t, count(*) over (partition by track order by i rows between current row and 29 following) as n from levels)
select track, cast(arg_min(i, t * 1000000 + i) + 15 as double) as at from w where n = 30 group by track""",
    "speech_blocks": "with recursive " + B.LEVELS_SQL + """,
w as (select track, i, sum(cast(round(db * 10000) as bigint)) over o as t, count(*) over o as m from levels window o as (partition by track order by i rows between current row and 29 following)),
tot as (select track, max(i) + 1 as n from levels group by track),
cut as (select tot.track, e.i as edge, arg_min(w.i, w.t * 1000000 + w.i) + 15 as nxt from tot join levels e on e.track = tot.track
        join w on w.track = tot.track and w.m = 30 and w.i between e.i + 80 and least(n, e.i + 120) - 30 group by tot.track, e.i),
rec as (select track, 0 as k, 0::bigint as edge from tot union all
        select r.track, k + 1, c.nxt from rec r join tot on tot.track = r.track join cut c on c.track = r.track and c.edge = r.edge where n - r.edge > 120),
ed as (select track, k, edge from rec union all select r.track, max(k) + 1, max(n) from rec r join tot on tot.track = r.track group by r.track)
select track, cast(k as bigint) as block, cast(edge as double) as lo, cast(nx as double) as hi from (select *, lead(edge) over (partition by track order by k) as nx from ed) where nx is not null""",
    "uncovered_loud_gaps": _L + """,
sl as (select track, i, i - row_number() over (partition by track order by i) as run from levels where db >= -9),
s as (select track, min(i)::double as lo, max(i) + 1.0::double as hi from sl group by track, run),
f as (select track, max(i) + 1.0::double as b from levels group by track),
p as (select track, lo, hi from s union all select track, b, b from f),
c as (select *, coalesce(max(hi) over (partition by track order by lo, hi rows between unbounded preceding and 1 preceding), 0) as e from p),
g as (select track, e as lo, lo as hi from c where lo - e >= 2)
select g.track, lo, hi from g join levels l on l.track = g.track and l.i >= lo and l.i < hi and l.db > -18 group by g.track, lo, hi having count(*) >= 1""",
    "pts_gaps": """with g as (select user_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events)
select user_id, cast(count(*) filter (where gap > 21600000000) as bigint) as gaps, max(gap) as longest_us, cast(count(gap) as bigint) as steps from g group by user_id""",
    "event_sessions": """with g as (select *, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events),
s as (select *, sum(case when gap is null or gap > 3600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from g)
select user_id, min(event_id) as first_event, cast(count(*) as bigint) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from s group by user_id, k""",
    "envelope_stretch": _L + """,
k as (select track, unnest(range(0, cast(ceil((n + 1) / 1.25::double) as bigint))) as k from (select track, max(i) as n from levels group by track)),
p as (select track, k, least(k * 1.25::double, (select max(i) from levels)) as pos from k)
select p.track, k as i, floor((x.db + (coalesce(y.db, x.db) - x.db) * (pos - floor(pos))) * 10000.0::double + 0.5::double) / 10000.0::double as db
from p join levels x on x.track = p.track and x.i = cast(floor(pos) as bigint) left join levels y on y.track = p.track and y.i = cast(floor(pos) as bigint) + 1""",
    "envelope_align": _L + """,
r as (select * from levels),
p as (select track, i + length(track) % 5 - 2 as i, db from r),
l as (select *, unnest(range(-6, 7)) as lag from p),
s as (select l.track, lag, floor(avg(abs(l.db - r.db)) * 10000.0::double + 0.5::double) / 10000.0::double as difference, corr(l.db, r.db) as c from l join r on r.track = l.track and r.i = l.i - lag group by l.track, lag)
select distinct on (track) track, lag, difference, floor(c * 10000.0::double + 0.5::double) / 10000.0::double as correlation from s order by track, difference, lag""",
}
