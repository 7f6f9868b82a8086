"""The data model bound to tables: levels from events, transcripts from conversations, cuts from lineitem, vectors.

Sums that must not depend on the order of rows are sums of integers (cents, characters, milliseconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import half_up

CHARS_A_SECOND = 15.0
ORIGIN = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_levels(events: DataFrame) -> DataFrame:
    """Tracks by type of event, one level an hour, hours without events at the floor: track, i, db."""
    cents = F.round(F.col("value") * 100).cast("long")
    hour = F.expr(f"timestampdiff(HOUR, {ORIGIN}, ts)").alias("i")
    energy = events.groupBy(F.col("event_type").alias("track"), hour).agg(F.sum(cents * cents).alias("s"), F.count(F.lit(1)).alias("n"))
    db = half_up(F.log10(F.col("s") / F.col("n") / 1e4 / 250000.0) * 10, 4)
    energy = energy.select("track", "i", db.alias("db"))
    hours = energy.agg(F.least(F.lit(0).cast("long"), F.min("i")).alias("first"), F.max("i").alias("last"))
    grid = energy.select("track").distinct().crossJoin(F.broadcast(hours)).select("track", F.explode(F.sequence("first", "last")).alias("i"))
    return grid.join(energy, ["track", "i"], "left").select("track", "i", F.coalesce("db", F.lit(-120.0)).alias("db"))


def transcript(conversations: DataFrame) -> DataFrame:
    """Segments: job, seg, role, text, lo, hi; time runs with the characters said."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    rows = conversations.select(F.col("conv_id").alias("job"), F.col("turn").alias("seg"), "role", "text", said.alias("c"))
    return rows.select("job", "seg", "role", "text", (F.col("c") / CHARS_A_SECOND).alias("lo"), ((F.col("c") + F.length("text")) / CHARS_A_SECOND).alias("hi"))


def words(segments: DataFrame) -> DataFrame:
    """Words of segments with the times of their characters: job, seg, w, text, lo, hi; w counts blanks too."""
    parts = segments.select("job", "seg", F.round(F.col("lo") * CHARS_A_SECOND).cast("long").alias("c"), F.posexplode(F.split("text", "[ \n]", -1)).alias("w", "word"))
    before = Window.partitionBy("job", "seg").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("c") + F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    rows = parts.select("job", "seg", F.col("w").cast("long").alias("w"), F.col("word").alias("text"), at.alias("at"))
    return rows.where("text <> ''").select("job", "seg", "w", "text", (F.col("at") / CHARS_A_SECOND).alias("lo"), ((F.col("at") + F.length("text")) / CHARS_A_SECOND).alias("hi"))


def cuts(lineitem: DataFrame) -> DataFrame:
    """Candidate cuts of a job: job, id, start_ms, end_ms, kept_ms, priority, included, pinned, remove_pauses,
    depends_on (null or an id), part, visual_only, note (an edge stayed in speech), quiet (a level).

    Lengths are quantities in seconds; gaps between cuts are 0, 20 or 40 ms and, after each fourth cut, 2 s.
    """
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]
    nth = Window.partitionBy("l_orderkey").orderBy(*order)
    rows = lineitem.select(F.col("l_orderkey").alias("job"), F.row_number().over(nth).cast("long").alias("id"), *order)
    length = F.round(F.col("l_quantity") * 1000).cast("long")
    rows = rows.withColumns({"length": length, "gap": F.col("id") % 3 * 20 + F.when(F.col("id") % 4 == 0, 2000).otherwise(0)})
    before = Window.partitionBy("job").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("length") + F.col("gap")).over(before), F.lit(0))
    percent = F.round(F.col("l_discount") * 100).cast("long")
    kept = F.when(F.col("l_tax") > 0.02, F.floor(F.col("length") * (100 - 6 * percent) / 100)).otherwise(F.col("length"))
    return rows.select(
        "job", "id", start.alias("start_ms"), (start + F.col("length")).alias("end_ms"), kept.cast("long").alias("kept_ms"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("priority"),
        (F.col("l_linestatus") == "F").alias("included"), (F.col("l_tax") >= 0.07).alias("pinned"), (F.col("l_tax") > 0.02).alias("remove_pauses"),
        F.when((F.col("id") > 1) & (percent % 3 == 0), F.col("id") - 1).alias("depends_on"),
        F.col("l_partkey").alias("part"), (F.col("l_partkey") % 11 == 0).alias("visual_only"), (F.col("l_partkey") % 13 == 0).alias("note"),
        (F.col("l_partkey") % 20 - 60.0).alias("quiet"),
    )


def jobs(cuts: DataFrame, orders: DataFrame) -> DataFrame:
    """Per job its total and its target (by the order's priority): job, total, target, speed."""
    totals = cuts.groupBy("job").agg((F.max("end_ms") + 5000).alias("total_ms"))
    total = F.col("total_ms") / 1000.0
    first = F.substring("o_orderpriority", 1, 1)
    target = F.when(first == "2", total * 0.6).when(first == "3", total * 0.4).when(first == "4", F.lit(15.0)).when(first == "5", total * 1.5)
    return orders.join(totals, F.col("o_orderkey") == F.col("job")).select("job", total.alias("total"), target.alias("target"), F.lit(1.25).alias("speed"))


# The same bindings for the other engine, as common table expressions.
LEVELS_SQL = """
ev as (select event_type as track, cast(floor(epoch(ts) / 3600) as bigint) - 473352 as i, cast(round(value * 100) as bigint) as c from events),
en as (select track, i, floor(10 * log10(sum(c * c) / count(*) / 1e4::double / 250000.0::double) * 10000.0::double + 0.5::double) / 10000.0::double as db from ev group by track, i),
levels as (select g.track, g.i, coalesce(en.db, -120.0::double) as db
           from (select track, unnest(range((select least(0, min(i)) from en), (select max(i) + 1 from en))) as i from (select distinct track from en)) g left join en on en.track = g.track and en.i = g.i)"""

SILENCES_SQL = LEVELS_SQL + """,
sr as (select track, i, i - row_number() over (partition by track order by i) as run from levels where db < -18),
silences as (select track, cast(min(i) as double) as lo, cast(max(i) + 1 as double) as hi from sr group by track, run having count(*) >= 3)"""

TRANSCRIPT_SQL = """
segments as (select conv_id as job, turn as seg, role, text, c, c / 15.0::double as lo, (c + length(text)) / 15.0::double as hi
             from (select *, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as c from conversations)),
wp as (select job, seg, c, list_zip(p, range(0, len(p))) as z from (select *, regexp_split_to_array(text, '[ \\n]') as p from segments)),
wx as (select job, seg, c, u[1] as text, u[2] as w from (select job, seg, c, unnest(z) as u from wp)),
wa as (select *, c + coalesce(sum(length(text) + 1) over (partition by job, seg order by w rows between unbounded preceding and 1 preceding), 0) as pos from wx),
words as (select job, seg, w, text, pos / 15.0::double as lo, (pos + length(text)) / 15.0::double as hi from wa where text <> '')"""

CUTS_SQL = """
c0 as (select l_orderkey as job, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as id,
              cast(round(l_quantity * 1000) as bigint) as length, cast(round(l_discount * 100) as bigint) as percent, l_tax, l_returnflag, l_linestatus, l_partkey from lineitem),
c1 as (select *, coalesce(sum(length + id % 3 * 20 + case when id % 4 = 0 then 2000 else 0 end) over (partition by job order by id rows between unbounded preceding and 1 preceding), 0) as s from c0),
cuts as materialized (select job, id, cast(s as bigint) as start_ms, cast(s + length as bigint) as end_ms,
                cast(case when l_tax > 0.02 then floor(length * (100 - 6 * percent) / 100) else length end as bigint) as kept_ms,
                case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as priority, l_linestatus = 'F' as included, l_tax >= 0.07 as pinned, l_tax > 0.02 as remove_pauses,
                case when id > 1 and percent % 3 = 0 then id - 1 end as depends_on, l_partkey as part,
                l_partkey % 11 = 0 as visual_only, l_partkey % 13 = 0 as note, l_partkey % 20 - 60.0::double as quiet from c1)"""

JOBS_SQL = CUTS_SQL + """,
jt as (select job, max(end_ms) + 5000 as total_ms from cuts group by job),
jobs as (select job, total_ms / 1000.0::double as total,
                case substr(o_orderpriority, 1, 1) when '2' then total_ms / 1000.0::double * 0.6::double when '3' then total_ms / 1000.0::double * 0.4::double
                     when '4' then 15.0::double when '5' then total_ms / 1000.0::double * 1.5::double end as target, 1.25::double as speed
         from orders join jt on o_orderkey = job)"""
