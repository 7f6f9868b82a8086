"""Queries on probes, files, streams of events and the checks before a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions import scalars as S
from chronoframe.operators import edges, gates, intervals, media, montage, signal
from chronoframe.plans.planner_queries import _blocks, _pieces
from chronoframe.plans.signal_queries import _levels
from chronoframe.sources import bindings as B
from chronoframe.sources import storage
from chronoframe.streaming import levels as streams


def _probes(spark, sf_dir) -> DataFrame:
    """Probe documents of made-up recordings, one for each order."""
    k = F.col("o_orderkey")
    text = lambda value: F.lit(value).cast("string")
    disposition = lambda cover: F.struct(cover.cast("int").alias("attached_pic"))

    def stream(index, kind, real, average, start, duration, rate, transfer, tags, cover):
        parts = [F.lit(index), text(kind), real, average, start, duration, text(rate), transfer, tags, disposition(cover)]
        names = ["index", "codec_type", "r_frame_rate", "avg_frame_rate", "start_time", "duration", "sample_rate", "color_transfer", "tags", "disposition"]
        return F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)])

    none, tags = text(None), F.create_map(text("DURATION-eng"), text("00:01:30.500000000"))
    real = F.when(k % 6 == 0, "90000/1").otherwise("30000/1001")
    average = F.when(k % 12 == 0, "0/0").when(k % 8 == 1, "30000/1001").otherwise("25/1")
    late = F.when(k % 5 == 0, "1.52").otherwise("0.033")
    picture = stream(0, "video", real, average, late, F.when(k % 3 > 0, text("59.25")), None, F.when(k % 13 == 0, "smpte2084").otherwise("bt709"), tags, (k % 9 == 0))
    sound = lambda index, rate: stream(index, "audio", text("0/0"), text("0/0"), none, text("58.0"), rate, none, F.create_map(text("title"), text("a")), F.lit(False))
    found = F.array(F.when(k % 7 > 0, picture), F.when(k % 10 > 0, sound(1, 44100)), F.when(k % 10 > 0, sound(2, 48000)))
    container = F.struct(
        F.when(k % 11 == 0, "N/A").otherwise(F.concat(k % 500 + 60, F.lit(".5"))).alias("duration"), F.when(k % 5 == 0, "1.5").otherwise("0.000000").alias("start_time"),
        F.when(k % 4 == 0, "mpegts").otherwise("mov,mp4,m4a").alias("format_name"),
    )
    orders = B.table(spark, sf_dir, "orders")
    return orders.select(k.alias("job"), container.alias("format"), (F.lit(1) + (k % 2 == 0).cast("int")).alias("audio_stream"), F.filter(found, lambda s: s.isNotNull()).alias("streams"))


def probe_facts(spark, sf_dir):
    rows = media.timeline(_probes(spark, sf_dir))
    picture, sound = F.get(media.pictures(), F.lit(0)), F.get(media.sounds(), F.lit(0))
    of = lambda stream, value: F.when(stream.isNotNull(), value)
    return rows.select(
        "job", "kind", "start", "origin", "rate", S.half_up(F.col("interval"), 9).alias("interval"), "fps", "sample_rate", media.duration().alias("duration"), media.seek_margin().alias("margin"),
        F.size(media.pictures()).alias("pictures"), of(picture, S.half_up(media.stream_duration(picture), 6)).alias("picture"), of(picture, S.half_up(media.stream_end(picture), 6)).alias("picture_end"),
        of(sound, media.stream_duration(sound)).alias("sound"), media.tag_seconds(picture).alias("tagged"), F.coalesce(gates.high_range(picture), F.lit(False)).alias("high_range"),
    )


def packet_warnings(spark, sf_dir):
    line = F.col("l_linenumber") * 40 + F.when(F.col("l_partkey") % 5 == 0, 80).otherwise(0) + F.col("l_suppkey") % 3
    stamps = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.when(F.col("l_suppkey") % 9 == 0, "N/A").otherwise((line / 1000.0).cast("string")).alias("stamp"))
    return media.packet_warnings(_probes(spark, sf_dir), stamps)


def packet_window(spark, sf_dir):
    """Steps between the first 600 events of each type; the limit is the feature."""
    stamps = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("job"), F.expr("cast(unix_micros(cast(ts as timestamp)) / 1e6 as string)").alias("stamp"), F.lit(1200.0).alias("interval"))
    return media.packet_gaps(stamps)


def _nations(spark, sf_dir):
    return B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name", F.col("n_regionkey").cast("long").alias("region"))


def event_log(spark, sf_dir):
    """Events of two shapes appended to one log of JSON lines, and read back as one table."""
    path = storage.fresh_path(spark, "event-log")
    rows = _nations(spark, sf_dir)
    storage.append_log(rows.select(F.lit("plan").alias("event"), "id", F.struct("n_name", "region").alias("payload")), path)
    storage.append_log(rows.where("id % 3 = 0").select(F.lit("render").alias("event"), "id", (F.col("region") * 0.5).alias("seconds")), path)
    return storage.read_json(spark, path, "event string, id long, payload struct<n_name:string,region:long>, seconds double", lines=True).select("event", "id", "payload.n_name", "payload.region", "seconds")


def published_versions(spark, sf_dir):
    """Two versions published one after the other; the last one read back, with the number that comes next."""
    folder, rows = storage.fresh_path(spark, "versions"), _nations(spark, sf_dir)
    for part in (rows.where("id % 2 = 0"), rows):
        storage.publish(part.withColumn("length", F.length("n_name")), folder, storage.next_version(spark, folder))
    following = storage.next_version(spark, folder)
    return storage.read_version(spark, folder, following - 1).select("id", "n_name", "length", F.lit(following).alias("following"))


def replaced_index(spark, sf_dir):
    """An index of revisions that is replaced as a whole each time a row is added."""
    folder, rows = storage.fresh_path(spark, "revisions"), _nations(spark, sf_dir)
    for region in range(3):
        added = rows.where(F.col("region") == region).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("reason"))
        storage.replace_with(spark, folder, lambda old, added=added: added if old is None else old.unionByName(added))
    return storage.read_replaced(spark, folder)


def file_fingerprints(spark, sf_dir):
    path = storage.fresh_path(spark, "texts")
    B.table(spark, sf_dir, "nation").orderBy("n_nationkey").repartition(1, "n_regionkey").sortWithinPartitions("n_nationkey").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    files = storage.read_files(spark, path + "/*/*.txt")
    region = F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int")
    found = storage.fingerprints(files, 30, 10).select(region.alias("region"), "size", "sha256")
    lines = storage.read_texts(spark, path + "/*/*.txt").select(region.alias("region"), (F.size(F.split("text", "\n")) - 1).alias("lines"))
    return found.join(lines, "region")


def pcm_levels(spark, sf_dir):
    """Files with a plain header and 16-bit samples made of the parts' sizes; their levels in windows of 16 samples."""
    value = (F.col("p_size") * 331 + F.col("p_partkey") % 7 * 1000).cast("long")
    little = F.concat(F.lpad(F.hex(value % 256), 2, "0"), F.lpad(F.hex(F.floor(value / 256).cast("long")), 2, "0"))
    rows = B.table(spark, sf_dir, "part").select(F.col("p_type").alias("path"), F.struct("p_partkey", little.alias("hex")).alias("s"))
    samples = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["hex"]), "")
    files = rows.groupBy("path").agg(F.unhex(F.concat(F.lit("00" * 44), samples)).alias("content"))
    levels = signal.levels_of(storage.pcm_samples(files), ["path"], 16)
    return levels.select("path", "i", S.half_up(F.col("db").cast("double"), 2).alias("db"))


def level_spread(spark, sf_dir):
    return signal.spread(_levels(spark, sf_dir), ["track"]).select("track", S.half_up(F.col("spread"), 6).alias("spread"))


def merged_spans(spark, sf_dir):
    return intervals.merge(_pieces(spark, sf_dir), ["job"], 20.0)


def block_names(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    return rows.select("job", "block", S.block_name(F.col("lo")).alias("name"), S.space_needed(F.col("frames")).alias("space"), S.part_label(F.col("job"), F.col("block"), F.col("frames")).alias("label"))


def tempo_factors(spark, sf_dir):
    speed = F.col("p_size") / 16.0
    rows = B.table(spark, sf_dir, "part").select("p_partkey", speed.alias("speed"), S.tempo_factors(speed).alias("f"))
    product = F.aggregate("f", F.lit(1.0), lambda a, x: a * x)
    return rows.select(F.col("p_partkey").alias("id"), S.factor(F.col("speed")).alias("label"), F.size("f").alias("n"), S.half_up(F.get("f", F.lit(0)), 9).alias("first"), S.half_up(product, 6).alias("product"))


def counted_shares(spark, sf_dir):
    """Labels of counts and shares: orders by priority and status of each customer's region."""
    orders = B.table(spark, sf_dir, "orders")
    sums = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return sums.select("o_custkey", S.counted(F.col("n"), "corte", "cortes").alias("cuts"), S.percent(F.col("f"), F.col("n")).alias("share"))


def resume_settings(spark, sf_dir):
    """Whether each order's results may be gone on with: all settings must agree, and null is a value."""
    orders = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    old = F.struct(F.when(key % 4 > 0, key % 3).alias("model"), (key % 5).alias("speed"))
    new = F.struct(F.when(key % 4 != 1, key % 3).alias("model"), F.when(key % 7 == 0, F.lit(9)).otherwise(key % 5).alias("speed"))
    from chronoframe.operators.blocks import same_settings

    return orders.select(key.alias("job"), same_settings(old, new).alias("same"))


def source_checks(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    planned = orders.select(key.alias("job"), F.concat(F.lit("/a/"), key).alias("path"), (key * 7).alias("size"), key.alias("mtime_ns"), montage.digest(key.cast("string")).alias("sha256"))
    current = planned.where("job % 10 > 0").select(
        "job", F.when(F.col("job") % 3 == 0, F.concat(F.lit("/b/"), "job")).otherwise(F.col("path")).alias("path"), F.when(F.col("job") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        "mtime_ns", F.when(F.col("job") % 6 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return gates.sources_agree(planned, current).select("job", F.array_join("differ", ", ").alias("differ"), "moved")


def effective_settings(spark, sf_dir):
    k, null = F.col("o_orderkey"), F.lit(None)
    drafts = B.table(spark, sf_dir, "orders").select(
        k.alias("job"), (k % 50 * 60.0 + 600.0).alias("total"), F.when(k % 3 == 0, F.concat(k % 60 + 1, F.lit("%"))).when(k % 3 == 1, "mucho").alias("target"), F.when(k % 4 == 0, "5min").alias("call_target"),
        F.when(k % 5 > 0, 1.0 + k % 13 / 10.0).alias("speed"), F.when(k % 6 == 0, 2.25).when(k % 6 == 1, 1.5).alias("call_speed"), F.when(k % 7 == 0, False).alias("pauses"),
        F.when(k % 8 == 0, True).alias("call_pauses"), F.when(k % 9 == 0, -40.0).alias("silence_db"), F.when(k % 11 == 0, float("inf")).otherwise(null.cast("double")).alias("call_silence_db"),
    )
    found = gates.effective_settings(drafts)
    return found.select("job", "target", S.half_up(F.col("seconds"), 6).alias("seconds"), S.half_up(F.col("tolerance"), 6).alias("tolerance"), "speed", "remove_pauses", F.when(F.abs("silence_db") < 1e6, F.col("silence_db")).alias("silence_db"), "problem")


def unknown_parents(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    drafts = orders.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("draft"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 12).alias("parent"))
    versions = orders.groupBy(F.col("o_custkey").alias("job")).agg(F.count(F.lit(1)).alias("n")).select("job", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("version"))
    return gates.unknown_parents(drafts, versions)


def outline_acceptance(spark, sf_dir):
    customer = B.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    computed = montage.digest(montage.canonical(id=key, name=F.col("c_name")))
    stored = F.when(key % 5 == 0, F.lit(None)).when(key % 4 == 0, F.reverse(computed)).otherwise(computed)
    return customer.select(key.alias("job"), gates.outline_accepted(stored, computed, F.when(key % 3 == 0, " ").otherwise("sí")).alias("problem"))


def cuts_out_of_speech(spark, sf_dir):
    """Cuts of each track (its levels 10 ms apart) with their edges moved to silences, else between words."""
    levels = _levels(spark, sf_dir).withColumnRenamed("track", "job")
    jobs = levels.select("job").distinct()
    k = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cuts = jobs.select("job", k(7).alias("id")).select("job", "id", (F.col("id") * 0.9 + 0.233).alias("a"), (F.col("id") * 0.9 + 0.733).alias("b"))
    words = jobs.select("job", k(23).alias("w")).select("job", (F.col("w") * 0.31 + 0.05).alias("lo"), (F.col("w") * 0.31 + 0.25).alias("hi"))
    found = edges.adjust_edges(cuts, levels, words, -18.0)
    return found.select("job", "id", S.half_up(F.col("lo"), 6).alias("lo"), S.half_up(F.col("hi"), 6).alias("hi"), "note")


def mark_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "inf").when(k % 5 == 1, F.concat(k % 900, F.lit(".5"))).when(k % 5 == 2, "-3").when(k % 5 == 3, "doce").otherwise((k % 700).cast("string"))
    return B.table(spark, sf_dir, "orders").select(k.alias("job"), text.alias("text"), gates.mark_seconds(text, (k % 600).cast("double")).alias("seconds"))


def session_stream(spark, sf_dir):
    stream = streams.sessions(streams.event_stream(spark, f"{sf_dir}/events.parquet"))
    found = streams.run_available(stream, "session-stream")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (
    probe_facts, packet_warnings, packet_window, event_log, published_versions, replaced_index, file_fingerprints, pcm_levels, level_spread, merged_spans, block_names, tempo_factors, counted_shares,
    resume_settings, source_checks, effective_settings, unknown_parents, outline_acceptance, cuts_out_of_speech, mark_numbers, session_stream,
)}

_HALF = lambda x, n: f"floor(({x}) * {10**n}.0::double + 0.5::double) / {10**n}.0::double"
_PROBES_SQL = """with o as (select o_orderkey as job, o_orderkey as k from orders),
b as (select *, case when k % 11 > 0 then k % 500 + 60.5::double end as dur, case when k % 5 = 0 then 1.5::double else 0 end as start, k % 7 > 0 and k % 9 > 0 as seen, k % 10 > 0 as heard from o),
r as (select *, case when not seen then null when k % 6 > 0 then '30000/1001' when k % 12 > 0 then case when k % 8 = 1 then '30000/1001' else '25/1' end else '30' end as rate,
             case when seen then case when k % 3 > 0 then 59.25::double else 90.5::double end end as own, case when k % 5 = 0 then 1.52::double - 1.5::double else 0.033::double end as late from b),
p as (select *, case rate when '30000/1001' then 1 / (30000.0::double / 1001) when '25/1' then 1 / 25.0::double when '30' then 1 / 30.0::double end as interval, case when seen then least(own, dur) end as pic from r)"""

ORACLES = {
    "probe_facts": _PROBES_SQL + f""" select job, case when not heard then null when seen then 'video' else 'audio' end as kind, start, case when rate is null then 0 else {_HALF('late', 9)} end as origin, rate, {_HALF('interval', 9)} as interval,
{_HALF('1 / interval', 9)} as fps, case when not heard then 0 when k % 2 = 0 then 48000 else 44100 end as sample_rate, dur as duration, case when k % 4 = 0 then 10.0::double else 3.0::double end as margin, cast(seen as int) as pictures,
{_HALF('pic', 6)} as picture, {_HALF('case when seen then least(late + pic, dur) end', 6)} as picture_end, case when heard then least(58.0::double, dur) end as sound, case when seen then 90.5::double end as tagged, seen and k % 13 = 0 as high_range from p""",
    "packet_warnings": _PROBES_SQL + f""",
v as (select *, case when k % 6 = 0 then '90000/1' else '30000/1001' end as real, case when k % 12 = 0 then '0/0' when k % 8 = 1 then '30000/1001' else '25/1' end as average from p where seen and heard),
l as (select l_orderkey as job, (l_linenumber * 40 + case when l_partkey % 5 = 0 then 80 else 0 end + l_suppkey % 3) / 1000.0::double as stamp from lineitem where l_suppkey % 9 > 0),
g as (select l.job, interval, stamp - lag(stamp) over (partition by l.job order by stamp) as gap from l join v on v.job = l.job),
s as (select job, count(*) as packets, count(*) filter (where gap > interval * 1.5::double) as gaps, max({_HALF('gap', 6)}) filter (where gap > interval * 1.5::double) as longest from g group by job)
select job, 'fuente_vfr' as code, 'La cadencia declarada no es constante (r_frame_rate ' || real || ', avg_frame_rate ' || average || '): el montaje fija F y normaliza con el filtro fps.' as message, false as blocking from v where real <> average
union all select job, 'huecos_pts', 'El sondeo de los primeros ' || packets || ' paquetes encuentra ' || gaps || ' saltos mayores de un fotograma (el mayor, ' || printf('%.3f', longest) || ' s): puede faltar imagen en el original.', false from s where gaps > 0""",
    "packet_window": f"""with e as (select event_type as job, epoch_us(ts) / 1e6::double as stamp, row_number() over (partition by event_type order by ts) as n, epoch_us(ts) / 1e6::double - lag(epoch_us(ts) / 1e6::double) over (partition by event_type order by ts) as gap from events)
select job, cast(count(*) as bigint) as packets, cast(count(*) filter (where gap > 1800) as bigint) as gaps, max({_HALF('gap', 6)}) filter (where gap > 1800) as longest from e where n <= 600 group by job""",
    "event_log": """select 'plan' as event, n_nationkey::bigint as id, n_name, n_regionkey::bigint as region, null::double as seconds from nation
union all select 'render', n_nationkey, null, null, n_regionkey * 0.5::double from nation where n_nationkey % 3 = 0""",
    "published_versions": "select n_nationkey::bigint as id, n_name, length(n_name)::int as length, 3 as following from nation",
    "replaced_index": "select n_regionkey::bigint as region, cast(count(*) as bigint) as n, min(n_name) as reason from nation where n_regionkey < 3 group by n_regionkey",
    "file_fingerprints": """with f as (select n_regionkey as region, string_agg(n_name || chr(10), '' order by n_nationkey) as t, count(*) as lines from nation group by n_regionkey)
select region, length(t)::bigint as size, sha256(case when length(t) <= 30 then t else substr(t, 1, 10) || right(t, 10) end) as sha256, lines::int as lines from f""",
    "pcm_levels": f"""with s as (select p_type as path, p_size * 331 + p_partkey % 7 * 1000 as x, row_number() over (partition by p_type order by p_partkey) - 1 as n from part),
w as (select path, cast(n // 16 as bigint) as i, sum(x * x) as e, count(*) as m from s group by all)
select path, i, {_HALF('greatest(-120.0::double, log10(e / 16 / 1073741824.0::double) * 10)::float::double', 2)} as db from w where m = 16""",
    "level_spread": "with " + B.LEVELS_SQL + f" select track, {_HALF('coalesce(stddev_pop(db), 0)', 6)} as spread from levels group by track",
    "merged_spans": """with p0 as (select l_suppkey as job, l_orderkey::double as lo, max(l_quantity) as q from lineitem group by all), sp as (select job, lo, lo + floor(q) / 64.0::double as hi from p0),
m as (select *, max(hi) over (partition by job order by lo, hi rows between unbounded preceding and 1 preceding) as before from sp),
g as (select *, sum(case when before is null or lo > before + 20 then 1 else 0 end) over (partition by job order by lo, hi) as grp from m)
select job, min(lo) as lo, max(hi) as hi from g group by job, grp""",
    "block_names": "with " + B.JOBS_SQL + """, b as (select job, total, unnest(range(0, cast(ceil(total / 60) as bigint))) as block from jobs),
c as (select job, block, block * 60 as lo, cast(greatest(1, ceil(floor((least(total, block * 60.0::double + 60) - block * 60.0::double) / 15.0::double * 1e9::double + 0.5::double) / 1e9::double)) as bigint) as frames from b)
select job, block, 'b' || lpad(cast(lo as varchar), 5, '0') as name, frames * 1000000 as space, 'corte ' || job || ' subcorte ' || (block + 1) || '/' || frames as label from c""",
    "tempo_factors": f"""with s as (select p_partkey as id, p_size / 16.0::double as speed from part),
n as (select *, case when speed = 1 then 0 else cast(greatest(1, ceil(log2(speed) - 1e-9)) as int) end as n from s),
f as (select *, case when n > 0 then pow(speed, 1.0::double / n) end as f from n)
select id, '×' || replace(regexp_replace(printf('%.5f', speed), '\\.?0+$', ''), '.', ',') as label, n, {_HALF('f', 9)} as first, {_HALF('case when n = 0 then 1 else speed end', 6)} as product from f""",
    "counted_shares": """with s as (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as f from orders group by o_custkey)
select o_custkey, n || case when n = 1 then ' corte' else ' cortes' end as cuts, replace(printf('%.1f', floor(f * 100 / n::double * 10.0::double + 0.5::double) / 10.0::double), '.', ',') || ' %' as share from s""",
    "resume_settings": """select o_orderkey as job, (case when o_orderkey % 4 > 0 then o_orderkey % 3 end) is not distinct from (case when o_orderkey % 4 <> 1 then o_orderkey % 3 end)
and o_orderkey % 5 = case when o_orderkey % 7 = 0 then 9 else o_orderkey % 5 end as same from orders""",
    "source_checks": """with o as (select o_orderkey as job, o_orderkey % 10 > 0 as there from orders),
d as (select job, there, concat_ws(', ', case when not there or job % 4 = 0 then 'size' end, case when not there then 'mtime_ns' end, case when not there or job % 6 = 0 then 'sha256' end) as differ from o)
select job, differ, differ = '' and job % 3 = 0 as moved from d""",
    "effective_settings": f"""with o as (select o_orderkey as job, o_orderkey as k, o_orderkey % 50 * 60.0::double + 600 as total from orders),
s as (select *, case when k % 4 = 0 then '5min' when k % 3 = 0 then (k % 60 + 1) || '%' when k % 3 = 1 then 'mucho' end as target, case when k % 4 = 0 then 300.0::double when k % 3 = 0 then (k % 60 + 1) * total / 100 end as want,
             case when k % 6 = 0 then 2.25::double when k % 6 = 1 then 1.5::double when k % 5 > 0 then 1.0::double + k % 13 / 10.0::double else 1.25::double end as speed,
             case when k % 8 = 0 then true when k % 7 = 0 then false else true end as remove_pauses, case when k % 11 = 0 then null when k % 9 = 0 then -40.0::double else -50.0::double end as silence_db from o),
v as (select *, case when want > 0 and want < total then want end as seconds from s)
select job, target, {_HALF('seconds', 6)} as seconds, {_HALF('case when seconds is not null then greatest(seconds * 0.05::double, 10) end', 6)} as tolerance, {_HALF('speed', 3)} as speed, remove_pauses, silence_db,
case when speed < 1 or speed > 2 then 'speed' when silence_db is null then 'silence_db' when target is not null and seconds is null then 'target' end as problem from v""",
    "unknown_parents": """with d as (select o_custkey as job, o_orderkey as draft, case when o_orderkey % 4 > 0 then o_orderkey % 12 end as parent from orders), v as (select o_custkey as job, count(*) as n from orders group by o_custkey)
select d.job, draft, parent from d join v on v.job = d.job where parent is not null and (parent < 1 or parent > n)""",
    "outline_acceptance": "select c_custkey as job, case when c_custkey % 3 = 0 then 'phrase' when c_custkey % 5 = 0 or c_custkey % 4 = 0 then 'sha256' end as problem from customer",
    "cuts_out_of_speech": "with " + B.LEVELS_SQL + f""",
jb as (select distinct track as job from levels),
cu as (select job, k as id, k * 0.9::double + 0.233::double as a, k * 0.9::double + 0.733::double as b from jb, range(0, 7) r(k)),
wd as (select job, k * 0.31::double + 0.05::double as lo, k * 0.31::double + 0.25::double as hi from jb, range(0, 23) r(k)),
wl as (select *, lag(hi) over (partition by job order by lo) as before, lead(lo) over (partition by job order by lo) as after from wd),
pt as (select job, id, -1 as side, a as x, greatest(0, a - 0.08::double) as l0, a as l1, greatest(0, a - 0.7::double) as w0, a as w1 from cu union all select job, id, 1, b, b, b + 0.08::double, b, b + 0.7::double from cu),
pv as (select *, (select max(hi) from wd where wd.job = pt.job and hi <= x) as past, (select min(lo) from wd where wd.job = pt.job and lo >= x) as next from pt
       where exists (select 1 from levels v where v.track = pt.job and v.i >= greatest(0, floor(l0 / 0.01::double + 1e-9)) and v.i < ceil(l1 / 0.01::double - 1e-9) and v.db >= -18)),
ql as (select pv.*, v.i, v.i - row_number() over (partition by job, id, side order by v.i) as run from pv join levels v on v.track = pv.job and v.i >= greatest(0, floor(w0 / 0.01::double + 1e-9)) and v.i < ceil(w1 / 0.01::double - 1e-9) where v.db < -18),
qr as (select job, id, side, x, past, next, {_HALF('greatest(any_value(w0), min(i) * 0.01::double)', 6)} as lo, {_HALF('least(any_value(w1), (max(i) + 1) * 0.01::double)', 6)} as hi from ql group by job, id, side, x, past, next, run),
qn as (select *, case when side < 0 then hi else lo end as near from qr where hi - lo >= 0.1::double - 1e-9),
qc as (select *, case when side < 0 then case when past is null then near else greatest(near, past + 0.02::double) end when next is null then near else least(near, next - 0.02::double) end as cand from qn),
qf as (select job, id, side, {_HALF('case when side < 0 then max(cand) else min(cand) end', 6)} as found from qc where abs(near - x) <= 0.6::double and case when side < 0 then cand < x else cand > x end group by job, id, side),
we as (select pv.job, pv.id, pv.side, pv.x, f.found, w.lo as wlo, w.hi as whi, case when before is null then w.lo - 0.15::double else greatest((before + w.lo) / 2, w.lo - 0.15::double) end as ahead,
              case when after is null then w.hi + 0.15::double else least((w.hi + after) / 2, w.hi + 0.15::double) end as behind
       from pv left join qf f on f.job = pv.job and f.id = pv.id and f.side = pv.side left join wl w on w.job = pv.job and w.lo < pv.x and pv.x < w.hi),
wk as (select *, 2 * (case when side < 0 then whi - x else x - wlo end) >= whi - wlo as keep, case when side < 0 then greatest(0.0::double, ahead) else behind end as wide, case when side < 0 then behind else ahead end as narrow from we),
wo as (select *, case when keep then wide else narrow end as one, case when keep then narrow else wide end as two from wk),
wm as (select *, case when found is not null then null when wlo is null then x when abs(one - x) <= 1 then {_HALF('one', 6)} when abs(two - x) <= 1 then {_HALF('two', 6)} end as moved from wo),
pl as (select job, id, side, coalesce(found, moved) as t, found is null and moved is not null and moved <> x as by from wm),
rw as (select cu.job, cu.id, a, b, coalesce(s.t, a) as lo, coalesce(e.t, b) as hi, (s.job is not null and s.t is null) or (e.job is not null and e.t is null) as lost, coalesce(s.by, false) as sby, coalesce(e.by, false) as eby
       from cu left join pl s on s.job = cu.job and s.id = cu.id and s.side = -1 left join pl e on e.job = cu.job and e.id = cu.id and e.side = 1),
rc as (select *, (sby or eby) and hi - lo < 0.3::double as closed from rw)
select job, id, {_HALF('case when closed and sby then a else lo end', 6)} as lo, {_HALF('case when closed and eby then b else hi end', 6)} as hi, case when lost or closed then 'borde_en_voz' end as note from rc""",
    "mark_numbers": """with o as (select o_orderkey as k, case o_orderkey % 5 when 0 then 'inf' when 1 then (o_orderkey % 900) || '.5' when 2 then '-3' when 3 then 'doce' else cast(o_orderkey % 700 as varchar) end as text,
case o_orderkey % 5 when 1 then o_orderkey % 900 + 0.5::double when 4 then (o_orderkey % 700)::double end as x from orders) select k as job, text, case when x <= k % 600 then x end as seconds from o""",
    "session_stream": """with g as (select user_id, ts, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap, event_id from events),
s as (select *, sum(case when gap is null or gap > 3600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from g),
c as (select user_id, k, count(*) as n from s group by all) select user_id, cast(count(*) as bigint) as sessions, cast(sum(n) as bigint) as events, cast(max(n) as bigint) as longest from c group by user_id""",
}
