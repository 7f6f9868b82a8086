"""Queries on what is stored beside plans: level caches, labels, settings, parts to render, imported subtitles, second passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import scalars as S
from chronoframe.operators import gates, montage, transcript
from chronoframe.plans.signal_queries import _levels
from chronoframe.plans.text_queries import _PARTS_SQL, _T, _notes, _parts, _segments
from chronoframe.sources import bindings as B
from chronoframe.sources import storage


def level_cache(spark, sf_dir):
    """Series written as raw 32-bit floats and read back."""
    path = storage.fresh_path(spark, "level-cache")
    storage.pack_levels(_levels(spark, sf_dir), ["track"]).write.parquet(path)
    found = storage.unpack_levels(spark.read.parquet(path), ["track"])
    return found.select("track", "i", S.half_up(F.col("db").cast("double"), 2).alias("db"))


def stored_digests(spark, sf_dir):
    """Digests of bodies that carry a digest themselves, which does not count."""
    body = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.md5(F.encode("c_name", "UTF-8")).alias("sha256"))
    rows = B.table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))
    return rows.select(F.col("c_custkey").alias("id"), montage.digest(F.to_json(F.col("body").dropFields("sha256"))).alias("digest"))


def merged_settings(spark, sf_dir):
    usual = F.create_map(*[F.lit(x) for pair in (("speed", "1.25"), ("pauses", "si"), ("silence", "-50")) for x in pair])
    key = F.col("p_partkey")
    own = F.map_filter(F.create_map(F.lit("speed"), F.when(key % 3 == 0, "1.5"), F.lit("target"), F.when(key % 4 == 0, F.concat(key % 50, F.lit("%")))), lambda k, v: v.isNotNull())
    rows = B.table(spark, sf_dir, "part").select(key.alias("id"), F.explode(gates.merged_settings(usual, own)).alias("name", "value"))
    return rows


def label_map(spark, sf_dir):
    """Labels read from JSON objects by the cut's id."""
    key = F.col("o_orderkey")
    text = F.format_string('{"1": "uno %d", "2": "dos", "%d": "x"}', key, key % 5 + 3)
    rows = B.table(spark, sf_dir, "orders").select(key.alias("job"), F.from_json(text, "map<string,string>").alias("labels"))
    return rows.select("job", F.explode("labels").alias("id", "label"))


def parts_to_render(spark, sf_dir):
    """The parts that no cached one stands for, as they are named while they are waited for."""
    todo = montage.cached(_parts(spark, sf_dir), _notes(spark, sf_dir)).where("not hit")
    return todo.select("job", "id", S.part_label(F.col("id"), F.lit(0), F.lit(1)).alias("label"), gates.complete(F.array(F.lit("frames"), F.lit("samples"), F.when(F.col("id") % 3 > 0, "spans")), ("spans", "frames", "samples")).alias("complete"))


def shared_cuts(spark, sf_dir):
    """Of each pair of versions the cuts that both have."""
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("id"), "l_returnflag", "l_linestatus")
    both = lines.where("l_returnflag = 'A'").select("job", "id").intersect(lines.where("l_linestatus = 'F'").select("job", "id"))
    return both


def probe_json(spark, sf_dir):
    rows = B.table(spark, sf_dir, "supplier")
    shown = F.to_json(F.struct(F.col("s_suppkey").alias("index"), F.col("s_name").alias("codec_type"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).alias("rate")), {"ignoreNullFields": "false"})
    return rows.select(F.col("s_suppkey").alias("job"), shown.alias("json"))


def published_texts(spark, sf_dir):
    """Documents published once as files, and read back."""
    folder = storage.fresh_path(spark, "texts")
    rows = B.table(spark, sf_dir, "region")
    path = storage.publish_texts(rows.select(F.concat(F.lit("# "), "r_name").alias("value")), folder, storage.next_version(spark, folder))
    lines = storage.read_texts(spark, path).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''").select(F.regexp_replace("line", "^# ", "").alias("name"))


def imported_subtitles(spark, sf_dir):
    """Subtitles made a transcript: numbered segments, and whether words have no times of their own."""
    segments = _segments(spark, sf_dir)
    cue = F.concat(S.stamp(F.col("lo")), F.lit(" --> "), S.stamp(F.col("hi")), F.lit("\n"), F.col("text"), F.lit("\n"))
    files = segments.groupBy("job").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", cue.alias("cue")))), lambda x: x["cue"]), "\n")).alias("text"))
    found = transcript.recovered(transcript.subtitles(files), transcript.subtitles(files.where("false")))
    return found.select("job", "seg", "text", F.lit("sin_marcas_por_palabra").alias("warning"))


def recovered_segments(spark, sf_dir):
    """What a second pass found joined with the first one's segments in one order."""
    segments = _segments(spark, sf_dir)
    first, second = segments.where("seg % 5 <> 2"), segments.where("seg % 5 = 2")
    return transcript.recovered(first, second).select("job", "seg", "recovered", F.length("text").alias("chars"))


def frozen_language(spark, sf_dir):
    """The first block that knows the language decides it for the job."""
    rows = _segments(spark, sf_dir).select("job", F.col("seg").alias("block"), F.when((F.col("seg") + F.col("job")) % 3 > 0, F.concat(F.lit("l"), F.col("seg") % 4)).alias("language"))
    return transcript.frozen(rows, "language").select("job", "block", F.col("frozen").alias("language"))


QUERIES = {f.__name__: f for f in (
    level_cache, stored_digests, merged_settings, label_map, parts_to_render, shared_cuts, probe_json, published_texts, imported_subtitles, recovered_segments, frozen_language,
)}

ORACLES = {
    "level_cache": "with " + B.LEVELS_SQL + " select track, i, floor(db::float::double * 100.0::double + 0.5::double) / 100.0::double as db from levels",
    "stored_digests": """select c_custkey as id, sha256('{"id":' || c_custkey || ',"name":"' || c_name || '"}') as digest from customer""",
    "merged_settings": """with p as (select p_partkey as id from part)
select id, 'speed' as name, case when id % 3 = 0 then '1.5' else '1.25' end as value from p union all select id, 'pauses', 'si' from p union all select id, 'silence', '-50' from p union all select id, 'target', (id % 50) || '%' from p where id % 4 = 0""",
    "label_map": """select o_orderkey as job, '1' as id, 'uno ' || o_orderkey as label from orders union all select o_orderkey, '2', 'dos' from orders union all select o_orderkey, cast(o_orderkey % 5 + 3 as varchar), 'x' from orders""",
    "parts_to_render": _PARTS_SQL + " select job, id, 'corte ' || id || ' subcorte 1/1' as label, id % 3 > 0 as complete from hit where not hit",
    "shared_cuts": "select l_orderkey as job, l_linenumber::bigint as id from lineitem where l_returnflag = 'A' intersect select l_orderkey, l_linenumber::bigint from lineitem where l_linestatus = 'F'",
    "probe_json": """select s_suppkey as job, '{"index":' || s_suppkey || ',"codec_type":"' || s_name || '","rate":' || coalesce(case when s_nationkey % 2 = 0 then cast(s_nationkey as varchar) end, 'null') || '}' as json from supplier""",
    "published_texts": "select r_name as name from region",
    "imported_subtitles": _T + """ select job, row_number() over (partition by job order by floor(lo * 1000 + 0.5::double), floor(hi * 1000 + 0.5::double)) - 1 as seg,
array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') as text, 'sin_marcas_por_palabra' as warning from segments where trim(text) <> '' and hi > lo""",
    "recovered_segments": _T + " select job, row_number() over (partition by job order by lo, hi, seg % 5 = 2) - 1 as seg, seg % 5 = 2 as recovered, length(text)::int as chars from segments",
    "frozen_language": _T + """, b as (select job, seg as block, case when (seg + job) % 3 > 0 then 'l' || seg % 4 end as language from segments)
select job, block, (select arg_min(language, c.block) from b c where c.job = b.job and c.language is not null) as language from b""",
}
