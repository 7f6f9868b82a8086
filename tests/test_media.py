import json

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import edges, media
from tests.test_operators import tone


def probe(video_start="0", container="0", **more):
    video = {"index": 0, "codec_type": "video", "r_frame_rate": "25/1", "avg_frame_rate": "25/1", "start_time": video_start, "tags": {"DURATION-eng": "00:01:02.5"}}
    sound = {"index": 1, "codec_type": "audio", "sample_rate": "48000", "duration": "59"}
    return {"format": {"duration": "60.0", "start_time": container, "format_name": "mov,mp4"}, "streams": [video, sound], "audio_stream": 1} | more


def read(spark, *documents):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "n int, j string")
    return rows.select("n", F.from_json("j", media.PROBE).alias("p")).select("n", "p.*")


def test_origins(spark):
    found = media.timeline(read(spark, probe("0.032"), probe("0.1"), probe("1.032", "1.0"), probe("-1"))).orderBy("n").collect()
    assert [r["origin"] for r in found] == pytest.approx([0.032, 0.02, 0.032, 0.0])
    assert all((r["kind"], r["fps"], r["interval"], r["sample_rate"]) == ("video", 25.0, 0.04, 48000) for r in found)


def test_cover_art_is_no_picture(spark):
    cover = probe()
    cover["streams"][0]["disposition"] = {"attached_pic": 1}
    found = media.timeline(read(spark, cover, probe(streams=[]))).orderBy("n").collect()
    assert [(r["kind"], r["rate"], r["interval"]) for r in found] == [("audio", None, None), (None, None, None)]


def test_lengths(spark):
    odd = probe(format={"duration": "inf", "start_time": "nan", "format_name": "mpegts"})
    rows = read(spark, probe(), odd).select("n", media.duration().alias("d"), media.start().alias("s"), media.seek_margin().alias("m"), media.stream_duration(F.col("streams")[0]).alias("v"), media.stream_end(F.col("streams")[1]).alias("e"))
    assert [tuple(r)[1:] for r in rows.orderBy("n").collect()] == [(60.0, 0.0, 3.0, 60.0, 59.0), (None, 0.0, 10.0, 62.5, 59.0)]


def test_packets(spark):
    rows = [("a", str(x), 0.04) for x in (0.0, 0.04, 0.08, 0.2, 0.24)] + [("a", "N/A", 0.04)]
    assert tuple(media.packet_gaps(spark.createDataFrame(rows, "job string, stamp string, interval double")).first()) == ("a", 5, 1, 0.12)


@pytest.mark.parametrize("a, b, want", [(2.0, 2.5, (1.5, 3.0, None)), (1.2, 1.3, (1.2, 1.3, None)), (4.0, 4.5, (3.6, 4.5, edges.NOTE))])
def test_edges_go_to_silences(spark, a, b, want):
    cuts = spark.createDataFrame([("t", 1, a, b)], "job string, id int, a double, b double")
    words = spark.createDataFrame([], "job string, lo double, hi double")
    r = edges.adjust_edges(cuts, tone(spark), words).first()
    assert (r["lo"], r["hi"], r["note"]) == want


@pytest.mark.parametrize("a, b, worded, want", [(1.7, 5.6, True, (1.5, 5.4, None)), (1.9, 5.8, True, (2.15, 6.05, None)), (1.5, 5.4, True, (1.5, 5.4, None)), (1.5, 5.4, False, (1.5, 5.4, edges.NOTE))])
def test_edges_go_between_words(spark, a, b, worded, want):
    levels = spark.createDataFrame([("t", i, -30.0) for i in range(1000)], "job string, i long, db double")
    words = spark.createDataFrame([("t", 1.0, 1.4), ("t", 1.6, 2.0), ("t", 2.3, 3.0), ("t", 5.0, 5.3), ("t", 5.5, 5.9), ("t", 6.2, 7.0)] if worded else [], "job string, lo double, hi double")
    r = edges.adjust_edges(spark.createDataFrame([("t", 1, a, b)], "job string, id int, a double, b double"), levels, words).first()
    assert (r["lo"], r["hi"], r["note"]) == want
