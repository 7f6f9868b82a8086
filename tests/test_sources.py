import json
import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chronoframe.operators import documents, placement
from chronoframe.sources import storage
from chronoframe.streaming import levels


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cut": 1, "frames": 5}, indent=1))
    (tmp_path / "b.json").write_text("{ not json")
    assert [r["cut"] for r in storage.read_json(spark, str(tmp_path / "a.json"), "cut int, frames int").collect()] == [1]
    assert storage.read_json(spark, str(tmp_path / "*.json"), "cut int, frames int", lenient=True).where("cut = 1").count() == 1
    with pytest.raises(Exception):
        storage.read_json(spark, str(tmp_path / "b.json"), "cut int").collect()


def test_texts_and_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s.srt").write_bytes("﻿1\nline".encode())
    assert storage.read_texts(spark, str(tmp_path / "x")).first()["text"] == "1\nline"
    files = storage.read_files(spark, str(tmp_path), deep=True)
    whole = storage.fingerprints(files).first()
    ends = storage.fingerprints(files, most=4, part=2).first()
    assert whole["size"] == 9 and whole["sha256"] != ends["sha256"]


def test_samples(spark, tmp_path):
    samples = [0, 5, -7, 32767] * 60_000
    (tmp_path / "a.wav").write_bytes(b"\0" * 44 + struct.pack(f"<{len(samples)}h", *samples) + b"\1")
    found = storage.pcm_samples(storage.read_files(spark, str(tmp_path)))
    assert found.count() == len(samples) and found.where("n = 200003").first()["x"] == samples[200003]


def test_versions_are_written_once(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/plans", spark.range(3)
    assert storage.next_version(spark, folder) == 1
    storage.publish(rows, folder, 1)
    assert storage.next_version(spark, folder) == 2
    with pytest.raises(AnalysisException):
        storage.publish(rows, folder, 1)
    log = f"{folder}-log"
    storage.append_log(rows.select(F.lit("a").alias("evento")), log)
    storage.append_log(rows.select(F.lit("b").alias("evento")), log)
    assert spark.read.json(log).count() == 6


def test_streams_agree_with_batches(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = levels.hourly(spark.read.parquet(path))
    stream = levels.run_available(levels.hourly(levels.event_stream(spark, path)), "hourly")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
    stream = levels.run_available(levels.sessions(levels.event_stream(spark, path)), "sessions")
    assert stream.count() == levels.sessions(spark.read.parquet(path)).count()


def test_marks(spark):
    cuts = spark.createDataFrame([("p", 1, 10.0, 20.0, 160, [(10.0, 13.0), (15.0, 20.0)]), ("p", 2, 30.0, 36.0, 80, [(30.0, 34.0)])], "job string, id int, start double, end double, frames long, spans array<struct<lo:double,hi:double>>")
    rows = spark.createDataFrame([("p", 1, "a [[t=11.0]] b [[r=30-34]]"), ("p", 2, "[[r=11-26]] [[t=25]]"), ("p", 3, "[[x=1]]")], "job string, n int, line string")
    found = {r["n"]: r["line"] for r in documents.expand_marks(rows, placement.placements(cuts, 25.0, 1.25), 1.25).collect()}
    assert found == {
        1: "a 0:11 (resumen 0:00) b 0:30–0:34 (resumen 0:06–0:09)",
        2: "0:11–0:26 (incluido en parte en el resumen) 0:25 (no incluido en el resumen)", 3: "[[x=1]]",
    }


def test_marks_round_before_they_truncate(spark):
    """At 14.5 the output is 9.999999999999998 in floating point, which is 10 seconds."""
    cuts = spark.createDataFrame([("p", 1, 0.0, 20.0, 400, [(0.0, 1.4), (3.4, 20.0)])], "job string, id int, start double, end double, frames long, spans array<struct<lo:double,hi:double>>")
    rows = spark.createDataFrame([("p", 1, "[[t=14.5]] [[r=0-14.5]]")], "job string, n int, line string")
    assert documents.expand_marks(rows, placement.placements(cuts, 25.0, 1.25), 1.25).first()["line"] == "0:14 (resumen 0:10) 0:00–0:14 (resumen 0:00–0:10)"


def test_bar(spark):
    cuts = spark.createDataFrame([(1, a, b, 60) for a, b in ((2, 10), (11, 18), (19, 26), (40, 47), (49, 55))], "job int, start int, end int, total int")
    assert placement.bar(cuts, 60, "#", "·").first()["bar"] == "··########·#######·#######··············#######··######·····"


def test_tree_digest_ignores_order(spark):
    rows = spark.createDataFrame([("t", f"f{i}", f"content {i}") for i in range(40)], "tree string, name string, content string")
    one = documents.tree_digest(rows, ["tree"]).first()
    assert one == documents.tree_digest(rows.repartition(5), ["tree"]).first() and one["files"] == 40
    assert one["digest"] != documents.tree_digest(rows.where("name <> 'f7'"), ["tree"]).first()["digest"]
