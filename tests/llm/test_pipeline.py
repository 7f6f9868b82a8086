import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoframe.llm import decontaminate, near_dedup

SF = "/root/testdata/sf0.01"


def test_each_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, unequal, unlike, clean, mixed = corpus_pipeline.STAGES
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = good[1](spark, docs, SF).cache()
    kept = one.join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in kept}[1] >= 330 and {r["quality"]: r["count"] for r in kept}.get(0, 0) <= 10
    two = unequal[1](spark, one, SF).cache()
    texts = one.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")).distinct().count()
    assert two.count() == texts
    three = unlike[1](spark, two, SF).cache()
    assert three.count() == near_dedup.classes(two).select("class_id").distinct().count()
    four = clean[1](spark, three, SF).cache()
    hits = decontaminate.hits(three, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert four.count() == hits.where("not contaminated").count()
    five = mixed[1](spark, four, SF)
    assert five.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert all(df.columns == docs.columns for df in (one, two, three, four, five))


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 900 and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (3, "word " * 20000, "en", "s", 5), (4, "Said so, well and good.", None, "s", 7)]
    docs = spark.createDataFrame([(*r, "c", "m") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string, mark string")
    found = stage(spark, docs, SF)
    assert found.columns == docs.columns and found.count() <= 2 * len(rows)
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_a_failed_run_leaves_no_tables(spark, monkeypatch):
    import os

    from chronoframe.llm import common

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))

    def fails(spark, docs, sf_dir):
        raise RuntimeError("midway")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[1], ("last", fails)])
    with pytest.raises(RuntimeError, match="midway"):
        corpus_pipeline.run(spark, SF)
    assert set(os.listdir(folder)) == before
    kept = common.written(spark.range(3), "kept")
    with common.tables_of_a_run(spark):
        common.written(spark.range(3), "own")
        common.release(spark, [])
    assert kept.count() == 3 and not [n for n in os.listdir(folder) if n.startswith("own-")]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from chronoframe.llm import common
    from chronoframe.sources import storage

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    for folder in (common.shared_dir, storage.shared_folder):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            folder(cluster)


def test_the_driver_returns_what_it_freed(spark, monkeypatch):
    import re

    from chronoframe.llm import common

    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def held():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024

    common.written(spark.range(3), "warm")
    small = [jvm.java.util.zip.Deflater() for _ in range(3000)]  # some 256 kB of native memory each
    for one in small[:-1]:
        one.end()
    before = held()
    common.written(spark.range(3), "freed")
    assert held() < before - 50
    begun = []
    monkeypatch.setattr(common, "give_back", lambda spark, collect=False: begun.append(collect))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        begun.append("stage")
        stage(spark, docs, SF)
    assert all(begun[i + 1 : i + 2] == [True] for i, x in enumerate(begun) if x == "stage")
