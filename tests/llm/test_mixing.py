import pytest
from pyspark.sql import functions as F

from chronoframe.llm import mixing


def level(sizes):
    """Targets by giving out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 10, "c": 1000, "d": 3, None: 50}, {"z": 7}, {"a": 0, "b": 0}, {"a": 0, "b": 9, "c": 1}])
def test_targets_agree_with_giving_out_the_excess(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(level(sizes))


def test_mix(spark):
    rows = [(i, "w " * (i % 90), f"s{i * i % 7}" if i % 11 else None, "x") for i in range(3000)] + [(5, None, "s1", "y"), (None, "a b", "s1", "y"), (6, "q " * 20000, "s2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    drawn = mixing.with_copies(docs).collect()
    assert len(drawn) == len(rows) and {r["copies"] for r in drawn} <= {0, 1, 2}
    by = {}
    for r in drawn:
        by.setdefault((r["row"]["source"], r["source_size"], r["target"]), []).append((r["size"], r["size"] * r["copies"]))
    for (_, _, target), sizes in by.items():
        # A source may miss its target by its largest document, of which only whole copies can be taken.
        assert abs(sum(taken for _, taken in sizes) - target) <= max(0.05 * target, max(size for size, _ in sizes))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in drawn)
    again = mixing.with_copies(docs.repartition(7)).collect()
    key = lambda r: (str(r["row"]), r["copies"])
    assert sorted(map(key, drawn)) == sorted(map(key, again))
    assert mixing.mix(docs.where("false")).count() == 0


def test_reruns_agree_where_ids_repeat(spark):
    rows = [(None if i % 3 else 7, "w " * (i % 20) + "x" * (i % 5), f"s{i % 2}", i % 4, {"a": i % 2}) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int, m map<string,int>")
    drawn = [sorted(str((r["row"], r["copies"])) for r in mixing.with_copies(d).collect()) for d in (docs, docs.repartition(5), docs.repartition(3, "other"), docs.orderBy(F.rand(3)))]
    assert drawn[0] == drawn[1] == drawn[2] == drawn[3]
    # The buckets of one id are as many as of different ones.
    assert docs.select(F.substring(mixing.place(F.col("doc_id"), F.col("text")), 1, 2).alias("d")).distinct().count() > 30


def test_no_step_crosses_more_integers_than_the_ceiling(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CEILING", 2.0)
    monkeypatch.setattr(mixing.F, "least", lambda copies, _: copies)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert mixing.with_copies(docs).agg(F.max("copies")).first()[0] == 2
