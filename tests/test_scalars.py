import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chronoframe.functions import scalars as S


def column(spark, values, expression, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_clock(spark):
    assert column(spark, [0.0, 5.72, 24.36, 1005.0, 3727.0], S.clock) == ["0:00", "0:05", "0:24", "16:45", "1:02:07"]


def test_stamp(spark):
    assert column(spark, [0.0, 62.25, 3727.0014], S.stamp) == ["00:00:00.000", "00:01:02.250", "01:02:07.001"]


def test_snap(spark):
    rows = spark.createDataFrame([(1.234, 0.04, 0.0), (1.219, 0.04, 0.0), (1.2, 0.04, 0.032), (1.0, 1001 / 30000, 0.0)], "t double, i double, o double")
    assert [r[0] for r in rows.select(S.snap(F.col("t"), F.col("i"), F.col("o"))).collect()] == pytest.approx([1.24, 1.2, 1.192, 1.001])


def test_frames_and_samples(spark):
    rows = spark.createDataFrame([(7.16, 25.0, 1.25, 48000.0), (0.5, 25.0, 1.0, 48000.0)], "l double, f double, v double, r double")
    frames = S.frames_for(F.col("l"), F.col("f"), F.col("v"))
    assert [tuple(r) for r in rows.select(frames, S.samples_for(frames, F.col("f"), F.col("r"))).collect()] == [(143, 274560), (13, 24960)]
    assert column(spark, [200, 1, 2, 3], lambda x: S.samples_for(x, 30000 / 1001, 48000), "long") == [320320, 1602, 3203, 4805]


def test_frame_count(spark):
    rows = spark.createDataFrame([(51.36, 51.60, 0.04), (8.02, 32.02, 0.04), (0.0, 600.0, 15.0), (5.9, 5.99, 0.07), (0.0, 1e-6, 1e4)], "a double, b double, s double")
    assert [r[0] for r in rows.select(S.frame_count(F.col("a"), F.col("b"), F.col("s"))).collect()] == [6, 600, 40, 2, 1]


def test_targets(spark):
    good = {"10%": 360, "10 por ciento": 360, "720s": 720, "12 min": 720, "0:12:00": 720, "12:00": 720, "1,5 min": 90, "0.5h": 1800}
    bad = ["12", "mucho", "1:2:3", "0%", "100%", "120%", "2h", "3600s", "0:00:00"]
    found = column(spark, [*good, *bad], lambda x: S.parse_target(x, F.lit(3600.0)), "string")
    assert found == [*map(float, good.values()), *[None] * len(bad)]
    assert column(spark, ["179.9996s"], lambda x: S.parse_target(x, F.lit(180.0)), "string") == [None]


def test_tolerance(spark):
    assert column(spark, [720.0, 200.0, 100.0, 240.0, None], S.tolerance) == [36, 10, 10, 12, None]


def test_texts(spark):
    assert column(spark, ["Año ATEX: ¿Qué diseñó Muñoz?", "ÑANDÚ ÜÖ"], S.strip_accents, "string") == ["Año ATEX: ¿Que diseño Muñoz?", "ÑANDU UO"]
    assert column(spark, ["  Straße\n ÁB "], S.normal, "string") == ["strasse ab"]
    assert column(spark, ["x" * 300, "x" * 301], S.ellipsis, "string") == ["x" * 300, "x" * 299 + "…"]
    assert column(spark, ["a|b\r\nc"], S.cell, "string") == ["a\\|b c"]
    assert column(spark, [12.345, 0.05], S.comma) == ["12,3", "0,1"]
    assert column(spark, [600.0], S.block_name) == ["b00600"]


def test_rates_and_tempo(spark):
    assert column(spark, ["25/1", "30000/1001", "0/0", "x", "1/0"], S.rate_of, "string") == [25.0, 30000 / 1001, None, None, None]
    assert column(spark, [1.0, 1.25], S.tempo_factors) == [[], [1.25]]
    two = column(spark, [2.5], S.tempo_factors)[0]
    assert len(two) == 2 and math.prod(two) == pytest.approx(2.5)


@settings(deadline=None, max_examples=10)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20))
def test_half_up(spark, values):
    assert column(spark, values, lambda x: S.half_up(x, 3)) == [math.floor(v * 1000 + 0.5) / 1000 for v in values]
