import random

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import intervals, montage, placement, planner, signal, transcript
from chronoframe.plans import catalogue

PAUSES = [(1.0, 1.5), (3.0, 3.6)]


def tone(spark, seconds=6, pauses=PAUSES):
    rows = [("t", i, -120.0 if any(a <= i / 100 + 1e-9 and i / 100 + 1e-9 < b for a, b in pauses) else -15.19) for i in range(seconds * 100)]
    return spark.createDataFrame(rows, "job string, i long, db double")


def spans(df, *columns):
    return sorted(tuple(round(r[c], 6) for c in columns) for r in df.collect())


def test_levels_of_samples(spark):
    rows = [("t", n, 8000 if n % 2 else -8000) for n in range(320)] + [("t", n, 0) for n in range(320, 500)]
    found = signal.levels_of(spark.createDataFrame(rows, "job string, n long, x int"), ["job"], 160).orderBy("i").collect()
    assert [round(r["db"], 2) for r in found] == [-12.25, -12.25, -120.0]


def test_silences(spark):
    levels = tone(spark)
    assert spans(signal.silences(levels, ["job"]), "lo", "hi") == PAUSES
    assert spans(signal.silences(levels, ["job"], least=0.55), "lo", "hi") == [(3.0, 3.6)]
    assert spans(signal.silences(levels, ["job"], threshold=-10.0), "lo", "hi") == [(0.0, 6.0)]


@pytest.mark.parametrize("a, b, pauses, options, want", [
    (0.5, 4.0, PAUSES, {}, [(0.52, 1.08), (1.44, 3.08), (3.52, 4.0)]),
    (0.95, 3.7, PAUSES, {}, [(1.44, 3.08)]),
    (1.1, 1.4, PAUSES, {}, []),
    (0.0, 6.0, [(1, 1.4), (1.5, 1.9), (4, 4.5)], {"interval": 0.01, "margin": 0.0}, [(0, 1), (1.9, 4), (4.5, 6)]),
    (0.0, 6.0, PAUSES, {"interval": 1.5, "margin": 0.0}, [(0.0, 6.0)]),
    (0.0, 6.0, PAUSES, {"margin": 0.0}, [(0.0, 1.0), (1.52, 3.0), (3.6, 6.0)]),
])
def test_islands(spark, a, b, pauses, options, want):
    quiet = signal.silences(tone(spark, pauses=pauses), ["job"])
    windows = spark.createDataFrame([("t", 1, a, b)], "job string, cut int, a double, b double")
    assert spans(intervals.islands(windows, quiet, ["job"], **{"interval": 0.04, **options}, width=2.0), "lo", "hi") == want


def test_blocks_fall_on_quiet_windows(spark):
    rows = [("t", i, -70.0 if any(s <= i < s + 10 for s in (5900, 11800, 17800)) else -20.0) for i in range(20000)]
    levels = spark.createDataFrame(rows, "job string, i long, db double")
    # A tenth of the scale of the real thing: blocks of 600 with 60 to spare, in levels of a tenth of a second.
    found = signal.speech_blocks(levels, ["job"], 6000, 600, 3, 0.1).orderBy("block").collect()
    assert [round(r["hi"], 2) for r in found] == [590.15, 1180.15, 1780.15, 2000.0]


def test_gaps_with_sound(spark):
    levels = spark.createDataFrame([("t", i, -30.0 if 200 <= i < 260 else -70.0) for i in range(300)], "job string, i long, db double")
    frames = spark.createDataFrame([("t", 0.0, 300.0)], "job string, a double, b double")
    run = lambda parts: spans(signal.uncovered(spark.createDataFrame([("t", *map(float, p)) for p in parts], "job string, lo double, hi double"), frames, levels, ["job"], threshold=-50.0, least=2.0, step=1.0, width=50.0), "lo", "hi")
    assert run([(0, 100), (150, 200), (260, 300)]) == [(200.0, 260.0)]
    assert run([(0, 300)]) == [] and run([]) == [(0.0, 300.0)]


def test_joins_agree_with_loops(spark):
    rng = random.Random(9)
    one = [("j", i, a := rng.uniform(0, 100), a + rng.uniform(0, 30)) for i in range(60)]
    two = [("j", a := rng.uniform(0, 100), a + rng.uniform(0, 9)) for _ in range(60)]
    left, right = spark.createDataFrame(one, "job string, id int, lo double, hi double"), spark.createDataFrame(two, "job string, lo double, hi double")
    pairs = {(r["id"], r["rlo"]) for r in intervals.overlap_join(left, right, ["job"], 7.0).collect()}
    assert pairs == {(i, c) for _, i, a, b in one for _, c, d in two if a < d and c < b}
    assert intervals.overlap_join(left, right, ["job"], 7.0).count() == len(pairs)
    edges = spark.createDataFrame([("j", float(t)) for t in range(0, 130, 3)], "job string, t double")
    for forward in (False, True):
        for r in intervals.asof(edges, right, ["job"], "t", "hi", 5.0, forward).collect():
            near = [d for _, _, d in two if (0 <= d - r["t"] <= 5 if forward else 0 <= r["t"] - d <= 5)]
            assert r["nearest"] == ((min if forward else max)(near) if near else None)
    merged = spans(intervals.merge(right, ["job"]), "lo", "hi")
    covered = lambda x, parts: any(a <= x < b for a, b in parts)
    gaps = spark.createDataFrame([("j", 1, 10.0, 90.0)], "job string, gap int, lo double, hi double")
    left_over = spans(intervals.difference(gaps, right, ["job"], 20.0), "lo", "hi")
    for k in range(1000):
        x = 10 + k * 0.08 + 0.0123
        assert covered(x, merged) == covered(x, [(c, d) for _, c, d in two])
        assert covered(x, left_over) != covered(x, merged)


def test_chunks_give_the_last_part_what_is_left(spark):
    rows = [("c", i * 2.0, i * 2.0 + 0.7 + (i % 3) * 0.1) for i in range(49)]
    pieces = spark.createDataFrame(rows, "job string, lo double, hi double")
    frames = int(sum(b - a for _, a, b in rows) * 25 / 1.25 + 0.5)
    totals = spark.createDataFrame([("c", frames, frames * 1920)], "job string, frames long, samples long")
    parts = intervals.chunks(pieces, ["job"], totals, 25.0, 1.25, 48000.0).orderBy("part").collect()
    assert [p["n_spans"] for p in parts] == [40, 9] and sum(p["frames"] for p in parts) == frames and sum(p["samples"] for p in parts) == frames * 1920


def test_envelopes(spark):
    shape = [-60.0] * 6 + [-10.0] * 20 + [-60.0] * 6
    series = lambda shift: spark.createDataFrame([("t", i, shape[i - shift] if 0 <= i - shift < 32 else -60.0) for i in range(32)], "job string, i long, db double")
    lag = lambda p, r: signal.align(series(p), series(r), ["job"]).first()["lag"]
    assert [lag(0, 0), lag(3, 0), lag(0, 3), lag(5, 0)] == [0, 3, -3, 5]
    ramp = spark.createDataFrame([("t", i, float(i)) for i in range(10)], "job string, i long, db double")
    found = {r["i"]: r["db"] for r in signal.stretched(ramp, ["job"], 1.25, 8).collect()}
    assert (found[4], found[1]) == (5.0, 1.25)
    assert {r["i"]: r["db"] for r in signal.stretched(ramp, ["job"], 4.0, 4).collect()}[3] == 9.0
    assert signal.spread(ramp, ["job"]).first()["spread"] == pytest.approx(2.8722813)


SRT = "﻿1\r\n00:00:01,000 --> 00:00:04,5\r\n<i>Hola</i>\r\nque tal\r\n\r\n2\r\n01:02.25 --> 01:05.0\r\n{\\an8}Uno\r\n3\r\n00:02:00,000 --> 00:01:00,000\r\nback\r\n"


def test_subtitles(spark):
    found = transcript.subtitles(spark.createDataFrame([("f", SRT)], "job string, text string")).orderBy("lo").collect()
    assert [(r["lo"], r["hi"], r["text"]) for r in found] == [(1.0, 4.5, "Hola que tal"), (62.25, 65.0, "Uno")]


def test_word_edges(spark):
    words = spark.createDataFrame([("a", 0.0, 3.0)], "job string, lo double, hi double")
    edges = spark.createDataFrame([("a", 1.5, 1), ("a", 2.5, 1), ("a", 3.5, 1)], "job string, edge double, side int")
    assert {r["edge"]: r["moved"] for r in transcript.word_edges(edges, words).collect()} == {1.5: None, 2.5: 3.15, 3.5: 3.5}


def test_search(spark):
    rows = [("a", 0, "Atmósfera ATEX y más"), ("a", 1, "aaaa Diseñó"), ("a", 2, "nada")]
    segments = spark.createDataFrame(rows, "job string, seg long, text string")
    places = lambda q: sorted((r["seg"], r["at"]) for r in transcript.hits(segments, F.lit(q)).collect())
    assert places("atex") == [(0, 10)] and places("ATMOSFERA") == [(0, 0)] and places("aa") == [(1, 0), (1, 2)] and places("diseno") == [] and places(" ") == []
    assert transcript.context(segments).where("seg = 1").first()["context"] == "Atmósfera ATEX y más aaaa Diseñó nada"


def test_coverage(spark):
    words = spark.createDataFrame([("a", 0, w, t, lo, hi) for w, (t, lo, hi) in enumerate([("uno", 3.0, 3.5), ("exige", 4.9, 5.6), ("dos", 5.6, 6.0), ("no", 9.2, 9.5)])], "job string, seg long, w long, text string, lo double, hi double")
    cuts = spark.createDataFrame([("a", 1, 3.0, 9.0, [(3.0, 5.0), (5.5, 9.0)]), ("a", 2, 9.0, 10.0, [(9.3, 10.0)]), ("a", 3, 20.0, 21.0, [(20.0, 21.0)])], "job string, id int, lo double, hi double, spans array<struct<lo:double,hi:double>>")
    found = transcript.coverage(cuts, words)
    assert sorted((r["id"], r["words"], r["covered"], r["share"], r["lost"]) for r in found.collect()) == [(1, 3, 2, 0.667, ["exige"]), (2, 1, 0, 0.0, ["no"]), (3, 0, 0, 1.0, [])]
    total = transcript.coverage_summary(found).first()
    assert (total["words"], total["covered"], total["mean"], total["least"], total["low"]) == (4, 2, 0.5, 0.0, True)


def test_output_at(spark):
    cuts = spark.createDataFrame([("p", 1, 10.0, 20.0, 160, [(10.0, 13.0), (15.0, 20.0)]), ("p", 2, 30.0, 36.0, 80, [(30.0, 34.0)])], "job string, id int, start double, end double, frames long, spans array<struct<lo:double,hi:double>>")
    placed = placement.placements(cuts, 25.0, 1.25)
    at = [10.0, 11.0, 13.0, 14.0, 15.0, 16.0, 20.0, 30.0, 34.0, 35.0, 36.0, 9.9, 25.0, 40.0]
    found = {r["t"]: r["out"] for r in placement.output_at(spark.createDataFrame([("p", t) for t in at], "job string, t double"), placed, 1.25).collect()}
    want = [0, 0.8, 2.4, 2.4, 2.4, 3.2, 6.4, 6.4, 9.6, 9.6, 9.6, None, None, None]
    assert [None if found[t] is None else round(found[t], 6) for t in at] == want


def test_exploded_instants_are_not_broadcast(spark):
    """Their estimated size is that of the rows they were exploded from; repeated ones and those without a job stay."""
    cuts = spark.createDataFrame([("p", 1, 10.0, 20.0, 160, [(10.0, 13.0), (15.0, 20.0)])], "job string, id int, start double, end double, frames long, spans array<struct<lo:double,hi:double>>")
    jobs = spark.createDataFrame([("p",), ("p",), (None,)], "job string")
    instants = jobs.select("job", F.explode(F.array(F.lit(11.0), F.lit(25.0))).alias("t"))
    out = placement.output_at(instants, placement.placements(cuts, 25.0, 1.25), 1.25)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("p", 11.0, 0.8)] * 2 + [("p", 25.0, None)] * 2 + [(None, 11.0, None), (None, 25.0, None)], key=repr)
    query = catalogue.QUERIES["output_time_map"](spark, "/root/testdata/sf0.001")
    assert query.count() > 0 and "Broadcast" not in query._jdf.queryExecution().executedPlan().toString()


BASE = [(1, 2, 10, 1, True, 7160), (2, 11, 18, 1, True, 6360), (3, 19, 26, 2, True, 5760), (4, 28, 33, 2, False, 4560), (5, 40, 47, 3, True, 5960), (6, 49, 55, 3, True, 5240)]


def plan(spark, target):
    rows = [(7, i, a * 1000, b * 1000, kept, p, inc, False, True, None) for i, a, b, p, inc, kept in BASE]
    cuts = spark.createDataFrame(rows, "job long, id long, start_ms long, end_ms long, kept_ms long, priority int, included boolean, pinned boolean, remove_pauses boolean, depends_on long")
    return cuts, spark.createDataFrame([(7, 60.0, target, 1.25)], "job long, total double, target double, speed double")


def test_estimate(spark):
    cuts, jobs = plan(spark, 24.0)
    r = planner.estimate(cuts, jobs).first()
    assert (r["cuts"], r["source"], r["after_pauses"], round(r["output"], 3), r["low"], r["high"], r["state"]) == (5, 35.0, 30.48, 24.36, 14.0, 34.0, "ok")
    assert (r["percent"], round(r["essentials"], 3), r["minimum"]) == (40.6, 10.8, 18.0)
    found = {(a["speed"], a["pauses"]): (a["output"], a["state"]) for a in planner.alternatives(cuts, jobs).collect()}
    assert found == {(1.0, True): (30.48, "ok"), (1.0, False): (35.0, "por_encima"), (1.25, True): (24.36, "ok"), (1.25, False): (28.0, "ok")}


@pytest.mark.parametrize("target, state", [(None, "sin_objetivo"), (24.0, "ok"), (12.0, "por_encima"), (40.0, "por_debajo"), (0.6, "inviable"), (55.0, "inalcanzable")])
def test_states(spark, target, state):
    assert planner.estimate(*plan(spark, target)).first()["state"] == state


def test_suggestions(spark):
    assert planner.suggest_drop(*plan(spark, 12.0)).first()["cuts"] == [5]
    assert planner.suggest_add(*plan(spark, 40.0)).first()["cuts"] == [4]
    r = planner.suggest_sacrifice(*plan(spark, 0.6)).first()
    assert (r["faster"], r["cuts"], r["minimum"]) == (1.3, [1], 18.0)


def test_fusion(spark):
    rows = [(7, 1, 2.0, 5.0), (7, 2, 5.0, 8.0), (7, 4, 34.0, 35.0), (7, 5, 35.04, 36.0), (7, 3, 40.0, 47.0)]
    cuts = spark.createDataFrame([(*r, True, 2 if r[1] == 1 else 1, False, t) for r, t in zip(rows, ["A", "A", "B", "", "C"])], "job long, id long, lo double, hi double, included boolean, priority int, pinned boolean, text string")
    found = {r["id"]: r for r in planner.fuse(cuts, 0.04).collect()}
    assert sorted(found) == [1, 3, 4, 5] and (found[1]["lo"], found[1]["hi"], found[1]["priority"], found[1]["absorbed"], found[1]["text"]) == (2.0, 8.0, 1, [2], "A")
    edges = spark.createDataFrame([(7, 2, 1), (7, 3, 2)], "job long, id long, depends_on long")
    assert [tuple(r) for r in planner.remap(edges, planner.fuse(cuts, 0.04)).collect()] == [(7, 3, 1)]


def test_violations(spark):
    rows = [(1, 0, 0, 10, 1, None, "t"), (1, 2, 5, 5, 4, 2, " "), (1, 2, 20, 30, 1, 9, "t")]
    draft = spark.createDataFrame(rows, "job long, id long, start_ms long, end_ms long, priority int, depends_on long, title string")
    found = {(r["id"], r["rule"]) for r in planner.violations(draft).collect()}
    assert found == {(0, "id"), (2, "empty"), (2, "priority"), (2, "title"), (2, "self"), (2, "order"), (2, "duplicate"), (2, "reference")}


def test_distances(spark):
    rows = spark.createDataFrame([([0] * 4, [255] * 4), ([128] * 4, [0] * 4), ([1], [1, 2])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(montage.image_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 128 / 255, None]


def test_cost(spark):
    parts = spark.createDataFrame([("j", f"k{i}", 100, 1) for i in range(3)], "job string, key string, frames long, samples long")
    notes = spark.createDataFrame([("j", "k0", 100, 1, 8.0, 8000), ("j", "x", 0, 1, 1.0, 1000), ("j", "k2", 99, 1, None, None)], "job string, key string, frames long, samples long, seconds double, seconds_ms long")
    r = montage.eta(parts, notes, ["job"]).first()
    assert (r["reused"], r["new"], r["eta"]) == (1, 2, 200 * 0.08 + 300 / 25 * 0.25)
