"""Runs in two levels, and thinning by successor jumps, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import intervals, postprocess, scans, signals, structure


def thin_out(times, window):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= window:
            kept.append(t)
    return kept


@pytest.mark.parametrize("before", [False, True])
def test_running_values_equal_a_walk(spark, before):
    rnd = random.Random(2)
    rows = [(k, rnd.randint(-50, 400), i, rnd.choice([None, rnd.randint(-9, 9)])) for k in ("a", "b", None) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long").repartition(4)
    got = scans.running(df, ["k"], ["t", "i"], 7, {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "least": ("min", F.col("v")), "now": ("last", F.col("v"))}, before=before)
    want = []
    for k in ("a", "b", None):
        seen = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            now = seen + ([r[3]] if r[3] is not None else [])
            use = seen if before else now
            want.append((*r, sum(use) if use else None, max(use, default=None), min(use, default=None), use[-1] if use else None))
            seen = now
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_union_of_nested_and_touching_intervals_over_slices(spark):
    rnd = random.Random(3)
    rows = [(c, a := rnd.randint(-100, 2000), a + rnd.choice([0, 1, 5, 30, 700])) for c in (1, 2) for _ in range(120)]
    got = intervals.union(spark.createDataFrame(rows, "chan int, t0_us long, t1_us long"), ["chan"], 1, slice_us=50)
    for c in (1, 2):
        covered = {t for chan, a, b in rows if chan == c for t in range(a - 1, b + 1)}
        found = [(r.t0_us, r.t1_us) for r in got.where(f"chan = {c}").orderBy("t0_us").collect()]
        assert {t for a, b in found for t in range(a, b)} == covered and all(b < c for (_, b), (c, _) in zip(found, found[1:]))


def test_merging_equals_a_walk(spark):
    rnd = random.Random(4)
    times = sorted(rnd.sample(range(4000), 300))
    df = spark.createDataFrame([("r", "d", 1, t) for t in times], "run_id string, detector string, chan int, t_us long")
    chains = []
    for t in times:
        if not chains or t - chains[-1][-1] >= 9:
            chains.append([])
        chains[-1].append(t)
    assert sorted((r.t_us, r.merged) for r in postprocess.merge_close(df, 9).collect()) == [(c[0], len(c)) for c in chains]


@pytest.mark.parametrize("seed", range(4))
def test_thinning_equals_a_walk(spark, seed):
    rnd = random.Random(seed)
    trains = {("r", c): [rnd.randint(-200, 200 * 10 ** (c % 3)) for _ in range(rnd.choice([1, 40, 400]))] for c in range(5)} | {(None, 9): [5, 5, 6, 30]}
    rows = [(r, c, t, rnd.randint(0, 9), "x") for (r, c), times in trains.items() for t in times]
    got = structure.collapsed(spark.createDataFrame(rows, "run_id string, chan int, t_us long, gap_us long, name string").repartition(3), ["run_id", "chan"], 10, windows=rnd.choice([1, 3, 50]))
    found = {}
    for r in got.collect():
        found.setdefault((r.run_id, r.chan), []).append(r.t_us)
        assert r.gap_us == min(g for a, b, t, g, _ in rows if (a, b, t) == (r.run_id, r.chan, r.t_us))
    assert {k: sorted(v) for k, v in found.items()} == {k: thin_out(v, 10) for k, v in trains.items()}


def test_one_channel_of_seeds_uses_several_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("chan"), (F.col("id") * 7).alias("t_us"))
    got = structure.collapsed(df, ["chan"], 20, windows=256)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got.groupBy(F.spark_partition_id()).count().count() > 1 and got.count() == -(-200_000 // 3)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_backgrounds_in_slices_equal_those_over_the_channel(spark, monkeypatch):
    rnd = random.Random(6)
    df = spark.createDataFrame([(c, i * 3, rnd.choice([None, rnd.lognormvariate(0, 1)])) for c in (1, 2) for i in range(300)], "chan int, at long, x double")
    whole = {(r.chan, r.at): r for r in signals.lognormal_background(df, ["chan"], "at", "x", 5, 9, 2.0, 0.5).collect()}
    monkeypatch.setattr(signals, "SLICE_ROWS", 8)
    monkeypatch.setattr(signals, "SLICE_PLACES", 40)
    parts = signals.lognormal_background(df, ["chan"], "at", "x", 5, 9, 2.0, 0.5).collect()
    assert len(parts) == 600 == len(whole)
    for r in parts:
        for name in ("mode", "median", "mean", "threshold"):
            assert r[name] == pytest.approx(whole[r.chan, r.at][name], rel=1e-9)


def test_intervals_of_any_length_hold_what_a_walk_says(spark):
    rnd = random.Random(11)
    cuts = sorted(rnd.sample(range(100_000), 60))
    spans = [("a", x, y, k) for k, (x, y) in enumerate(zip(cuts[::2], cuts[1::2]))] + [("b", 0, 90_000, 100), ("c", 5, 5, 101)]
    spans += [("a", x, x + 1, 200 + k) for k, x in enumerate(range(200_000, 200_050, 2))]
    events = [(i, rnd.choice("abcd"), rnd.choice([rnd.randrange(100_000), 200_000 + rnd.randrange(60), *cuts])) for i in range(500)] + [(500, "a", None)]
    I_, E = spark.createDataFrame(spans, "k string, t0_us long, t1_us long, name long"), spark.createDataFrame(events, "id long, k string, t_us long").repartition(5)
    of = {i: next((n for key, x, y, n in spans if t is not None and key == k and x <= t < y), None) for i, k, t in events}
    for slice_us in (7, 1_000, 10**9):
        got = {r.id: r.name for r in intervals.carried(E, I_, ["k"], "left", slice_us).collect()}
        assert got == of
    for how, keep in (("inner", True), ("left_semi", True), ("left_anti", False)):
        got = sorted(r.id for r in intervals.within(E, I_, ["k"], None, how).collect())
        assert got == sorted(i for i, n in of.items() if (n is not None) == keep), how
    assert intervals.within(E, I_.where("false"), ["k"], None, "left_anti").count() == 501


def test_the_clock_of_a_condition_stands_still_between_segments(spark):
    segments = spark.createDataFrame([("r", 10, 20), ("r", 50, 55), ("s", 0, 7)], "k string, t0_us long, t1_us long")
    events = spark.createDataFrame([("r", 10), ("r", 20), ("r", 52), ("s", 6), ("s", 7), ("q", 1)], "k string, t_us long")
    got = sorted(tuple(r) for r in intervals.on_clock(events, segments, ["k"], 10).collect())
    assert got == [("r", 10, 0, 15), ("r", 52, 12, 15), ("s", 6, 6, 7)]
