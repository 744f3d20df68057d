"""Rules that SQL cannot say, and plans for busy trains, against plain Python."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import dsp
from eventloom.functions import pvalues as T
from eventloom.operators import matching as M
from eventloom.operators import rates as R
from eventloom.operators import signals as G
from eventloom.operators import structure as S
from eventloom.plans import signals as Q
from eventloom.plans.fixtures import DAY, HOUR, Tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# matching


def greedy(a, b, tol):
    """Pairs by stepping along both sorted trains: on a hit both step, else the earlier one."""
    i = j = 0
    out = {}
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tol:
            out[i] = j
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("tol", [0, 5, 40])
def test_islands_of_busy_trains_match_as_a_walk_does(spark, monkeypatch, tol):
    monkeypatch.setattr(M, "SLICE_TOLERANCES", 3)
    rnd = random.Random(tol)
    trains = {c: [sorted(rnd.sample(range(6000), rnd.choice([0, 1, 60, 300]))) for _ in range(2)] for c in [None, *range(9)]}
    side = lambda k: spark.createDataFrame([(c, t) for c, v in trains.items() for t in v[k]], "chan int, t_us long")
    got = {(r.chan, r.side, r.t_us): r.partner for r in M.match(side(0), side(1), ["chan"], tol).collect()}
    assert len(got) == sum(len(x) for v in trains.values() for x in v)
    for c, (a, b) in trains.items():
        pairs = greedy(a, b, tol)
        back = {j: i for i, j in pairs.items()}
        assert all(got[c, 0, t] == (b[pairs[i]] if i in pairs else None) for i, t in enumerate(a))
        assert all(got[c, 1, t] == (a[back[j]] if j in back else None) for j, t in enumerate(b))


def test_near_any_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_TOLERANCES", 2)
    rnd = random.Random(2)
    a = [(rnd.randint(0, 3), rnd.randint(-500, 2000)) for _ in range(300)]
    b = [(rnd.randint(0, 3), rnd.randint(-500, 2000)) for _ in range(40)]
    got = sorted((r.chan, r.t_us, r.near) for r in M.near_any(spark.createDataFrame(a, "chan int, t_us long"), spark.createDataFrame(b, "chan int, t_us long"), ["chan"], 9).collect())
    assert got == sorted((c, t, any(c == d and abs(t - u) <= 9 for d, u in b)) for c, t in a)


def test_a_busy_channel_takes_seconds(spark):
    events = spark.range(300_000).select(F.lit(1).alias("chan"), (F.col("id") * 7).alias("t_us"))
    others = spark.range(300_000).select(F.lit(1).alias("chan"), (F.col("id") * 7 + 3).alias("t_us"))
    assert M.near_any(events, others, ["chan"], 3).where("near").count() == 300_000
    assert M.match(events, others, ["chan"], 3).where("partner is not null and side = 0").count() == 300_000


# backgrounds and signals


def test_background_equals_plain_windows(spark):
    rnd = np.random.default_rng(0)
    x = np.exp(rnd.normal(size=400))
    x[100:160] = 1.0
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "chan int, at long, x double")
    for r in G.lognormal_background(df, ["chan"], "at", "x", 5, 9, 2.0, 0.5).collect():
        part = np.log(x[max(r["at"] - 5, 0) : r["at"] + 10])
        m, v = part.mean(), part.var(ddof=1)
        mode, mean = math.exp(m - v), math.exp(m + v / 2)
        assert (r.mode, r.median, r.mean) == pytest.approx((mode, math.exp(m), mean), rel=1e-9)
        assert r.threshold == pytest.approx(2 * (mode + math.exp(m)) - 0.5 * (mean - mode), rel=1e-9)


def channels(spark):
    """{(rec_id, chan): samples by block} of the test tables."""
    out = {}
    for r in Q.blocks(Tables(spark, DATA)).collect():
        out.setdefault((r.rec_id, r.chan), {})[r.block] = np.array(r.samples, np.float64)
    return out


@needs_data
def test_detector_and_rhythm_windows_equal_plain_loops(spark):
    marks, windows = set(), set()
    for (rec, chan), days in channels(spark).items():
        for first in range(0, 30, 10):
            held = range(max(first - 3, 0), min(first + 13, 30))
            x = np.concatenate([days[d] for d in held])
            for i, *_, con in dsp.detect(x, Q.FS, **Q.ENVELOPE):
                t = held[0] * DAY + i * HOUR
                if first * DAY <= t < (first + 10) * DAY:
                    marks.add((rec, chan, t, con))
            for a in (0, 5):
                part = np.concatenate([days[first + a + k] for k in range(5)])
                if part.std() > 0 and Q.FS / 48 < dsp.rhythm_peak(part, Q.FS) < Q.FS / 12:
                    windows.add((rec, chan, (first + a) * DAY, (first + a + 5) * DAY))
    sure = {(m[0], m[2]) for m in marks if m[3] == 1}
    low = {m for m in marks if m[3] < 1}
    marks = {m for m in marks if m[3] == 1 or any((m[0], m[2] + k * HOUR) in sure for k in range(-2, 3))}
    assert low and low & marks and low - marks
    run = lambda name: Q.QUERIES[name](spark, DATA).collect()
    assert {(r.rec_id, r.chan, r.t_us, r.con) for r in run("d1_envelope")} == marks
    assert {(r.rec_id, r.chan, r.t0_us, r.t1_us) for r in run("d8_rhythm_mask")} == windows
    inside = lambda m: any(m[:2] == w[:2] and w[2] <= m[2] < w[3] for w in windows)
    assert {(r.rec_id, r.chan, r.t_us, r.con) for r in run("d8_suppressed")} == {m for m in marks if not inside(m)}


@needs_data
def test_filtered_blocks_show_no_edges(spark):
    want = {k: Q.filtered(np.concatenate([days[d] for d in range(30)]), Q.FS)[0] for k, days in channels(spark).items()}
    for r in Q.QUERIES["d2_d3_filtered"](spark, DATA).collect():
        y = want[r.rec_id, r.chan]
        assert len(r.samples) == 12 and r.fs == Q.FS / 2
        assert np.abs(np.array(r.samples) - y[r.block * 12 : r.block * 12 + 12]).max() <= 0.01 * max(np.abs(y).max(), 1)


@needs_data
def test_resampled_blocks_show_no_edges(spark):
    want = {k: dsp.resampled(np.concatenate([days[d] for d in range(30)]), Q.FS, Q.FS * 3 / 4)[0] for k, days in channels(spark).items()}
    for r in Q.QUERIES["d3_resampled"](spark, DATA).collect():
        y = want[r.rec_id, r.chan]
        assert len(r.samples) == 18 and r.fs == Q.FS * 3 / 4
        assert np.abs(np.array(r.samples) - y[r.block * 18 : r.block * 18 + 18]).max() <= 1e-3 * max(np.abs(y).max(), 1)


def test_resampling_equals_the_sum_over_taps():
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=50)
    for up, down in ((3, 4), (5, 2), (1, 3)):
        most = max(up, down)
        taps = [np.sinc(k / most) * np.kaiser(20 * most + 1, 5.0)[k + 10 * most] for k in range(-10 * most, 10 * most + 1)]
        y = dsp.resample(x, up, down)
        assert len(y) == -(-50 * up // down)
        for m in range(len(y)):
            want = sum(x[k] * up * taps[m * down - k * up + 10 * most] / sum(taps) for k in range(50) if abs(m * down - k * up) <= 10 * most)
            assert y[m] == pytest.approx(want, abs=1e-9)
    t = np.arange(4000) / 2000
    y, fs = dsp.resampled(np.sin(2 * np.pi * 7 * t), 2000, 150)
    assert fs == 150 and np.abs(y - np.sin(2 * np.pi * 7 * np.arange(len(y)) / 150))[15:-15].max() < 0.01


def test_a_missing_block_parts_a_signal(spark):
    rows = [(1, 1, b, b * 1_000_000, 100.0, [float(b)] * 100) for b in (0, 1, 3)]
    sig = spark.createDataFrame(rows, "rec_id int, chan int, block long, t0_us long, fs double, samples array<float>")
    seen = {r.block: r.samples for r in G.per_channel(sig, lambda x, fs: (np.full(len(x), len(x)), fs), 10, 2).collect()}
    assert seen[0][0] == seen[1][0] == 200 and seen[3][0] == 100


def test_spline_and_smoothing():
    rnd = np.random.default_rng(3)
    x = np.cumsum(rnd.uniform(0.5, 2, 12))
    cubic = lambda t: 0.3 * t**3 - 2 * t**2 + t - 5
    at = np.linspace(x[0], x[-1], 200)
    assert dsp.spline(x, cubic(x), at) == pytest.approx(cubic(at), abs=1e-7)  # it is one cubic throughout
    y = rnd.normal(size=12)
    assert dsp.spline(x, y, x) == pytest.approx(y, abs=1e-9)
    step = 1e-4
    for k in range(1, 11):  # value, slope and bend run on at the points
        side = lambda f: (f(x[k] - 3 * step), f(x[k] - 2 * step), f(x[k] - step), f(x[k]), f(x[k] + step), f(x[k] + 2 * step), f(x[k] + 3 * step))
        v = side(lambda t: dsp.spline(x, y, np.array([t]))[0])
        assert (v[0] - 2 * v[1] + v[2]) / step**2 == pytest.approx((v[4] - 2 * v[5] + v[6]) / step**2, abs=0.05)
    assert dsp.spline(x[:3], y[:3], x[:3]) == pytest.approx(y[:3]) and dsp.spline(x[:2], y[:2], x[:2]) == pytest.approx(y[:2])
    z = rnd.normal(size=60)
    want = [sum(z[i + d] * (4 - abs(d)) / 16 for d in range(-3, 4)) for i in range(5, 55)]
    assert dsp.smoothed(z, 4)[5:55] == pytest.approx(want)


# p-values


def test_signed_rank_p_equals_all_sign_patterns():
    for n in (1, 4, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in {min(sums), max(sums), n, n * (n + 1) // 2 - 1}:
            low = min(w, n * (n + 1) // 2 - w)
            assert T.wilcoxon_p(w, n) == pytest.approx(min(1.0, 2 * sum(s <= low for s in sums) / len(sums)))


def test_effects_and_correlations_carry_p(spark):
    rows = [("d", 2.0 + 0.1 * k, 1.0, 9) for k in range(7)] + [("d", 0.0, 1.0, 9), ("d", 9.0, 1.0, 2), ("e", 2.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "detector string, on_rate double, off_rate double, off_n long")
    got = {r.detector: r for r in R.with_effect_p(R.condition_effect(df, ["detector"])).collect()}
    assert got["d"].n == 8 and got["d"].n_zero == 1 and got["d"].n_down == 1 and got["d"].p == pytest.approx(2 / 2**7)
    assert got["e"].n == 1 and got["e"].p is None
    found = spark.createDataFrame([(10, 0.5), (2, 1.0), (5, 1.0), (9, None)], "n long, rho double")
    p = {(r.n, r.rho): r.p for r in R.with_correlation_p(found).collect()}
    t = 0.5 * math.sqrt(8 / 0.75)
    grid = np.linspace(t, 4000, 4_000_001)
    tail = np.trapezoid((1 + grid**2 / 8) ** -4.5, grid) * math.gamma(4.5) / (math.sqrt(8 * math.pi) * math.gamma(4))
    assert p[10, 0.5] == pytest.approx(2 * tail, rel=1e-3) and p[2, 1.0] is None and p[5, 1.0] == 0.0 and p[9, None] is None


# picks


def test_review_pick_takes_no_channel_twice(spark):
    rnd = random.Random(8)
    rows = [(k % 2, rnd.randint(0, 1), rnd.randint(0, 30), rnd.randint(0, 99), rnd.randint(2, 8), rnd.randint(0, 6), k) for k in range(200)]
    df = spark.createDataFrame(rows, "band int, run_id int, chan int, gap_us int, most int, spread int, t_us int").withColumn("shaft", F.col("chan") % 5)
    got = S.review_pick(df, ["band"], ["gap_us", "run_id", "chan", "t_us"], 12).orderBy("turn").collect()

    def take(ranked, k):
        picked, shafts, chans = [], set(), set()
        for fresh in (True, False):
            for r in ranked:
                if len(picked) < k and r[1:3] not in chans and not (fresh and r[2] % 5 in shafts):
                    picked.append(r)
                    shafts.add(r[2] % 5)
                    chans.add(r[1:3])
        return picked

    for band in (0, 1):
        mine = [r for r in rows if r[0] == band]
        apart = take(sorted(mine, key=lambda r: (-r[5], r[3], r[1], r[2], r[6])), 6)
        used, middle = {r[1:3] for r in apart}, float(np.median([r[4] for r in mine]))
        rest = sorted((r for r in mine if r[1:3] not in used), key=lambda r: (abs(r[4] - middle), r[5], r[3], r[1], r[2], r[6]))
        want = apart + take(rest, 6)
        assert [r.t_us for r in got if r.band == band] == [r[6] for r in want]
        assert len({r[1:3] for r in want}) == 12
