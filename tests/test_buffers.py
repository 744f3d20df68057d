"""Buffers of channels: many at once, each as it would be alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import dsp
from eventloom.operators import signals as G
from eventloom.plans import signals as Q
from eventloom.plans.fixtures import days
from tests.test_queries import DATA, pytestmark  # noqa: F401

SCHEMA = "rec_id int, chan int, block long, t0_us long, fs double, samples array<float>"


def frame(spark, chans=12, blocks=4):
    rows = [(c % 2, c, b, b * 10_000_000, 1.0, [float(c * 100 + b * 10 + i) for i in range(10)]) for c in range(chans) for b in range(blocks)]
    return spark.createDataFrame(rows, SCHEMA)


def test_a_detector_takes_many_buffers_at_once(spark, monkeypatch):
    monkeypatch.setitem(G.DETECTORS, "rows", lambda x, fs: [[(i, float(len(x)), row[i], 0.0, 1.0) for i in range(len(row))] for row in x])
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = G.run_detector(frame(spark), "rows", 2, 1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.rec_id, r.chan, r.t_us, r.weight) for r in got) == sorted((c % 2, c, i * 1_000_000, float(c * 100 + i)) for c in range(12) for i in range(40))
    assert {r.value for r in got} == {24.0}  # twelve channels, two buffers of one length each


def test_a_helper_takes_rows_and_blocks_keep_their_own(spark):
    seen = G.per_channel(frame(spark), lambda x, fs: (np.repeat(x[:, ::2] + len(x), 1, axis=1), fs / 2), 2, 1, rows=True).collect()
    assert {(r.chan, r.block) for r in seen} == {(c, b) for c in range(12) for b in range(4)}
    for r in seen:
        own = [r.chan * 100 + r.block * 10 + i for i in range(0, 10, 2)]
        more = r.samples[0] - own[0]
        assert r.fs == 0.5 and more >= 1 and r.samples == [x + more for x in own] and r.rec_id == r.chan % 2


@pytest.mark.parametrize("n", [720, 312, 50, 9, 5])
def test_rows_of_samples_equal_single_ones(n):
    rnd = np.random.default_rng(n)
    x = np.where(rnd.random((20, n)) < 0.09, rnd.exponential(50, (20, n)), 0.0)
    for f in (lambda v: Q.filtered(v, Q.FS)[0], lambda v: dsp.resampled(v, Q.FS, Q.FS * 3 / 4)[0], lambda v: dsp.resample(v, 5, 3)):
        assert f(x) == pytest.approx(np.array([f(r) for r in x]), abs=1e-9)
    alone = [dsp.detect(r, Q.FS, **Q.ENVELOPE) for r in x]
    for row, marks in zip(alone, dsp.detect_rows(x, Q.FS, **Q.ENVELOPE)):
        assert [(m[0], m[4]) for m in marks] == [(m[0], m[4]) for m in row]
        assert [m[1:4] for m in marks] == [pytest.approx(m[1:4], abs=1e-9) for m in row]
    if n > 12:
        assert (dsp.rhythm_peak(x, Q.FS) == [dsp.rhythm_peak(r, Q.FS) for r in x]).all()


def test_marks_are_the_first_highest_samples_of_their_runs():
    rnd = np.random.default_rng(0)
    env, bound = np.round(rnd.random((30, 60)), 1), np.full((30, 60), 0.7)
    want = []
    for k, row in enumerate(env):
        above = np.flatnonzero(row > 0.7)
        for run in np.split(above, np.flatnonzero(np.diff(above) > 3) + 1) if len(above) else []:
            want.append((k, run[0] + int(np.argmax(row[run[0] : run[-1] + 1]))))
    assert list(zip(*dsp.maxima_of_rows(env, bound, 3))) == want


def test_a_signal_shorter_than_the_decimating_filter_stays_in_place():
    x = np.arange(9.0)
    assert dsp.decimate(x, 2) == pytest.approx(x[::2], abs=0.3)


def test_hours_fill_days_without_a_row_each(spark):
    hits = spark.createDataFrame([(1, 0, 2.0), (1, 23, 3.0), (1, 24, 4.0), (1, 719, 5.0), (1, 720, 9.0), (1, -1, 9.0), (2, 720, 9.0), (None, 5, 9.0)], "chan int, hour long, v double")
    got = {r.chan: np.array(r.days) for r in days(hits, ["chan"], F.lit(0.0)).collect()}
    want = np.zeros(720)
    want[[0, 23, 24, 719]] = 2, 3, 4, 5
    assert set(got) == {1, 2, None} and (got[1].ravel() == want).all() and got[1].shape == (30, 24)
    assert not got[2].any() and not got[None].any()


def test_the_detector_runs_once(spark):
    plan = Q.QUERIES["d1_envelope"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", ["d3_resampled", "d2_d3_filtered"])
def test_queries_take_many_channels_at_once(spark, monkeypatch, name):
    calls = []
    real = G.per_channel
    monkeypatch.setattr(G, "per_channel", lambda *a, rows=False: calls.append(rows) or real(*a, rows=rows))
    found = Q.QUERIES[name](spark, DATA)
    assert calls == [True] and found.count() == 450  # 15 channels of 30 days
