"""Numeric helpers, sources and live jobs."""

import datetime as dt
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import dsp
from eventloom.operators import signals as G
from eventloom.plans.recordings import sample_file
from eventloom.sources import edf, runs
from eventloom.streaming import jobs


def test_filters_keep_and_remove():
    fs, t = 500.0, np.arange(2000) / 500
    slow, fast = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 100 * t)
    low = dsp.zero_phase(slow + fast, fs, dsp.low_pass(30, fs))
    assert np.abs(low - slow)[200:-200].max() < 0.05
    band = dsp.zero_phase(slow + fast, fs, dsp.band_pass(60, 150, fs))
    assert np.abs(band - fast)[200:-200].max() < 0.1
    clean = dsp.zero_phase(slow + np.sin(2 * np.pi * 50 * t), fs, dsp.notch(50, fs))
    assert np.abs(clean - slow)[300:-300].max() < 0.1
    assert np.abs(dsp.envelope(fast)[100:-100] - 1).max() < 0.05
    assert dsp.low_pass_steep(50, 200)(np.array([1.0]))[0] > 0.99 > 0.01 > dsp.low_pass_steep(50, 200)(np.array([60.0]))[0]


def test_median_decimation_and_spectrum():
    x = np.zeros(101)
    x[50] = 9
    assert dsp.median_filter(x, 3).max() == 0 and dsp.median_filter(x, 1).max() == 9
    with pytest.raises(ValueError):
        dsp.median_filter(x, 2)
    t = np.arange(4000) / 1000
    y = dsp.decimate(np.sin(2 * np.pi * 3 * t), 10)
    assert len(y) == 400 and np.abs(y - np.sin(2 * np.pi * 3 * t[::10]))[20:-20].max() < 0.02
    f, p = dsp.density(np.sin(2 * np.pi * 40 * t) + 0.5 * np.sin(2 * np.pi * 90 * t), 1000, 1000)
    assert f[p.argmax()] == 40 and p[40] == pytest.approx(4 * p[90], rel=1e-6)
    assert p.sum() * f[1] == pytest.approx(0.625, rel=1e-3)


def test_rhythm_and_autoregression():
    t = np.arange(4000) / 200
    assert dsp.rhythm_peak(np.sin(2 * np.pi * 15 * t) + 0.01 * np.cos(7 * t * t), 200) == pytest.approx(15, abs=1)
    rnd = np.random.default_rng(0)
    x = np.zeros(20000)
    for k in range(1, len(x)):
        x[k] = 0.7 * x[k - 1] + rnd.normal()
    a, e = dsp.autoregression(x, 1)
    assert a[0] == pytest.approx(0.7, abs=0.03) and e == pytest.approx(1, abs=0.05)


def bursts(n=6000, fs=200.0):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=n)
    at = [900, 2500, 4100]
    for a in at:
        k = np.arange(-15, 16)
        x[a - 15 : a + 16] += 25 * np.exp(-((k / 6) ** 2)) * np.cos(2 * np.pi * 25 * k / fs)
    return x, at


def test_detector_finds_bursts(spark):
    x, at = bursts()
    marks = dsp.detect(x, 200.0, 10, 60, 1000, 200, 3.65, 0.0, 20)
    assert [any(abs(m[0] - a) <= 6 for m in marks) for a in at] == [True] * 3
    rows = [("r", 0, k, int(k * 5e6), 200.0, x[k * 1000 : (k + 1) * 1000].tolist()) for k in range(6)]
    sig = spark.createDataFrame(rows, "rec_id string, chan int, block long, t0_us long, fs double, samples array<float>")
    got = [r.t_us / 5000 for r in G.run_detector(sig, "envelope", 2, 1, low=10, high=60, window=1000, step=200, k1=3.65, k3=0.0, join=20).orderBy("t_us").collect()]
    assert [any(abs(m - a) <= 6 for m in got) for a in at] == [True] * 3 and len(got) == len(set(got))
    with pytest.raises(ValueError, match="speed"):
        G.run_detector(sig, "envelope", 2, 1, speed=3)


def test_stored_arrays(spark, tmp_path):
    stored = dict(fs=400.0, seconds=20.0, names=np.array(["A", "B"]), J_idx=np.array([800, 2401]), J_chan=np.array([0, 1]), J_on=np.array([True, False]), truth_idx=np.array([4000]), truth_chan=np.array([1]), truth_amp=np.array([2.5]), truth_fs=2000.0, simulated=True, noise=np.array([[1.0, np.nan]]))
    for name in ("one", "two"):
        buf = io.BytesIO()
        np.savez(buf, **(stored if name == "one" else {k: v for k, v in stored.items() if k != "simulated"}))
        (tmp_path / f"{name}.npz").write_bytes(buf.getvalue())
    e = runs.read_npz(spark, str(tmp_path / "*.npz")).cache()
    assert runs.detections_of(e).count() == 4
    got = runs.detections_of(e, only_simulated=True).orderBy("idx").collect()
    assert [(r.run_id, r.detector, r.chan, r.t_us, r.is_on) for r in got] == [("one", "J", 0, 2_000_000, True), ("one", "J", 1, 6_002_500, False)]
    assert [tuple(r)[1:] for r in runs.truth_of(e).where("run_id = 'one'").collect()] == [(1, 2_000_000, 2.5)]
    assert e.where("key = 'noise' and run_id = 'one'").orderBy("j").collect()[1].num is None


def test_expert_files(spark, tmp_path):
    for s in ("01", "02"):
        d = tmp_path / f"sub-{s}"
        d.mkdir()
        (d / "channels.tsv").write_bytes("﻿name\ttype\nA1\tSEEG\nA2\tSEEG\n".encode())
    (tmp_path / "sub-01" / "marks.tsv").write_text("time_in_sec\tannotation\tchans\n1.5\tRt sharp\tA1 A2\n0.25\tRt sharp\tA2\n")
    channels = runs.read_tsv(spark, str(tmp_path / "sub-*" / "channels.tsv"))
    assert channels.columns[0] == "name" and channels.count() == 4
    marks = runs.read_tsv(spark, str(tmp_path / "sub-*" / "marks.tsv"))
    assert [r.subject for r in runs.complete_subjects(channels, marks).collect()] == ["01"]
    got = runs.expert_marks(marks).orderBy("t_us").collect()
    assert [(r.t_us, list(r.chans)) for r in got] == [(250_000, ["A2"]), (1_500_000, ["A1", "A2"])]
    (tmp_path / "ez.json").write_text('[{"patient": "p1", "EZ": ["A1", "A2"]}, {"patient": "p5", "EZ": null}]')
    assert sorted((r.patient, r.name or "") for r in runs.read_onset(spark, str(tmp_path / "ez.json")).collect()) == [("p1", "A1"), ("p1", "A2"), ("p5", "")]


def test_recording_files(spark, tmp_path):
    records = [[[k, k + 1, k + 2, k + 3], [0, 0, 0, 0]] for k in range(5)]
    (tmp_path / "rec.edf").write_bytes(sample_file(["A1", "A2"], records, 4))
    spark.dataSource.register(edf.Edf)
    rows = spark.read.format("edf").option("records", "2").load(str(tmp_path / "*.edf")).orderBy("chan", "block").collect()
    assert len(rows) == 10 and rows[3].name == "A1" and rows[3].t0_us == 3_000_000 and rows[3].fs == 4.0
    assert np.allclose(rows[3].samples, [0.3, 0.4, 0.5, 0.6], atol=0.06) and set(rows[7].samples) == {rows[7].samples[0]}


def test_excerpts_cross_blocks(spark):
    sig = spark.createDataFrame([("r", 1, b, [float(b * 4 + k) for k in range(4)]) for b in range(3)], "rec_id string, chan int, block long, samples array<float>")
    marks = spark.createDataFrame([("r", 1, 4), ("r", 1, 0)], "rec_id string, chan int, t_us long")
    got = {r.t_us: (r.from_us, list(r.samples)) for r in G.excerpts(sig, marks, 2, 4, 1).collect()}
    assert got == {4: (2, [2.0, 3.0, 4.0, 5.0, 6.0]), 0: (0, [0.0, 1.0, 2.0])}


def test_live_jobs_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "d", 1, k, t0 + dt.timedelta(seconds=s)) for k, s in enumerate((0, 5, 14, 24, 60))]
    spark.createDataFrame(rows + rows[:1], "run_id int, detector string, chan int, idx long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id int, detector string, chan int, idx long, ts timestamp").parquet(str(tmp_path / "in"))
    once = jobs.run_once(jobs.without_overlap(stream), str(tmp_path / "a"))
    assert once.count() == 5
    merged = jobs.run_once(jobs.merged_marks(stream, 10_000_000), str(tmp_path / "b"), "complete").orderBy("ts").collect()
    assert [(r.ts - t0).seconds for r in merged] == [0, 24, 60]
    rate = jobs.run_once(jobs.population_rate(stream, "30 seconds"), str(tmp_path / "c"), "complete").agg(F.sum("n")).first()[0]
    assert rate == 6


def test_live_chains_end_in_append_mode(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    kind = "run_id int, detector string, chan int, idx long, ts timestamp"
    put = lambda seconds, name: spark.createDataFrame([(1, "d", 1, k, t0 + dt.timedelta(seconds=s)) for k, s in enumerate(seconds)], kind).coalesce(1).write.parquet(str(tmp_path / name))
    stream = lambda name: spark.readStream.schema(kind).parquet(str(tmp_path / name))
    put((0, 5, 14, 24, 60, 200), "in")
    put((0,), "end")
    ended = lambda: jobs.with_end(stream("in"), stream("end"), F.lit(t0 + dt.timedelta(days=2)))
    chains = lambda name, df: sorted(((r.ts - t0).seconds, r.merged) for r in jobs.run_once(jobs.merged_marks(df, 10_000_000, "20 seconds"), str(tmp_path / name)).collect())
    assert chains("a", stream("in")) == [(0, 3), (24, 1), (60, 1)]
    assert chains("b", ended()) == [(0, 3), (24, 1), (60, 1), (200, 1)]
    rate = jobs.run_once(jobs.population_rate(ended(), "30 seconds", "20 seconds"), str(tmp_path / "c")).collect()
    assert sorted(((r.start - t0).seconds, r.n) for r in rate) == [(0, 4), (60, 1), (180, 1)]


def test_a_late_mark_is_left_out_once_its_chain_is_closed(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    kind = "run_id int, detector string, chan int, idx long, ts timestamp"
    put = lambda seconds: spark.createDataFrame([(1, "d", 1, s, t0 + dt.timedelta(seconds=s)) for s in seconds], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: sorted(((r.ts - t0).seconds, r.merged) for r in jobs.run_once(jobs.merged_marks(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 10_000_000, "20 seconds"), str(tmp_path / "job")).collect())
    put((0, 5, 100))
    assert run() == [(0, 2)]
    put((7, 95, 101))
    put((5000,))
    assert run() == [(0, 2), (95, 3)]


def test_filters_reach_recordings(spark, tmp_path, monkeypatch):
    names, n = ["A1", "A2", "A3"], 50
    for rec in ("one", "two"):
        (tmp_path / f"{rec}.edf").write_bytes(sample_file(names, [[[100 * k + c] * n for c in range(3)] for k in range(6)], n))
    load = lambda: edf.read(spark, str(tmp_path), records=4)
    key = lambda df: sorted((r.rec_id, r.chan, r.name, r.block, r.t0_us, round(r.samples[0], 1), len(r.samples)) for r in df.collect())
    every = key(load())
    assert len(every) == 36 and every[0][:5] == ("one", 0, "A1", 0, 0)
    for rule, keep in (
        ("name = 'A2'", lambda r: r[2] == "A2"), ("chan in (0, 2) and block >= 2 and block < 5", lambda r: r[1] != 1 and 2 <= r[3] < 5),
        ("rec_id = 'two' and block in (0, 5)", lambda r: r[0] == "two" and r[3] in (0, 5)), ("block > 3 and block <= 4 and rec_id <> 'one'", lambda r: r[0] == "two" and r[3] == 4),
        ("name = 'A2' and chan = 0", lambda r: False), ("block > 9", lambda r: False),
    ):
        assert key(load().where(rule)) == [r for r in every if keep(r)], rule
    sizes, fetched = [], edf.fetched
    monkeypatch.setattr(edf, "fetched", lambda f, at, size: sizes.append(size) or fetched(f, at, size))
    reader = edf.FilteringReader({"path": str(tmp_path), "records": "4", "gap": "0"})
    assert list(reader.pushFilters([edf.EqualTo(("name",), "A2"), edf.EqualTo(("rec_id",), "one"), edf.LessThan(("block",), 5)])) == []
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 5 and sizes == [2 * n] * 5


def test_broken_runs_are_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 50)], "run_id long, detector string, t_us long")
    broken = spark.createDataFrame([(2, "event outside", "50"), (3, "event outside", "7")], "run_id long, rule string, detail string")
    with pytest.raises(runs.BrokenRuns, match="run 2: event outside, 1 times"):
        runs.write_checked_runs(rows, str(tmp_path / "x"), broken)
    assert not (tmp_path / "x").exists()
    runs.write_checked_runs(rows, str(tmp_path / "y"), broken, skip=True)
    assert [r.run_id for r in runs.read_runs(spark, str(tmp_path / "y")).collect()] == [1]
    runs.write_checked_runs(rows, str(tmp_path / "z"), broken.where("run_id = 3"))
    assert runs.read_runs(spark, str(tmp_path / "z")).count() == 2


def test_discharges_look_at_all_channels_samples(spark):
    rnd = np.random.default_rng(3)
    n, per, dt_us, step = 120, 10, 25, 10
    raw, high = np.round(rnd.normal(size=(3, n)), 1), np.round(rnd.normal(size=(3, n)), 2)
    rows = [("r", c, b * per * step, 1e6 / step, raw[c, b * per : (b + 1) * per].tolist(), high[c, b * per : (b + 1) * per].tolist()) for c in range(3) for b in range(n // per) if (c, b) != (1, 4)]
    signals = spark.createDataFrame(rows, "rec_id string, chan int, t0_us long, fs double, samples array<double>, heights array<double>")
    marks = [(0, 93), (0, 100), (1, 118), (0, 400), (1, 431), (0, 1180)]
    frame = spark.createDataFrame([("r", c, t, 1.0 if c else 0.5) for c, t in marks], "rec_id string, chan int, t_us long, con double")
    expected = set()
    for t0, t1 in ((93, 143), (400, 425), (431, 456), (1180, 1205)):
        for c in range(3):
            own = [t for k, t in marks if k == c and t0 <= t < t1]
            at = [k for k in range(n) if t0 <= k * step <= t1 and not (c == 1 and 40 <= k < 50)]
            if own or at:
                expected.add((t0, t1, c, (1.0 if c else 0.5) if own else 0.0, len(own), max(own) + dt_us if own else None, max(abs(high[c, at])) if at else None, max(raw[c, at], key=abs) if at else None))
    for width in (100, 37, 5000):
        got = G.discharges_with_signal(frame, signals, dt_us, width).collect()
        assert {(r.t0_us, r.t1_us, r.chan, r.con, r.marks, r.last_us, r.height, r.raw) for r in got} == expected and len(got) == len(expected)
