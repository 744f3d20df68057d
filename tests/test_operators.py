"""Hand-computed cases and properties of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import columns as C
from eventloom.functions import pvalues as T
from eventloom.operators import intervals as I
from eventloom.operators import matching as M
from eventloom.operators import postprocess as P
from eventloom.operators import rates as R
from eventloom.operators import scoring as S
from eventloom.operators import structure as X

S_US = 1_000_000


def two_pointers(a, b, tol):
    """A plain walk over both sorted trains."""
    a, b, i, j, out = sorted(a), sorted(b), 0, 0, []
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tol:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return out


def paired(a, b, tol):
    rows = sorted([(0, t, 0) for t in a] + [(0, t, 1) for t in b], key=lambda r: (r[1], r[2]))
    return sorted((r[1], p) for r, p in M.pair_off(rows, 1, tol) if r[2] == 0 and p is not None)


def test_pairs_equal_a_walk_over_both_trains():
    rnd = random.Random(5)
    for _ in range(3000):
        a, b = ([rnd.randint(0, 60) for _ in range(rnd.randint(0, 20))] for _ in range(2))
        tol = rnd.randint(0, 6)
        assert paired(a, b, tol) == sorted(two_pointers(a, b, tol))


def test_matching_known_cases(spark):
    assert paired([10000, 20000], [10020, 30000], 50) == [(10000, 10020)]
    assert paired([10000, 10040], [10020], 50) == [(10000, 10020)]
    a = spark.createDataFrame([(1, 30), (1, 10), (1, 20), (2, 5), (3, None)], "k int, t_us long")
    b = spark.createDataFrame([(1, 11), (1, 31)], "k int, t_us long")
    found = M.match(a, b, ["k"], 2).where("side = 0").select("k", "t_us", "partner").collect()
    assert sorted((r.k, r.t_us, r.partner or 0) for r in found) == [(1, 10, 11), (1, 20, 0), (1, 30, 31), (2, 5, 0)]
    assert M.match(a.where("false"), b.where("false"), ["k"], 2).count() == 0


def segs(spark, rows):
    return spark.createDataFrame([(1, k, a * S_US, b * S_US) for k, (a, b) in enumerate(rows)], "run_id int, seg int, t0_us long, t1_us long")


def events(spark, times):
    return spark.createDataFrame([(1, int(t * S_US)) for t in times], "run_id int, t_us long")


def test_intervals_and_bins_equal_a_plain_count(spark):
    rnd = random.Random(12)
    for _ in range(4):
        edges = sorted(rnd.sample(range(0, 300), 6))
        runs = list(zip(edges[::2], edges[1::2]))
        times = sorted({*(rnd.randint(0, 320) for _ in range(40)), runs[0][0], runs[1][1]})
        s, e = segs(spark, runs), events(spark, times)
        inside = [[t for t in times if a <= t < z] for a, z in runs]
        isi = sorted(r[0] // S_US for r in I.isis(e, s, ["run_id"], 50 * S_US).where("isi_us is not null").select("isi_us").collect())
        assert isi == sorted(y - x for part in inside for x, y in zip(part, part[1:]))
        width = rnd.choice([7, 12])
        starts = [(k, i, a + i * width) for k, (a, z) in enumerate(runs) for i in range((z - a) // width)]
        assert sorted((r.seg, r.bin, r.t0_us // S_US) for r in I.bins(s, width * S_US).collect()) == starts
        counts = I.filled(I.bin_counts(e, s, ["run_id"], width * S_US, 50 * S_US), e.limit(1), s, ["run_id"], width * S_US)
        assert sorted((r.seg, r.bin, r.n) for r in counts.collect()) == [(k, i, sum(t <= x < t + width for x in times)) for k, i, t in starts]


def test_complement_and_union(spark):
    spans = spark.createDataFrame([(1, 100 * S_US), (2, 50 * S_US)], "run_id int, total_us long")
    gaps = I.complement(segs(spark, [(10, 20), (50, 60), (15, 18)]).drop("seg"), spans, ["run_id"]).orderBy("run_id", "t0_us").collect()
    assert [(r.run_id, r.t0_us // S_US, r.t1_us // S_US) for r in gaps] == [(1, 0, 10), (1, 20, 50), (1, 60, 100), (2, 0, 50)]
    assert I.complement(segs(spark, [(0, 100)]).drop("seg"), spans.where("run_id = 1"), ["run_id"]).count() == 0
    merged = I.union(segs(spark, [(0, 10), (10, 20), (25, 30), (5, 8)]), ["run_id"]).orderBy("t0_us").collect()
    assert [(r.t0_us // S_US, r.t1_us // S_US) for r in merged] == [(0, 20), (25, 30)]


def test_conditions_partition_the_recording(spark):
    spans = spark.createDataFrame([(1, 100 * S_US)], "run_id int, total_us long")
    on = segs(spark, [(4, 11), (52, 65)]).drop("seg")
    total = lambda label, until=None: I.select_condition(on, spans, label, until).agg(F.sum(F.col("t1_us") - F.col("t0_us"))).first()[0]
    assert total("on") == 20 * S_US and total("off") == 80 * S_US and total("all") == 100 * S_US
    assert total("on", 60 * S_US) == 15 * S_US
    with pytest.raises(ValueError):
        I.select_condition(on, spans, "other")


def test_merging_is_idempotent_and_strict(spark):
    rnd = random.Random(1)
    d = spark.createDataFrame([("r", "d", 1, rnd.randint(0, 5000)) for _ in range(300)], "run_id string, detector string, chan int, t_us long").distinct()
    once = P.merge_close(d, 20)
    assert once.count() < d.count()
    two = spark.createDataFrame([("r", "d", 1, 0), ("r", "d", 1, 20), ("r", "d", 1, 39)], "run_id string, detector string, chan int, t_us long")
    assert sorted(r.t_us for r in P.merge_close(two, 20).collect()) == [0, 20]


def test_labels_shafts_and_rounding(spark):
    df = spark.createDataFrame([(" B'1-B'2 ", "_A1", 2.5, -2.5), ("C’1", "12", 0.5, 0.8029 * 1000)], "l string, n string, x double, y double")
    got = df.select(C.normalise_label(F.col("l")), C.shaft(F.col("n")), C.to_samples(F.col("x"), 1.0), C.half_away(F.col("y"))).collect()
    assert [tuple(r) for r in got] == [("B_1_B_2", "A", 2, -3), ("C_1", "?", 0, 803)]


def test_markers_become_samples(spark):
    m = spark.createDataFrame([("r", "Spike", 1.25, ["B1-B2"]), ("r", "Spike", 2.5, ["B1-B2", "C'1-C'2"]), ("r", "Ripple", 3.0, ["B1-B2"]), ("r", "Spike", 2.5, ["B1-B2"]), ("r", "Spike", float("nan"), ["B1-B2"])], "rec_id string, label string, position double, channels array<string>")
    channels = spark.createDataFrame([("r", "B1_B2"), ("r", "C_1_C_2"), ("r", "H1-H2")], "rec_id string, name string")
    got = P.from_markers(m, channels, 400.0).orderBy("name", "idx").collect()
    assert [(r.name, r.idx) for r in got] == [("B1_B2", 500), ("B1_B2", 1000), ("C_1_C_2", 1000), ("H1_H2", None)]


def test_rates_need_a_fifth_of_the_time(spark):
    df = spark.createDataFrame([(30, 500.0), (9, 2.5), (6, 99.0), (25, 100.0), (4, 0.0)], "n long, clean double")
    got = [r[0] for r in df.select(C.measured_rate(F.col("n"), F.col("clean"), F.lit(500.0))).collect()]
    assert got == [0.06, None, None, 0.25, None]


def test_wilson(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (50, 100), (0, 0)], "k long, n long")
    low, high = C.wilson(F.col("k"), F.col("n"))
    got = df.select(low, high).collect()
    assert got[0][0] == 0 and abs(got[1][1] - 1) < 1e-12 and abs(got[2][0] + got[2][1] - 1) < 1e-9 and got[3][0] is None


def test_event_and_window_scores(spark):
    ms = 1000
    truth = spark.createDataFrame([(1, 0, 1000 * ms, 1.0), (1, 0, 5000 * ms, 1.0), (1, 1, 2000 * ms, 1.0)], "run_id int, chan int, t_us long, amp double")
    det = spark.createDataFrame([("d", 1, 0, 1010 * ms), ("d", 1, 0, 9000 * ms), ("d", 1, 1, 2020 * ms)], "detector string, run_id int, chan int, t_us long")
    r = S.event_scores(S.hits(truth, det, ["detector"], 50 * ms), ["detector"], F.lit(2.0)).first()
    assert (r.tp, r.fp, r.fn, r.dt_ms, r.bias_ms, r.fp_per_minute) == (2, 1, 1, 15.0, 15.0, 0.5)
    truth = spark.createDataFrame([(1, 0, 50 * ms, 1.0), (1, 0, 550 * ms, 1.0)], "run_id int, chan int, t_us long, amp double")
    det = spark.createDataFrame([("d", 1, 0, 60 * ms), ("d", 1, 0, 620 * ms), ("d", 1, 1, 250 * ms)], "detector string, run_id int, chan int, t_us long")
    w = S.window_scores(truth, det, ["detector"], 100 * ms, 0, 1000 * ms, F.lit(2)).first()
    assert (w.tp, w.fp, w.fn, w.tn, w.fp_adjacent) == (1, 2, 1, 16, 1)


def test_curves(spark):
    def area(points):
        return S.partial_auc(spark.createDataFrame([("d", float(x), float(y)) for x, y in points], "d string, x double, y double"), ["d"], "x", "y").first().pauc

    assert area([(0, 1), (0.1, 1), (0.2, 1)]) == pytest.approx(1) and area([(0, 0), (1, 1)]) == pytest.approx(0.5) and area([(0, 1)]) is None
    assert S.average_precision(spark.createDataFrame([("d", 0.5, 0.8)], "d string, recall double, precision double"), ["d"]).first().ap == pytest.approx(0.4)


def test_interpolation(spark):
    curve = spark.createDataFrame([("d", 1.0, 10.0), ("d", 2.0, 20.0), ("d", 4.0, 0.0)], "d string, x double, y double")
    at = spark.createDataFrame([("d", v) for v in (0.5, 1.0, 1.5, 3.0, 4.0, 9.0)], "d string, at double")
    get = lambda clamp: [r.y for r in S.interpolated(curve, at, ["d"], "x", "y", "at", clamp).orderBy("at").collect()]
    assert get(False) == [None, 10.0, 15.0, 10.0, 0.0, None] and get(True) == [10.0, 10.0, 15.0, 10.0, 0.0, 0.0]


def test_spearman_and_ranks(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 2.0), (3, 3.0, 1.0), (4, None, 1.0)], "chan int, x double, y double").withColumn("g", F.lit(1))
    r = R.spearman(df, "x", "y", ["g"]).first()
    assert r.n == 3 and r.rho == pytest.approx(-1)
    assert R.spearman(df.withColumn("x", F.lit(1.0)), "x", "y", ["g"]).first().rho is None
    ranked = R.ranked(df.withColumnRenamed("x", "rate"), ["g"]).orderBy("rank").collect()
    assert [r.chan for r in ranked] == [3, 2, 1, 4]


def test_p_values():
    assert T.wilcoxon_p(0, 5) == pytest.approx(2 / 32) and T.wilcoxon_p(7.5, 5) == pytest.approx(1.0) and T.wilcoxon_p(0, 0) is None
    assert T.student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and T.student_p(0.0, 5) == 1.0
    assert T.spearman_p(1.0, 10) == 0.0 and T.spearman_p(0.5, 2) is None and 0 < T.spearman_p(0.5, 10) < 1


def test_synchrony_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(1, rnd.randint(0, 3), rnd.randint(0, 3000)) for _ in range(200)]
    got = X.synchrony(spark.createDataFrame(rows, "g int, chan int, t_us long"), ["g"], 7, 100).first().synchrony
    want = sum(any(c != d and abs(t - u) <= 7 for _, d, u in rows) for _, c, t in rows) / len(rows)
    assert got == pytest.approx(want)


def test_thinning_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 5, 9, 10, 19, 21)], "chan int, t_us long")
    assert sorted(r.t_us for r in X.collapsed(rows, ["chan"], 10).collect()) == [0, 10, 21]


def test_contacts(spark):
    marks = spark.createDataFrame([("s", 1, "a", ["A1", "ZZ9"]), ("s", 2, "a", ["ZZ9"])], "subject string, t_us long, annotation string, chans array<string>")
    channels = spark.createDataFrame([("s", "A1"), ("s", "A2")], "subject string, name string")
    kept, unknown = M.resolve_contacts(marks, channels)
    assert sorted((r.t_us, list(r.chans)) for r in kept.collect()) == [(1, ["A1"]), (2, [])]
    with pytest.raises(ValueError, match="ZZ9"):
        M.require_none(unknown, "unknown contacts")
    assert sorted((r.name, r.t_us or 0) for r in M.truth_per_channel(kept, channels).collect()) == [("A1", 1), ("A2", 0)]


def test_invariants_fire_one_by_one(spark):
    runs = spark.createDataFrame([(1, 100 * S_US, 30 * S_US, 70 * S_US)], "run_id int, total_us long, on_us long, off_us long")
    det = spark.createDataFrame([(1, 0, 5 * S_US)], "run_id int, chan int, t_us long")
    seg = segs(spark, [(10, 25), (60, 75)]).drop("seg")
    clean = spark.createDataFrame([(1, S_US)], "run_id int, clean_us long")
    chans = spark.createDataFrame([(1, 0)], "run_id int, chan int")
    rules = lambda **k: {r.rule for r in S.violations(**{**dict(runs=runs, detections=det, segments=seg, clean_per_slice=clean, channels=chans, slice_us=S_US), **k}).collect()}
    assert rules() == set()
    assert rules(detections=det.withColumn("t_us", F.lit(100 * S_US).cast("long"))) == {"event outside"}
    assert rules(detections=det.withColumn("chan", F.lit(9))) == {"unknown channel"}
    assert rules(clean_per_slice=clean.withColumn("clean_us", F.lit(2 * S_US).cast("long"))) == {"clean time"}
    assert rules(runs=runs.withColumn("off_us", F.lit(60 * S_US).cast("long"))) == {"ON and OFF"}
    assert rules(segments=segs(spark, [(10, 10)]).drop("seg")) == {"empty segment"}
    assert rules(segments=segs(spark, [(90, 101)]).drop("seg")) == {"segment outside"}
    assert rules(segments=segs(spark, [(10, 25), (20, 30)]).drop("seg")) == {"segments overlap"}
    assert rules(detections=det.withColumn("is_on", F.lit(True))) == set() and rules(detections=det.withColumn("is_on", F.lit(None).cast("boolean"))) == {"no flag"}
    slices = spark.createDataFrame([(1, 0, S_US), (1, 0, S_US // 2)], "run_id int, chan int, clean_us long")
    split = lambda on, off: spark.createDataFrame([(1, 0, on, off)], "run_id int, chan int, on_us long, off_us long")
    assert rules(clean_per_slice=slices, clean=split(S_US, S_US)) == set()
    assert rules(clean_per_slice=slices, clean=split(2 * S_US, S_US)) == {"clean time is not that of the slices"}
    assert rules(clean_per_slice=slices, clean=split(102 * S_US, 0)) == {"clean time of a condition", "clean time is not that of the slices"}


def test_fano_without_grids(spark):
    rnd = random.Random(2)
    rows = [("g", c, rnd.randint(0, 999)) for c in range(3) for _ in range(60)]
    got = X.fano(spark.createDataFrame(rows, "g string, chan int, t_us long"), ["g"], [50], 1000, 0.0, 1000).first().fano
    each = []
    for c in range(3):
        n = [sum(k == c and t // 50 == b for _, k, t in rows) for b in range(20)]
        mean = sum(n) / 20
        each.append((sum(x * x for x in n) / 20 - mean * mean) / mean)
    assert got == pytest.approx(sorted(each)[1])
    assert math.isfinite(got)
