"""All points of a sweep in one walk, against a walk a point."""

import random

from pyspark.sql import functions as F

from eventloom.operators import matching as M
from eventloom.operators import scoring as S


def trains(spark, seed, n, reach):
    """Truth and scored detections of two detectors on two channels, with equal times, nulls and a train without a gap."""
    r = random.Random(seed)
    truth = [(c, c + 1, r.randrange(reach), 1.0) for c in range(2) for _ in range(n)] + [(0, 1, None, 1.0)]
    found = [(d, c, c + 1, r.randrange(reach), r.choice([None, 0, 1, 2, 3, 5])) for d in ("p", "q") for c in range(2) for _ in range(n)]
    found += [("p", 0, 1, t, 2) for t in range(0, reach, 9)] + [("other", 0, 1, 5, 5)]
    return spark.createDataFrame(truth, "run_id int, chan int, t_us long, amp double"), spark.createDataFrame(found, "detector string, run_id int, chan int, t_us long, score int")


def test_points_are_matched_as_each_by_itself(spark):
    keys, values, tol = ["run_id", "chan"], [3, 0, 2, 9], 10
    for seed, n, reach in ((1, 60, 3000), (2, 80, 700)):
        truth, found = trains(spark, seed, n, reach)
        got = {(r.run_id, r.detector, r.value): (r.tp, r.n_true, r.n_det) for r in M.sweep_counts(truth, found, ["p", "q"], values, keys, tol, ["run_id"]).collect()}
        assert len(got) == 2 * 2 * 4
        times = lambda rows: sorted(rows, key=lambda x: x[:4])
        t, d = truth.where("t_us is not null").collect(), found.collect()
        for (run, detector, value), counts in got.items():
            here = [(x.run_id, x.chan, x.t_us, 0) for x in t if x.run_id == run]
            there = [(x.run_id, x.chan, x.t_us, 1) for x in d if x.run_id == run and x.detector == detector and x.score is not None and x.score >= value]
            pairs = sum(row[-1] == 0 and p is not None for row, p in M.pair_off(times(here + there), 2, tol))
            assert counts == (pairs, len(here), len(there))


def test_partners_are_those_of_match(spark):
    truth, found = trains(spark, 3, 50, 900)
    keys = ["run_id", "chan"]
    b = found.where("detector = 'p' and score is not null").select(*keys, "t_us", F.lit(1).alias("lo"), F.lit(3).alias("hi"))
    got = M.match_points(truth, b, keys, 10, 4)
    flat = got.select(*keys, "t_us", "side", "lo", F.posexplode("partners").alias("at", "partner")).withColumn("point", F.expr("lo + at"))
    rows = lambda df: sorted((tuple(r) for r in df.select(*keys, "t_us", "side", "partner").collect()), key=repr)
    alone = rows(M.match(truth, b, keys, 10))
    assert rows(flat.where("point = 1")) == alone and rows(flat.where("point = 2")) == alone
    empty = flat.where("point in (0, 3)")
    assert empty.where("side = 1 or partner is not null").count() == 0 and empty.count() == 2 * 100


def test_empty_sides_and_a_plan_of_as_many_shuffles_for_more_points(spark):
    truth, found = trains(spark, 4, 20, 500)
    channels = truth.select("run_id", "chan").distinct()
    none = S.sweep_matrix(truth, found.limit(0), channels, ["p", "q"], [0, 2], 10, 1.0).collect()
    assert sorted((r.subject, r.detector, r.value, r.tp, r.n_true, r.n_det) for r in none) == [(s, d, v, 0, 20, 0) for s in range(2) for d in "pq" for v in (0, 2)]
    assert M.sweep_against(found.limit(0), truth, [0, 1], ["run_id", "chan"], 10).collect() == []
    few, many = (M.sweep_counts(truth, found, ["p", "q"], list(range(k)), ["run_id", "chan"], 10, ["run_id"]) for k in (1, 6))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(few) == shuffles(many)
