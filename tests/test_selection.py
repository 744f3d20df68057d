"""Exact quantiles by selection, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import matching, selection


@pytest.mark.parametrize("kind", ["long", "double"])
def test_quantiles_equal_numpy(spark, kind):
    rnd = random.Random(1)
    number = (lambda x: int(x)) if kind == "long" else float
    shapes = {
        "wide": [number(rnd.uniform(-1e12, 1e12)) for _ in range(3001)], "hot": [number(5)] * 2000 + [number(x) for x in range(999)], "two": [number(1), number(2)], "one": [number(7)],
        "tail": [number(2.0 ** (k / 40)) for k in range(1500)] * 2, "same": [number(3)] * 50, None: [number(x) for x in range(100)],
    }
    rows = [(g, x) for g, values in shapes.items() for x in values] + [("wide", None), ("empty", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, f"g string, x {kind}").repartition(5)
    got = {r.g: r for r in selection.quantiles(selection.counted(df, ["g"], "x"), ["g"], {"q1": 0.25, "q2": 0.5, "low": 0.0, "high": 1.0, "odd": 0.377}).collect()}
    assert set(got) == set(shapes)
    for g, values in shapes.items():
        for name, share in (("q1", 0.25), ("q2", 0.5), ("low", 0.0), ("high", 1.0), ("odd", 0.377)):
            assert got[g][name] == pytest.approx(np.quantile(np.array(values, float), share), rel=1e-12, abs=1e-9), (g, name)


def test_no_groups_and_one_group_of_all(spark):
    df = spark.createDataFrame([(x,) for x in [4, 1, 9, None]], "x long")
    assert selection.medians(df, [], "x").collect() == [(4.0,)]
    assert selection.medians(df.where("x > 10"), [], "x").collect() == [(None,)]
    several = selection.medians_of(df, [], {"a": F.col("x"), "b": -F.col("x"), "none": F.lit(None)}).collect()
    assert several == [(4.0, -4.0, None)]


def test_only_buckets_are_sorted(spark):
    """No task of the last sort holds a group: of 40,000 values of one group a bucket has some 160."""
    df = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") * F.col("id")).alias("x"))
    counts = selection.counted(df, ["g"], "x")
    assert selection.quantiles(counts, ["g"], {"m": 0.5}).collect() == [(1, (19_999**2 + 20_000**2) / 2)]
    edges = counts.groupBy("g").agg(F.percentile_approx("value", [i / 256 for i in range(1, 256)], selection.ACCURACY).alias("e")).first().e
    sizes = np.histogram([x * x for x in range(40_000)], [-1, *sorted(set(edges)), 1 << 62])[0]
    assert sizes.max() < 1000


def test_classified_tells_events_of_one_time_apart(spark):
    rows = lambda times: spark.createDataFrame([("r", 1, t) for t in times], "run_id string, chan int, t_us long")
    got = matching.classified(rows([10, 10, 50, 90]), rows([12, 49]), [rows([9, 11, 52]), rows([10, 95])], ["run_id", "chan"], 5)
    assert sorted((r.t_us, r.lost, r.corroborated) for r in got.collect()) == [(10, False, True), (10, True, True), (50, False, True), (90, True, True)]
    alone = matching.classified(rows([10, 10]), rows([10]), [], ["run_id", "chan"], 5)
    assert sorted((r.lost, r.corroborated) for r in alone.collect()) == [(False, False), (True, False)]
