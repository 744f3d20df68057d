"""op12: intervals hold the products, and the rows equal SQL's and a plain walk over all pairs."""

import math
import random

import numpy as np
import pytest

from eventloom.llm import negatives
from tests.compare import connection, same


def plainly(rows, low=30, high=90):
    """The result by comparing all pairs of rows with whole numbers of any length."""
    kept = set()
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in kept:
        if i % 100:
            continue
        scored = [(-min(max(sum(map(int.__mul__, v, w)), -(2**63)), 2**63 - 1), j, other) for j, other, w in kept if len(w) == len(v) and (j != i or other != label)]
        for p, pos, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:5]:
            hard = sorted((s, j) for s, j, other in scored if other != label and low * -p <= 100 * -s <= high * -p)[:10]
            out += [(i, pos, r + 1, j, -p, -s) for r, (s, j) in enumerate(hard)]
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_intervals_hold_every_product(dim):
    rnd = np.random.default_rng(dim)
    centre = np.floor(rnd.normal(0, 50, dim))
    x = np.floor(np.concatenate((centre + rnd.normal(0, 3, (60, dim)), rnd.normal(0, 200, (60, dim)), centre[None], np.zeros((1, dim)))))
    q = np.floor(np.concatenate((rnd.normal(0, 100, (40, dim)), x[:20], np.zeros((1, dim)))))
    least, most = negatives.Codes(x, centre).intervals(q)
    assert (least <= q @ x.T).all() and (q @ x.T <= most).all()


def test_rows_far_from_a_query_are_left_out_by_their_intervals():
    rnd = np.random.default_rng(5)
    q = np.floor(rnd.normal(0, 100, (1, 64)))
    x = np.floor(np.concatenate((rnd.normal(0, 5, (450, 64)), q + rnd.normal(0, 20, (50, 64)))))
    least, most = negatives.Codes(x, np.zeros(64)).intervals(q)
    left = most >= negatives.largest(least, 5)
    assert left[0, 450:].all() and left.mean() < 0.2


def table(rnd, n, dim=8, labels=10):
    rows = []
    for i in range(n):
        spread = rnd.choice([0.02, 0.5])
        rows.append((i, rnd.randrange(labels), [(1.0 if k == i % 5 else 0.0) + rnd.gauss(0, spread) for k in range(dim)]))
    return rows


SCHEMA = "vec_id long, label int, embedding array<double>"


def test_rows_equal_sql_and_all_pairs(spark, tmp_path):
    rnd = random.Random(1)
    rows = table(rnd, 700)
    rows += [rows[100], rows[100], (200, 3, rows[5][2]), (300, None, rows[1][2]), (None, 1, rows[2][2]), (901, 1, None), (902, 2, [None] * 8), (903, 3, [math.nan] * 8), (904, 3, [math.inf] * 8), (905, 4, [])]
    rows += [(1000 + i, 5, rows[400][2]) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cell int, dim string").repartition(3)
    want = plainly(rows)
    assert len(want) > 100 and told(negatives.mine(df)) == want
    assert told(negatives.mine(df, cell_rows=9, block_rows=3)) == want
    df.select("vec_id", "label", "embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connection("/nowhere")
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert same(negatives.mine(df), con, negatives.ORACLE) == len(want)


def test_other_lengths_and_large_components(spark):
    rnd = random.Random(2)
    rows = table(rnd, 120) + [(i + 200, i % 3, [rnd.gauss(0, 1)] * 3) for i in range(101)]
    rows += [(1000 + 50 * i, i % 2, [rnd.uniform(0.5, 1) * 1e12 for _ in range(8)]) for i in range(12)] + [(2000 + 50 * i, i % 2, [rnd.choice([1e40, 1e300, -1e18]), 1.0]) for i in range(12)]
    assert told(negatives.mine(spark.createDataFrame(rows, SCHEMA))) == plainly(rows)


def test_hot_vector_and_label(spark):
    rnd = random.Random(4)
    rows = table(rnd, 200) + [(i, 1, [0.5] * 8) for i in range(1000, 1400)]
    assert told(negatives.mine(spark.createDataFrame(rows, SCHEMA), cell_rows=50)) == plainly(rows)


def test_no_rows(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0])], SCHEMA)).collect() == []
