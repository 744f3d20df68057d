"""What Spark would size by what went in, though far more comes out, is not broadcast."""

import random

from eventloom.llm import copies, simhash


def test_fingerprints_at_anchors_are_not_broadcast(spark):
    rnd = random.Random(3)
    prints = [rnd.getrandbits(63) for _ in range(200)]
    prints += [x ^ 1 << 5 ^ 1 << 40 for x in prints[:20]]
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"))
    assert {(r.u, r.v) for r in found.collect()} >= {tuple(sorted((x, x ^ 1 << 5 ^ 1 << 40))) for x in prints[:20]}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_copies_broadcast_nothing_that_python_made_many_rows_of(spark):
    rnd = random.Random(4)
    rows = [(str(i).encode(), rnd.getrandbits(63)) for i in range(200)]
    rows += [(b"x" + key, fp ^ 1 << 7) for key, fp in rows[:20]] + [(b"y" + key, fp) for key, fp in rows[:20]]
    found = copies.anchored(spark.createDataFrame(rows, "key binary, fp long"))
    assert len(found.collect()) == 40
    lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    assert any("MapInArrow" in line for line in lines)
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            assert not any("MapInArrow" in x for x in lines[i:below]) or any("SortMergeJoin" in x for x in lines[i:below])
