"""A search holds a bounded number of scores, and nothing afterwards."""

import gc
import tracemalloc

import numpy as np
import pytest

from eventloom.llm import topk


def brute(x, q_ids, y, ids, k):
    scores = x @ y.T
    out = []
    for row, own in zip(scores, q_ids):
        best = sorted((-s, i) for s, i in zip(row.tolist(), ids.tolist()) if i != own)[:k]
        out.append([(i, -s) for s, i in best] + [(np.iinfo(np.int64).max, -np.inf)] * (k - len(best)))
    return out


def test_rows_far_from_each_other_are_compared_in_parts():
    n = 1024
    x = 256 * np.eye(n)  # all equally far apart: one leaf
    tracemalloc.start()
    scores, ids = topk.search(x, np.arange(n), x, np.arange(n))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60  # the distances of either side are 8 MB, and so are the rows
    assert not scores.any() and (ids[7] == [0, 1, 2, 3, 4]).all() and (ids[1] == [0, 2, 3, 4, 5]).all()


def test_a_search_leaves_nothing_behind():
    rnd = np.random.default_rng(1)
    x, y = (np.floor(256 * (v / np.linalg.norm(v, axis=1, keepdims=True))) for v in (rnd.normal(size=(600, 16)), rnd.normal(size=(600, 16))))
    gc.collect()
    gc.disable()
    try:
        tracemalloc.start()
        scores, ids = topk.search(x, np.arange(600), y, np.arange(600))
        kept = tracemalloc.get_traced_memory()[0] / 1e6
        tracemalloc.stop()
    finally:
        gc.enable()
    assert kept < 0.5  # the distances of one side are 2.9 MB
    assert [list(zip(i, s)) for i, s in zip(ids.tolist(), scores.tolist())] == brute(x, np.arange(600), y, np.arange(600), topk.K)


@pytest.mark.parametrize("many", [3, 5, 6, 40])
def test_equal_scores_and_few_rows_keep_the_smaller_ids(many, monkeypatch):
    monkeypatch.setattr(topk, "AT_ONCE", 64)
    rnd = np.random.default_rng(many)
    y = rnd.integers(-1, 2, (many, 3)).astype(float)
    ids = rnd.permutation(many) + 7
    x, own = np.concatenate((y, y[:2])), np.concatenate((ids, [1000, 1001]))
    scores, found = topk.search(x, own, y, ids)
    assert [list(zip(i, s)) for i, s in zip(found.tolist(), scores.tolist())] == brute(x, own, y, ids, topk.K)
