"""Scores and shares worked out by plain Python from the same definitions."""

import math
import random
from collections import Counter

import pytest

from eventloom.llm import pii, quality


def test_quality_scores_equal_the_rules_by_hand(spark):
    rnd = random.Random(0)
    text = lambda ok: " ".join(rnd.choice(["tree", "River", "stone,", "and", "the", "cloud."]) if ok else rnd.choice(["$$$ BUY!!", "WIN!! ***", "the", "tree"]) for _ in range(rnd.randint(1, 60)))
    marks = [(i, int(rnd.random() < 0.6)) for i in range(400)]
    rows = [(i, text(q)) for i, q in marks] + [(9001, None), (9002, ""), (9003, "a\n\na\nB 1 #")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    stats = quality.statistics(docs)
    model = quality.fit(stats, labels)
    assert model.weighted and any(len(rule) > 1 for rule, _ in model.weighted)
    got = {r.doc_id: r.score for r in stats.select("doc_id", model.score().alias("score")).collect()}
    for i, t in rows:
        x = quality.statistics_of(t)
        total = model.intercept
        for rule, weight in model.weighted:
            if all(x[at] <= bound if most else x[at] > bound for at, most, bound in rule):
                total += weight
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_disclosure_shares_and_spans_equal_plain_python(spark):
    rnd = random.Random(6)
    people = [f"p{k}@{'xy'[k % 2]}.example" for k in range(6)]
    words = [f"word{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(120):
        parts = [rnd.choice(words) for _ in range(rnd.randint(0, 9))]
        if rnd.random() < 0.5:
            k = rnd.randrange(6)
            parts.insert(rnd.randint(0, len(parts)), people[k])
            parts.append(f"secret{'abcdef'[k]}")
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, ""), (3, "secreta alone"), (None, "wordb wordc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    texts = [t or "" for _, t in rows]
    spans = [pii.base_spans(t) for t in texts]
    held = [{(f"{k}:{t[a:b]}", k) for a, b, k in s} for t, s in zip(texts, spans)]
    terms = [{m[0].lower() for m in pii._TERM.finditer(t)} for t in texts]
    free = [{w for _, w, _, _ in pii.context(t, s, 10**6)} if s else set() for t, s in zip(texts, spans)]
    n_rows, n_term = len(rows), Counter(w for x in terms for w in x)
    near = {(e, w) for t, s in zip(texts, spans) for e, w, _, _ in pii.context(t, s)}
    share = {}
    for e, w in near:
        g, kind = pii.group_of(e), e.partition(":")[0]
        has = lambda test: sum(any(test(x) for x, _ in h) for h in held)
        with_w = lambda test: sum(w in f and any(test(x) for x, _ in h) for f, h in zip(free, held))
        in_e, in_g, in_k = (lambda x: x == e), (lambda x: pii.group_of(x) == g), (lambda x: x.startswith(kind))
        n, be, bg, bk = n_term[w], with_w(in_e), with_w(in_g), with_w(in_k)
        p_k = (bk - bg + has(in_k) / n_rows) / (n - bg + 1)
        p_g = (bg - be + p_k * has(in_g) / has(in_k)) / (n - be + 1)
        p = min(1.0, (be + p_g * has(in_e) / has(in_g)) / (n + 1))
        share[e, w] = 1 + math.log(p) / math.log(n_rows / has(in_e))
    flagged = {k: v for k, v in share.items() if v >= pii.GENERALISE}
    everywhere = {w: max(v for (_, x), v in flagged.items() if x == w) for _, w in flagged}
    everywhere = {w: v for w, v in everywhere.items() if v >= pii.REMOVE}
    assert flagged and any(w.startswith("secret") for _, w in flagged)
    got = {(r.doc_id, tuple(r.base)): sorted((s.start, s.end, s.removed) for s in r.terms) for r in pii.sensitive(docs).collect() if r.terms}
    want = {}
    for (i, _), t, s, h in zip(rows, texts, spans, held):
        found = {}
        for m in pii._TERM.finditer(t):
            if any(m.start() < b and a < m.end() for a, b, _ in s):
                continue
            w = m[0].lower()
            best = max([flagged.get((e, w), 0) for e, _ in h] + [everywhere.get(w, 0)], default=0)
            if best >= pii.GENERALISE:
                found[m.span()] = best >= pii.REMOVE
        if found:
            want[i] = sorted((a, b, gone) for (a, b), gone in found.items())
    assert {k[0]: v for k, v in got.items()} == want
