"""The pipeline's stages against plain Python, on the smallest documents."""

import hashlib
import os
import re
from collections import Counter

import pytest

from eventloom.llm import pieces, pii, quality

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def smallest_of_groups(docs):
    """The smallest id of each group that links of five-word Jaccard 0.8 or more join."""
    words = {i: (t or "").encode().lower().split() for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in words.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def plain_mix(docs):
    """How often each document is taken: {id: (text, source)} in, by one sorted queue."""
    size = {i: len([w for w in re.split("[\x20\x09-\x0d]+", t) if w]) for i, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values()})
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    own = Counter()
    for i, (_, s) in docs.items():
        own[s] += size[i]
    key = {i: int(hashlib.md5(f"{i}/{t}".encode()).hexdigest()[:15], 16) for i, (t, _) in docs.items()}
    queue = []
    for s in sources:
        done = 0
        for i in sorted((i for i in docs if docs[i][1] == s), key=lambda i: (key[i], i, size[i])):
            done += size[i]
            queue += [((e * own[s] + done) / weight[s], sources.index(s), e, key[i], i, size[i]) for e in range(3)]
    taken, total = Counter(), 0
    for item in sorted(queue):
        total += item[5]
        if total > sum(size.values()):
            break
        taken[item[4]] += 1
    return Counter({i: n for i, n in taken.items() if size[i]})


def test_every_stage(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, every = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = {}
    for name, stage in c.STAGES:
        docs = c.written(stage(spark, docs, DATA), "test-stage")
        assert (docs.columns == columns) == (name != "tokens")
        out[name] = docs.collect()
    assert {r.doc_id for r in out["quality"]} == good and sum(labels.get(i) == 1 for i in set(every) - good) <= 2
    kept = {r.doc_id for r in out["near-duplicates"]}
    assert kept == smallest_of_groups({i: every[i] for i in good}) and len(out["near-duplicates"]) == len(kept)
    clean = {r.doc_id: r for r in out["personal data"]}
    assert set(clean) == kept
    for i, r in clean.items():
        assert r.text == every[i] or pii.base_spans(every[i])
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    assert Counter(r.doc_id for r in out["mix"]) == plain_mix({i: (r.text, r.source) for i, r in clean.items()})
    if os.path.exists(pieces.MODEL):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
        assert len(out["tokens"]) == len(out["mix"])
        for r in out["tokens"]:
            assert list(r.ids) == lib.encode(clean[r.doc_id].text)
    assert Counter(r.doc_id for r in c.run(spark, DATA).collect()) == Counter(r.doc_id for r in out["tokens"])
