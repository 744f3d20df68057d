"""Near copies against brute-force Jaccard."""

import random

from pyspark.sql import functions as F

from eventloom.llm import copies, simhash


def jaccard(a, b):
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def groups(texts, least):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def test_one_of_each_equals_brute_force_jaccard(spark):
    rnd, texts = random.Random(3), []
    for _ in range(40):
        base = [f"w{rnd.randint(0, 99999)}" for _ in range(rnd.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            words = [f"x{rnd.randint(0, 99999)}" if rnd.random() < rnd.choice((0.01, 0.02, 0.03, 0.05)) else w for w in base]
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups(texts, 0.8)
    assert {r.doc_id for r in copies.one_of_each(docs).collect()} == want and 40 < len(want) < 120


def test_a_large_group_is_joined_through_its_members(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):  # every text has its own four changed words, so many pairs are under 0.8, but chains join them
        words = list(base)
        for at in range(0, 4):
            words[(i * 3 + at * 7) % 200] = f"v{(i + at) // 3}"
        texts.append(" ".join(words))
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in copies.one_of_each(docs).collect()} == groups(texts, 0.8)


def test_texts_meet_at_the_anchors_of_their_fingerprints(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 99999)}" for _ in range(600)]
    print_of = lambda words: simhash.fingerprint_of(copies.shingles([w.encode() for w in words]))
    changed = [[*base[:-k], *(f"y{i}" for i in range(k))] for k in range(1, 40)]
    near = next(c for c in changed if bin((print_of(c) ^ print_of(base)) & (1 << 64) - 1).count("1") == 3)
    texts = [" ".join(base), " ".join(near), " ".join(f"x{rnd.randint(0, 99999)}" for _ in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = copies.signatures(docs).withColumn("bands", F.array().cast("array<long>"))  # so that anchors alone can join
    key = {r.doc_id: (bytes(r.key), r.fp) for r in prints.collect()}
    assert bin((key[0][1] ^ key[1][1]) & (1 << 64) - 1).count("1") == 3
    assert {bytes(r.node): bytes(r.root) for r in copies.near_copies(docs, prints).collect()} == {key[i][0]: min(key[0][0], key[1][0]) for i in (0, 1)}


def test_a_crowded_fingerprint_costs_one_pair_a_text(spark):
    rows = [(bytes([i]), 7) for i in range(50)] + [(bytes([50]), 6), (bytes([51]), -1)]
    got = {(r.u[0], r.v[0]) for r in copies.anchored(spark.createDataFrame(rows, "key binary, fp long")).collect()}
    assert got == {(0, i) for i in range(1, 51)}
