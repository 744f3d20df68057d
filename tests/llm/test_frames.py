"""Near copies among texts that share a frame: pairs in proportion to the texts, none lost."""

import random

import pytest

from eventloom.llm import copies


def sets_of(spark, texts):
    return spark.createDataFrame([(str(i).encode(), len(s), s) for i, s in enumerate(texts)], "key binary, n long, set array<long>")


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("seed", range(3))
def test_no_similar_pair_is_left_out(spark, seed):
    rnd = random.Random(seed)
    base = [rnd.sample(range(10**6), rnd.choice([1, 4, 5, 20, 60])) for _ in range(6)]
    texts = []
    for _ in range(70):
        b = rnd.choice(base)
        texts.append(sorted({x for x in b if rnd.random() > rnd.choice([0, 0.05, 0.1])} | {rnd.randrange(10**6, 10**7) for _ in range(rnd.choice([0, 1, 3]))}) or [7])
    rows = spark.createDataFrame([(str(i).encode(), str(i % 60).encode()) for i in range(len(texts))], "key binary, root binary")
    got = {tuple(sorted((int(r.u), int(r.v)))) for r in copies.rare_pairs(rows, sets_of(spark, texts)).collect()}
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if jaccard(texts[i], texts[j]) >= 0.8 and i % 60 != j % 60}
    assert want <= got and all(i % 60 != j % 60 for i, j in got)


def test_texts_of_one_frame_make_no_pairs(spark):
    rnd = random.Random(1)
    frame = rnd.sample(range(10**6), 300)
    for n in (50, 200):
        texts = [sorted(frame + rnd.sample(range(10**6, 10**9), 64)) for _ in range(n)]
        rows = spark.createDataFrame([(str(i).encode(), str(i).encode()) for i in range(n)], "key binary, root binary")
        assert copies.rare_pairs(rows, sets_of(spark, texts)).count() == 0


def test_copies_of_an_original_come_together_by_it(spark):
    rnd = random.Random(2)
    original = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(original)]
    for _ in range(60):
        words = original[:]
        for at in rnd.sample(range(400), 7):
            words[at] = f"x{rnd.randrange(10**9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "apart from all others stands this text of its own")], "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.one_of_each(docs).collect()) == [0, 99]
