import random

import numpy as np
import xxhash

from eventloom.llm import components, simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint_equals_the_definition(spark):
    rnd = random.Random(0)
    texts = ["", None, "one", "One two", "a\tb\nC", "É é É É", "  x  y  z  ", "long " * 3000] + [" ".join(rnd.choice("ab AB Ää \x1f\x85 c d".split(" ")) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t), repr(t)


def test_golay_code_is_perfect():
    leaders = simhash._leaders()
    assert len(set(leaders.tolist())) == 2048 and all(bin(x).count("1") <= 3 for x in leaders.tolist())
    v = np.random.default_rng(0).integers(0, 1 << 23, 1000)
    assert (simhash._remainder(v ^ leaders[simhash._remainder(v)]) == 0).all()


def test_links_equal_brute_force(spark):
    rnd = random.Random(1)
    prints = [rnd.getrandbits(64) for _ in range(60)]
    for p in prints[:30]:
        for _ in range(4):
            q = p
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                q ^= 1 << b
            prints.append(q)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want and want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (8, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + k: 100 for k in range(40)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_with_odd_rows(spark):
    rnd = random.Random(2)
    base = " ".join(f"w{rnd.randint(0, 999)}" for _ in range(400))
    near = base.replace(" w1", " w1", 1) + " tail"
    rows = [(5, base, "x"), (3, base, "x"), (3, base, "x"), (9, near, "x"), (None, base, "x"), (7, None, "x"), (2, "", "x"), (8, "quite another text here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (2, 2), (3, 3), (3, 3), (5, 3), (7, 2), (8, 8), (9, 3)]
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [2, 3, 8]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [None, None]
    assert simhash.one_of_each(docs).count() == 1
