"""Components against a plain union of links, and what the steps of near copies join."""

import random

import pytest

from eventloom.llm import common, components, copies


def plain(links):
    """{node: least node that it reaches}."""
    root = {x: x for link in links for x in link}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_equal_a_plain_union(spark, kind):
    rnd = random.Random(6)
    names = rnd.sample(range(1 << 20), 500)
    links = [tuple(rnd.sample(names[:200], 2)) for _ in range(150)]  # many small components
    links += list(zip(names[200:300], names[201:301])) + [(names[300], x) for x in names[300:400]]  # a chain in no order, a star
    links += [(names[400 + i], names[400 + (i * i + 1) % 100]) for i in range(100)] + links[:20] + [(v, u) for u, v in links[20:40]]
    of = (lambda x: x.to_bytes(3, "big")) if kind == "binary" else int
    rows = [(of(u), of(v)) for u, v in links]
    got = components.components(spark.createDataFrame([*rows, (None, rows[0][0]), (rows[0][0], None)], f"u {kind}, v {kind}")).collect()
    assert {r.node: r.root for r in got} == plain([r for r in rows if r[0] != r[1]]) and len(got) == len({r.node for r in got})


def test_a_star_takes_one_round(spark, monkeypatch):
    names = []
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or common.written(df, name))
    links = spark.createDataFrame([(500, i) for i in range(1000) if i != 500], "u long, v long")
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(i, 0) for i in range(1000)}
    assert names.count("components") == 2  # the links, and that none is left


def test_later_steps_join_only_what_is_apart(spark, monkeypatch):
    rnd, texts = random.Random(7), []
    for size in (900, 400, 60, 25):
        base = [f"w{rnd.randint(0, 99999)}" for _ in range(size)]
        for _ in range(30):
            words = list(base)
            for at in rnd.sample(range(size), max(1, size % 900 // 50)):
                words[at] = f"x{rnd.randint(0, 99999)}"
            texts.append(" ".join(words))
    given = []

    def noted(links):
        given.append([(bytes(r.u), bytes(r.v)) for r in links.collect()])
        return components.components(links)

    monkeypatch.setattr(copies, "components", noted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = copies.signatures(docs)
    tables = common.made()
    roots = {bytes(r.node): bytes(r.root) for r in copies.near_copies(docs, prints).collect()}
    assert common.made() == tables + 1
    before = []
    for links in given:
        known = plain(before)
        assert not [1 for u, v in links if known.get(u, u) == known.get(v, v)]
        before += links
    assert roots == plain(before) and sum(map(bool, given)) > 1


def test_verified_pairs_keep_their_other_columns(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join(words[:50])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = copies.signatures(docs)
    sets = copies.sets_of(docs, prints.select("row"))
    key = {r.doc_id: r.key for r in prints.collect()}
    pairs = spark.createDataFrame([(key[0], key[1], 1), (key[0], key[2], 2)], "u binary, v binary, no int")
    assert [(r.u, r.v, r.no) for r in copies.verified(pairs, sets).collect()] == [(key[0], key[1], 1)]
    assert copies.verified(pairs.select("u", "v"), sets).columns == ["u", "v"]
