import hashlib
import html
import itertools
import json
import math
import random
import re
import time
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import languages, licenses, media, mixing, pii, quality, topk, urls
from tests.compare import connection, same


def views(tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = connection("/nowhere")
    for name in tables:
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    return con


# mixing


def test_mixing_equals_sql_and_keeps_its_bounds(spark, tmp_path):
    rnd = random.Random(0)
    rows = [(i, rnd.choice(["a", "b", "Z", "é", None]) if i % 3 else "hot", " ".join(["w"] * rnd.randint(0, 9)), i) for i in range(900)]
    rows += [(1000, "a", None, 1), (1001, "a", "", 1), (None, "b", "x y", 1), (1002, "b", " \t\x0b ", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size long")
    got = mixing.mix(docs)
    assert same(got.select("doc_id", "size", "source_size", "target", "taken"), views(tmp_path, documents=docs), mixing.ORACLE) == 904
    per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("own")).collect()
    for r in per:
        assert abs(r.taken - r.target) <= 27 and r.target <= 3 * r.own
    assert sum(r.target for r in per) == pytest.approx(sum(r.own for r in per))
    again = mixing.mix(docs.repartition(7)).groupBy().sum("taken").first()[0]
    assert again == sum(r.taken for r in per)
    assert mixing.mixed(docs.where("doc_id < 1000")).count() == got.where("doc_id < 1000 and size > 0").agg(F.sum("times")).first()[0]


def test_texts_without_words_do_not_queue_and_repeated_ids_differ(spark):
    rows = [(None, "a", "x " * k) for k in range(1, 40)] + [(7, "b", "y " * k) for k in range(1, 40)] + [(k, "empty", None) for k in range(50)] + [(k, "a", "") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r.taken == 0 for r in got if not r.size) and {r.target for r in got if r.source == "empty"} == {0.0}
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    targets = {r.source: r.target for r in got}
    assert all(abs(taken[s] - targets[s]) <= 120 for s in "ab") and all(r.taken <= 3 * r.size for r in got)
    assert mixing.sized(df).where("size > 0").select("key").distinct().count() == 78


def test_mixing_nothing(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.mix(docs).collect()] == [0, 0]
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed(docs).count() == 0


# personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    for _ in range(30000):
        t = "".join(rnd.choice("ab1.@- +%(2\né") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)
    for _ in range(5000):
        t = "".join(rnd.choice("0123456789 -.+") for _ in range(rnd.randint(10, 60)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def test_disclosing_terms(spark):
    rows = [(i, f"common words here write zanzibar to me{'' if i % 2 else ' now'} a.b@c.example about it") for i in range(4)]
    rows += [(10 + i, "common words here and about it without anything") for i in range(40)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    got = {r.doc_id: r for r in pii.described(pii.sensitive(docs)).collect()}
    assert len(got) == 46
    text = rows[0][1]
    a, b = text.index("zanzibar"), text.index("a.b@")
    assert f"term:{a}:{a + 8}" in got[0].spans and f"email:{b}:{b + 13}" in got[0].spans and "term" not in got[10].spans
    assert got[0].base_sha256 == hashlib.sha256(f"email:{b}:{b + 13}".encode()).hexdigest()
    assert got[60].spans == got[61].spans == "" and got[60].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r for r in pii.sanitise(docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert "zanzibar" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[10].text == rows[4][1] and clean[60].text is None and len(clean) == 46
    assert pii.sensitive(docs.where("false")).count() == 0


def test_repeated_ids_keep_their_own_spans(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc"), (1, "mail a@b.cc"), (1, "ip 1.2.3.4"), (None, "x a@b.cc")], "doc_id long, text string")
    assert sorted(r.spans for r in pii.described(pii.sensitive(docs)).collect()) == ["email:2:8", "email:5:11", "email:5:11", "ip:3:10"]


# media


def test_media_round_trip(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5000), (5, "abc"), (6, "x" * 192)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(0))
    got = {r.doc_id: r for r in media.described(media.text_media(docs)).collect()}
    for i, t in rows:
        n, data = media.payload(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])) and len(data) % 192 == 0 and len(data)
        assert len(r.feature) == 16
    assert got[1].media_sha256 == got[5].media_sha256 and got[2].media_sha256 == got[3].media_sha256
    assert media.text_media(docs.where("false")).count() == 0


def test_a_null_media_has_nulls(spark):
    files = spark.createDataFrame([(1, None), (2, bytearray(b"P9 broken")), (3, bytearray(b"P6 1 1 255\nabc"))], "doc_id long, image binary")
    kept = media.tiles(files).withColumn("n_bytes", F.lit(None).cast("long")).select("doc_id", "n_bytes", "media")
    got = {r.doc_id: (r.media_bytes, r.feature) for r in media.described(kept).collect()}
    assert got[1] == got[2] == (None, None) and got[3][0] > 0


def test_difference_hash_equals_plain_means():
    rnd = np.random.default_rng(5)
    for h, w in ((8, 9), (24, 18), (5, 8), (300, 8)):
        x = rnd.integers(0, 256, (h, w, 3), np.uint8)
        big = x.astype(float).mean(axis=2).repeat(8, 0).repeat(9, 1)  # each target area is h x w of these
        mean = big.reshape(8, h, 9, w).mean(axis=(1, 3))
        bits = "".join(str(int(a > b)) for row in mean for a, b in zip(row, row[1:]))
        got = bin(int(media.difference_hash(x), 16))[2:].zfill(64)
        close = sum(abs(a - b) < 1e-9 for row in mean for a, b in zip(row, row[1:]))
        assert sum(p != q for p, q in zip(bits, got)) <= close


def test_pictures_of_every_kind(spark):
    want = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    ppm = b"P6 # note\n4 2\n255\n" + want.tobytes()
    assert (media.decode(ppm) == want).all() and (media.decode(b"P3 4 2 255 " + " ".join(map(str, want.ravel())).encode()) == want).all()
    assert (media.decode(b"P5 4 2 255\n" + want[..., 0].tobytes())[..., 0] == want[..., 0]).all()
    assert media.decode(b"P1 3 1 1 0 1").ravel().tolist() == [0, 255, 0] and media.decode(b"P4 3 1 \xa0").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P5 1 1 1000\n\x03\xe8").ravel().tolist() == [1000]
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54, 40, 4, 2, 1, 24, 0, 0, 0, 0, 0, 0)
    assert (media.decode(head + want[::-1, :, ::-1].tobytes()) == want).all()
    tiles = media.from_npy(media.to_npy(want))
    assert tiles.shape == (1, 8, 8, 3) and (tiles[0, :2, :4] == want).all()
    df = spark.createDataFrame([(1, bytearray(ppm)), (2, bytearray(b"junk")), (3, None), (4, bytearray(b"P6 9 9 255\n"))], "doc_id long, image binary")
    assert {r.doc_id: r.media is not None for r in media.tiles(df).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_area_resize_equals_brute_force():
    x = np.random.default_rng(0).integers(0, 255, (7, 5, 2)).astype(np.uint8)
    big = x.repeat(3, 0).repeat(4, 1).astype(float)
    want = big.reshape(3, 7, 4, 5, 2).mean(axis=(1, 3))
    assert np.allclose(media.resize(x, 3, 4), want)


# licenses


def test_license_scan(spark):
    t = {k: v for k, v in reversed(licenses.TEMPLATES) if not v.startswith("SPDX")}
    full = next(v for k, v in licenses.TEMPLATES if k == "MIT" and len(v) > 500)
    wrapped = "# " + full.replace(". ", ".\n# ").replace("without ", "without\n# ")
    files = [
        (1, "repo/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + full, 0), (2, "repo/a.py", "code only", 0),
        (3, "repo/sub/b.py", "code\n" + t["Apache-2.0"] + "\nmore " + "words " * 90, 0), (4, "repo/sub/deep/c.py", "x", 0), (5, "repo/sub/COPYING", t["GPL-3.0"], 0), (6, "other/d.py", None, 0),
        (7, None, "", 0), (8, "repo/sub/deep/c.py", "x", 0), (9, "repo/sub/e", "this license text says nothing known", 0), (10, "c/h.c", wrapped + "\n\nint main() { return 0; }", 0),
        (11, "s/x.py", "# SPDX-License-Identifier: MIT\nimport os", 0), (12, "s/y.py", "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", 0), (13, "s/z.py", "# SPDX-License-Identifier: No-Such-1.0", 0),
        (14, "r/LICENSE.txt", t["MIT"] + "\n\n" + full, 0), (15, "r/f", "beside it", 0), (16, "p/long.txt", "word " * 300 + "\n" + t["MIT"], 0), (17, "p/f", "not granted by a file that only mentions it", 0),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string, license int")
    got = {r.doc_id: (r.license, r.origin, r.directory) for r in licenses.scan(df, licenses.template_table(spark)).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "repo"), 3: ("Apache-2.0", "own", None), 4: ("GPL-3.0", "inherited", "repo/sub"), 5: ("GPL-3.0", "own", None), 6: (None, "none", None), 7: (None, "none", None),
        8: ("GPL-3.0", "inherited", "repo/sub"), 9: ("GPL-3.0", "inherited", "repo/sub"), 10: ("MIT", "own", None), 11: ("MIT", "own", None), 12: ("GPL-3.0", "own", None), 13: (None, "none", None), 14: ("MIT", "own", None),
        15: ("MIT", "inherited", "r"), 16: ("MIT", "own", None), 17: (None, "none", None),
    }
    assert licenses.scan(df.where("false"), licenses.template_table(spark)).count() == 0
    assert {r.origin for r in licenses.scan(df, licenses.template_table(spark).where("false")).collect()} == {"none"}
    own = licenses.template_table(spark, [("WTF", "do what you want to with this code")])
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame([(1, "a/COPYING", "Do what you want to with this code"), (2, "a/b", "x")], "doc_id long, path string, text string"), own).collect()}
    assert found == {1: "WTF", 2: "WTF"}


def test_license_cosines_equal_sql_without_the_filter(spark, tmp_path):
    rnd = random.Random(1)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["tree", "river", "stone.", "cloud"] * 60
    say = lambda: rnd.choice([lambda: rnd.choice(licenses.TEMPLATES)[1], lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))), lambda: "Released under the the MIT MIT License."])()
    rows = [(i, rnd.choice(["", "a/", "a/b/", "a/b/c/"]) + rnd.choice(["LICENSE", "f.py", "g.txt"]), rnd.choice(["\n", "\n\n", " ", "\n# \n"]).join(say() for _ in range(rnd.randint(0, 4)))) for i in range(150)] + [(900, None, None), (901, "a/x", ""), (3, "a/y", None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    few = licenses.TEMPLATES[::4]
    con = views(tmp_path, files=df)
    assert same(licenses.scan(df, licenses.template_table(spark, few)), con, licenses.oracle("select * from files", few)) == len(rows)


# quality


def test_quality_learns_only_from_its_share(spark):
    rnd = random.Random(0)
    text = lambda ok: " ".join(rnd.choice(["tree", "River", "stone,", "and", "the", "cloud."]) if ok else rnd.choice(["$$$ BUY!!", "WIN!! ***", "### ###"]) for _ in range(rnd.randint(5, 60)))
    marks = [(i, int(rnd.random() < 0.6)) for i in range(600)]
    docs = spark.createDataFrame([(i, text(q), "zz") for i, q in marks] + [(9001, None, "x"), (9002, "", "x"), (None, "odd", "x")], "doc_id long, text string, upper string")
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in marks}
    lie = [(i, 1 - q if out[i] else q, 0) for i, q in marks]
    labels = spark.createDataFrame(lie, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == out[i] for i, _ in marks)
    held = [i for i, _ in marks if out[i]]
    assert sum(got[i].predicted == dict(marks)[i] for i in held) / len(held) > 0.95
    bad = labels.where("quality = 0").count() - 0
    assert bad and quality.good(docs, labels).columns == docs.columns


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, labels).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (1, 7)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in quality.classify(docs, one).collect())
    assert quality.classify(docs.where("false"), one).count() == 0


# urls


def test_urls_equal_plain_rules(spark, tmp_path):
    rnd = random.Random(0)
    hosts = ["org", "example.org", "spam.example.org", "badexample.org", "com", "a.com", "", "x.net", "EXAMPLE.org", "org.", "a..org", "example.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a#b", "/de/", "/de/?q", "?/es/", "#x", "/ES/"]
    rows = [(i, rnd.choice(["http://", "HTTPS://", "://", "", "a://b://"]) + rnd.choice(hosts) + rnd.choice(paths)) for i in range(700)] + [(900, None), (901, ""), (1, "http://org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    assert same(urls.judge(pages, urls.rule_table(spark)), views(tmp_path, pages=pages), urls.ORACLE) == 703
    assert urls.judge(pages.where("false"), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judge(pages, urls.rule_table(spark, [("block", "", "/")]), default="allow").collect()} == {"allow"}


def test_many_nested_rules(spark):
    rnd = random.Random(3)
    label = lambda: rnd.choice("abc")
    host = lambda: ".".join(label() for _ in range(rnd.randint(1, 4)))
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in ((host(), rnd.choice(["/", "/x", "/xy"])) for _ in range(40))}.values())
    pages = [(i, f"h://{host()}{rnd.choice(['/', '/x', '/xyz', ''])}") for i in range(400)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark, rules)).collect()}
    for i, u in pages:
        h, _, p = u[4:].partition("/")
        p = "/" + p if "/" in u[4:] else ""
        fit = [(len(a + b), a + b, act) for act, a, b in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fit)[0] if fit else None
        assert got[i] == (None, "allow") if best is None else got[i] in [(r, a) for n, r, a in fit if n == best]


def test_thousands_of_path_rules_on_one_host(spark):
    rnd = random.Random(4)
    path = lambda n: "/" + "".join(rnd.choice("ab/é") for _ in range(n))
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in ((rnd.choice(["big.example", "example", "w.big.example"]), path(rnd.randint(0, 9))) for _ in range(4000))}.values())
    pages = [(i, f"http://{rnd.choice(['big.example', 'w.big.example', 'x.w.big.example', 'other'])}{path(rnd.randint(0, 12))}?q") for i in range(1500)]
    table = spark.createDataFrame([*rules, (None, "x", "/"), ("block", None, "/"), ("block", "x", None)], "action string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), table, default="none", salts=4).collect()}
    by = {(h, p): a for a, h, p in rules}
    for i, u in pages:
        h, _, p = u[7:-2].partition("/")
        p = "/" + p
        fit = [(len(x + p[:n]), x + p[:n], by[x, p[:n]]) for x in (h.split(".", k)[-1] for k in range(4)) for n in range(len(p) + 1) if (x, p[:n]) in by]
        assert got[i] == (max(fit)[1:] if fit else (None, "none"))


# top k


def test_top_k_equals_brute_force(spark, tmp_path):
    rnd = np.random.default_rng(0)
    centre = rnd.normal(size=(6, 16)) * 0.2
    x = np.concatenate([centre[rnd.integers(0, 6, 900)] + rnd.normal(size=(900, 16)) * 0.02, np.repeat(centre[:1], 300, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [None] * 16), (5050, [float("nan")] + [0.0] * 15), (5100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit(1)).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert same(topk.top_k(df), views(tmp_path, embeddings=df), topk.ORACLE) == 24 * 5
    assert topk.top_k(df.where("vec_id < 3")).count() == 2 and topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, []), (3, [0.5])], "vec_id long, embedding array<double>")).count() == 1


def brute_top(rows, k=5, every=50, scale=256):
    """By whole numbers of any length; scores beyond a long become the nearest long."""
    whole = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows]
    out = {}
    for q in {i for i, _ in whole if i % every == 0}:
        asked = {tuple(v) for i, v in whole if i == q}
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), n) for v in asked for n, w in whole if n != q and len(w) == len(v))
        out |= {(q, r + 1): (n, -s) for r, (s, n) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_top_k_over_many_cells_with_big_components_and_repeated_ids(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "CELL_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    monkeypatch.setattr(topk, "SAMPLE", 100)
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(12, 8))
    rows = [(i, (centre[rnd.integers(0, 12)] + rnd.normal(size=8) * spread).tolist()) for i in range(1500)]
    rows += [(50, rows[7][1]), (50, rows[50][1]), (100, [x * 1e6 for x in rows[3][1]]), (2001, [1e30] * 8), (2002, [-1e30, 1e-30] * 4), (2050, [1e300] * 8), (2100, [0.5] * 3), (2101, [-1e-20] * 3), (2102, [0.25, -0.25, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute_top(rows)


def test_blocks_meet_only_cells_that_can_hold_better_rows(spark, monkeypatch):
    met = []
    monkeypatch.setattr(topk, "CELL_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rnd = np.random.default_rng(4)
    centre = np.eye(16)
    rows = [(i, (centre[i % 16] + rnd.normal(size=16) * 0.01).tolist()) for i in range(1600)]
    create = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: (met.append(len(data)) if schema == "block int, cell int, parts int" else None) or create(data, schema, **k))
    df = create(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df).collect()}
    assert got == brute_top(rows) and met[-1] <= 64  # of some 4 x 25 pairs


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(size=(500, 8)).round(2)
    x[100:200] = x[0]
    seen = []

    def walk(node):
        assert np.linalg.norm(x[node.rows] - x[node.at], axis=1).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(itertools.chain.from_iterable(c.rows.tolist() for c in node.children)) == sorted(node.rows.tolist())
            [walk(c) for c in node.children]
        else:
            seen.extend(node.rows.tolist())

    walk(topk.cover_tree(x))
    assert sorted(seen) == list(range(500))


# languages


def test_languages_fuse_evidence(spark):
    rnd = random.Random(0)
    words = {"de": "der die und nicht schlich keit".split(), "en": "the and of with thing that".split(), "fr": "le la est que eaux dans".split()}
    say = lambda x, n: " ".join(rnd.choice(words[x]) for _ in range(n))
    docs = spark.createDataFrame([(i, x, say(x, 30)) for i, x in enumerate(list(words) * 30)] + [(99, None, "x"), (100, "de", None)], "doc_id long, lang string, text string")
    pages = [(i, f"http://{x}.host.example/{x}/{i}", f'<html lang="{x}"><p>{say(x, 20)}</p></html>', x) for i, x in enumerate(list(words) * 20)]
    pages += [(100, "http://de.host.example/de/1", '<html lang="de"></html>', "de"), (101, None, None, None), (102, "http://fr.host.example/q", "", "fr"), (102, "http://fr.host.example/q", "", "fr")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, lang string")
    got = languages.identify(df, languages.fit(docs)).collect()
    assert len(got) == 64 and all(0 < r.posterior <= 1 and r.lang in words for r in got)
    want = {i: x for i, _, _, x in pages}
    assert all(r.lang == want[r.page_id] for r in got if want[r.page_id])
    assert all(r.text_lang is None for r in got if r.page_id >= 100)
    assert languages.identify(df.where("false"), languages.fit(docs)).count() == 0
    assert [r.lang for r in languages.identify(df.limit(1), languages.fit(docs.where("false"))).collect()] == [None]


def test_posterior_equals_plain_python(spark):
    rnd = random.Random(5)
    words = {"de": "der die und nicht".split(), "en": "the and of with".split()}
    say = lambda x, n: " ".join(rnd.choice(words[x]) for _ in range(n))
    model = languages.fit(spark.createDataFrame([(i, x, say(x, 20)) for i, x in enumerate(["de", "en"] * 20)], "doc_id long, lang string, text string"))
    pages = [(i, f"http://{rnd.choice(['a.x.de', 'b.x.de', 'c.y.com'])}/{rnd.choice(['de/', 'en/', ''])}p", f'<html lang="{rnd.choice(["de", "en"])}">{say(rnd.choice(["de", "en"]), rnd.randint(0, 3))}') for i in range(60)]
    names = model.languages
    facts = []
    for i, url, page in pages:
        host = url.split("/")[2]
        ll = languages.likelihood(languages.plain(page), model.rows, model.logs)
        suffix = languages.SUFFIXES.get(host.split(".")[-1], host.split(".")[-1])
        facts.append((i, host, ".".join(host.split(".")[-2:]), suffix, (re.findall("/(de|en)/", url) or [""])[0], re.findall('lang="(..)"', page)[0], ll, names[int(ll.argmax())] if ll.any() else None))
    count = lambda keep: np.array([sum(f[7] == x for f in facts if keep(f)) for x in names], float)
    whole = count(lambda f: True)
    smooth = lambda n, above: (n + languages.BELIEF * above) / (n.sum() + languages.BELIEF)
    got = {r.page_id: r for r in languages.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    for f in facts:
        prior = smooth(count(lambda g: g[1] == f[1]), smooth(count(lambda g: g[2] == f[2]), (whole + 1) / (whole.sum() + len(names))))
        score = f[6] + np.log(prior)
        for k in (3, 4, 5):
            score = score + np.log((count(lambda g: g[k] == f[k]) + languages.ADDED) / (whole + languages.ADDED * len({g[k] for g in facts})))
        share = np.exp(score - score.max())
        share /= share.sum()
        assert got[f[0]].lang == names[int(share.argmax())] and got[f[0]].posterior == pytest.approx(share.max(), rel=1e-6)


def test_plain_text_of_pages_equals_the_pattern_and_is_linear():
    tags = re.compile(r"<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", re.S | re.I)
    rnd = random.Random(0)
    parts = ["<p>", "</p>", "a", " b ", "<", ">", "<script>x<b>", "</SCRIPT>", "<style a>", "</style>", "<!--", "-->", "&amp;", "<br", "\n"]
    for _ in range(3000):
        page = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert languages.plain(page) == html.unescape(tags.sub(" ", page)), page
    began = time.time()
    for page in ("<script" * 200_000, "<!--" * 200_000 + ">", "<" * 500_000, "<style>" * 100_000):
        languages.plain(page)
    assert time.time() - began < 20


def test_likelihood_by_hand():
    rows, logs = {" a ": 0}, np.log(np.array([[0.5, 0.1], [0.01, 0.02]]))
    assert languages.likelihood("a", rows, logs) == pytest.approx(logs[0]) and languages.likelihood("1 2", rows, logs).tolist() == [0, 0]
    assert languages.plain("<script>x</script><p>a &amp; b</p><!-- c -->").split() == ["a", "&", "b"] and json.dumps(languages.grams(""))
