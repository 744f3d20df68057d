"""op13 against a brute-force version with the public libraries, whole texts at a time."""

import hashlib
import os
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from eventloom.llm import alignment, queries
from eventloom.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plainly(rows):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)] by walking along both rows of tokens."""
    a_model = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a_model.encode_special_tokens = True
    letters, names = alignment.byte_letters(), {i: t for t, i in a_model.get_vocab().items()}
    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL)
    bytes_b = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    per, held = [], Counter()
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        in_a, in_b = [bytes(letters[c] for c in names[i]) for i in a], [bytes_b(i) for i in b]
        if not text or not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
            per.append((doc_id, [], Counter()))
            continue
        groups, now, x, y, at_a, at_b = [], ([], []), 0, 0, 0, 0
        while x < len(a) or y < len(b):
            if at_a <= at_b:
                now[0].append(a[x])
                at_a, x = at_a + len(in_a[x]), x + 1
            else:
                now[1].append(b[y])
                at_b, y = at_b + len(in_b[y]), y + 1
            if at_a == at_b:
                groups.append(now)
                now = ([], [])
        links = Counter()
        for g in groups:
            for i, m in Counter(g[0]).items():
                for j, n in Counter(g[1]).items():
                    links[i, j] += m * n
        held.update(links.keys())
        per.append((doc_id, groups, links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for doc_id, groups, links in per:
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sha = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        n_best = sum(n for (i, j), n in links.items() if held[i, j] == best[i])
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), n_best, sum(n * held[p] for p, n in links.items()), sha))
    return out


def told(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b   ", "\n", "\n\n a\n b", "tab\tand\x0bmore \r\n x", "it's we'll I'd 's", "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "▁", "naïve über Straße ñ", "日本語のテキスト です 漢字",
    "​ zero width 　 wide", "🙂 👩‍👩‍👧 ok", "é combining ́", "a\x1c b\x1f c\x85 d", "word" * 400, "a" * 5000, "ab" * 3000 + " " + "xyz" * 999, " " * 700 + "end", "0123456789 3.14159 1,000", "===== ---- ####", "\x00 nul \x00", "İstanbul ǅ ﬁ",
]


def test_rows_equal_brute_force(spark):
    rnd = random.Random(3)
    letters = "abcdefgh  \n'.,é漢🙂▁ \t0129ABC"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(i, "".join(rnd.choices(letters, k=rnd.randint(1, 120)))) for i in range(100, 400)]
    rows += [(None, "null id"), (7, "same id"), (7, "same id"), (7, "same id, other text")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, pair string").repartition(5)
    want = sorted(plainly(rows), key=repr)
    assert told(alignment.align(df)) == want
    assert told(alignment.align(df, most=50)) == want
    assert told(alignment.align(df, most=0)) == want


def test_the_query_equals_brute_force(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text").collect()
    assert told(queries.op13_align(spark, DATA)) == sorted(plainly([tuple(r) for r in docs]), key=repr)


def test_small_holdings_change_nothing(spark, monkeypatch):
    rows = [(i, f"word{i % 7} and {'x' * (i % 5)} {i}") for i in range(200)]
    monkeypatch.setattr(alignment, "HELD_SEGMENTS", 5)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 0)
    assert told(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(plainly(rows), key=repr)


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_jumping_reaches_the_common_ends(seed):
    import numpy as np

    rnd = np.random.default_rng(seed)
    length = int(rnd.integers(1, 60))
    ends = [np.union1d(np.flatnonzero(rnd.random(length) < rnd.random()), [length - 1]) + 1 for _ in "ab"]
    last = alignment.jumped(*ends)
    common = np.intersect1d(*ends)
    both = np.concatenate(ends)
    assert np.array_equal(both[last], common[np.searchsorted(common, both)]) and (last >= len(ends[0])).all()
