"""Terms that reveal rare entities, and where they are marked."""

from eventloom.llm import pii


def test_rare_entities_and_whole_texts(spark):
    filler = "common words fill this line"
    rows = [(0, f"zanzibar stood first\n{filler} zanzibar mail a.b@c.example {filler}\nand zanzibar came again")]
    rows += [(i, f"{filler} number") for i in range(1, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.sensitive(docs).collect()}
    marked = [rows[0][1][s.start : s.end] for s in got[0].terms]
    assert marked.count("zanzibar") == 3 and "common" not in marked
    assert all(not r.terms for i, r in got.items() if i)


def test_a_fully_revealing_term_is_marked_without_its_entity(spark):
    rows = [(i, f"mail a.b@c.example quagga {'x' * i}") for i in range(300)] + [(1000, "the quagga alone\nQuagga"), (1001, "nothing")]
    rows += [(2000 + i, "some other words") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.start, s.end, s.removed) for s in r.terms] for r in pii.sensitive(docs).where("doc_id in (1000, 1001)").collect()}
    assert got == {1000: [(4, 10, True), (17, 23, True)], 1001: []}


def test_context_counts_terms_not_characters():
    words = ["w" * 120 + c for c in "abcdefg"]
    text = " ".join(words) + " a@b.cc tail"
    spans = pii.base_spans(text)
    assert [w for _, w, _, _ in pii.context(text, spans)] == words[-5:] + ["tail"]
    text = "1 " * 300 + "word " + "1 " * 200 + "a@b.cc"
    assert [w for _, w, _, _ in pii.context(text, pii.base_spans(text))] == ["word"]


def test_terms_counted_first_in_few_or_all_partitions_or_joined_give_equal_spans(spark, monkeypatch):
    import random

    r = random.Random(5)
    words = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("rin", "lom", "tek", "sul")]
    line = lambda: " ".join(r.choice(words[: 5 + int(200 * r.random() ** 3)]) for _ in range(12))
    rows = [(i, f"{line()} {f'write to n{i % 7}@d{i % 3}.example' if i % 5 == 0 else ''} {line()}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = lambda: sorted((x.doc_id, [tuple(s) for s in x.terms]) for x in pii.sensitive(docs).collect())
    first = found()
    assert any(terms for _, terms in first)
    for rounds in ((), (1,), (5, 3)):
        monkeypatch.setattr(pii, "ROUNDS", rounds)
        assert found() == first
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert found() == first
