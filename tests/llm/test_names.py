"""Stages keep every column of their input, whatever its name."""

import pytest
from pyspark.sql import functions as F

from eventloom.llm import copies, mixing, pii, quality

#: Every name that a stage uses inside.
NAMES = "base terms _row times _text _doc _doc_id _doc_text _doc_key _id _key _new _turn _times row key n bands root node near held start end size target taken finish rank weight slice bits score term entity share at label features".split()


def stages():
    return {
        "one_of_each": copies.one_of_each,
        "sanitise": pii.sanitise,
        "mixed": mixing.mixed,
        "good": lambda docs: quality.good(docs, docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
    }


@pytest.mark.parametrize("name", sorted(stages()))
def test_columns_of_any_name_stay(spark, name):
    texts = ["Write to anna.berg@example.org about the harbour lease today.", "Nothing here but plain words about boats and nets.", "Another text that has words of its own in it."]
    rows = [(i, t, "en", "ab"[i % 2], len(t), *(100 * i + k for k in range(len(NAMES)))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in NAMES))
    got = stages()[name](docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    kept = {r.doc_id: r for r in got.collect()}
    assert kept and (name == "mixed" or len(kept) == 3)
    for i, r in kept.items():
        assert [r[n] for n in NAMES] == [100 * i + k for k in range(len(NAMES))]
        assert r.n_chars == len(r.text) and (r.text == texts[i] or name == "sanitise" and "[EMAIL]" in r.text)


@pytest.mark.parametrize("name", sorted(stages()))
def test_no_rows(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, base int")
    got = stages()[name](docs)
    assert got.columns == docs.columns and got.collect() == []


def test_rows_are_told_apart_by_128_bits(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (1, None), (1, "")], "doc_id long, text string")
    from eventloom.llm.common import row_key, whole_row_key

    keys = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), whole_row_key(docs).alias("w")).collect()
    assert {len(r.k) for r in keys} == {len(r.w) for r in keys} == {16} and len({bytes(r.k) for r in keys}) == 3
