"""Rows with null or repeated ids are judged by their own text."""

from pyspark.sql import functions as F

from eventloom.llm import copies, mixing, quality


def test_clean_rows_with_null_or_repeated_ids_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[4])], "doc_id long, text string")
    assert sorted(r.text for r in copies.one_of_each(docs).collect()) == texts


def test_a_bad_row_takes_no_clean_row_along(spark, monkeypatch):
    class Short:
        def score(self):
            return F.when(F.col("log_words") < 2.0, 0.0).otherwise(1.0)

    monkeypatch.setattr(quality, "fit", lambda stats, labels: Short())
    good = "many words stand in this row so that it is long enough"
    docs = spark.createDataFrame([(1, "bad"), (1, good), (None, "bad"), (None, good)], "doc_id long, text string")
    assert [r.text for r in quality.good(docs, None).collect()] == [good, good]


def test_the_mix_counts_every_row_by_itself(spark):
    rows = [(i % 3 or None, " ".join(["w"] * (1 + i % 7)), "s" if i % 2 else "t", i) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string, extra int")
    keyed = docs.withColumn("row", F.xxhash64(*docs.columns))
    want = {r.row: r.n for r in mixing.mix(keyed, row_col="row").groupBy("row").agg(F.sum("times").alias("n")).where("n > 0").collect()}
    got = {r.row: r["count"] for r in mixing.mixed(docs).withColumn("row", F.xxhash64(*docs.columns)).groupBy("row").count().collect()}
    assert got == want and len(set(want.values())) > 1
