"""What the driver gives back between large steps."""

import os

from pyspark.sql import functions as F

from eventloom.llm import common, components


def test_the_driver_hands_freed_memory_back(spark):
    assert common.trim(spark).startswith("Trim native heap")
    common.settle(spark)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in folders for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.SWEEP)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    table = common.written(sums.join(sums.withColumnRenamed("s", "t"), "k"), "test-settle")
    assert shuffle_files(spark) <= before and spark.conf.get(common.SWEEP) == setting
    assert {(r.k, r.s, r.t) for r in table.collect()} == {(k, sum(range(k, 1000, 7)), sum(range(k, 1000, 7))) for k in range(7)}


def test_components_leave_one_table_and_no_shuffle_files(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    before, tables = shuffle_files(spark), common.made()
    roots = components.components(links)
    assert shuffle_files(spark) <= before and common.made() == tables + 1
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(61)}
    common.clear(spark, since=tables)
