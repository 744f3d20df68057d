"""Stored runs: parquet tables by run, migration from .npz files, summaries."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that write one run at most; what one array entry of a stored run becomes: its key, place and value as a number or text.
WRITERS = 16
ENTRY = "run_id string, key string, i long, j long, num double, txt string"


def read_runs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A run table written by write_runs; only runs of one kind if it is given, pruned by partition columns where there are any."""
    rows = spark.read.parquet(path)
    return rows if kind is None else rows.where(F.col("run_kind") == kind)


def write_runs(rows: DataFrame, path: str, **settings) -> None:
    """Write rows by run_id; runs that the rows hold are replaced, others stay as they are. settings go beside every row as `provenance`.

    Each run is written by up to WRITERS tasks, so a large one does not wait for one of them.
    """
    kept = rows.withColumn("provenance", F.lit(provenance(**settings))) if settings else rows
    dealt = kept.repartition("run_id", F.pmod(F.xxhash64(*rows.columns), F.lit(WRITERS)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


class BrokenRuns(ValueError):
    """Runs that break an invariant, found before anything of them was written."""


def write_checked_runs(rows: DataFrame, path: str, broken: DataFrame, skip: bool = False, **settings) -> None:
    """write_runs behind the invariants: broken (run_id, rule, detail), as scoring.violations gives it, names what is wrong with the runs.

    If a run of the rows is named, nothing is written and BrokenRuns says how often which rule is broken, the first
    20 of them by run. With skip only the runs that are named stay out; what is stored of them stays as it was.
    """
    ours = broken.join(rows.select("run_id").distinct(), "run_id", "left_semi")
    if skip:
        return write_runs(rows.join(ours.select("run_id").distinct(), "run_id", "left_anti"), path, **settings)
    found = ours.groupBy("run_id", "rule").agg(F.count("*").alias("n"), F.min("detail").alias("detail")).orderBy("run_id", "rule").limit(20).collect()
    if found:
        raise BrokenRuns("; ".join(f"run {r.run_id}: {r.rule}, {r.n} times, {r.detail} among them" for r in found))
    write_runs(rows, path, **settings)


def entries_of(name: str, data: bytes):
    """(run_id, key, i, j, num, txt) of every entry of every array of one .npz file, as columns array by array; only plain numbers, flags and text are read."""
    with np.load(io.BytesIO(data), allow_pickle=False) as stored:
        for key in stored.files:
            a = np.atleast_1d(stored[key])
            rows, n = len(a), a.size
            width = n // rows if rows else 0
            flat = a.reshape(-1)
            if flat.dtype.kind in "US":
                num, txt = pa.nulls(n, pa.float64()), pa.array([v.decode() if isinstance(v, bytes) else str(v) for v in flat], pa.string())
            else:
                num, txt = pa.array(flat.astype(np.float64), from_pandas=True), pa.nulls(n, pa.string())
            yield [pa.array([name] * n, pa.string()), pa.array([key] * n, pa.string()), pa.array(np.repeat(np.arange(rows), width)), pa.array(np.tile(np.arange(width), rows)), num, txt]


def read_npz(spark: SparkSession, pattern: str) -> DataFrame:
    """(run_id, key, i, j, num, txt): the arrays of all .npz files that the pattern names, one row an entry; NaN becomes null; the run is the file's name without its ending."""

    def batches(rows):
        for b in rows:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                for columns in entries_of(path.rsplit("/", 1)[-1].removesuffix(".npz"), data.as_py()):
                    yield pa.RecordBatch.from_arrays(columns, ["run_id", "key", "i", "j", "num", "txt"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(batches, ENTRY)


def detections_of(entries: DataFrame, only_simulated: bool = False) -> DataFrame:
    """(run_id, detector, chan, idx, t_us, is_on) from entries: keys <detector>_idx, _chan and, where stored, _on, and fs. Runs without a key `simulated` are left out on demand."""
    part = lambda suffix, name: entries.where(F.col("key").endswith(suffix)).select("run_id", F.expr(f"substring(key, 1, length(key) - {len(suffix)})").alias("detector"), "i", F.col("num").alias(name))
    fs = entries.where("key = 'fs'").select("run_id", F.col("num").alias("fs"))
    rows = part("_idx", "idx").join(part("_chan", "chan"), ["run_id", "detector", "i"]).join(part("_on", "on"), ["run_id", "detector", "i"], "left").join(F.broadcast(fs), "run_id").where("detector <> 'truth'")
    if only_simulated:
        rows = rows.join(entries.where("key = 'simulated'").select("run_id").distinct(), "run_id", "left_semi")
    return rows.select("run_id", "detector", F.col("chan").cast("int").alias("chan"), F.col("idx").cast("long").alias("idx"), F.bround(F.col("idx") * 1e6 / F.col("fs")).cast("long").alias("t_us"), (F.col("on") != 0).alias("is_on"))


def truth_of(entries: DataFrame) -> DataFrame:
    """(run_id, chan, t_us, amp) from the keys truth_idx, truth_chan, truth_amp and truth_fs."""
    part = lambda key, name: entries.where(F.col("key") == key).select("run_id", "i", F.col("num").alias(name))
    fs = entries.where("key = 'truth_fs'").select("run_id", F.col("num").alias("fs"))
    rows = part("truth_idx", "idx").join(part("truth_chan", "chan"), ["run_id", "i"]).join(part("truth_amp", "amp"), ["run_id", "i"], "left").join(F.broadcast(fs), "run_id")
    return rows.select("run_id", F.col("chan").cast("int").alias("chan"), F.bround(F.col("idx") * 1e6 / F.col("fs")).cast("long").alias("t_us"), "amp")


def write_summary(rows: DataFrame, path: str) -> None:
    """The sweep's summary table as CSV with a header."""
    rows.select("detector", "param", "value", "det_per_chan_min", "recall", "precision_lower_bound", "tp", "n_true", "n_det").write.mode("overwrite").option("header", True).csv(path)


def read_tsv(spark: SparkSession, pattern: str) -> DataFrame:
    """Tab-separated files with a header; a byte-order mark on the first column's name goes; subject comes from the path's sub-<name> part."""
    rows = spark.read.option("sep", "\t").option("header", True).option("encoding", "UTF-8").csv(pattern)
    rows = rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("﻿"))
    return rows.withColumn("subject", F.regexp_extract(F.col("_metadata.file_path"), r"sub-([^/_]+)", 1))


def complete_subjects(recordings: DataFrame, interpretations: DataFrame) -> DataFrame:
    """Subjects that have both files."""
    return recordings.select("subject").distinct().join(interpretations.select("subject").distinct(), "subject", "left_semi")


def expert_marks(rows: DataFrame) -> DataFrame:
    """(subject, t_us, annotation, chans) from interpretation rows (time_in_sec, annotation, chans separated by blanks)."""
    names = F.filter(F.split(F.trim("chans"), r"\s+"), lambda c: c != "")
    return rows.select("subject", F.bround(F.col("time_in_sec").cast("double") * 1e6).cast("long").alias("t_us"), "annotation", names.alias("chans"))


def read_onset(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(patient, name) from a JSON array of patients with a list EZ, or (lines) one object a line; a null list gives one row with a null name."""
    rows = spark.read.schema("patient string, EZ array<string>").option("multiLine", not lines).json(path)
    return rows.select("patient", F.explode_outer("EZ").alias("name"))


def provenance(**values) -> str:
    """A run's settings as JSON text, for its provenance column."""
    return json.dumps(values, sort_keys=True)
