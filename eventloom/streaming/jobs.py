"""Live jobs over a stream of detections (run_id, detector, chan, idx, ts): the same results as in batch on bounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_end(stream: DataFrame, marks: DataFrame, ts: Column) -> DataFrame:
    """The stream with an end mark for each row of another stream: a row at ts whose other columns are null.

    A mark that lies later than all events by more than the lateness allowed moves the watermark past them, so windows
    and chains still open come out in append mode and their state goes. The mark's own window stays open and never
    comes out. A recorder sends one when it stops, or at intervals while it has nothing else to send.
    """
    end = marks.select(*((ts if c == "ts" else F.lit(None)).cast(kind).alias(c) for c, kind in stream.dtypes))
    return stream.unionByName(end)


def population_rate(stream: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Events of all channels per run and tumbling window; events later than `late` are dropped. In append mode a window comes out once, when the watermark passes its end, and its state goes."""
    counted = stream.withWatermark("ts", late).groupBy("run_id", F.window("ts", width)).agg(F.count("*").alias("n"))
    return counted.select("run_id", F.col("window.start").alias("start"), "n")


def merged_marks(stream: DataFrame, gap_us: int, late: str = "1 hour") -> DataFrame:
    """Chains of marks closer than gap_us as one, at its first. Sessions join at equal gaps, so theirs is a microsecond less. In append mode a chain comes out once, when no mark in time can still join it, and its state goes."""
    session = F.session_window("ts", f"{gap_us - 1} microseconds")
    merged = stream.withWatermark("ts", late).groupBy("run_id", "detector", "chan", session).agg(F.count("*").alias("merged"))
    return merged.select("run_id", "detector", "chan", F.col("session_window.start").alias("ts"), "merged")


def without_overlap(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One mark per train and sample, though overlapping windows report it twice."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "detector", "chan", "idx"])


def run_once(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into parquet files under a path that all executors share; for bounded input and tests.

    Each batch is a folder of its own, written anew if it is run again. In complete mode the last batch holds the result.
    """
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        last[:] = [number]

    query = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows/batch={last[0]}" if mode == "complete" else f"{path}/rows").select(*df.columns)
