"""What every detector's raw events go through before they are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.columns import normalise_label, to_samples
from eventloom.operators import intervals
from eventloom.operators.matching import islands

TRAIN = ["run_id", "detector", "chan"]


def clip_unique(detections: DataFrame, spans: DataFrame) -> DataFrame:
    """One event per train and time, inside [0, T)."""
    return detections.join(spans.select("run_id", "total_us"), "run_id").where("t_us >= 0 and t_us < total_us").drop("total_us").dropDuplicates([*TRAIN, "t_us"])


def edge_guard(events: DataFrame, spans: DataFrame, guard_us: int) -> DataFrame:
    """Events at least guard_us from either end, both bounds included."""
    return events.join(spans.select("run_id", "total_us"), "run_id").where(F.col("t_us").between(F.lit(guard_us), F.col("total_us") - guard_us)).drop("total_us")


def trim_edges(events: DataFrame, spans: DataFrame, edge_us: int) -> DataFrame:
    """Events strictly further than edge_us from either end."""
    return events.join(spans.select("run_id", "total_us"), "run_id").where((F.col("t_us") > edge_us) & (F.col("t_us") < F.col("total_us") - edge_us)).drop("total_us")


def reject_masked(detections: DataFrame, mask: DataFrame, width_us: int) -> DataFrame:
    """Events outside their channel's mask."""
    return intervals.within(detections, mask, ["run_id", "chan"], width_us, "left_anti")


def merge_close(detections: DataFrame, gap_us: int, keys: list[str] = TRAIN) -> DataFrame:
    """Chains of events closer than gap_us become their first event."""
    chains = islands(detections.select(*keys, "t_us"), keys, gap_us - 1)
    return chains.groupBy(*keys, "island").agg(F.min("t_us").alias("t_us"), F.count("*").alias("merged")).drop("island")


def label_on(events: DataFrame, on: DataFrame, width_us: int) -> DataFrame:
    """Events with is_on: whether they lie in an ON segment of their run."""
    inside = intervals.within(events, on.select("run_id", "t0_us", "t1_us").withColumn("_in", F.lit(True)), ["run_id"], width_us, "left")
    return inside.drop("t0_us", "t1_us").withColumn("is_on", F.coalesce("_in", F.lit(False))).drop("_in")


def assemble(marks: DataFrame, plan: DataFrame) -> DataFrame:
    """Marks of overlapping windows (run_id, window, t_us from the window's start) on the recording's clock, each in the window that owns its time."""
    joined = marks.join(plan.select("run_id", "window", "start_us", "t0_us", "t1_us"), ["run_id", "window"]).withColumn("t_us", F.col("t_us") + F.col("start_us"))
    return joined.where("t_us >= t0_us and t_us < t1_us").drop("start_us", "t0_us", "t1_us")


def attrition(detections: DataFrame, mask: DataFrame, gap_us: int, width_us: int) -> DataFrame:
    """Per run and detector: events, those outside the mask, and those left after merging; one pass over flagged rows."""
    marked = intervals.within(detections, mask.withColumn("_in", F.lit(1)), ["run_id", "chan"], width_us, "left")
    flags = marked.groupBy(*TRAIN, "t_us").agg(F.max("_in").isNotNull().alias("masked"))
    order = W.partitionBy(*TRAIN, "masked").orderBy("t_us")
    new = F.when(~F.col("masked") & F.coalesce(F.col("t_us") - F.lag("t_us").over(order) >= gap_us, F.lit(True)), 1).otherwise(0)
    return flags.withColumn("_new", new).groupBy("run_id", "detector").agg(F.count("*").alias("n_raw"), F.sum(F.when(F.col("masked"), 0).otherwise(1)).alias("n_unmasked"), F.sum("_new").alias("n_merged"))


def from_markers(markers: DataFrame, channels: DataFrame, fs: float, start: float = 0.0, label: str = "Spike") -> DataFrame:
    """(rec_id, name, idx) from a marker list (rec_id, label, position, channels): one row a channel and sample, names normalised; channels without marks stay with a null idx."""
    kept = markers.where((F.col("label") == label) & F.col("position").isNotNull() & ~F.isnan("position"))
    rows = kept.select("rec_id", F.explode("channels").alias("channel"), "position").select("rec_id", normalise_label(F.col("channel")).alias("name"), to_samples(F.col("position") - start, fs).alias("idx")).distinct()
    return channels.select("rec_id", normalise_label(F.col("name")).alias("name")).distinct().join(rows, ["rec_id", "name"], "left")


def matched_share(channels: DataFrame, names: DataFrame) -> DataFrame:
    """Per recording: the share of the pipeline's channel names that the detector knows, and whether it is under 0.8."""
    known = names.select("rec_id", normalise_label(F.col("name")).alias("name")).distinct().withColumn("_hit", F.lit(1))
    listed = channels.select("rec_id", normalise_label(F.col("name")).alias("name"))
    share = F.avg(F.coalesce("_hit", F.lit(0)))
    return listed.join(known, ["rec_id", "name"], "left").groupBy("rec_id").agg(share.alias("matched"), (share < 0.8).alias("low"))


def merge_floor(isi: DataFrame) -> DataFrame:
    """Per detector the least interval, and whether it is the same for all."""
    least = isi.groupBy("detector").agg(F.min("isi_us").alias("min_us"))
    every = W.partitionBy()
    return least.withColumn("same", F.min("min_us").over(every) == F.max("min_us").over(every))
