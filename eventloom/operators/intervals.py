"""The gap-aware time base: half-open intervals in whole microseconds, their unions, complements and bins.

Events are rows with key columns and t_us; intervals rows with the same keys and t0_us, t1_us.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.scans import SLICE_US, previous, running


def union(intervals: DataFrame, keys: list[str], grow_us: int = 0, slice_us: int = SLICE_US) -> DataFrame:
    """Intervals grown by grow_us on both sides and merged where they overlap or touch: an island starts where the greatest end so far lies before. Runs go in slices, so a channel of very many intervals is many small sorts."""
    grown = intervals.select(*keys, (F.col("t0_us") - grow_us).alias("t0_us"), (F.col("t1_us") + grow_us).alias("t1_us")).where("t1_us > t0_us")
    ends = running(grown, keys, ["t0_us", "t1_us"], slice_us, {"_end": ("max", F.col("t1_us"))}, before=True)
    start = F.when(F.col("_end") >= F.col("t0_us"), None).otherwise(F.col("t0_us"))
    marked = running(ends, keys, ["t0_us", "t1_us"], slice_us, {"_island": ("last", start)})
    return marked.groupBy(*keys, "_island").agg(F.min("t0_us").alias("t0_us"), F.max("t1_us").alias("t1_us")).drop("_island")


def complement(intervals: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps of the intervals inside [0, T), with T from spans (keys, total_us); spans without intervals are one gap."""
    tail = spans.select(*keys, F.col("total_us").alias("t0_us"), F.col("total_us").alias("t1_us"))
    inside = intervals.select(*keys, "t0_us", "t1_us").join(spans.select(*keys, "total_us"), keys).select(*keys, F.greatest("t0_us", F.lit(0)).alias("t0_us"), F.least("t1_us", "total_us").alias("t1_us")).where("t1_us > t0_us")
    ends = running(inside.unionByName(tail), keys, ["t0_us", "t1_us"], SLICE_US, {"_end": ("max", F.col("t1_us"))}, before=True)
    gaps = ends.select(*keys, F.coalesce("_end", F.lit(0)).alias("from"), F.col("t0_us").alias("to"))
    return gaps.where(F.col("from") < F.col("to")).select(*keys, F.col("from").cast("long").alias("t0_us"), F.col("to").alias("t1_us"))


def runs_of_flags(flags: DataFrame, keys: list[str], at: str = "i", flag: str = "flag") -> DataFrame:
    """Each longest run of true flags at consecutive positions as [start, stop)."""
    island = F.col(at) - F.row_number().over(W.partitionBy(*keys).orderBy(at))
    return flags.where(F.col(flag)).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("stop")).drop("_island")


def _bucketed(intervals: DataFrame, width_us: int) -> DataFrame:
    return intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("t0_us") / width_us), F.floor((F.col("t1_us") - 1) / width_us))))


def within(events: DataFrame, intervals: DataFrame, keys: list[str], width_us: int | None, how: str = "inner") -> DataFrame:
    """Events joined to the intervals that hold them: an equi-join on keys and time bucket, then the bounds.

    width_us should be near the intervals' usual length: each interval is copied to the buckets that it meets. Intervals
    that do not overlap may have any mix of lengths if width_us is None: then nothing is copied, see carried.
    how: inner, left, left_semi or left_anti.
    """
    if width_us is None:
        return carried(events, intervals, keys, how)
    cells = _bucketed(intervals, width_us)
    cells = cells.select(*(F.col(c).alias(f"_i_{c}") for c in cells.columns))
    placed = events.withColumn("_bucket", F.floor(F.col("t_us") / width_us))
    on = [F.col(k) == F.col(f"_i_{k}") for k in (*keys, "_bucket")] + [F.col("t_us") >= F.col("_i_t0_us"), F.col("t_us") < F.col("_i_t1_us")]
    joined = placed.join(cells, on, how)
    if how in ("inner", "left"):
        return joined.select(*events.columns, *(F.col(f"_i_{c}").alias(c) for c in intervals.columns if c not in keys))
    return joined.drop("_bucket")


def carried(events: DataFrame, intervals: DataFrame, keys: list[str], how: str = "inner", slice_us: int = SLICE_US) -> DataFrame:
    """within for disjoint intervals of any lengths: one scan over both, in time slices, carries the last interval that began up to each event, which alone can hold it.

    Every event and interval is one row, whether an interval lasts a millisecond or a month. An empty interval holds
    nothing; an event without a time is in none. Null keys equal each other here.
    """
    given = intervals.where("t1_us > t0_us")
    held = F.struct(*(c for c in intervals.columns if c not in keys))
    nothing = lambda like: F.lit(None).cast(like.schema["_x"].dataType)
    starts, marks = given.select(*keys, F.col("t0_us").alias("_at"), held.alias("_x")), events.select(*keys, F.col("t_us").alias("_at"), F.struct(*events.columns).alias("_x"))
    both = starts.select(*keys, "_at", F.lit(0).alias("_kind"), F.col("_x").alias("_span"), nothing(marks).alias("_row"))
    both = both.unionByName(marks.where("_at is not null").select(*keys, "_at", F.lit(1).alias("_kind"), nothing(starts).alias("_span"), F.col("_x").alias("_row")))
    line = running(both, keys, ["_at", "_kind"], slice_us, {"_last": ("last", F.col("_span"))}).where("_kind = 1")
    inside = F.coalesce(F.col("_at") < F.col("_last.t1_us"), F.lit(False))
    own = [F.col("_row")[c].alias(c) for c in events.columns]
    if how in ("left_semi", "left_anti"):
        found = line.where(inside if how == "left_semi" else ~inside).select(*own)
    else:
        found = (line if how == "left" else line.where(inside)).select(*own, *(F.when(inside, F.col("_last")[c]).alias(c) for c in intervals.columns if c not in keys))
    return found.unionByName(events.where("t_us is null"), allowMissingColumns=True) if how in ("left", "left_anti") else found


def clocked(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint segments with before_us, the length of all segments of the same keys that lie ahead, and length_us, that of all of them: the condition's own clock runs from 0 to length_us and stands still between segments."""
    length = F.col("t1_us") - F.col("t0_us")
    line = running(segments, keys, ["t0_us", "t1_us"], SLICE_US, {"before_us": ("sum", length)}, before=True).withColumn("before_us", F.coalesce("before_us", F.lit(0).cast("long")))
    totals = segments.groupBy(*keys).agg(F.sum(length).alias("length_us"))
    return line.join(totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "length_us"), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*(f"_k_{k}" for k in keys))


def on_clock(events: DataFrame, segments: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """The events inside the segments with clock_us, their time on the condition's own clock, and its length_us. width_us as in within."""
    inside = within(events, clocked(segments.select(*keys, "t0_us", "t1_us"), keys), keys, width_us)
    return inside.withColumn("clock_us", F.col("t_us") - F.col("t0_us") + F.col("before_us")).select(*events.columns, "clock_us", "length_us")


def overlap_per_slice(intervals: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """(keys, slice, covered_us): how much of each slice of width_us disjoint intervals cover; slices untouched have no row."""
    cells = _bucketed(intervals, width_us)
    part = F.least("t1_us", (F.col("_bucket") + 1) * width_us) - F.greatest("t0_us", F.col("_bucket") * width_us)
    return cells.groupBy(*keys, F.col("_bucket").alias("slice")).agg(F.sum(part).alias("covered_us"))


def analysable(channels: DataFrame, mask: DataFrame, flags: DataFrame, width_us: int, total_us: int) -> DataFrame:
    """(run_id, chan, is_on, clean_us): unmasked time by channel and condition, measured slice by slice, never scaled.

    flags has a row (run_id, slice, is_on) for every whole slice. Time is what the slices of a condition have,
    less what the mask covers there, so no grid of channels and slices is made.
    """
    whole = flags.groupBy("run_id", "is_on").agg((F.count("*") * width_us).alias("_time"))
    lost = overlap_per_slice(mask, ["run_id", "chan"], width_us).join(flags, ["run_id", "slice"]).groupBy("run_id", "chan", "is_on").agg(F.sum("covered_us").alias("_lost"))
    out = channels.select("run_id", "chan").join(whole, "run_id").join(lost, ["run_id", "chan", "is_on"], "left")
    return out.select("run_id", "chan", "is_on", (F.col("_time") - F.coalesce("_lost", F.lit(0))).cast("long").alias("clean_us"))


def select_condition(on: DataFrame, spans: DataFrame, label: str, until_us: int | None = None) -> DataFrame:
    """(run_id, seg, t0_us, t1_us) of a condition: all, on, or off (the complement of on), cut at until_us; empty segments go."""
    if label == "all":
        found = spans.select("run_id", F.lit(0).cast("long").alias("t0_us"), F.col("total_us").alias("t1_us"))
    elif label == "on":
        found = on.select("run_id", "t0_us", "t1_us")
    elif label == "off":
        found = complement(on, spans, ["run_id"])
    else:
        raise ValueError("label is all, on or off")
    if until_us is not None:
        found = found.withColumn("t1_us", F.least("t1_us", F.lit(until_us)))
    return found.where("t1_us > t0_us").withColumn("seg", F.row_number().over(W.partitionBy("run_id").orderBy("t0_us")) - 1).select("run_id", "seg", "t0_us", "t1_us")


def described(segments: DataFrame) -> DataFrame:
    """Per run: total time, number, shortest and longest of the segments."""
    length = F.col("t1_us") - F.col("t0_us")
    return segments.groupBy("run_id").agg(F.sum(length).alias("total_us"), F.count("*").alias("n"), F.min(length).alias("min_us"), F.max(length).alias("max_us"))


def isis(events: DataFrame, segments: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """Events with seg and isi_us: the time since the event before in the same segment (null for its first); events in gaps go."""
    tagged = within(events, segments, ["run_id"], width_us)
    return previous(tagged, [*keys, "seg"], "t_us", SLICE_US, "_before").withColumn("isi_us", F.col("t_us") - F.col("_before")).drop("_before")


def bins(segments: DataFrame, width_us: int) -> DataFrame:
    """(run_id, seg, bin, t0_us): whole bins of each segment; the rest of a segment is dropped."""
    n = F.floor((F.col("t1_us") - F.col("t0_us")) / width_us)
    return segments.withColumn("bin", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))).select("run_id", "seg", "bin", (F.col("t0_us") + F.col("bin") * width_us).alias("t0_us"))


def bin_counts(events: DataFrame, segments: DataFrame, keys: list[str], width_us: int, join_us: int) -> DataFrame:
    """(keys, seg, bin, n) of the bins that hold events; bins without any have no row (see filled)."""
    tagged = within(events, segments, ["run_id"], join_us)
    placed = tagged.withColumn("bin", F.floor((F.col("t_us") - F.col("t0_us")) / width_us)).where((F.col("bin") + 1) * width_us <= F.col("t1_us") - F.col("t0_us"))
    return placed.groupBy(*keys, "seg", "bin").agg(F.count("*").alias("n"))


def filled(counts: DataFrame, groups: DataFrame, segments: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """The counts with a zero for every bin of every group (keys, run_id among them) that has none."""
    grid = groups.select(*keys).distinct().join(bins(segments, width_us).select("run_id", "seg", "bin"), "run_id")
    return grid.join(counts, [*keys, "seg", "bin"], "left").select(*keys, "seg", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def bin_totals(segments: DataFrame, width_us: int) -> DataFrame:
    """(run_id, bins): the number of whole bins, without making them."""
    return segments.groupBy("run_id").agg(F.sum(F.floor((F.col("t1_us") - F.col("t0_us")) / width_us)).alias("bins"))


def sample_windows(segments: DataFrame, n: int, length_us: int, lead_us: int, trail_us: int) -> DataFrame:
    """(run_id, seg, t_us): evenly spaced window starts; a segment has its share of n by length (one at least), away from its ends."""
    length = F.col("t1_us") - F.col("t0_us")
    k = F.greatest(F.bround(F.lit(n) * length / F.sum(length).over(W.partitionBy("run_id"))), F.lit(1)).cast("int")
    first, last = F.col("t0_us") + lead_us, F.col("t1_us") - trail_us - length_us
    step = F.when(F.col("k") > 1, (F.col("last") - F.col("first")) / (F.col("k") - 1)).otherwise(0.0)
    placed = segments.withColumn("k", k).withColumn("first", first).withColumn("last", last).where("last >= first").withColumn("step", step)
    return placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("run_id", "seg", F.floor(F.col("first") + F.col("i") * F.col("step")).alias("t_us"))


def window_plan(spans: DataFrame, window_us: int, overlap_us: int) -> DataFrame:
    """(run_id, window, start_us, stop_us, t0_us, t1_us): overlapping windows; each owns its interior, the first from 0, the last to the end."""
    step = window_us - overlap_us
    n = F.greatest(F.ceil((F.col("total_us") - overlap_us) / step), F.lit(1))
    rows = spans.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("last", F.col("window") == n - 1)
    start = F.col("window") * step
    stop = F.least(start + window_us, "total_us")
    t0 = F.when(F.col("window") == 0, 0).otherwise(start + overlap_us // 2)
    t1 = F.when(F.col("last"), F.col("total_us")).otherwise(start + step + overlap_us // 2)
    return rows.select("run_id", "window", start.alias("start_us"), stop.alias("stop_us"), t0.cast("long").alias("t0_us"), t1.cast("long").alias("t1_us"))
