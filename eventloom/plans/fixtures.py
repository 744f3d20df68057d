"""The model's tables from the driver's events table, in Spark and in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000
TOTAL, EPOCH = 30 * DAY, 1_704_067_200_000_000
TOL, MERGE, DILATE, SYNC, GUARD, BIN, ACTIVITY, WINDOW = 6 * HOUR, 12 * HOUR, 3 * HOUR, HOUR // 6, DAY, DAY, 2 * DAY, 12 * HOUR
DETECTORS = ("click", "purchase", "view")
THRESHOLDS = (0, 10, 25, 50, 75, 100)


def events(spark, sf_dir: str) -> DataFrame:
    """Events on the recording's clock: run_id, chan, event_type, t_us, value."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 5).alias("run_id"), F.col("user_id").alias("chan"), "event_type", t.alias("t_us"), "value")


def days(hits: DataFrame, keys: list[str], zero) -> DataFrame:
    """(keys, days): an array of 30 days, each an array of 24 values, of every train; hits has keys, hour, v, a row a train and hour at most; hours without one are zero, those outside the 30 days go.

    No row is made for an hour: a day is one row, and a train one row of its days.
    """
    dealt = hits.withColumn("_day", F.floor(F.col("hour") / 24)).repartition(*keys)
    at = F.col("hour") - 24 * F.col("_day")
    by_day = dealt.groupBy(*keys, "_day").agg(F.array(*(F.coalesce(F.max(F.when(at == h, F.col("v"))), zero) for h in range(24))).alias("_v"))
    counts = F.col("_day").between(0, 29)
    for k in keys:
        counts = counts & F.col(k).isNotNull()
    held = by_day.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(counts, F.struct("_day", "_v")))).alias("_held"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")), lambda d: F.coalesce(F.col("_held")[d], F.array_repeat(zero, 24))).alias("days"))


def scratch(t, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    base = t.spark.sparkContext.getCheckpointDir() or t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Tables:
    """The model's tables over one folder."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.events = events(spark, sf_dir)
        self.channels = self.events.select("run_id", "chan").distinct().withColumn("name", F.concat(F.lit("A_"), "chan")).withColumn("is_ez", F.col("chan") % 7 == 0)
        self.raw = self.events.where(F.col("event_type").isin(*DETECTORS)).select("run_id", F.col("event_type").alias("detector"), "chan", "t_us", "value", "event_id")
        self.detections = self.raw.groupBy("run_id", "detector", "chan", "t_us").agg(F.max("value").alias("value"), F.min("event_id").alias("event_id"))
        self.truth = self.events.where("event_type = 'signup'").select("run_id", "chan", "t_us", F.col("value").alias("amp"), "event_id")
        self.mask_marks = self.events.where("event_type = 'error'").select("run_id", "chan", F.col("t_us").alias("t0_us"), (F.col("t_us") + 1).alias("t1_us"))
        self.spans = self.channels.select("run_id").distinct().withColumn("total_us", F.lit(TOTAL))
        self.on = self.spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("run_id", ((F.col("k") * 5 + 1) * DAY).alias("t0_us"), ((F.col("k") * 5 + 3) * DAY).alias("t1_us"))
        self.day_flags = self.spans.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("slice")).select("run_id", F.col("slice").cast("long").alias("slice"), (F.col("slice") % 5).isin(1, 2).alias("is_on"))

    def mask(self) -> DataFrame:
        """The dilated artefact mask as disjoint intervals inside the recording."""
        from eventloom.operators import intervals

        grown = intervals.union(self.mask_marks, ["run_id", "chan"], DILATE)
        return grown.select("run_id", "chan", F.greatest("t0_us", F.lit(0)).alias("t0_us"), F.least("t1_us", F.lit(TOTAL)).alias("t1_us")).where("t1_us > t0_us")

    def segments(self, label: str) -> DataFrame:
        """The segments of a condition."""
        from eventloom.operators import intervals

        return intervals.select_condition(self.on, self.spans, label)

    def pairs(self) -> DataFrame:
        """channels x detectors, so that channels without events count."""
        return self.channels.select("run_id", "chan").withColumn("detector", F.explode(F.array(*map(F.lit, DETECTORS))))


#: The same tables as common table expressions; every oracle starts with them.
BASE = f"""with recursive
ev as (select event_id, user_id % 5 as run_id, user_id as chan, event_type, epoch_us(ts) - {EPOCH} as t_us, value from events),
channels as (select distinct run_id, chan, 'A_' || chan as name, chan % 7 = 0 as is_ez from ev),
raw as (select run_id, event_type as detector, chan, t_us, value, event_id from ev where event_type in {DETECTORS}),
det as (select run_id, detector, chan, t_us, max(value) as value, min(event_id) as event_id from raw group by all),
truth as (select run_id, chan, t_us, value as amp, event_id from ev where event_type = 'signup'),
spans as (select distinct run_id, {TOTAL}::bigint as total_us from channels),
ons as (select run_id, ((k * 5 + 1) * {DAY})::bigint as t0_us, ((k * 5 + 3) * {DAY})::bigint as t1_us from spans, range(6) r(k)),
offs as (select run_id, case when k = 0 then 0 else ((k * 5 - 2) * {DAY})::bigint end as t0_us, case when k = 6 then {TOTAL} else ((k * 5 + 1) * {DAY})::bigint end as t1_us from spans, range(7) r(k) where k < 6 or 28 * {DAY} < {TOTAL}),
alls as (select run_id, 0::bigint as t0_us, total_us as t1_us from spans),
dets as (select unnest({list(DETECTORS)}) as detector),
pairs as (select c.run_id, c.chan, d.detector from channels c, dets d),
m0 as (select run_id, chan, t_us - {DILATE} as t0, t_us + 1 + {DILATE} as t1 from ev where event_type = 'error'),
m1 as (select *, max(t1) over (partition by run_id, chan order by t0, t1 rows between unbounded preceding and 1 preceding) as e from m0),
m2 as (select *, sum(case when e >= t0 then 0 else 1 end) over (partition by run_id, chan order by t0, t1 rows unbounded preceding) as g from m1),
mask as (select run_id, chan, greatest(min(t0), 0)::bigint as t0_us, least(max(t1), {TOTAL})::bigint as t1_us from m2 group by run_id, chan, g having least(max(t1), {TOTAL}) > greatest(min(t0), 0))
"""


def matched(name: str, a: str, b: str, tol: int) -> str:
    """CTEs for the greedy one-to-one match of two relations (g, id, t): `name` has (g, ia, ib, d) for each pair, d = a - b."""
    near = f"abs(a.t - b.t) <= {tol}"
    return f"""{name}_a as (select g, id, t, row_number() over (partition by g order by t, id) as k from ({a})),
{name}_b as (select g, id, t, row_number() over (partition by g order by t, id) as k from ({b})),
{name}_w as (select g, 1::bigint as i, 1::bigint as j, null::bigint as ia, null::bigint as ib, null::bigint as d from (select distinct g from {name}_a)
  union all select w.g, case when {near} or a.t < b.t then i + 1 else i end, case when {near} or a.t >= b.t then j + 1 else j end,
  case when {near} then a.id end, case when {near} then b.id end, case when {near} then a.t - b.t end
  from {name}_w w join {name}_a a on a.g = w.g and a.k = w.i join {name}_b b on b.g = w.g and b.k = w.j),
{name} as (select g, ia, ib, d from {name}_w where ia is not null)"""
