"""Queries of the time base and post-processing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import columns as C
from eventloom.operators import intervals as I
from eventloom.operators import postprocess as P
from eventloom.plans.fixtures import BASE, BIN, DAY, EPOCH, GUARD, HOUR, MERGE, TOTAL, Tables

QUERIES, ORACLES = {}, {}
SEG_COLUMNS = "run_id, row_number() over (partition by run_id order by t0_us) - 1 as seg, t0_us, t1_us"
SEGS = {k: f"(select {SEG_COLUMNS} from {k}s)" for k in ("on", "off", "all")}


def query(sql: str | None = None):
    """Register a function (tables -> DataFrame) as a query, with the SQL that follows the common tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return register


@query("select run_id, detector, count(*) as n, sum(t_us)::bigint as sum_t from (select distinct run_id, detector, chan, t_us from raw where t_us >= 0 and t_us < 30 * 86400000000) group by all")
def p1_clip_unique(t):
    """Clip to the recording and keep one event per time."""
    return P.clip_unique(t.raw, t.spans).groupBy("run_id", "detector").agg(F.count("*").alias("n"), F.sum("t_us").alias("sum_t"))


@query(f"select run_id, 'truth' as kind, count(*) as n from truth where t_us between {GUARD} and {TOTAL - GUARD} group by 1 union all select run_id, 'detections', count(*) from det where t_us between {GUARD} and {TOTAL - GUARD} group by 1")
def p2_edge_guard(t):
    """The guard on truth and detections alike."""
    one = lambda df, kind: P.edge_guard(df, t.spans, GUARD).groupBy("run_id").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return one(t.truth, "truth").unionByName(one(t.detections, "detections"))


@query(f"select run_id, detector, count(*) as n from det where t_us > {2 * HOUR} and t_us < {TOTAL - 2 * HOUR} group by all")
def p3_trim_edges(t):
    """Strictly inside the edges."""
    return P.trim_edges(t.detections, t.spans, 2 * HOUR).groupBy("run_id", "detector").agg(F.count("*").alias("n"))


@query(f", tagged as (select d.*, exists (select 1 from ons o where o.run_id = d.run_id and d.t_us >= o.t0_us and d.t_us < o.t1_us) as is_on from det d) select run_id, detector, is_on, count(*) as n from tagged where t_us < {20 * DAY} group by all")
def p4_select_on(t):
    """Detections by condition flag before a time limit."""
    return P.label_on(t.detections.where(F.col("t_us") < 20 * DAY), t.on, 2 * DAY).groupBy("run_id", "detector", "is_on").agg(F.count("*").alias("n"))


@query("select chan, translate(trim('  A''' || chan || '-x’ '), '''’-', '___') as label, left(regexp_extract(replace('_Ab' || chan, '_', ''), '^([A-Za-z]+)', 1), 1) as shaft, coalesce(nullif(left(regexp_extract(replace(chan::varchar || '_A', '_', ''), '^([A-Za-z]+)', 1), 1), ''), '?') as no_shaft from channels")
def p5_p9_labels(t):
    """Labels normalised, and shafts."""
    raw = F.concat(F.lit("  A'"), "chan", F.lit("-x’ "))
    return t.channels.select("chan", C.normalise_label(raw).alias("label"), C.shaft(F.concat(F.lit("_Ab"), "chan")).alias("shaft"), C.shaft(F.concat(F.col("chan").cast("string"), F.lit("_A"))).alias("no_shaft"))


def _markers(t):
    name = F.concat(F.lit("A-"), "chan")
    label = F.when(F.col("event_type") == "click", "Spike").otherwise("Ripple")
    return t.events.where("event_type in ('click', 'view')").select(F.col("run_id").alias("rec_id"), label.alias("label"), (F.col("t_us") / 1e6).alias("position"), F.array(name, F.concat(F.lit("A-"), F.col("chan") + 5)).alias("channels"))


@query(""", marks as (select run_id as rec_id, unnest(['A_' || chan, 'A_' || (chan + 5)]) as name, round_even(t_us / 1e6 * 0.1, 0)::bigint as idx from ev where event_type = 'click'),
u as (select distinct * from marks) select c.run_id as rec_id, c.name, count(u.idx) as n, sum(u.idx)::bigint as sum_idx from channels c left join u on u.rec_id = c.run_id and u.name = c.name group by all""")
def p6_p7_markers(t):
    """A marker list on the channels of the recording, times to samples, empty channels kept."""
    channels = t.channels.select(F.col("run_id").alias("rec_id"), "name")
    found = P.from_markers(_markers(t), channels, 0.1)
    return found.groupBy("rec_id", "name").agg(F.count("idx").alias("n"), F.sum("idx").alias("sum_idx"))


@query(", known as (select distinct run_id, 'A_' || (chan + 5) as name from ev where event_type = 'click') select c.run_id as rec_id, avg(case when k.name is null then 0.0 else 1.0 end) as matched, avg(case when k.name is null then 0.0 else 1.0 end) < 0.8 as low from channels c left join known k on k.run_id = c.run_id and k.name = c.name group by 1")
def p7_matched_share(t):
    """How many of the pipeline's labels a detector knows."""
    names = _markers(t).where("label = 'Spike'").select("rec_id", F.col("channels")[1].alias("name"))
    return P.matched_share(t.channels.select(F.col("run_id").alias("rec_id"), "name"), names)


@query("select event_id, round_even(t_us / 1e6 * 0.25, 0)::bigint as even, round(t_us / 1e6 * 0.25)::bigint as away from truth")
def p8_p11_rounding(t):
    """Both rounding rules side by side."""
    return t.truth.select("event_id", C.to_samples(F.col("t_us") / 1e6, 0.25).alias("even"), C.half_away(F.col("t_us") / 1e6 * 0.25).alias("away"))


@query(", c as (select d.run_id, d.detector, d.chan, count(*) filter (where o.run_id is not null) as on_n, count(*) filter (where o.run_id is null) as off_n from det d left join ons o on o.run_id = d.run_id and d.t_us >= o.t0_us and d.t_us < o.t1_us group by all) select run_id, detector, chan, case when off_n >= 3 and on_n > 0 then round(log2((on_n / 12.0) / (off_n / 18.0)), 6) end as effect from c")
def p10_log_effect(t):
    """log2 ON/OFF rates a day."""
    counts = P.label_on(t.detections, t.on, 2 * DAY).groupBy("run_id", "detector", "chan").agg(F.sum(F.col("is_on").cast("long")).alias("on_n"), F.sum((~F.col("is_on")).cast("long")).alias("off_n"))
    return counts.select("run_id", "detector", "chan", F.round(C.log_effect(F.col("on_n") / 12.0, F.col("off_n") / 18.0, F.col("off_n")), 6).alias("effect"))


@query(", f as (select run_id, d::bigint as i, d % 5 in (1, 2) as flag from spans, range(30) r(d)), g as (select run_id, i, i - row_number() over (partition by run_id order by i) as k from f where flag) select run_id, min(i)::bigint as start, max(i)::bigint + 1 as stop from g group by run_id, k")
def i1_on_runs(t):
    """ON runs from daily flags."""
    return I.runs_of_flags(t.day_flags.select("run_id", F.col("slice").alias("i"), F.col("is_on").alias("flag")), ["run_id"])


@query(f", e as (select run_id, t_us as a, t_us + {10 * HOUR} as b from ev where event_type = 'signup' and value > 60), f as (select *, max(b) over (partition by run_id order by a, b rows between unbounded preceding and 1 preceding) as m from e), g as (select *, sum(case when m >= a then 0 else 1 end) over (partition by run_id order by a, b rows unbounded preceding) as k from f) select run_id, min(a) as t0_us, max(b) as t1_us from g group by run_id, k")
def i2_epochs_union(t):
    """Flagged epochs of fixed length united to ON segments."""
    epochs = t.truth.where("amp > 60").select("run_id", F.col("t_us").alias("t0_us"), (F.col("t_us") + 10 * HOUR).alias("t1_us"))
    return I.union(epochs, ["run_id"])


@query("select * from offs")
def i3_complement(t):
    """OFF as the gaps of ON."""
    return I.complement(t.on, t.spans, ["run_id"])


@query("select * from mask")
def i4_mask(t):
    """The mask grown and united per channel."""
    return t.mask()


@query(f", f as (select run_id, chan, (t_us // {HOUR})::bigint as i from ev where event_type = 'error') select run_id, chan, (i // 7)::bigint as coarse, true as bad from f group by 1, 2, 3")
def i5_fold_mask(t):
    """An hourly mask at a seventh of its rate: bad if any fine sample is."""
    fine = t.events.where("event_type = 'error'").select("run_id", "chan", F.floor(F.col("t_us") / HOUR).alias("i"), F.lit(True).alias("bad"))
    return fine.groupBy("run_id", "chan", F.floor(F.col("i") / 7).alias("coarse")).agg(F.bool_or("bad").alias("bad"))


@query("select run_id, detector, chan, count(*) as n, sum(t_us)::bigint as sum_t from det d where not exists (select 1 from mask m where m.run_id = d.run_id and m.chan = d.chan and d.t_us >= m.t0_us and d.t_us < m.t1_us) group by all")
def i6_reject(t):
    """Detections outside the mask."""
    return P.reject_masked(t.detections, t.mask(), 6 * HOUR).groupBy("run_id", "detector", "chan").agg(F.count("*").alias("n"), F.sum("t_us").alias("sum_t"))


_MIXED = f"select run_id, chan, t0_us, t1_us from mask where chan % 10 <> 0 union all select run_id, chan, {2 * DAY}::bigint, {23 * DAY}::bigint from channels where chan % 10 = 0"


@query(f", mx as ({_MIXED}) select run_id, detector, count(*) as n, sum(t_us)::bigint as sum_t from det d where not exists (select 1 from mx where mx.run_id = d.run_id and mx.chan = d.chan and d.t_us >= mx.t0_us and d.t_us < mx.t1_us) group by all")
def i6_reject_any_length(t):
    """Events outside a mask whose intervals last hours on some channels and weeks on others, by one scan."""
    weeks = t.channels.where("chan % 10 = 0").select("run_id", "chan", F.lit(2 * DAY).cast("long").alias("t0_us"), F.lit(23 * DAY).cast("long").alias("t1_us"))
    mask = t.mask().where("chan % 10 <> 0").unionByName(weeks)
    return I.within(t.detections, mask, ["run_id", "chan"], None, "left_anti").groupBy("run_id", "detector").agg(F.count("*").alias("n"), F.sum("t_us").alias("sum_t"))


@query(f", s as (select *, unnest(range(t0_us // {DAY}, (t1_us - 1) // {DAY} + 1)) as slice from mask) select run_id, chan, slice, ({DAY} - sum(least(t1_us, (slice + 1) * {DAY}) - greatest(t0_us, slice * {DAY})))::bigint as clean_us from s group by all")
def i7_clean_per_day(t):
    """Unmasked time per channel and day, where a mask touches it."""
    return I.overlap_per_slice(t.mask(), ["run_id", "chan"], DAY).select("run_id", "chan", "slice", (DAY - F.col("covered_us")).cast("long").alias("clean_us"))


ANALYSABLE = f""", sl as (select *, unnest(range(t0_us // {DAY}, (t1_us - 1) // {DAY} + 1)) as slice from mask),
lost as (select run_id, chan, slice % 5 in (1, 2) as is_on, sum(least(t1_us, (slice + 1) * {DAY}) - greatest(t0_us, slice * {DAY})) as us from sl group by all),
conds as (select true as is_on, {12 * DAY}::bigint as us union all select false, {18 * DAY}::bigint),
clean as (select c.run_id, c.chan, k.is_on, (k.us - coalesce(l.us, 0))::bigint as clean_us from channels c cross join conds k left join lost l on l.run_id = c.run_id and l.chan = c.chan and l.is_on = k.is_on)
"""


def clean(t):
    """Analysable time by channel and condition."""
    return I.analysable(t.channels, t.mask(), t.day_flags, DAY, TOTAL)


@query(ANALYSABLE + "select * from clean")
def i8_analysable(t):
    """Measured, never scaled."""
    return clean(t)


@query(", o as (select d.event_id, coalesce(least(d.t_us // 86400000000, 29) % 5 in (1, 2), false) as is_on from det d) select * from o")
def i9_flag_by_slice(t):
    """The ON flag of the slice an event lies in, clipped to the last one."""
    placed = t.detections.withColumn("slice", F.least(F.floor(F.col("t_us") / DAY), F.lit(29)))
    return placed.join(F.broadcast(t.day_flags), ["run_id", "slice"]).select("event_id", "is_on")


@query(" union all ".join(f"select '{k}' as cond, * from {SEGS[k]}" if i else f"select '{k}' as cond, * from {SEGS[k]}" for i, k in enumerate(("all", "on", "off"))))
def i10_segments(t):
    """The segments of every condition."""
    parts = [t.segments(k).select(F.lit(k).alias("cond"), "run_id", "seg", "t0_us", "t1_us") for k in ("all", "on", "off")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select run_id, sum(t1_us - t0_us)::bigint as total_us, count(*) as n, min(t1_us - t0_us) as min_us, max(t1_us - t0_us) as max_us from offs group by 1")
def i11_describe(t):
    """Length and number of the OFF segments."""
    return I.described(t.segments("off"))


ISI = f""", segs as {SEGS["off"]}, isi as (select d.*, s.seg, d.t_us - lag(d.t_us) over (partition by d.run_id, d.detector, d.chan, s.seg order by d.t_us) as isi_us from det d join segs s on s.run_id = d.run_id and d.t_us >= s.t0_us and d.t_us < s.t1_us) """


def isis(t, label="off"):
    """Intervals inside the segments of a condition."""
    return I.isis(t.detections, t.segments(label), P.TRAIN, 3 * DAY)


@query(ISI + "select run_id, detector, chan, seg, count(isi_us) as n, sum(isi_us)::bigint as sum_us from isi group by all")
def i12_isis(t):
    """Intervals that never span a gap."""
    return isis(t).groupBy("run_id", "detector", "chan", "seg").agg(F.count("isi_us").alias("n"), F.sum("isi_us").alias("sum_us"))


@query(f"select run_id, seg, b as bin, (t0_us + b * {BIN * 7 // 10})::bigint as t0_us from (select *, unnest(range((t1_us - t0_us) // {BIN * 7 // 10})) as b from {SEGS['off']})")
def i13_bins(t):
    """Whole bins that do not divide the segments."""
    return I.bins(t.segments("off"), BIN * 7 // 10)


COUNTS = f""", segs as {SEGS["off"]}, grid as (select p.run_id, p.detector, p.chan, s.seg, unnest(range((s.t1_us - s.t0_us) // {BIN})) as bin from pairs p join segs s using (run_id)),
hits as (select d.run_id, d.detector, d.chan, s.seg, (d.t_us - s.t0_us) // {BIN} as bin, count(*) as n from det d join segs s on s.run_id = d.run_id and d.t_us >= s.t0_us and d.t_us < s.t1_us group by all),
counts as (select g.*, coalesce(h.n, 0) as n from grid g left join hits h using (run_id, detector, chan, seg, bin))
"""


@query(COUNTS + "select * from counts")
def i14_bin_counts(t):
    """Counts with zero bins kept."""
    segments = t.segments("off")
    return I.filled(I.bin_counts(t.detections, segments, P.TRAIN, BIN, 3 * DAY), t.pairs(), segments, P.TRAIN, BIN)


@query(f", segs as {SEGS['off']}, p as (select run_id, detector, chan, t_us, lead(t_us) over (partition by run_id, detector, chan order by t_us) as nxt from det), q as (select p.*, a.seg as sa, b.seg as sb from p left join segs a on a.run_id = p.run_id and p.t_us >= a.t0_us and p.t_us < a.t1_us left join segs b on b.run_id = p.run_id and p.nxt >= b.t0_us and p.nxt < b.t1_us where nxt is not null) select run_id, detector, count(*) filter (where sa = sb) as same, count(*) as n from q group by all")
def i15_same_segment(t):
    """How many neighbours share a segment."""
    from pyspark.sql import Window as W

    segments = t.segments("off").select("run_id", "seg", "t0_us", "t1_us")
    pairs = t.detections.withColumn("nxt", F.lead("t_us").over(W.partitionBy(*P.TRAIN).orderBy("t_us"))).where("nxt is not null").select(*P.TRAIN, "t_us", "nxt")
    first = I.within(pairs, segments, ["run_id"], 3 * DAY, "left").select(*P.TRAIN, "nxt", F.col("seg").alias("sa"))
    both = I.within(first.withColumnRenamed("nxt", "t_us"), segments.select("run_id", F.col("seg").alias("sb"), "t0_us", "t1_us"), ["run_id"], 3 * DAY, "left")
    return both.groupBy("run_id", "detector").agg(F.sum(F.coalesce((F.col("sa") == F.col("sb")).cast("long"), F.lit(0))).alias("same"), F.count("*").alias("n"))


@query(f", a as (select *, case when t_us - lag(t_us) over w < {MERGE} then 0 else 1 end as new from det window w as (partition by run_id, detector, chan order by t_us)), b as (select *, sum(new) over (partition by run_id, detector, chan order by t_us rows unbounded preceding) as k from a) select run_id, detector, chan, min(t_us) as t_us, count(*) as merged from b group by run_id, detector, chan, k")
def i16_merge_close(t):
    """Chains of close marks become their first."""
    return P.merge_close(t.detections, MERGE)


PLAN = f""", plan as (select run_id, w as "window", (w * {4 * DAY})::bigint as start_us, least(w * {4 * DAY} + {5 * DAY}, {TOTAL})::bigint as stop_us, case when w = 0 then 0 else w * {4 * DAY} + {DAY // 2} end::bigint as t0_us, case when w = 7 then {TOTAL} else w * {4 * DAY} + {4 * DAY + DAY // 2} end::bigint as t1_us from spans, range(8) r(w))
"""


@query(PLAN + "select * from plan")
def i17_window_plan(t):
    """Five-day windows that overlap by one."""
    return I.window_plan(t.spans, 5 * DAY, DAY)


@query(PLAN + ", marks as (select d.run_id, d.detector, d.chan, p.\"window\", d.t_us - p.start_us as t_us, p.start_us, p.t0_us, p.t1_us from det d join plan p on p.run_id = d.run_id and d.t_us >= p.start_us and d.t_us < p.stop_us) select run_id, detector, chan, \"window\", count(*) as n, sum(t_us + start_us)::bigint as sum_t from marks where t_us + start_us >= t0_us and t_us + start_us < t1_us group by all")
def i18_assemble(t):
    """Windowed marks back on one clock, none twice."""
    plan = I.window_plan(t.spans, 5 * DAY, DAY)
    marks = I.within(t.detections, plan.select("run_id", "window", F.col("start_us").alias("t0_us"), F.col("stop_us").alias("t1_us")), ["run_id"], 5 * DAY).select(*P.TRAIN, "window", (F.col("t_us") - F.col("t0_us")).alias("t_us"))
    return P.assemble(marks, plan).groupBy(*P.TRAIN, "window").agg(F.count("*").alias("n"), F.sum("t_us").alias("sum_t"))


@query(f", a as (select *, case when t_us - lag(t_us) over w < {MERGE} then 0 else 1 end as new from det window w as (partition by run_id, detector, chan order by t_us)) select run_id, detector, count(*) filter (where new = 1) as n from a group by all")
def i19_merge_after_assembly(t):
    """Merging once more over the joins of windows."""
    plan = I.window_plan(t.spans, 5 * DAY, DAY)
    marks = I.within(t.detections, plan.select("run_id", "window", F.col("start_us").alias("t0_us"), F.col("stop_us").alias("t1_us")), ["run_id"], 5 * DAY).select(*P.TRAIN, "window", (F.col("t_us") - F.col("t0_us")).alias("t_us"))
    return P.merge_close(P.assemble(marks, plan), MERGE).groupBy("run_id", "detector").agg(F.count("*").alias("n"))


@query(f", k as (select d.*, not exists (select 1 from mask m where m.run_id = d.run_id and m.chan = d.chan and d.t_us >= m.t0_us and d.t_us < m.t1_us) as ok from det d), g as (select *, case when ok and coalesce(t_us - lag(t_us) over (partition by run_id, detector, chan, ok order by t_us) >= {MERGE}, true) then 1 else 0 end as new from k) select run_id, detector, count(*) as n_raw, count(*) filter (where ok) as n_unmasked, sum(new)::bigint as n_merged from g group by all")
def i20_attrition(t):
    """Raw, unmasked and merged counts in one pass."""
    return P.attrition(t.detections, t.mask(), MERGE, 6 * HOUR)


@query(f", k as (select *, greatest(round_even(20 * (t1_us - t0_us) / sum(t1_us - t0_us) over (partition by run_id), 0), 1)::bigint as k, t0_us + {HOUR} as f, t1_us - {2 * HOUR} - {HOUR} as l from {SEGS['on']}) select run_id, seg, floor(f + i * case when k > 1 then (l - f) / (k - 1) else 0.0 end)::bigint as t_us from (select *, unnest(range(k)) as i from k)")
def i21_sample_windows(t):
    """Evenly spaced windows by segment length."""
    return I.sample_windows(t.segments("on"), 20, HOUR, HOUR, 2 * HOUR)


@query(ISI + ", m as (select detector, min(isi_us) as min_us from isi group by 1 having min(isi_us) is not null) select *, (select min(min_us) = max(min_us) from m) as same from m")
def i22_merge_floor(t):
    """The least interval of each detector."""
    return P.merge_floor(isis(t))
