"""Queries of rates, ranks and condition effects, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators import intervals as I
from eventloom.operators import matching as M
from eventloom.operators import postprocess as P
from eventloom.operators import rates as R
from eventloom.plans.fixtures import BASE, BIN, DAY, DETECTORS, THRESHOLDS, TOTAL, Tables
from eventloom.plans.timebase import ANALYSABLE, SEGS, clean

QUERIES, ORACLES = {}, {}
ALL = list(DETECTORS)


def query(sql: str | None = None):
    """Register a function (tables -> DataFrame) as a query, with the SQL that follows the common tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return register


def rnd(df, *cols):
    """Rounded columns, for results that engines sum in another order."""
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def by_condition(t):
    """Rates a day by channel, detector and condition."""
    flagged = P.label_on(P.reject_masked(t.detections, t.mask(), DAY // 4), t.on, 2 * DAY)
    grid = t.pairs().withColumn("is_on", F.explode(F.array(F.lit(True), F.lit(False))))
    total = F.when(F.col("is_on"), 12 * DAY).otherwise(18 * DAY)
    return R.rates(R.counts(flagged, grid, ["run_id", "chan", "detector", "is_on"]), clean(t), ["run_id", "chan", "is_on"], DAY, total)


RATED = ANALYSABLE + f""", kept as (select d.*, exists (select 1 from ons o where o.run_id = d.run_id and d.t_us >= o.t0_us and d.t_us < o.t1_us) as is_on from det d where not exists (select 1 from mask m where m.run_id = d.run_id and m.chan = d.chan and d.t_us >= m.t0_us and d.t_us < m.t1_us)),
cn as (select run_id, chan, detector, is_on, count(*) as n from kept group by all),
rated as (select p.run_id, p.chan, p.detector, k.is_on, coalesce(cn.n, 0) as n, case when c.clean_us > 0 and c.clean_us / {DAY} >= 0.2 * (k.us / {DAY}) then coalesce(cn.n, 0)::double / (c.clean_us / {DAY}) end as rate
  from pairs p cross join conds k left join cn on cn.run_id = p.run_id and cn.chan = p.chan and cn.detector = p.detector and cn.is_on = k.is_on left join clean c on c.run_id = p.run_id and c.chan = p.chan and c.is_on = k.is_on)
"""


@query(RATED + "select run_id, chan, detector, is_on, n, round(rate, 6) as rate from rated")
def a1_rates(t):
    """Rates over analysable time, quiet channels kept."""
    return rnd(by_condition(t).select("run_id", "chan", "detector", "is_on", "n", "rate"), "rate")


@query(RATED + "select run_id, detector, is_on, sum(n)::bigint as total, round(avg(rate), 6) as mean_rate, arg_max(chan, (rate, -chan)) filter (where rate is not null) as busiest, round(max(rate), 6) as busiest_rate, count(*) filter (where rate is null) as excluded from rated group by all")
def a2_summary(t):
    """Rate summary per detector and condition."""
    return rnd(R.summary(by_condition(t), ["run_id", "detector", "is_on"]), "mean_rate", "busiest_rate")


OFF = RATED + """, pr as (select a.run_id, a.chan, a.detector as det_a, b.detector as det_b, a.rate as x, b.rate as y from rated a join rated b using (run_id, chan, is_on) where not a.is_on and a.detector < b.detector)
"""


def rho_sql(source: str, x: str, y: str, by: str) -> str:
    """A query for (by, n, rho) over a relation."""
    rank = lambda c: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0"
    return f"(select {by}, count(*) as n, case when var_pop(rx) > 0 and var_pop(ry) > 0 then round(corr(rx, ry), 6) end as rho from (select {by}, {rank(x)} as rx, {rank(y)} as ry from {source} where {x} is not null and {y} is not null) group by all)"


def off_pairs(t):
    """Detector pairs' OFF rates."""
    return R.paired(by_condition(t).where("not is_on"), ALL, ["run_id", "chan"])


BY = ["run_id", "det_a", "det_b"]
BY_SQL = "run_id, det_a, det_b"


@query(OFF + f", s as {rho_sql('pr', 'x', 'y', BY_SQL)}, g as (select {BY_SQL}, round(sum(x * y) / sum(x * x), 6) as gain, round(corr(x, y), 6) as r from pr where x is not null and y is not null group by all) select * from g join s using ({BY_SQL})")
def a3_a4_pairs(t):
    """Gain, Pearson and Spearman of every pair."""
    return rnd(R.pair_statistics(off_pairs(t), BY), "gain", "r", "rho")


@query(OFF + f", k as (select * from pr where x > 0 and y > 0), l as (select *, count(*) over (partition by {BY_SQL}, x) as cx, count(*) over (partition by {BY_SQL}, y) as cy from k), u as (select * from l where cx = 1 and cy = 1), s as {rho_sql('u', 'x', 'y', BY_SQL)} select *, n < 25 as thin from s where n >= 3")
def a5_rankable(t):
    """Spearman over the rankable channels without ties."""
    kept = R.rankable(off_pairs(t), BY, drop_ties=True)
    thin = kept.select(*BY, "thin").distinct()
    return rnd(R.spearman(kept, "x", "y", BY).join(thin, BY), "rho")


def numbered(t):
    """Daily counts of OFF with the bin's number in the run."""
    segments = t.segments("off")
    n = F.floor((F.col("t1_us") - F.col("t0_us")) / BIN)
    before = F.coalesce(F.sum(n).over(W.partitionBy("run_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = segments.select("run_id", "seg", before.alias("_before"))
    found = I.bin_counts(t.detections, segments, P.TRAIN, BIN, 3 * DAY).join(F.broadcast(first), ["run_id", "seg"])
    return found.withColumn("bin_no", F.col("_before") + F.col("bin")), I.bin_totals(segments, BIN)


SELF = f""", sg as (select *, (t1_us - t0_us) // {BIN} as nb from {SEGS['off']}), sb as (select *, coalesce(sum(nb) over (partition by run_id order by seg rows between unbounded preceding and 1 preceding), 0) as b0 from sg),
hb as (select d.run_id, d.detector, d.chan, s.b0 + (d.t_us - s.t0_us) // {BIN} as no from det d join sb s on s.run_id = d.run_id and d.t_us >= s.t0_us and d.t_us < s.t1_us),
halves as (select run_id, detector, chan, count(*) filter (where no % 2 = 0) as even, count(*) filter (where no % 2 = 1) as odd from hb group by all)
"""


@query(SELF + f"select run_id, detector, n, rho as self_rho from {rho_sql('halves', 'even', 'odd', 'run_id, detector')}")
def a6_self_rho(t):
    """Split-half reliability."""
    found, totals = numbered(t)
    return rnd(R.self_rho(found, totals, ["run_id", "detector"], ["bin_no"]), "self_rho")


@query(OFF + SELF + f", own as {rho_sql('halves', 'even', 'odd', 'run_id, detector')}, s as {rho_sql('pr', 'x', 'y', BY_SQL)}, j as (select s.*, sqrt(greatest(a.rho, 0) * greatest(b.rho, 0)) as ceiling from s left join own a on a.run_id = s.run_id and a.detector = det_a left join own b on b.run_id = s.run_id and b.detector = det_b) select {BY_SQL}, rho, round(ceiling, 4) as ceiling, round(case when ceiling > 0 then rho / ceiling end, 3) as share from j")
def a7_ceiling(t):
    """Pair correlation as a share of what the reliabilities allow."""
    found, totals = numbered(t)
    own = R.self_rho(found, totals, ["run_id", "detector"], ["bin_no"])
    rho = R.spearman(off_pairs(t), "x", "y", BY).drop("n")
    return R.ceiling(rho, own).select(*BY, F.round("rho", 6).alias("rho"), F.round("ceiling", 4).alias("ceiling"), F.round("share", 3).alias("share"))


SCOPED = RATED + """, sc as (select 'all' as scope, * from rated union all select 'ez', r.* from rated r join channels c using (run_id, chan) where c.is_ez),
md as (select scope, run_id % 2 as patient, detector, is_on, median(rate) as median, count(*) as n from sc where rate is not null group by all)
"""


def scoped(t):
    """Rates over all channels and the onset zone, with the patient."""
    return M.in_scopes(by_condition(t), t.channels.where("is_ez"), ["run_id", "chan"]).withColumn("patient", F.col("run_id") % 2)


SCOPE = ["scope", "patient", "detector", "is_on"]


@query(SCOPED + "select m.scope, m.patient, m.detector, m.is_on, m.n, round(m.median, 6) as median, round(median(abs(s.rate - m.median)) * 1.4826, 6) as mad from sc s join md m on m.scope = s.scope and m.patient = s.run_id % 2 and m.detector = s.detector and m.is_on = s.is_on where s.rate is not null group by all")
def a8_median_mad(t):
    """Median and MAD by patient, condition, detector and scope."""
    return rnd(R.median_mad(scoped(t), "rate", SCOPE), "median", "mad")


@query(SCOPED + "select detector, is_on, round(max(median) filter (where scope = 'all' and patient = 0) / nullif(max(median) filter (where scope = 'all' and patient = 1), 0), 6) as patients_ratio, round(max(median) filter (where scope = 'ez' and patient = 0) / nullif(max(median) filter (where scope = 'all' and patient = 0), 0), 6) as concentration from md group by all")
def a9_ratios(t):
    """Ratio of patients' medians, and of the onset zone to all."""
    m = R.median_mad(scoped(t), "rate", SCOPE)
    pick = lambda scope, patient: F.max(F.when((F.col("scope") == scope) & (F.col("patient") == patient), F.col("median")))
    over = lambda a, b: F.try_divide(a, F.when(b != 0, b))
    return rnd(m.groupBy("detector", "is_on").agg(over(pick("all", 0), pick("all", 1)).alias("patients_ratio"), over(pick("ez", 0), pick("all", 0)).alias("concentration")), "patients_ratio", "concentration")


@query(f""", segs as {SEGS["off"]}, grid as (select p.run_id, p.detector, p.chan, s.seg, unnest(range((s.t1_us - s.t0_us) // {BIN})) as bin from pairs p join segs s using (run_id)),
hits as (select d.run_id, d.detector, d.chan, s.seg, (d.t_us - s.t0_us) // {BIN} as bin, count(*) as n from det d join segs s on s.run_id = d.run_id and d.t_us >= s.t0_us and d.t_us < s.t1_us group by all),
c as (select g.*, coalesce(h.n, 0) as n from grid g left join hits h using (run_id, detector, chan, seg, bin)),
q as (select run_id, detector, chan, quantile_cont(n, 0.25) as q1, median(n) as q2, quantile_cont(n, 0.75) as q3, avg(n) as mean from c group by all)
select run_id, detector, chan, q1, q2, q3, round(mean, 6) as mean, min(n) filter (where n >= q1 - 1.5 * (q3 - q1) and n <= q3 + 1.5 * (q3 - q1)) as low, max(n) filter (where n >= q1 - 1.5 * (q3 - q1) and n <= q3 + 1.5 * (q3 - q1)) as high, count(*) filter (where not (n >= q1 - 1.5 * (q3 - q1) and n <= q3 + 1.5 * (q3 - q1))) as outliers from c join q using (run_id, detector, chan) group by all""")
def a10_box(t):
    """Box statistics of daily counts."""
    segments = t.segments("off")
    counts = I.filled(I.bin_counts(t.detections, segments, P.TRAIN, BIN, 3 * DAY), t.pairs(), segments, P.TRAIN, BIN)
    return rnd(R.box(counts, "n", P.TRAIN), "mean")


BOTH = RATED + ", bo as (select a.run_id, a.chan, a.detector, a.rate as on_rate, b.rate as off_rate, b.n as off_n, case when b.n >= 3 then a.rate / nullif(b.rate, 0) end as ratio from rated a join rated b using (run_id, chan, detector) where a.is_on and not b.is_on and a.rate is not null and b.rate is not null)"


def both(t):
    """Channels measured ON and OFF."""
    r = by_condition(t)
    return M.both_measurable(r.where("is_on"), r.where("not is_on"), ["run_id", "chan", "detector"])


@query(BOTH + """, lg as (select run_id, detector, round(ln(ratio), 12) as lg, abs(round(ln(ratio), 12)) as sz from bo where ratio > 0 and ratio <> 1),
rk as (select *, rank() over (partition by run_id, detector order by sz) + (count(*) over (partition by run_id, detector, sz) - 1) / 2.0 as place, count(*) over (partition by run_id, detector, sz) as tied from lg),
sg as (select run_id, detector, sum(case when lg > 0 then place else 0 end) as w_plus, count(*) as n_signed, sum(tied * tied - 1)::double as ties from rk group by all)
select bo.run_id, bo.detector, round(avg(on_rate), 6) as mean_on, round(avg(off_rate), 6) as mean_off, round(sum(on_rate) / sum(off_rate), 6) as pooled, round(median(ratio), 6) as median_ratio, count(*) filter (where ratio < 1) as n_down, count(*) filter (where ratio = 0) as n_zero, count(ratio) as n, any_value(w_plus) as w_plus, any_value(n_signed) as n_signed, any_value(ties) as ties from bo left join sg using (run_id, detector) group by all""")
def a11_m11_effect(t):
    """Paired ON/OFF effect with signed-rank sums; channels with fewer than three OFF events have no ratio."""
    return rnd(R.condition_effect(both(t), ["run_id", "detector"]), "mean_on", "mean_off", "pooled", "median_ratio")


@query()
def a11_effect_p(t):
    """The same with the p-value of the signed-rank sum."""
    return R.with_effect_p(R.condition_effect(both(t), ["run_id", "detector"])).select("run_id", "detector", "n", "n_zero", "w_plus", "n_signed", "ties", F.round("p", 9).alias("p"))


@query(BOTH + f", segs as (select run_id, t0_us, t1_us, true as is_on from ons union all select run_id, t0_us, t1_us, false from offs), g as (select s.*, d.detector from segs s, dets d), c as (select g.run_id, g.detector, g.is_on, g.t0_us, g.t1_us, count(d.t_us) as n from g left join (select det.* from det join bo using (run_id, chan, detector)) d on d.run_id = g.run_id and d.detector = g.detector and d.t_us >= g.t0_us and d.t_us < g.t1_us group by all), r as (select *, n / ((t1_us - t0_us) / {DAY}) as rate from c) select run_id, detector, is_on, t0_us, n, round(rate / nullif(avg(rate) over (partition by run_id, detector), 0), 6) as relative from r")
def a12_time_course(t):
    """Relative rate of each ON and OFF segment, over the channels measured in both."""
    segments = t.segments("on").withColumn("is_on", F.lit(True)).unionByName(t.segments("off").withColumn("is_on", F.lit(False)))
    kept = t.detections.join(both(t).select("run_id", "chan", "detector"), ["run_id", "chan", "detector"], "left_semi")
    found = [I.within(kept, t.segments(label), ["run_id"], 3 * DAY).groupBy("run_id", "detector", "seg").agg(F.count("*").alias("n")).withColumn("is_on", F.lit(label == "on")) for label in ("on", "off")]
    grid = segments.withColumn("detector", F.explode(F.array(*map(F.lit, ALL)))).join(found[0].unionByName(found[1]), ["run_id", "detector", "seg", "is_on"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rnd(R.time_course(grid, ["run_id", "detector"], DAY, DAY).select("run_id", "detector", "is_on", "t0_us", "n", "relative"), "relative")


@query(RATED + "select run_id, chan, round(max(rate) / greatest(min(rate), 1e-9), 3) as spread from rated where not is_on group by all having count(rate) = 3 and max(rate) >= 0.05 order by max(rate) / greatest(min(rate), 1e-9) desc, run_id, chan limit 10")
def a15_disagreement(t):
    """The ten channels on which detectors differ most."""
    return R.disagreement(by_condition(t).where("not is_on"), 3, 10, ["run_id", "chan"]).withColumn("spread", F.round("spread", 3))


@query(f", v as (select unnest([{', '.join(map(str, THRESHOLDS))}]) as value), c as (select v.value, count(*) filter (where o.run_id is not null) as n_on, count(*) filter (where o.run_id is null) as n_off from v join det d on d.detector = 'click' and d.value >= v.value left join ons o on o.run_id = d.run_id and d.t_us >= o.t0_us and d.t_us < o.t1_us group by all) select value, n_on, n_off, round((n_on / 12.0) / (n_off / 18.0), 6) as ratio from c")
def a16_pooled_ratio(t):
    """Pooled wall-clock ON/OFF ratio by threshold."""
    from eventloom.plans.matching import sweep

    rows = P.label_on(sweep(t, "click"), t.on, 2 * DAY).groupBy("value").agg(F.sum(F.col("is_on").cast("long")).alias("n_on"), F.sum((~F.col("is_on")).cast("long")).alias("n_off"))
    return rows.withColumn("ratio", F.round((F.col("n_on") / 12.0) / (F.col("n_off") / 18.0), 6))


RANKS = RATED + ", rk as (select r.run_id, r.detector, r.chan, c.is_ez, row_number() over (partition by r.run_id, r.detector order by coalesce(r.rate, -1) desc, r.chan) as rank from rated r join channels c using (run_id, chan) where not r.is_on)"


def ranks(t):
    """Places of channels by OFF rate."""
    rated = by_condition(t).where("not is_on").join(t.channels.select("run_id", "chan", "is_ez"), ["run_id", "chan"])
    return R.ranked(rated, ["run_id", "detector"])


@query(RANKS + " select * from rk")
def w1_ranks(t):
    """Channel ranks, unmeasured last."""
    return ranks(t).select("run_id", "detector", "chan", "is_ez", "rank")


@query(RANKS + ", z as (select *, sum(is_ez::int) over (partition by run_id, detector) as n from rk) select run_id, detector, max(n)::bigint as n_ez, count(*) as n_channels, count(*) filter (where is_ez and rank <= n) as hits, floor(median(rank) filter (where is_ez))::bigint as median_rank, max(rank) filter (where is_ez) as worst_rank, count(*) filter (where is_ez and rank > 3 * n) as far, round(max(n) * max(n) / count(*), 6) as chance, round(count(*) filter (where is_ez and rank <= n) / nullif(max(n) * max(n) / count(*), 0), 6) as times_chance from z group by all")
def w2_onset_report(t):
    """Onset contacts among the busiest."""
    return rnd(R.onset_report(ranks(t), ["run_id", "detector"]), "chance", "times_chance")


@query(RANKS + " select run_id, detector, rank, sum(is_ez::int) over (partition by run_id, detector order by rank)::bigint as found, round(rank * sum(is_ez::int) over (partition by run_id, detector) / count(*) over (partition by run_id, detector), 6) as chance from rk")
def w3_gain(t):
    """Cumulative gain."""
    return rnd(R.cumulative_gain(ranks(t), ["run_id", "detector"]), "chance")


@query(OFF + f", k as (select *, row_number() over (partition by {BY_SQL} order by x desc, chan) as a, row_number() over (partition by {BY_SQL} order by y desc, chan) as b from pr where x > 0 and y > 0) select {BY_SQL}, count(*) filter (where a <= 10 and b <= 10) as overlap from k group by all having count(*) >= 3")
def w4_top_overlap(t):
    """Overlap of the ten busiest."""
    return R.top_overlap(R.rankable(off_pairs(t), BY), BY, 10)


@query(RATED + ", tt as (select run_id, chan, round(sum(rate), 6) as total from rated where not is_on group by all) select *, rank() over (partition by run_id order by total desc nulls last) as place from tt")
def w5_busiest_first(t):
    """Channels by total rate, unmeasured last."""
    total = by_condition(t).where("not is_on").groupBy("run_id", "chan").agg(F.round(F.sum("rate"), 6).alias("total"))
    return total.withColumn("place", F.rank().over(W.partitionBy("run_id").orderBy(F.desc_nulls_last("total"))))


@query(", s as (select chan % 25 as subject, count(*) as n_events, count(distinct chan) as n_channels from truth group by 1), n as (select *, ntile(8) over (order by n_events, n_channels, subject) as stratum from s) select *, row_number() over (partition by stratum order by md5('7' || subject)) = 1 as train from n")
def w6_split(t):
    """A stratified train/test split of subjects."""
    subjects = t.truth.groupBy((F.col("chan") % 25).alias("subject")).agg(F.count("*").alias("n_events"), F.countDistinct("chan").alias("n_channels"))
    return R.stratified_split(subjects, 8, "7")


@query(" select 'all' as cond, run_id, detector, count(*) as n from det group by all union all select 'on', d.run_id, d.detector, count(*) from det d join ons o on o.run_id = d.run_id and d.t_us >= o.t0_us and d.t_us < o.t1_us group by all union all select 'off', d.run_id, d.detector, count(*) from det d join offs o on o.run_id = d.run_id and d.t_us >= o.t0_us and d.t_us < o.t1_us group by all")
def w9_columns(t):
    """The comparison columns of every run and condition; one pass tags each event with its condition."""
    flagged = P.label_on(t.detections, t.on, 2 * DAY)
    tagged = flagged.withColumn("cond", F.explode(F.array(F.lit("all"), F.when(F.col("is_on"), "on").otherwise("off"))))
    return tagged.groupBy("cond", "run_id", "detector").agg(F.count("*").alias("n"))


@query(" select distinct run_id, chan from channels where is_ez and chan % 3 <> 0")
def w10_missing(t):
    """Onset contacts that a recording lacks."""
    return M.missing(t.channels.where("is_ez"), t.channels.where("chan % 3 = 0"), ["run_id", "chan"])
