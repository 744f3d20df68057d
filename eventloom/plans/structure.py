"""Queries of train structure, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import columns as C
from eventloom.operators import structure as S
from eventloom.plans.fixtures import ACTIVITY, BASE, DAY, HOUR, SYNC, TOTAL, Tables
from eventloom.plans.timebase import ISI, SEGS, isis

QUERIES, ORACLES = {}, {}
BY = ["run_id", "detector"]


def query(sql: str | None = None):
    """Register a function (tables -> DataFrame) as a query, with the SQL that follows the common tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return register


def rnd(df, *cols, places=6):
    """Rounded columns, for results that engines sum in another order."""
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


@query(ISI + f"select run_id, detector, round(stddev_pop(isi_us) / avg(isi_us), 6) as cv, median(isi_us) as median_us, min(isi_us) as min_us, round(count(*) filter (where isi_us < {6 * HOUR}) / count(*), 6) as burst_fraction from isi group by all")
def x1_x2_isi(t):
    """Interval summary and bursts."""
    return rnd(S.isi_summary(isis(t), BY, 6 * HOUR), "cv", "burst_fraction")


_LOW, _HIGH = HOUR, 10 * DAY


def _hist(log: bool) -> str:
    scale = (lambda x: f"ln({x}::double)") if log else (lambda x: f"({x})::double")
    lo, step = scale(_LOW), f"(({scale(_HIGH)} - {scale(_LOW)}) / 59)"
    edge = (lambda k: f"exp({lo} + {k} * {step})") if log else (lambda k: f"({lo} + {k} * {step})")
    return ISI + f""", h as (select detector, least(floor(({scale('isi_us')} - {lo}) / {step}), 58)::bigint as bin, count(*) as n from isi where isi_us between {_LOW} and {_HIGH} group by all)
select detector, bin, n, round({DAY} * n / (sum(n) over (partition by detector) * ({edge('(bin + 1)')} - {edge('bin')})), 6) as density from h"""


@query(_hist(True))
def x3_histogram_log(t):
    """Log-spaced interval histogram, density per day."""
    return rnd(S.isi_histogram(isis(t), ["detector"], _LOW, _HIGH).withColumn("density", F.col("density") * DAY), "density")


@query(_hist(False))
def x3_histogram_linear(t):
    """Evenly spaced interval histogram, density per day."""
    return rnd(S.isi_histogram(isis(t), ["detector"], _LOW, _HIGH, log=False).withColumn("density", F.col("density") * DAY), "density")


@query(ISI + f"select detector, round(avg(case when isi_us < {3 * HOUR} then 1.0 else 0.0 end), 6) as share from isi where isi_us is not null group by 1")
def x4_band(t):
    """Share of short intervals."""
    return rnd(S.band_fraction(isis(t), ["detector"], 3 * HOUR), "share")


def _sync_sql(source: str, by: str) -> str:
    return f"select {by}, count(*) as n, avg(case when a - o > 0 then 1.0 else 0.0 end) as synchrony from (select {by}, count(*) over (partition by {by} order by t_us range between {SYNC} preceding and {SYNC} following) as a, count(*) over (partition by {by}, chan order by t_us range between {SYNC} preceding and {SYNC} following) as o from {source}) group by all"


@query(" select run_id, detector, n, round(synchrony, 6) as synchrony from (" + _sync_sql("det", "run_id, detector") + ")")
def x5_synchrony(t):
    """Events with another channel's event near."""
    return rnd(S.synchrony(t.detections, BY, SYNC, DAY), "synchrony")


@query(f", mv as (select run_id, detector, chan, rep, (t_us + ('0x' || substr(md5(chan || '/' || rep), 1, 12))::bigint % {TOTAL}) % {TOTAL} as t_us from det, range(3) r(rep)), o as (" + _sync_sql("det", "run_id, detector") + "), c as (select run_id, detector, avg(synchrony) as chance from (" + _sync_sql("mv", "run_id, detector, rep") + ") group by all) select run_id, detector, round(synchrony, 6) as observed, round(chance, 6) as chance, round(synchrony - chance, 6) as excess from o join c using (run_id, detector)")
def x6_chance(t):
    """Synchrony against shifted channels."""
    both = S.synchrony(t.detections, BY, SYNC, DAY).join(S.chance_synchrony(t.detections, BY, SYNC, DAY, TOTAL), BY)
    return rnd(both.select(*BY, F.col("synchrony").alias("observed"), "chance", (F.col("synchrony") - F.col("chance")).alias("excess")), "observed", "chance", "excess")


_COND = f""", sg as (select 'on' as cond, run_id, t0_us, t1_us from ons union all select 'off', run_id, t0_us, t1_us from offs), ck as (select *, coalesce(sum(t1_us - t0_us) over (partition by cond, run_id order by t0_us rows between unbounded preceding and 1 preceding), 0)::bigint as ahead, (sum(t1_us - t0_us) over (partition by cond, run_id))::bigint as total from sg),
dc as (select cond, d.run_id, d.detector, d.chan, d.t_us, d.t_us - t0_us + ahead as c_us, total from det d join ck on ck.run_id = d.run_id and d.t_us >= t0_us and d.t_us < t1_us),
mv as (select cond, run_id, detector, chan, rep, (c_us + ('0x' || substr(md5(chan || '/' || rep), 1, 12))::bigint % total) % total as t_us from dc, range(3) r(rep)), o as ("""


@query(_COND + _sync_sql("dc", "cond, run_id, detector") + "), c as (select cond, run_id, detector, avg(synchrony) as chance from (" + _sync_sql("mv", "cond, run_id, detector, rep") + ") group by all) select cond, run_id, detector, n, round(synchrony, 6) as observed, round(chance, 6) as chance, round(synchrony - chance, 6) as excess from o join c using (cond, run_id, detector)")
def x6_chance_in_condition(t):
    """Synchrony while ON and OFF against channels shifted on the condition's own clock."""
    on, off = (t.segments(label).select(F.lit(label).alias("cond"), "run_id", "t0_us", "t1_us") for label in ("on", "off"))
    both = t.detections.withColumn("cond", F.explode(F.array(F.lit("on"), F.lit("off"))))
    found = S.synchrony_in_condition(both, on.unionByName(off), ["cond", "run_id"], ["cond", *BY], SYNC, DAY, 2 * DAY)
    return rnd(found.select("cond", *BY, "n", "observed", "chance", (F.col("observed") - F.col("chance")).alias("excess")), "observed", "chance", "excess")


_WIDTHS = [DAY // 2, DAY, 2 * DAY, 3 * DAY, 7 * DAY]
_W = "(select unnest([" + ", ".join(map(str, _WIDTHS)) + "]::bigint[]) as w)"
_BINS = f", ws as {_W}, bw as (select run_id, detector, chan, w, t_us // w as bin, count(*) as n from det, ws where t_us // w < {TOTAL} // w group by all), rt as (select run_id, detector, chan, count(*) / ({TOTAL} / {DAY}) as rate from det group by all)"


@query(_BINS + f", m as (select run_id, detector, chan, w, sum(n) / ({TOTAL} // w) as mu, sum(n * n) / ({TOTAL} // w) as q from bw where w <= {TOTAL} / 8 group by run_id, detector, chan, w) select m.run_id, m.detector, w as width_us, round(median((q - mu * mu) / mu), 6) as fano, count(*) as channels from m join rt using (run_id, detector, chan) where rate > 0.2 group by all")
def x7_fano(t):
    """Fano factor against bin width."""
    return rnd(S.fano(t.detections, BY, _WIDTHS, TOTAL, 0.2, DAY), "fano")


_ACT = f", g as (select distinct run_id, detector, b as bin from pairs, range({TOTAL // ACTIVITY}) r(b)), h as (select run_id, detector, t_us // {ACTIVITY} as bin, count(*) as n from det group by all), a as (select g.*, coalesce(h.n, 0) as n from g left join h using (run_id, detector, bin))"


@query(_ACT + " select run_id, detector, round(stddev_samp(n) / avg(n), 6) as cv, round(stddev_samp(n) / avg(n) * sqrt(avg(n)), 6) as over_poisson from a group by all")
def x8_activity(t):
    """Variability of pooled counts."""
    return rnd(S.activity(t.detections, t.pairs(), BY, ACTIVITY, TOTAL)[0], "cv", "over_poisson")


@query(_ACT + " select run_id, detector, bin, n, round(n / avg(n) over (partition by run_id, detector), 6) as relative, round(1 / sqrt(avg(n) over (partition by run_id, detector)), 6) as band from a")
def x8_activity_series(t):
    """The series behind it."""
    return rnd(S.activity(t.detections, t.pairs(), BY, ACTIVITY, TOTAL)[1], "relative", "band")


_TIERS = [(0.0, 0.4), (0.4, 0.5), (0.5, 99.0)]
_ERR = _BINS + f""", tr as (select *, case {' '.join(f'when rate >= {a} and rate < {b} then {i}' for i, (a, b) in enumerate(_TIERS))} end as tier from rt), tc as (select *, count(*) over (partition by tier) as channels from tr where tier is not null),
gr as (select tc.*, w, unnest(range({TOTAL} // w)) as bin from tc, ws), er as (select tier, channels, w, abs(coalesce(bw.n, 0) / (gr.w / {DAY}) - rate) / rate as e from gr left join bw using (run_id, detector, chan, w, bin) where channels >= 3)
"""


@query(_ERR + "select tier, channels, w as width_us, round(median(e), 6) as error from er group by all")
def x9_width_error(t):
    """Error of binned rates by width and tier."""
    return rnd(S.width_errors(t.detections, _WIDTHS, _TIERS, TOTAL, DAY), "error")


@query(_ERR + ", m as (select tier, w, median(e) as e from er group by all) select tier, min(w) filter (where e <= 0.6) as width_us from m group by 1")
def x9_least_width(t):
    """The least width whose error is small enough."""
    return S.least_width(S.width_errors(t.detections, _WIDTHS, _TIERS, TOTAL, DAY), 0.6)


@query(_BINS + f" select run_id, detector, chan, round(1 / sqrt(rate * 2.0), 6) as floor_two_days, round(25 / rate, 6) as days_20, round(100 / rate, 6) as days_10 from rt")
def x10_poisson_floor(t):
    """What chance alone allows."""
    rate = t.detections.groupBy("run_id", "detector", "chan").agg((F.count("*") / (TOTAL / DAY)).alias("rate"))
    return rnd(rate.select("run_id", "detector", "chan", C.poisson_floor(F.col("rate"), 2.0).alias("floor_two_days"), (25 / F.col("rate")).alias("days_20"), (100 / F.col("rate")).alias("days_10")), "floor_two_days", "days_20", "days_10")


_CUTS = [h * HOUR for h in (1, 3, 6, 12, 24, 48)]


@query(ISI + f", c as (select unnest([{', '.join(map(str, _CUTS))}]::bigint[]) as cut_us) select detector, cut_us, round(count(*) filter (where isi_us < cut_us) / count(*), 6) as absorbed, round((count(*) - count(*) filter (where isi_us < cut_us)) / 18.0, 6) as surviving from isi, c group by all")
def x11_absorption(t):
    """What each merge gap would absorb."""
    return rnd(S.absorption(isis(t), ["detector"], _CUTS, 18.0), "absorbed", "surviving")


_PAIR, _WIN = 18 * HOUR, 12 * HOUR
_CAND = ISI + f""", sd as (select run_id, chan, t_us - isi_us as t, isi_us as gap from isi where isi_us <= {_PAIR}), sn as (select *, row_number() over (partition by run_id, chan order by t, gap) as k from sd),
wk as (select run_id, chan, k, t, gap, t as kept, true as keep from sn where k = 1 union all select s.run_id, s.chan, s.k, s.t, s.gap, case when s.t - w.kept >= {_WIN} then s.t else w.kept end, s.t - w.kept >= {_WIN} from wk w join sn s on s.run_id = w.run_id and s.chan = w.chan and s.k = w.k + 1),
kp as (select run_id, chan, t, gap from wk where keep), ct as (select k.run_id, k.chan, k.t, k.gap, q.detector, count(d.t_us) as n from kp k cross join dets q left join det d on d.run_id = k.run_id and d.chan = k.chan and d.detector = q.detector and d.t_us >= k.t - {_WIN} and d.t_us <= k.t + {2 * _WIN} group by all),
cand as (select run_id, chan, t as t_us, gap as gap_us, max(n) as most, max(n) - min(n) as spread from ct group by all having max(n) >= 2)
"""


def candidates(t):
    """Burst candidates of the OFF segments."""
    return S.candidates(isis(t), t.detections, _PAIR, _WIN)


@query(_CAND + "select * from cand")
def x12_candidates(t):
    """Burst candidates."""
    return candidates(t)


_BANDS = [0, HOUR, 3 * HOUR, 6 * HOUR, 12 * HOUR, 18 * HOUR]


@query(_CAND + f", b as (select *, case {' '.join(f'when gap_us >= {a} and gap_us < {b} then {a}' for a, b in zip(_BANDS[1:], _BANDS[2:]))} end as band_us from cand) select band_us, count(*) as n from b where band_us is not null group by 1")
def x13_bands(t):
    """Candidates by gap band above the merge floor."""
    return S.band_histogram(candidates(t), _BANDS, HOUR)


@query(f", g as (select distinct run_id, b as bin from channels, range(30) r(b)), h as (select run_id, t_us // {DAY} as bin, count(*) as n from det group by all) select g.run_id, g.bin, coalesce(h.n, 0) as n from g left join h using (run_id, bin)")
def x14_population(t):
    """Events of all channels by day."""
    hits = t.detections.groupBy("run_id", F.floor(F.col("t_us") / DAY).alias("bin")).agg(F.count("*").alias("n"))
    grid = t.spans.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("bin"))
    return grid.join(hits, ["run_id", "bin"], "left").select("run_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


_SHAFT = "chr((65 + chan % 7)::int) as shaft"


def diverse_sql(name: str, rows: str, by: str, order: str, n: str) -> str:
    """CTEs up to `name`: the first n rows a group, no channel twice, new shafts first."""
    return f"{name}_c as (select *, row_number() over (partition by {by}, run_id, chan order by {order}) as c from {rows}), {name}_s as (select *, least(row_number() over (partition by {by}, shaft order by {order}), 2) as s from {name}_c where c = 1), {name} as (select * from (select *, row_number() over (partition by {by} order by s, {order}) as turn from {name}_s) where turn <= {n})"


@query(_CAND + f", r as (select *, {_SHAFT}, case when gap_us < {6 * HOUR} then 0 else 1 end as band from cand where most <= 8), " + diverse_sql("ap", "r", "band", "spread desc, gap_us, run_id, chan, t_us", "5") + ", md as (select band, median(most) as middle from r group by 1), tk as (select band, count(*) as taken from ap group by 1), ot as (select r.*, abs(most - middle) as far, taken from r join md using (band) join tk using (band) where not exists (select 1 from ap where ap.band = r.band and ap.run_id = r.run_id and ap.chan = r.chan)), " + diverse_sql("ty", "ot", "band", "far, spread, gap_us, run_id, chan, t_us", "10 - taken") + " select band, turn, false as typical, run_id, chan, t_us, gap_us, shaft from ap union all select band, turn + taken, true, run_id, chan, t_us, gap_us, shaft from ty")
def w7_pick(t):
    """Candidates for review: half where detectors disagree most, half nearest the band's median count; new shafts first, no channel twice."""
    rows = candidates(t).where("most <= 8").withColumn("shaft", F.chr(65 + F.col("chan") % 7)).withColumn("band", F.when(F.col("gap_us") < 6 * HOUR, 0).otherwise(1))
    ties = ["gap_us", "run_id", "chan", "t_us"]
    return S.review_pick(rows, ["band"], ties, 10).select("band", "turn", "typical", "run_id", "chan", "t_us", "gap_us", "shaft")


@query(f", d as (select run_id, chan, t_us, {_SHAFT}, exists (select 1 from det o where o.chan = v.chan and o.detector = 'click' and abs(o.t_us - v.t_us) <= {6 * HOUR}) as near from det v where detector = 'view'), " + diverse_sql("u", "d", "near", "t_us, run_id, chan", "12") + " select near, turn, run_id, chan, t_us from u")
def w8_pick_in_time(t):
    """Events for review in time order, split by corroboration."""
    from eventloom.operators.matching import near_any

    view = t.detections.where("detector = 'view'").select("run_id", "chan", "t_us")
    clicks = t.detections.where("detector = 'click'").select("run_id", "chan", "t_us")
    rows = near_any(view, clicks, ["run_id", "chan"], 6 * HOUR).withColumn("shaft", F.chr(65 + F.col("chan") % 7))
    return S.diverse(rows, ["near"], [F.col("t_us"), F.col("run_id"), F.col("chan")], 12).select("near", "turn", "run_id", "chan", "t_us")
