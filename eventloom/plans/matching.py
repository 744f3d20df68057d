"""Queries of the matching family, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import matching as M
from eventloom.plans.fixtures import BASE, DETECTORS, SYNC, THRESHOLDS, TOL, Tables, matched

QUERIES, ORACLES = {}, {}
KEYS = ["run_id", "chan"]


def query(sql: str | None = None):
    """Register a function (tables -> DataFrame) as a query, with the SQL that follows the common tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return register


def one(name: str) -> str:
    return f"select chan::varchar as g, event_id as id, t_us as t from det where detector = '{name}'"


def side(t, name: str):
    return t.detections.where(F.col("detector") == name).select("run_id", "chan", "t_us", "event_id")


@query(", " + matched("m", one("purchase"), one("click"), TOL) + " select d.event_id, m.ib is not null as hit, -m.d as off_us from det d left join m on m.ia = d.event_id where d.detector = 'purchase'")
def m1_match(t):
    """One-to-one partners of purchases among clicks, with offsets."""
    found = M.match(side(t, "purchase"), side(t, "click"), KEYS, TOL, carry=("event_id",)).where("side = 0")
    return found.select("event_id", F.col("partner").isNotNull().alias("hit"), (F.col("partner") - F.col("t_us")).alias("off_us"))


PAIRS = [(a, b) for i, a in enumerate(DETECTORS) for b in DETECTORS[i + 1 :]]
_ALL = ", " + ", ".join(matched(f"m_{a}_{b}", one(a), one(b), TOL) for a, b in PAIRS)
_PAIRS = _ALL + ", mm as (" + " union all ".join(f"select '{a}' as det_a, '{b}' as det_b, g::bigint % 5 as run_id, g, d from m_{a}_{b}" for a, b in PAIRS) + "), nn as (select detector, run_id, count(*) as n from det group by all), pp as (select a.detector as det_a, b.detector as det_b, a.run_id, a.n as n_a, b.n as n_b from nn a join nn b on a.detector < b.detector and a.run_id = b.run_id)"


@query(_PAIRS + ", c as (select det_a, det_b, count(*) as matched, median(abs(d)) / 1000 as dt from mm group by all), p as (select det_a, det_b, sum(n_a)::bigint as n_a, sum(n_b)::bigint as n_b from pp group by all) select det_a, det_b, n_a, n_b, matched, round(matched / (n_a + n_b - matched), 6) as jaccard, dt as median_dt_ms, n_a - matched as a_only, n_b - matched as b_only from p join c using (det_a, det_b)")
def m2_agreement(t):
    """Agreement of every pair of detectors."""
    return M.agreement(t.detections, list(DETECTORS), TOL).withColumn("jaccard", F.round("jaccard", 6))


@query(_PAIRS + " select det_a, det_b, run_id, median(abs(d)) / 1000 as median_dt_ms from mm group by all")
def m3_median_dt(t):
    """Median |dt| per recording and pair."""
    return M.agreement(t.detections, list(DETECTORS), TOL, ["run_id"]).select("det_a", "det_b", "run_id", "median_dt_ms")


@query(f" select d.event_id, exists (select 1 from det o where o.chan = d.chan and o.detector <> 'view' and abs(o.t_us - d.t_us) <= {TOL}) as near from det d where d.detector = 'view'")
def m4_near_any(t):
    """Views with any other detector's event near."""
    others = t.detections.where("detector <> 'view'").select("run_id", "chan", "t_us")
    return M.near_any(side(t, "view"), others, KEYS, TOL).select("event_id", "near")


_THR = "select chan::varchar as g, event_id as id, t_us as t from det where detector = 'view' and value >= {0}"


@query(", " + matched("m", _THR.format(10), _THR.format(50), SYNC) + f""", a as (select d.*, 'removed' as change from det d where detector = 'view' and value >= 10 and event_id not in (select ia from m)),
b as (select d.*, 'added' as change from det d where detector = 'view' and value >= 50 and event_id not in (select ib from m)), u as (select * from a union all select * from b)
select run_id, change, count(*) as n, round(avg(case when exists (select 1 from det o where o.chan = u.chan and o.detector = 'click' and abs(o.t_us - u.t_us) <= {TOL}) then 1.0 else 0.0 end), 6) as corroborated from u group by all""")
def m5_run_delta(t):
    """What a higher threshold removes, and whether another detector saw it."""
    view = t.detections.where("detector = 'view'")
    clicks = side(t, "click").select("run_id", "chan", "t_us")
    return M.run_delta(view.where("value >= 10"), view.where("value >= 50"), clicks, clicks, KEYS, SYNC, TOL).withColumn("corroborated", F.round("corroborated", 6))


@query(", " + ", ".join(matched(n, one("click"), one(o), TOL) for n, o in (("mv", "view"), ("mp", "purchase"))) + ", c as (select d.event_id, mv.ib is null as lost, mp.ib is not null as corroborated from det d left join mv on mv.ia = d.event_id left join mp on mp.ia = d.event_id where d.detector = 'click') select lost, count(*) as n, round(avg(corroborated::int), 6) as corroborated from c group by 1")
def m6_classify(t):
    """Clicks lost against views, with purchases as witnesses."""
    found = M.classified(side(t, "click"), side(t, "view"), [side(t, "purchase")], KEYS, TOL)
    return found.groupBy("lost").agg(F.count("*").alias("n"), F.round(F.avg(F.col("corroborated").cast("double")), 6).alias("corroborated"))


def marks(t):
    """Expert marks: each sign-up on its own channel, the next one of the run, and one that no recording has."""
    names = F.array(F.concat(F.lit("A_"), "chan"), F.concat(F.lit("A_"), F.col("chan") + 5), F.when(F.col("chan") % 9 == 0, "ZZ9"))
    return t.truth.select(F.col("run_id").alias("subject"), "t_us", F.lit("mark").alias("annotation"), F.array_compact(names).alias("chans"))


_MARKS = ", marks as (select run_id as subject, t_us, list_filter(['A_' || chan, 'A_' || (chan + 5), case when chan % 9 = 0 then 'ZZ9' end], lambda x: x is not null) as chans from truth), flat as (select subject, t_us, unnest(chans) as name from marks)"


@query(_MARKS + " select f.subject, f.t_us, count(c.name) as n, count(*) - count(c.name) as unknown from flat f left join channels c on c.run_id = f.subject and c.name = f.name group by all")
def m7_contacts(t):
    """Marks with their known contacts."""
    channels = t.channels.select(F.col("run_id").alias("subject"), "name")
    kept, _ = M.resolve_contacts(marks(t), channels)
    wanted = marks(t).groupBy("subject", "t_us").agg(F.sum(F.size("chans")).alias("all"))
    return kept.join(wanted, ["subject", "t_us"]).select("subject", "t_us", F.size("chans").cast("long").alias("n"), (F.col("all") - F.size("chans")).alias("unknown"))


@query(_MARKS + " select c.run_id as subject, c.name, count(f.t_us) as n from channels c left join flat f on f.subject = c.run_id and f.name = c.name group by all")
def m8_truth_per_channel(t):
    """Marks by channel, empty channels kept."""
    channels = t.channels.select(F.col("run_id").alias("subject"), "name")
    kept, _ = M.resolve_contacts(marks(t), channels)
    return M.truth_per_channel(kept, channels).groupBy("subject", "name").agg(F.count("t_us").alias("n"))


@query(" select run_id, chan, name as ours, case when chan % 11 <> 0 then case when chan % 13 = 0 then 'B' else name end end as theirs from channels where chan % 11 = 0 or chan % 13 = 0")
def m9_order_check(t):
    """Positions where two channel lists differ."""
    theirs = t.channels.where("chan % 11 <> 0").withColumn("name", F.when(F.col("chan") % 13 == 0, "B").otherwise(F.col("name")))
    return M.order_violations(t.channels, theirs)


@query(" select scope, detector, count(*) as n from (select 'all' as scope, * from det union all select 'ez', d.* from det d join channels c using (run_id, chan) where c.is_ez) group by all")
def m10_scopes(t):
    """Detections over all channels and over the onset zone."""
    return M.in_scopes(t.detections, t.channels.where("is_ez"), KEYS).groupBy("scope", "detector").agg(F.count("*").alias("n"))


_FIXED = "select v.v || '/' || chan as g, event_id as id, t_us as t from det, (select unnest([" + ", ".join(map(str, THRESHOLDS)) + "]) as v) v where detector = 'click'"
_MOVED = "select v.v || '/' || chan as g, event_id as id, t_us as t from det, (select unnest([" + ", ".join(map(str, THRESHOLDS)) + "]) as v) v where detector = 'view' and value >= v.v"


def sweep(t, detector: str = "view"):
    """Detections of a detector at every threshold, as rows (value, run_id, chan, t_us, event_id)."""
    values = F.explode(F.array(*map(F.lit, THRESHOLDS)))
    return t.detections.where(F.col("detector") == detector).select("run_id", "chan", "t_us", "event_id", F.col("value").alias("score")).withColumn("value", values).where("score >= value").drop("score")


@query(", " + matched("m", _MOVED, _FIXED, TOL) + f", c as (select split_part(g, '/', 1)::int as value, count(*) as m from m group by 1), n as (select v.v as value, count(*) as n from det, (select unnest([{', '.join(map(str, THRESHOLDS))}]) as v) v where detector = 'view' and det.value >= v.v group by 1), f as (select count(*) as nf from det where detector = 'click') select n.value, n.n, coalesce(c.m, 0) as matched, round(coalesce(c.m, 0) / (n + nf - coalesce(c.m, 0)), 6) as jaccard, min(n) over () = max(n) over () as constant from n left join c using (value), f")
def g22_sweep_fixed(t):
    """One detector's threshold moved against a fixed detector."""
    return M.sweep_against(t.detections.where("detector = 'view'").withColumn("score", F.col("value")), side(t, "click"), list(THRESHOLDS), KEYS, TOL).withColumn("jaccard", F.round("jaccard", 6))
