"""Queries of truth scoring, sweeps and operating points, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.columns import wilson
from eventloom.operators import intervals as I
from eventloom.operators import postprocess as P
from eventloom.operators import scoring as S
from eventloom.plans.fixtures import BASE, DAY, DETECTORS, GUARD, THRESHOLDS, TOL, TOTAL, WINDOW, Tables, matched, scratch
from eventloom.sources.runs import write_summary

QUERIES, ORACLES = {}, {}
MINUTES = (TOTAL - 2 * GUARD) / DAY
TARGETS = (0.2, 0.3, 0.4)


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


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """Both Wilson bounds in SQL."""
    z, p, nn = 1.96, f"({k}::double / {n})", f"{n}::double"
    mid, half = f"({p} + {z * z} / (2 * {nn})) / (1 + {z * z} / {nn})", f"{z} * sqrt({p} * (1 - {p}) / {nn} + {z * z} / (4 * {nn} * {nn})) / (1 + {z * z} / {nn})"
    return f"case when {n} > 0 then round(greatest(0, {mid} - {half}), 6) end", f"case when {n} > 0 then round(least(1, {mid} + {half}), 6) end"


def guarded(t):
    """Truth and detections away from the recording's edges, matched by detector."""
    truth, found = P.edge_guard(t.truth, t.spans, GUARD), P.edge_guard(t.detections, t.spans, GUARD)
    return S.hits(truth, found, ["detector"], TOL), truth, found


_IN = f"t_us between {GUARD} and {TOTAL - GUARD}"
_G = ", " + matched("m", f"select d.detector || '/' || chan as g, event_id as id, t_us as t from truth, dets d where {_IN}", f"select detector || '/' || chan as g, event_id as id, t_us as t from det where {_IN}", TOL) + f""",
th as (select d.detector, tr.run_id, tr.chan, tr.t_us, tr.amp, m.ib is not null as hit, -m.d as off from truth tr cross join dets d left join m on m.ia = tr.event_id and m.g = d.detector || '/' || tr.chan where {_IN}),
dn as (select detector, run_id, chan, count(*) as n_det from det where {_IN} group by all)
"""


def _scores(by: str, dets: str = "dn") -> str:
    on = " and ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    return f"(select {', '.join('a.' + c.strip() for c in by.split(','))}, tp, n_det - tp as fp, n_true - tp as fn, n_true, n_det, tp / greatest(n_true, 1) as recall, tp / greatest(n_det, 1) as precision, 2 * (tp / greatest(n_true, 1)) * (tp / greatest(n_det, 1)) / greatest(tp / greatest(n_true, 1) + tp / greatest(n_det, 1), 1e-12) as f1, bias_ms, dt_ms from (select {by}, count(*) filter (where hit) as tp, count(*) as n_true, median(off) / 1000 as bias_ms, median(abs(off)) / 1000 as dt_ms from th group by all) a join (select {by}, sum(n_det)::bigint as n_det from {dets} group by all) b on {on})"


_SHOWN = "tp, fp, fn, n_true, n_det, round(recall, 6) as recall, round(precision, 6) as precision, round(f1, 6) as f1, bias_ms, dt_ms"


@query(_G + f"select detector, {_SHOWN}, round(fp / ((select count(*) from channels) * {MINUTES}), 6) as fp_per_minute, {wilson_sql('tp', 'n_true')[0]} as recall_low, {wilson_sql('tp', 'n_true')[1]} as recall_high from {_scores('detector')}")
def g1_event_scores(t):
    """Every detector against truth, with the interval of its recall."""
    found, _, _ = guarded(t)
    n = t.channels.agg(F.count("*").alias("_channels"))
    out = S.event_scores(found, ["detector"]).crossJoin(F.broadcast(n))
    low, high = wilson(F.col("tp"), F.col("n_true"))
    out = out.withColumn("fp_per_minute", F.col("fp") / (F.col("_channels") * MINUTES)).withColumn("recall_low", low).withColumn("recall_high", high).drop("_channels")
    return rnd(out, "recall", "precision", "f1", "fp_per_minute", "recall_low", "recall_high")


@query(_G + "select c.run_id, c.chan, d.detector, coalesce(a.n, 0) as n_true, coalesce(b.n_det, 0) as n_det, coalesce(a.tp, 0) as tp, round(a.tp / a.n, 6) as recall from channels c cross join dets d left join (select detector, run_id, chan, count(*) as n, count(*) filter (where hit) as tp from th group by all) a using (run_id, chan, detector) left join dn b using (run_id, chan, detector)")
def g1_channel_recall(t):
    """Recall by channel."""
    found, _, _ = guarded(t)
    return rnd(S.channel_recall(found, t.channels, ["detector"]), "recall")


_NB = (TOTAL - 2 * GUARD) // WINDOW
_WINDOWS = f""", tb as (select distinct run_id, chan, least((t_us - {GUARD}) // {WINDOW}, {_NB - 1}) as bin from truth where {_IN}), tbd as (select tb.*, detector from tb, dets),
db as (select distinct detector, run_id, chan, least((t_us - {GUARD}) // {WINDOW}, {_NB - 1}) as bin from det where {_IN}),
fj as (select coalesce(a.detector, b.detector) as detector, a.bin as tbin, b.bin as dbin, b.run_id, b.chan from tbd a full outer join db b using (detector, run_id, chan, bin)),
cl as (select *, tbin is null and exists (select 1 from tb x where x.run_id = fj.run_id and x.chan = fj.chan and abs(x.bin - fj.dbin) = 1) as adj from fj),
ws as (select detector, count(*) filter (where tbin is not null and dbin is not null) as tp, count(*) filter (where tbin is null) as fp, count(*) filter (where dbin is null) as fn, count(*) filter (where adj) as fp_adjacent from cl group by 1),
wt as (select *, (select count(*) from channels) * {_NB} - tp - fp - fn as tn from ws)
"""


@query(_WINDOWS + "select *, round(tp / (tp + fn), 6) as sensitivity, round(tn / (tn + fp), 6) as specificity, round(fp / (tn + fp), 6) as fpr from wt")
def g2_window_scores(t):
    """Binary accounting of half-day bins; empty bins are never made."""
    _, truth, found = guarded(t)
    n = F.lit(t.channels.count())
    return rnd(S.window_scores(truth, found, ["detector"], WINDOW, GUARD, TOTAL - 2 * GUARD, n), "sensitivity", "specificity", "fpr")


@query(_G + f", sp as (select detector, min(amp) as lo, max(amp) as hi from th group by 1), pb as (select th.detector, least(floor((amp - lo) / (hi - lo) * 12), 11)::int as bin, count(*) as n, count(*) filter (where hit) as k from th join sp using (detector) group by all), gr as (select detector, b::int as bin from dets, range(12) r(b)), j as (select gr.detector, gr.bin, coalesce(n, 0) as n, coalesce(k, 0) as k from gr left join pb using (detector, bin)) select *, round(k / nullif(n, 0), 6) as p, {wilson_sql('k', 'n')[0]} as low, {wilson_sql('k', 'n')[1]} as high from j")
def g3_g4_detection_by_amplitude(t):
    """P(detect) by amplitude with Wilson intervals."""
    found, _, _ = guarded(t)
    return rnd(S.detection_by_amplitude(found, ["detector"]), "p", "low", "high")


def points(t):
    """Every detector and threshold."""
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, DETECTORS))).alias("detector")).select("detector", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("value"))


def matrix(t):
    """(subject, detector, value) counts of every detector at every threshold; no guard."""
    return S.sweep_matrix(t.truth, t.detections.withColumn("score", F.col("value")), t.channels, list(DETECTORS), list(THRESHOLDS), TOL, TOTAL / DAY)


_V = "(select unnest([" + ", ".join(map(str, THRESHOLDS)) + "]) as v)"
_SW = f", pt as (select detector, v as value from dets, {_V}), " + matched("m", f"select pt.detector || '/' || pt.value || '/' || chan as g, event_id as id, t_us as t from truth, pt", f"select pt.detector || '/' || pt.value || '/' || chan as g, event_id as id, t_us as t from det join pt on pt.detector = det.detector and det.value >= pt.value", TOL) + f""",
nt as (select run_id, count(*) as n from truth group by 1), nd as (select run_id, pt.detector, pt.value, count(*) as n from det join pt on pt.detector = det.detector and det.value >= pt.value group by all),
np as (select split_part(g, '/', 1) as detector, split_part(g, '/', 2)::int as value, split_part(g, '/', 3)::bigint % 5 as run_id, count(*) as n from m group by all),
nc as (select run_id, count(*) * {TOTAL / DAY} as chan_min from channels group by 1),
mx as (select c.run_id as subject, pt.detector, pt.value, c.chan_min, coalesce(np.n, 0) as tp, coalesce(nt.n, 0) as n_true, coalesce(nd.n, 0) as n_det from nc c cross join pt left join nt on nt.run_id = c.run_id left join nd on nd.run_id = c.run_id and nd.detector = pt.detector and nd.value = pt.value left join np on np.run_id = c.run_id and np.detector = pt.detector and np.value = pt.value),
br as (select detector, value, sum(tp)::bigint as tp, sum(n_true)::bigint as n_true, sum(n_det)::bigint as n_det, sum(n_det) / sum(chan_min) as budget, sum(tp) / greatest(sum(n_true), 1) as recall, sum(tp) / greatest(sum(n_det), 1) as precision from mx group by all)
"""
CURVE = ["detector", "value"]


def curve(t):
    """Pooled budget, recall and precision of every point."""
    return S.budget_recall(matrix(t), CURVE)


@query(_SW + "select detector, value, tp, n_true, n_det, round(budget, 6) as budget, round(recall, 6) as recall, round(precision, 6) as precision from br")
def g13_g15_points(t):
    """Sweep points: budget, recall, precision."""
    return rnd(curve(t), "budget", "recall", "precision")


@query(_SW + "select * from mx")
def g14_matrix(t):
    """Subject by sweep point."""
    return matrix(t)


@query(_SW + ", a as (select detector, budget, recall, (budget - lag(budget) over w) * (recall + lag(recall) over w) / 2 as s from br window w as (partition by detector order by budget, recall)) select detector, round(sum(s) / (max(budget) - min(budget)), 6) as pauc from a group by 1")
def g5_partial_auc(t):
    """Area of recall over budget."""
    return rnd(S.partial_auc(curve(t), ["detector"], "budget", "recall"), "pauc")


@query(_SW + ", a as (select detector, (recall - lag(recall, 1, 0.0) over (partition by detector order by recall, precision)) * precision as s from br) select detector, round(sum(s), 6) as ap from a group by 1")
def g6_average_precision(t):
    """Average precision of every detector."""
    return rnd(S.average_precision(curve(t), ["detector"]), "ap")


@query(_G + f"select run_id, detector, {_SHOWN} from {_scores('run_id, detector')}")
def g7_score_table(t):
    """Scores by recording and detector."""
    found, _, _ = guarded(t)
    return rnd(S.event_scores(found, ["run_id", "detector"]), "recall", "precision", "f1")


@query(_G + f", mute as (select run_id, 'mute' as detector, 0::bigint as n_det, 0.0::double as recall, null::double as bias_ms from spans), sc as (select *, row_number() over (partition by detector order by run_id desc) as place, sum(n_det) over (partition by detector) as every from (select run_id, detector, n_det, recall, bias_ms from {_scores('run_id, detector')} union all select * from mute)) select detector, unnest(list_filter([case when abs(bias_ms) > 0.02 * {TOL / 1000} then 'bias' end, case when recall < 0.3 then 'recall' end, case when every = 0 then 'silent' end], lambda x: x is not null)) as gate from sc where place = 1")
def g8_gates(t):
    """Failed checks at the highest level; the run number stands for the level, and one detector never fires."""
    found, _, _ = guarded(t)
    mute = t.spans.select("run_id", F.lit("mute").alias("detector"), F.lit(0).cast("long").alias("n_det"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("bias_ms"))
    scores = S.event_scores(found, ["run_id", "detector"]).select(*mute.columns).unionByName(mute)
    return S.gates(scores.withColumn("snr", F.col("run_id")), TOL / 1000 / 10, least_recall=0.3)


def partial_sql(name: str, rows: str, x: str, y: str, z: str, n: str, rho: str) -> str:
    """CTEs up to `name` (detector, n, rho): the rank correlation of x and y with z held fixed, over a relation."""
    ranks = ", ".join(f"rank() over (partition by detector order by {c}) + (count(*) over (partition by detector, {c}) - 1) / 2.0 as r{i}" for i, c in enumerate((x, y, z)))
    return f"{name}_r as (select detector, {ranks} from {rows}), {name}_c as (select detector, count(*) as n, corr(r0, r1) as xy, corr(r0, r2) as xz, corr(r1, r2) as yz from {name}_r group by 1), {name} as (select detector, n as {n}, round((xy - xz * yz) / sqrt(greatest((1 - xz * xz) * (1 - yz * yz), 1e-12)), 6) as {rho} from {name}_c)"


_COV = _G + f", cv as (select chan, run_id, stddev_samp(value) as noise from ev group by all), cr as (select detector, run_id, chan, count(*) as n_true, count(*) filter (where hit) as tp from th group by all), pz as (select p.detector, noise, coalesce(n_true, 0) as n_true, tp / n_true as recall, (coalesce(n_det, 0) - coalesce(tp, 0)) / {MINUTES} as fp from pairs p join cv using (run_id, chan) left join cr using (run_id, chan, detector) left join dn using (run_id, chan, detector) where noise is not null)"


@query(_COV + ", " + partial_sql("pa", "(select * from pz where n_true > 0)", "noise", "recall", "n_true", "n", "rho") + ", " + partial_sql("pb", "pz", "noise", "fp", "n_true", "n_fp", "rho_fp") + " select pb.detector, n_fp, rho_fp, n, rho from pb left join pa using (detector) where (select max(noise) / greatest(min(noise), 1e-9) from pz) >= 1.2")
def g9_partial_spearman(t):
    """Noise against recall, and against false positives a minute, with the rate held fixed."""
    found, _, _ = guarded(t)
    noise = t.events.groupBy("run_id", "chan").agg(F.stddev_samp("value").alias("noise"))
    rows = S.channel_recall(found, t.channels, ["detector"]).join(noise, ["run_id", "chan"])
    return rnd(S.noise_report(rows, ["detector"], MINUTES), "rho", "rho_fp")


@query(_SW + "select detector, 'value' as param, round(max(recall) - min(recall), 6) as recall_span, round(max(precision) - min(precision), 6) as precision_span, count(*) as n from br group by 1")
def g10_sweep_spans(t):
    """How far a parameter moves recall and precision."""
    span = lambda c: F.round(F.max(c) - F.min(c), 6)
    return curve(t).withColumn("param", F.lit("value")).groupBy("detector", "param").agg(span("recall").alias("recall_span"), span("precision").alias("precision_span"), F.count("*").alias("n"))


@query(_G + f", a as (select run_id, chan, count(*) / {MINUTES} as true_rate from truth where {_IN} group by all) select p.run_id, p.chan, p.detector, round(coalesce(true_rate, 0), 6) as true_rate, round(coalesce(n_det, 0) / {MINUTES}, 6) as det_rate from pairs p left join a using (run_id, chan) left join dn using (run_id, chan, detector)")
def g11_rate_recovery(t):
    """True and detected rate by channel."""
    found, _, _ = guarded(t)
    out = S.channel_recall(found, t.channels, ["detector"])
    return rnd(out.select("run_id", "chan", "detector", (F.col("n_true") / MINUTES).alias("true_rate"), (F.col("n_det") / MINUTES).alias("det_rate")), "true_rate", "det_rate")


def _unguarded(sql: str) -> str:
    return sql.replace(f" where {_IN}", "")


@query(_unguarded(_G) + f", sc as (select * from {_scores('run_id, detector')}) select detector, sum(tp)::bigint as tp, sum(n_true)::bigint as n_true, sum(n_det)::bigint as n_det, round(sum(tp) / sum(n_true), 6) as recall, round(sum(tp) / sum(n_det), 6) as precision, median(dt_ms) as dt_ms, median(bias_ms) as bias_ms, {wilson_sql('sum(tp)', 'sum(n_true)')[0]} as recall_low, {wilson_sql('sum(tp)', 'sum(n_true)')[1]} as recall_high, {wilson_sql('sum(tp)', 'sum(n_det)')[0]} as precision_low, {wilson_sql('sum(tp)', 'sum(n_det)')[1]} as precision_high from sc group by 1")
def g12_pooled_report(t):
    """The labelled report, without a guard."""
    found = S.hits(t.truth, t.detections.select("detector", "run_id", "chan", "t_us"), ["detector"], TOL)
    return rnd(S.pooled_report(S.event_scores(found, ["run_id", "detector"])), "recall", "precision", "recall_low", "recall_high", "precision_low", "precision_high")


@query(_unguarded(_G) + f", sc as (select * from {_scores('run_id, detector')}) select run_id as subject, detector, tp, n_true, n_det from sc union all select null, detector, sum(tp)::bigint, sum(n_true)::bigint, sum(n_det)::bigint from sc group by 2")
def a14_subject_and_pooled(t):
    """Per subject and pooled in one pass."""
    return S.subject_and_pooled(S.hits(t.truth, t.detections.select("detector", "run_id", "chan", "t_us"), ["detector"], TOL))


def lookup_sql(curve: str, wanted: str, by: str, x: str, y: str, at: str, clamp: bool) -> str:
    """wanted with y at x = at, as interpolated() does."""
    keys = [c.strip() for c in by.split(",")]
    on = " and ".join(f"w.{c} = s.{c}" for c in keys)
    ends = f" or (x1 is null and {at} > x0) or (k = 1 and {at} < x0)" if clamp else ""
    return f"(select w.*, (select case when x1 is null or {at} < x0 or x1 = x0 then y0 else y0 + ({at} - x0) / (x1 - x0) * (y1 - y0) end from (select {by}, {x} as x0, {y} as y0, lead({x}) over o as x1, lead({y}) over o as y1, row_number() over o as k from {curve} window o as (partition by {by} order by {x}, {y})) s where {on} and (({at} >= x0 and {at} <= x1){ends}) order by k limit 1) as {y} from {wanted} w)"


_TG = f", tg as (select detector, unnest([{', '.join(map(str, TARGETS))}]::double[]) as target from dets), bd as (select detector, value::double as value, budget, recall, precision from br)"


def targets(t):
    """Every detector and target budget."""
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, DETECTORS))).alias("detector")).withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))


@query(_SW + _TG + f" select detector, target, round(value, 6) as value from {lookup_sql('bd', 'tg', 'detector', 'budget', 'value', 'target', False)}")
def g16_value_for_budget(t):
    """The parameter that meets a budget; null outside the swept range."""
    c = curve(t).select("detector", "budget", F.col("value").cast("double").alias("value"))
    return rnd(S.interpolated(c, targets(t), ["detector"], "budget", "value", "target"), "value")


@query(_SW + _TG + f", wa as (select detector, unnest([-5.0, 7.0, 60.0, 500.0]::double[]) as wanted from dets) select detector, wanted, round(recall, 6) as recall from {lookup_sql('bd', 'wa', 'detector', 'value', 'recall', 'wanted', True)}")
def g17_recall_at_value(t):
    """Recall at any parameter value, held at the ends."""
    c = curve(t).select("detector", F.col("value").cast("double").alias("value"), "recall")
    at = targets(t).select("detector").distinct().withColumn("wanted", F.explode(F.array(*(F.lit(x) for x in (-5.0, 7.0, 60.0, 500.0)))))
    return rnd(S.interpolated(c, at, ["detector"], "value", "recall", "wanted", clamp=True), "recall")


def _part(rows, train):
    return S.budget_recall(rows.where(F.col("subject") < 2 if train else F.col("subject") >= 2), CURVE).select("detector", F.col("value").cast("double").alias("value"), "budget", "recall")


_TT = ", " + ", ".join(f"{n} as (select detector, value::double as value, sum(n_det) / sum(chan_min) as budget, sum(tp) / greatest(sum(n_true), 1) as recall from mx where subject {op} 2 group by all)" for n, op in (("trn", "<"), ("tst", ">=")))


@query(_SW + _TG + _TT + f", f as (select * from {lookup_sql('trn', 'tg', 'detector', 'budget', 'value', 'target', False)}), a as (select detector, target, value as pick from f where value is not null) select detector, target, round(pick, 6) as pick, round(budget, 6) as budget, round(recall, 6) as recall from {lookup_sql('tst', '(select * from ' + lookup_sql('tst', 'a', 'detector', 'value', 'budget', 'pick', True) + ')', 'detector', 'value', 'recall', 'pick', True)}")
def g18_train_test(t):
    """A value fitted on some subjects, measured on the others."""
    rows = matrix(t)
    train, test = _part(rows, True), _part(rows, False)
    pick = S.interpolated(train, targets(t), ["detector"], "budget", "value", "target").where("value is not null").withColumnRenamed("value", "pick")
    out = S.interpolated(test.drop("recall"), pick, ["detector"], "value", "budget", "pick", clamp=True)
    return rnd(S.interpolated(test.drop("budget"), out, ["detector"], "value", "recall", "pick", clamp=True), "pick", "budget", "recall")


_LO = f", lo as (select a.subject as fold, a.detector, a.value::double as value, (sum(b.n_det)) / sum(b.chan_min) as budget, sum(b.tp) / greatest(sum(b.n_true), 1) as recall from mx a join mx b on a.detector = b.detector and a.value = b.value and a.subject <> b.subject group by all), wf as (select distinct fold, detector, 0.3::double as target from lo), pf as (select * from {lookup_sql('lo', 'wf', 'fold, detector', 'budget', 'value', 'target', False)})"


@query(_SW + _LO + " select detector, round(median(value), 6) as median, round(min(value), 6) as low, round(max(value), 6) as high, round(100 * (max(value) - min(value)) / nullif(median(value), 0), 6) as spread, count(value) as folds from pf group by 1")
def g19_stability(t):
    """The pick with each subject left out in turn."""
    rows = S.left_out(matrix(t), CURVE).withColumn("value", F.col("value").cast("double"))
    wanted = rows.select("fold", "detector").distinct().withColumn("target", F.lit(0.3))
    picks = S.interpolated(rows.select("fold", "detector", "budget", "value"), wanted, ["fold", "detector"], "budget", "value", "target")
    return rnd(S.stability(picks, ["detector"]), "median", "low", "high", "spread")


_OWN = ", ow as (select subject, detector, value::double as value, tp / greatest(n_true, 1) as recall from mx)"


@query(_SW + _TG + _OWN + f", f as (select detector, value as pick from {lookup_sql('bd', '(select * from tg where target = 0.3)', 'detector', 'budget', 'value', 'target', False)} where value is not null), w as (select distinct ow.subject, f.detector, f.pick from ow join f using (detector)) select subject, detector, round(pick, 6) as pick, round(recall, 6) as recall from {lookup_sql('ow', 'w', 'subject, detector', 'value', 'recall', 'pick', True)}")
def g20_matched_rate(t):
    """Each subject's recall at the value that gives one common budget."""
    rows = matrix(t)
    c = S.budget_recall(rows, CURVE).select("detector", "budget", F.col("value").cast("double").alias("value"))
    pick = S.interpolated(c, targets(t).where("target = 0.3"), ["detector"], "budget", "value", "target").where("value is not null").select("detector", F.col("value").alias("pick"))
    own = rows.select("subject", "detector", F.col("value").cast("double").alias("value"), (F.col("tp") / F.greatest("n_true", F.lit(1))).alias("recall"))
    wanted = own.select("subject", "detector").distinct().join(pick, "detector").select("subject", "detector", "pick")
    return rnd(S.interpolated(own, wanted, ["subject", "detector"], "value", "recall", "pick", clamp=True), "pick", "recall")


@query(_SW + _OWN + " select detector, value, round(quantile_cont(recall, 0.25), 6) as q25, round(quantile_cont(recall, 0.75), 6) as q75 from ow group by all")
def g21_quartiles(t):
    """The spread of subjects' recall along the sweep."""
    own = matrix(t).select("detector", F.col("value").cast("double").alias("value"), (F.col("tp") / F.greatest("n_true", F.lit(1))).alias("recall"))
    return rnd(S.quartile_band(own, CURVE, "recall"), "q25", "q75")


@query(f", bad as (select run_id, 'event outside' as rule, t_us::varchar as detail from det where t_us >= {25 * DAY} union all select run_id, 'unknown channel', chan::varchar from det where chan % 10 = 3 union all select run_id, 'no flag', t_us::varchar from det where chan % 10 = 5), masked as (select distinct run_id, chan from mask), sg as (select run_id, t0_us, t1_us from ons union all select run_id, {2 * DAY}::bigint, {4 * DAY}::bigint from spans) select * from bad union all select run_id, 'ON and OFF', '{12 * DAY}' from spans union all select run_id, 'segment outside', t0_us::varchar from sg where t1_us > {25 * DAY} union all select run_id, 'segments overlap', '{2 * DAY}' from spans union all select run_id, 'clean time is not that of the slices', chan::varchar from masked where chan % 10 in (4, 7) union all select run_id, 'clean time of a condition', '{26 * DAY}' from masked where chan % 10 = 7")
def g23_violations(t):
    """Invariants over a run that breaks several."""
    runs = t.spans.select("run_id", F.lit(25 * DAY).cast("long").alias("total_us"), F.lit(12 * DAY).cast("long").alias("on_us"), F.lit(18 * DAY).cast("long").alias("off_us"))
    extra = t.spans.select("run_id", F.lit(2 * DAY).cast("long").alias("t0_us"), F.lit(4 * DAY).cast("long").alias("t1_us"))
    known = t.channels.where("chan % 10 <> 3")
    slices = I.overlap_per_slice(t.mask(), ["run_id", "chan"], DAY).select("run_id", "chan", (DAY - F.col("covered_us")).alias("clean_us"))
    more = F.when(F.col("chan") % 10 == 4, 5_000_000).otherwise(0)
    sums = slices.groupBy("run_id", "chan").agg(F.sum("clean_us").alias("_sum"))
    clean = sums.select("run_id", "chan", F.when(F.col("chan") % 10 == 7, 26 * DAY).otherwise(0).alias("on_us"), F.least(F.col("_sum") + more, F.lit(25 * DAY)).alias("off_us"))
    flagged = t.detections.withColumn("is_on", F.when(F.col("chan") % 10 != 5, F.lit(True)))
    return S.violations(runs, flagged, t.on.unionByName(extra), slices, known, DAY, clean)


_CFG = "select run_id, case when run_id = 3 then 'b' else 'a' end as cfg_hash from spans"


@query(f", r as ({_CFG}) select run_id, cfg_hash, cfg_hash = 'a' as kept from r")
def s5_configurations(t):
    """Runs of the most common configuration, and the rest."""
    runs = t.spans.select("run_id", F.when(F.col("run_id") == 3, "b").otherwise("a").alias("cfg_hash"))
    kept, rest = S.largest_configuration(runs)
    return kept.withColumn("kept", F.lit(True)).unionByName(rest.withColumn("kept", F.lit(False))).select("run_id", "cfg_hash", "kept")


@query(_SW + "select detector, 'value' as param, value::double as value, round(budget, 3) as det_per_chan_min, round(recall, 4) as recall, round(precision, 4) as precision_lower_bound, tp, n_true, n_det from br")
def s6_s8_summary(t):
    """The summary table of a sweep, written to the shared folder and read back."""
    c = curve(t)
    rows = c.select("detector", F.lit("value").alias("param"), F.col("value").cast("double").alias("value"), F.round("budget", 3).alias("det_per_chan_min"), F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision_lower_bound"), "tp", "n_true", "n_det")
    path = scratch(t, "summary")
    write_summary(rows, path)
    return t.spark.read.option("header", True).schema(rows.schema).csv(path).select(*rows.columns)


@query(_SW + "select s.run_id as subject, pt.detector, pt.value from spans s, pt where not exists (select 1 from det d where d.run_id = s.run_id and d.detector = pt.detector and d.value >= pt.value and d.value < pt.value + 0.2)")
def s7_pending(t):
    """Points of the grid that nothing was stored for."""
    grid = t.spans.select(F.col("run_id").alias("subject")).crossJoin(points(t))
    done = t.detections.select(F.col("run_id").alias("subject"), "detector", F.col("value").alias("score")).withColumn("value", F.explode(F.array(*map(F.lit, THRESHOLDS)))).where((F.col("score") >= F.col("value")) & (F.col("score") < F.col("value") + 0.2))
    return S.pending(grid, done, ["subject", "detector", "value"])
