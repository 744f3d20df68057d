"""Scoring detections against truth, curves over sweeps, and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.columns import wilson
from eventloom.operators.matching import match, sweep_counts
from eventloom.operators.rates import average_rank, correlation
from eventloom.operators.selection import counted, joined, medians_of


def hits(truth: DataFrame, detections: DataFrame, by: list[str], tol: int) -> DataFrame:
    """Every truth event and detection with its partner: (by, run_id, chan, t_us, amp, side, partner); side 0 is truth.

    Truth is copied to the groups of `by` (detector, sweep point) that its run has, so that all points are matched in
    one job.
    """
    groups = detections.select(*by).distinct() if by else None
    marks = truth.select("run_id", "chan", "t_us", "amp")
    marks = marks.crossJoin(F.broadcast(groups)) if by else marks
    found = detections.select(*by, "run_id", "chan", "t_us", F.lit(None).cast("double").alias("amp"))
    return match(marks, found, [*by, "run_id", "chan"], tol, carry=("amp",))


def event_scores(found: DataFrame, by: list[str], minutes: Column | None = None) -> DataFrame:
    """Per group: tp, fp, fn, recall, precision, F1, bias and median distance in ms (detection less truth), and false positives a channel-minute if `minutes` gives their number."""
    counts = counted(found, [*by, "side"], F.when(F.col("side") == 0, F.col("partner") - F.col("t_us")))
    truth, hit = F.col("side") == 0, F.col("value").isNotNull()
    tp, n_true, n_det = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in (truth & hit, truth, ~truth))
    middle = medians_of(counts.where(F.when(hit, F.col("n")) > 0), by, {"_bias": F.col("value"), "_dt": F.abs("value")}, F.col("n"))
    out = joined(counts.groupBy(*by).agg(tp.alias("tp"), n_true.alias("n_true"), n_det.alias("n_det")), middle, by, "left")
    fp, fn = F.col("n_det") - F.col("tp"), F.col("n_true") - F.col("tp")
    recall, precision = F.col("tp") / F.greatest("n_true", F.lit(1)), F.col("tp") / F.greatest("n_det", F.lit(1))
    out = out.select(*by, "tp", fp.alias("fp"), fn.alias("fn"), "n_true", "n_det", recall.alias("recall"), precision.alias("precision"), (2 * recall * precision / F.greatest(recall + precision, F.lit(1e-12))).alias("f1"), (F.col("_bias") / 1000).alias("bias_ms"), (F.col("_dt") / 1000).alias("dt_ms"))
    return out if minutes is None else out.withColumn("fp_per_minute", F.col("fp") / minutes)


def channel_recall(found: DataFrame, channels: DataFrame, by: list[str]) -> DataFrame:
    """Per group and channel: recall, null without truth, and numbers of truth and detections; quiet channels kept."""
    groups = found.select(*by).distinct()
    truth, hit = F.col("side") == 0, F.col("partner").isNotNull()
    per = found.groupBy(*by, "run_id", "chan").agg(F.sum(truth.cast("long")).alias("n_true"), F.sum((~truth).cast("long")).alias("n_det"), F.sum((truth & hit).cast("long")).alias("tp"))
    grid = channels.select("run_id", "chan").crossJoin(F.broadcast(groups))
    out = grid.join(per, [*by, "run_id", "chan"], "left").fillna(0, ["n_true", "n_det", "tp"])
    return out.withColumn("recall", F.col("tp") / F.when(F.col("n_true") > 0, F.col("n_true")))


def window_scores(truth: DataFrame, detections: DataFrame, by: list[str], bin_us: int, start_us: int, length_us: int, n_channels: Column) -> DataFrame:
    """Per group: TP, FP, FN, TN over binary bins per channel, FP in a bin beside a truth bin, sensitivity, specificity and false-positive rate.

    Only bins that hold something exist: both sides' distinct bins meet in one grouping, and TN is the rest of
    channels times bins. The last bin's edge is closed.
    """
    bins = length_us // bin_us
    at = F.least(F.floor((F.col("t_us") - start_us) / bin_us), F.lit(bins - 1))
    inside = F.col("t_us").between(start_us, start_us + length_us)
    keys = [*by, "run_id", "chan"]
    groups = detections.select(*by).distinct()
    t = truth.where(inside).select("run_id", "chan", at.alias("bin")).distinct().crossJoin(F.broadcast(groups))
    d = detections.where(inside).select(*keys, at.alias("bin")).distinct()
    near = t.select(*keys, F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.lit(0).alias("d"), F.col("bin").alias("_b")).select(*keys, "bin", (F.col("bin") == F.col("_b")).cast("int").alias("t"), "d", F.lit(1).alias("n"))
    every = near.unionByName(d.select(*keys, "bin", F.lit(0).alias("t"), F.lit(1).alias("d"), F.lit(0).alias("n")))
    cell = every.groupBy(*keys, "bin").agg(F.max("t").alias("t"), F.max("d").alias("d"), F.max("n").alias("n"))
    count = lambda c: F.sum(c.cast("long"))
    out = cell.groupBy(*by).agg(count((F.col("t") == 1) & (F.col("d") == 1)).alias("tp"), count((F.col("t") == 0) & (F.col("d") == 1)).alias("fp"), count((F.col("t") == 1) & (F.col("d") == 0)).alias("fn"), count((F.col("t") == 0) & (F.col("d") == 1) & (F.col("n") == 1)).alias("fp_adjacent"))
    tn = n_channels * bins - F.col("tp") - F.col("fp") - F.col("fn")
    out = out.withColumn("tn", tn.cast("long"))
    over = lambda a, b: F.col(a) / F.when(F.col(a) + F.col(b) > 0, F.col(a) + F.col(b))
    return out.withColumn("sensitivity", over("tp", "fn")).withColumn("specificity", over("tn", "fp")).withColumn("fpr", over("fp", "tn"))


def detection_by_amplitude(found: DataFrame, by: list[str], bins: int = 12) -> DataFrame:
    """Per group and bin of equal amplitude width (the last closed): truth events, the share detected and its Wilson interval; empty bins have null shares."""
    truth = found.where("side = 0 and amp is not null").withColumn("_hit", F.col("partner").isNotNull().cast("long"))
    span = truth.groupBy(*by).agg(F.min("amp").alias("_lo"), F.max("amp").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("amp") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    per = truth.join(span, by).withColumn("bin", at.cast("int")).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("_hit").alias("k"))
    out = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(per, [*by, "bin"], "left").fillna(0, ["n", "k"])
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select(*by, "bin", "n", "k", (F.col("k") / F.when(F.col("n") > 0, F.col("n"))).alias("p"), low.alias("low"), high.alias("high"))


def partial_auc(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per group: the trapezoid area of y over x, over the range of x; null for one point or no range."""
    order = W.partitionBy(*by).orderBy(x, y)
    area = (F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2
    reach = F.max(x) - F.min(x)
    return points.withColumn("_a", area).groupBy(*by).agg((F.sum("_a") / F.when(reach > 0, reach)).alias("pauc"))


def average_precision(points: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the sum of precision times the gain in recall, from recall 0."""
    order = W.partitionBy(*by).orderBy("recall", "precision")
    return points.withColumn("_g", (F.col("recall") - F.lag("recall", 1, 0.0).over(order)) * F.col("precision")).groupBy(*by).agg(F.sum("_g").alias("ap"))


def gates(scores: DataFrame, tol_ms: float, bias_share: float = 0.2, least_recall: float = 0.2) -> DataFrame:
    """(detector, gate) for every failed check of scores by detector and level (snr): at the top level a bias over a share of the tolerance and a recall under a bound, and silence at every level."""
    top = W.partitionBy("detector").orderBy(F.desc("snr"))
    rows = scores.withColumn("_top", F.row_number().over(top)).withColumn("_all", F.sum("n_det").over(W.partitionBy("detector"))).where("_top = 1")
    failed = F.array_compact(F.array(F.when(F.abs("bias_ms") > bias_share * tol_ms, "bias"), F.when(F.col("recall") < least_recall, "recall"), F.when(F.col("_all") == 0, "silent")))
    return rows.select("detector", F.explode(failed).alias("gate"))


def partial_spearman(rows: DataFrame, x: str, y: str, z: str, by: list[str]) -> DataFrame:
    """Per group: rank correlation of x and y with z held fixed; null where x, y or z is constant."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c in (x, y, z):
        both = both.withColumn(f"_{c}", average_rank(c, by))
    out = both.groupBy(*by).agg(F.count("*").alias("n"), correlation(f"_{x}", f"_{y}").alias("_xy"), correlation(f"_{x}", f"_{z}").alias("_xz"), correlation(f"_{y}", f"_{z}").alias("_yz"))
    rest = F.greatest((1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz")), F.lit(1e-12))
    return out.select(*by, "n", ((F.col("_xy") - F.col("_xz") * F.col("_yz")) / F.sqrt(rest)).alias("rho"))


def noise_report(rows: DataFrame, by: list[str], minutes: float, least_span: float = 1.2) -> DataFrame:
    """Per group: the rank correlations of channel noise with recall (channels with truth) and with false positives a minute (all channels), the true rate held fixed.

    rows has by, noise, n_true, n_det, tp. Where the noisiest channel is not `least_span` times the quietest, a group has no row.
    """
    span = rows.groupBy(*by).agg((F.max("noise") / F.greatest(F.min("noise"), F.lit(1e-9))).alias("_span")).where(F.col("_span") >= least_span)
    kept = rows.join(span, by).withColumn("recall", F.col("tp") / F.when(F.col("n_true") > 0, F.col("n_true"))).withColumn("fp_minute", (F.col("n_det") - F.col("tp")) / minutes)
    recall = partial_spearman(kept.where("n_true > 0"), "noise", "recall", "n_true", by)
    false = partial_spearman(kept, "noise", "fp_minute", "n_true", by).select(*by, F.col("n").alias("n_fp"), F.col("rho").alias("rho_fp"))
    return false.join(recall, by, "left")


def pooled_report(scores: DataFrame) -> DataFrame:
    """Per detector over subjects: pooled counts, recall and precision with Wilson bounds, and medians over subjects of their medians.

    scores has a row a subject and detector (tp, n_true, n_det, dt_ms, bias_ms).
    """
    out = scores.groupBy("detector").agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.sum("n_det").alias("n_det"))
    out = joined(out, medians_of(scores, ["detector"], {"dt_ms": F.col("dt_ms"), "bias_ms": F.col("bias_ms")}), ["detector"], "left")
    r, p = wilson(F.col("tp"), F.col("n_true")), wilson(F.col("tp"), F.col("n_det"))
    return out.select("detector", "tp", "n_true", "n_det", (F.col("tp") / F.greatest("n_true", F.lit(1))).alias("recall"), r[0].alias("recall_low"), r[1].alias("recall_high"), (F.col("tp") / F.greatest("n_det", F.lit(1))).alias("precision"), p[0].alias("precision_low"), p[1].alias("precision_high"), "dt_ms", "bias_ms")


def subject_and_pooled(found: DataFrame) -> DataFrame:
    """tp, n_true and n_det per subject and detector and, with subject null, per detector; one pass with grouping sets."""
    truth, hit = F.col("side") == 0, F.col("partner").isNotNull()
    rows = found.select(F.col("run_id").alias("subject"), "detector", truth.cast("long").alias("t"), (~truth).cast("long").alias("d"), (truth & hit).cast("long").alias("h"))
    return rows.groupingSets([["subject", "detector"], ["detector"]], "subject", "detector").agg(F.sum("h").alias("tp"), F.sum("t").alias("n_true"), F.sum("d").alias("n_det"))


def matrix(found: DataFrame, channels: DataFrame, points: DataFrame, by: list[str], minutes: float) -> DataFrame:
    """(subject, by, tp, n_true, n_det, chan_min): counts of every subject and sweep point; points without events stay at zero."""
    truth, hit = F.col("side") == 0, F.col("partner").isNotNull()
    per = found.groupBy(F.col("run_id").alias("subject"), *by).agg(F.sum((truth & hit).cast("long")).alias("tp"), F.sum(truth.cast("long")).alias("n_true"), F.sum((~truth).cast("long")).alias("n_det"))
    return _at_all_points(per, channels, points, by, minutes)


def _at_all_points(per: DataFrame, channels: DataFrame, points: DataFrame, by: list[str], minutes: float) -> DataFrame:
    size = channels.groupBy(F.col("run_id").alias("subject")).agg((F.count("*") * minutes).alias("chan_min"))
    return size.crossJoin(F.broadcast(points.select(*by).distinct())).join(per, ["subject", *by], "left").fillna(0, ["tp", "n_true", "n_det"])


def sweep_matrix(truth: DataFrame, detections: DataFrame, channels: DataFrame, detectors: list[str], values: list, tol: int, minutes: float) -> DataFrame:
    """matrix() of every detector and threshold from detections with their score: all points in one walk, truth not copied to them."""
    per = sweep_counts(truth, detections, detectors, values, ["run_id", "chan"], tol, ["run_id"]).withColumnRenamed("run_id", "subject")
    points = truth.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, detectors))).alias("detector")).select("detector", F.explode(F.array(*map(F.lit, values))).alias("value"))
    return _at_all_points(per, channels, points, ["detector", "value"], minutes)


def budget_recall(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pooled over subjects: budget (detections a channel-minute), recall and precision per sweep point."""
    out = rows.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.sum("n_det").alias("n_det"), F.sum("chan_min").alias("chan_min"))
    return out.select(*by, "tp", "n_true", "n_det", (F.col("n_det") / F.col("chan_min")).alias("budget"), (F.col("tp") / F.greatest("n_true", F.lit(1))).alias("recall"), (F.col("tp") / F.greatest("n_det", F.lit(1))).alias("precision"))


def left_out(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per fold (the subject left out) and sweep point: the pooled budget and recall of the others, as the total less the subject's own."""
    every = W.partitionBy(*by)
    rest = lambda c: F.sum(c).over(every) - F.col(c)
    out = rows.select(F.col("subject").alias("fold"), *by, rest("tp").alias("tp"), rest("n_true").alias("n_true"), rest("n_det").alias("n_det"), rest("chan_min").alias("chan_min"))
    return out.select("fold", *by, (F.col("n_det") / F.col("chan_min")).alias("budget"), (F.col("tp") / F.greatest("n_true", F.lit(1))).alias("recall"))


def interpolated(curve: DataFrame, wanted: DataFrame, by: list[str], x: str, y: str, at: str, clamp: bool = False) -> DataFrame:
    """wanted (by, at) with y at x = at by straight lines between the curve's points, in the order of x; outside the range null, or with clamp the end's value.

    Each point carries the next one, so a lookup is one join on the groups with a range; a group's curve is a few points.
    """
    order = W.partitionBy(*by).orderBy(x, y)
    seg = curve.select(*by, F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(order).alias("_x1"), F.lead(y).over(order).alias("_y1"), F.row_number().over(order).alias("_k"))
    hit = ((F.col(at) >= F.col("_x0")) & (F.col(at) <= F.col("_x1"))) | (F.lit(clamp) & ((F.col("_x1").isNull() & (F.col(at) > F.col("_x0"))) | ((F.col("_k") == 1) & (F.col(at) < F.col("_x0")))))
    value = F.when(F.col("_x1").isNull() | (F.col(at) < F.col("_x0")), F.col("_y0")).when(F.col("_x1") == F.col("_x0"), F.col("_y0")).otherwise(F.col("_y0") + (F.col(at) - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")))
    keys = [*by, *(c for c in wanted.columns if c not in by)]
    joined = wanted.join(seg, by) if by else wanted.crossJoin(seg)
    found = joined.where(hit).withColumn("_v", F.struct("_k", value.alias("v"))).groupBy(*keys).agg(F.min("_v")["v"].alias(y))
    return wanted.join(found, keys, "left")


def stability(picks: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Over folds: median, least and greatest pick, and their spread in percent of the median."""
    middle = F.median(value)
    return picks.groupBy(*by).agg(middle.alias("median"), F.min(value).alias("low"), F.max(value).alias("high"), (100 * (F.max(value) - F.min(value)) / F.when(middle != 0, middle)).alias("spread"), F.count(value).alias("folds"))


def quartile_band(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The quarter and three-quarter points over subjects."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return rows.groupBy(*by).agg(q[0].alias("q25"), q[1].alias("q75"))


def largest_configuration(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs of the configuration that most runs have, the others); ties to the lowest hash."""
    best = runs.groupBy("cfg_hash").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "cfg_hash").limit(1)
    return runs.join(best, "cfg_hash", "left_semi"), runs.join(best, "cfg_hash", "left_anti")


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Points of a grid that are not done."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def violations(runs: DataFrame, detections: DataFrame, segments: DataFrame, clean_per_slice: DataFrame, channels: DataFrame, slice_us: int, clean: DataFrame | None = None) -> DataFrame:
    """(run_id, rule, detail) for every broken invariant; empty if all hold. runs: run_id, total_us, on_us, off_us;
    clean_per_slice: run_id, chan, clean_us; clean: run_id, chan, on_us, off_us, the analysable time by condition.

    Rules: event times inside the recording, with a channel that is known and, where detections carry is_on, a flag;
    analysable time within a slice, and by condition within the recording; ON and OFF add up to the recording, and a
    channel's analysable ON and OFF to its slices, within a second; segments not empty, inside and apart.
    """
    second = 1_000_000
    say = lambda df, rule, detail: df.select("run_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    inside = detections.join(runs.select("run_id", "total_us"), "run_id")
    seg = segments.join(runs.select("run_id", "total_us"), "run_id")
    before = F.max("t1_us").over(W.partitionBy("run_id").orderBy("t0_us", "t1_us").rowsBetween(W.unboundedPreceding, -1))
    parts = [
        say(inside.where("t_us < 0 or t_us >= total_us"), "event outside", F.col("t_us")),
        say(detections.join(channels.select("run_id", "chan"), ["run_id", "chan"], "left_anti"), "unknown channel", F.col("chan")),
        say(clean_per_slice.where((F.col("clean_us") < 0) | (F.col("clean_us") > slice_us)), "clean time", F.col("clean_us")),
        say(runs.where(F.abs(F.col("on_us") + F.col("off_us") - F.col("total_us")) > second), "ON and OFF", F.col("on_us")),
        say(seg.where("t1_us <= t0_us"), "empty segment", F.col("t0_us")),
        say(seg.where("t0_us < 0 or t1_us > total_us"), "segment outside", F.col("t0_us")),
        say(seg.withColumn("_b", before).where("_b > t0_us"), "segments overlap", F.col("t0_us")),
    ]
    if "is_on" in detections.columns:
        parts.append(say(detections.where("is_on is null"), "no flag", F.col("t_us")))
    if clean is not None:
        both = clean.join(runs.select("run_id", "total_us"), "run_id")
        parts += [say(both.where((F.col(c) < 0) | (F.col(c) > F.col("total_us") + second)), "clean time of a condition", F.col(c)) for c in ("on_us", "off_us")]
        per = clean_per_slice.groupBy("run_id", "chan").agg(F.sum("clean_us").alias("_sum"))
        parts.append(say(clean.join(per, ["run_id", "chan"]).where(F.abs(F.col("on_us") + F.col("off_us") - F.col("_sum")) > second), "clean time is not that of the slices", F.col("chan")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
