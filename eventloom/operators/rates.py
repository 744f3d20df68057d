"""Rates over analysable time, rank correlation, reliability, robust summaries and condition effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.columns import measured_rate
from eventloom.functions.pvalues import spearman_p, wilcoxon_p
from eventloom.operators.selection import counted, joined, quantiles


def counts(events: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """The grid's rows with n, the number of events there; zero where there are none."""
    return grid.join(events.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rates(counted: DataFrame, clean: DataFrame, keys: list[str], unit_us: int, total_us: Column, least: float = 0.2) -> DataFrame:
    """Counted rows with the rate in events per unit_us of analysable time (clean: keys, clean_us); null where too little was measured."""
    joined = counted.join(clean, keys, "left")
    return joined.withColumn("rate", measured_rate(F.col("n"), F.col("clean_us") / unit_us, total_us / unit_us, least))


def summary(rated: DataFrame, by: list[str]) -> DataFrame:
    """Per group: events, mean rate, busiest channel (ties: the lowest) and its rate, channels not measured."""
    top = F.max(F.when(F.col("rate").isNotNull(), F.struct("rate", (-F.col("chan")).alias("c"))))
    return rated.groupBy(*by).agg(F.sum("n").alias("total"), F.avg("rate").alias("mean_rate"), (-top["c"]).alias("busiest"), top["rate"].alias("busiest_rate"), F.sum(F.col("rate").isNull().cast("long")).alias("excluded"))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 by value within a group; equal values share the mean of their places."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def spearman(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Per group: n and rho, Pearson's correlation of average ranks, over rows that have both; null without spread."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null, not NaN, for constant columns."""
    spread = F.var_pop(x) * F.var_pop(y)
    return F.covar_pop(x, y) / F.sqrt(F.when(spread > 0, spread))


def paired(rated: DataFrame, detectors: list[str], keys: list[str]) -> DataFrame:
    """Both detectors' rates of every unordered pair side by side: (det_a, det_b, keys, x, y)."""
    a = rated.select(F.col("detector").alias("det_a"), *keys, F.col("rate").alias("x"))
    b = rated.select(F.col("detector").alias("det_b"), *keys, F.col("rate").alias("y"))
    return a.join(b, keys).where("det_a < det_b")


def pair_statistics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per pair over channels measured by both: gain through the origin, Pearson's r and Spearman's rho."""
    both = pairs.where("x is not null and y is not null")
    plain = both.groupBy(*by).agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.when(F.col("x") != 0, F.col("x") * F.col("x")))).alias("gain"), correlation("x", "y").alias("r"))
    return plain.join(spearman(both, "x", "y", by), by, "left")


def rankable(pairs: DataFrame, by: list[str], drop_ties: bool = False, least: int = 3, warn: int = 25) -> DataFrame:
    """Pairs measured and above zero on both sides, in groups of `least` or more; `thin` marks groups under `warn`. drop_ties removes values that occur twice among them."""
    kept = pairs.where("x > 0 and y > 0")
    if drop_ties:
        alone = lambda c: F.count("*").over(W.partitionBy(*by, c)) == 1
        kept = kept.withColumn("_a", alone("x") & alone("y")).where("_a").drop("_a")
    return kept.withColumn("_n", F.count("*").over(W.partitionBy(*by))).where(F.col("_n") >= least).withColumn("thin", F.col("_n") < warn).drop("_n")


def self_rho(bin_counts: DataFrame, bin_totals: DataFrame, by: list[str], order: list[str], least: int = 4) -> DataFrame:
    """Split-half reliability per group: Spearman's rho of channels' events in even and odd bins, over channels with any.

    bin_counts has (by, run_id, chan, bin_no, n) for bins with events, bin_no counting a run's whole bins in time; null with fewer than `least` bins.
    """
    halves = bin_counts.groupBy(*by, "chan").agg(F.sum(F.when(F.col("bin_no") % 2 == 0, F.col("n")).otherwise(0)).alias("even"), F.sum(F.when(F.col("bin_no") % 2 == 1, F.col("n")).otherwise(0)).alias("odd"))
    found = spearman(halves.where(F.col("even") + F.col("odd") > 0), "even", "odd", by)
    return found.join(bin_totals, "run_id", "left").select(*by, "n", F.when(F.col("bins") >= least, F.col("rho")).alias("self_rho"))


def ceiling(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pair correlations (run_id, det_a, det_b, rho) with the ceiling that both reliabilities set, and their share of it."""
    side = lambda name: own.select("run_id", F.col("detector").alias(f"det_{name}"), F.greatest("self_rho", F.lit(0.0)).alias(f"_{name}"))
    out = pairs.join(side("a"), ["run_id", "det_a"], "left").join(side("b"), ["run_id", "det_b"], "left").withColumn("ceiling", F.sqrt(F.col("_a") * F.col("_b")))
    return out.withColumn("share", F.when(F.col("ceiling") > 0, F.col("rho") / F.col("ceiling"))).drop("_a", "_b")


def median_mad(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: median and 1.4826 times the median distance from it, nulls left out."""
    counts = counted(rows, by, value)
    many = counts.where(F.when(F.col("value").isNotNull(), F.col("n")) > 0).groupBy(*by).agg(F.sum("n").alias("n"))
    middle = joined(quantiles(counts, by, {"median": 0.5}), many, by)
    away = joined(counts, middle.select(*by, "median"), by).groupBy(*by, F.abs(F.col("value") - F.col("median")).alias("value")).agg(F.sum("n").alias("n"))
    return joined(middle, quantiles(away, by, {"mad": 0.5}).withColumn("mad", F.col("mad") * 1.4826), by)


def box(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: quartiles, mean, whiskers (the furthest values within 1.5 interquartile ranges) and the number of outliers."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg(value).alias("mean"))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "mean")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return rows.join(q, by).groupBy(*by, "q1", "q2", "q3", "mean").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.sum((~inside).cast("long")).alias("outliers"))


def condition_effect(both: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Per group over channels measured ON and OFF: mean rates and pooled ratio of all; over those with `least` OFF events or more, the median ratio (zeros included), channels down and at zero, and the signed-rank sum of log ratios (zeros out), with what its p-value needs."""
    rows = both.withColumn("ratio", F.when(F.col("off_n") >= least, F.col("on_rate") / F.when(F.col("off_rate") > 0, F.col("off_rate"))))
    plain = rows.groupBy(*by).agg(
        F.avg("on_rate").alias("mean_on"), F.avg("off_rate").alias("mean_off"), F.try_divide(F.sum("on_rate"), F.sum("off_rate")).alias("pooled"), F.median("ratio").alias("median_ratio"),
        F.sum((F.col("ratio") < 1).cast("long")).alias("n_down"), F.sum((F.col("ratio") == 0).cast("long")).alias("n_zero"), F.count("ratio").alias("n"),
    )
    plain = plain.fillna(0, ["n_down", "n_zero"])
    logs = rows.where("ratio > 0 and ratio <> 1").withColumn("log", F.round(F.log("ratio"), 12)).withColumn("size", F.abs("log"))
    tied = F.count("*").over(W.partitionBy(*by, "size"))
    signed = logs.withColumn("place", average_rank("size", by)).withColumn("tied", tied).groupBy(*by).agg(
        F.sum(F.when(F.col("log") > 0, F.col("place")).otherwise(0.0)).alias("w_plus"), F.count("*").alias("n_signed"), F.sum(F.col("tied") * F.col("tied") - 1).cast("double").alias("ties"),
    )
    return plain.join(signed, by, "left")


def with_effect_p(effects: DataFrame, least: int = 6) -> DataFrame:
    """condition_effect's rows with p, the two-sided p-value of the signed-rank sum; null under `least` channels with a ratio above zero."""
    p = F.udf(lambda w, n, ties, m: None if w is None or m < least else wilcoxon_p(w, n, ties), "double")
    return effects.withColumn("p", p("w_plus", "n_signed", "ties", F.col("n") - F.col("n_zero")))


def with_correlation_p(found: DataFrame) -> DataFrame:
    """Rows of (n, rho) with p, the two-sided p-value of a rank correlation; null under three pairs."""
    p = F.udf(lambda rho, n: None if rho is None else spearman_p(rho, n), "double")
    return found.withColumn("p", p("rho", "n"))


def time_course(counted: DataFrame, by: list[str], least_us: int, unit_us: int) -> DataFrame:
    """Per group and segment (n, t0_us, t1_us): events per unit, over the group's mean of its segments; segments under least_us go."""
    rate = F.col("n") / ((F.col("t1_us") - F.col("t0_us")) / unit_us)
    kept = counted.where(F.col("t1_us") - F.col("t0_us") >= least_us).withColumn("rate", rate)
    mean = F.avg("rate").over(W.partitionBy(*by))
    return kept.withColumn("relative", F.col("rate") / F.when(mean > 0, mean))


def disagreement(rated: DataFrame, n_detectors: int, top: int, by: list[str], floor: float = 1e-9, least: float = 0.05) -> DataFrame:
    """The channels whose detectors' rates differ most: largest over smallest rate; channels not measured by all, or quiet for all, go; ties by channel."""
    spread = rated.groupBy(*by).agg((F.max("rate") / F.greatest(F.min("rate"), F.lit(floor))).alias("spread"), F.count("rate").alias("_n"), F.max("rate").alias("_top"))
    return spread.where((F.col("_n") == n_detectors) & (F.col("_top") >= least)).select(*by, "spread").orderBy(F.desc("spread"), *by).limit(top)


def ranked(rated: DataFrame, by: list[str]) -> DataFrame:
    """Channels with their place by rate, 1 the busiest; those not measured last; ties by channel."""
    return rated.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.coalesce("rate", F.lit(-1.0)).desc(), "chan")))


def onset_report(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Per group: onset contacts, how many of them are among as many busiest channels, what chance gives, their median (cut to a whole number) and worst rank, and how many lie beyond three times their number."""
    n, total = W.partitionBy(*by), W.partitionBy(*by)
    rows = ranks.withColumn("_n", F.sum(F.col("is_ez").cast("long")).over(n)).withColumn("_total", F.count("*").over(total))
    out = rows.groupBy(*by).agg(
        F.max("_n").alias("n_ez"), F.max("_total").alias("n_channels"), F.sum((F.col("is_ez") & (F.col("rank") <= F.col("_n"))).cast("long")).alias("hits"),
        F.floor(F.median(F.when(F.col("is_ez"), F.col("rank")))).alias("median_rank"), F.max(F.when(F.col("is_ez"), F.col("rank"))).alias("worst_rank"),
        F.sum((F.col("is_ez") & (F.col("rank") > 3 * F.col("_n"))).cast("long")).alias("far"),
    )
    chance = F.col("n_ez") * F.col("n_ez") / F.col("n_channels")
    return out.withColumn("chance", chance).withColumn("times_chance", F.col("hits") / F.when(chance > 0, chance))


def cumulative_gain(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Per place k: onset contacts found among the k busiest, and the chance line."""
    order = W.partitionBy(*by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    ez, every = F.col("is_ez").cast("long"), W.partitionBy(*by)
    return ranks.select(*by, "rank", F.sum(ez).over(order).alias("found"), (F.col("rank") * F.sum(ez).over(every) / F.count("*").over(every)).alias("chance"))


def top_overlap(pairs: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Per pair: how many channels are among both sides' k busiest; ties by channel."""
    place = lambda c: F.row_number().over(W.partitionBy(*by).orderBy(F.desc(c), "chan"))
    return pairs.withColumn("_a", place("x")).withColumn("_b", place("y")).groupBy(*by).agg(F.sum(((F.col("_a") <= k) & (F.col("_b") <= k)).cast("long")).alias("overlap"))


def stratified_split(subjects: DataFrame, n_train: int, seed: str) -> DataFrame:
    """Subjects (subject, n_events, n_channels) with train: one of each of n_train equal strata by size, picked by hash."""
    strata = subjects.withColumn("stratum", F.ntile(n_train).over(W.orderBy("n_events", "n_channels", "subject")))
    return strata.withColumn("train", F.row_number().over(W.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(seed), F.col("subject").cast("string"))))) == 1)
