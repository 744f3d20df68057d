"""The structure of event trains: intervals, bursts, synchrony, variability of counts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.intervals import on_clock
from eventloom.operators.selection import counted, joined, quantiles


def isi_summary(isi: DataFrame, by: list[str], burst_us: int) -> DataFrame:
    """Per group, channels pooled: CV of intervals (population), their median and least, and intervals under burst_us per event."""
    counts = counted(isi, by, "isi_us")
    n, x = F.col("n"), F.col("value").cast("double")
    some = F.sum(F.when(F.col("value").isNotNull(), n))
    mean = F.sum(x * n) / some
    out = counts.groupBy(*by).agg(F.sum("n").alias("_n"), some.alias("_some"), mean.alias("_mean"), F.min("value").alias("min_us"), F.sum(F.when(F.col("value") < burst_us, n).otherwise(0)).alias("_burst"))
    spread = joined(counts, out.select(*by, F.col("_mean").alias("_about")), by).groupBy(*by).agg(F.sum((x - F.col("_about")) * (x - F.col("_about")) * n).alias("_square"))
    out = joined(joined(out, spread, by), quantiles(counts, by, {"median_us": 0.5}), by, "left")
    return out.select(*by, F.try_divide(F.sqrt(F.col("_square") / F.col("_some")), F.col("_mean")).alias("cv"), "median_us", "min_us", (F.col("_burst") / F.col("_n")).alias("burst_fraction"))


def isi_histogram(isi: DataFrame, by: list[str], low: float, high: float, bins: int = 59, log: bool = True) -> DataFrame:
    """Per group and bin (from 0): count and density of the intervals in [low, high], the last bin closed; edges equal in log or plain time."""
    scale = (lambda c: F.log(c)) if log else (lambda c: c)
    lo, hi = scale(F.lit(float(low))), scale(F.lit(float(high)))
    step = (hi - lo) / bins
    inside = isi.where(F.col("isi_us").between(low, high))
    at = F.least(F.floor((scale(F.col("isi_us").cast("double")) - lo) / step), F.lit(bins - 1))
    counted = inside.withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    edge = (lambda k: F.exp(lo + k * step)) if log else (lambda k: lo + k * step)
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    return counted.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy(*by)) * width))


def band_fraction(isi: DataFrame, by: list[str], under_us: int) -> DataFrame:
    """Per group: the share of intervals under a bound."""
    return isi.where("isi_us is not null").groupBy(*by).agg(F.avg((F.col("isi_us") < under_us).cast("double")).alias("share"))


def synchrony(events: DataFrame, by: list[str], window_us: int, slice_us: int) -> DataFrame:
    """Per group: the share of events with one on another channel within the window, bounds included.

    The nearest event of another channel before an event is the one before its run of events of one channel, carried
    along the run; the nearest after it likewise from the end. Both run over time slices: each event is also copied to
    the slices that its window reaches, and counted only at home, so that one busy group is many small sorts.
    """
    at = F.floor(F.col("t_us") / slice_us)
    copies = events.select(*by, "chan", "t_us", at.alias("_home"), F.explode(F.sequence(F.floor((F.col("t_us") - window_us) / slice_us), F.floor((F.col("t_us") + window_us) / slice_us))).alias("_slice"))

    def other(rows: DataFrame, name: str, *order: Column) -> DataFrame:
        line = W.partitionBy(*by, "_slice").orderBy(*order)
        beside = rows.withColumn("_c", F.lag("chan").over(line)).withColumn("_t", F.lag("t_us").over(line))
        turn = F.when(F.col("_t").isNotNull() & ~F.col("_c").eqNullSafe(F.col("chan")), F.col("_t"))
        return beside.withColumn(name, F.last(turn, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0))).drop("_c", "_t")

    placed = other(other(copies, "_before", F.asc("t_us"), F.asc("chan")), "_after", F.desc("t_us"), F.desc("chan")).where("_home = _slice")
    near = F.coalesce(F.col("t_us") - F.col("_before") <= window_us, F.lit(False)) | F.coalesce(F.col("_after") - F.col("t_us") <= window_us, F.lit(False))
    return placed.groupBy(*by).agg(F.count("*").alias("n"), F.avg(near.cast("double")).alias("synchrony"))


def shift(chan: Column, rep: Column, total_us: int | Column) -> Column:
    """A channel's circular shift for one repeat: from a hash, so that reruns and engines agree."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", chan.cast("string"), rep.cast("string"))), 1, 12), 16, 10).cast("long") % total_us


def chance_synchrony(events: DataFrame, by: list[str], window_us: int, slice_us: int, total_us: int, reps: int = 3) -> DataFrame:
    """Per group: mean synchrony after each channel is shifted by its own offset modulo the recording."""
    moved = events.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("t_us", (F.col("t_us") + shift(F.col("chan"), F.col("_rep"), total_us)) % total_us)
    return synchrony(moved, [*by, "_rep"], window_us, slice_us).groupBy(*by).agg(F.avg("synchrony").alias("chance"))


def synchrony_in_condition(events: DataFrame, segments: DataFrame, keys: list[str], by: list[str], window_us: int, slice_us: int, width_us: int, reps: int = 3) -> DataFrame:
    """Per group, over the events inside segments (keys, t0_us, t1_us, disjoint): observed synchrony, and chance, the mean after each channel is shifted by its own offset.

    Observed synchrony is on the recording's clock. Shifts go round the condition's own clock, which stands still
    outside the segments, so that a shifted train keeps to the condition and its rate there; modulo the recording it
    would be thinned by the time outside, and modulo the condition's length alone segments would fall on one another.
    keys are columns of events and segments; by holds them and what else parts the groups.
    """
    inside = on_clock(events, segments, keys, width_us)
    moved = inside.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    moved = moved.withColumn("t_us", (F.col("clock_us") + shift(F.col("chan"), F.col("_rep"), F.col("length_us"))) % F.col("length_us"))
    chance = synchrony(moved, [*by, "_rep"], window_us, slice_us).groupBy(*by).agg(F.avg("synchrony").alias("chance"))
    return synchrony(inside, by, window_us, slice_us).withColumnRenamed("synchrony", "observed").join(chance, by)


def bins_by_width(events: DataFrame, by: list[str], widths: list[int]) -> DataFrame:
    """(by, width_us, bin, n) of a whole recording's bins that hold events, for all widths at once.

    Events are counted once, in bins of the widths' greatest common divisor, which no bin's edge cuts; only these
    counts go on to every width.
    """
    least = math.gcd(*widths)
    fine = events.groupBy(*by, F.floor(F.col("t_us") / least).alias("_fine")).agg(F.count("*").alias("_n"))
    rows = fine.withColumn("width_us", F.explode(F.array(*(F.lit(w).cast("long") for w in widths))))
    return rows.groupBy(*by, "width_us", F.floor(F.col("_fine") * least / F.col("width_us")).alias("bin")).agg(F.sum("_n").alias("n"))


def fano(events: DataFrame, by: list[str], widths: list[int], total_us: int, least_rate: float, unit_us: int) -> DataFrame:
    """Per group and width: the median over channels above a rate of variance over mean of the counts of whole bins.

    Empty bins need no rows: sums of n and n squared and the known number of bins give both moments. Widths have two
    bins at least and eight fit the recording.
    """
    fit = [w for w in widths if w <= total_us / 8 and total_us // w >= 2]
    rate = events.groupBy(*by, "chan").agg((F.count("*") / (total_us / unit_us)).alias("_rate")).where(F.col("_rate") > least_rate)
    whole = bins_by_width(events, [*by, "chan"], fit).withColumn("_bins", F.floor(F.lit(total_us) / F.col("width_us"))).where("bin < _bins")
    per = whole.groupBy(*by, "chan", "width_us", "_bins").agg(F.sum("n").alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    mean = F.col("_s") / F.col("_bins")
    return per.join(rate, [*by, "chan"]).withColumn("_fano", (F.col("_q") / F.col("_bins") - mean * mean) / mean).groupBy(*by, "width_us").agg(F.median("_fano").alias("fano"), F.count("*").alias("channels"))


def activity(events: DataFrame, groups: DataFrame, by: list[str], width_us: int, total_us: int) -> tuple[DataFrame, DataFrame]:
    """(per group, per bin) of pooled counts in a recording's whole bins: CV (sample), CV over Poisson's, and each bin relative to the mean with Poisson's band; groups with fewer than four bins have null."""
    bins = total_us // width_us
    hits = events.groupBy(*by, F.floor(F.col("t_us") / width_us).alias("bin")).agg(F.count("*").alias("n"))
    grid = groups.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    rows = grid.join(hits, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cv = F.when(F.lit(bins >= 4), F.try_divide(F.stddev_samp("n"), F.avg("n")))
    mean = F.avg("n").over(W.partitionBy(*by))
    mean = F.when(mean > 0, mean)
    return rows.groupBy(*by).agg(cv.alias("cv"), (cv * F.sqrt(F.avg("n"))).alias("over_poisson")), rows.select(*by, "bin", "n", (F.col("n") / mean).alias("relative"), (1 / F.sqrt(mean)).alias("band"))


def width_errors(events: DataFrame, widths: list[int], tiers: list[tuple[float, float]], total_us: int, unit_us: int, least: int = 3) -> DataFrame:
    """Per tier of channel rates and width: the median relative error of a bin's rate, over channels' whole bins.

    Equal errors are weighted: a channel's bins of one count are one row with a frequency, empty bins among them.
    Tiers with fewer than `least` channels go.
    """
    keys = ["run_id", "detector", "chan"]
    rate = events.groupBy(*keys).agg((F.count("*") / (total_us / unit_us)).alias("rate"))
    tier = F.coalesce(*(F.when((F.col("rate") >= a) & (F.col("rate") < b), F.lit(i)) for i, (a, b) in enumerate(tiers)))
    rate = rate.withColumn("tier", tier).where("tier is not null").withColumn("channels", F.count("*").over(W.partitionBy("tier"))).where(F.col("channels") >= least)
    full = bins_by_width(events, keys, widths).withColumn("_bins", F.floor(F.lit(total_us) / F.col("width_us"))).where("bin < _bins")
    hist = full.groupBy(*keys, "width_us", "_bins", "n").agg(F.count("*").alias("freq"))
    some = hist.groupBy(*keys, "width_us").agg(F.sum("freq").alias("_some"))
    grid = rate.select(*keys).withColumn("width_us", F.explode(F.array(*(F.lit(w).cast("long") for w in widths)))).join(some, [*keys, "width_us"], "left")
    zero = grid.select(*keys, "width_us", F.lit(0).cast("long").alias("n"), (F.floor(F.lit(total_us) / F.col("width_us")) - F.coalesce("_some", F.lit(0))).alias("freq")).where("freq > 0")
    rows = hist.select(*keys, "width_us", "n", "freq").unionByName(zero).join(rate, keys)
    error = F.abs(F.col("n") / (F.col("width_us") / unit_us) - F.col("rate")) / F.col("rate")
    return rows.withColumn("_e", error).groupBy("tier", "channels", "width_us").agg(F.percentile("_e", 0.5, F.col("freq")).alias("error"))


def least_width(errors: DataFrame, bound: float) -> DataFrame:
    """Per tier: the least width whose error is within the bound; null if none is."""
    return errors.groupBy("tier").agg(F.min(F.when(F.col("error") <= bound, F.col("width_us"))).alias("width_us"))


def absorption(isi: DataFrame, by: list[str], cuts: list[int], unit_total: float) -> DataFrame:
    """Per group and cut-off: intervals under it over all events, and the events a unit of time that would survive. One pass: each interval is counted at its first cut-off above, then summed up."""
    first = F.element_at(F.filter(F.array(*map(F.lit, sorted(cuts))), lambda c: c > F.col("isi_us")), 1)
    placed = isi.groupBy(*by, F.when(F.size(F.filter(F.array(*map(F.lit, sorted(cuts))), lambda c: c > F.col("isi_us"))) > 0, first).alias("cut_us")).agg(F.count("*").alias("_n"))
    totals = placed.groupBy(*by).agg(F.sum("_n").alias("_all"))
    grid = totals.withColumn("cut_us", F.explode(F.array(*map(F.lit, sorted(cuts)))))
    line = grid.join(placed, [*by, "cut_us"], "left").withColumn("_under", F.sum(F.coalesce("_n", F.lit(0))).over(W.partitionBy(*by).orderBy("cut_us").rowsBetween(W.unboundedPreceding, 0)))
    return line.select(*by, "cut_us", (F.col("_under") / F.col("_all")).alias("absorbed"), ((F.col("_all") - F.col("_under")) / unit_total).alias("surviving"))


#: Windows in one slice of a train of seeds.
SLICE_WINDOWS = 1024


def collapsed(seeds: DataFrame, keys: list[str], window_us: int, windows: int = SLICE_WINDOWS) -> DataFrame:
    """Seeds (keys, t_us, ...) without those closer than the window to the one kept before; of equal times the first by the other columns.

    A kept seed's successor is the first one at least a window later, so what is kept is the orbit of the first seed.
    Trains are cut into slices. In each, pointers to successors are doubled until they leave it: that gives, for the few
    seeds where an orbit can enter, the time from which it goes on. One stream a train then steps from slice to slice,
    a row for each such seed, and every slice takes its part of the orbit from where it enters. Seeds without a time go.
    """
    if window_us <= 0:
        return seeds.where("t_us is not null")
    rest = [c for c in seeds.columns if c not in (*keys, "t_us")]
    width = windows * window_us
    placed = seeds.select(*keys, "t_us", *rest, F.floor(F.col("t_us") / width).alias("_slice")).where("_slice is not null")
    group = [*keys, "_slice"]

    def entries(part: pa.Table) -> pa.Table:
        t = np.unique(part["t_us"].to_numpy())
        start = part["_slice"][0].as_py() * width
        to = np.searchsorted(t, t + window_us)
        to = np.where(to < len(t), to, np.arange(len(t)))  # the last one within the slice points to itself
        while not np.array_equal(to[to], to):
            to = to[to]
        some = t[: np.searchsorted(t, start + window_us) + 1]
        first = part.slice(0, 1).select(group)
        return pa.table({**{c: pa.repeat(first[c][0], len(some)) for c in group}, "_enter": some, "_from": t[to[: len(some)]] + window_us})

    kinds = dict(placed.dtypes)
    named = lambda columns: ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    ways = placed.groupBy(*group).applyInArrow(entries, named(group) + ", _enter long, _from long")
    ordered = ways.repartition(*keys).sortWithinPartitions(*keys, "_slice", "_enter")
    n = len(keys)

    def steps(batches):
        train, done, due = None, None, None
        for b in batches:
            kept = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if row[:n] != train:
                    train, done, due = row[:n], None, None
                if row[n] != done and (due is None or row[n + 1] >= due):
                    done, due = row[n], row[n + 2]
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64())).select([*group, "_enter"])

    chosen = ordered.mapInArrow(steps, named(group) + ", _enter long")

    def walk(part: pa.Table, entered: pa.Table) -> pa.Table:
        if not len(part) or not len(entered):
            return part.slice(0, 0).drop_columns("_slice")
        part = part.sort_by([("t_us", "ascending"), *((c, "ascending") for c in rest)])
        t, kept, at = part["t_us"].to_numpy(), [], int(np.searchsorted(part["t_us"].to_numpy(), entered["_enter"][0].as_py()))
        while at < len(t):
            kept.append(at)
            at = int(np.searchsorted(t, t[at] + window_us))
        return part.take(pa.array(kept, pa.int64())).drop_columns("_slice")

    return placed.groupBy(*group).cogroup(chosen.groupBy(*group)).applyInArrow(walk, named([*keys, "t_us", *rest])).select(*seeds.columns)


def candidates(isi: DataFrame, events: DataFrame, pair_us: int, window_us: int) -> DataFrame:
    """Burst candidates (run_id, chan, t_us, gap_us, most, spread): seeds are pairs of one detector within pair_us in a segment; close seeds collapse; a candidate has some detector with two events or more in [t - w, t + 2w]; spread is the largest less the smallest of the detectors' counts."""
    seeds = isi.where(F.col("isi_us") <= pair_us).select("run_id", "chan", (F.col("t_us") - F.col("isi_us")).alias("t_us"), F.col("isi_us").alias("gap_us"))
    kept = collapsed(seeds, ["run_id", "chan"], window_us)
    cells = kept.withColumn("_b", F.explode(F.sequence(F.floor((F.col("t_us") - window_us) / window_us), F.floor((F.col("t_us") + 2 * window_us) / window_us))))
    there = events.select("run_id", "chan", "detector", F.col("t_us").alias("_t"), F.floor(F.col("t_us") / window_us).alias("_b"))
    hits = cells.join(there, ["run_id", "chan", "_b"]).where((F.col("_t") >= F.col("t_us") - window_us) & (F.col("_t") <= F.col("t_us") + 2 * window_us))
    per = hits.groupBy("run_id", "chan", "t_us", "gap_us", "detector").agg(F.count("*").alias("n"))
    n_detectors = events.select("detector").distinct().count()
    least = F.when(F.count("*") < n_detectors, 0).otherwise(F.min("n"))
    return per.groupBy("run_id", "chan", "t_us", "gap_us").agg(F.max("n").alias("most"), (F.max("n") - least).alias("spread")).where("most >= 2")


def band_histogram(found: DataFrame, bands: list[int], floor_us: int) -> DataFrame:
    """Candidates per half-open gap band [low, high); bands that end at or under the merge floor go."""
    kept = [(a, b) for a, b in zip(bands, bands[1:]) if b > floor_us]
    band = F.coalesce(*(F.when((F.col("gap_us") >= a) & (F.col("gap_us") < b), F.lit(a)) for a, b in kept))
    return found.withColumn("band_us", band).where("band_us is not null").groupBy("band_us").agg(F.count("*").alias("n"))


def diverse(rows: DataFrame, by: list[str], order: list[Column], n) -> DataFrame:
    """The first n rows a group, no channel twice: new shafts first, then the other channels, each in the given order. n is a number or column.

    A channel's best row comes before any other of it, and a shaft's best row is its channel's; so only ranks are
    needed, no walk.
    """
    first_of = lambda c: F.row_number().over(W.partitionBy(*by, *c).orderBy(*order))
    best = rows.withColumn("_c", first_of(["run_id", "chan"])).where("_c = 1").withColumn("_s", F.least(first_of(["shaft"]), F.lit(2)))
    turn = F.row_number().over(W.partitionBy(*by).orderBy("_s", *order))
    return best.withColumn("turn", turn).where(F.col("turn") <= n).drop("_s", "_c")


def review_pick(rows: DataFrame, by: list[str], ties: list[str], n: int) -> DataFrame:
    """n candidates a group for review: half of them where detectors disagree most (largest spread, then least gap), the rest nearest the group's median count on other channels.

    rows has by, run_id, chan, shaft, gap_us, most, spread; ties names the columns that settle equal places. `typical` tells the halves apart.
    """
    apart = diverse(rows, by, [F.desc("spread"), F.col("gap_us"), *map(F.col, ties)], n // 2)
    middle = rows.groupBy(*by).agg(F.median("most").alias("_middle"))
    taken = apart.groupBy(*by).agg(F.count("*").alias("_taken"))
    others = rows.join(apart.select(*by, "run_id", "chan"), [*by, "run_id", "chan"], "left_anti").join(middle, by).join(taken, by)
    typical = diverse(others, by, [F.abs(F.col("most") - F.col("_middle")), F.col("spread"), *map(F.col, ties)], n - F.col("_taken"))
    typical = typical.withColumn("turn", F.col("turn") + F.col("_taken")).select(*apart.columns)
    return apart.withColumn("typical", F.lit(False)).unionByName(typical.withColumn("typical", F.lit(True)))
