"""Jobs over channel-blocks of samples: detection, spectra, excerpts and averages.

signals has a row a channel and block: rec_id, chan, block, t0_us, fs, samples. Blocks follow each other.
"""

from __future__ import annotations

import inspect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from eventloom.functions import dsp
from eventloom.operators.matching import islands, near_any
from eventloom.operators.scans import neighbourhoods, running

#: Samples of one slice of a channel, and places of one slice while they are numbered.
SLICE_ROWS, SLICE_PLACES = 1 << 16, 1 << 16

#: Samples that a numpy helper takes at once, of buffers of one length, unless one buffer has more.
AT_ONCE = 1 << 18

#: Detectors by name: functions of (buffers of one length as rows, fs, **parameters) that give each row's list of (sample, value, weight, density, confidence) tuples.
DETECTORS = {"envelope": dsp.detect_rows}


def parameters(name: str, **given) -> dict:
    """The given parameters, if the detector knows them all."""
    known = set(list(inspect.signature(DETECTORS[name]).parameters)[2:])
    if unknown := sorted(set(given) - known):
        raise ValueError(f"{name} has no {', '.join(unknown)}; it has {', '.join(sorted(known))}")
    return given


def buffers(signals: DataFrame, blocks: int, halo: int) -> DataFrame:
    """Signals with `buffer` and `inner`: every block in its own buffer of `blocks` blocks, and copied to the buffers beside within `halo` blocks."""
    own = F.floor(F.col("block") / blocks)
    reach = F.sequence(F.floor((F.col("block") - halo) / blocks), F.floor((F.col("block") + halo) / blocks))
    return signals.withColumn("buffer", F.explode(reach)).withColumn("inner", F.col("buffer") == own)


def in_buffers(signals: DataFrame, blocks: int, halo: int, one, schema: str) -> DataFrame:
    """What one(rec_id, chan, stretches) gives as an Arrow batch of the schema, for buffers of `blocks` blocks and `halo` blocks on either side.

    A stretch is a run of blocks that follow each other, as (place of its buffer in rec_id and chan, first block's
    t0_us, fs, blocks, their t0_us, which of them are the buffer's own, where each ends in the samples, samples); a missing
    block parts two. A buffer is one row with its samples end to end, and buffers without blocks of their own go. They
    are dealt to a number of partitions of its own: what is done with them takes longer than their bytes tell.
    """
    parts = int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = buffers(signals.select("rec_id", "chan", "block", "t0_us", "fs", "samples"), blocks, halo).repartition(parts, "rec_id", "chan", "buffer")
    held = F.sort_array(F.collect_list(F.struct("block", "inner", "t0_us", "fs", F.size("samples").alias("size"), "samples")))
    rows = rows.groupBy("rec_id", "chan", "buffer").agg(F.max("inner").alias("own"), held.alias("b")).where("own")
    every = F.flatten(F.transform("b", lambda x: x["samples"].cast("array<double>")))
    rows = rows.select("rec_id", "chan", *(F.col(f"b.{c}").alias(c) for c in ("block", "inner", "t0_us", "size", "fs")), every.alias("samples"))

    def batches(found):
        for b in found:
            at = {c: b.column(c).offsets.to_numpy() for c in ("block", "samples")}
            flat = {c: b.column(c).values.to_numpy(zero_copy_only=False) for c in ("block", "inner", "t0_us", "size", "fs", "samples")}
            out = []
            for k in range(b.num_rows):
                a, z = at["block"][k], at["block"][k + 1]
                ends = np.concatenate(([0], np.cumsum(flat["size"][a:z])))
                cuts = [a, *(a + 1 + np.flatnonzero(np.diff(flat["block"][a:z]) != 1)), z]
                for x, y in zip(cuts, cuts[1:]):
                    if flat["inner"][x:y].any():
                        first, last = at["samples"][k] + ends[x - a], at["samples"][k] + ends[y - a]
                        out.append((k, int(flat["t0_us"][x]), float(flat["fs"][x]), flat["block"][x:y], flat["t0_us"][x:y], flat["inner"][x:y], ends[x - a + 1 : y - a + 1] - ends[x - a], flat["samples"][first:last]))
            yield one(b.column("rec_id"), b.column("chan"), out)

    return rows.mapInArrow(batches, schema)


def alike(stretches: list[tuple]):
    """(places in the list, samples as rows, fs) of stretches of one length and rate, at most AT_ONCE samples at once unless one has more."""
    groups: dict = {}
    for i, (_, _, fs, *_, x) in enumerate(stretches):
        groups.setdefault((len(x), fs), []).append(i)
    for (n, fs), places in groups.items():
        step = max(AT_ONCE // max(n, 1), 1)
        for a in range(0, len(places), step):
            some = places[a : a + step]
            yield some, np.stack([stretches[i][-1] for i in some]), fs


def run_detector(signals: DataFrame, name: str, blocks: int, halo: int, **given) -> DataFrame:
    """(rec_id, chan, t_us, value, weight, density, con): a detector on every channel's buffers; marks count in the buffer whose own blocks hold them. A task holds a batch of buffers with their halo; where a block is missing, either side is a signal by itself."""
    fn, arguments = DETECTORS[name], parameters(name, **given)
    numbers = ["value", "weight", "density", "con"]

    def one(recs, chans, stretches):
        at, times, values = [], [], []
        for places, x, fs in alike(stretches):
            for i, marks in zip(places, fn(x, fs, **arguments)):
                k, start, _, _, t0_us, inner, ends, _ = stretches[i]
                sizes = np.diff(ends, prepend=0)
                first, last = int(t0_us[inner].min()), int(t0_us[inner].max() + sizes[inner][-1] / fs * 1e6)
                for m, *rest in marks:
                    t = start + round(m / fs * 1e6)
                    if first <= t < last:
                        at.append(k)
                        times.append(t)
                        values.append(rest)
        at = pa.array(at, pa.int32())
        columns = [pa.array([v[c] for v in values], pa.float64()) for c in range(len(numbers))]
        return pa.RecordBatch.from_arrays([recs.take(at), chans.take(at), pa.array(times, pa.int64()), *columns], ["rec_id", "chan", "t_us", *numbers])

    kinds = dict(signals.dtypes)
    return in_buffers(signals, blocks, halo, one, f"rec_id {kinds['rec_id']}, chan {kinds['chan']}, t_us long, value double, weight double, density double, con double")


def lognormal_background(samples: DataFrame, keys: list[str], at: str, value: str, before: int, after: int, k1: float, k3: float) -> DataFrame:
    """Samples with mode, median and mean of a lognormal background over a window of rows, and the threshold.

    Samples are numbered along their channel, and slices of numbers carry copies of the samples that their windows reach,
    so a long channel is many tasks. A window's moments are differences of a slice's running sums of ln x and its
    square, so a row costs the same however wide the window is. Sums run over ln x less the slice's mean of it, which
    keeps them small. A null sample counts as a row but not in the moments.
    """
    size = max(SLICE_ROWS, 4 * (before + after))
    numbered = running(samples, keys, [at], SLICE_PLACES, {"_i": ("sum", F.lit(1))}).withColumn("_x", F.log(value))
    inside_of = [*keys, "_slice"]
    order, whole = W.partitionBy(*inside_of).orderBy("_i"), W.partitionBy(*inside_of)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    out = neighbourhoods(numbered, keys, "_i", before + 1, after, size).withColumn("_c", F.avg("_x").over(whole)).withColumn("_x", F.col("_x") - F.col("_c"))
    out = out.withColumn("_1", F.count("_x").over(so_far)).withColumn("_2", F.sum("_x").over(so_far)).withColumn("_3", F.sum(F.col("_x") * F.col("_x")).over(so_far))
    all_of = {"_1": F.count("_x").over(whole), "_2": F.sum("_x").over(whole), "_3": F.sum(F.col("_x") * F.col("_x")).over(whole)}
    inside = lambda c: F.coalesce(F.lead(c, after).over(order), all_of[c]) - F.coalesce(F.lag(c, before + 1).over(order), F.lit(0))
    out = out.withColumn("_n", inside("_1")).withColumn("_s1", inside("_2")).withColumn("_s2", inside("_3")).where("_home")
    spread = F.when(F.col("_n") > 1, F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n"), F.lit(0.0)) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    out = out.withColumn("_m", F.col("_c") + F.col("_s1") / F.col("_n")).withColumn("_v", spread)
    mode, median, mean = F.exp(F.col("_m") - F.col("_v")), F.exp("_m"), F.exp(F.col("_m") + F.col("_v") / 2)
    out = out.withColumn("mode", mode).withColumn("median", median).withColumn("mean", mean)
    return out.withColumn("threshold", k1 * (F.col("mode") + F.col("median")) - k3 * (F.col("mean") - F.col("mode"))).drop("_x", "_c", "_1", "_2", "_3", "_n", "_s1", "_s2", "_m", "_v", "_i", "_slice", "_home")


def crossings(samples: DataFrame, keys: list[str], at: str, value: str, bound: str, join: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, start, stop, peak_at, peak, carry): runs of samples above their bound, runs at most `join` places apart united, with their highest sample (the first of equals) and its other columns named in carry."""
    runs = islands(samples.where(F.col(value) > F.col(bound)), keys, join, at).withColumnRenamed("island", "_run")
    return runs.groupBy(*keys, "_run").agg(F.min(at).alias("start"), F.max(at).alias("stop"), (-F.max_by(-F.col(at), F.struct(F.col(value), -F.col(at)))).alias("peak_at"), F.max(value).alias("peak"), *(F.max_by(c, F.struct(F.col(value), -F.col(at))).alias(c) for c in carry)).drop("_run")


def with_ambiguous(obvious: DataFrame, low: DataFrame, keys: list[str], dt_us: int) -> DataFrame:
    """Obvious marks with con 1, and those of the low threshold that have an obvious mark of any channel within dt, with con 0.5."""
    extra = low.join(obvious.select(*keys, "chan", "t_us"), [*keys, "chan", "t_us"], "left_anti")
    kept = near_any(extra.select(*keys, "chan", "t_us"), obvious.select(*keys, "t_us"), keys, dt_us).where("near").select(*keys, "chan", "t_us", F.lit(0.5).alias("con"))
    return obvious.select(*keys, "chan", "t_us", F.lit(1.0).alias("con")).unionByName(kept)


def tiers(marks: DataFrame, keys: list[str], dt_us: int) -> DataFrame:
    """Marks of confidence 1, and of the others those that have such a mark of any channel within dt. Marks are read three times, so they should be stored."""
    sure, other = marks.where("con >= 1"), marks.where("con < 1")
    kept = near_any(other, sure.select(*keys, "t_us").distinct(), keys, dt_us).where("near").select(*marks.columns)
    return sure.unionByName(kept)


def discharges(marks: DataFrame, dt_us: int) -> DataFrame:
    """(rec_id, t0_us, t1_us, duration_us, chan, marks, last_us and the greatest of each other column): marks of all channels, each active for dt, united to events.

    Per event and channel: marks, the end of its last activity, and the greatest value, weight, confidence, density or
    height over the background, whichever the marks have. Channels without a mark have no row. Marks at most dt apart
    are one event; events are found by time slices, so a busy recording is many small sorts.
    """
    rest = [c for c in marks.columns if c not in ("rec_id", "chan", "t_us")]
    whole = W.partitionBy("rec_id", "island")
    rows = islands(marks, ["rec_id"], dt_us).withColumn("t1_us", F.max("t_us").over(whole) + dt_us).withColumnRenamed("island", "t0_us")
    out = rows.groupBy("rec_id", "t0_us", "t1_us", "chan").agg(F.count("*").alias("marks"), (F.max("t_us") + dt_us).alias("last_us"), *(F.max(c).alias(c) for c in rest))
    return out.withColumn("duration_us", F.col("t1_us") - F.col("t0_us"))


def discharges_with_signal(marks: DataFrame, signals: DataFrame, dt_us: int, width_us: int) -> DataFrame:
    """(rec_id, t0_us, t1_us, duration_us, chan, con, marks, last_us, height, raw) of every event on every channel of its recording.

    signals has channel-blocks with two arrays of equal length: samples, and heights, the envelope over its background;
    width_us should be near a block's usual length. Events are those of discharges. Over an event's time, bounds included,
    height is the greatest absolute height and raw the sample of greatest absolute value with its sign, the first of
    equal ones. con and marks are 0 and last_us null where a channel has no mark; channels without samples then have no
    row. Events meet blocks by an equi-join on recording and time bucket, and only the touched part of a block is
    looked at; what leaves a block is one row.
    """
    found = discharges(marks.select("rec_id", "chan", "t_us", "con"), dt_us)
    events = found.select("rec_id", "t0_us", "t1_us").distinct()
    end = F.col("t0_us") + F.ceil(F.size("samples") * 1e6 / F.col("fs"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width_us), F.floor(b / width_us)))
    blocks = signals.where(F.size("samples") > 0).withColumn("_c", cells(F.col("t0_us"), end - 1)).select("rec_id", "chan", "fs", "samples", "heights", "_c", F.col("t0_us").alias("_b0"), end.alias("_b1"))
    met = events.withColumn("_c", cells(F.col("t0_us"), F.col("t1_us"))).join(blocks, ["rec_id", "_c"])
    met = met.where((F.col("_b0") <= F.col("t1_us")) & (F.col("t0_us") < F.col("_b1")) & (F.col("_c") == F.floor(F.greatest("t0_us", "_b0") / width_us)))
    place = lambda t: (t - F.col("_b0")) * F.col("fs") / 1e6
    first = F.greatest(F.ceil(F.round(place(F.col("t0_us")), 6)), F.lit(0))
    size = F.least(F.floor(F.round(place(F.col("t1_us")), 6)) + 1, F.size("samples").cast("long")) - first
    part = lambda c: F.slice(c, (first + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))
    high = F.array_max(F.transform(part("heights"), F.abs))
    far = F.array_max(F.transform(part("samples"), lambda x, i: F.struct(F.abs(x).alias("far"), (-(F.col("_b0") + (first + i) * 1e6 / F.col("fs"))).alias("before"), x.alias("raw"))))
    per = met.select("rec_id", "t0_us", "t1_us", "chan", high.alias("_high"), far.alias("_far")).groupBy("rec_id", "t0_us", "t1_us", "chan").agg(F.max("_high").alias("height"), F.max("_far")["raw"].alias("raw"))
    out = per.join(found, ["rec_id", "t0_us", "t1_us", "chan"], "full")
    return out.select("rec_id", "t0_us", "t1_us", (F.col("t1_us") - F.col("t0_us")).alias("duration_us"), "chan", F.coalesce("con", F.lit(0.0)).alias("con"), F.coalesce("marks", F.lit(0)).alias("marks"), "last_us", "height", "raw")


def rhythm_mask(signals: DataFrame, window: int, low: float, high: float, blocks: int = 10) -> DataFrame:
    """(rec_id, chan, t0_us, t1_us) of windows whose autoregressive spectrum peaks between two frequencies.

    Windows follow each other from the start of each buffer of blocks or, after a missing block, of what follows it; a
    shorter rest counts as a window.
    """

    def one(recs, chans, stretches):
        out = []
        cut = [(k, start, fs, a, x[a : a + window]) for k, start, fs, *_, x in stretches for a in range(0, len(x), window)]
        cut = [w for w in cut if len(w[-1]) > 12]
        for places, parts, fs in alike(cut):
            for i, varies, peak in zip(places, parts.std(-1) > 0, dsp.rhythm_peak(parts, fs)):
                if varies and low < peak < high:
                    k, start, _, a, part = cut[i]
                    out.append((k, start + round(a / fs * 1e6), start + round((a + len(part)) / fs * 1e6)))
        at = pa.array([r[0] for r in out], pa.int32())
        return pa.RecordBatch.from_arrays([recs.take(at), chans.take(at), *(pa.array([r[c] for r in out], pa.int64()) for c in (1, 2))], ["rec_id", "chan", "t0_us", "t1_us"])

    kinds = dict(signals.dtypes)
    return in_buffers(signals, blocks, 0, one, f"rec_id {kinds['rec_id']}, chan {kinds['chan']}, t0_us long, t1_us long")


def without_rhythm(marks: DataFrame, mask: DataFrame, width_us: int) -> DataFrame:
    """Marks outside the windows of a rhythm mask; an anti-join on time cells of width_us."""
    cells = mask.select("rec_id", "chan", "t0_us", "t1_us", F.explode(F.sequence(F.floor(F.col("t0_us") / width_us), F.floor((F.col("t1_us") - 1) / width_us))).alias("_cell"))
    m, c = marks.withColumn("_cell", F.floor(F.col("t_us") / width_us)).alias("m"), cells.alias("c")
    same = (F.col("m.rec_id") == F.col("c.rec_id")) & (F.col("m.chan") == F.col("c.chan")) & (F.col("m._cell") == F.col("c._cell"))
    return m.join(c, same & (F.col("m.t_us") >= F.col("c.t0_us")) & (F.col("m.t_us") < F.col("c.t1_us")), "left_anti").drop("_cell")


def per_channel(signals: DataFrame, fn, blocks: int, halo: int, rows: bool = False) -> DataFrame:
    """Signals with samples replaced by fn(samples, fs), a numpy helper such as a filter, median or decimation, and fs by what it gives beside.

    fn sees a buffer of blocks and `halo` blocks on either side, so block edges do not show; each block of the buffer
    itself then gets its share of the result. The rate may only change by a factor that divides a block's samples.
    With rows, fn takes many buffers of one length and rate at once, as the rows of a matrix.
    """

    def one(recs, chans, stretches):
        at, block, t0_us, rate, parts = [], [], [], [], []
        for places, x, fs in alike(stretches):
            done, after = fn(x, fs) if rows else (None, None)
            for n, i in enumerate(places):
                k, _, _, own, times, inner, ends, _ = stretches[i]
                y, to = (done[n], after) if rows else fn(x[n], fs)
                edges = np.concatenate(([0], ends * len(y) // max(x.shape[1], 1)))
                for b in np.flatnonzero(inner):
                    at.append(k)
                    block.append(own[b])
                    t0_us.append(times[b])
                    rate.append(to)
                    parts.append(np.asarray(y[edges[b] : edges[b + 1]], np.float32))
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        samples = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.float32)))
        at = pa.array(at, pa.int32())
        columns = [recs.take(at), chans.take(at), pa.array(block, kinds["block"]), pa.array(t0_us, kinds["t0_us"]), pa.array(rate, kinds["fs"]), samples.cast(kinds["samples"])]
        return pa.RecordBatch.from_arrays(columns, list(kinds))

    kept = signals.select("rec_id", "chan", "block", "t0_us", "fs", "samples")
    kinds = {f.name: f.type for f in to_arrow_schema(kept.schema)}
    return in_buffers(signals, blocks, halo, one, ", ".join(f"{c} {k}" for c, k in kept.dtypes))


def spectra(blocks: DataFrame, keys: list[str], fs: float, window: int, samples: str = "samples") -> DataFrame:
    """(keys, f, power): the one-sided power density of each row's samples, over half-overlapping Hann windows."""

    def one(batches):
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                f, p = dsp.density(np.asarray(getattr(row, samples), float), fs, window)
                out.append(pd.DataFrame({**{k: getattr(row, k) for k in keys}, "f": f, "power": p}))
            if out:
                yield pd.concat(out)[[*keys, "f", "power"]]

    kinds = dict(blocks.dtypes)
    return blocks.select(*keys, samples).mapInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", f double, power double")


def band_power(spectrum: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Per key the mean power in each band [low, high)."""
    return spectrum.groupBy(*keys).agg(*(F.avg(F.when((F.col("f") >= a) & (F.col("f") < b), F.col("power"))).alias(n) for n, (a, b) in bands.items()))


def relative_band(band: str, references: list[str]) -> Column:
    """The power in a band over the mean of those beside it; null where these have none."""
    beside = sum((F.col(r) for r in references), F.lit(0.0)) / len(references)
    return F.col(band) / F.when(beside > 0, beside)


def contamination(spectra: DataFrame, keys: list[str], band: tuple[float, float], references: list[tuple[float, float]], broad: tuple[float, float]) -> DataFrame:
    """(keys, contam, broad): how much more power a channel has ON than OFF, in doublings: in a band relative to the bands beside it, and over a broad band.

    spectra has keys, is_on, f, power, a row a window and frequency; windows of one condition are averaged first.
    """
    names = {"_band": band, "_broad": broad, **{f"_r{k}": r for k, r in enumerate(references)}}
    mean = spectra.groupBy(*keys, "is_on", "f").agg(F.avg("power").alias("power"))
    power = band_power(mean, [*keys, "is_on"], names).withColumn("_rel", relative_band("_band", [f"_r{k}" for k in range(len(references))]))
    side = lambda c, on: F.max(F.when(F.col("is_on") == on, F.col(c)))
    both = power.groupBy(*keys).agg(*(side(c, on).alias(f"{c}_{on}") for c in ("_rel", "_broad") for on in (True, False)))
    doublings = lambda c: F.log2(F.when(F.col(f"{c}_True") > 0, F.col(f"{c}_True")) / F.when(F.col(f"{c}_False") > 0, F.col(f"{c}_False")))
    return both.select(*keys, doublings("_rel").alias("contam"), doublings("_broad").alias("broad"))


def peaks(spectrum: DataFrame, keys: list[str], low: float, high: float, n: int = 4) -> DataFrame:
    """Per key the n highest powers between two frequencies."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("power"), "f"))
    return spectrum.where((F.col("f") >= low) & (F.col("f") < high)).withColumn("place", place).where(F.col("place") <= n)


def excerpts(signals: DataFrame, marks: DataFrame, pad: int, block_us: int, step_us: int) -> DataFrame:
    """(rec_id, chan, t_us, from_us, samples): the samples from pad before to pad after each mark, cut from the one or two blocks that they touch."""
    first = F.floor(F.col("t_us") / step_us) - pad
    wanted = marks.select("rec_id", "chan", "t_us", first.alias("_a"), (first + 2 * pad + 1).alias("_z"))
    per = block_us // step_us
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("_a") / per), F.floor((F.col("_z") - 1) / per))))
    found = wanted.join(signals.select("rec_id", "chan", "block", "samples"), ["rec_id", "chan", "block"])
    low, high = F.greatest(F.col("_a") - F.col("block") * per, F.lit(0)), F.least(F.col("_z") - F.col("block") * per, F.lit(per))
    part = F.slice("samples", (low + 1).cast("int"), (high - low).cast("int"))
    rows = found.select("rec_id", "chan", "t_us", "block", (F.col("block") * per + low).alias("_from"), part.alias("part"))
    return rows.groupBy("rec_id", "chan", "t_us").agg((F.min("_from") * step_us).alias("from_us"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"])).alias("samples"))


def event_average(cut: DataFrame, keys: list[str], pad: int, step_us: int) -> DataFrame:
    """(keys, offset, mean, n): the mean sample at each offset from the marks."""
    rows = cut.select(*keys, "t_us", "from_us", F.posexplode("samples").alias("i", "v"))
    offset = F.floor(F.col("from_us") / step_us) + F.col("i") - F.floor(F.col("t_us") / step_us)
    return rows.groupBy(*keys, offset.alias("offset")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def bipolar(signals: DataFrame, contacts: DataFrame) -> DataFrame:
    """(rec_id, shaft, name, block, samples): differences of neighbouring contacts of a shaft; contacts has rec_id, chan, shaft, contact, name."""
    placed = signals.join(contacts, ["rec_id", "chan"])
    a = placed.select("rec_id", "shaft", "contact", "block", F.col("name").alias("_a"), F.col("samples").alias("_x"))
    b = placed.select("rec_id", "shaft", (F.col("contact") - 1).alias("contact"), "block", F.col("name").alias("_b"), F.col("samples").alias("_y"))
    return a.join(b, ["rec_id", "shaft", "contact", "block"]).select("rec_id", "shaft", F.concat_ws("_", "_a", "_b").alias("name"), "block", F.zip_with("_x", "_y", lambda x, y: x - y).alias("samples"))
