"""Matching event trains one-to-one within a tolerance, and what is counted from the pairs."""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.selection import counted, joined, quantiles


def pair_off(rows, n_keys: int, tol):
    """(row, partner's time or None) for rows (keys..., time, ..., side) sorted by keys and time.

    What waits is one side's unmatched events within reach, oldest first. An event of the other side takes the
    oldest; otherwise it waits itself. That pairs as a walk over both trains does that steps on both on a hit.
    """
    waiting: deque = deque()
    group = None
    for row in rows:
        if row[:n_keys] != group:
            yield from ((w, None) for w in waiting)
            waiting.clear()
            group = row[:n_keys]
        while waiting and row[n_keys] - waiting[0][n_keys] > tol:
            yield waiting.popleft(), None
        if waiting and waiting[0][-1] != row[-1]:
            other = waiting.popleft()
            yield other, row[n_keys]
            yield row, other[n_keys]
        else:
            waiting.append(row)
    yield from ((w, None) for w in waiting)


#: Tolerances in one time slice: what a window of one busy train sorts at once.
SLICE_TOLERANCES = 256


def islands(rows: DataFrame, keys: list[str], tol, time: str = "t_us") -> DataFrame:
    """rows with `island`: the first time of the run of events, each at most tol after the one before, that a row is in.

    A train is cut into time slices of many tolerances, so that a busy one is many small sorts. Inside a slice a row's
    island starts at the last gap before it; a slice without a gap before the row takes what the slices before it, one
    row each, have last.
    """
    width = SLICE_TOLERANCES * max(tol, 1)
    # the condition stands here because the join below infers it for one of the two uses alone
    sliced = rows.withColumn("_slice", F.floor(F.col(time) / width)).where("_slice is not null")
    inside = W.partitionBy(*keys, "_slice").orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(inside) > tol, F.col(time))
    begun = sliced.withColumn("_new", new)
    # the last event with all its columns: so both uses of the slices want the same columns, and share one shuffle
    rest = [c for c in rows.columns if c not in (*keys, time)]
    per = begun.groupBy(*keys, "_slice").agg(F.min(time).alias("_first"), F.max(F.struct(time, *rest)).alias("_end"), F.max("_new").alias("_latest"))
    per = per.withColumn("_last", F.col("_end").getField(time)).drop("_end")
    line = W.partitionBy(*keys).orderBy("_slice")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(line) > tol, F.lit(True))
    per = per.withColumn("_begins", F.when(fresh, F.col("_first"))).withColumn("_own", F.coalesce("_latest", "_begins"))
    held = F.last("_own", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1))
    per = per.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), F.coalesce("_begins", held).alias("_held"))
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = begun.withColumn("_run", F.last("_new", ignorenulls=True).over(inside)).join(per, same)
    return out.select(*rows.columns, F.coalesce("_run", "_held").alias("island"))


def match(a: DataFrame, b: DataFrame, keys: list[str], tol, time: str = "t_us", carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, time, carry, side, partner): every event of a (side 0) and b (side 1) with its partner's time, or null.

    Pairs are one-to-one within |a - b| <= tol and greedy in time. carry names columns of both inputs to keep. No pair
    crosses a gap of more than tol, so trains fall into islands, which are dealt out by their starts: a busy train is
    spread over tasks. Islands of one side have no pairs, those of one event a side have one; only the others are walked
    in their tasks, as a stream that holds the events within one tolerance. Events with a null time go. Among equal events
    those that come first by carry are paired first.
    """
    cols = [*keys, time, *carry]
    both = a.select(*cols, F.lit(0).alias("side")).unionByName(b.select(*cols, F.lit(1).alias("side"))).where(F.col(time).isNotNull())
    kinds = dict(both.dtypes)
    order = [time, "side", *carry]
    whole = W.partitionBy(*keys, "island").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # a number of its own: rows are short and the walk is long, so partitions are not to be put together by their bytes
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = islands(both, keys, tol, time).repartition(parts, *keys, "island").withColumn("_n", F.count("*").over(whole)).withColumn("_b", F.sum("side").over(whole)).withColumn("_both", F.sum(time).over(whole))
    one_sided, lone = (F.col("_b") == 0) | (F.col("_b") == F.col("_n")), (F.col("_b") == 1) & (F.col("_n") == 2)
    partner = F.when(lone, F.col("_both") - F.col(time)).cast(kinds[time])
    placed = counted.select(*keys, "island", *order, (one_sided | lone).alias("_easy"), partner.alias("partner"))
    ordered = placed.sortWithinPartitions(*keys, "island", *order)
    n, names, kept = len(keys) + 1, [*keys, "island", time, "side", *carry], [*keys, time, *carry, "side", "partner"]
    walked = [*range(n), n, *range(n + 2, n + 2 + len(carry)), n + 1]

    def walk(batches):
        easy, kinds = [], []

        def rows():
            for batch in batches:
                kinds[:] = [batch.schema.field(i).type for i in walked]
                mask = batch.column(batch.num_columns - 2)
                easy.append(batch.filter(mask))
                hard = batch.filter(pc.invert(mask))
                yield from zip(*(hard.column(i).to_pylist() for i in walked))

        def packed(done):
            arrays = [pa.array([r[k] for r, _ in done], kind) for k, kind in enumerate(kinds)]
            found = dict(zip([*keys, "island", time, *carry, "side"], arrays)) | {"partner": pa.array([p for _, p in done], kinds[n])}
            return pa.RecordBatch.from_arrays([found[c] for c in kept], kept)

        def plain():
            while easy:
                batch = easy.pop(0)
                at = {c: i for i, c in enumerate([*names, "_easy", "partner"])}
                yield pa.RecordBatch.from_arrays([batch.column(at[c]) for c in kept], kept)

        done = []
        for found in pair_off(rows(), n, tol):
            done.append(found)
            if len(done) == 10_000:
                yield packed(done)
                done = []
                yield from plain()
        if done:
            yield packed(done)
        yield from plain()

    schema = ", ".join(f"`{c}` {kinds.get(c, kinds[time])}" for c in kept)
    return ordered.mapInArrow(walk, schema)


def pair_off_points(rows, n_keys: int, tol):
    """(row, partners' times or None, one a point) for rows (keys..., time, side, lo, hi) sorted by keys and time.

    A row takes part in the points lo to hi - 1; each point has its own queue, which pairs as pair_off does. What is out
    of reach is settled at all points, so one line of the events within one tolerance holds all that waits.
    """
    queues: dict = defaultdict(deque)
    line: deque = deque()
    group = None
    for row in rows:
        if row[:n_keys] != group:
            yield from line
            line.clear()
            queues.clear()
            group = row[:n_keys]
        now, side, lo, hi = row[n_keys:]
        while line and now - line[0][0][n_keys] > tol:
            yield line.popleft()
        event = (row, [None] * (hi - lo))
        line.append(event)
        for point in range(lo, hi):
            queue = queues[point]
            while queue and now - queue[0][0][n_keys] > tol:
                queue.popleft()
            if queue and queue[0][0][n_keys + 1] != side:
                other, partners = queue.popleft()
                partners[point - other[n_keys + 2]] = now
                event[1][point - lo] = other[n_keys]
            else:
                queue.append(event)
    yield from line


def match_points(a: DataFrame, b: DataFrame, keys: list[str], tol, points: int, time: str = "t_us") -> DataFrame:
    """(keys, time, side, lo, partners): events of a (side 0) matched with those of b (side 1) at every point of a sweep, in one walk.

    b has columns lo and hi: an event is there at the points lo to hi - 1 (a threshold's sweep is such a range); a is there
    at all points, 0 to points - 1. partners has the partner's time, or null, of each of an event's points, from lo on. Pairs
    are those of match() at each point by itself, but every event is shuffled as one row, whatever the number of
    points. Events with a null time or without a point go. Islands are those of all events together.
    """
    kinds = dict(a.dtypes)
    sides = [a.select(*keys, time, F.lit(0).alias("side"), F.lit(0).alias("lo"), F.lit(points).alias("hi")), b.select(*keys, time, F.lit(1).alias("side"), F.col("lo").cast("int"), F.col("hi").cast("int"))]
    both = sides[0].unionByName(sides[1]).where(F.col(time).isNotNull() & (F.col("lo") < F.col("hi")))
    names = [*keys, "island", time, "side", "lo", "hi"]
    # a number of its own: rows are short and the walk is long, so partitions are not to be put together by their bytes
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = islands(both, keys, tol, time).select(*names).repartition(parts, *keys, "island").sortWithinPartitions(*names[:-2])
    n = len(keys) + 1

    def walk(batches):
        types = []

        def rows():
            for batch in batches:
                types[:] = [field.type for field in batch.schema]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def packed(done):
            kept = [i for i in range(n + 3) if i != n - 1]
            arrays = [pa.array([row[i] for row, _ in done], types[i]) for i in kept]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([p for _, p in done], pa.list_(types[n]))], [*(names[i] for i in kept), "partners"])

        done = []
        for found in pair_off_points(rows(), n, tol):
            done.append(found)
            if len(done) == 10_000:
                yield packed(done)
                done = []
        if done:
            yield packed(done)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, time]) + f", side int, lo int, partners array<{kinds[time]}>"
    return ordered.mapInArrow(walk, schema)


def sweep_counts(truth: DataFrame, detections: DataFrame, groups: list[str], values: list, keys: list[str], tol: int, by: list[str]) -> DataFrame:
    """(by, detector, value, tp, n_true, n_det): detections (detector, keys, t_us, score) of at least each value, matched with truth.

    by is among keys. All detectors and values are points of one walk, so truth and detections are shuffled as one row each; detectors
    that are not in groups, and null scores, are left out. Where there are events of neither side there is no row.
    """
    steps = sorted(set(values))
    names, bounds = F.array(*map(F.lit, groups)), F.array(*map(F.lit, steps))
    first = (F.array_position(names, F.col("detector")) - 1) * len(steps)
    rows = detections.select(*keys, "t_us", first.alias("lo"), (first + F.size(F.filter(bounds, lambda v: v <= F.col("score")))).alias("hi")).where("lo >= 0")
    found = match_points(truth, rows, keys, tol, len(groups) * len(steps))
    every = found.select(*by, "side", "lo", F.posexplode("partners").alias("_at", "_partner"))
    is_true, hit = F.col("side") == 0, F.col("_partner").isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    per = every.groupBy(*by, (F.col("lo") + F.col("_at")).alias("_point")).agg(count(is_true & hit).alias("tp"), count(is_true).alias("n_true"), count(~is_true).alias("n_det"))
    at = lambda line, i: F.element_at(line, (i + 1).cast("int"))
    return per.select(*by, at(names, F.floor(F.col("_point") / len(steps))).alias("detector"), at(bounds, F.col("_point") % len(steps)).alias("value"), "tp", "n_true", "n_det")


def detector_pairs(detections: DataFrame, detectors: list[str], keys: list[str] = ["run_id", "chan"]) -> tuple[DataFrame, DataFrame]:
    """Both sides of every unordered pair of detectors, labelled det_a and det_b; each event is copied to the pairs it is in."""
    pairs = F.array(*(F.struct(F.lit(a).alias("det_a"), F.lit(b).alias("det_b")) for i, a in enumerate(sorted(detectors)) for b in sorted(detectors)[i + 1 :]))
    rows = detections.select("detector", *keys, "t_us", F.explode(pairs).alias("p")).select("detector", *keys, "t_us", "p.*")
    return rows.where("detector = det_a").drop("detector"), rows.where("detector = det_b").drop("detector")


def agreement(detections: DataFrame, detectors: list[str], tol: int, by: list[str] = []) -> DataFrame:
    """Per pair of detectors (and `by`): events of each, pairs, Jaccard index, median |dt| in ms, and what only one found."""
    keys = ["det_a", "det_b", "run_id", "chan"]
    found = match(*detector_pairs(detections, detectors), keys, tol)
    group = ["det_a", "det_b", *by]
    counts = counted(found, [*group, "side"], F.abs(F.col("t_us") - F.col("partner")))
    n_a, n_b, m = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in (F.col("side") == 0, F.col("side") == 1, (F.col("side") == 0) & F.col("value").isNotNull()))
    # a pair stands once on either side: both sides' distances have the median of one
    out = joined(counts.groupBy(*group).agg(n_a.alias("n_a"), n_b.alias("n_b"), m.alias("matched")), quantiles(counts, group, {"_dt": 0.5}), group, "left")
    union = F.col("n_a") + F.col("n_b") - F.col("matched")
    return out.select(
        "det_a", "det_b", *by, "n_a", "n_b", "matched", (F.col("matched") / F.when(union > 0, union)).alias("jaccard"), (F.col("_dt") / 1000).alias("median_dt_ms"),
        (F.col("n_a") - F.col("matched")).alias("a_only"), (F.col("n_b") - F.col("matched")).alias("b_only"),
    )


def near_any(events: DataFrame, others: DataFrame, keys: list[str], tol: int) -> DataFrame:
    """Events with `near`: whether any of the others has the same keys and lies within tol; one other may serve many events.

    Last other before and first after, each from a running value over a sorted window, instead of a range join. Windows
    run over time slices, to which the others within tol are copied, so a busy train is many small sorts.
    """
    width = SLICE_TOLERANCES * max(tol, 1)
    cols = [c for c in events.columns if c not in (*keys, "t_us")]
    slice_of = lambda t: F.floor(t / width)
    kept = events.select(*keys, "t_us", F.struct(*cols).alias("_row") if cols else F.lit(1).alias("_row"), F.lit(None).cast("long").alias("_o"), slice_of(F.col("t_us")).alias("_slice"))
    reach = F.sequence(slice_of(F.col("t_us") - tol), slice_of(F.col("t_us") + tol))
    marks = others.select(*keys, "t_us", F.lit(None).cast(dict(kept.dtypes)["_row"]).alias("_row"), F.col("t_us").alias("_o"), F.explode(reach).alias("_slice"))
    part = W.partitionBy(*keys, "_slice")
    so_far = lambda order: F.last("_o", ignorenulls=True).over(part.orderBy(order).rangeBetween(W.unboundedPreceding, 0))
    before, after = so_far(F.asc("t_us")), so_far(F.desc("t_us"))
    near = F.coalesce(F.col("t_us") - before <= tol, F.lit(False)) | F.coalesce(after - F.col("t_us") <= tol, F.lit(False))
    out = kept.unionByName(marks).withColumn("near", near).where("_row is not null")
    return out.select(*keys, "t_us", *([F.col(f"_row.{c}") for c in cols]), "near")


def run_delta(before: DataFrame, after: DataFrame, others_before: DataFrame, others_after: DataFrame, keys: list[str], tol: int, near_tol: int | None = None) -> DataFrame:
    """Per (keys less chan), what a changed detector added and removed, how many, and the share with another detector's event near, looked up in the run the event is from."""
    reach = tol if near_tol is None else near_tol
    found = match(before, after, keys, tol).where("partner is null")
    removed = near_any(found.where("side = 0").drop("partner", "side"), others_before, keys, reach).withColumn("change", F.lit("removed"))
    added = near_any(found.where("side = 1").drop("partner", "side"), others_after, keys, reach).withColumn("change", F.lit("added"))
    return removed.unionByName(added).groupBy("run_id", "change").agg(F.count("*").alias("n"), F.avg(F.col("near").cast("double")).alias("corroborated"))


def classified(a: DataFrame, b: DataFrame, others: list[DataFrame], keys: list[str], tol: int) -> DataFrame:
    """Events of a with lost (no partner in b) and corroborated (a one-to-one partner in any of the others).

    All are matched in one call, under a label; events of a at one time are told apart by a number, and the first of
    them are paired first with each.
    """
    many = a.groupBy(*keys, "t_us").agg(F.count("*").cast("int").alias("_many"))
    numbered = many.select(*keys, "t_us", F.explode(F.sequence(F.lit(1), F.col("_many"))).alias("_number"))
    left = numbered.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(len(others)))))
    right = b.select(*keys, "t_us", F.lit(0).alias("_number"), F.lit(0).alias("_with"))
    for k, other in enumerate(others):
        right = right.unionByName(other.select(*keys, "t_us", F.lit(0).alias("_number"), F.lit(k + 1).alias("_with")))
    found = match(left, right, ["_with", *keys], tol, carry=("_number",)).where("side = 0")
    lost, hit = F.max(F.when(F.col("_with") == 0, F.col("partner").isNull())), F.max(F.when(F.col("_with") > 0, F.col("partner").isNotNull()))
    return found.groupBy(*keys, "t_us", "_number").agg(lost.alias("lost"), F.coalesce(hit, F.lit(False)).alias("corroborated")).drop("_number")


def resolve_contacts(marks: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks on known contacts, unknown contacts) of expert marks (subject, t_us, annotation, chans).

    Unknown contacts are dropped from their marks, which stay, with an empty list if need be. A strict caller has
    require_none() raise on the second table.
    """
    listed = marks.select("subject", "t_us", "annotation", F.posexplode_outer("chans").alias("_at", "name"))
    known = listed.join(channels.select("subject", "name", F.lit(1).alias("_known")), ["subject", "name"], "left")
    unknown = known.where("name is not null and _known is null").select("subject", "name").distinct()
    kept = known.groupBy("subject", "t_us", "annotation").agg(F.array_sort(F.collect_list(F.when(F.col("_known") == 1, F.struct("_at", "name")))).alias("_l"))
    return kept.select("subject", "t_us", "annotation", F.transform("_l", lambda x: x["name"]).alias("chans")), unknown


def truth_per_channel(marks: DataFrame, channels: DataFrame) -> DataFrame:
    """(subject, name, t_us): one row a mark and contact; channels without marks stay with a null time."""
    rows = marks.select("subject", "t_us", F.explode("chans").alias("name"))
    return channels.select("subject", "name").join(rows, ["subject", "name"], "left")


def order_violations(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Positions whose channel names differ between two lists (run_id, chan, name), or that one lacks."""
    a, b = ours.select("run_id", "chan", F.col("name").alias("ours")), theirs.select("run_id", "chan", F.col("name").alias("theirs"))
    return a.join(b, ["run_id", "chan"], "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs")))


def in_scopes(rows: DataFrame, ez: DataFrame, keys: list[str]) -> DataFrame:
    """Rows under scope all, and those on seizure-onset contacts under scope ez as well."""
    return rows.withColumn("scope", F.lit("all")).unionByName(rows.join(ez.select(*keys), keys, "left_semi").withColumn("scope", F.lit("ez")))


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not present."""
    return wanted.select(*keys).join(present.select(*keys), keys, "left_anti").distinct()


def require_none(violations: DataFrame, what: str) -> None:
    """Raise, naming the first rows, if there are any."""
    rows = violations.limit(10).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def both_measurable(on: DataFrame, off: DataFrame, keys: list[str]) -> DataFrame:
    """Channels measured in both conditions: (keys, on_rate, off_rate, on_n, off_n)."""
    side = lambda df, name: df.where("rate is not null").select(*keys, F.col("rate").alias(f"{name}_rate"), F.col("n").alias(f"{name}_n"))
    return side(on, "on").join(side(off, "off"), keys)


def sweep_against(moved: DataFrame, fixed: DataFrame, values: list, keys: list[str], tol: int) -> DataFrame:
    """Per value of a moved threshold: events of moved (detector, keys, t_us, score) that reach it, pairs with the fixed detector, Jaccard, and whether the count never moves.

    All values are matched in one walk. A value that no event reaches has no row.
    """
    detector = moved.select("detector").distinct().limit(2).collect()
    if len(detector) > 1:
        raise ValueError("a sweep moves one detector")
    counts = sweep_counts(fixed, moved, [r[0] for r in detector] or [""], values, keys, tol, [keys[0]])
    out = counts.groupBy("value").agg(F.sum("n_det").alias("n"), F.sum("tp").alias("matched"), F.sum("n_true").alias("_fixed")).where("n > 0")
    every = W.partitionBy()
    out = out.select("value", "n", "matched", (F.col("matched") / (F.col("n") + F.col("_fixed") - F.col("matched"))).alias("jaccard"))
    return out.withColumn("constant", F.min("n").over(every) == F.max("n").over(every))
