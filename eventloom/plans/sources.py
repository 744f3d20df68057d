"""Queries that write tables of the model to the shared folder in each format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.scoring import violations
from eventloom.plans.fixtures import BASE, DAY, HOUR, Tables, days, scratch
from eventloom.plans.recordings import write_files
from eventloom.sources import edf
from eventloom.sources import runs as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function (tables -> DataFrame) as a query, with the SQL that follows the common tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return register


@query(""" select run_id, detector, '{"tol_ms": 50, "version": 1}' as provenance, count(*) as n, sum(t_us)::bigint as sum_t from det where run_id <> 2 group by all union all select run_id, detector, '{"tol_ms": 40, "version": 2}', count(*), sum(t_us)::bigint from det where run_id = 2 and detector = 'click' group by all""")
def s1_s2_runs(t):
    """Runs stored by partition with their settings; a second write replaces one run and leaves the others."""
    path = scratch(t, "runs")
    S.write_runs(t.detections, path, version=1, tol_ms=50)
    S.write_runs(t.detections.where("run_id = 2 and detector = 'click'"), path, version=2, tol_ms=40)
    return S.read_runs(t.spark, path).groupBy(F.col("run_id").cast("long").alias("run_id"), "detector", "provenance").agg(F.count("*").alias("n"), F.sum("t_us").alias("sum_t"))


@query(f" select run_id, detector, count(*) as n from det where run_id not in (select run_id from det where run_id % 2 = 0 and t_us >= {25 * DAY}) and run_id <> 3 group by all")
def s2_checked_runs(t):
    """Runs stored only if their invariants hold: even runs are said to last 25 days, and run 3 lacks some channels."""
    total = F.when(F.col("run_id") % 2 == 0, 25 * DAY).otherwise(30 * DAY).cast("long")
    runs = t.spans.select("run_id", total.alias("total_us"), F.lit(0).cast("long").alias("on_us"), total.alias("off_us"))
    known = t.channels.where("run_id <> 3 or chan % 10 <> 3")
    clean = t.channels.select("run_id", "chan", F.lit(DAY).cast("long").alias("clean_us"))
    broken = violations(runs, t.detections, t.on.where("t1_us < 0"), clean, known, DAY)
    path = scratch(t, "checked")
    S.write_checked_runs(t.detections, path, broken, skip=True)
    return S.read_runs(t.spark, path).groupBy(F.col("run_id").cast("long").alias("run_id"), "detector").agg(F.count("*").alias("n"))


@query(" select run_id::varchar as subject, count(*) as n, sum(t_us)::bigint as sum_t, sum(2 - (chan % 3 = 0)::int)::bigint as contacts from truth where run_id <> 4 group by 1")
def s3_expert_tables(t):
    """Expert marks written as tab-separated files and read back; subjects without a recording file go."""
    chans = F.when(F.col("chan") % 3 == 0, F.concat(F.lit("A_"), "chan")).otherwise(F.concat(F.lit("A_"), "chan", F.lit("  A_x")))
    marks = t.truth.select(F.col("run_id").cast("string").alias("subject"), (F.col("t_us") / 1e6).cast("decimal(20,6)").cast("string").alias("time_in_sec"), F.lit("mark").alias("annotation"), chans.alias("chans"))
    path = scratch(t, "marks")
    marks.withColumn("folder", F.concat(F.lit("sub-"), "subject")).drop("subject").write.partitionBy("folder").option("sep", "\t").option("header", True).csv(path)
    rows = S.read_tsv(t.spark, path)
    whole = S.complete_subjects(t.spans.where("run_id <> 4").select(F.col("run_id").cast("string").alias("subject")), rows)
    found = S.expert_marks(rows.join(whole, "subject", "left_semi"))
    return found.groupBy("subject").agg(F.count("*").alias("n"), F.sum("t_us").alias("sum_t"), F.sum(F.size("chans")).alias("contacts"))


@query(" select run_id::varchar as patient, name from channels where is_ez and run_id <> 1 union all select run_id::varchar, null from spans where run_id = 1 or run_id not in (select run_id from channels where is_ez)")
def s4_onset_lists(t):
    """Onset lists as JSON; a patient with a null or empty list keeps one row."""
    path = scratch(t, "onset")
    lists = t.channels.groupBy(F.col("run_id").cast("string").alias("patient")).agg(F.array_sort(F.collect_list(F.when(F.col("is_ez"), F.col("name")))).alias("EZ"))
    lists.withColumn("EZ", F.when(F.col("patient") != "1", F.col("EZ"))).write.json(path)
    return S.read_onset(t.spark, path, lines=True)


def _recorded(t):
    """Hourly counts of ten channels each, stored as recording files of a day a record; their folder."""
    counts = t.events.groupBy("chan", F.floor(F.col("t_us") / HOUR).alias("hour")).agg(F.count("*").cast("int").alias("v"))
    chans = days(counts, ["chan"], F.lit(0)).withColumn("rec", F.floor(F.col("chan") / 10))
    whole = chans.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("chan", "days"))).alias("chans"))
    names = F.transform("chans", lambda c: F.concat(F.lit("A_"), c["chan"].cast("string")))
    by_day = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda b: F.transform("chans", lambda c: c["days"][b]))
    files = whole.select(F.concat(F.lit("rec"), "rec").alias("rec_id"), names.alias("names"), by_day.alias("records"))
    path = scratch(t, "recordings")
    write_files(files, path, 24).write.format("noop").mode("overwrite").save()
    return path


def _totals(found):
    total = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return found.select("rec_id", "name", "block", "t0_us", "fs", F.round(total, 3).alias("total"))


_STORED = f", n as (select chan // 10 as rec, chan, t_us // {DAY} as block, count(*) as n from ev group by all), c as (select rec, chan, row_number() over (partition by rec order by chan) - 1 as place from (select distinct chan // 10 as rec, chan from ev)), g as (select c.rec, c.chan, c.place, b::bigint as block from c, range(30) r(b)) select 'rec' || g.rec as rec_id, 'A_' || g.chan as name, g.block, (g.block * 1000000)::bigint as t0_us, 24.0::double as fs, round(coalesce(n.n, 0) * 0.1, 3) as total from g left join n using (rec, chan, block)"


@query(_STORED)
def s9_recordings(t):
    """The recording files read back through the data source."""
    return _totals(edf.read(t.spark, _recorded(t), records=7))


@query(_STORED + " where place in (3, 7) and g.block between 6 and 20")
def s9_some_records(t):
    """Two channels and two weeks of every recording: only their bytes are read."""
    found = edf.read(t.spark, _recorded(t), records=7, gap=0)
    return _totals(found.where("chan in (3, 7) and block >= 6 and block < 21"))
