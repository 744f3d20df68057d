"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import cut, packed, rows_as, unpacked, whole_row_key

WEIGHTS, REPEATS = (5, 2, 1), 3
#: Rows aimed at in one slice of a source or one range of finish times, and the most slices and ranges.
SLICE_ROWS, MOST_SLICES = 256, 65536
#: Ranges whose sums one task runs up.
BLOCK_RANGES = 512
KEY_BITS = 60


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, key): size in words that white space parts; key: a 60-bit hash of id and text that shuffles. With row_col, that too."""
    more = {row_col: row_col} if row_col else {}
    kept = rows_as(docs, doc_id=id_col, text=text_col, source=source_col, **more)
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("text", F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), key.alias("key"), *more)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row a source: rank (by code point, null last), weight, source_size, target, total, rows_in.

    A source stops at repeats times its own size, and what it leaves is shared by weight among the others until
    none is above. Sources in the order of cap / weight: a source is capped exactly if its cap is at most its share
    of what all earlier caps leave, so one pass over running sums finds the level.
    """
    every, order = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    big = lambda c: c.cast("decimal(38,0)")
    table = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows_in"))
    table = table.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    table = table.withColumn("cap", F.col("source_size") * repeats).withColumn("total", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    left, room = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    table = table.withColumn("capped", big(F.col("cap")) * big(room) <= big(left) * big(F.col("weight")))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    open_total = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    table = table.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * open_total.cast("double") / open_weight.cast("double")))
    return table.select("source", "rank", "weight", "source_size", "target", "total", "rows_in")


def _slices(rows: str) -> str:
    """The bits that number a source's slices: a power of two of slices with about SLICE_ROWS rows."""
    return f"cast(least(ceil(log2(greatest({rows} / {SLICE_ROWS}, 1))), log2({MOST_SLICES})) as int)"


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, times, finish) for every row.

    Each source's documents stand in a shuffled order that a hash of id and text fixes, repeats times over. A document's
    virtual finish time is the source's tokens so far, its own included, over the source's weight. All are sorted
    by finish time and taken while the running total stays within the total budget (the size of all documents).
    Running totals never gather a source: rows lie in slices of the hash, and finish times in ranges of equal
    width, whose sums are added up beforehand, so a source with a third of all rows is many small tasks.

    Null and empty texts have size 0, do not queue and take nothing; a null source is a source of its own, the last one;
    rows with equal doc_id and text are taken alike; extra columns are ignored; an empty table gives an empty result.
    """
    more = [row_col] if row_col else []
    rows = cut(sized(docs, id_col, text_col, source_col, row_col))
    by_source = cut(targets(rows, weights, repeats).withColumn("bits", F.expr(_slices("rows_in"))))
    placed = rows.join(F.broadcast(by_source) if by_source.count() <= 100_000 else by_source, rows["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
    nothing = [F.lit(0).cast("long").alias("taken"), F.lit(0).alias("times"), F.lit(0.0).alias("finish")]
    idle = placed.where("size = 0").select("doc_id", "source", "size", "source_size", "target", *nothing, *more)
    placed = placed.where("size > 0").withColumn("slice", F.expr(f"shiftright(key, {KEY_BITS} - bits)"))
    sums = placed.groupBy("rank", "slice").agg(F.sum("size").alias("sum"))
    sums = sums.select("rank", "slice", F.coalesce(F.sum("sum").over(W.partitionBy("rank").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("rank", "slice").orderBy("key", "doc_id", "size", *more).rowsBetween(W.unboundedPreceding, 0)
    queue = cut(placed.join(sums, ["rank", "slice"]).withColumn("done", F.col("before") + F.sum("size").over(inside)))

    top = queue.agg(F.count("*").alias("n"), F.max((F.lit(repeats) * F.col("source_size")) / F.col("weight")).alias("last"), F.max("total").alias("total")).first()
    if not top["n"] or not top["total"]:
        return idle
    level = queue.agg(F.max(F.col("target") / F.col("weight"))).first()[0]
    width = level / min(max(repeats * top["n"] // SLICE_ROWS, 1), MOST_SLICES // 4)
    finish = lambda turn: (turn * F.col("source_size") + F.col("done")).cast("double") / F.col("weight").cast("double")
    item = lambda turn: F.struct(finish(turn).alias("f"), F.col("rank").alias("r"), turn.cast("int").alias("e"), F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"))
    items = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select(item(F.col("turn")).alias("item")).withColumn("part", F.floor(F.col("item.f") / width))
    parts = items.groupBy("part").agg(F.sum("item.s").alias("sum"))
    # ranges stand in blocks: sums run inside a block, and over the blocks, of which there are few
    parts = parts.withColumn("block", F.floor(F.col("part") / BLOCK_RANGES))
    blocks = parts.groupBy("block").agg(F.sum("sum").alias("all"))
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inner = F.coalesce(F.sum("sum").over(W.partitionBy("block").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("inner", inner).join(blocks, "block").select("part", (F.col("earlier") + F.col("inner")).alias("before"))
    ranged = items.join(parts, "part").withColumn("sofar", F.col("before") + F.sum("item.s").over(W.partitionBy("part").orderBy("item").rowsBetween(W.unboundedPreceding, 0)))
    last = cut(ranged.where(F.col("sofar") <= top["total"]).agg(F.max("item").alias("last")))
    times = sum((F.when(item(F.lit(e)) <= F.col("last"), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    out = queue.crossJoin(F.broadcast(last)).withColumn("times", F.coalesce(times, F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times", finish(F.lit(0)).alias("finish"), *more).unionByName(idle)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, rows not taken left out; all columns are kept.

    Rows are told apart by all their columns; rows that agree in all share what is taken of them.
    """
    held = packed(docs, _row=whole_row_key(docs))
    keyed = docs.select(*(docs[how.get(f"{c}_col", c)].alias(c) for c in ("doc_id", "text", "source")), whole_row_key(docs).alias("row"))
    counts = mix(keyed, row_col="row", **{k: v for k, v in how.items() if k in ("weights", "repeats")}).where("times > 0 and size > 0").groupBy("row").agg(F.sum("times").cast("int").alias("_times"))
    out = held.dropDuplicates(["_row"]).join(counts, F.col("_row") == F.col("row"))
    return unpacked(out.withColumn("_turn", F.explode(F.sequence(F.lit(1), "_times"))), docs.columns)


ORACLE = f"""
with rows_ as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/' || coalesce(text, '')), 1, {KEY_BITS // 4}))::bigint as key from documents),
s0 as (select source, sum(size)::hugeint as source_size, (row_number() over (order by source nulls last) - 1) as rank from rows_ group by source),
s1 as (select *, case rank % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end::hugeint as weight, {REPEATS} * source_size as cap, sum(source_size) over () as total from s0),
s2 as (select *, sum(weight) over () as all_weight,
    coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as caps,
    coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as weights from s1),
s3 as (select *, cap * (all_weight - weights) <= (total - caps) * weight as capped from s2),
s4 as (select *, case when capped then cap::double else weight::double * (total - coalesce(sum(case when capped then cap end) over (), 0))::double / (sum(case when not capped then weight end) over ())::double end as target from s3),
queue as (select r.doc_id, r.size, r.key, s4.rank, s4.weight, s4.source_size, s4.target, s4.total,
    sum(r.size) over (partition by s4.rank order by r.key, r.doc_id, r.size rows unbounded preceding) as done
    from rows_ r join s4 on r.source is not distinct from s4.source),
items as (select doc_id, size, rank, key, e, total, (e * source_size + done)::double / weight::double as f from queue, (select unnest(range({REPEATS})) as e)),
line as (select *, sum(size) over (order by f, rank, e, key, doc_id, size rows unbounded preceding) as sofar from items),
took as (select doc_id, size, key, rank, sum(size) filter (where sofar <= total) as taken from line group by doc_id, size, key, rank)
select q.doc_id, q.size, q.source_size::bigint as source_size, q.target, coalesce(t.taken, 0)::bigint as taken
from queue q left join took t on q.doc_id is not distinct from t.doc_id and q.size = t.size and q.key = t.key and q.rank = t.rank
"""
