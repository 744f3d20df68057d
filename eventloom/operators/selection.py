"""Exact medians and other quantiles by distributed selection: no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a group's distinct values, found by an approximate sketch, and the coarse steps in which a value looks for its own.
COARSE, FINE = 16, 16
#: The sketch's relative accuracy is one in this many.
ACCURACY = 4096


def _same(keys: list[str], names: list[str]) -> Column:
    on = F.lit(True)
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return on


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys where nulls equal each other, with the keys once."""
    names = [f"_r_{i}" for i in range(len(keys))]
    rest = [c for c in right.columns if c not in keys]
    return left.join(right.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *rest), _same(keys, names), how).select(*left.columns, *rest)


def counted(rows: DataFrame, by: list[str], value: str | Column) -> DataFrame:
    """(by, value, n): how often a group has each value. What quantiles() and other sums start from, so that rows are read once."""
    return rows.groupBy(*by, (F.col(value) if isinstance(value, str) else value).alias("value")).agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, a column for each name in shares): exact quantiles, linear between neighbours, of values (by, value, n) that stand n times.

    A sketch of a group's distinct values gives the edges of COARSE * FINE buckets of about as many values each; sums
    over buckets tell which ones hold the ranks asked for; only those are sorted. So a task holds a bucket, whatever the
    group's size, and a value that stands very often is one row. Nulls are left out, as are groups of nulls only; without `by` there
    is always a row.
    """
    size = COARSE * FINE
    # the condition rests on n, which keeps it above the counting: every branch then reads the same shuffled counts
    held = counts.where(F.when(F.col("value").isNotNull(), F.col("n")) > 0).select(*by, "value", "n")
    edges = F.percentile_approx("value", [i / size for i in range(1, size)], ACCURACY)
    per = held.groupBy(*by).agg(edges.alias("_edges"), F.sum("n").alias("_total"))
    below = lambda line: F.size(F.filter(line, lambda e: e <= F.col("value")))
    steps = F.transform(F.sequence(F.lit(1), F.lit(COARSE - 1)), lambda i: F.element_at("_edges", i * FINE))
    placed = joined(held, per, by).withColumn("_step", below(steps))
    placed = placed.withColumn("_bucket", F.col("_step") * FINE + below(F.slice("_edges", F.col("_step") * FINE + 1, F.lit(FINE - 1)))).drop("_edges", "_step")
    ranks = {name: (F.col("_total") - 1) * F.lit(float(share)) for name, share in shares.items()}
    wanted = [r for rank in ranks.values() for r in (F.floor(rank), F.ceil(rank))]
    line = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = placed.groupBy(*by, "_bucket", "_total").agg(F.sum("n").alias("_in")).withColumn("_to", F.sum("_in").over(line)).withColumn("_from", F.col("_to") - F.col("_in"))
    holds = F.lit(False)
    for rank in wanted:
        holds = holds | ((rank >= F.col("_from")) & (rank < F.col("_to")))
    chosen = joined(placed, sums.where(holds).select(*by, "_bucket", "_from"), [*by, "_bucket"])
    inside = W.partitionBy(*by, "_bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = chosen.withColumn("_to", F.col("_from") + F.sum("n").over(inside)).withColumn("_at", F.col("_to") - F.col("n"))
    found = []
    for name, rank in ranks.items():
        low, high = (F.max(F.when((r >= F.col("_at")) & (r < F.col("_to")), F.col("value"))).cast("double") for r in (F.floor(rank), F.ceil(rank)))
        found += [low.alias(f"_low_{name}"), high.alias(f"_high_{name}"), F.max(rank - F.floor(rank)).alias(f"_part_{name}")]
    out = ranked.groupBy(*by).agg(*found)
    return out.select(*by, *((F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares))


def medians(rows: DataFrame, by: list[str], value: str | Column, name: str = "median") -> DataFrame:
    """(by, name): the exact median of each group's values; groups of nulls only have no row."""
    return quantiles(counted(rows, by, value), by, {name: 0.5})


def medians_of(rows: DataFrame, by: list[str], values: dict[str, Column], n: Column | None = None) -> DataFrame:
    """(by, a column for each of values): the exact medians of several values, in one selection; a row stands n times. Null where a group has none of a value."""
    listed = rows.select(*by, (F.lit(1) if n is None else n).alias("n"), F.explode(F.array(*(F.struct(F.lit(k).alias("_of"), v.cast("double").alias("value")) for k, v in values.items()))).alias("_v"))
    counts = listed.groupBy(*by, F.col("_v._of").alias("_of"), F.col("_v.value").alias("value")).agg(F.sum("n").alias("n"))
    found = quantiles(counts, [*by, "_of"], {"_middle": 0.5})
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_of") == k, F.col("_middle"))).alias(k) for k in values))
