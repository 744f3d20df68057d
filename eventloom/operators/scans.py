"""Running values over long trains in two levels: inside slices, then over the slices' totals.

A window over a whole train is one sort in one task. Here a train is cut into slices, each a small window; what a slice
hands over (a sum, the greatest or the last value so far) is one row, and a window over these rows gives every slice
what all slices before it amount to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Time of one slice where a caller does not know better, in microseconds.
SLICE_US = 3_600_000_000


def sliced(rows: DataFrame, at: str, width) -> DataFrame:
    """rows with `_slice`; rows without a place go."""
    return rows.withColumn("_slice", F.floor(F.col(at) / width)).where("_slice is not null")


def running(rows: DataFrame, keys: list[str], order: list[str], width, values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """rows with a column for each name in values: a kind (sum, max, min or last) and a column to run over, null values left out.

    Runs go along `order`, whose first column is a number that slices of `width` cut; rows equal in all of order come in any
    order. With before, a row's own value is not counted. Keys equal each other where they are null.
    """
    placed = sliced(rows, order[0], width)
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    frame = inside.rowsBetween(W.unboundedPreceding, -1 if before else 0)
    over = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    held = placed
    for name, (_, c) in values.items():
        held = held.withColumn(f"_v_{name}", c)
    # the last row with all its columns: so both uses of the slices want the same columns, and share one shuffle
    rest = [c for c in held.columns if c not in (*keys, "_slice", *order)]
    last = F.max(F.struct(*order, *rest))
    totals = held.groupBy(*keys, "_slice").agg(last.alias("_end"), *(_whole(kind, f"_v_{n}", order).alias(f"_t_{n}") for n, (kind, _) in values.items())).where("_end is not null")
    line = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    prior = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), *(over[kind](f"_t_{n}").over(line).alias(f"_p_{n}") for n, (kind, _) in values.items()))
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = held.select("*", *(over[kind](f"_v_{n}").over(frame).alias(f"_i_{n}") for n, (kind, _) in values.items())).join(prior, same)
    return out.select(*rows.columns, *(_joined(kind, F.col(f"_p_{n}"), F.col(f"_i_{n}")).alias(n) for n, (kind, _) in values.items()))


def _whole(kind: str, name: str, order: list[str]) -> Column:
    """A slice's total."""
    if kind == "last":
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](name)


def _joined(kind: str, prior: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.when(prior.isNotNull() | inside.isNotNull(), F.coalesce(prior, F.lit(0)) + F.coalesce(inside, F.lit(0)))
    if kind == "last":
        return F.coalesce(inside, prior)
    return (F.greatest if kind == "max" else F.least)(prior, inside)


def previous(rows: DataFrame, keys: list[str], at: str, width, name: str = "previous") -> DataFrame:
    """rows with the place of the row before in the same train; null for the first."""
    return running(rows, keys, [at], width, {name: ("last", F.col(at))}, before=True)


def neighbourhoods(rows: DataFrame, keys: list[str], at: str, before: int, after: int, size: int) -> DataFrame:
    """rows with `_slice` and `_home`: slices of `size` places `at`, each with copies of the rows up to `before` places ahead of it and `after` behind it; _home tells its own rows. Windows that reach no further may run in a slice."""
    own = F.floor(F.col(at) / size)
    reach = F.sequence(F.floor((F.col(at) - after) / size), F.floor((F.col(at) + before) / size))
    return rows.withColumn("_slice", F.explode(reach)).withColumn("_home", F.col("_slice") == own)
