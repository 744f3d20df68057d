"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_label(label: Column) -> Column:
    """A contact label without outer blanks, apostrophes and hyphens turned to underscores."""
    return F.translate(F.trim(label), "'’-", "___")


def shaft(name: Column) -> Column:
    """The first letter of the letters that lead a name once underscores are gone; ? if there are none."""
    lead = F.regexp_extract(F.translate(name, "_", ""), "^([A-Za-z])", 1)
    return F.when((lead == "") | lead.isNull(), "?").otherwise(lead)


def to_samples(seconds: Column, fs: float) -> Column:
    """Seconds to sample index, halves to the even one."""
    return F.bround(seconds * fs).cast("long")


def half_away(x: Column) -> Column:
    """Rounded to a whole number, halves away from zero."""
    return F.round(x).cast("long")


def log_effect(on: Column, off: Column, off_count: Column, least: int = 3) -> Column:
    """log2 of an ON/OFF rate ratio; null with fewer than `least` OFF events, or where either rate is zero."""
    return F.when((off_count >= least) & (on > 0) & (off > 0), F.log2(on / off))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n, within [0, 1]; null for n = 0."""
    p, nn = k / n, n.cast("double")
    middle, half = (p + z * z / (2 * nn)) / (1 + z * z / nn), z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return a.cast("double") / F.when(b != 0, b)


def measured_rate(n: Column, clean: Column, total: Column, least: float = 0.2) -> Column:
    """Events a second of analysable time; null unless that is at least the given share of all time."""
    return F.when((clean > 0) & (clean >= least * total), n.cast("double") / clean)


def poisson_floor(rate: Column, width: float) -> Column:
    """The relative error of a count in a bin that chance alone gives: 1 / sqrt(rate * width)."""
    return F.when(rate > 0, 1 / F.sqrt(rate * width))
