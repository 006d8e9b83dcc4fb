"""Scans along series of any length, in two levels: inside ranges of positions, and over one row for each range.

A window by series needs a task for each series. Here a window covers a range of ``rows`` positions; what a range
carries over (sums, the last or first value that is there) comes from a table with one row for each range, which is
joined back. Only that table has a window by series: it is ``rows`` times shorter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_index

#: Positions of a range.
RANGE = 1 << 20


def scanned(df: DataFrame, sums: dict[str, str] | None = None, before: dict[str, str] | None = None, after: dict[str, str] | None = None, by: tuple[str, ...] = ("series_id",), order: str = "t", rows: int = RANGE) -> DataFrame:
    """``df`` with new columns along ``order``, whole numbers without repeats in a series (from any start, gaps are allowed).

    ``sums``: new name -> column whose sum over the rows before it is taken (0 without any); ``before``: new name ->
    column whose last value up to the row that is not null; ``after``: the first one from the row on.
    """
    sums, before, after = sums or {}, before or {}, after or {}
    ranged = df.withColumn("_range", F.floor(F.col(order) / rows))
    local = Window.partitionBy(*by, "_range").orderBy(order)
    here = local.rowsBetween(Window.unboundedPreceding, -1)
    out = {n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()}
    out |= {n: F.last(c, True).over(local.rowsBetween(Window.unboundedPreceding, 0)) for n, c in before.items()}
    # backwards: Spark begins a frame that ends with the partition anew at each row
    back = Window.partitionBy(*by, "_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out |= {n: F.last(c, True).over(back) for n, c in after.items()}
    there = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    whole = [F.sum(c).alias(f"_c_{n}") for n, c in sums.items()] + [F.max_by(c, there(c)).alias(f"_c_{n}") for n, c in before.items()] + [F.min_by(c, there(c)).alias(f"_c_{n}") for n, c in after.items()]
    along = Window.partitionBy(*by).orderBy("_range")  # a row for each range
    past, coming = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (along, Window.partitionBy(*by).orderBy(F.desc("_range"))))
    carry = {n: F.sum(f"_c_{n}").over(past) for n in sums} | {n: F.last(f"_c_{n}", True).over(past) for n in before} | {n: F.last(f"_c_{n}", True).over(coming) for n in after}
    # null-safe names: a range of rows without a series joins, too
    carried = ranged.groupBy(*by, "_range").agg(*whole).select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_range").alias("_k_range"), *(v.alias(f"_c_{n}") for n, v in carry.items()))
    on = F.col("_range") == F.col("_k_range")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = ranged.withColumns(out).join(carried, on)
    ends = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(n, f"_c_{n}") for n in (*before, *after)}
    return joined.withColumns(ends).select(*df.columns, *ends)


def medians(df: DataFrame, value: str = "value", by: str = "series_id") -> DataFrame:
    """by, median: the exact median of the values that are there, from positions in sorted ranges; no group holds a series' values."""
    there = with_index(df.where(F.col(value).isNotNull()).select(by, value), by, value, name="_pos")
    size = there.groupBy(by).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    at = F.col("_pos") - F.col("_first")
    middle = there.join(size, by).where((at == F.floor((F.col("_n") - 1) / 2)) | (at == F.floor(F.col("_n") / 2)))
    return middle.groupBy(by).agg(F.avg(value).alias("median"))
