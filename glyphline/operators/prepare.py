"""Preparation of series(series_id, t, value): gaps, normalization, blocks, collinear points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans

FILLS = ("ffill", "bfill", "mean", "median", "zero")


def number_rows(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """series_id, t (0-based in the order given), value; each series is ordered apart."""
    t = F.row_number().over(Window.partitionBy(series).orderBy(*order)) - 1
    return df.select(F.col(series).cast("long").alias("series_id"), t.cast("long").alias("t"), F.col(value).cast("double").alias("value"))


def fill_missing(series: DataFrame, method: str = "ffill", by: tuple[str, ...] = ("series_id",), range_rows: int | None = None) -> DataFrame:
    """Null and NaN replaced: the value before or after (else 0), the series' (or block's) mean or median (else 0), or 0.

    ``range_rows``: series are scanned by ranges of so many positions, for ones that are too long for a task; else by a window.
    """
    if method not in FILLS:
        raise ValueError(f"method must be one of {FILLS}")
    if range_rows is not None:
        return _fill_ranges(series, method, by, range_rows)
    v = F.when(~F.isnan("value"), F.col("value"))
    s = series.withColumn("value", v)
    by = Window.partitionBy(*by)
    if method == "ffill":
        other = F.last("value", True).over(by.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bfill":
        other = F.last("value", True).over(by.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0))  # backwards, in one turn
    elif method == "zero":
        other = F.lit(0.0)
    else:
        other = (F.avg if method == "mean" else F.median)("value").over(by)
    return s.withColumn("value", F.coalesce("value", other, F.lit(0.0)))


def _fill_ranges(series: DataFrame, method: str, by: tuple[str, ...], rows: int) -> DataFrame:
    s = series.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if method in ("ffill", "bfill"):
        side = {"before" if method == "ffill" else "after": {"_other": "value"}}
        s = scans.scanned(s, **side, by=by, rows=rows)
    elif method == "zero":
        s = s.withColumn("_other", F.lit(0.0))
    elif method == "mean":
        s = s.join(s.groupBy(*by).agg(F.avg("value").alias("_other")), list(by))
    else:
        key = F.struct(*by)
        m = scans.medians(s.select(key.alias("key"), "value"), by="key")
        s = s.withColumn("key", key).join(m.withColumnRenamed("median", "_other"), "key", "left").drop("key")
    return s.withColumn("value", F.coalesce("value", "_other", F.lit(0.0))).select(*series.columns)


def z_normalize(series: DataFrame, by: str = "series_id") -> DataFrame:
    """(value - mean) / population deviation over ``by`` (series_id: rows, t: columns); a deviation of 0 counts as 1."""
    stats = series.groupBy(by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    std = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return series.join(stats, by).withColumn("value", (F.col("value") - F.col("mean")) / std).select("series_id", "t", "value")


def denormalize(series: DataFrame, stats: DataFrame, by: str = "t", as_bytes: bool = False) -> DataFrame:
    """value * std + mean with stats(by, mean, std); ``as_bytes`` rounds half to even and wraps modulo 256."""
    value = F.col("value") * F.col("std") + F.col("mean")
    value = F.pmod(F.rint(value).cast("long"), F.lit(256)).cast("double") if as_bytes else value
    return series.join(stats, by).select("series_id", "t", value.alias("value"))


def split_interval(series: DataFrame, blocks: int) -> DataFrame:
    """block_id: contiguous blocks of n // blocks points, the last takes the rest; blocks of fewer than two points are dropped.

    t counts a series' points from 0. Only the lengths are grouped by series, so a long one needs no task of its own.
    """
    lengths = series.groupBy("series_id").agg(F.count("*").alias("_n"))
    m = F.least(F.lit(max(blocks, 1)), F.col("_n"))
    width = F.floor(F.col("_n") / m)
    s = series.join(lengths, "series_id").withColumn("block_id", F.least(F.floor(F.col("t") / width), m - 1).cast("int"))
    size = F.when(F.col("block_id") == m - 1, F.col("_n") - width * (m - 1)).otherwise(width)
    return s.where(size >= 2).select(*series.columns, "block_id")


def split_even(series: DataFrame, blocks: int) -> DataFrame:
    """block_id: blocks that differ by one point at most, the longer ones first."""
    return series.withColumn("block_id", (F.ntile(blocks).over(Window.partitionBy("series_id").orderBy("t")) - 1).cast("int"))


def drop_collinear(series: DataFrame, least: float = 1e-14) -> DataFrame:
    """Without interior points whose second difference is below ``least``."""
    w = Window.partitionBy("series_id").orderBy("t")
    second: Column = F.abs(F.lead("value").over(w) - 2 * F.col("value") + F.lag("value").over(w))
    return series.withColumn("_d", second).where(F.col("_d").isNull() | (F.col("_d") >= least)).drop("_d")


def fit_length(series: DataFrame, lengths: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Cut to lengths(by..., n), or padded with the last value."""
    last = series.groupBy(*by).agg(F.max("t").alias("end"), F.max_by("value", "t").alias("value")).join(lengths, list(by))
    more = last.where("end + 1 < n").select(*by, F.explode(F.sequence(F.col("end") + 1, F.col("n") - 1)).alias("t"), "value")
    return series.join(lengths, list(by)).where("t < n").select(*by, "t", "value").unionByName(more)
