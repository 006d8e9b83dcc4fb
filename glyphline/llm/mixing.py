"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, named

#: Rates of up to so many bytes are broadcast to the documents; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Digits of md5 that make the uniform number: 13 hex digits are 52 bits, exact in a double.
_DIGITS = 13


def uniform(seed: int, *columns: str):
    """A number in [0, 1) from the md5 of seed and columns; the same wherever and whenever it runs."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def log_factorial(k: Column) -> Column:
    """log k!, from a table up to 20 and by Stirling's series beyond, exact to a double there."""
    x = k.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(k <= 20, F.get(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(21))), k.cast("int"))).otherwise(series)


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", temperature: float = 0.5, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n_docs, n_chars, rate, first, cdf): the mean repetition rate that brings each source to its target.

    Target shares of characters are ``weights`` (scaled to sum 1; a source not named gets none), else
    proportional to chars ** temperature; the total stays what it was. ``cdf`` are the cumulated
    Poisson probabilities of first, first + 1, ...: twelve standard deviations and some more on both sides of the rate,
    beyond which a double doesn't tell them from 0 and 1. A null source is a source; one without characters has rate 0.
    """
    stats = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"), F.sum(F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")).alias("n_chars"))
    if weights:
        named = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.coalesce("source", F.lit(""))], F.lit(0.0))
    else:
        named = F.pow(F.col("n_chars").cast("double"), F.lit(float(temperature)))
    stats = stats.withColumn("w", named)
    total = stats.agg(F.sum("w").alias("sum_w"), F.sum("n_chars").alias("sum_chars"))  # one row
    rate = F.coalesce(F.try_divide(F.try_divide("w", "sum_w") * F.col("sum_chars"), F.col("n_chars")), F.lit(0.0))
    return poisson(stats.join(F.broadcast(total)).withColumn("rate", F.round(rate, 9))).select("source", "n_docs", "n_chars", "rate", "first", "cdf")


def poisson(rates: DataFrame) -> DataFrame:
    """rates(rate, ...) with first and cdf, in time linear in the square root of the rate: probabilities by row, sums by window."""
    rates = rates.withColumn("_key", F.monotonically_increasing_id())
    wide = 12 * F.sqrt("rate") + 30
    first, last = F.greatest(F.floor(F.col("rate") - wide), F.lit(0)).cast("long"), F.ceil(F.col("rate") + wide).cast("long")
    rates = materialize(rates.withColumn("first", F.when(F.col("rate") > 0, first).otherwise(0)), "rates")
    steps = rates.where("rate > 0").select("_key", "rate", F.explode(F.sequence("first", last)).alias("k"))
    p = F.exp(-F.col("rate") + F.col("k") * F.log("rate") - log_factorial(F.col("k")))
    sums = steps.select("_key", "k", F.sum(p).over(Window.partitionBy("_key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    tables = sums.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))  # 24 roots of the rate long
    return rates.join(tables, "_key", "left").withColumn("cdf", F.coalesce("cdf", F.array(F.lit(1.0)))).drop("_key")


def inverted(cdf: Column, u: Column) -> Column:
    """How many values of the sorted ``cdf`` are at most ``u``, by halving."""
    n = F.size(cdf)
    turns = F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double") + 1)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")  # the answer is in [lo, hi]
        low = F.get(cdf, mid) <= u
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & low, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~low, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", temperature: float = 0.5, weights: dict[str, float] | None = None, seed: int = 17, names: tuple[str, str, str] = ("copy", "copies", "shuffle_key")) -> DataFrame:
    """The columns of ``docs`` with copy (0, 1, ...), copies and shuffle_key, in global shuffled order.

    Each row's count inverts the Poisson distribution with its source's rate at a number hashed from
    seed and id: rows with one id (null is an id, too) get one count. Copies are sorted by shuffle_key, the hash of
    seed, id and copy number; rows that share it by id, copy, the hash of their text, and then by where they stand in the input.
    ``names`` are those of the three columns; a column of ``docs`` with one of them is left out, all others stay as
    they are, whatever their names. Null and empty texts are repeated as often as their source's others. An empty table gives no rows.
    """
    rates = materialize(source_rates(docs, source_col, text_col, temperature, weights), "source-rates")
    size = rates.agg(F.sum(8 * F.size("cdf") + F.octet_length(F.coalesce("source", F.lit(""))) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else a hot source is split by the adaptive join
        rates = F.broadcast(rates)
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*(named(c).alias(c) for c in kept)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("from"), F.xxhash64(text_col).alias("text_hash"), uniform(seed, id_col).alias("u"))
    d = rows.alias("d").join(rates.select("source", "first", "cdf").alias("r"), F.col("d.from").eqNullSafe(F.col("r.source")))
    d = d.select("row", "id", "text_hash", (F.col("first") + inverted(F.col("cdf"), F.col("u"))).cast("int").alias("copies")).where("copies > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}+"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    # the last key splits what is equal in all others, so that no range is one hot id
    d = d.withColumn("key", key).withColumn("at", F.monotonically_increasing_id()).orderBy("key", "id", "copy", "text_hash", "at")
    return d.select("row.*", F.col("copy").alias(names[0]), F.col("copies").alias(names[1]), F.col("key").alias(names[2]))
