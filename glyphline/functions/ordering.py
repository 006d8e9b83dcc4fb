"""Positions in a global order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def with_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """``df`` with its 0-based position by ``order``: ranges are sorted apart and shifted by the rows of the ranges before."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "indexed")
    total, before = 0, []
    for row in sorted(dealt.groupBy("_part").count().collect()):  # a row for each range
        before.append((row["_part"], total))
        total += row["count"]
    shift = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return dealt.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def even_block(index: str, rows: int, blocks: int):
    """The block of a position when ``rows`` are split evenly, the first rows % blocks of them one longer."""
    size, more = divmod(rows, blocks)
    i = F.col(index)
    long_part = F.floor(i / (size + 1))
    short_part = more + F.floor((i - more * (size + 1)) / max(size, 1))
    return F.when(i < more * (size + 1), long_part).otherwise(short_part).cast("int")
