"""Time warping, forced pieces at boundaries, frequency symbols, and summaries of repeated runs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _diagonals(x: np.ndarray, y: np.ndarray, dist: Callable | None, start: int, before: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Costs of the cells (i, k - i) for k from ``start`` on, at i + 1 in an array as long as x and one more; what is outside is infinite.

    ``before`` are the two anti-diagonals before; all cells of one depend on those alone, so each is a few array steps.
    """
    n, m = len(x), len(y)
    two, one = before
    for k in range(start, n + m - 1):
        lo, hi = max(0, k - m + 1), min(k, n - 1)
        a, b = x[lo : hi + 1], y[k - hi : k - lo + 1][::-1]
        d = (a - b) ** 2 if dist is None else np.array([dist(p, q) for p, q in zip(a, b, strict=True)], float)
        least = np.minimum(np.minimum(one[lo : hi + 1], one[lo + 1 : hi + 2]), two[lo : hi + 1])
        new = np.full(n + 1, np.inf)
        new[lo + 1 : hi + 2] = d + (least if k else 0.0)
        yield new
        two, one = one, new


def dtw_cost(x: np.ndarray, y: np.ndarray, dist: Callable | None = None) -> float:
    """Cost of the cheapest monotone alignment; squared differences unless ``dist`` says otherwise. Memory is linear in the lengths."""
    none = np.full(len(x) + 1, np.inf)
    for last in _diagonals(x, y, dist, 0, [none, none]):
        pass
    return float(last[-1])


def dtw_pairs(series: DataFrame, pairs: DataFrame, dist: Callable | None = None) -> DataFrame:
    """pairs(a, b) of series ids -> a, b, cost. A group is a pair of series."""
    arrays = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p")).select("series_id", F.col("p.value").alias("v"))
    both = pairs.join(arrays.select(F.col("series_id").alias("a"), F.col("v").alias("x")), "a").join(arrays.select(F.col("series_id").alias("b"), F.col("v").alias("y")), "b")

    def run(batches):
        for batch in batches:
            cost = [dtw_cost(np.array(x.as_py(), float), np.array(y.as_py(), float), dist) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cost, pa.float64())], ["a", "b", "cost"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cost double")


def dtw_path(x: np.ndarray, y: np.ndarray, dist: Callable | None = None, filter_redundant: bool = False) -> tuple[float, list[tuple[int, int]]]:
    """Cost and the 0-based positions that the cheapest alignment pairs; of equal ways the one from above, from the left, then diagonal.

    Memory is the lengths times the root of their sum, and the path.
    ``filter_redundant`` leaves out collinear interior points; positions are still those of the input.
    """
    keep = [np.arange(len(v)) for v in (x, y)]
    if filter_redundant:
        keep = [k[np.r_[True, np.abs(np.diff(v, 2)) >= 1e-14, True]] if len(v) > 2 else k for k, v in zip(keep, (x, y), strict=True)]
    x, y = x[keep[0]], y[keep[1]]
    # every so many anti-diagonals two are kept; the way back makes those between them once more
    every = max(2, math.isqrt(len(x) + len(y)))
    none = np.full(len(x) + 1, np.inf)
    two, one, kept = none, none, []
    for k, new in enumerate(_diagonals(x, y, dist, 0, [none, none])):
        if k % every == 0:
            kept.append([two, one])
        two, one = one, new
    cost, path, i, j = float(one[-1]), [], len(x) - 1, len(y) - 1
    for block in reversed(range(len(kept))):
        start = block * every
        known = [*kept[block], *islice(_diagonals(x, y, dist, start, kept[block]), i + j - start + 1)]
        while i + j >= start:
            path.append((int(keep[0][i]), int(keep[1][j])))
            if not i and not j:
                break
            a, b = known[i + j - start + 1], known[i + j - start]
            ways = [(a[i], i - 1, j), (a[i + 1], i, j - 1), (b[i], i - 1, j - 1)]  # of equal ones the first
            _, i, j = min(ways, key=lambda w: w[0])
    return cost, path[::-1]


def dtw_paths(series: DataFrame, pairs: DataFrame, dist: Callable | None = None, filter_redundant: bool = False) -> DataFrame:
    """pairs(a, b) of series ids -> a, b, cost, path of (i, j)."""
    arrays = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p")).select("series_id", F.col("p.value").alias("v"))
    both = pairs.join(arrays.select(F.col("series_id").alias("a"), F.col("v").alias("x")), "a").join(arrays.select(F.col("series_id").alias("b"), F.col("v").alias("y")), "b")
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))

    def run(batches):
        for batch in batches:
            got = [dtw_path(np.array(x.as_py(), float), np.array(y.as_py(), float), dist, filter_redundant) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            paths = pa.array([[{"i": i, "j": j} for i, j in p] for _, p in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([c for c, _ in got], pa.float64()), paths], ["a", "b", "cost", "path"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cost double, path array<struct<i:int,j:int>>")


def boundary_extra(pieces: DataFrame, lengths: DataFrame, blocks: list[int]) -> DataFrame:
    """blocks, forced: pieces of the unsplit series that a boundary of an even split falls inside (not on a knot), in all series.

    At most blocks - 1 for each series. Boundaries are a small table: one row for each series and cut.
    """
    ms = pieces.sparkSession.createDataFrame([(m,) for m in blocks], "blocks int")
    # a boundary is the first point of each block but the first, after n // m points each
    cuts = lengths.join(F.broadcast(ms)).where("n >= blocks and blocks > 1").select("series_id", "blocks", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("i"), "n").select("series_id", "blocks", (F.col("i") * F.floor(F.col("n") / F.col("blocks"))).alias("cut"))
    w = Window.partitionBy("series_id").orderBy("piece_idx")
    ends = pieces.withColumn("to", F.sum("len").over(w)).withColumn("from", F.col("to") - F.col("len"))
    hit = ends.join(cuts, "series_id").where("`from` < cut and cut < `to`").groupBy("blocks").agg(F.count("*").alias("forced"))
    return ms.join(hit, "blocks", "left").select("blocks", F.coalesce("forced", F.lit(0)).cast("long").alias("forced"))


def boundary_report(forced: DataFrame, counts: DataFrame, base: int) -> DataFrame:
    """forced(blocks, forced) and counts(blocks, pieces) of the split series, ``base`` pieces of the unsplit ones -> those with
    observed extra pieces, both as percentages of base, forced pieces a boundary (0 without one)."""
    r = forced.join(counts, "blocks").withColumn("observed", F.col("pieces") - base)
    share = lambda c: (F.col(c) * 100.0 / base if base else F.lit(0.0)).alias(f"{c}_percent")
    return r.select("blocks", "pieces", "forced", "observed", share("forced"), share("observed"), F.when(F.col("blocks") > 1, F.col("forced") / (F.col("blocks") - 1)).otherwise(0.0).alias("forced_per_boundary"))


def symbol_segments(labelled: DataFrame, lengths: DataFrame) -> DataFrame:
    """labelled(series_id, piece_idx, len, symbol) and lengths(series_id, n) -> series_id, piece_idx, symbol, start, width.

    Rounded lengths of at least one step, the last fitted to n points; what starts beyond the end is left out, what
    passes it is cut, to a half step at least.
    """
    by = Window.partitionBy("series_id")
    p = labelled.select("series_id", "piece_idx", "symbol", F.greatest(F.rint("len").cast("long"), F.lit(1)).alias("w")).join(lengths.select("series_id", F.greatest(F.col("n") - 1, F.lit(1)).alias("total")), "series_id")
    fixed = F.greatest(F.lit(1), F.col("w") + F.col("total") - F.sum("w").over(by))
    p = p.withColumn("w", F.when(F.col("piece_idx") == F.max("piece_idx").over(by), fixed).otherwise(F.col("w")))
    p = p.withColumn("start", F.sum("w").over(by.orderBy("piece_idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    width = F.greatest(F.lit(0.5), F.least(F.col("w"), F.col("total") - F.col("start")).cast("double"))
    return p.where("start < total").select("series_id", "piece_idx", "symbol", F.col("start").cast("double").alias("start"), width.alias("width"))


def frequency_symbols(labelled: DataFrame) -> DataFrame:
    """label, n, rank, symbol: labels by falling frequency, ties by first appearance (order); the symbol is a, b, ... by rank."""
    c = labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    c = c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1)
    return c.select("label", "n", "rank", F.when(F.col("rank") < 26, F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.col("rank") + 1, F.lit(1))).otherwise(F.concat(F.lit("s"), F.col("rank").cast("string"))).alias("symbol"))


def run_summary(runs: DataFrame, workers: str = "workers", seconds: str = "seconds") -> DataFrame:
    """workers, median, mean, std_pop, std_samp, low, high, speedup and efficiency against the fewest workers."""
    s = runs.groupBy(workers).agg(F.median(seconds).alias("median"), F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("std_pop"), F.stddev_samp(seconds).alias("std_samp"), F.min(seconds).alias("low"), F.max(seconds).alias("high"))
    base = s.agg(F.min_by("median", workers).alias("base"))
    return s.join(F.broadcast(base)).withColumn("speedup", F.col("base") / F.col("median")).withColumn("efficiency", F.col("speedup") / F.col(workers)).drop("base")


def keep_one(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row for each key: the first by ``order``, or the last."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*([F.desc(c) for c in order] if last else order)))).where("_n = 1").drop("_n")


def median_run(runs: DataFrame, keys: list[str], seconds: str, order: list[str]) -> DataFrame:
    """For each key the run at the middle (the upper one of two) by ``seconds``, ties by ``order``."""
    w = Window.partitionBy(*keys)
    r = runs.withColumn("_n", F.row_number().over(w.orderBy(seconds, *order))).withColumn("_all", F.count("*").over(w))
    return r.where("_n = floor(_all / 2) + 1").drop("_n", "_all")


def against_serial(runs: DataFrame, serial: DataFrame, keys: list[str], seconds: str = "seconds", workers: str = "workers") -> DataFrame:
    """runs with base (median seconds of ``serial`` by key), speedup and efficiency; null without a base."""
    base = serial.groupBy(*keys).agg(F.median(seconds).alias("base"))
    r = runs.join(base, keys, "left").withColumn("speedup", F.col("base") / F.col(seconds))
    return r.withColumn("efficiency", F.col("speedup") / F.col(workers))


def best_workers(runs: DataFrame, keys: list[str], seconds: str = "seconds", workers: str = "workers") -> DataFrame:
    """keys, best_workers, best_seconds: the least mean seconds, ties to fewer workers."""
    means = runs.groupBy(*keys, workers).agg(F.avg(seconds).alias("best_seconds"))
    best = F.min(F.struct("best_seconds", F.col(workers).alias("best_workers"))).alias("b")
    return means.groupBy(*keys).agg(best).select(*keys, "b.best_workers", "b.best_seconds")


def wide_table(runs: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """A row for each ``row``, a column for each ``column``: the median value."""
    return runs.groupBy(row).pivot(column, columns).agg(F.median(value)).orderBy(row)


def table_text(table: DataFrame, form: str = "markdown", digits: int = 4) -> str:
    """A report table (as small as a page: a row for each data set) as markdown or LaTeX; nulls are "--"."""
    cell = lambda v: "--" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    rows = [[cell(v) for v in r] for r in table.collect()]
    if form == "markdown":
        lines = [table.columns, ["---"] * len(table.columns), *rows]
        return "\n".join("| " + " | ".join(r) + " |" for r in lines)
    if form != "latex":
        raise ValueError("form must be markdown or latex")
    escape = lambda v: v.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(map(escape, r)) + r" \\" for r in [table.columns, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{l{'r' * (len(table.columns) - 1)}}}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}"])
