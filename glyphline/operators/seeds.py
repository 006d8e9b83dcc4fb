"""Seeds of the exact greedy rule without a task that sees all points.

A point is a seed if no earlier seed takes it: one within alpha of it whose key is at most alpha smaller. Seeds are thus the first
maximal independent set in the order of keys. Any two points of one square (side alpha over the square root of 2, for 1-norm keys
half of alpha) take each other, so a square has one seed at most: its first point that no seed of the squares around takes.
So only a square's first points are looked at, ``PREFIX`` of them. Tiles of squares settle them in rounds:
in the order of keys, a point becomes a seed if all earlier points that could take it are settled, those of the tiles around included.
Where all first points of a square are taken and it has more, the next ones that no known seed takes follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: First points of a square that are looked at together; points of a tile that is not split.
PREFIX, TILE_POINTS = 8192, 400_000
OPEN, TAKEN, SEED = 0, 1, 2


def with_square(points: DataFrame, alpha: float, sorting: str) -> tuple[DataFrame, int]:
    """points with their square cx, cy, and how many squares away alpha reaches."""
    side = alpha * (0.5 if sorting == "1-norm" else 0.5**0.5) * (1 - 1e-6)
    return points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)), int(alpha // side) + 1


def settle(key: np.ndarray, x: np.ndarray, y: np.ndarray, square: np.ndarray, own: np.ndarray, last: np.ndarray, state: np.ndarray, alpha: float) -> np.ndarray:
    """States of points in the order of keys, as far as they can be told.

    ``own``: points that may be decided here; ``last``: those behind which their square may have more; ``state``: SEED for seeds
    that are known. Others stay OPEN: a point with an open one before it that could take it, what follows it in its square, and all
    points behind a ``last`` one whose square has no seed.
    """
    state, shut = state.copy(), np.zeros(int(square.max(initial=-1)) + 1, bool)

    def near(i: int, a: int, b: int) -> np.ndarray:
        return (x[a:b] - x[i]) * (x[a:b] - x[i]) + (y[a:b] - y[i]) * (y[a:b] - y[i]) <= alpha * alpha

    def take(i: int) -> None:
        end = i + 1 + int(np.searchsorted(key[i + 1 :], key[i] + alpha * (1 + 1e-9), "right"))
        hit = near(i, i + 1, end) & (key[i + 1 : end] - key[i] <= alpha) & (state[i + 1 : end] == OPEN)
        hit &= ~last[i + 1 : end] | (square[i + 1 : end] == square[i])  # what is behind it is not known to be taken
        state[i + 1 : end][hit] = TAKEN
        shut[square[i]] = True

    for i in np.flatnonzero(state == SEED):
        take(i)
    todo = np.flatnonzero((state == OPEN) & (own | last))
    for a in range(0, len(todo), 256):
        part = todo[a : a + 256]
        for i in part[(state[part] == OPEN) & ~(shut[square[part]] & ~last[part])]:
            if state[i] != OPEN or shut[square[i]] and not last[i]:
                continue
            if last[i]:
                return state
            start = int(np.searchsorted(key[:i], key[i] - alpha * (1 + 1e-9), "left"))
            before = near(i, start, i) & (key[i] - key[start:i] <= alpha) & (state[start:i] == OPEN)
            if before.any():
                shut[square[i]] = True
            else:
                state[i] = SEED
                take(i)
    return state


def _tile_width(squares: DataFrame, reach: int) -> int:
    """Squares of a tile's side so that its points, a square's first ones, are at most TILE_POINTS if tiles of a few squares allow it."""
    width = 1 << 20
    while width > 4 * reach:
        tile = [F.floor(F.col(c) / width) for c in ("cx", "cy")]
        if (squares.groupBy(*tile).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= TILE_POINTS:
            break
        width //= 4
    return max(width, reach)


def find(points: DataFrame, alpha: float, sorting: str) -> DataFrame:
    """points(id, x, y, key) -> the seeds of them: id, x, y, key, cx, cy."""
    order = ["key", "y", "id"] if sorting == "lexi" else ["key", "id"]
    p, reach = with_square(points, alpha, sorting)

    def first(q: DataFrame) -> DataFrame:
        """The first points of each square; a further one is marked ``last``. Spark keeps as many of a square in each task, before the shuffle."""
        n = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(*order))
        return q.withColumn("n", n).where(F.col("n") <= PREFIX + 1).select("id", "x", "y", "key", "cx", "cy", (F.col("n") == PREFIX + 1).alias("last"))

    open_ = materialize(first(p), "open")
    width = _tile_width(open_.groupBy("cx", "cy").agg(F.count("*").alias("n")), reach)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        square = np.unique(np.stack([rows.column(c).to_numpy() for c in ("cx", "cy")]), axis=1, return_inverse=True)[1].ravel()
        known, foreign, last = (rows.column(c).to_numpy() for c in ("known", "foreign", "last"))
        state = settle(*(rows.column(c).to_numpy() for c in ("key", "x", "y")), square, ~foreign & ~last, last, np.where(known, SEED, OPEN), alpha)
        seeded = np.zeros(int(square.max(initial=-1)) + 1, bool)
        seeded[square[state == SEED]] = True
        keep = ~foreign & ~known & ((state == SEED) | (state == OPEN) & ~seeded[square])
        return rows.select(["id", "x", "y", "key", "cx", "cy", "last"]).append_column("seed", pa.array(state == SEED)).filter(pa.array(keep))

    def dealt(q: DataFrame) -> DataFrame:
        """Each point to its tile, and to those that its square's surroundings touch."""
        span = lambda c: F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width))
        to = q.withColumn("tx", F.explode(span("cx"))).withColumn("ty", F.explode(span("cy")))
        return to.withColumn("foreign", (F.col("tx") != F.floor(F.col("cx") / width)) | (F.col("ty") != F.floor(F.col("cy") / width)))

    columns = ["id", "x", "y", "key", "cx", "cy"]
    schema = "id long, x double, y double, key double, cx long, cy long, last boolean, seed boolean"
    seeds = fresh = None
    while True:
        rows = open_.withColumn("known", F.lit(False))
        if fresh is not None:
            rows = rows.unionByName(fresh.select(*columns, F.lit(False).alias("last"), F.lit(True).alias("known")))
        out = materialize(dealt(rows).groupBy("tx", "ty").applyInArrow(run, schema), "settled")
        fresh = out.where("seed").select(*columns)
        seeds = fresh if seeds is None else seeds.unionByName(fresh)
        open_ = out.where("not seed").select(*columns, "last")
        left = open_.groupBy("cx", "cy").agg(F.bool_and("last").alias("spent"))
        state = left.agg(F.count("*").alias("n"), F.coalesce(F.max("spent"), F.lit(False)).alias("spent")).first()
        if not state["n"]:
            return seeds
        if state["spent"]:
            spent = left.where("spent").select("cx", "cy")
            free = takers(p.join(spent, ["cx", "cy"]), seeds, reach, alpha, sorting).where("size(by) = 0").drop("by")
            open_ = materialize(open_.join(spent, ["cx", "cy"], "left_anti").select(*columns, "last").unionByName(first(free)), "open")


def takers(points: DataFrame, seeds: DataFrame, reach: int, alpha: float, sorting: str, *more: str) -> DataFrame:
    """points(id, x, y, key, cx, cy) with ``by``: the seeds (and columns ``more`` of them) that take each or are it.

    A square's row has the seeds around it, one for each square there at most, so points meet one row each.
    """
    span = F.sequence(F.lit(-reach), F.lit(reach))
    around = seeds.withColumn("cx", F.explode(F.transform(span, lambda i: F.col("cx") + i))).withColumn("cy", F.explode(F.transform(span, lambda i: F.col("cy") + i)))
    rows = around.groupBy("cx", "cy").agg(F.collect_list(F.struct("id", "x", "y", "key", *more)).alias("by"))
    ties = "s.y < y or s.y = y and s.id <= id" if sorting == "lexi" else "s.id <= id"
    near = f"s -> (s.key < key or s.key = key and ({ties})) and key - s.key <= {alpha!r} and (x - s.x) * (x - s.x) + (y - s.y) * (y - s.y) <= {alpha * alpha!r}"
    return points.join(rows, ["cx", "cy"], "left").withColumn("by", F.expr(f"filter(coalesce(by, array()), {near})"))


def labels(points: DataFrame, seeds: DataFrame, alpha: float, sorting: str) -> DataFrame:
    """points(id, x, y, key) and numbered seeds(..., label) -> id, x, y, label, seed: the first seed that takes each point."""
    p, reach = with_square(points, alpha, sorting)
    best = takers(p, seeds, reach, alpha, sorting, "label").withColumn("b", F.expr("array_min(transform(by, s -> struct(s.label, s.id)))"))
    return best.select("id", "x", "y", F.col("b.label").cast("int").alias("label"), (F.col("b.id") == F.col("id")).alias("seed"))
