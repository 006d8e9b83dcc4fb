"""Which squares of points have two points within alpha of each other, without meeting all their pairs.

Pairs of squares are told by their points' bounding boxes: boxes that lie apart have no such points, boxes that are
within alpha as a whole have, and so have those whose first points are near. What is left is split into sixteen
cells a square, and pairs of cells are looked at in the same way, until a pair has few pairs of points, which are
compared. A level is one pass over the points of the cells that are left; only cells are copied, never points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Pairs of points that are compared when a pair of cells has no more of them; levels of splits by four each way.
LEAF, LEVELS = 4096, 12
CELL = ("cx", "cy", "ix", "iy")


def _cells(points: DataFrame, level: int) -> DataFrame:
    """Cells with their bounding box, first point and number of points."""
    p = points.select("cx", "cy", *(F.shiftright(f"{c}_", 2 * (LEVELS - level)).alias(c) for c in ("ix", "iy")), "x", "y")
    return p.groupBy(*CELL).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(F.struct("x", "y")).alias("p"), F.count("*").alias("n"))


def _named(cells: DataFrame, side: str) -> DataFrame:
    return cells.select(*(F.col(c).alias(f"{side}_{c}") for c in cells.columns))


def near_squares(points: DataFrame, alpha: float, side: float, reach: int = 2) -> DataFrame:
    """Distinct points(x, y, cx, cy), cx and cy numbers of squares of ``side`` -> a_cx, a_cy, b_cx, b_cy of different squares with near points.

    ``reach`` squares must be longer than alpha.
    """
    fine = 4**LEVELS
    place = lambda v, c: F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((F.col(v) - F.col(c) * side) / side * fine))).cast("long")
    p = materialize(points.select("x", "y", "cx", "cy", place("x", "cx").alias("ix_"), place("y", "cy").alias("iy_")), "points")
    cells = materialize(_cells(p, 0), "cells")
    ways = [(i, j) for i in range(reach + 1) for j in range(-reach, reach + 1) if (i, j) > (0, 0)]
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ways))
    to = _named(cells, "a").withColumn("o", F.explode(offsets)).withColumn("b_cx", F.col("a_cx") + F.col("o.i")).withColumn("b_cy", F.col("a_cy") + F.col("o.j")).drop("o")
    pairs = to.join(_named(cells, "b"), ["b_cx", "b_cy"])
    square, limit = ["a_cx", "a_cy", "b_cx", "b_cy"], alpha * alpha
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"))
    across = lambda c: F.greatest(F.abs(F.col(f"a_{c}1") - F.col(f"b_{c}0")), F.abs(F.col(f"b_{c}1") - F.col(f"a_{c}0")))
    first = "(a_p.x - b_p.x) * (a_p.x - b_p.x) + (a_p.y - b_p.y) * (a_p.y - b_p.y)"
    linked = None
    for level in range(LEVELS + 1):
        # boxes tell with a margin for rounding; what they leave is compared as the points are
        kind = F.when(F.pow(apart("x"), 2) + F.pow(apart("y"), 2) > limit * (1 + 1e-9), 0).when((F.pow(across("x"), 2) + F.pow(across("y"), 2) < limit * (1 - 1e-9)) | (F.expr(first) <= limit), 1)
        few = F.lit(level == LEVELS) | (F.col("a_n") * F.col("b_n") <= LEAF)
        told = materialize(pairs.withColumn("kind", kind.when(few, 2).otherwise(3)).where("kind > 0"), "pairs")
        sure = told.where("kind = 1").select(*square).distinct()
        left = told.where("kind > 1").join(sure, square, "left_anti")
        keys = {s: [f"{s}_{c}" for c in CELL] for s in "ab"}
        at = p.select("cx", "cy", *(F.shiftright(f"{c}_", 2 * (LEVELS - level)).alias(c) for c in ("ix", "iy")), "x", "y")
        leaves = left.where("kind = 2").select(*keys["a"], *keys["b"])
        met = leaves.join(_named(at, "a"), keys["a"]).join(_named(at, "b"), keys["b"]).where(f"(a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y) <= {limit!r}")
        found = materialize(sure.unionByName(met.select(*square)).distinct(), "near")
        linked = found if linked is None else linked.unionByName(found)
        split = left.where("kind = 3").join(found, square, "left_anti")
        if split.isEmpty():
            return linked
        split = materialize(split.select(*keys["a"], *keys["b"]), "split")
        kept = split.select(*(F.col(f"a_{c}").alias(c) for c in CELL)).union(split.select(*(F.col(f"b_{c}") for c in CELL))).distinct()
        p = materialize(p.withColumns({c: F.shiftright(f"{c}_", 2 * (LEVELS - level)) for c in ("ix", "iy")}).join(kept, list(CELL), "left_semi").drop("ix", "iy"), "points")
        cells = materialize(_cells(p, level + 1), "cells")
        up = {s: _named(cells, s).withColumns({f"{s}_{c}_up": F.shiftright(f"{s}_{c}", 2) for c in ("ix", "iy")}) for s in "ab"}
        pairs = split
        for s in "ab":
            names = [f"{s}_cx", f"{s}_cy", f"{s}_ix_up", f"{s}_iy_up"]
            pairs = pairs.withColumnsRenamed({f"{s}_ix": f"{s}_ix_up", f"{s}_iy": f"{s}_iy_up"}).join(up[s], names).drop(f"{s}_ix_up", f"{s}_iy_up")
    return linked
