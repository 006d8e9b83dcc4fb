"""Clustering of points(id, x, y) with a tolerance: exact greedy in two dimensions or one, two-stage greedy, connected grid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import even_block, with_index
from ..storage import materialize
from . import near_pairs, seeds

#: Sort keys: a member's key exceeds its seed's by at most alpha.
KEYS = {"2-norm": "sqrt(x * x + y * y)", "1-norm": "abs(x) + abs(y)", "lexi": "x"}


def _key(sorting: str) -> str:
    sorting = {"norm": "2-norm"}.get(sorting, sorting)
    if sorting not in KEYS:
        raise ValueError(f"sorting must be one of {sorted(KEYS)}, norm or pca")
    return KEYS[sorting]


def principal_axis(points: DataFrame) -> dict[str, float]:
    """Means mx, my and direction c, s of the largest variance, rounded to 9 digits; the point of the smallest id is not on its positive side."""
    row = points.agg(F.round(F.avg("x"), 9).alias("mx"), F.round(F.avg("y"), 9).alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cov"), F.min_by(F.struct("x", "y"), "id").alias("p")).first()
    if row["p"] is None:
        return {"mx": 0.0, "my": 0.0, "c": 1.0, "s": 0.0}
    angle = math.atan2(2 * row["cov"], row["vx"] - row["vy"]) / 2
    c, s = round(math.cos(angle), 9), round(math.sin(angle), 9)
    turn = -1.0 if (row["p"]["x"] - row["mx"]) * c + (row["p"]["y"] - row["my"]) * s > 0 else 1.0
    return {"mx": row["mx"], "my": row["my"], "c": turn * c, "s": turn * s}


def with_key(points: DataFrame, sorting: str) -> DataFrame:
    """points(id, x, y) with ``key``; pca: the position along the principal axis."""
    p = points.select("id", "x", "y")
    if sorting != "pca":
        return p.withColumn("key", F.expr(_key(sorting)))
    a = principal_axis(p)
    return p.withColumn("key", (F.col("x") - a["mx"]) * a["c"] + (F.col("y") - a["my"]) * a["s"])


def greedy_labels(key: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float, distance_first: bool = False) -> np.ndarray:
    """Of points in order: the first without a label is a seed, and takes those without labels near it.

    ``distance_first`` takes points beyond the key gap, too, up to the first that is neither within the gap nor near.
    """
    label = np.full(len(key), -1, np.int64)
    n = 0
    for i in range(len(key)):
        if label[i] >= 0:
            continue
        reach = alpha * 2**0.5 if distance_first else alpha  # no key grows faster than that
        j = slice(i, np.searchsorted(key, key[i] + reach * (1 + 1e-9) + 1e-9, "right"))
        free, within = label[j] < 0, key[j] - key[i] <= alpha
        near = (x[j] - x[i]) * (x[j] - x[i]) + (y[j] - y[i]) * (y[j] - y[i]) <= alpha * alpha
        if distance_first:
            stop = free & ~near & ~within
            near &= np.arange(len(near)) < (int(np.argmax(stop)) if stop.any() else len(near))
        else:
            near &= within
        label[j][free & near] = n
        n += 1
    return label


def _in_groups(points: DataFrame, group: str, alpha: float, lexi: bool, distance_first: bool = False) -> DataFrame:
    """points(id, x, y, key, group) -> those and local labels from 0 in each group; seed marks a label's first point."""
    kind = points.schema[group].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), *([("y", "ascending")] if lexi else []), ("id", "ascending")])
        label = greedy_labels(*(np.asarray(rows.column(c), float) for c in ("key", "x", "y")), alpha, distance_first)
        seed = np.zeros(len(label), bool)
        seed[np.unique(label, return_index=True)[1]] = True
        return rows.select(["id", "x", "y", "key", group]).append_column("local", pa.array(label)).append_column("seed", pa.array(seed))

    return points.select("id", "x", "y", "key", group).groupBy(group).applyInArrow(run, f"id long, x double, y double, key double, {group} {kind}, local long, seed boolean")


def greedy(points: DataFrame, alpha: float, sorting: str = "2-norm", distance_first: bool = False) -> DataFrame:
    """id, x, y, label, seed. The order is (key, id), for lexi (x, y, id); labels count seeds in that order.

    Seeds are found by rounds over tiles of squares (``seeds.find``), then each point is labelled from the seeds around
    its square: no task has more than a tile's share. ``distance_first`` (see ``greedy_labels``) is the rule of ``runs``.
    """
    sorting = {"norm": "2-norm"}.get(sorting, sorting)
    if distance_first:
        return runs(points, alpha, sorting, distance_first)
    p = materialize(with_key(points, sorting), "points")
    order = ["key", "y", "id"] if sorting == "lexi" else ["key", "id"]
    found = with_index(seeds.find(p, alpha, sorting), *order, name="label")
    return seeds.labels(p, found, alpha, sorting)


def runs(points: DataFrame, alpha: float, sorting: str = "2-norm", distance_first: bool = False) -> DataFrame:
    """What ``greedy`` gives, with a group for each run of occupied key cells.

    Where consecutive keys are more than alpha apart nothing reaches across, so the runs of occupied key
    cells of width alpha are clustered apart from each other and their labels shifted. With ``distance_first``
    (see ``greedy_labels``) cells are wider by the square root of 2, as points may be near at that 1-norm gap.
    That rule looks at the next free point of the whole order, so it has no form by squares.
    """
    width = alpha * 2**0.5 if distance_first else alpha
    p = with_key(points, sorting).withColumn("cell", F.floor(F.col("key") / width))
    cells = p.select("cell").distinct()  # as many as the key range has widths of alpha
    new = F.when(F.col("cell") - F.lag("cell").over(Window.orderBy("cell")) == 1, 0).otherwise(1)
    islands = cells.withColumn("new", new).withColumn("island", F.sum("new").over(Window.orderBy("cell"))).drop("new")
    local = materialize(_in_groups(p.join(islands, "cell"), "island", alpha, sorting == "lexi", distance_first), "greedy")
    sizes = local.groupBy("island").agg((F.max("local") + 1).alias("n"))
    before = sizes.select("island", F.coalesce(F.sum("n").over(Window.orderBy("island").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return local.join(before, "island").select("id", "x", "y", (F.col("local") + F.col("before")).cast("int").alias("label"), "seed")


def two_stage(points: DataFrame, alpha: float, blocks: int, sorting: str = "2-norm") -> DataFrame:
    """id, x, y, label, seed: greedy in ``blocks`` even slices of the sorted points, then greedy over their seeds.

    Members can be up to twice alpha from the seed; one block gives what ``greedy`` gives.
    """
    order = ["key", "y", "id"] if sorting == "lexi" else ["key", "id"]
    p = with_index(with_key(points, sorting), *order)
    rows = p.count()
    local = materialize(_in_groups(p.withColumn("block", even_block("idx", rows, blocks)), "block", alpha, sorting == "lexi"), "two-stage")
    name = F.shiftleft(F.col("block").cast("long"), 40) + F.col("local")
    tops = greedy(local.where("seed").select(name.alias("id"), "x", "y"), alpha, sorting)
    joined = local.withColumn("s", name).join(tops.select(F.col("id").alias("s"), "label", F.col("seed").alias("top")), "s")
    return joined.select("id", "x", "y", "label", (F.col("seed") & F.col("top")).alias("seed"))


def greedy_1d(values: DataFrame, tol: float) -> DataFrame:
    """values(id, x) -> id, x, label, center. Along sorted values, the first free one starts a cluster that takes all within
    tol of its center: tol above it, or itself if that is within tol of the last input value (largest id).

    Clusters follow one another, so values more than 2 tol apart part the input into groups that are done apart.
    """
    last = values.agg(F.max_by("x", "id").alias("last")).first()["last"]
    v = values.select("id", "x").withColumn("cell", F.floor(F.col("x") / (2 * tol)))
    new = F.when(F.col("cell") - F.lag("cell").over(Window.orderBy("cell")) == 1, 0).otherwise(1)
    islands = v.select("cell").distinct().withColumn("new", new).withColumn("island", F.sum("new").over(Window.orderBy("cell"))).drop("new")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("x", "ascending"), ("id", "ascending")])
        x = rows.column("x").to_numpy().astype(float)
        label, center, i, n = np.zeros(len(x), np.int64), np.zeros(len(x)), 0, 0
        while i < len(x):
            c = x[i] + tol if x[i] < last - tol else x[i]
            far = np.abs(x[i + 1 :] - c) > tol
            end = i + 1 + (int(np.argmax(far)) if far.any() else len(far))
            label[i:end], center[i:end] = n, c
            i, n = end, n + 1
        return rows.select(["id", "x", "island"]).append_column("local", pa.array(label)).append_column("center", pa.array(center))

    local = materialize(v.join(islands, "cell").select("id", "x", "island").groupBy("island").applyInArrow(run, "id long, x double, island long, local long, center double"), "greedy-1d")
    sizes = local.groupBy("island").agg((F.max("local") + 1).alias("n"))
    before = sizes.select("island", F.coalesce(F.sum("n").over(Window.orderBy("island").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return local.join(before, "island").select("id", "x", (F.col("local") + F.col("before")).cast("int").alias("label"), "center")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(node), edges(a, b) -> node, comp: the smallest node that can be reached."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    comp = materialize(nodes.select("node", F.col("node").alias("comp")), "components")
    while True:
        near = both.join(comp.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = comp.join(near, "node", "left").select("node", F.least("comp", F.coalesce("m", "comp")).alias("new"), F.col("comp").alias("old"))
        up = comp.select(F.col("node").alias("new"), F.col("comp").alias("up"))
        step = materialize(step.join(up, "new").select("node", F.least("new", "up").alias("comp"), "old"), "components")
        comp = step.select("node", "comp")
        if step.where("comp <> old").isEmpty():
            return comp


def grid_components(points: DataFrame, alpha: float) -> DataFrame:
    """id, x, y, label: connected components of the graph that links points at most alpha apart.

    Points in one square of side alpha / 2 are linked anyway; squares are linked where two of their
    distinct points are near (``near_pairs``). Labels count components by their smallest id.
    """
    side = alpha / 2 * (1 + 1e-6)  # what is near is at most two squares away, rounding or not
    p = materialize(points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")), "points")
    squares = materialize(p.groupBy("cx", "cy").agg(F.min("id").alias("node")), "squares")
    near = near_pairs.near_squares(p.select("x", "y", "cx", "cy").distinct(), alpha, side)
    node = lambda s: squares.select(F.col("cx").alias(f"{s}_cx"), F.col("cy").alias(f"{s}_cy"), F.col("node").alias(s))
    edges = near.join(node("a"), ["a_cx", "a_cy"]).join(node("b"), ["b_cx", "b_cy"]).select("a", "b")
    comp = components(edges, squares.select("node"))
    first = with_index(comp.groupBy("comp").agg(F.min("node").alias("first")), "first", name="label").select("comp", F.col("label").cast("int").alias("label"))
    return p.join(squares, ["cx", "cy"]).join(comp, "node").join(first, "comp").select("id", "x", "y", "label")


def summary(labelled: DataFrame) -> DataFrame:
    """labelled(id, x, y, label, seed) -> label, count, seed_x, seed_y, centroid_x, centroid_y, sse."""
    c = labelled.groupBy("label").agg(F.count("*").alias("count"), F.max(F.when(F.col("seed"), F.col("x"))).alias("seed_x"), F.max(F.when(F.col("seed"), F.col("y"))).alias("seed_y"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))
    sse = labelled.join(c, "label").groupBy("label").agg(F.sum(F.pow(F.col("x") - F.col("centroid_x"), 2) + F.pow(F.col("y") - F.col("centroid_y"), 2)).alias("sse"))
    return c.join(sse, "label")
