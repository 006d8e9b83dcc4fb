"""Digitization that finds its own number of symbols: growing runs of increments, and searches over k.

Each series has its own labels here, so the pieces of one series are a group; ``search_k`` is the joint
form, over the pooled points of all series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

EPS = 2.220446049250313e-16
LABELLED = "series_id long, piece_idx int, len double, inc double, label int, center_len double, center_inc double"


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The value that more than half the weight falls on, else where the sorted weights pass half; at exactly half the mean of both sides."""
    half = weights.sum() / 2
    if weights.max() > half:
        return float(values[np.argmax(weights)])
    order = np.lexsort((weights, values))
    v, below = values[order], np.cumsum(weights[order])
    i = np.searchsorted(below, half, "left")  # the first to reach half
    return float((v[i] + v[i + 1]) / 2 if below[i] == half else v[i])


def run_center(values: np.ndarray, norm: int, weighted: bool) -> tuple[float, float]:
    """Center and error of increments in the order of time; weighted: of their running sums against a line."""
    if not weighted:
        c = float(np.median(values) if norm == 1 else values.sum() / len(values))
        # the baseline takes the 1-norm of a one-row matrix, which is its largest entry
        return c, float(np.abs(values - c).max() if norm == 1 else ((values - c) ** 2).sum())
    i, s = np.arange(1, len(values) + 1), np.cumsum(values)
    c = weighted_median(s / i, i) if norm == 1 else float(i @ s / (i @ i))
    return c, float(np.abs(s - i * c).sum() if norm == 1 else ((s - i * c) ** 2).sum())


class _Mean:
    """Squared distances of a run's increments from their mean, by sums of what they are off the first one."""

    def __init__(self, inc: np.ndarray):
        self.inc = inc.tolist()

    def begin(self, i: int) -> None:
        self.first, self.n, self.sum, self.square = self.inc[i], 1, 0.0, 0.0

    def error(self, i: int) -> tuple[float, float]:
        """The run's error with one more increment, and how far rounding may have moved it."""
        v = self.inc[i] - self.first
        self.n, self.sum, self.square = self.n + 1, self.sum + v, self.square + v * v
        return self.square - self.sum * self.sum / self.n, 4 * EPS * (self.n + 4) * self.square


class _Sums:
    """The same by the increments' sum and that of their squares, as SQL adds them up: what these say at the limit, rounding included, holds."""

    def __init__(self, inc: np.ndarray):
        self.inc = inc.tolist()

    def begin(self, i: int) -> None:
        v = self.inc[i]
        self.n, self.sum, self.square = 1, v, v * v

    def error(self, i: int) -> tuple[float, float]:
        v = self.inc[i]
        self.n, self.sum, self.square = self.n + 1, self.sum + v, self.square + v * v
        return self.square - self.sum**2 / self.n, 0.0


class _Median:
    """The largest distance from the median. Increments come sorted, or by absolute value: each is a new least or largest one."""

    def __init__(self, inc: np.ndarray):
        self.inc = inc.tolist()

    def begin(self, i: int) -> None:
        self.low, self.high = [], [self.inc[i]]  # down from the first, and up

    def _at(self, k: int) -> float:
        n = len(self.low)
        return self.low[n - 1 - k] if k < n else self.high[k - n]

    def error(self, i: int) -> tuple[float, float]:
        v = self.inc[i]
        (self.high if v >= self.high[-1] else self.low).append(v)
        n = len(self.low) + len(self.high)
        c = self._at(n // 2) if n % 2 else (self._at(n // 2 - 1) + self._at(n // 2)) / 2
        return max(self._at(n - 1) - c, c - self._at(0)), 0.0


class _SumLine:
    """Squared distances of a run's running sums s from the best line i * c.

    A new increment may stand anywhere in time and moves all sums behind it, so sums of i * s and s * s are kept in a binary tree
    over time: a node has those of its own increments alone, and two nodes make one.
    """

    def __init__(self, inc: np.ndarray):
        self.inc, self.leaves = inc.tolist(), 1 << max(len(inc) - 1, 1).bit_length()
        self.nodes: list[tuple | None] = [None] * (2 * self.leaves)
        self.run: list[int] = []

    def begin(self, i: int) -> None:
        for j in self.run:
            at = j + self.leaves
            while at and self.nodes[at] is not None:
                self.nodes[at] = None
                at >>= 1
        self.first, self.size, self.run = self.inc[i], 0.0, []
        self._put(i)

    def _put(self, i: int) -> None:
        v = self.inc[i] - self.first  # a line less a line is a line: the error is the same
        self.run.append(i)
        self.size += abs(v)
        at, nodes = i + self.leaves, self.nodes
        nodes[at] = here = (1, v, v, v, v * v)  # number, sum, and the sums of s, of i * s and of s * s
        while at > 1:
            other = nodes[at ^ 1]
            if other is not None:
                (n, t, b, a, c), (m, u, e, d, f) = (other, here) if at & 1 else (here, other)
                here = (n + m, t + u, b + e + t * m, a + d + t * (m * (m + 1) // 2) + n * e + n * t * m, c + f + 2 * t * e + t * t * m)
            at >>= 1
            nodes[at] = here

    def error(self, i: int) -> tuple[float, float]:
        self._put(i)
        n, _, _, a, c = self.nodes[1]
        return c - a * a / (n * (n + 1) * (2 * n + 1) / 6), 1e-13 * n * self.size * self.size


class _Anew:
    """Weighted medians of running sums: a new increment moves all behind it, so each is told from the whole run."""

    def __init__(self, inc: np.ndarray):
        pass

    def begin(self, i: int) -> None:
        pass

    def error(self, i: int) -> tuple[float, float]:
        return 0.0, float("inf")


def grow_runs(inc: np.ndarray, tol: float, norm: int = 2, weighted: bool = True, symmetric: bool = False, sums: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centers: along sorted increments a run grows while its error stays below size * tol.

    ``symmetric`` starts from the smallest absolute value; after the first run that met a change of sign,
    the rest is taken by sign, then by absolute value. An increment costs a step (unweighted) or log n steps (weighted, 2-norm); only
    where rounding could decide, and in the weighted 1-norm, the run's error is told anew. With ``sums`` (unweighted, 2-norm) plain sums
    decide there, too, as in SQL.
    """
    if sums and (weighted or norm != 2):
        raise ValueError("plain sums are for the unweighted 2-norm")
    order = np.argsort(np.abs(inc) if symmetric else inc, kind="stable")
    label, centers = np.empty(len(inc), np.int64), []
    grown = {(False, 2): _Mean, (False, 1): _Median, (True, 2): _SumLine, (True, 1): _Anew}[weighted, norm]
    grown = (_Sums if sums else grown)(inc)
    sign, at, crossed, dealt, start = np.sign(inc).tolist(), order.tolist(), False, not symmetric, 0
    while start < len(inc):
        end = start + 1
        grown.begin(at[start])
        while end < len(inc):
            if not dealt and sign[at[end]] != sign[at[0]]:
                crossed = True
            err, doubt = grown.error(at[end])
            most = (end + 1 - start) * tol
            if not sums and not abs(err - most) > doubt:
                err = run_center(inc[np.sort(order[start : end + 1])], norm, weighted)[1]
            if not err < most:
                break
            end += 1
        label[order[start:end]] = len(centers)
        centers.append(run_center(inc[np.sort(order[start:end])], norm, weighted)[0] if end > start + 1 else inc[order[start]])
        if crossed and not dealt:
            rest = order[end:]
            order[end:] = rest[np.lexsort((np.abs(inc[rest]), np.sign(inc[rest])))]
            at, dealt = order.tolist(), True
        start = end
    return label, np.array(centers)


def spread_bound(total_len: float, pieces: int, tol: float) -> float:
    """The largest variance a cluster may have, for series of total_len steps in so many pieces."""
    n = total_len + 1
    return 6 * (n - pieces) / (n * pieces) * tol * tol / 0.04


def best_splits(values: np.ndarray, most: int):
    """Yields labels of the optimal 1, 2, .. ``most`` clusters of numbers by squared distance; at most the distinct values.

    A cluster is a run of the sorted distinct values. Dynamic programme over run ends, a row for each k; ties go to the later cut.
    The best last cut never moves back when the end moves on, so ends are told middle first, each between the cuts of its
    neighbours: a row costs n log n.
    """
    v, back, n = np.unique(values, return_inverse=True, return_counts=True)
    mid = np.average(v, weights=n)
    w, s, q = (np.r_[0.0, np.cumsum(x)] for x in (n, n * (v - mid), n * (v - mid) ** 2))

    def cost(i, j):
        return np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(w[j] - w[i], 1), 0)

    ends = np.arange(1, len(v) + 1)
    best, cuts = np.r_[0.0, cost(0, ends)], []
    for k in range(1, min(most, len(v)) + 1):
        if k > 1:
            new, cut = np.full(len(v) + 1, np.inf), np.zeros(len(v) + 1, np.int32)
            # spans of ends that are not told, and the cuts of the ends next to them
            first, last, low, high = (np.array([x]) for x in (k, len(v), k - 1, len(v) - 1))
            while len(first):
                j = (first + last) // 2
                size = np.minimum(high, j - 1) - low + 1
                start = np.cumsum(size) - size
                i = np.arange(size.sum()) - np.repeat(start - low, size)
                c = best[i] + cost(i, np.repeat(j, size))
                least = np.minimum.reduceat(c, start)
                at = np.maximum.reduceat(np.where(c == np.repeat(least, size), i, -1), start)
                new[j], cut[j] = least, at
                left, right = j > first, j < last
                first, last, low, high = (np.r_[p[left], q[right]] for p, q in ((first, j + 1), (j - 1, last), (low, at), (at, high)))
            best = new
            cuts.append(cut)
        label, j = np.zeros(len(v), int), len(v)
        for c in range(k - 1, 0, -1):
            label[cuts[c - 1][j] : j] = c
            j = cuts[c - 1][j]
        label[:j] = 0
        yield label[back]


def max_spread(label: np.ndarray, values: np.ndarray) -> float:
    """The largest population variance of a label of several values."""
    own, label = np.unique(label, return_inverse=True)
    n = np.bincount(label, minlength=len(own))
    off = values - (np.bincount(label, values) / np.maximum(n, 1))[label]
    spread = np.bincount(label, off * off) / np.maximum(n, 1)
    return float(spread[n > 1].max(initial=0.0))


def split_1d(values: np.ndarray, bound: float, min_k: int, max_k: int) -> np.ndarray:
    """Labels of the fewest optimal clusters, min_k to max_k, whose variances are within ``bound``; else of max_k."""
    label = np.zeros(len(values), int)
    for k, label in enumerate(best_splits(values, max_k), 1):
        if k >= min_k and max_spread(label, values) <= bound:
            break
    return label


def _each_series(pieces: DataFrame, fit) -> DataFrame:
    """fit(len, inc) -> label, center_len, center_inc of every piece, for each series apart."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece_idx")
        label, one, two = fit(*(rows.column(c).to_numpy().astype(float) for c in ("len", "inc")))
        for name, values, kind in (("label", label, pa.int32()), ("center_len", one, pa.float64()), ("center_inc", two, pa.float64())):
            rows = rows.append_column(name, pa.array(values, kind))
        return rows

    own = pieces.select(F.col("series_id").cast("long").alias("series_id"), F.col("piece_idx").cast("int").alias("piece_idx"), F.col("len").cast("double").alias("len"), F.col("inc").cast("double").alias("inc"))
    return own.groupBy("series_id").applyInArrow(run, LABELLED)


def _means(label: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.bincount(label, values) / np.maximum(np.bincount(label), 1)


def incremental(pieces: DataFrame, tol: float, norm: int = 2, weighted: bool = True, symmetric: bool = False, sums: bool = False) -> DataFrame:
    """pieces(series_id, piece_idx, len, inc) -> those, label, center_len (mean), center_inc (of ``grow_runs``)."""
    if norm not in (1, 2) or not tol >= 0:
        raise ValueError("norm must be 1 or 2, tol at least 0")

    def fit(length, inc):
        label, centers = grow_runs(inc, tol, norm, weighted, symmetric, sums)
        return label, _means(label, length)[label], centers[label]

    return _each_series(pieces, fit)


def optimal_1d(pieces: DataFrame, tol: float, scl: float = 0.0, min_k: int = 3, max_k: int = 100) -> DataFrame:
    """Like ``incremental``, with the fewest optimal clusters of one dimension whose variance keeps ``spread_bound``.

    scl 0 clusters increments, infinity lengths, each over its deviation (0 counts as 1); centers are means.
    tol 0 takes max_k. A series of fewer pieces than min_k gets a label for each distinct value.
    """
    if scl not in (0, float("inf")) or not 1 <= min_k <= max_k or not tol >= 0:
        raise ValueError("scl must be 0 or infinity, 1 <= min_k <= max_k, tol at least 0")

    def fit(length, inc):
        v = inc if scl == 0 else length
        std = v.std() if v.std() > EPS else 1.0
        bound = spread_bound(length.sum(), len(v), tol) if tol > 0 else -1.0
        label = split_1d(v / std, bound, min_k, max_k)
        return label, _means(label, length)[label], _means(label, inc)[label]

    return _each_series(pieces, fit)


def max_cluster_var(labelled: DataFrame, *columns: str) -> DataFrame:
    """One row: for each column, the largest population variance over labels (var_<column>); single pieces have none."""
    each = labelled.groupBy("label").agg(*(F.var_pop(c).alias(c) for c in columns))
    return each.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(f"var_{c}") for c in columns))


def search_k(points: DataFrame, tol: float, min_k: int = 3, max_k: int = 100, seed: int = 0) -> DataFrame:
    """points(id, x, y, len, ...) with label: k-means of the pooled points, with the fewest clusters whose variances keep ``spread_bound``.

    A job for each k from min_k; k never exceeds the distinct points. tol 0 takes the most.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if not 1 <= min_k <= max_k or not tol >= 0:
        raise ValueError("1 <= min_k <= max_k, tol at least 0")
    p = materialize(points, "search")
    facts = p.agg(F.sum("len").alias("total"), F.count("*").alias("n"), F.count_distinct("x", "y").alias("k")).first()
    if not facts["n"]:
        return p.withColumn("label", F.lit(None).cast("int"))
    bound = spread_bound(facts["total"], facts["n"], tol)
    v = p.withColumn("features", array_to_vector(F.array("x", "y")))
    most = max(1, min(max_k, facts["k"]))
    for k in range(min(min_k, most) if tol > 0 else most, most + 1):
        got = KMeans(k=k, seed=seed, maxIter=100, tol=0.0).fit(v) if k > 1 else None
        labelled = (got.transform(v).withColumnRenamed("prediction", "label") if got else v.withColumn("label", F.lit(0))).drop("features")
        if k == most or max(max_cluster_var(labelled, "x", "y").first()) <= bound:
            return materialize(labelled, "searched")
    raise AssertionError("k has been tried up to its most")


def _slices(series: DataFrame, labelled: DataFrame) -> DataFrame:
    """labelled pieces with v, the points of each from its first to its last."""
    arrays = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s")).select("series_id", F.col("s.value").alias("v"))
    rows = labelled.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("piece_idx", F.col("len").cast("int").alias("n"), "label", "center_len", "center_inc"))).alias("p"))
    step = "(a, x) -> named_struct('at', a.at + x.n, 'out', concat(a.out, array(a.at)))"
    starts = F.expr(f"aggregate(p, named_struct('at', 0, 'out', CAST(array() AS array<int>)), {step}, a -> a.out)")
    cut = F.expr("transform(arrays_zip(p, at), z -> struct(z.p AS p, slice(v, z.at + 1, z.p.n + 1) AS v))")
    return rows.join(arrays, "series_id").withColumn("at", starts).select("series_id", F.explode(cut).alias("z")).select("series_id", "z.p.*", "z.v")


def patches(series: DataFrame, labelled: DataFrame) -> DataFrame:
    """label, pos, value: the mean course of a label's pieces.

    Each piece's points are shifted so that half the difference to the center's increment is on either side, and resampled
    linearly to the rounded center length. labelled(series_id, piece_idx, len, label, center_len, center_inc); filled series.
    """
    s = _slices(series, labelled).withColumn("g", F.greatest(F.rint("center_len").cast("int"), F.lit(1)))
    s = s.withColumn("base", F.expr("v[0] + (v[n] - v[0] - center_inc) / 2"))
    at = s.withColumn("pos", F.explode(F.expr("sequence(0, g)"))).withColumn("u", F.expr("pos * n / CAST(g AS double)")).withColumn("i", F.expr("least(CAST(floor(u) AS int), n - 1)"))
    return at.withColumn("value", F.expr("v[i] + (u - i) * (v[i + 1] - v[i]) - base")).groupBy("label", "pos").agg(F.avg("value").alias("value"))


def patched(series: DataFrame, labelled: DataFrame) -> DataFrame:
    """series_id, t, value: the mean courses one after the other from each series' first value; the length may differ from the input's."""
    from pyspark.sql import Window

    course = materialize(patches(series, labelled), "patches")
    ends = course.groupBy("label").agg(F.max("pos").alias("g"), F.min_by("value", "pos").alias("low"), (F.max_by("value", "pos") - F.min_by("value", "pos")).alias("up"))
    w = Window.partitionBy("series_id").orderBy("piece_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = series.groupBy("series_id").agg(F.min_by("value", "t").alias("start"))
    placed = labelled.select("series_id", "piece_idx", "label").join(ends, "label").withColumn("t0", F.coalesce(F.sum("g").over(w), F.lit(0))).withColumn("rise", F.coalesce(F.sum("up").over(w), F.lit(0.0))).join(start, "series_id")
    line = placed.join(course.where("pos > 0"), "label")
    again = line.select("series_id", (F.col("t0") + F.col("pos")).alias("t"), (F.col("start") + F.col("rise") + F.col("value") - F.col("low")).alias("value"))
    return again.unionByName(start.join(labelled.select("series_id").distinct(), "series_id").select("series_id", F.lit(0).cast("long").alias("t"), F.col("start").alias("value")))
