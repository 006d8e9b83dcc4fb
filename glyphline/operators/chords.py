"""Where the longest chord from a point ends, for many starts at once, and series of any length by ranges.

The end of a chord depends on its start alone, so every point has a successor and the pieces of a series are the path
of successors from its first point. A range of a long series, with some points behind it, gives the successors in it,
and with them a map: where a path that enters the range at a point leaves it. Maps of neighbouring ranges are
joined in groups, groups of groups, until the first point's path is known at every range; then each range writes its pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

EPS = 2.220446049250313e-16
#: Steps that are tried for all starts together; longer chords are followed one by one, for starts on a path.
MOST = 24
#: Points of a range, points behind it that are looked at, and maps that are joined in a group.
RANGE, OVERLAP, FAN = 1 << 20, 4096, 64


def direct(v: np.ndarray, s: np.ndarray, m: int | np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Squared residuals of chords of m steps from s, added one by one: sums at the limit must agree with any other engine."""
    m = np.broadcast_to(m, s.shape)
    out = np.zeros(len(s))
    for i in range(int(m.max(initial=-1)) + 1):
        on = m >= i
        g = v[s[on]] + slope[on] * i - v[s[on] + i]
        out[on] += g * g
    return out


def successors(v: np.ndarray, last: np.ndarray, tol: float, max_len: float = float("inf"), eps: float = EPS) -> np.ndarray:
    """Where the chord from each point ends, at most at ``last`` of it; -1 if after more than MOST steps."""
    out, s = last.copy(), np.flatnonzero(last - np.arange(len(v)) >= 2)
    a = v[s + 1] - v[s]
    b = a * a
    for m in range(2, MOST + 1):
        d = v[s + m] - v[s]
        a, b, slope, limit = a + m * d, b + d * d, d / m, tol * (m - 1) + eps
        r = slope * slope * m * (m + 1) * (2 * m + 1) / 6 - 2 * slope * a + b
        close = np.abs(r - limit) <= 1e-9 * np.maximum(1.0, b)
        if close.any():
            r[close] = direct(v, s[close], m, slope[close])
        fits = (r <= limit) & (m - 1 < max_len)
        out[s[~fits]] = s[~fits] + m - 1
        keep = fits & (s + m < last[s])
        s, a, b = s[keep], a[keep], b[keep]
    out[s] = -1
    return out


def reach(v: np.ndarray, s: int, last: int, tol: float, max_len: float, a: float = 0.0, b: float = 0.0, done: int = 0, base: float | None = None, eps: float = EPS) -> tuple[int, bool]:
    """The end of the chord from s, and whether it failed behind that; looked for in spans that double.

    With ``done`` steps known (sums a, b, first value ``base``) v holds what follows them, s is -done, and sums decide alone.
    """
    known, m, width, base = base is not None, done + 1, 64, v[s] if base is None else base
    while s + m <= last:
        k = np.arange(m, min(m + width, last - s + 1))
        d = v[s + k] - base
        sa, sb = (np.cumsum(np.r_[x, y])[1:] for x, y in ((a, k * d), (b, d * d)))
        slope, limit = d / k, tol * (k - 1) + eps
        r = slope * slope * k * (k + 1) * (2 * k + 1) / 6 - 2 * slope * sa + sb
        close = np.abs(r - limit) <= 1e-9 * np.maximum(1.0, sb)
        fits = (k == 1) | (r <= limit) & (k - 1 < max_len)
        for i in np.flatnonzero((close & (k > 1) & (k - 1 < max_len)) | ~fits):
            if close[i] and k[i] > 1 and k[i] - 1 < max_len and not known:
                g = base + slope[i] * np.arange(k[i] + 1) - v[s : s + k[i] + 1]
                if np.cumsum(g * g)[-1] <= limit[i]:
                    continue
            elif fits[i]:
                continue
            return int(s + k[i] - 1), True
        a, b, m, width = sa[-1], sb[-1], m + len(k), width * 2
    return last, False


class Paths:
    """Paths of successors in consecutive values; ``last`` is the last point of each point's series here, ``open_end`` whether that goes on."""

    def __init__(self, v: np.ndarray, last: np.ndarray, tol: float, max_len: float, open_end: bool = False, eps: float = EPS):
        self.v, self.last, self.tol, self.max_len, self.open_end, self.eps = v, last, tol, max_len, open_end, eps
        self.next = successors(v, last, tol, max_len, eps).tolist()

    def step(self, s: int) -> int:
        """The successor of s; -2 if the chord runs to the end of an open range."""
        e = self.next[s]
        if e == -1:
            e, failed = reach(self.v, s, int(self.last[s]), self.tol, self.max_len, eps=self.eps)
            self.next[s] = e = -2 if self.open_end and not failed else e
        elif self.open_end and e == self.last[s]:
            # the end may be that of the chord by chance: it is known only if a point behind it is
            self.next[s] = e = -2
        return e

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """len, inc, err of pieces between known points."""
        m, inc = ends - starts, self.v[ends] - self.v[starts]
        err, short = np.zeros(len(m)), (m > 1) & (m <= MOST)
        err[short] = direct(self.v, starts[short], m[short], inc[short] / m[short])
        for i in np.flatnonzero(m > MOST):
            g = self.v[starts[i]] + inc[i] / m[i] * np.arange(m[i] + 1) - self.v[starts[i] : ends[i] + 1]
            err[i] = np.cumsum(g * g)[-1]
        return m.astype(float), inc, err


def all_pieces(v: np.ndarray, first: np.ndarray, tol: float, max_len: float) -> tuple[np.ndarray, ...]:
    """Pieces of whole series that follow one another in v, each from ``first`` on: number of the series, piece_idx, len, inc, err."""
    ends = np.r_[first[1:], len(v)] - 1
    p = Paths(v, np.repeat(ends, ends - first + 1), tol, max_len)
    nxt, starts, count = p.next, [], []
    for s, end in zip(first.tolist(), ends.tolist(), strict=True):
        n = len(starts)
        while s < end:
            starts.append(s)
            s = e if (e := nxt[s]) >= 0 else p.step(s)
        count.append(len(starts) - n)
    at = np.array(starts, np.int64)
    to = np.array([nxt[s] for s in starts], np.int64)
    count = np.array(count, np.int64)
    index = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.arange(len(first)), count), index, *p.pieces(at, to)


def _ranges(series: DataFrame, rows: int, overlap: int) -> DataFrame:
    """Points dealt to their range, and those at a range's beginning to the range before, too; ``n`` points of the whole series."""
    n = series.groupBy("series_id").agg(F.count("*").alias("n"))
    own = F.floor(F.col("t") / rows)
    to = F.when((F.col("t") % rows < overlap) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return series.select("series_id", "t", "value", F.explode(to).alias("range")).join(n, "series_id")


def _paths(group: pa.Table, rows: int, tol: float, max_len: float, eps: float) -> tuple[Paths, int, int, int]:
    """A range's paths, its first position, its number, and the position behind it or the series' last one."""
    group = group.sort_by("t")
    v, at, n = group.column("value").to_numpy(), group.column("t")[0].as_py(), group.column("n")[0].as_py()
    last, r = at + len(v) - 1, group.column("range")[0].as_py()
    return Paths(v, np.full(len(v), len(v) - 1), tol, max_len, last < n - 1, eps), at, r, min((r + 1) * rows, n - 1)


def _walk(p: Paths, at: int, entry: int, end: int) -> tuple[list[int], int, bool]:
    """Positions from ``entry`` on the path before ``end``, the position where it leaves, and whether it is stuck there in a longer chord."""
    seen, s = [], entry - at
    while s + at < end:
        e = p.step(s)
        if e < 0:
            return seen, s + at, True
        seen.append(s)
        s = e
    return seen, s + at, False


def _joined(maps: list[dict], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where paths leave several ranges in turn, whether they are stuck on the way, and where they enter each (-1: not at all)."""
    at, stuck, seen = entries.copy(), np.zeros(len(entries), bool), []
    for m in maps:
        i = np.minimum(np.searchsorted(m["entry"], at), len(m["entry"]) - 1)
        here = ~stuck & (m["entry"][i] == at)
        seen.append(np.where(here, at, -1))
        at, stuck = np.where(here, m["exit"][i], at), np.where(here, m["stuck"][i], stuck)
    return at, stuck, seen


def _tables(rows: pa.Table) -> list[dict]:
    """The maps of a group by range."""
    rows = rows.sort_by([("range", "ascending"), ("entry", "ascending")])
    r = rows.column("range").to_numpy()
    cut = np.r_[0, np.flatnonzero(np.diff(r)) + 1, len(r)]
    return [{"range": int(r[a])} | {c: rows.column(c).to_numpy()[a:b] for c in ("entry", "exit", "stuck", "extra")} for a, b in zip(cut[:-1], cut[1:], strict=True)]


#: ``extra``: an entry where a path begins, which maps of maps have wherever its range is.
MAP = "series_id long, range long, entry long, exit long, stuck boolean, extra boolean"


def entries(maps: DataFrame, origins: DataFrame, levels: int) -> DataFrame:
    """maps of ranges and origins(series_id, range, entry) -> series_id, range, entry: where each series' path enters every range it meets.

    FAN maps make one, as often as ``levels`` says; then entries are handed down again. A group has FAN maps of OVERLAP rows.
    """
    tables = [maps]

    def up(rows: pa.Table) -> pa.Table:
        parts = _tables(rows)
        begun = [m["entry"][m["extra"]] for m in parts[1:]]
        at = np.concatenate([parts[0]["entry"], *begun])
        extra = np.r_[parts[0]["extra"], np.ones(sum(map(len, begun)), bool)]
        out, stuck, _ = _joined(parts, at)
        n = len(at)
        return pa.table({"series_id": pa.array([rows.column("series_id")[0].as_py()] * n, pa.int64()), "range": pa.array([parts[0]["range"] // FAN] * n, pa.int64()), "entry": pa.array(at), "exit": pa.array(out), "stuck": pa.array(stuck), "extra": pa.array(extra)})

    for _ in range(levels):
        tables.append(materialize(tables[-1].withColumn("g", F.floor(F.col("range") / FAN)).groupBy("series_id", "g").applyInArrow(up, MAP), "maps"))
    known = origins.select("series_id", F.floor(F.col("range") / FAN**levels).alias("range"), "entry")

    def down(rows: pa.Table, tops: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and tops.num_rows:
            parts = _tables(rows)
            seen = _joined(parts, np.array([tops.column("entry")[0].as_py()]))[2]
            found = [(m["range"], int(e[0])) for m, e in zip(parts, seen, strict=True) if e[0] >= 0]
        sid = tops.column("series_id")[0].as_py() if found else None
        return pa.table({"series_id": pa.array([sid] * len(found), pa.int64()), "range": pa.array([r for r, _ in found], pa.int64()), "entry": pa.array([e for _, e in found], pa.int64())})

    for table in reversed(tables[:-1]):
        a = table.withColumn("g", F.floor(F.col("range") / FAN)).groupBy("series_id", "g")
        known = materialize(a.cogroup(known.withColumnRenamed("range", "g").groupBy("series_id", "g")).applyInArrow(down, "series_id long, range long, entry long"), "entries")
    return known


def compress_ranges(series: DataFrame, tol: float, max_len: float = float("inf"), rows: int = RANGE, overlap: int = OVERLAP, eps: float = EPS) -> DataFrame:
    """series(series_id, t, value), t from 0 without gaps -> series_id, piece_idx, len, inc, err, as ``compress`` gives; no task sees a whole series.

    A group is a range of ``rows`` points and ``overlap`` behind it. A chord that runs past both is looked for over all ranges
    behind it (two passes each; there it is told by running sums alone), so ``overlap`` should be above most lengths. ``eps`` is what
    an error may be above its limit: errors that are equal to it in exact numbers hold with one above their rounding.
    """
    if not 2 <= overlap <= rows:
        raise ValueError("overlap must be from 2 to rows")
    dealt = _ranges(series, rows, overlap)
    most = (series.agg(F.max("t")).first()[0] or 0) // rows + 1  # ranges of the longest series
    levels = 1
    while FAN**levels < most:
        levels += 1

    def leave(group: pa.Table) -> pa.Table:
        p, at, r, end = _paths(group, rows, tol, max_len, eps)
        first = r * rows
        ways: dict[int, tuple[int, bool]] = {}
        enter = range(first, min(first + (overlap if r else 1), end))
        for e in reversed(enter):  # later entries first: earlier paths run into theirs
            s, seen = e, []
            while s not in ways and s < end:
                seen.append(s)
                n = p.step(s - at)
                if n < 0:
                    ways[s] = (s, True)
                    break
                s = n + at
            out = ways.get(s, (s, False))
            ways.update((x, out) for x in seen)
        sid = group.column("series_id")[0].as_py()
        return pa.table({"series_id": pa.array([sid] * len(enter), pa.int64()), "range": pa.array([r] * len(enter), pa.int64()), "entry": pa.array(list(enter), pa.int64()), "exit": pa.array([ways[e][0] for e in enter], pa.int64()), "stuck": pa.array([ways[e][1] for e in enter], pa.bool_()), "extra": pa.array([False] * len(enter), pa.bool_())})

    maps = materialize(dealt.groupBy("series_id", "range").applyInArrow(leave, MAP), "maps")
    origins = series.where("t = 0").select("series_id", F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("entry"))
    out_schema = "series_id long, range long, start long, len double, inc double, err double, stuck boolean"

    def write(group: pa.Table, enter: pa.Table) -> pa.Table:
        found = []
        if group.num_rows and enter.num_rows:
            p, at, r, end = _paths(group, rows, tol, max_len, eps)
            sid = group.column("series_id")[0].as_py()
            for entry in enter.column("entry").to_pylist():
                seen, s, stuck = _walk(p, at, entry, end)
                a = np.array(seen, np.int64)
                b = np.r_[a[1:], s - at][: len(a)].astype(np.int64)
                found += [(sid, r, x + at, *q, False) for x, *q in zip(a.tolist(), *(c.tolist() for c in p.pieces(a, b)), strict=True)]
                if stuck:
                    found.append((sid, r, s, 0.0, 0.0, 0.0, True))
        columns = list(zip(*found, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("series_id", "range", "start", "len", "inc", "err", "stuck"), columns, kinds, strict=True)})

    pieces = None
    while True:
        at = entries(maps, origins, levels)
        # the range of an origin is walked from it even where its map has no such entry
        at = at.unionByName(origins).distinct()
        found = materialize(dealt.groupBy("series_id", "range").cogroup(at.groupBy("series_id", "range")).applyInArrow(write, out_schema), "pieces")
        longer = found.where("stuck").select("series_id", "start", "range")
        done = found.where("not stuck").drop("stuck", "range")
        pieces = done if pieces is None else pieces.unionByName(done)
        if longer.isEmpty():
            break
        ends = materialize(_long(series, longer, rows, tol, max_len, eps), "long")
        pieces = pieces.unionByName(ends.select(*done.columns))
        # the path goes on behind the chord, walked to its range's end, and from there through the maps
        origins = ends.where("not final").select("series_id", F.floor(F.col("end") / rows).alias("range"), F.col("end").alias("entry"))
        more = materialize(dealt.groupBy("series_id", "range").cogroup(origins.groupBy("series_id", "range")).applyInArrow(_one(rows, tol, max_len, eps), MAP), "maps")
        maps = maps.join(more.select("series_id", "range", "entry"), ["series_id", "range", "entry"], "left_anti").unionByName(more)
    # positions among the pieces: those of a range, and all of the ranges before
    ranged = pieces.withColumn("range", F.floor(F.col("start") / rows))
    local = ranged.withColumn("i", F.row_number().over(Window.partitionBy("series_id", "range").orderBy("start")) - 1)
    sizes = ranged.groupBy("series_id", "range").agg(F.count("*").alias("k"))  # a row for each range
    before = sizes.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("series_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    return local.join(before, ["series_id", "range"]).select("series_id", (F.col("i") + F.col("before")).cast("int").alias("piece_idx"), "len", "inc", "err")


def _one(rows: int, tol: float, max_len: float, eps: float):
    """The map of a range at given entries only."""

    def run(group: pa.Table, enter: pa.Table) -> pa.Table:
        found = []
        if group.num_rows and enter.num_rows:
            p, at, r, end = _paths(group, rows, tol, max_len, eps)
            for entry in enter.column("entry").to_pylist():
                _, s, stuck = _walk(p, at, entry, end)
                found.append((group.column("series_id")[0].as_py(), r, entry, s, stuck, True))
        columns = list(zip(*found, strict=True)) or [()] * 6
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("series_id", "range", "entry", "exit", "stuck", "extra"), columns, (*[pa.int64()] * 4, pa.bool_(), pa.bool_()), strict=True)})

    return run


def _long(series: DataFrame, starts: DataFrame, rows: int, tol: float, max_len: float, eps: float) -> DataFrame:
    """starts(series_id, start) -> those with end, final (the series ends there), len, inc, err of chords over many ranges, at most one of a series."""
    first = series.join(starts.select("series_id", F.col("start").alias("t"), F.col("t").alias("start")), ["series_id", "t"]).select("series_id", "start", F.col("value").alias("base"))
    behind = series.join(first, "series_id").where("t > start").withColumn("range", F.floor(F.col("t") / rows))
    d, m = F.col("value") - F.col("base"), F.col("t") - F.col("start")
    sums = behind.groupBy("series_id", "range").agg(F.sum(m * d).alias("a"), F.sum(d * d).alias("b"))
    w = Window.partitionBy("series_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carry = sums.select("series_id", "range", *(F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in "ab"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("t")
        get = lambda c: group.column(c)[0].as_py()
        v, start, t0 = group.column("value").to_numpy(), get("start"), get("t")
        end, failed = reach(v, start - t0, len(v) - 1, tol, max_len, get("a"), get("b"), t0 - start - 1, get("base"), eps)
        return pa.table({"series_id": pa.array([get("series_id")], pa.int64()), "end": pa.array([end + t0], pa.int64()), "failed": pa.array([failed], pa.bool_())})

    tried = behind.join(carry, ["series_id", "range"]).groupBy("series_id", "range").applyInArrow(run, "series_id long, end long, failed boolean")
    # the first range that fails tells; else the chord ends with the series
    ends = tried.groupBy("series_id").agg(F.min(F.when(F.col("failed"), F.col("end"))).alias("cut"), F.max("end").alias("final_end"))
    ends = ends.select("series_id", F.coalesce("cut", "final_end").alias("end"), (F.col("cut").isNull() | (F.col("cut") == F.col("final_end"))).alias("final")).join(first, "series_id")
    to = series.join(ends.select("series_id", F.col("end").alias("t")), ["series_id", "t"]).select("series_id", F.col("value").alias("top"))
    ends = ends.join(to, "series_id").withColumn("len", (F.col("end") - F.col("start")).cast("double")).withColumn("inc", F.col("top") - F.col("base"))
    g = F.pow(F.col("base") + F.col("inc") / F.col("len") * (F.col("t") - F.col("start")) - F.col("value"), 2)
    err = series.join(ends.select("series_id", "start", "end", "base", "inc", "len"), "series_id").where("t >= start and t <= end").groupBy("series_id").agg(F.sum(g).alias("err"))
    return ends.join(err, "series_id").select("series_id", "start", "end", "final", "len", "inc", "err")
