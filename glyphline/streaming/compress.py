"""Compression of unbounded series: an extension, the pieces of a stream as they end."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.compress import EPS
from ..storage import prepare

PIECES = "series_id long, piece_idx int, len double, inc double, err double"
#: The open chord in sums, and the points that wait for the watermark. Sums are decimals of 60 digits: their differences lose nothing.
STATE = "first double, last double, m long, cross string, square string, inc double, err double, number int, taken long, wait_ms array<long>, wait_t array<long>, wait_v array<double>"
_WIDE = Context(prec=60)


class _Chord:
    """The open chord of a series: its first and last value, and sums of i * y and y * y over its points, y from the first."""

    def __init__(self, first=0.0, last=0.0, m=-1, cross="0", square="0", inc=0.0, err=0.0, number=0):
        self.first, self.last, self.m, self.inc, self.err, self.number = first, last, m, inc, err, number
        self.cross, self.square = Decimal(cross), Decimal(square)

    def fields(self) -> tuple:
        return self.first, self.last, self.m, str(self.cross), str(self.square), self.inc, self.err, self.number

    def begin(self, first: float) -> None:
        self.first, self.last, self.m, self.cross, self.square, self.inc, self.err = first, first, 0, Decimal(0), Decimal(0), 0.0, 0.0

    def add(self, value: float, tol: float, max_len: float) -> tuple | None:
        """Takes a point; the piece that it ends, if it ends one."""
        if self.m < 0:
            self.begin(value)
            return None
        m, w = self.m + 1, _WIDE
        y = w.subtract(Decimal(value), Decimal(self.first))
        cross, square = w.fma(y, Decimal(m), self.cross), w.fma(y, y, self.square)
        slope = w.divide(y, Decimal(m))
        off = w.add(w.subtract(w.multiply(w.multiply(slope, slope), Decimal(m * (m + 1) * (2 * m + 1) // 6)), w.multiply(w.multiply(Decimal(2), slope), cross)), square)
        if m == 1 or (float(off) <= tol * (m - 1) + EPS and m - 1 < max_len):
            self.last, self.m, self.cross, self.square, self.inc, self.err = value, m, cross, square, value - self.first, max(float(off), 0.0)
            return None
        ended = self.end()
        self.begin(self.last)
        self.add(value, tol, max_len)
        return ended

    def end(self) -> tuple | None:
        """The piece up to the last point; none behind a point that stands alone."""
        if self.m < 1:
            return None
        self.number += 1
        return self.number - 1, float(self.m), self.inc, self.err


def compress_stream(stream: DataFrame, tol: float, max_len: float = float("inf"), time_col: str | None = None, idle: float = 0.0) -> DataFrame:
    """stream(series_id, t, value) -> series_id, piece_idx, len, inc, err of pieces that have ended.

    The state of a series is its open chord in sums: it doesn't grow with the chord. Without ``time_col`` points are taken as they come,
    by t in each batch, and the last piece stays open.

    ``time_col`` names a timestamp with a watermark: points wait in the state until the watermark has reached their time and are then
    taken by time and t, in whatever order they came. When the watermark is ``idle`` seconds past a series' last point, its last
    piece is given out, and a later point begins anew, with the next number. A point that is not after the last one taken comes too late and is left out,
    as late rows are by Spark's own windows.
    """
    prepare(stream.sparkSession)
    timed = time_col is not None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (*_Chord().fields(), None, [], [], [])
        chord, taken, out = _Chord(*held[:8]), held[8], []
        waiting = list(zip(*held[9:], strict=True))
        for rows in batches:
            waiting += zip(rows["ms"].tolist(), rows["t"].tolist(), rows["value"].astype(float).tolist(), strict=True)
        waiting.sort(key=lambda p: p[:2])
        mark = state.getCurrentWatermarkMs() if timed else None
        ready = len(waiting) if mark is None else sum(p[0] <= mark for p in waiting)
        before = taken
        for ms, _, value in waiting[:ready]:
            if not timed or before is None or ms > before:
                out.append(chord.add(value, tol, max_len))
                taken = ms
        waiting = waiting[ready:]
        closes = None if taken is None else taken + int(idle * 1000)
        if timed and not waiting and chord.m >= 0 and closes < mark:
            out.append(chord.end())
            chord.m = -1
        state.update((*chord.fields(), taken, *([p[i] for p in waiting] for i in range(3))))
        if timed and (waiting or chord.m >= 0):
            state.setTimeoutTimestamp(max(waiting[0][0] if waiting else closes, mark, 1))
        yield pd.DataFrame([(key[0], *piece) for piece in out if piece], columns=["series_id", "piece_idx", "len", "inc", "err"])

    points = stream.select("series_id", F.col("t").cast("long").alias("t"), "value", *((time_col, F.unix_millis(time_col).alias("ms")) if timed else (F.lit(0).cast("long").alias("ms"),)))
    return points.groupBy("series_id").applyInPandasWithState(step, PIECES, STATE, "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)
