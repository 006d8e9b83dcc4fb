"""Compression of series into linear pieces, greedily the longest chord first.

A chord from ``start`` to ``end`` is kept while the squared residuals of the points under it are at most
``tol * (length - 1)``; the first that fails ends the piece one point earlier.  A chord of two points
always holds.  Engine "arrow" runs the rule with running sums, for many series of a task at once; one series is in one task's memory
(``chords.compress_ranges`` cuts longer ones into ranges). "expr" folds each series with array functions in the JVM, which
copies the pieces so far at each new one: it is for short arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chords import EPS, all_pieces

#: Points of whole series that are worked on together.
AT_ONCE = 200_000
PIECES = "array<struct<len:double,inc:double,err:double>>"


def _check(tol: float, max_len: float) -> None:
    if not (tol >= 0 and np.isfinite(tol)) or max_len < 1:
        raise ValueError("tol must be finite and at least 0, max_len at least 1")


def compress_arrays(values: DataFrame, tol: float, max_len: float = float("inf")) -> DataFrame:
    """values(..., v array<double>) -> the other columns, piece_idx, len, inc, err; arrays of fewer than two points give nothing."""
    _check(tol, max_len)
    most = min(max_len, 2**31 - 1)
    # residuals by running sums (of m * d and d * d), summed up directly where they are close to the limit
    exact = "aggregate(sequence(0, e - a.s), 0D, (q, i) -> q + pow(v[a.s] + (v[e] - v[a.s]) / (e - a.s) * i - v[a.s + i], 2))"
    sums = "named_struct('m', CAST(e - a.s AS DOUBLE), 'd', v[e] - v[a.s], 'qa', a.qa + (e - a.s) * (v[e] - v[a.s]), 'qb', a.qb + (v[e] - v[a.s]) * (v[e] - v[a.s]))"
    fast = "x.d * x.d * (x.m + 1) * (2 * x.m + 1) / (6 * x.m) - 2 * x.d / x.m * x.qa + x.qb"
    limit = f"({tol!r} * (x.m - 1) + {EPS!r})"
    # a piece's own error is summed up once, when it is known
    piece = "named_struct('len', CAST({n} AS DOUBLE), 'inc', a.inc, 'err', IF({n} = 1, 0D, aggregate(sequence(0, {n}), 0D, (q, i) -> q + pow(v[a.s] + a.inc / {n} * i - v[a.s + i], 2))))"
    keep = f"(x.m = 1 OR (r <= {limit} AND x.m - 1 < {most}))"
    step = f"""(a, e) -> transform(array({sums}), x -> transform(transform(array({fast}), r -> IF(abs(r - {limit}) <= 1e-9 * greatest(1D, x.qb), {exact}, r)), r -> IF({keep},
        named_struct('s', a.s, 'inc', x.d, 'qa', x.qa, 'qb', x.qb, 'p', a.p),
        named_struct('s', e - 1, 'inc', v[e] - v[e - 1], 'qa', v[e] - v[e - 1], 'qb', (v[e] - v[e - 1]) * (v[e] - v[e - 1]),
                     'p', concat(a.p, array({piece.format(n="(e - 1 - a.s)")})))))[0])[0]"""
    start = f"named_struct('s', 0, 'inc', 0D, 'qa', 0D, 'qb', 0D, 'p', CAST(array() AS {PIECES}))"
    end = f"a -> concat(a.p, array({piece.format(n='(size(v) - 1 - a.s)')}))"
    others = [c for c in values.columns if c != "v"]
    # the guard is part of the expression: the optimizer may ask for p before it filters rows
    folded = values.where("size(v) >= 2").withColumn("p", F.expr(f"IF(size(v) >= 2, aggregate(sequence(1, size(v) - 1), {start}, {step}, {end}), CAST(array() AS {PIECES}))"))
    return folded.select(*others, F.posexplode("p").alias("piece_idx", "p")).select(*others, "piece_idx", "p.len", "p.inc", "p.err")


def compress(series: DataFrame, tol: float, max_len: float = float("inf"), by: tuple[str, ...] = ("series_id",), engine: str = "arrow") -> DataFrame:
    """series(by..., t, value) -> by..., piece_idx, len, inc, err. Values must be filled: null or NaN is an error of the caller."""
    _check(tol, max_len)
    if engine == "expr":
        arrays = series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
        return compress_arrays(arrays.select(*by, F.col("p.value").alias("v")), tol, max_len)
    head = ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in by)

    def pieces(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        number, index, *sizes = all_pieces(rows.column("value").to_numpy().astype(float), first, tol, max_len)
        keys = rows.select(list(by)).take(pa.array(first[number])).combine_chunks()
        columns = [*(keys.column(c).combine_chunks() for c in by), pa.array(index, pa.int32()), *map(pa.array, sizes)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns], [*by, "piece_idx", "len", "inc", "err"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wanted = [], 0, AT_ONCE
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= wanted:
                table = pa.Table.from_batches(held)
                first = _firsts(table, by)
                if len(first) > 1:  # the last series may go on
                    yield pieces(table.slice(0, first[-1]), first[:-1])
                held = table.slice(first[-1]).to_batches()
                rows = table.num_rows - int(first[-1])
                wanted = max(AT_ONCE, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held)
            yield pieces(table, _firsts(table, by))

    # a fixed number: small series are much work for few bytes, which would else be put together into one task
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = series.select(*by, "t", "value").repartition(parts, *by).sortWithinPartitions(*by, "t")
    return dealt.mapInArrow(run, f"{head}, piece_idx int, len double, inc double, err double")


def _firsts(rows: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """Where a new series begins in sorted rows; null is a key like others."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in by:
        a, b = rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)
        null = pc.or_(pc.is_null(a), pc.is_null(b))
        new[1:] |= pc.if_else(null, pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), True)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def chords(v: np.ndarray, tol: float, max_len: float = float("inf")) -> np.ndarray:
    """[piece, (len, inc, err)] of one series."""
    return np.stack(all_pieces(np.asarray(v, float), np.zeros(1, np.int64), tol, max_len)[2:], axis=1) if len(v) else np.zeros((0, 3))


def scaled_points(pieces: DataFrame, scl: float = 1.0) -> DataFrame:
    """Pieces with x, y: length and increment over their population deviations (0 counts as 1), rounded to 9 digits."""
    std = pieces.agg(F.round(F.stddev_pop("len"), 9).alias("std_len"), F.round(F.stddev_pop("inc"), 9).alias("std_inc"))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    return pieces.join(F.broadcast(std)).withColumn("x", F.round(F.col("len") * scl / one("std_len"), 9)).withColumn("y", F.round(F.col("inc") / one("std_inc"), 9)).drop("std_len", "std_inc")


def auto_alpha(pieces: DataFrame, length: int, tol: float, eta: float = 0.01, scl: float = 1.0) -> DataFrame:
    """One row: k distinct points and the alpha that balances both errors for series of ``length`` points."""
    k = scaled_points(pieces, scl).agg(F.count_distinct("x", "y").cast("double").alias("k"))
    n = float(length)
    top = F.lit(60.0 * n * tol * tol) * F.greatest(F.lit(n) - F.col("k"), F.lit(1.0))
    low = F.greatest(F.col("k") * (eta * eta) * (3 * n**4 + 2 - 5 * F.pow("k", F.lit(2.0))), F.lit(EPS))
    return k.select("k", F.pow(top / low, F.lit(0.25)).alias("alpha"))
