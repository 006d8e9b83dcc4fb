"""Symbols of labelled pieces, symbols of unseen pieces, and the way back to values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans
from ..functions.ordering import with_index
from ..storage import materialize
from .center_index import CenterTree

#: Centers that are met one by one, that a tree holds, and of a model at most.
FEW, SLICE, MOST = 256, 1 << 20, 1 << 24

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def alphabet(labels: int, kind: int | list[str] | None = 0) -> list[str]:
    """Symbols of labels 0, 1, ...: 0 is AaBb.., 1 is A-Za-z, a list is itself, else a-zA-Z; from as many
    labels as it has symbols on, characters from "!" upwards (without surrogates, which are no text)."""
    if kind == 0:
        names = [c for pair in zip(_UP, _LOW, strict=True) for c in pair]
    elif kind == 1:
        names = [*_UP, *_LOW]
    else:
        names = list(kind) if isinstance(kind, list) and kind else [*_LOW, *_UP]
    if labels < len(names):
        return names[:labels]
    return [chr(33 + i + (0x800 if 33 + i >= 0xD800 else 0)) for i in range(labels)]


def model_of(labelled: DataFrame, center: str = "centroid", scl: float = 1.0) -> DataFrame:
    """labelled pieces(len, inc, label, seed) -> label, center_len, center_inc: the mean or the seed of each label; scl 0 always takes mean lengths."""
    mean_len, mean_inc = F.avg("len"), F.avg("inc")
    seed_len, seed_inc = (F.max(F.when(F.col("seed"), F.col(c))) for c in ("len", "inc"))
    one, two = (mean_len, mean_inc) if center == "centroid" else (mean_len if scl == 0 else seed_len, seed_inc)
    return labelled.groupBy("label").agg(one.alias("center_len"), two.alias("center_inc"))


def with_symbols(model: DataFrame, kind: int | list[str] | None = 0) -> DataFrame:
    """``model`` with its symbol; the join is by label, of which there are as many as clusters."""
    n = (model.agg(F.max("label").alias("n")).first()["n"] or 0) + 1
    names = model.sparkSession.createDataFrame(list(enumerate(alphabet(n, kind))), "label int, symbol string")
    return model.join(names, "label")


def sequences(labelled: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """by..., symbols: in the order of pieces."""
    return labelled.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("piece_idx", "symbol"))).alias("s")).select(*by, F.col("s.symbol").alias("symbols"))


def symbol_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("symbol").agg(F.count("*").alias("n"))


def nearest(pieces: DataFrame, model: DataFrame, id_cols: tuple[str, ...] = ("series_id", "piece_idx")) -> DataFrame:
    """id_cols..., label: the center at the least unscaled distance, ties to the lowest label.

    Pieces stay where they are. Up to ``FEW`` centers travel as one array; more of them as k-d trees (``center_index``) of ``SLICE``
    centers each, 24 bytes a center, which a piece meets in turn. A model goes through the driver as a fit does: more than ``MOST`` centers are an error.
    """
    n = model.count()
    if n > MOST:
        raise ValueError(f"a model has at most {MOST} centers")
    if n > FEW:
        return _nearest_by_trees(pieces, model, id_cols)
    centers = model.agg(F.array_sort(F.collect_list(F.struct("label", "center_len", "center_inc"))).alias("m"))
    d2 = lambda c: F.pow(F.col("len") - c["center_len"], 2) + F.pow(F.col("inc") - c["center_inc"], 2)
    best = F.array_min(F.transform("m", lambda c: F.struct(d2(c).alias("d"), c["label"].alias("label"))))
    return pieces.crossJoin(F.broadcast(centers)).select(*id_cols, best["label"].alias("label"))  # one row


def _nearest_by_trees(pieces: DataFrame, model: DataFrame, id_cols: tuple[str, ...]) -> DataFrame:
    spark = pieces.sparkSession
    out = pieces.select(*id_cols, F.col("len").cast("double").alias("_x"), F.col("inc").cast("double").alias("_y"), F.lit(float("inf")).alias("_d"), F.lit(2**31 - 1).cast("long").alias("_label"))
    numbered = materialize(with_index(model.select("label", "center_len", "center_inc"), "label", name="_n"), "centers")
    for a in range(0, numbered.count(), SLICE):
        part = numbered.where((F.col("_n") >= a) & (F.col("_n") < a + SLICE)).toPandas()  # SLICE rows
        sent = spark.sparkContext.broadcast((part[["center_len", "center_inc"]].to_numpy(float), part["label"].to_numpy("int64")))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tree = None
            for batch in batches:
                tree = tree or CenterTree(*sent.value)
                at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y")], axis=1)
                found = tree.nearest(at, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_label")))
                new = dict(zip(("_d", "_label"), map(pa.array, found), strict=True))
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.select(*id_cols, F.col("_label").cast("int").alias("label"))


def quantize(coded: DataFrame, by: tuple[str, ...] = ("series_id",), clamp: bool = True) -> DataFrame:
    """coded(by..., piece_idx, len, inc) with integer ``steps``: rounded half to even, the error carried on; a 0 becomes 1 and is carried, too.

    Without ``clamp`` the last piece of a series keeps its 0, as the older inverse has it.
    """
    arrays = coded.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("piece_idx", "len", "inc"))).alias("p"))
    n = "rint(x.len + a.c)"
    whole = f"IF({n} = 0{'' if clamp else ' AND size(a.q) < size(p) - 1'}, 1D, {n})"
    step = f"(a, x) -> named_struct('c', x.len + a.c - {whole}, 'q', concat(a.q, array({whole})))"
    q = f"aggregate(p, named_struct('c', 0D, 'q', CAST(array() AS array<double>)), {step}, a -> a.q)"
    z = arrays.withColumn("q", F.expr(q)).select(*by, F.explode(F.arrays_zip("p", "q")).alias("z"))
    return z.select(*by, F.col("z.p.piece_idx").alias("piece_idx"), F.col("z.p.len").alias("len"), F.col("z.p.inc").alias("inc"), F.col("z.q").cast("long").alias("steps"))


def fit_last(quantized: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The last piece takes what is missing of blocks(by..., target_length) - 1 steps, but at least one."""
    q = quantized.join(blocks.select(*by, "target_length"), list(by))
    w = Window.partitionBy(*by)
    last = F.col("piece_idx") == F.max("piece_idx").over(w)
    want = F.greatest(F.lit(1), F.col("steps") + F.greatest(F.col("target_length") - 1, F.lit(1)) - F.sum("steps").over(w))
    return q.withColumn("steps", F.when(last, want).otherwise(F.col("steps"))).drop("target_length")


def ramps(quantized: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ("series_id",), range_rows: int | None = None, clamp: bool = True) -> DataFrame:
    """by..., t, value: each piece a line of its steps (at least one) from where the last one ended; blocks has the start.

    Without ``clamp`` a piece of less than one step has no points, and its increment is not made.

    ``range_rows``: pieces are summed up by ranges of so many, for series that are too long for a task; else by a window.
    """
    q = quantized.withColumn("steps", F.greatest("steps", F.lit(1))) if clamp else quantized.where("steps >= 1")
    if range_rows is None:
        w = Window.partitionBy(*by).orderBy("piece_idx").rowsBetween(Window.unboundedPreceding, -1)
        q = q.withColumn("t0", F.coalesce(F.sum("steps").over(w), F.lit(0))).withColumn("rise", F.coalesce(F.sum("inc").over(w), F.lit(0.0)))
    else:
        q = scans.scanned(q, sums={"t0": "steps", "rise": "inc"}, by=by, order="piece_idx", rows=range_rows)
    q = q.join(blocks.select(*by, "start"), list(by))
    line = q.select(*by, F.col("t0").alias("t0"), F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("k"), "steps", "inc", (F.col("start") + F.col("rise")).alias("base"))
    points = line.select(*by, (F.col("t0") + F.col("k")).alias("t"), (F.col("base") + F.col("inc") / F.col("steps") * F.col("k")).alias("value"))
    return points.unionByName(blocks.select(*by, F.lit(0).cast("long").alias("t"), F.col("start").alias("value")))


def block_info(series: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """by..., start (first value), target_length (points)."""
    return series.groupBy(*by).agg(F.min_by("value", "t").alias("start"), F.count("*").alias("target_length"))


def error(series: DataFrame, again: DataFrame) -> DataFrame:
    """One row: mse_micro over all points, mse_macro over series; both over the points that either side has."""
    d = series.join(again.withColumnRenamed("value", "v2"), ["series_id", "t"]).withColumn("e", F.pow(F.col("value") - F.col("v2"), 2))
    per = d.groupBy("series_id").agg(F.sum("e").alias("sse"), F.count("*").alias("n"))
    return per.agg((F.sum("sse") / F.sum("n")).alias("mse_micro"), F.avg(F.col("sse") / F.col("n")).alias("mse_macro"))
