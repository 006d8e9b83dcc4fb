"""Fit one alphabet for many series, encode others with it, and decode symbols."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import with_index
from ..operators import aggregate, compress, prepare, symbols
from ..storage import materialize, prepare as ship


@dataclass
class SymbolicEncoder:
    """Parameters of joint symbolic encoding. ``strategy``: greedy, two_stage (with ``blocks``), grid or kmeans (with ``k``).

    Without ``alpha``, or with ``auto_digitize``, alpha balances both errors; ``eta`` is then 0.01 for one series and 2e-6
    for several, unless given. ``partition`` cuts each series into so many blocks, which are compressed apart and share the
    alphabet; without it ``partition_rate`` cuts into round(exp(1 / rate)) * n_jobs. ``center`` is seed or centroid; k-means
    has centroids.
    """

    tol: float = 0.5
    alpha: float | None = 0.5
    sorting: str = "2-norm"
    strategy: str = "greedy"
    blocks: int = 4
    k: int = 8
    scl: float = 1.0
    center: str = "seed"
    max_len: float = float("inf")
    fill: str = "ffill"
    alphabet: int | list[str] | None = 0
    engine: str = "arrow"
    seed: int = 0
    partition: int | None = None
    partition_rate: float | None = None
    n_jobs: int = 1
    auto_digitize: bool = False
    eta: float | None = None

    @property
    def cuts(self) -> int | None:
        """Blocks of each series, at most one a point; None: series are not cut."""
        if self.partition is not None:
            return max(int(self.partition), 1)
        return None if self.partition_rate is None else max(round(math.exp(1 / self.partition_rate)) * self.n_jobs, 1)

    @property
    def by(self) -> tuple[str, ...]:
        return ("series_id",) if self.cuts is None else ("series_id", "block_id")

    def split(self, series: DataFrame) -> DataFrame:
        """``series``, with block_id if series are cut; t counts a series' points from 0."""
        return series if self.cuts is None else prepare.split_interval(series, self.cuts)

    def pieces(self, series: DataFrame) -> DataFrame:
        return compress.compress(prepare.fill_missing(self.split(series), self.fill, self.by), self.tol, self.max_len, self.by, self.engine)

    def info(self, series: DataFrame) -> DataFrame:
        """What ``inverse`` needs beside symbols: by..., start (of the filled values), target_length."""
        return symbols.block_info(prepare.fill_missing(self.split(series), self.fill, self.by), self.by)

    def _balanced(self, series: DataFrame, pieces: DataFrame) -> SymbolicEncoder:
        size = series.agg(F.count("*").alias("n"), F.min("series_id").alias("low"), F.max("series_id").alias("high")).first()
        eta = self.eta or (0.01 if size["low"] == size["high"] else 0.000002)
        return replace(self, alpha=compress.auto_alpha(pieces, size["n"], self.tol, eta, self.scl).first()["alpha"])

    def fit(self, series: DataFrame) -> EncoderModel:
        """Pools the pieces of all series, scales and clusters them. Series of fewer than two points have no pieces."""
        ship(series.sparkSession)
        p = with_index(self.pieces(series), *self.by, "piece_idx", name="id")
        p = materialize(compress.scaled_points(p, self.scl), "points")
        if self.strategy != "kmeans" and (self.alpha is None or self.auto_digitize):
            return self._balanced(series, p)._digitize(p)
        return self._digitize(p)

    def _digitize(self, p: DataFrame) -> EncoderModel:
        if self.strategy == "kmeans":
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.feature import VectorAssembler

            k = max(1, min(self.k, p.select("x", "y").distinct().count()))
            v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(p)
            labels = KMeans(k=k, seed=self.seed).fit(v).transform(v).select("id", F.col("prediction").alias("label"))
        elif self.strategy == "grid":
            labels = aggregate.grid_components(p, self.alpha).select("id", "label")
        elif self.strategy == "two_stage":
            labels = aggregate.two_stage(p, self.alpha, self.blocks, self.sorting).select("id", "label", "seed")
        else:
            labels = aggregate.greedy(p, self.alpha, self.sorting).select("id", "label", "seed")
        if "seed" not in labels.columns:
            labels = labels.withColumn("seed", F.row_number().over(Window.partitionBy("label").orderBy("id")) == 1)
        labelled = materialize(p.join(labels, "id"), "labelled")
        center = "centroid" if self.strategy == "kmeans" else self.center
        model = materialize(symbols.with_symbols(symbols.model_of(labelled, center, self.scl), self.alphabet), "model")
        return EncoderModel(self, labelled.join(model.select("label", "symbol"), "label"), model)

    def fit_transform(self, series: DataFrame) -> DataFrame:
        return self.fit(series).sequences()


@dataclass
class EncoderModel:
    params: SymbolicEncoder
    labelled: DataFrame
    model: DataFrame

    def sequences(self) -> DataFrame:
        """by..., symbols of the fitted series; by is series_id, and block_id if series are cut."""
        return symbols.sequences(self.labelled, self.params.by)

    def transform(self, series: DataFrame) -> DataFrame:
        """by..., symbols of unseen series: nearest centers of their pieces."""
        by = self.params.by
        near = symbols.nearest(self.params.pieces(series), self.model, (*by, "piece_idx")).join(self.model.select("label", "symbol"), "label")
        return symbols.sequences(near, by)

    def inverse(self, coded: DataFrame, series_info: DataFrame, fit_length: bool = True, fix_last: bool = True, clamp: bool = True) -> DataFrame:
        """coded(by..., symbols) and series_info(by..., start, target_length) -> series_id, t, value.

        Blocks follow one another, each as long as it came out. ``fit_length`` cuts or pads to target_length, after ``fix_last`` has stretched the last piece towards it; without
        both the lengths are those of the symbols alone. Without ``clamp``, too, this is the older inverse: a last piece that rounds to 0 steps has no points.
        """
        if fix_last and not clamp:
            raise ValueError("fix_last gives the last piece a step at least: it needs clamp")
        by = self.params.by
        c = coded.select(*by, F.posexplode("symbols").alias("piece_idx", "symbol")).join(self.model.select("symbol", F.col("center_len").alias("len"), F.col("center_inc").alias("inc")), "symbol")
        steps = symbols.quantize(c, by, clamp)
        again = symbols.ramps(symbols.fit_last(steps, series_info, by) if fix_last else steps, series_info, by, clamp=clamp)
        again = prepare.fit_length(again, series_info.select(*by, F.col("target_length").alias("n")), by) if fit_length else again
        if len(by) == 1:
            return again
        before = Window.partitionBy("series_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
        begins = again.groupBy(*by).agg((F.max("t") + 1).alias("n")).select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
        return again.join(begins, list(by)).select("series_id", (F.col("begin") + F.col("t")).alias("t"), "value")


@dataclass
class TensorCode:
    """What ``compress_tensor`` leaves: the model, symbols by sample, and what the way back needs."""

    model: EncoderModel
    symbols: DataFrame
    info: DataFrame
    stats: DataFrame | None
    width: int | None


def compress_tensor(encoder: SymbolicEncoder, tensor: DataFrame, width: int | None = None, adjust: bool = True) -> TensorCode:
    """tensor(sample_id, t, value), or with dim_id and ``width`` points in each dimension: then a sample's dimensions follow one another.

    ``adjust`` normalizes each position over all samples (a deviation of 0 counts as 1) before encoding.
    """
    t = F.col("dim_id") * width + F.col("t") if width else F.col("t")
    series = tensor.select(F.col("sample_id").cast("long").alias("series_id"), t.cast("long").alias("t"), F.col("value").cast("double").alias("value"))
    stats = None
    if adjust:
        std = F.stddev_pop("value")
        stats = materialize(series.groupBy("t").agg(F.avg("value").alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std")), "columns")
        series = series.join(stats, "t").select("series_id", "t", ((F.col("value") - F.col("mean")) / F.col("std")).alias("value"))
    series = materialize(series, "tensor")
    model = encoder.fit(series)
    return TensorCode(model, symbols.sequences(model.labelled), symbols.block_info(series), stats, width)


def decompress_tensor(code: TensorCode, as_bytes: bool = True) -> DataFrame:
    """sample_id, t, value, with dim_id if the tensor had it; such values become bytes with ``as_bytes``."""
    again = code.model.inverse(code.symbols, code.info)
    as_bytes = as_bytes and code.width is not None
    if code.stats is not None:
        again = prepare.denormalize(again, code.stats, as_bytes=as_bytes)
    elif as_bytes:
        again = again.withColumn("value", F.pmod(F.rint("value").cast("long"), F.lit(256)).cast("double"))
    if code.width is None:
        return again.withColumnRenamed("series_id", "sample_id")
    return again.select(F.col("series_id").alias("sample_id"), F.floor(F.col("t") / code.width).cast("int").alias("dim_id"), (F.col("t") % code.width).alias("t"), "value")


def encode_one(spark: SparkSession, values: list[float], encoder: SymbolicEncoder | None = None) -> tuple[EncoderModel, list[str]]:
    """One short series from the driver, by default with two k-means symbols: its model and its symbols."""
    series = spark.createDataFrame([(0, t, None if v is None else float(v)) for t, v in enumerate(values)], "series_id long, t long, value double")
    model = (encoder or SymbolicEncoder(tol=0.2, strategy="kmeans", k=2)).fit(series)
    row = symbols.sequences(model.labelled).first()
    return model, row["symbols"] if row else []
