"""Generated points and series, and readers of runs and of archives of series."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import with_index


def points(spark: SparkSession, n: int, kind: str = "uniform", seed: int = 0) -> DataFrame:
    """id, x, y: uniform in the unit square; blobs around (.2|.8, .2|.8); a jittered grid; wide blobs around (+-2, +-2)."""
    r = spark.range(n)
    a, b = F.rand(seed), F.rand(seed + 1)
    x, y = F.randn(seed + 2), F.randn(seed + 3)
    if kind == "uniform":
        return r.select("id", a.alias("x"), b.alias("y"))
    if kind in ("blobs", "wide"):
        lo, hi, s = (0.2, 0.8, 0.05) if kind == "blobs" else (-2.0, 2.0, 0.3)
        at = lambda v: F.when(v < 0.5, lo).otherwise(hi)
        return r.select("id", (at(a) + s * x).alias("x"), (at(b) + s * y).alias("y"))
    if kind == "grid":
        side = max(int(n**0.5), 1)
        return r.select("id", ((F.col("id") % side) / side + 0.01 * x).alias("x"), (F.floor(F.col("id") / side) / side + 0.01 * y).alias("y"))
    raise ValueError("kind must be uniform, blobs, wide or grid")


def series(spark: SparkSession, n: int, kind: str = "example", seed: int = 0, many: int = 1) -> DataFrame:
    """series_id, t, value: gaussian, random_walk, seasonal, or the example sin(x) + .15 cos(3x) on [0, 8 pi]."""
    r = spark.range(many).withColumnRenamed("id", "series_id").join(spark.range(n).withColumnRenamed("id", "t"))
    z, t = F.randn(seed), F.col("t") / max(n - 1, 1)
    if kind == "random_walk":
        return r.withColumn("z", z).withColumn("value", F.sum("z").over(Window.partitionBy("series_id").orderBy("t"))).drop("z")
    value = {"gaussian": z, "seasonal": F.sin(t * 80 * F.pi()) + 0.5 * F.sin(t * 13 * F.pi()) + 0.35 * z, "example": F.sin(t * 8 * F.pi()) + 0.15 * F.cos(3 * t * 8 * F.pi())}
    if kind not in value:
        raise ValueError(f"kind must be random_walk or one of {sorted(value)}")
    return r.withColumn("value", value[kind])


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runs from CSV with a header; "", None and nan are null."""
    raw = spark.read.csv(path, header=True, nullValue="", mode="PERMISSIVE")
    kinds = [x.strip().split() for x in schema.split(",")]
    return raw.select(*(F.when(~F.col(n).isin("None", "nan"), F.col(n)).try_cast(k).alias(n) for n, k in kinds))


def write_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    runs.write.mode(mode).csv(path, header=True)


def read_baselines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``schema``; without such a path there are none, and lines that are no JSON are left out."""
    try:
        return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_baselines(rows: DataFrame, path: str) -> None:
    """Written whole beside ``path``, then put in its place: a reader never sees a part of them, but for a moment may find none."""
    spark, new = rows.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.json(new)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(at(path), True)
    if not files.rename(at(new), at(path)):
        raise OSError(f"{new} cannot be renamed to {path}")


def read_arff(spark: SparkSession, *paths: str) -> DataFrame:
    """sample_id, dim_id, t, value, target of relational ARFF files, one after the other; a missing value (?) is 0.

    A data line is 'ch0 v,v,..\\nch1 v,v,..',target: channels apart by an escaped line break.
    """
    if not paths:
        raise ValueError("at least one path is needed")
    lines = None
    for i, path in enumerate(paths):
        part = spark.read.text(path).withColumn("file", F.lit(i)).withColumn("line", F.monotonically_increasing_id())
        lines = part if lines is None else lines.unionByName(part)
    rows = lines.where("trim(value) <> '' and value rlike \"^\\\\s*['\\\"]\"")
    body = F.regexp_extract("value", "^\\s*['\"](.*)['\"]\\s*,", 1)
    rows = with_index(rows, "file", "line", name="sample_id").select("sample_id", body.alias("body"), F.trim(F.regexp_extract("value", "['\"]\\s*,\\s*([^,'\"]*)$", 1)).alias("target"))
    dims = rows.select("sample_id", "target", F.posexplode(F.split("body", r"\\n")).alias("dim_id", "channel"))
    return dims.select("sample_id", "dim_id", "target", F.posexplode(F.split("channel", ",")).alias("t", "v")).select("sample_id", "dim_id", F.col("t").cast("long").alias("t"), F.coalesce(F.expr("try_cast(trim(v) AS double)"), F.lit(0.0)).alias("value"), "target")


def joint_series(tensor: DataFrame, dims: int) -> DataFrame:
    """(sample_id, dim_id, t, value) -> series_id = sample_id * dims + dim_id."""
    return tensor.select((F.col("sample_id") * dims + F.col("dim_id")).alias("series_id"), "t", "value")
