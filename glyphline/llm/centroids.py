"""Lloyd's clustering of integer vectors, exact to the last unit.

Distances to all centroids come from one float32 matrix product. Each has an interval that surely holds the true
value: a product of d terms is off by at most (d + 2) u / (1 - (d + 2) u) times the product of the two lengths (u =
2**-24; two roundings are of the factors), whatever the order of the sum. Centroids whose interval begins above the
smallest interval's end are out; where more than one is left their distances are computed anew with integers, and of
equal ones the smallest number counts. Centroids are means rounded down, of exact sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from ._vectors import load, matrix, pack

#: Centroids of one product, and the most components of all centroids: they travel to every task (8 bytes each).
SLICE, MOST = 1024, 1 << 24


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row; in Python's integers where a long might not hold them."""
    top = (int(np.abs(a).max(initial=0)) + int(np.abs(b).max(initial=0))) ** 2 * max(a.shape[1], 1)
    kind = np.int64 if top < 2**63 else object
    d = a.astype(kind) - b.astype(kind)
    return (d * d).sum(axis=1) if d.size else np.zeros(len(d), np.int64)


def screen(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[row, centroid]: whether the centroid can be the nearest one."""
    u, d = 2.0**-24, v.shape[1] + 2
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (v.astype(np.float32) @ c.astype(np.float32).T).astype(float)
        nc = np.square(c.astype(float)).sum(axis=1)
        reach = np.sqrt(np.square(v.astype(float)).sum(axis=1))[:, None] * np.sqrt(nc)[None, :]
        # the second term is for what float64 itself rounds here
        off = (2 * d * u / (1 - d * u) * reach + (4 + v.shape[1]) * 2.0**-52 * (nc + 2 * reach)) * (1 + 1e-9)
        about = nc - 2 * dot  # without the vector's own square, which all have
        return ~(about - off > (about + off).min(axis=1, initial=np.inf)[:, None])  # what is not a number stays


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid's number of each vector, its squared distance, and how many distances were computed with integers to tell."""
    number, distance, again = np.zeros(len(v), np.int64), None, 0
    for a in range(0, len(c), SLICE):
        part = c[a : a + SLICE]
        row, col = np.nonzero(screen(v, part))
        d = squared(v[row], part[col])
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        again += len(row) - len(start)
        least = np.minimum.reduceat(d, start)
        hit = np.flatnonzero(d == np.repeat(least, np.diff(np.r_[start, len(row)])))
        first = hit[np.unique(row[hit], return_index=True)[1]]  # columns rise within a row
        better = slice(None) if distance is None else least < distance
        distance = least if distance is None else np.where(better, least, distance)
        number[better] = (col[first] + a)[better]
    return number, distance, again


def seeds(blocks: DataFrame, k: int, prefix: str = "1:") -> np.ndarray:
    """The k kept vectors of the smallest sha256 of ``prefix`` and the id, in that order; of one hash, in the order of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks_ in batches:
            for data in blocks_.column("block"):
                b = load(data.as_py())
                q, ids = matrix(b), b.column("id").to_pylist()
                hashed = sorted((hashlib.sha256(f"{prefix}{'' if i is None else i}".encode()).hexdigest(), q[n].tolist()) for n, i in enumerate(ids))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in hashed], pa.string()), pa.array([x for _, x in hashed], pa.list_(pa.int64()))], ["hash", "q"])

    top = blocks.select("block").mapInArrow(run, "hash string, q array<long>").orderBy("hash", "q").limit(k).collect()  # k rows
    return np.array([r["q"] for r in top], np.int64).reshape(len(top), -1 if top else 0)


def move(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids replaced by the exact rounded-down means of the vectors next to them; those without any stay."""
    sent, dim = blocks.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        count, total = np.zeros(len(c), object), np.zeros((len(c), dim), object)
        for blocks_ in batches:
            for data in blocks_.column("block"):
                q = matrix(load(data.as_py())).astype(np.int64)
                number = nearest(q, c)[0]
                order = np.argsort(number, kind="stable")
                own, start = np.unique(number[order], return_index=True)
                wide = int(np.abs(q).max(initial=0)) * len(q) >= 2**63
                total[own] += np.add.reduceat(q[order].astype(object) if wide else q[order], start, axis=0)
                count[own] += np.diff(np.r_[start, len(q)])
        used = np.flatnonzero(count)
        cells = [pa.array(np.repeat(used, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(used)), pa.int32()), pa.array([int(x) for x in total[used].ravel()], pa.decimal128(38)), pa.array(np.repeat(count[used], dim).astype(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(cells, ["cluster", "i", "s", "n"])

    sums = blocks.select("block").mapInArrow(run, "cluster int, i int, s decimal(38,0), n long").groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each component of a centroid
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    sent.destroy()
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, scale: float, dim: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vectors(id, vector) -> id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Vectors with ``dim`` components, none null or not finite, are kept, as floor(scale * x); repeated rows and ids count
    each, rows without an id are kept (their hash is of no digits). With fewer than k kept vectors there are as many
    centroids as vectors, with none an empty result. Other columns are left out. The centroids go through the driver: k * dim numbers, at most
    ``MOST``. A row is never sent anywhere: a round is a pass over blocks that sends k * dim sums from each task.
    """
    if k * dim > MOST:
        raise ValueError(f"at most {MOST} components of centroids")
    kind = vectors.schema[id].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    blocks = materialize(pack(rows, scale, dim), "vectors")
    c = seeds(blocks, k)
    for _ in range(rounds if len(c) else 0):
        c = move(blocks, c)
    sent = blocks.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks_ in batches:
            for data in blocks_.column("block"):
                b = load(data.as_py())
                number, distance, _ = nearest(matrix(b).astype(np.int64), sent.value)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(number, pa.int32()), pa.array([int(x) for x in distance] if distance.dtype == object else distance, pa.int64())], ["id", "cluster", "distance"])

    found = materialize(blocks.select("block").mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = [(n, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for n, x in enumerate(c.tolist())]
    hashes = blocks.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    inertia = each.agg(F.sum("cluster_inertia")).first()[0]
    totals = each.join(hashes, "cluster").withColumn("inertia", F.lit(inertia).cast("long"))  # k rows
    return found.join(F.broadcast(totals), "cluster").select(F.col("id").cast(kind).alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
