"""Blocks of integer vectors: many rows of a table as one binary value, which tasks multiply as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a block.
BLOCK = 4096


def dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def matrix(batch: pa.RecordBatch, column: str = "q") -> np.ndarray:
    """[row, component] of a column of lists of one length."""
    kind = batch.schema.field(column).type
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, kind.list_size)


def quantized(vectors: pa.Array, scale: float, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors without null or non-finite components (and of ``dim`` components), and floor(scale * x) of those.

    Shorter vectors are filled with 0. Integers of 2**62 and more are an error: no long could hold their products.
    """
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    good = (size >= 0) if dim is None else size == dim
    good[row[~np.isfinite(flat)]] = False
    take = good[row]
    row, flat = row[take], np.floor(scale * flat[take])
    if np.abs(flat).max(initial=0) >= 2.0**62:
        raise ValueError("a component is too large for integer scores")
    keep = np.flatnonzero(good)
    width = int(size[keep].max(initial=0)) if dim is None else dim
    first = np.cumsum(np.maximum(size, 0) * good) - np.maximum(size, 0) * good
    out = np.zeros((len(keep), width), np.int64)
    out[np.searchsorted(keep, row), np.arange(len(row)) - first[row]] = flat.astype(np.int64)
    return keep, out


def pack(rows: DataFrame, scale: float, dim: int | None = None, size: int = BLOCK) -> DataFrame:
    """rows(vector, others...) -> block (the kept rows' other columns and ``q``), n, peak (largest squared length, rounded up)."""

    def block(columns: dict[str, list[pa.Array]], q: list[np.ndarray]) -> pa.RecordBatch:
        width = max(x.shape[1] for x in q)
        q = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in q])
        small = np.int16 if np.abs(q).max(initial=0) < 2**15 else np.int64
        lists = pa.FixedSizeListArray.from_arrays(pa.array(q.astype(small).ravel()), width) if width else pa.array([[]] * len(q), pa.list_(pa.int16(), 0))
        batch = pa.RecordBatch.from_arrays([*(pa.chunked_array(v).combine_chunks() for v in columns.values()), lists], [*columns, "q"])
        peak = float(np.square(q.astype(float)).sum(axis=1).max(initial=0)) * (1 + 1e-9)
        return pa.RecordBatch.from_arrays([pa.array([dump(batch)], pa.binary()), pa.array([len(q)], pa.int64()), pa.array([peak], pa.float64())], ["block", "n", "peak"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, q, n = {}, [], 0
        for batch in batches:
            at, values = quantized(batch.column("vector"), scale, dim)
            for a in range(0, len(at), size):
                for name in batch.schema.names:
                    if name != "vector":
                        columns.setdefault(name, []).append(batch.column(name).take(pa.array(at[a : a + size])))
                q.append(values[a : a + size])
                n += len(q[-1])
                if n >= size:
                    yield block(columns, q)
                    columns, q, n = {}, [], 0
        if n:
            yield block(columns, q)

    return rows.mapInArrow(run, "block binary, n long, peak double")
