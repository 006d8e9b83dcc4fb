"""Packing token runs into windows by non-negative least squares over length combinations.

Lengths are put into bins of ``step`` tokens (rounded up).  Combinations of at most ``depth`` bins
that fill a window exactly are enumerated; non-negative least squares finds how often to repeat each
so that together they use up the histogram; the counts are rounded down and what is left is packed
greedily, bin by bin.  All this works on the histogram, whose size doesn't depend on the data: the
pieces themselves are ranked in their bins and joined with the plan on Spark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, shuffle_partitions

END_ID = 1
#: Blank runs of so many characters are left to ``tokenizers``: the pattern engine of ``tiktoken`` recurses in them.
LONG_BLANK = 50_000
#: Ranks are counted in at most so many chunks of each bin.
MOST_CHUNKS = 1024


def encoder(vocabulary: str):
    """The byte-level BPE of ``vocabulary`` as a function text -> ids; one for each Python worker.

    ``tiktoken`` gives the ids of ``tokenizers`` in a fifth of the time; texts with very long runs of blanks
    overflow its stack and go to ``tokenizers``.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    cache = encoder.__dict__.setdefault("made", {})
    if vocabulary not in cache:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        # the printable stand-ins that byte-level BPE files write for bytes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        enc = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names, plain = list(special), []

        def encode(text: str) -> list[int]:
            if len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in re.finditer(r"\s+", text)):
                if not plain:
                    plain.append(Tokenizer.from_file(vocabulary))
                return plain[0].encode(text, add_special_tokens=False).ids
            if any(x in text for x in names):
                return enc.encode(text, allowed_special="all")
            return enc.encode_ordinary(text)

        cache[vocabulary] = encode
    return cache[vocabulary]


def token_pieces(docs: DataFrame, vocabulary: str, window: int) -> DataFrame:
    """docs(id, text) -> id, start, length, ids_crc32, doc_tokens: full windows and a rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for a in range(0, len(ids), window):
                    piece = ids[a : a + window]
                    rows.append(i)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``depth`` bins that sum to ``bins``."""

    def of(rest: int, largest: int, depth: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif depth:
            for first in range(min(rest, largest), (rest - 1) // depth, -1):
                for tail in of(rest - first, first, depth - 1):
                    yield (first, *tail)

    return list(of(bins, bins, depth))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """min |a x - b| over x >= 0, by active sets: the most useful column enters, columns that turn negative leave."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    blocked: set[int] = set()
    scale = max(np.abs(b).max(initial=0), 1)
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        gain[list(blocked)] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance * scale:
            break
        active.append(j)
        while True:
            s = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[-1] <= 0 and active[-1] == j and x[j] == 0:  # the new column can't help, for rounding
                active.pop()
                blocked.add(j)
                break
            if (s > 0).all():
                x[:] = 0
                x[active] = s
                blocked.clear()
                break
            now = x[active]
            low = s <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.min(np.where(low, now / (now - s), np.inf))
            now = now + step * (s - now)
            now[low & (now < 1e-12 * scale)] = 0
            x[:] = 0
            x[active] = np.maximum(now, 0)
            kept = [k for k in active if x[k] > 0]
            if len(kept) == len(active):
                kept = [k for k, bad in zip(active, low, strict=True) if not bad]
                x[[k for k, bad in zip(active, low, strict=True) if bad]] = 0
            active = kept
            if not active:
                break
    return x


def plan_windows(histogram: dict[int, int], bins: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a window, how many such windows) that use up the histogram exactly."""
    left = np.zeros(bins + 1, np.int64)
    for k, n in histogram.items():
        left[k] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[bins]:
        out.append(((bins,), int(left[bins])))
        left[bins] = 0
    if left.any():
        shapes = [c for c in combinations(bins, depth) if all(left[k] for k in c)]
        if shapes:
            a = np.zeros((bins, len(shapes)))
            for j, c in enumerate(shapes):
                for k in c:
                    a[k, j] += 1
            for j in np.argsort(-(x := nnls(a, left[:bins].astype(float))), kind="stable"):
                use = np.unique(shapes[j], return_counts=True)
                n = int(min(np.floor(x[j] + 1e-9), (left[use[0]] // use[1]).min()))
                if n > 0:
                    out.append((shapes[j], n))
                    left[use[0]] -= n * use[1]
    while (held := np.flatnonzero(left)).size:  # the longest, then what fits best beside it, again and again
        shape, rest, free = [], bins, left.copy()
        while (fit := held[(held <= rest) & (free[held] > 0)]).size:
            k = int(fit[-1])
            shape.append(k)
            free[k] -= 1
            rest -= k
        use = np.unique(shape, return_counts=True)
        n = int((left[use[0]] // use[1]).min())
        out.append((tuple(shape), n))
        left[use[0]] -= n * use[1]
    return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, step: int = 8, depth: int = 3) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's (null: empty) and the end id 1. It is cut at every multiple of
    ``window`` and nowhere else; each piece gets a place in one sequence of at most ``window`` ids.
    Offsets run without gaps from 0. Rows with one id are documents of their own, null ids too. Which of
    the pieces of one bin gets which place follows their order in the input. An empty table gives no rows. Other columns are ignored.
    """
    spark, bins = docs.sparkSession, window // step
    chunks = min(shuffle_partitions(spark), MOST_CHUNKS)
    pieces = token_pieces(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), vocabulary, window)
    # numbered once and written with the number: equal pieces are told apart and spread over the chunks
    numbered = pieces.withColumn("bin", F.ceil(F.col("length") / step).cast("int")).withColumn("row", F.monotonically_increasing_id())
    pieces = materialize(numbered.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")), "pieces")
    sizes = pieces.groupBy("bin", "chunk").agg(F.count("*").alias("n")).toArrow().sort_by([("bin", "ascending"), ("chunk", "ascending")])  # at most bins x MOST_CHUNKS rows
    bin_, n = (np.asarray(sizes.column(c), np.int64) for c in ("bin", "n"))
    total = np.bincount(bin_, n, bins + 1).astype(np.int64)
    # of each chunk: the pieces of its bin in the chunks before
    sums = np.cumsum(n) - n
    before = pa.table({"bin": sizes.column("bin"), "chunk": sizes.column("chunk"), "before": pa.array(sums - (np.cumsum(total) - total)[bin_], pa.int64())})
    rows, sequence, used = [], 0, np.zeros(bins + 1, np.int64)
    for shape, many in plan_windows({k: int(total[k]) for k in np.flatnonzero(total).tolist()}, bins, depth):
        for slot, k in enumerate(shape):
            rows.append((k, int(used[k]), int(used[k]) + many, sequence, slot))
            used[k] += many
        sequence += many
    plan = spark.createDataFrame(rows, "bin int, low long, high long, sequence long, slot int")
    in_chunk = F.row_number().over(Window.partitionBy("bin", "chunk").orderBy("row")) - 1
    offsets = spark.createDataFrame(before) if len(bin_) else spark.createDataFrame([], "bin int, chunk int, before long")
    ranked = pieces.withColumn("at", in_chunk).join(F.broadcast(offsets), ["bin", "chunk"]).withColumn("rank", F.col("at") + F.col("before"))
    # the plan has a few rows for each of at most ``bins`` bins, whatever the data
    placed = ranked.alias("r").join(F.broadcast(plan.alias("p")), (F.col("r.bin") == F.col("p.bin")) & (F.col("r.rank") >= F.col("p.low")) & (F.col("r.rank") < F.col("p.high")))
    placed = placed.select("r.id", "r.start", "r.length", "r.ids_crc32", "r.doc_tokens", (F.col("p.sequence") + F.col("r.rank") - F.col("p.low")).alias("sequence_id"), "p.slot")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))
