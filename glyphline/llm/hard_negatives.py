"""Hard negatives by distributed radix selection.

An anchor is scored against all rows, in blocks: a block of anchors meets every block of rows as two binary values
that are multiplied as integer matrices. Nothing of the scores leaves the task but histograms. A window is an
anchor with an interval of scores, and asks for its first k rows, by falling score and then by rising id. Each pass cuts a
window's interval into buckets and counts them, only down to the bucket of the block's own kth row, since the kth of
all rows is not below it. The bucket that holds the kth row is the next pass's interval. When few rows are
left, or buckets are of one score, which is then cut by ids in the same way, a last pass gathers the rows that qualify,
and no others. An anchor's own window over the rows of its label gives its positives, each of which is a
window over the other labels' rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from ._vectors import dump, load, matrix, pack

#: Buckets of a pass, and rows beyond those asked for that may be gathered with them.
BUCKETS, SLACK = 256, 16
#: Anchors of a block, and those multiplied at a time with a block of rows.
ANCHORS, AT_ONCE = 1024, 256
#: Bytes of rows that one copy of the anchors is sent to.
GROUP_BYTES = 128 << 20
STATE = "akey long, w int, high long, lo long, hi long, id_lo long, id_hi long, by_id boolean, need long, done boolean"


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: float32 or float64 where these hold every partial sum, else whole numbers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(width, 1)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def _near(anchors: pa.RecordBatch, rows: pa.RecordBatch, same: bool, gather: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(position of the anchor, slot of its window, score, row id) of all rows of a block in some window's interval, for some anchors at a time."""
    column = lambda b, c: b.column(c).to_numpy(zero_copy_only=False)
    a_id, a_label, r_id, r_label = (column(b, c) for b in (anchors, rows) for c in ("id", "label"))
    aq, rq = matrix(anchors), matrix(rows)
    lo, high = (matrix(anchors, c) for c in ("lo", "high" if gather else "hi"))
    for s in range(0, len(a_id), AT_ONCE):
        part = slice(s, s + AT_ONCE)
        score = scores(aq[part], rq)
        ok = (a_label[part, None] == r_label[None, :]) == same
        if same:
            ok &= a_id[part, None] != r_id[None, :]
        ok &= (score >= lo[part].min(axis=1)[:, None]) & (score <= high[part].max(axis=1)[:, None])
        at, row = np.nonzero(ok)
        value, ids = score[at, row].astype(np.int64), r_id[row]
        at = at + s
        for slot in range(lo.shape[1]):
            m = (value >= lo[at, slot]) & (value <= high[at, slot])
            yield at[m], np.full(int(m.sum()), slot), value[m], ids[m]


def _windows(anchors: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: matrix(anchors, c) for c in ("w", "lo", "hi", "id_lo", "id_hi", "by_id", "need")}


def _count(anchors: pa.RecordBatch, rows: pa.RecordBatch, same: bool) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets of each window, from the best on, until they hold as many rows as it needs."""
    akey, win = anchors.column("akey").to_numpy(), _windows(anchors)
    for at, slot, value, ids in _near(anchors, rows, same, gather=False):
        own = {c: v[at, slot] for c, v in win.items()}
        by_id = own["by_id"] > 0
        keep = ~by_id | ((ids >= own["id_lo"]) & (ids <= own["id_hi"]))
        at, slot, value, ids, by_id = at[keep], slot[keep], value[keep], ids[keep], by_id[keep]
        own = {c: v[keep] for c, v in own.items()}
        # unsigned differences are right even where signed ones would overflow
        low, top = (np.where(by_id, own[i], own[s]).astype(np.uint64) for i, s in (("id_lo", "lo"), ("id_hi", "hi")))
        width = (top - low) // np.uint64(BUCKETS) + np.uint64(1)
        bucket = (np.where(by_id, ids.astype(np.uint64) - low, top - value.astype(np.uint64)) // width).astype(np.int64)
        code, first, n = np.unique(at * BUCKETS + bucket, return_index=True, return_counts=True)
        owner = code // BUCKETS
        new = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
        before = np.cumsum(n) - n
        before -= np.maximum.accumulate(np.where(new, before, 0)) if len(n) else 0
        use = before < own["need"][first]
        first, n, step, width, by_id = first[use], n[use], (code % BUCKETS)[use].astype(np.uint64), width[first[use]], by_id[first[use]]
        low, top = low[first], top[first]
        # a bucket's own interval; its far end is within the window's
        left = top - low - step * width
        span = np.minimum(width - np.uint64(1), left)
        near = np.where(by_id, low + step * width, top - step * width)
        far = np.where(by_id, near + span, near - span)
        b_lo, b_hi = np.where(by_id, near, far).astype(np.int64), np.where(by_id, far, near).astype(np.int64)
        cells = [akey[at[first]], own["w"][first].astype(np.int32), step.astype(np.int32), b_lo, b_hi, n]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["akey", "w", "bucket", "b_lo", "b_hi", "n"])


def _gather(anchors: pa.RecordBatch, rows: pa.RecordBatch, same: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a block that qualify for a window whose bounds are known."""
    akey, win = anchors.column("akey").to_numpy(), _windows(anchors)
    for at, slot, value, ids in _near(anchors, rows, same, gather=True):
        own = {c: v[at, slot] for c, v in win.items()}
        m = (value > own["lo"]) | (own["by_id"] == 0) | (ids <= own["id_hi"])
        yield pa.RecordBatch.from_arrays([pa.array(akey[at[m]]), pa.array(own["w"][m].astype(np.int32)), pa.array(value[m]), pa.array(ids[m])], ["akey", "w", "score", "id"])


def _packed_anchors(windows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Windows with their anchors as blocks; an anchor's windows, a few, are lists of one length."""
    fields = ["w", "high", "lo", "hi", "id_lo", "id_hi", "by_id", "need"]
    each = windows.withColumn("by_id", F.col("by_id").cast("long")).groupBy("akey").agg(F.collect_list(F.struct(*fields)).alias("ws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ws = t.column("ws").to_pylist()
            slots = max(map(len, ws))
            none = {f: 0 for f in fields} | {"lo": 1, "high": 0, "hi": 0}  # an interval without scores
            q = t.column("q").to_pylist()
            width = max(map(len, q))
            lists = {f: pa.FixedSizeListArray.from_arrays(pa.array([w[f] for x in ws for w in (*x, *[none] * (slots - len(x)))], pa.int64()), slots) for f in fields}
            flat = pa.array(np.array([x + [0] * (width - len(x)) for x in q], np.int64).ravel())
            lists["q"] = pa.FixedSizeListArray.from_arrays(flat, width) if width else pa.array([[]] * len(q), pa.list_(pa.int64(), 0))
            plain = {c: t.column(c).combine_chunks() for c in ("akey", "id", "label")}
            data = dump(pa.RecordBatch.from_arrays([*plain.values(), *lists.values()], [*plain, *lists]))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["anchors"])

        for batch in batches:
            for s in range(0, batch.num_rows, ANCHORS):
                held.append(batch.slice(s, ANCHORS))
                if sum(b.num_rows for b in held) >= ANCHORS:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return each.join(anchors, "akey").select("akey", "id", "label", "q", "ws").mapInArrow(run, "anchors binary")


def _meet(windows: DataFrame, anchors: DataFrame, blocks: DataFrame, groups: int, same: bool, step, schema: str) -> DataFrame:
    """``step`` of every block of anchors with every block of rows.

    Rows are dealt to ``groups`` and each group gets the anchors, so these are copied once for some ``GROUP_BYTES`` of
    rows and not for each block. A pair is two bounded values; what is made of it is small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("anchors"), batch.column("block"), strict=True):
                yield from step(load(a.as_py()), load(b.as_py()), same)

    copies = _packed_anchors(windows, anchors).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = blocks.select("group", "block").repartition(groups, "group")
    return dealt.join(copies.repartition(groups, "group"), "group").select("anchors", "block").mapInArrow(run, schema)


def select_first(windows: DataFrame, anchors: DataFrame, blocks: DataFrame, groups: int, ids: tuple[int, int], same: bool, k: int) -> DataFrame:
    """windows(akey, w, lo, hi) -> akey, w, rank, id, score: each window's first k rows of its anchor's label, or of others."""
    start = windows.where("lo <= hi").select("akey", "w", F.col("hi").alias("high"), "lo", "hi", F.lit(ids[0]).cast("long").alias("id_lo"), F.lit(ids[1]).cast("long").alias("id_hi"), F.lit(False).alias("by_id"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("done"))
    state, done = materialize(start, "windows"), None
    while not state.isEmpty():
        counts = _meet(state, anchors, blocks, groups, same, _count, "akey long, w int, bucket int, b_lo long, b_hi long, n long").groupBy("akey", "w", "bucket", "b_lo", "b_hi").agg(F.sum("n").alias("n"))
        # at most BUCKETS rows of a window
        summed = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("akey", "w").orderBy("bucket")))
        found = summed.join(state, ["akey", "w"])
        first = F.struct("bucket", "b_lo", "b_hi", "upto", "n")
        at = found.groupBy("akey", "w", "high", "lo", "hi", "id_lo", "id_hi", "by_id", "need").agg(F.min(F.when(F.col("upto") >= F.col("need"), first)).alias("b"))
        cut = F.col("b").isNotNull()  # else all rows of the interval are asked for
        one = F.col("b.b_lo") == F.col("b.b_hi")
        enough = ~cut | (F.col("b.upto") <= F.col("need") + SLACK) | (F.col("by_id") & one)
        by_score, by_id = cut & ~F.col("by_id"), cut & F.col("by_id")
        bound = lambda side: (F.when(by_score, F.col(f"b.b_{side}")).otherwise(F.col(side)).alias(side), F.when(by_id, F.col(f"b.b_{side}")).otherwise(F.col(f"id_{side}")).alias(f"id_{side}"))
        (lo, id_lo), (hi, id_hi) = bound("lo"), bound("hi")
        new = at.select("akey", "w", "high", lo, hi, id_lo, id_hi, (F.col("by_id") | (by_score & one & ~enough)).alias("by_id"), F.when(enough, F.col("need")).otherwise(F.col("need") - (F.col("b.upto") - F.col("b.n"))).alias("need"), enough.alias("done"))
        new = materialize(new, "windows")
        ready = new.where("done")
        done = ready if done is None else done.unionByName(ready)
        state = new.where("not done")
    if done is None:
        return windows.sparkSession.createDataFrame([], "akey long, w int, rank int, id long, score long")
    rows = _meet(done, anchors, blocks, groups, same, _gather, "akey long, w int, score long, id long").groupBy("akey", "w", "score", "id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("akey", "w").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k)
    # repeated rows count each
    return ranked.select("akey", "w", F.explode(F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("n"), F.lit(k)).cast("int"))).alias("rank"), "id", "score")


def _anchors(blocks: DataFrame) -> DataFrame:
    """akey, id, label, q, top (no score of the anchor is beyond it) of the rows marked as anchors."""
    peak = blocks.agg(F.max("peak")).first()[0] or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("block"):
                b = load(data.as_py())
                b = b.filter(b.column("anchor"))
                q = matrix(b).astype(np.int64)
                top = np.minimum(np.sqrt(np.square(q.astype(float)).sum(axis=1) * peak) * (1 + 1e-9) + 1, 2.0**62).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(q.tolist(), pa.list_(pa.int64())), pa.array(top)], ["id", "label", "q", "top"])

    found = blocks.select("block").mapInArrow(run, "id long, label long, q array<long>, top long")
    return materialize(found.withColumn("akey", F.monotonically_increasing_id()), "anchors")


def mine(vectors: DataFrame, anchors: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256) -> DataFrame:
    """vectors(id, label, vector) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says which rows are anchors. A row's score is its inner product with the anchor, of components floor(scale * x).
    Positives are the first rows of the anchor's label whose id is not its own; negatives of each the first of other labels with
    low * positive <= 100 * negative <= high * positive. Higher scores come first, then smaller ids. Rows with a null id, label,
    vector or component, or one that is not finite, take no part; shorter vectors count as filled with 0. Repeated rows count
    each, as rows and as anchors. Labels and ids are integers. Other columns are left out. Scores must fit into a long.
    """
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor")).where("id is not null and label is not null")
    spark = vectors.sparkSession
    blocks = materialize(pack(rows, scale).withColumn("key", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    size = blocks.agg(F.sum(F.length("block"))).first()[0] or 0
    groups = max(4 * spark.sparkContext.defaultParallelism, size // GROUP_BYTES + 1)
    blocks = blocks.withColumn("group", F.pmod("key", F.lit(groups)).cast("int"))
    known = _anchors(blocks)
    ids = rows.agg(F.min("id"), F.max("id")).first()
    ids = (ids[0] or 0, ids[1] or 0)
    every = known.select("akey", F.lit(0).alias("w"), (-F.col("top")).alias("lo"), F.col("top").alias("hi"))
    near = materialize(select_first(every, known, blocks, groups, ids, True, positives), "positives")
    # one window for each positive: the least and the largest whole score of its interval
    share = lambda p, up: F.expr(f"{'-' if up else ''}floor(cast({'-' if up else ''}score as decimal(20,0)) * {p} / 100)").cast("long")
    windows = near.select("akey", F.col("rank").alias("w"), share(low, True).alias("lo"), share(high, False).alias("hi"))
    hard = select_first(windows, known, blocks, groups, ids, False, negatives)
    out = hard.select("akey", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(near.select("akey", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["akey", "w"])
    return out.join(known.select("akey", F.col("id").alias("anchor_id")), "akey").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
