"""MinHash near-dedup with tensored banding.

A text's set is its distinct shingles of ``size`` words.  Two collections of ``halves`` half keys
(``rows`` minhashes each) are computed; a table key is a pair of one half key of either, so
``halves**2`` tables of ``2 * rows`` minhashes cost ``2 * halves * rows`` minhashes instead of
``2 * rows * halves**2``.  A pair of half keys can only meet in a table where each half meets, so
half keys that one set alone has are dropped before pairs are formed.  With the defaults a link of
similarity 0.8 is missed with probability 8e-5, one of 0.85 with 5e-6.

Candidates never are all pairs of a bucket: a round joins each bucket to one pivot, checks the full
sets, and contracts what is linked; only sets that stay apart in a bucket meet again (other pivots,
then an exact prefix filter over their sets), so large groups of near copies cost a few links for
each member, and sets that share no more than a frequent passage cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import Words, mix, shingles, slices

HALVES, ROWS = 10, 2
#: A set with more than this part of all rows is hot; so there are fewer hot sets than this.
HOT = 1000


def _sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and offsets."""
    w = Words(part.column("text"))
    h, off = shingles(w.hashes(), w.off, size)
    sets = [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    return np.concatenate(sets) if sets else h, np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def signatures(docs: DataFrame, size: int, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """docs(id, text) -> id, n, set_a, set_b (128 bits that name the set), keys (2 * halves half keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240607)
        mul = rng.integers(1, 2**63, 2 * halves * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, 2 * halves * rows, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                h, off = _sets(part, size)
                n = np.diff(off)
                full = np.flatnonzero(n)
                at = off[:-1][full]
                set_a, set_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys = np.zeros((len(full), 2 * halves), np.uint64)
                if len(full):
                    set_a[full] = np.add.reduceat(mix(h), at)
                    set_b[full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for k in range(2 * halves):
                        for r in range(k * rows, (k + 1) * rows):
                            x = h * mul[r] + add[r]
                            low = np.minimum.reduceat(x ^ (x >> np.uint64(31)), at)
                            keys[:, k] = mix(keys[:, k] + low + np.uint64(k + 1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * halves, 0))]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), lists], ["id", "n", "set_a", "set_b", "keys"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, set_a long, set_b long, keys array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(id, text) -> id, hashes: the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, off = _sets(part, size)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h.view(np.int64)))], ["id", "hashes"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, hashes array<long>")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, comp: the smallest node that each node reaches, by minimum labels with pointer jumps."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    comp = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "components")
    while True:
        near = both.join(comp.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = comp.join(near, "node").select("node", F.least("comp", "m").alias("new"), F.col("comp").alias("old"))
        up = comp.select(F.col("node").alias("new"), F.col("comp").alias("up"))
        step = materialize(step.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("comp"), "old"), "components")
        comp = step.select("node", "comp")
        if step.where("comp <> old").isEmpty():
            return comp


def _shared_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key more than one row has; counted before the shuffle, so hot keys are no load."""
    return df.join(df.groupBy(*keys).count().where("count > 1").select(*keys), list(keys), "left_semi")


def _with_sets(rows: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """rows(set_a, set_b, n, ...) with the values of sets(set_a, set_b, n, size, ...); rows of hot sets aren't shuffled."""
    keys, hot = ["set_a", "set_b", "n"], F.col("size") * HOT > total
    few = sets.where(hot).drop("size")  # fewer than HOT
    others = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(sets.where(~hot).drop("size"), keys)
    return rows.join(F.broadcast(few), keys).unionByName(others)


def _by_prefix(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets(id, n, hashes, comp) of different components that can be links: (a, n_a, b, n_b).

    In an order from rare to frequent hashes, linked sets share one of their first
    n - percent * n + 1 hashes, and after the shared places enough is left for the overlap: so sets
    that have no more than a frequent passage in common are never paired. No link is lost.
    """
    each = sets.select("id", "n", "comp", F.explode("hashes").alias("h"))
    each = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h")
    each = each.withColumn("at", F.row_number().over(Window.partitionBy("id", "n").orderBy("df", "h")))
    each = each.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1))
    x, y = (each.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "comp", "at"))) for s in "ab")
    overlap = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b")))
    pairs = x.join(y, "h").where((F.col("id_a") < F.col("id_b")) & (F.col("comp_a") != F.col("comp_b")) & near)
    return pairs.select(F.col("id_a").alias("a"), "n_a", F.col("id_b").alias("b"), "n_b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Sets are linked when 100 * intersection >= percent * union. component_id is the smallest id that
    a row reaches over links, itself included; kept where it is the row's own id. A text without words
    (or null) has the empty set and is linked with nothing. Rows with one id are one node with
    the links of all of them. Rows with a null id are linked with nothing and have a null component_id and
    kept true. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = materialize(signatures(texts, size, halves, rows), "signatures")
    real = sig.where("n > 0 and id is not null")
    # each set once, under its smallest id
    sets = real.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("id", "keys")).alias("first"), F.count("*").alias("size"))
    sets = materialize(sets.select("set_a", "set_b", "n", F.col("first.id").alias("rep"), F.col("first.keys").alias("keys"), "size"), "distinct")
    total = sets.agg(F.sum("size")).first()[0] or 0
    members, named = real.select("id", "set_a", "set_b", "n"), sets.select("set_a", "set_b", "n", "rep", "size")
    own = sets.select(F.col("rep").alias("id"), "n", F.posexplode("keys").alias("k", "half"))
    meet = _shared_keys(own, "k", "half")
    pairs = meet.groupBy("id", "n").agg(F.collect_set(F.struct("k", "half")).alias("h"))
    first, second = F.expr(f"filter(h, x -> x.k < {halves})"), F.expr(f"filter(h, x -> x.k >= {halves})")
    pairs = pairs.select("id", "n", F.explode(first).alias("x"), second.alias("y")).select("id", "n", "x", F.explode("y").alias("y"))
    keyed = pairs.select("id", "n", F.xxhash64("x.k", "x.half", "y.k", "y.half").alias("key"))
    buckets = materialize(_shared_keys(keyed, "key"), "buckets")
    known = materialize(full_sets(texts.where("id is not null").join(buckets.select("id").distinct(), "id", "left_semi"), size).select("id", F.size("hashes").alias("n"), "hashes"), "sets").where("n > 0")

    def linked(tried: DataFrame) -> DataFrame:
        """Which of the pairs tried(a, n_a, b, n_b) are links, by their full sets."""
        small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        p = tried.where((F.col("a") != F.col("b")) & (100 * small >= percent * large)).select("a", "n_a", "b", "n_b").distinct()
        p = p.join(known.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b")), ["b", "n_b"])
        p = p.join(known.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a")), ["a", "n_a"])
        p = p.withColumn("both", F.size(F.array_intersect("h_a", "h_b")))
        return p.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")

    def with_pivot(rows_: DataFrame, order) -> DataFrame:
        pivots = rows_.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n")).alias("p"))
        return rows_.join(pivots, "key").select(F.col("p.id").alias("a"), F.col("p.n").alias("n_a"), F.col("id").alias("b"), F.col("n").alias("n_b"))

    links = materialize(linked(with_pivot(buckets, F.lit(0))), "links")
    twice = members.join(members.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi")  # one id with several rows
    twice = materialize(_with_sets(twice, named, total).select("id", "rep").distinct(), "repeated")
    links = links.unionByName(twice.join(twice.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b")))
    comp = components(links)
    for turn in range(1, 4):
        apart = buckets.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        apart = materialize(apart, "apart")
        mixed = apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        apart = materialize(apart.join(mixed, "key", "left_semi"), "apart")
        if turn < 3:
            tried = with_pivot(apart, F.xxhash64("id", F.lit(turn)))
        else:
            tried = _by_prefix(known.join(apart.select("id", "comp").distinct(), "id"), percent)
        found = materialize(linked(tried), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            comp = components(links)
    named = materialize(named.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "named")
    of = _with_sets(members, named, total).groupBy("id").agg(F.min("comp").alias("comp"))
    out = sig.select("id", "n").join(of, "id", "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, with all their columns."""
    gone = near_dedup(docs, id_col, text_col, **how).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
