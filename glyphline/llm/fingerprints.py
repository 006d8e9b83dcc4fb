"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band (rare and frequent terms say
little about near copies).  A document's distinct lexicon terms, sorted, are hashed once for each of
several random subsets of the lexicon, from half of it down to a 4096th, so that texts of any
length have subsets that keep one or a few of their terms.  An edit spares a subset the likelier the fewer
terms it keeps, so texts are compared by the sparsest subsets that either has, and denser ones count little.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shuffle_partitions
from ._words import Words, mix, slices

_INTEGERS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
#: Each subset keeps a term with probability 2**-power; most are sparse.
POWERS = tuple(p for p in range(1, 13) for _ in range(2 if p < 4 else 10 if p < 10 else 6))
#: So many of the subsets that either text has, the sparsest ones, count whole in their likeness; the others by ``DENSE`` each.
COMPARED, DENSE = 24, 1 / 16


def lexicon(docs: DataFrame, text_col: str = "text", low: float = 0.001, high: float = 0.05) -> np.ndarray:
    """Sorted hashes of the terms in at least ``low`` and at most ``high`` of all documents.

    Counts are exact and cover all documents: each task adds up its own, and Spark adds up the tasks' by term. No more
    than (mean distinct terms of a document) / low terms can be in the band, whatever the corpus. Null texts are empty;
    without documents there are no terms. Both edges of the band are in it.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_docs = texts.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, held, limit = [], [], 0, 1 << 22

        def add_up() -> tuple[np.ndarray, np.ndarray]:
            uniq, where = np.unique(np.concatenate(terms), return_inverse=True)
            return uniq, np.bincount(where, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                h = w.hashes()
                distinct = np.concatenate([np.unique(h[a:b]) for a, b in zip(w.off[:-1], w.off[1:], strict=True)])
                uniq, n = np.unique(distinct, return_counts=True)
                terms.append(uniq)
                counts.append(n)
                held += len(uniq)
                if held > limit:
                    uniq, n = add_up()
                    terms, counts, held = [uniq], [n], len(uniq)
                    limit = max(limit, 2 * held)
        if terms:
            uniq, n = add_up()
            for a in range(0, len(uniq), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(uniq[a : a + (1 << 17)].view(np.int64)), pa.array(n[a : a + (1 << 17)])], ["term", "n"])

    found = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    band = found.where((F.col("df") >= low * n_docs) & (F.col("df") <= high * n_docs)).select("term")
    return np.sort(np.asarray(band.toArrow().column("term"), np.int64).view(np.uint64))


def _draw(out: np.ndarray, owner: np.ndarray, value: np.ndarray) -> None:
    """Sets the subsets' hashes of the texts that are owners; value: their distinct terms."""
    n, some = len(out), np.unique(owner)
    for j, power in enumerate(POWERS):
        if j % 4 == 0:  # four subsets share a draw, 16 bits each
            draw = mix(value ^ mix(np.array([j // 4 + 1], np.uint64))[0])
        kept = (draw >> np.uint64(16 * (j % 4))) & np.uint64(0xFFFF) < np.uint64(1 << (16 - power))
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner[kept], mix(draw[kept]))
        low = (mix(total) >> np.uint64(32)).astype(np.uint32)
        out[some, j] = np.where(np.bincount(owner[kept], minlength=n) > 0, np.maximum(low, 1), 0)[some]


def subset_hashes(texts: pa.Array, terms: np.ndarray) -> np.ndarray:
    """[text, subset] 32-bit hashes, 0 where the subset has none of the text's terms.

    A text none of whose lexicon terms is in any subset draws the subsets from all its distinct words; one
    of so few words that no subset has any is hashed by all of them, in every subset.
    """
    w = Words(texts)
    h, n = w.hashes(), len(texts)
    text = np.repeat(np.arange(n), w.counts())
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    known = terms[at] == h if len(terms) else np.zeros(len(h), bool)
    out = np.zeros((n, len(POWERS)), np.uint32)
    pairs = np.unique(text[known] * max(len(terms), 1) + at[known])  # distinct and sorted in each text
    owner, term = np.divmod(pairs, max(len(terms), 1))
    _draw(out, owner, terms[term] if len(terms) else np.zeros(0, np.uint64))
    bare = np.flatnonzero((out == 0).all(1))
    sets = [np.unique(h[w.off[i] : w.off[i + 1]]) for i in bare]
    if len(bare):
        _draw(out, np.repeat(bare, [len(x) for x in sets]), np.concatenate(sets))
    for i, words in zip(bare, sets, strict=True):
        if not out[i].any():
            total = np.add.reduce(mix(words)) if len(words) else np.uint64(0)
            out[i] = np.maximum((mix(np.array([total], np.uint64)) >> np.uint64(32)).astype(np.uint32), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of subsets with equal hashes among those that either text has terms of, by weight: 1 if equal, below 1 if any differs."""
    either = (a > 0) | (b > 0)
    weight = np.where(np.cumsum(either[:, ::-1], 1)[:, ::-1] <= COMPARED, 1.0, DENSE) * either
    total = weight.sum(1)
    return ((a == b) * weight).sum(1) / np.where(total > 0, total, 1)


def _hex(rows: np.ndarray) -> list[str]:
    return [x.astype(">u4").tobytes().hex() for x in rows]


def fingerprint(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, fingerprint. Null texts are empty; equal texts get equal fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_chars"), pa.array(_hex(subset_hashes(part.column("text"), shared.value)), pa.string())], ["id", "n_chars", "fingerprint"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs(above, rank, id, text): ascending in above and rank, ids descend and rows of one id follow a hash of their text; those without an id come last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return docs.select(F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).alias("above"), rank.alias("rank"), F.col(id_col).alias("id"), text.alias("text"))


def _heads(ordered: DataFrame) -> list[tuple[int, int]]:
    """The first place (above, rank) of each of some runs of about as many rows, ascending; as many runs as there are tasks, times 4.

    Runs are cut by Spark's range partitioning of the places alone, so rows of one id are split by their texts. Whatever the cuts, each is a row's place, and the first is the first row's.
    """
    runs = ordered.select("above", "rank").repartitionByRange(4 * shuffle_partitions(ordered.sparkSession), "above", "rank")
    first = runs.groupBy(F.spark_partition_id().alias("run")).agg(F.min(F.struct("above", "rank")).alias("head")).select("head.*")
    return sorted((r["above"], r["rank"]) for r in first.collect())


def fingerprint_edits(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 2 code points replaced by the first as many (or all) of
    the next document in descending id; the first follows the last. Null texts are empty; rows with one id
    follow each other by a hash of their text, those without an id come last. Rows of one id and one text are
    put together before they are shuffled, and told apart again in the result. Ids are integers, since their order tells which
    document is next; others are a TypeError. Other columns are ignored. An empty table gives no rows.
    """
    if docs.schema[id_col].dataType.simpleString() not in _INTEGERS:
        raise TypeError(f"ids must be integers, not {docs.schema[id_col].dataType.simpleString()}")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its run, a run's first also behind the run before; equal rows of a batch as one."""
        z, at = zstandard.ZstdCompressor(level=1), heads.value
        for b in batches:
            same: dict[tuple, list] = {}
            for above, rank, id_, text in zip(*(b.column(c) for c in ("above", "rank", "id", "text")), strict=True):
                key = above.as_py(), rank.as_py(), id_.as_py()
                if key in same:
                    same[key][1] += 1
                else:
                    same[key] = [z.compress(text.as_py().encode()), 1]
            out = []
            for (above, rank, id_), (packed, times) in same.items():
                run_ = bisect.bisect_right(at, (above, rank)) - 1
                out.append((run_, False, above, rank, id_, times, packed))
                if at[run_] == (above, rank):
                    out.append(((run_ - 1) % len(at), True, above, rank, id_, 1, packed))
            if not out:
                continue
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), id_kind, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "extra", "above", "rank", "id", "times", "packed"])

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (id, text, next text, times)"""
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n, _ in rows]
        own, cut, after = (subset_hashes(pa.array(x, pa.large_string()), shared.value) for x in ([r[1] for r in rows], edited, [r[2] for r in rows]))
        told = pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], id_kind), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(_hex(own)), pa.array(_hex(cut)), pa.array(likeness(own, cut)), pa.array(likeness(own, after))],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        once = [i for i, r in enumerate(rows) if r[3] == 1]
        yield told.take(pa.array(once, pa.int64()))
        for i, r in enumerate(rows):
            for left in range(r[3], 0, -(1 << 12)) if r[3] > 1 else ():
                yield told.take(pa.array([i] * min(left, 1 << 12), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        last, done, rows, size = None, None, [], 0
        for b in batches:
            for part, extra, id_, times, packed in zip(*(b.column(c).to_pylist() for c in ("part", "extra", "id", "times", "packed")), strict=True):
                if done == part:
                    continue  # another row at the place of the following document
                text = z.decompress(packed).decode()
                if last is not None:
                    rows.append((last[0], last[1], text, 1))
                    size += len(last[1])
                if times > 1:  # all but the last are followed by their like
                    rows.append((id_, text, text, times - 1))
                    size += len(text)
                last, done = ((id_, text), None) if not extra else (None, part)
                if size > 1 << 20:
                    yield from flush(rows)
                    rows, size = [], 0
        if rows:
            yield from flush(rows)

    ordered = _ordered(docs, id_col, text_col)
    kind = ordered.schema["id"].dataType.simpleString()
    id_kind = _INTEGERS[kind]
    heads = spark.sparkContext.broadcast(_heads(ordered))  # a pair of numbers a run
    packed = ordered.mapInArrow(squeeze, f"part int, extra boolean, above long, rank long, id {kind}, times long, packed binary")
    sorted_ = packed.repartition("part").sortWithinPartitions("part", "extra", "above", "rank")
    out = sorted_.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
