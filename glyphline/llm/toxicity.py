"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled rows gives the examples.  Terms and term prefixes that toxic examples
have far more often than others make the lexicon; their document frequencies are counted over all
documents.  The examples' vectors over the lexicon are indexed by term, in blocks that carry the
largest weight of each term; a query bounds each block, and evaluates blocks from the highest bound
until no block can reach the k-th best cosine.  Distance-weighted votes of these neighbours are
calibrated by the examples themselves, each left out in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import PUNCTUATION, Words, slices

#: Features of a term: itself (0) and its first bytes.
PREFIXES = (0, 4, 5, 6)


def term_features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all terms of all texts, and the text's number of each."""
    w = Words(part.column("text"), PUNCTUATION)
    text = np.repeat(np.arange(part.num_rows), w.counts())
    found = [w.hashes()]
    texts = [text]
    for k in PREFIXES[1:]:
        longer = (w.ends - w.starts) > k
        found.append(w.hashes(k, tag=k)[longer])
        texts.append(text[longer])
    return np.concatenate(found).view(np.int64), np.concatenate(texts)


def _feature_counts(examples: DataFrame) -> DataFrame:
    """examples(toxic, text) -> feature, toxic, n (texts that have it), counted in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f, text = term_features(part)
                toxic = np.asarray(part.column("toxic"))[text]
                both = np.unique(np.stack([f, text.astype(np.int64), toxic.astype(np.int64)]), axis=1) if len(f) else np.zeros((3, 0), np.int64)
                for label in (0, 1):
                    g, n = np.unique(both[0, both[2] == label], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), label, np.int32)), pa.array(n.astype(np.int64))], ["feature", "toxic", "n"])

    return examples.select("toxic", "text").mapInArrow(run, "feature long, toxic int, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n"))


def _lexicon_rows(docs: DataFrame, lexicon: np.ndarray, keep: list[str]) -> DataFrame:
    """docs(*keep, text) -> *keep, features, counts: the lexicon's features in each text; lexicon is sorted and bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                off, number, count = lexicon_counts(part, shared.value)
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32())) for x in (number, count)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *lists], [*keep, "features", "counts"])

    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}features array<int>, counts array<int>")


def lexicon_counts(part: pa.RecordBatch, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: offsets, the numbers of the lexicon's features it has, and how often.

    A text that has any has one feature more, behind the lexicon: its features in all, as a power of two. So a
    few chance hits in a long text point elsewhere than as many in a short one.
    """
    f, text = term_features(part)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, f), len(lexicon) - 1)
        hit = lexicon[at] == f
        pair, count = np.unique(text[hit] * (len(lexicon) + 1) + at[hit], return_counts=True)
        some = np.unique(text[hit])
        size = 2 ** np.rint(np.log2(np.bincount(text, minlength=part.num_rows)[some])).astype(np.int64)
        pair, count = np.concatenate([pair, some * (len(lexicon) + 1) + len(lexicon)]), np.concatenate([count, size])
        order = np.argsort(pair)
        (owner, number), count = np.divmod(pair[order], len(lexicon) + 1), count[order]
    else:
        owner = number = count = np.zeros(0, np.int64)
    return np.searchsorted(owner, np.arange(part.num_rows + 1)), number, count


@dataclass
class Index:
    """Unit vectors of examples by term, in blocks of examples."""

    idf: np.ndarray
    toxic: np.ndarray
    ids: list
    block: int
    #: Of each term: where its blocks begin; of each entry: block and the largest weight there.
    term_off: np.ndarray
    term_block: np.ndarray
    term_max: np.ndarray
    #: Of each example: where its terms begin; of each entry: term and weight.
    row_off: np.ndarray
    row_term: np.ndarray
    row_weight: np.ndarray

    @staticmethod
    def build(rows: list[tuple[object, int, list[int], list[int]]], idf: np.ndarray, block: int = 32) -> Index:
        """rows(id, toxic, features, counts), those without features left out."""
        rows = sorted((r for r in rows if r[2]), key=lambda r: (min(r[2]), len(r[2]), str(r[0])))  # alike in one block: tight bounds
        size = np.array([len(r[2]) for r in rows], np.int64)
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        term = np.array([f for r in rows for f in r[2]], np.int64)
        weight = (1 + np.log(np.array([c for r in rows for c in r[3]], float))) * idf[term] if len(term) else np.zeros(0)
        owner = np.repeat(np.arange(len(rows)), size)
        norm = np.sqrt(np.bincount(owner, weight * weight, len(rows)))
        weight = weight / norm[owner] if len(term) else weight
        at = owner // block
        order = np.lexsort((at, term))
        new = np.flatnonzero(np.r_[True, (term[order][1:] != term[order][:-1]) | (at[order][1:] != at[order][:-1])]) if len(term) else np.zeros(0, np.int64)
        first = order[new]
        return Index(idf, np.array([r[1] for r in rows], float), [r[0] for r in rows], block, np.searchsorted(term[first], np.arange(len(idf) + 1)), at[first], np.maximum.reduceat(weight[order], new) if len(term) else weight, off, term, weight)

    def query(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights."""
        q = (1 + np.log(counts)) * self.idf[features]
        return features, q / np.sqrt(q @ q)

    def nearest(self, features: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0 (ties: the first), exactly."""
        ranges = [slice(self.term_off[f], self.term_off[f + 1]) for f in features]
        bound = np.zeros(len(self.toxic) // self.block + 1)
        for r, w in zip(ranges, weights, strict=True):
            bound[self.term_block[r]] += w * self.term_max[r]
        dense = np.zeros(len(self.idf))
        dense[features] = weights
        todo = np.flatnonzero(bound > 0)
        todo = todo[np.lexsort((todo, -bound[todo]))]
        best, best_cos = np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(todo), 8):
            some = todo[start : start + 8]
            if len(best) == k and bound[some[0]] < best_cos[-1] - 1e-12:
                break
            for b in some:
                lo, hi = b * self.block, min((b + 1) * self.block, len(self.toxic))
                e0, e1 = self.row_off[lo], self.row_off[hi]
                cos = np.add.reduceat(dense[self.row_term[e0:e1]] * self.row_weight[e0:e1], self.row_off[lo:hi] - e0)
                best, best_cos = np.concatenate([best, np.arange(lo, hi)[cos > 0]]), np.concatenate([best_cos, cos[cos > 0]])
            order = np.lexsort((best, -np.round(best_cos, 12)))[:k]
            best, best_cos = best[order], best_cos[order]
        return best, best_cos

    def vote(self, near: np.ndarray, cos: np.ndarray, base: float, smooth: float = 0.5) -> float:
        w = 1 / (1.02 - np.minimum(cos, 1))
        w = w / w.max() if len(w) else w
        return float((w @ self.toxic[near] + smooth * base) / (w.sum() + smooth))


@dataclass
class Model:
    lexicon: np.ndarray
    index: Index
    k: int
    base: float
    #: Score of texts without features; and of votes, by their value.
    plain: float
    votes: np.ndarray
    scores: np.ndarray

    def score(self, features: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(features) or not len(self.index.toxic):
            return self.plain, np.zeros(0, np.int64), np.zeros(0)
        near, cos = self.index.nearest(*self.index.query(features, counts), self.k)
        return self.calibrated(self.index.vote(near, cos, self.base)), near, cos

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.scores)) if len(self.votes) else vote


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best increasing steps: neighbours that violate the order are pooled."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a2, b2, n2 = pools.pop()
            a1, b1, n1 = pools[-1]
            pools[-1] = [(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2]
    p = np.array(pools)
    return p[:, 0], np.clip((p[:, 1] * p[:, 2] + 0.5) / (p[:, 2] + 1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = 16384, max_terms: int = 4096, lift: float = 3.0, k: int = 25) -> Model:
    """The model; ``labels`` are the rows to learn from. At most ``max_examples`` of them, lowest in the
    hash of their id, are examples, and at most ``max_terms`` features are looked at: so the index, and
    all that reaches the driver, is bounded. Null labels or ids are left out; of several labels of an
    id the highest counts.
    """
    spark = docs.sparkSession
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    some = named.orderBy(F.xxhash64("id"), "id").limit(max_examples)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    examples = materialize(texts.join(F.broadcast(some), "id").select("id", "toxic", "text"), "examples")  # bounded by max_examples
    sizes = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    both = _feature_counts(examples).groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    p_rate, q_rate = (F.col("p") + 0.5) / (pos + 1), (F.col("q") + 0.5) / (neg + 1)
    spread = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    chosen = both.where((F.col("p") >= 3) & (p_rate >= lift * q_rate)).withColumn("z", F.log(p_rate / q_rate) / spread).where("z >= 2.5").orderBy(F.desc("z"), "feature").limit(max_terms)
    lexicon = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64))
    rows = [(r["id"], r["toxic"], r["features"], r["counts"]) for r in _lexicon_rows(examples, lexicon, ["id", "toxic"]).collect()]
    found = _lexicon_rows(texts, lexicon, []) if len(lexicon) else None
    df, total = np.zeros(len(lexicon) + 1), 0
    if found is not None:
        counted = found.select(F.explode_outer("features").alias("f"), F.lit(1).alias("n")).groupBy("f").count().collect()  # at most max_terms + 1 rows
        for r in counted:
            if r["f"] is not None:
                df[r["f"]] = r["count"]
        total = texts.count()
    idf = np.log((1 + total) / (1 + df)) + 1
    index = Index.build(rows, idf)
    base = (pos + 0.5) / (pos + neg + 1) if rows else 0.0
    none = [r[1] for r in rows if not r[2]]
    model = Model(lexicon, index, k, base, (sum(none) + base) / (len(none) + 1) if rows else 0.0, np.zeros(0), np.zeros(0))
    votes = []
    for i in range(len(index.toxic)):
        e = slice(index.row_off[i], index.row_off[i + 1])
        near, cos = index.nearest(index.row_term[e], index.row_weight[e], k + 1)
        others = near != i
        votes.append(index.vote(near[others][:k], cos[others][:k], base))
    if votes:
        model.votes, model.scores = _isotonic(np.array(votes), index.toxic)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted, neighbours (the nearest examples' id,
    cosine and label). Null and empty texts, and texts without any of the lexicon's terms, get the rate
    of toxic examples among those without them. Equal texts get equal scores. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, {}
        for batch in batches:
            for part in slices(batch, "text"):
                off, number, count = lexicon_counts(part, m.lexicon)
                scores, near = [], []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    key = (number[a:b].tobytes(), count[a:b].tobytes())
                    if key not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        s, who, cos = m.score(number[a:b], count[a:b])
                        seen[key] = s, [{"id": str(m.index.ids[i]), "cosine": float(c), "label": int(m.index.toxic[i])} for i, c in zip(who[:evidence], cos[:evidence], strict=True)]
                    s, n = seen[key]
                    scores.append(s)
                    near.append(n)
                kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(near, kind)], ["id", "score", "predicted", "neighbours"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(run, f"id {kind}, score double, predicted int, neighbours array<struct<id:string,cosine:double,label:int>>")
    return out.select(F.col("id").alias(id_col), "score", "predicted", "neighbours")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, in place: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, {}
        at = docs_columns.index(text_col)
        for batch in batches:
            for part in slices(batch, text_col):
                off, number, count = lexicon_counts(pa.RecordBatch.from_arrays([part.column(at)], ["text"]), m.lexicon)
                keep = []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    key = (number[a:b].tobytes(), count[a:b].tobytes())
                    if key not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[key] = m.score(number[a:b], count[a:b])[0] < threshold
                    keep.append(seen[key])
                yield part.filter(pa.array(keep, pa.bool_()))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)
