import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pyspark.sql import functions as F

from glyphline.llm import byte_bpe, centroids, hard_negatives
from glyphline.llm._shared import prepare

VECTORS = "vec_id long, label int, embedding array<double>, block string, n int, `a.b` int, rank int"


def table_of(spark, rows):
    """rows of (vec_id, label, vector), with more columns whose names are also used inside."""
    prepare(spark)
    return spark.createDataFrame([(*r, "x", 3, 4, 5) for r in rows], VECTORS)


def some_vectors(n, dim, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(0, 4)), (rng.normal(size=dim) * spread).tolist()) for i in range(n)]


ODD = [(None, 1, [1.0, 2.0]), (7001, None, [1.0, 2.0]), (7002, 1, None), (7003, 1, [1.0, None]), (7004, 2, [float("nan"), 1.0]), (7005, 2, [float("inf"), 1.0])]


def negatives_by_hand(rows, every=10, positives=5, negatives=3, low=50, high=95, scale=256):
    good = [(i, c, [math.floor(scale * x) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v in good:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, d) for j, d, w in good]
        for p, j, _ in sorted(s for s in score if s[2] == c and s[1] != i)[:positives]:
            fit = sorted((s, k) for s, k, d in score if d != c and low * -p <= 100 * -s <= high * -p)[:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["plain", "ties", "repeats", "wide", "far ids", "mixed lengths"])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(hard_negatives, "SLACK", 2)
    rows = some_vectors(240, 6, spread=0.3)
    if case == "ties":  # a third of the rows is one vector, with every label
        rows = [(i, c, v if i % 3 else [0.5, -0.25, 0.5, 0.125, 0.0, 0.75]) for i, c, v in rows] + [(1000 + i, i % 4, [0.4, -0.2, 0.4, 0.1, 0.0, 0.7]) for i in range(300)]
    if case == "repeats":
        rows = rows + rows[:40] + [rows[3]] * 30 + [(55, 2, [0.3] * 6)] * 40
    if case == "wide":
        rows = [(i, c, [x * 1e6 for x in v]) for i, c, v in rows]
    if case == "far ids":
        rows = [(i * 10 if i < 100 else (1 << 62) + i if i % 2 else -(1 << 62) - i, c, v if i % 4 else [0.5] * 6) for i, c, v in rows]
    if case == "mixed lengths":
        rows = [(i, c, v[: i % 7]) for i, c, v in rows]
    got = hard_negatives.mine(table_of(spark, [*rows, *ODD]).repartition(5), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)


def test_hard_negatives_of_nothing_and_of_one_label(spark):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows in (ODD, [(i, 1, [1.0, 2.0]) for i in range(30)], [(0, 1, [])]):
        got = hard_negatives.mine(table_of(spark, rows), F.col("vec_id") % 10 == 0)
        assert got.columns == columns and got.count() == 0


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 10**5, 2**27):
        a, b = (rng.integers(-top, top, (7, 40)) for _ in range(2))
        assert (hard_negatives.scores(a, b).astype(object) == a.astype(object) @ b.astype(object).T).all()


def clusters_by_hand(rows, k, rounds, scale, dim):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, _, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [q for _, q in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [min((far(q, x), n) for n, x in enumerate(c)) for _, q in kept]
        if turn < rounds:
            for n in range(len(c)):
                mine = [q for (_, q), (_, m) in zip(kept, own) if m == n]
                if mine:
                    c[n] = [sum(x) // len(mine) for x in zip(*mine)]
    total = collections.Counter()
    for d, n in own:
        total[n] += d
    return sorted((str(i), n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, own))


@pytest.mark.parametrize("case", ["plain", "ties", "wide", "huge", "few"])
def test_clusters_are_those_of_brute_force(spark, case):
    rows = some_vectors(5 if case == "few" else 300, 8)
    if case == "ties":
        rows = [(i, c, [round(x) / 64 for x in v]) for i, c, v in rows] + [(9000 + i, 0, [0.5] * 8) for i in range(200)] + [(None, 0, [0.25] * 8)] + [(4, 1, [0.5] * 8)] * 3
    if case == "wide":  # neighbours that float32 cannot tell apart
        rows = [(i, c, [1e5 + round(x) for x in v]) for i, c, v in rows]
    if case == "huge":  # squares that no long holds on the way
        rows = [(i, c, [2.0**25 + round(x) for x in v]) for i, c, v in rows]
    odd = [*ODD, (8000, 1, [1.0] * 7), (8001, 1, [1.0] * 9), (8002, 1, [])]
    got = centroids.cluster(table_of(spark, [*rows, *odd]).repartition(4), k=16, rounds=3, scale=64, dim=8)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == clusters_by_hand(rows, 16, 3, 64, 8)


def test_clusters_of_nothing(spark):
    for rows in ([], ODD):
        got = centroids.cluster(table_of(spark, rows), k=4, rounds=2, scale=64, dim=8)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_screening_leaves_the_nearest_in(monkeypatch):
    monkeypatch.setattr(centroids, "SLICE", 5)
    rng = np.random.default_rng(2)
    for shift, spread in ((0, 50), (10**5, 3), (3 * 10**6, 40), (2**40, 9)):
        v, c = (shift + rng.integers(-spread, spread, (n, 24)) for n in (200, 17))
        number, distance, again = centroids.nearest(v, c)
        d = ((v[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert (shift == 0) == (again < len(v) * 3)


def library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(spark):
    prepare(spark)
    return byte_bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_encoding_is_that_of_the_library(spark, vocabulary):
    rng = random.Random(3)
    late = byte_bpe.newer_characters()
    spans = [(32, 127), (0, 0x250), (0x3000, 0xD000), (0x10000, 0x11000), (0x1F300, 0x1F600), (0x2028, 0x2030)]
    texts = ["".join(rng.choice(late) if rng.random() < 0.05 else chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", None, " ", "\n\n \n", "a" * 200_000, "ab " * 70_000 + " " * 40_000 + "x", "it's 12345 don't", "⁇<unk>▁ ▁", "\x00\x1c\x85 ", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"tokens": F.lit(1), "a.b": F.lit("q"), "n_tokens": F.lit(2)}).repartition(5)
    coded = byte_bpe.encode(df, vocabulary)
    assert coded.columns == ["doc_id", "tokens", "a.b", "n_tokens", "ids"]
    enc = library()
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t or ""), repr(t)[:80]
    back = byte_bpe.decode(coded, vocabulary)
    assert back.columns == ["doc_id", "tokens", "a.b", "n_tokens", "bytes"]
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_encoding_of_empty_tables_and_wrong_ids(spark, vocabulary):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(none, vocabulary), vocabulary).columns == ["doc_id", "bytes"]
    assert byte_bpe.encode(none, vocabulary).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r.bytes) for r in byte_bpe.decode(ids, vocabulary).collect()} == {b""}
    with pytest.raises(ValueError):
        byte_bpe.encode(ids.withColumn("text", F.lit("a")), vocabulary)
    for wrong in ([10**8], [-1], [3, None]):
        with pytest.raises(Exception, match="an id is"):
            byte_bpe.decode(spark.createDataFrame([(1, wrong)], "doc_id long, ids array<int>"), vocabulary).collect()


def test_tokens_without_merges_and_bad_vocabularies(monkeypatch):
    # "abc" is a token that no merges lead to; "bc" is merged before "ab"
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abcd": 258, b"cd": 259}
    codec = byte_bpe.Codec(byte_bpe.model_bytes(ranks), sorted(ranks.values()), r"\w+|\W")
    enc = tiktoken.Encoding("small", pat_str=r"\w+|\W", mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 4)
    for t in ("abcd", "abc", "abcdabcd", "aabcdd bc ab", "dcba", "xabcdx"):
        assert codec.encode(t).tolist() == enc.encode_ordinary(t) and codec.decode(codec.encode(t)) == t.encode()
    for bad in ({b"a": 0}, ranks | {b"zz": 3}, ranks | {b"zz": 1 << 24}):
        with pytest.raises(ValueError):
            byte_bpe.model_bytes(bad)
