"""The ``opN_<name>`` queries over the test tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, exact_dedup, fingerprints, hard_negatives, lm_scoring, mixing, near_dedup, packing, secrets, toxicity, url_filter, warc
from ._shared import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The fixed rules of op1_url_filter.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "copy", "copies", "shuffle_key", "text")


OP3_SQL = """
WITH stats AS (SELECT source, count(*) AS n_docs, sum(length(coalesce(text, ''))) AS n_chars FROM documents GROUP BY source),
weighted AS (SELECT source, n_chars, pow(n_chars::DOUBLE, 0.5) AS w FROM stats),
rates AS (SELECT source, CASE WHEN n_chars > 0 THEN round(w / (SELECT sum(w) FROM weighted) * (SELECT sum(n_chars) FROM weighted) / n_chars, 9) ELSE 0 END AS rate FROM weighted),
steps AS (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate)) + 31)::BIGINT)) AS k FROM rates WHERE rate > 0),
terms AS (SELECT source, k, exp(-rate + k * ln(rate) - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: ln(i::DOUBLE))), 0)) AS p FROM steps),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
counted AS (
  SELECT d.rid, count(*) AS copies
  FROM (SELECT row_number() OVER () AS rid, source, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents) d
  JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u GROUP BY d.rid),
docs AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents)
SELECT doc_id, source, copy::INTEGER AS copy, copies::INTEGER AS copies,
  ('0x' || substr(md5('17+:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key, text
FROM (SELECT doc_id, source, text, copies, unnest(range(0, copies)) AS copy FROM docs JOIN counted USING (rid))
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), size=4)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, sha256(text) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.fingerprint_edits(docs, fingerprints.lexicon(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT id, label, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS x FROM v),
s AS (SELECT a.id AS anchor_id, a.label AS al, b.id, b.label, sum(a.x * b.x)::BIGINT AS score FROM c a JOIN c b ON a.i = b.i WHERE a.id % 50 = 0 GROUP BY ALL),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = al AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND label <> al AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""


def multi_vocabulary(spark: SparkSession) -> byte_bpe.Vocabulary:
    import public_tokenizers

    return byte_bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = multi_vocabulary(spark)
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    said = tokens.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("ids_sha256", F.sha2(F.array_join("ids", ","), 256))
    return byte_bpe.decode(said, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=16, rounds=3, scale=64, dim=64)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sql(k: int, rounds: int) -> str:
    """Each round as tables of its own: t (id, number of the nearest centroid) and c (centroids)."""
    ctes = [
        """v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS MATERIALIZED (SELECT row, unnest(range(1, 65)) AS i, unnest(q) AS x FROM v)",
        f"""c0 AS MATERIALIZED (
  SELECT n, unnest(range(1, 65)) AS i, unnest(q) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS n, q FROM v) WHERE n < {k})""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT row, n, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{r} c USING (i) GROUP BY row, n)")
        ctes.append(f"t{r} AS MATERIALIZED (SELECT row, n, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, n) = 1)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT n, i, sum(x)::BIGINT AS s, count(*) AS w FROM t{r} JOIN x USING (row) GROUP BY n, i)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.n, i, CASE WHEN w IS NULL THEN x ELSE (s - ((s % w) + w) % w) // w END AS x FROM c{r} c LEFT JOIN s{r} USING (n, i))")
    return f"""WITH {", ".join(ctes)},
h AS (SELECT n, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY n),
w AS (SELECT n, sum(d)::BIGINT AS cluster_inertia FROM t{rounds} GROUP BY n)
SELECT vec_id, n::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM t{rounds}) AS inertia, centroid_sha256
FROM t{rounds} JOIN v USING (row) JOIN h USING (n) JOIN w USING (n)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_near_dedup": op4_near_dedup,
    "op5_secrets": op5_secrets,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op13_centroids": op13_sql(16, 3)}
