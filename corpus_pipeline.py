"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

toxicity drops the documents it rejects, exact_dedup and near_dedup leave one document of each
group, mixing repeats documents so that sources reach their target weights, packing gives the pieces
of token windows. Each stage is written as Parquet and read again as the next one's documents.
Null texts count as empty: of several, one stays. Rows without an id are documents like others. Without documents there are no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphline.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from glyphline.llm._shared import materialize, prepare
from glyphline.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; labels of any of them may be learned from."""
    prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest id."""
    prepare(spark)
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order."""
    prepare(spark)
    return mixing.mix_sources(docs, names=("_mix_copy", "_mix_copies", "_mix_key")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL has neither the classifier nor the tokenizer; tests hold exact and near duplicates against brute force, toxicity and mixing against their operators, packing against its own counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
    return docs
