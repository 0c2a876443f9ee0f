"""The corpus pipeline: toxic documents go, near duplicates are thinned, secrets masked, sources mixed, sequences packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. No stage but the
mix drops a document that its decision does not concern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_dedup, packing, secrets, toxicity
from tessera.llm.shared import fresh, save, workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold of a model fitted to the labelled ones among them."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return toxicity.score(docs, model, docs.columns, score).filter(F.col(score) < toxicity.REJECT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at five-word shingles and similarity 0.8: that of the least doc_id (null last), then the least hash.

    Rows are told apart by a hash of doc_id and text, so rows that share an id but not a text are documents of
    their own, and so are rows without an id. Of rows equal in both one stays. Rows without words are in no group and all stay.
    """
    key, least = fresh(docs, "_key"), "_least"
    d = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = d.filter(worded)
    found = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80)
    ids = rows.select(F.col(key).alias("key"), "doc_id").distinct()
    groups = found.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias(least))
    stay = first.select(F.col(f"{least}.key").alias(key))
    left = rows.join(stay, key, "left_semi").dropDuplicates([key, "doc_id"])
    return left.select(*docs.columns).unionByName(docs.filter(~worded))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Model scores, MinHash and tokenizers have no SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
