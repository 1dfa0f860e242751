"""A corpus pipeline of five of the operators: clean documents in, packed training windows out.

Stages run one after another on what the one before kept; each result is written as Parquet
in the shared checkpoint folder and read again, so a lost executor never reaches further back
than its stage. All stages but the last return the columns of their input.

Defined cases are those of the operators; rows with a NULL doc_id pass the near-duplicate stage,
and rows that share a doc_id go there only if all of them would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm import exact_dedup, near_dups, packing, personal_data
from carelens.llm import toxicity as toxic_segments
from carelens.llm.common import in_fold, saved, ship, small_batches
from carelens.llm.queries import tokenizer

#: The stages cannot be expressed in SQL (learned models, MinHash, tokenizer); tests use brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; learned from the labels outside the held-out fold."""
    small_batches(ship(spark))
    known = ~in_fold("doc_id", 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic_segments.without_toxic(spark, docs, toxic_segments.learned(spark, docs.filter(known), labels.filter(known)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text."""
    return exact_dedup.without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies."""
    small_batches(ship(spark))
    said = near_dups.near_duplicates(spark, docs).groupBy(F.col("doc_id").alias("gone")).agg(F.max("kept").alias("kept"))
    gone = said.filter("NOT kept AND gone IS NOT NULL").select("gone")
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("gone"), "left_anti")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the name of its kind; n_chars follows."""
    small_batches(ship(spark))
    out = personal_data.redacted(spark, docs, personal_data.learned(spark, docs))
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in fixed windows."""
    small_batches(ship(spark))
    return packing.packed_pieces(docs, tokenizer("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("personal_data", private_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(spark, stage(spark, docs, sf_dir), name)
    return docs
