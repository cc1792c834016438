"""A corpus pipeline of the training-data operators: each stage is written as Parquet and
reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import mixing, packing, pii, simhash, toxicity
from factloom.llm.common import materialize, read_table
from factloom.llm.queries import tokenizer_files


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go; rows without an id can't be told apart and stay."""
    scored = toxicity.score_toxicity(docs, read_table(spark, sf_dir, "labels"))
    rejected = scored.where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id, and one row of it."""
    return simhash.one_of_each(docs, simhash.similar_documents(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets."""
    return pii.redact_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens."""
    return packing.pack_documents(docs, **tokenizer_files())


STAGES = [
    ("toxicity", reject_toxic),
    ("SimHash near-dedup", near_duplicates),
    ("PII", private_data),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained scores, fingerprint groups and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
