"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, fingerprints, licenses, mixing, packing, periodic, pii, quality, simhash, spelling, tokencount, toxicity, urls
from .common import read_table
from .twins import TWINS


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), **tokenizer_files())


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(read_table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts, base, all_found = F.transform("base", lambda p: p["start"]), F.col("base"), F.col("detections")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.label_list(base).alias("base_labels"), licenses.label_list(base, all_found).alias("labels"), "score",
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in pii.KINDS if k.base]))
    return found.select("doc_id", *[count(k.name) for k in pii.KINDS if k.base], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counter = tokencount.TokenCounter.of(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), counter)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted_words(read_table(spark, sf_dir, "documents"), misspelt=97))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.with_planted_periods(read_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_packing, op2_fingerprints, op3_embeddings, op4_simhash, op5_licenses, op6_quality, op7_toxicity, op8_pii, op9_mixing, op10_urls, op11_token_counts, op12_spelling_variants, op13_periodic_runs, *TWINS)}
#: None of the thirteen can be stated in DuckDB whole; tests/llm holds each against a plain version. Parts of four can.
ORACLE_SQL: dict[str, str] = {f.__name__: sql for f, sql in TWINS.items()}
