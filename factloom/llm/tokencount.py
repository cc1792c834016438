"""Token counts from a cache of digests: a text is encoded once per tokenizer version.

A text's key is the SHA-256 of its normal form, the tokenizer's that of the library's name and the
very bytes of the model file. Counts known under both come from the cache; of the others each distinct text is encoded
once, in the tasks that hold it, and the counts are appended to the cache.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize, shared_dir, text_or_empty

CACHE = "tokenizer string, digest binary, n_tokens bigint"
#: At most so many missing digests (32 bytes each) are sent to all tasks; more are joined by shuffle.
BROADCAST_MISSES = 200_000


@dataclass(frozen=True)
class TokenCounter:
    """A tokenizer file as bytes: what is digested is what encodes, on every executor alike."""

    model: bytes
    library: str

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        """``tokenizers`` for .json, ``sentencepiece`` for .model."""
        libraries = {".json": "tokenizers", ".model": "sentencepiece"}
        if Path(path).suffix not in libraries:
            raise ValueError(f"no library for {path}")
        return cls(Path(path).read_bytes(), libraries[Path(path).suffix])

    @property
    def version(self) -> str:
        return hashlib.sha256(self.library.encode() + b"\0" + self.model).hexdigest()

    def normal_form(self, text: Column) -> Column:
        """What of a text can't change its count: sentencepiece itself writes spaces as U+2581, so the two are one."""
        return F.replace(text, F.lit("▁"), F.lit(" ")) if self.library == "sentencepiece" and _plain_spaces(self) else text

    def counts(self, texts: list[str]) -> list[int]:
        return _loaded(self)(texts)


@functools.lru_cache(4)
def _piece_processor(counter: TokenCounter):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=counter.model)


def _plain_spaces(counter: TokenCounter) -> bool:
    """Whether a space and U+2581 are the same to the model, whatever stands around them."""
    encode = _piece_processor(counter).encode
    return all(encode(t) == encode(t.replace("▁", " ")) for t in ("▁", "a ▁ b", "▁▁a", "a▁", "a▁b ▁▁ c\n▁"))


@functools.lru_cache(4)
def _loaded(counter: TokenCounter):
    """A function from texts to their numbers of tokens, without added special tokens, cuts or padding."""
    if counter.library == "sentencepiece":
        encode = _piece_processor(counter).encode
        return lambda texts: [len(ids) for ids in encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(counter.model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def encode_counts(texts: DataFrame, counter: TokenCounter, together: int = 64) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text), ``together`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            for k in range(0, len(batch), together):
                counts += counter.counts(batch.column(1)[k : k + together].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


def read_cache(spark: SparkSession, path: str, counter: TokenCounter) -> DataFrame | None:
    """(digest, n_tokens) of this tokenizer version; None where nothing has been stored.

    Two jobs that met the same text at the same time stored it twice, with the same count.
    """
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return stored.where(F.col("tokenizer") == counter.version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _distinct_misses(keyed: DataFrame, missing: DataFrame | None) -> DataFrame:
    """(digest, text): one text of each digest in ``missing`` (None: of all).

    Copies are merged in the task that reads them, before the shuffle, so a text that a third of all rows
    have crosses it once per task.
    """
    rows = keyed.select("digest", "text")
    few = missing is not None and missing.limit(BROADCAST_MISSES + 1).count() <= BROADCAST_MISSES
    if few:
        rows = rows.join(F.broadcast(missing), "digest", "left_semi")
    texts = rows.groupBy("digest").agg(F.first("text").alias("text"))
    return texts if few or missing is None else texts.join(missing, "digest", "left_semi")


def count_tokens(docs: DataFrame, counter: TokenCounter, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of each row of ``docs``.

    docs: doc_id (any type; may be null or repeat) and text (null counts as empty: 0 bytes and 0 tokens); other columns are ignored. Each
    row of the input gives one. ``cache`` is a folder of Parquet files that driver and executors share and that grows
    by the distinct texts it lacked; without one the cache starts empty in the folder of ``spark.checkpoint.dir``. An append
    that is lost half-way leaves right counts only, and what is missing is encoded again. An empty table gives no rows and
    appends nothing.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/factloom/token-cache-{uuid.uuid4().hex}"
    text = text_or_empty()
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(counter.normal_form(text), 256)).alias("digest"))
    rows = materialize(keyed.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest"), "digests")
    digests = materialize(rows.groupBy("digest").agg(F.count("*").alias("copies")), "distinct-digests")
    stored = read_cache(spark, cache, counter)
    missing = None if stored is None else materialize(digests.select("digest").join(stored, "digest", "left_anti"), "missing-digests")
    if missing is None or missing.limit(1).count():
        fresh = encode_counts(_distinct_misses(keyed, missing), counter)
        fresh.select(F.lit(counter.version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = materialize(digests.join(read_cache(spark, cache, counter), "digest"), "known-counts")
    counted = join_counted(rows, known, ["digest"], "copies", rows.count(), "inner")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
