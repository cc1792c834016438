"""Token counts against the library itself, with a cache and without."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import queries, tokencount
from factloom.llm.tokencount import TokenCounter, count_tokens

SF = "/root/testdata/sf0.001"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, n_bytes string, digest int, tokenizer string"
TEXTS = [None, "", " ", "▁", " ▁ a▁b", "   a b", "<s> x </s><unk>", "a\0b\x01", "\U0001f600 é <|endoftext|>", "word " * 50_000, "x" * 200_000, "word " * 50_000]


def library_counts(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        return [len(encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if k == 3 else k // 2, t, "x", 1, "y") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def as_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


@pytest.mark.parametrize("path", [PIECES, WORDS])
def test_counts_are_the_librarys(spark, odd, path):
    counts = library_counts(path, TEXTS)
    want = sorted((k == 3, 0 if k == 3 else k // 2, len((t or "").encode()), n, n > 4096) for k, (t, n) in enumerate(zip(TEXTS, counts, strict=True)))
    assert as_rows(count_tokens(odd, TokenCounter.of(path))) == want
    assert count_tokens(spark.createDataFrame([], SCHEMA), TokenCounter.of(path)).count() == 0


def test_query_on_the_smallest_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    counts = library_counts(PIECES, [t for _, t in rows])
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op11_token_counts(spark, SF).collect()}
    assert got == {d: (len((t or "").encode()), n, n > 4096) for (d, t), n in zip(rows, counts, strict=True)}


@pytest.mark.parametrize("few", [True, False])
def test_only_distinct_misses_are_encoded(spark, odd, tmp_path, monkeypatch, few):
    monkeypatch.setattr(tokencount, "BROADCAST_MISSES", 1000 if few else 0)
    cache, counter = str(tmp_path / "cache"), TokenCounter.of(PIECES)
    first = as_rows(count_tokens(odd, counter, cache))
    stored = lambda: spark.read.parquet(cache)
    distinct = {(t or "").replace("▁", " ") for t in TEXTS}
    assert stored().count() == len(distinct)
    assert as_rows(count_tokens(odd, counter, cache)) == first and stored().count() == len(distinct)
    more = odd.unionByName(spark.createDataFrame([(99, "something new", "x", 1, "y"), (98, "something new", "x", 1, "y"), (97, "  ", "x", 1, "y")], SCHEMA))
    assert count_tokens(more, counter, cache).count() == len(TEXTS) + 3
    assert stored().count() == len(distinct) + 2
    other = TokenCounter.of(WORDS)  # another version has counts of its own
    assert sorted(r[3] for r in as_rows(count_tokens(odd, other, cache))) == sorted(library_counts(WORDS, TEXTS))
    assert {r[0] for r in stored().select("tokenizer").distinct().collect()} == {counter.version, other.version}


def test_cached_counts_are_used_and_repeated_entries_do_no_harm(spark, odd, tmp_path):
    cache, counter = str(tmp_path / "cache"), TokenCounter.of(PIECES)
    first = as_rows(count_tokens(odd, counter, cache))
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 7).write.parquet(str(tmp_path / "other"))
    twice = spark.read.parquet(str(tmp_path / "other"))
    twice.write.mode("append").parquet(str(tmp_path / "other2"))
    twice.write.mode("append").parquet(str(tmp_path / "other2"))
    again = as_rows(count_tokens(odd, counter, str(tmp_path / "other2")))
    assert [r[3] - 7 for r in again] == [r[3] for r in first]
