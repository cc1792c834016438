"""The pipeline's stages on the smallest documents, each against what it was given."""

import hashlib

import duckdb
import plain
import pytest

import corpus_pipeline as c
from factloom.llm import simhash
from factloom.llm.common import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output rows) of each stage."""
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in c.STAGES:
        after = c.materialize(stage(spark, docs, SF), "test")
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "SimHash near-dedup", "PII", "mixing sources", "best-fit packing"]
    assert all(list(r[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, r in stages[:-1])


def test_toxic_documents_go(stages):
    _, before, after = stages[0]
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if toxic.get(r.doc_id) == 0]
    assert {r for r in after} <= {r for r in before} and sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    shingles = {r.doc_id: set(plain.five_shingles(plain.ascii_lower(r.text))) for r in before}
    kept = {r.doc_id for r in after}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for d in shingles.keys() - kept:
        assert max(alike(d, k) for k in shingles if k != d) >= 0.8
    left = sorted(kept)
    assert sum(alike(a, b) >= 0.8 for k, a in enumerate(left) for b in left[:k]) == 0


def test_dropped_documents_have_a_partner(spark, stages):
    _, before, after = stages[1]
    shingles = {r.doc_id: set(plain.five_shingles(plain.ascii_lower(r.text))) for r in before}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for d in shingles.keys() - {r.doc_id for r in after}:
        assert max(alike(d, k) for k in shingles if k != d) >= 0.8


def test_templates_below_the_similarity_stay(spark):
    """Documents that share 270 of 300 words in a row are similar to 0.78 and all stay, in any chunks; true copies go."""
    template = [f"t{k}" for k in range(270)]
    rows = [(k, " ".join([*template, *[f"own{k}-{j}" for j in range(37)]]), "en", "s", 1) for k in range(60)]
    rows += [(100 + k, " ".join([*template, *[f"own{k}-{j}" for j in range(36)]]), "en", "s", 1) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in c.near_duplicates(spark, docs, SF).collect()) == list(range(60))
    nodes = docs.selectExpr("doc_id as node", "doc_id", "xxhash64(text) as mark", "bigint(length(text)) as chars", "1L as part")
    links = {(r.src, r.dst) for r in simhash.similar_links(docs, nodes, 5, 0.8, chunk=7).collect()}
    assert links == {(k, 100 + k) for k in range(10)}


def test_personal_data_is_gone(stages):
    _, before, after = stages[2]
    text = {r.doc_id: r.text for r in before}
    assert len(before) == len(after)
    for r in after:
        assert not plain.base_pii(r.text) and r.n_chars == len(r.text)
        if not plain.base_pii(text[r.doc_id]):
            assert r.text == text[r.doc_id] or "[IBAN]" in r.text or "[SSN]" in r.text


def test_sources_come_near_their_targets(stages):
    _, before, after = stages[3]
    sizes, target = plain.mix_targets([(r.source, len(plain.words(r.text))) for r in before])
    digest = lambda r: hashlib.sha256(str(r).encode()).hexdigest()
    given, count = {digest(r) for r in before}, {}
    for r in after:
        count[digest(r)] = count.get(digest(r), 0) + 1
    assert count.keys() <= given
    rate = {s: target[s] / sizes[s] if sizes[s] else 0 for s in sizes}
    assert max(count.values()) <= 3
    for r in before:
        assert count.get(digest(r), 0) in (int(rate[r.source] + 1e-9), int(rate[r.source]) + 1)


def test_every_document_is_packed(stages):
    _, before, after = stages[4]
    assert sum(r.piece == 0 for r in after) == len(before)
    total = {}
    for r in after:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 1024
