"""The queries over the smallest generated tables against plain versions, row by row."""

import duckdb
import numpy as np
import plain
import pytest

from factloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def test_op1_is_whole_and_tight(spark, documents):
    from tokenizers import Tokenizer

    rows = queries.op1_packing(spark, SF).collect()
    encode = Tokenizer.from_file(queries.tokenizer_files()["json_path"]).encode
    ids = {d: [*encode(t or "", add_special_tokens=False).ids, 2] for d, t, _ in documents}
    from factloom.llm.packing import crc32_of

    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == crc32_of(ids[d][at : at + r.length])
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(by_sequence) <= 1.03 * least + 1


def test_op4_equals_all_pairs(spark, documents):
    prints, component = plain.simhash_components([(d, t) for d, t, _ in documents])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", component[d]) for d in prints}


def test_op8_keeps_every_base_span(spark, documents):
    got = {r.doc_id: r for r in queries.op8_pii(spark, SF).collect()}
    assert len(got) == len(documents)
    for d, t, _ in documents:
        base, r = plain.base_pii(t), got[d]
        assert r.base_sha256 == plain.sha(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in plain.KINDS[:4]]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))| {""}


def test_op9_hits_its_targets(spark, documents):
    rows = queries.op9_mixing(spark, SF).collect()
    sizes, target = plain.mix_targets([(s, len(plain.words(t))) for _, t, s in documents])
    source, size = {d: s for d, _, s in documents}, {d: len(plain.words(t)) for d, t, _ in documents}
    assert len(rows) == len(documents)
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken <= 3 * r.size
        assert r.copies in {int(np.floor(r.target / r.source_size + k)) for k in (0, 1 - 1e-12)}
    assert sorted(rows) == sorted(queries.op9_mixing(spark, SF).collect())


def test_op10_follows_the_rules(spark):
    pages = duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries.op10_urls(spark, SF).collect()}
    assert len(got) == len(pages)
    for page, url in pages:
        host, path, rule, verdict = plain.url_rule(url)
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")


def test_op2_estimates_generalised_jaccard(spark, documents):
    import hashlib

    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, SF).collect()}
    assert len(got) == len(documents)
    off = []
    for k, (d, t, _) in enumerate(documents):
        after = documents[(k + 1) % len(documents)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off.append(r.near_edited - plain.generalised_jaccard(plain.five_shingles(t), plain.five_shingles(edited)))
        off.append(r.near_next - plain.generalised_jaccard(plain.five_shingles(t), plain.five_shingles(after)))
    assert np.abs(off).mean() < 0.06 and abs(np.mean(off)) < 0.02
    by_text = {}
    for d, t, _ in documents:
        by_text.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({f for x in by_text.values() for f in x}) > 0.95 * len(by_text)


def test_op5_keeps_every_base_place(spark, documents):
    got = {r.doc_id: r for r in queries.op5_licenses(spark, SF).collect()}
    for d, t, _ in documents:
        n, found = plain.license_base(t)
        r = got[d]
        places = [k for k, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and {x for _, x in found} <= set(labels) and 0 <= r.score <= 1
