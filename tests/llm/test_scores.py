"""Learned scores on rows that they did not learn from, what they are learned by, and their features."""

import re
import zlib

import duckdb
import numpy as np
import pytest

from factloom.llm import features, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    """The share of (1, 0) pairs in the right order; ties count half."""
    ones, zeros = scores[labels == 1], scores[labels == 0]
    return float(np.mean((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros)))


@pytest.mark.parametrize(("query", "column", "threshold", "least_auc", "least_right"), [("op6_quality", "quality", 0.3, 0.9, 0.85), ("op7_toxicity", "toxic", 0.5, 0.9, 0.9)])
def test_held_out_labels(spark, query, column, threshold, least_auc, least_right):
    rows = {r.doc_id: r for r in queries.QUERIES[query](spark, SF).collect()}
    assert rows.keys() == {d for (d,) in duckdb.sql(f"select doc_id from '{SF}/documents.parquet'").fetchall()}
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    labels = duckdb.sql(f"select doc_id, {column} from '{SF}/labels.parquet' where {column} is not null").fetchall()
    held = [(rows[d].score, rows[d].predicted, x) for d, x in labels if d in rows and rows[d].held_out]
    score, predicted, truth = map(np.array, zip(*held, strict=True))
    right, found = (predicted == truth).mean(), auc(score, truth)
    print(query, "rows", len(held), "AUC", round(found, 3), "right", round(float(right), 3))
    assert found >= least_auc and right >= least_right


def test_equal_texts_have_equal_scores(spark):
    """Only the text is an input: repeated texts under other ids, in other folds, score alike; labels show only through words."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(300).selectExpr("doc_id", "text").collect()
    docs = spark.createDataFrame([(r.doc_id + shift, r.text) for r in rows for shift in (0, 10**6, 2 * 10**6 + 1)], "doc_id bigint, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = {r.doc_id: (r.score, r.predicted) for r in score(docs, labels).collect()}
        assert all(got[r.doc_id] == got[r.doc_id + 10**6] == got[r.doc_id + 2 * 10**6 + 1] for r in rows)


def test_toxicity_is_calibrated(spark):
    """On the held-out fold: mean score near the share of toxic rows, in all and in each half of the scores."""
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect()}
    labels = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet' where toxic is not null").fetchall()
    held = sorted((rows[d].score, x) for d, x in labels if d in rows)
    score, truth = map(np.array, zip(*held, strict=True))
    assert len(held) > 300 and abs(score.mean() - truth.mean()) < 0.04
    for part in (score < 0.5, score >= 0.5):
        assert abs(score[part].mean() - truth[part].mean()) < 0.08


def test_risk_is_that_of_the_definition():
    """The fitted weights have no more non-negative risk, computed plainly, than points around them, and the prior is near the truth."""
    rng = np.random.default_rng(0)
    one = lambda n: rng.standard_normal((n, 3)) + [2.0, 0, 0]
    two = lambda n: rng.standard_normal((n, 3)) - [2.0, 0, 0]
    constant = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u = constant(one(800)), constant(np.vstack([one(600), two(1_400)]))
    w, prior = quality.fit_nnpu(p, u)
    assert abs(prior - 0.3) < 0.06
    loss = lambda f: np.log1p(np.exp(-f))

    def risk(w):
        negative = loss(-u @ w).mean() - prior * loss(-p @ w).mean()
        return prior * loss(p @ w).mean() + max(0.0, negative) + 1e-3 * w @ w

    assert all(risk(w) <= risk(w + 0.3 * rng.standard_normal(4)) + 1e-3 for _ in range(200))
    assert ((constant(one(500)) @ w > 0).mean() + (constant(two(500)) @ w < 0).mean()) / 2 > 0.93


@pytest.mark.parametrize("text", ["", "aaaa bbb 111 ___ ²²² ßßß aaaBBB", "f u c k you", "(a.b.c.d) e.g.", "x-a b c d!", "a_b c_d e", "_______", "1d10t y0u st*pid wh0re", "sooo\nb\na\nd", "a\x1cb c d e f", "zz zzz"])
def test_features_equal_whole_text_patterns(text):
    tokens = text.split()
    odd = [w for w in tokens if not w.isalpha()]
    assert features.drawn_out(text) == len(re.findall(r"([^\W\d_])\1{2,}", text))
    assert features.spaced_out(text, tokens, odd) == [re.sub(r"[ .*_-]", "", m[0]).lower() for m in features.SPACED.finditer(text)]
    assert [m for w in odd for m in features.DISGUISED.findall(w)] == features.DISGUISED.findall(text)
