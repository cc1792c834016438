"""Periodic runs against a walk over all periods."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from factloom.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def all_runs(words, least=12):
    """(start, length, period), for each period every stretch whose words equal those a period on."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts():
    """Random words of small alphabets, Fibonacci and Thue-Morse words, repeats of repeats, copies."""
    rng = random.Random(5)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 500, ["a", "b"] * 300 + ["c"]]
    for k in range(120):
        letters = "abcdefgh"[: rng.choice([1, 2, 2, 3, 8])]
        words = [rng.choice(letters) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            if words:
                a, b = sorted(rng.choices(range(len(words) + 1), k=2))
                words[b:b] = words[a:b] * rng.randrange(1, 5)
                words = words[:900]
        out.append(words)
    x, y = "a", "ab"
    while len(y) < 700:
        x, y = y, y + x
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(600))
    return [*out, list(y), list(morse), list(y) * 2, out[50], out[50]]


def test_extensions_equal_plain_ones():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (13, 1), (200, 1), (300, 2), (500, 40), (64, 2)):
        row = np.append(rng.integers(0, k, n), 99)
        if n == 500:
            row[250:500] = row[:250]
        index = periodic.CoverIndex(row)
        a, b = rng.integers(0, n + 1, (2, 400))
        a, b = a[a != b], b[a != b]
        want = [next((t for t in range(n + 1) if max(x, y) + t > n or row[x + t] != row[y + t])) for x, y in zip(a, b, strict=True)]
        assert index.extension(a, b).tolist() == want


@pytest.mark.parametrize("together,pairs", [(100_000, 1_000_000), (50, 300)])
def test_runs_equal_a_walk_over_all_periods(spark, monkeypatch, together, pairs):
    monkeypatch.setattr(periodic, "TOGETHER", together)
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    some = texts()
    import pyarrow as pa

    block, got = pa.array([" ".join(w) for w in some]), []
    for ids, words in periodic._blocks(list(range(len(some))), block):
        got += periodic._examined(ids, words, 12).to_pylist()
    assert [r["doc_id"] for r in got] == list(range(len(some)))
    for r, words in zip(got, some, strict=True):
        runs = all_runs(words)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs
        assert r["n_words"] == len(words) and r["collapsed"] == collapsed(words, runs)


def test_query_on_the_smallest_table(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for d, t in rows:
        words = planted(d, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        runs, r = all_runs(words), got[d]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best and r.n_runs == len(runs)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, runs int, n_words string, collapsed int, _words int"
    long = "ab cd " * 40_000
    rows = [(1, None, 1, "x", 1, 1), (2, "", 1, "x", 1, 1), (3, " \t\n", 1, "x", 1, 1), (None, "x " * 20, 1, "x", 1, 1), (None, None, 1, "x", 1, 1), (8, "a\u00a0b " * 13, 1, "x", 1, 1), (8, "a\u00a0b " * 13, 1, "x", 1, 1), (9, long, 1, "x", 1, 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()))
    assert got == [(0, 0, [], ""), (0, 20, [(0, 20, 1)], "x"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (8, 13, [(0, 13, 1)], "a\u00a0b"), (8, 13, [(0, 13, 1)], "a\u00a0b"), (9, 80_000, [(0, 80_000, 2)], "ab cd")]
    marked = periodic.digests(periodic.periodic_runs(periodic.with_planted_periods(docs))).collect()
    assert len(marked) == len(rows) and all(r.runs_sha256 and r.collapsed_sha256 for r in marked)
    assert periodic.periodic_runs(spark.createDataFrame([], schema)).count() == 0
