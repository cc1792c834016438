"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from factloom.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_variants(words):
    """word -> (n, n_near, form, form_n, root) by comparing all pairs."""
    out, form = {}, {}
    for w, n in words.items():
        others = sorted((-m, x) for x, m in words.items() if near(w, x))
        if others and -others[0][0] >= 2 * n:
            form[w] = others[0][1]
        out[w] = (n, len(others), form.get(w), words[form[w]] if w in form else None)
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] += (root,)
    return out


def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def collected(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def vocabulary():
    """Words of few letters, families of one stem, repeated letters, letters beyond ASCII, one very long word."""
    rng = random.Random(3)
    words = {}
    while len(words) < 900:
        base = "".join(rng.choice("abé" if rng.random() < 0.5 else "abcdefghijklmnopqrstuvwxyzàÿ") for _ in range(rng.randrange(5, 12)))
        for w in [base] * (rng.random() < 0.8) + [base[:k] + rng.choice(["", "a", "ö", "zz"]) + base[k + rng.randrange(2) :] for k in rng.choices(range(len(base)), k=3)]:
            if len(w) >= 5:
                words[w] = rng.choice([3, 3, 4, 6, 7, 12, 25, 200])
    words |= {"a" * k: 3 * k for k in range(5, 12)} | {"x" * 3000: 3, "x" * 2999 + "y": 9, "x" * 1500 + "q" + "x" * 1499: 40}
    return words


@pytest.mark.parametrize("frequent,long", [(50, 200), (1, 200), (10**9, 200), (3, 4)])
def test_variants_equal_all_pairs(spark, monkeypatch, frequent, long):
    words = vocabulary()
    monkeypatch.setattr(spelling, "LONG_LIST", long)
    made = spelling.gram_dictionary
    monkeypatch.setattr(spelling, "gram_dictionary", lambda rows: {g: n for g, n in made(rows).items() if n > frequent} if frequent >= 50 else dict(Counter(g for w in words for p in range(len(w) - 1) for q in (2, 3, 4) if len(g := f"\x01{w}\x02"[p : p + q]) == q).most_common(5000 // frequent)))
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    assert collected(spelling.variants(df)) == plain_variants(words)


def test_chosen_grams_survive_any_edit():
    """For random words and each edit: both words share a list."""
    rng = random.Random(9)
    for _ in range(3000):
        w = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefg") for _ in range(rng.randrange(5, 14)))
        k, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        x = w[:k] + ("" if kind == 0 else rng.choice("abz")) + w[k + (kind < 2) :]
        if len(x) < 5 or not near(w, x):
            continue
        frequent = {g: rng.randrange(1, 9) for u in (w, x, "abaab") for g in spelling.grams_of(u, {}) + [f"\x01{u}\x02"[p : p + 3] for p in range(len(u))] if rng.random() < 0.5}
        a, b = dict(spelling.entries_of(w, frequent)), dict(spelling.entries_of(x, frequent))
        shared = a.keys() & b.keys()
        assert shared
        assert any(set(spelling.forms_of(w, key, a[key])) & set(spelling.forms_of(x, key, b[key])) for key in shared)


def test_query_on_the_smallest_table(spark):
    words = plain_words(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    assert collected(queries.op12_spelling_variants(spark, SF)) == plain_variants(words)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, word string, n int, id string"
    texts = [None, "", "...", "Straße straße STRASSE Straße straße straßen straßen straßen", "colour color colour color colour color color color, Color", "y" * 100_000, "y" * 100_000, "y" * 100_000 + " " + "y" * 99_999]
    rows = [(k if k % 3 else None, t, "w", 1, "i") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows, schema).repartition(3)
    assert collected(spelling.variants(spelling.counted_words(docs, misspelt=97))) == plain_variants(plain_words([r[:2] for r in rows + rows]))
    assert spelling.variants(spelling.counted_words(spark.createDataFrame([], schema), misspelt=97)).count() == 0
    plain_counts = {r.word: r.n for r in spelling.counted_words(docs).collect()}
    assert plain_counts["straße"] == 8 and "strasse" not in plain_counts
