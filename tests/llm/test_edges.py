"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import plain
import pytest

from factloom.llm import embeddings, fingerprints, licenses, mixing, packing, pii, quality, queries, simhash, toxicity, urls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 60_000 + "end"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "one two three", "en", None, 13), (None, None, None, None, None),
        (5, LONG, "en", "b", len(LONG)), (6, "The MIT License and the Apache License. mail a@b.co, 4111 1111 1111 1111", "en", "b", 70), (7, "  \t\n", "de", "c", 4), (8, "x" * 100_000, "fr", "c", 100_000), (9, "\U0001f600 é <|endoftext|> a.b@c.d.e", "fr", "ü", 30),
    ]
    extra = [(*r, k, "x", 0.5, [1], "k") for k, r in enumerate(rows)]
    return spark.createDataFrame(extra, SCHEMA + ", fp int, key string, score double, spans array<int>, copies string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, odd, empty):
    files = queries.tokenizer_files()
    rows = packing.pack_documents(odd, **files).collect()
    assert sum(r.piece == 0 for r in rows) == 11
    assert sum(r.length for r in rows if r.doc_id is None) == packing_length("one two three") + 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert [r for r in rows if r.doc_id == 1][0].length == 1
    assert packing.pack_documents(empty, **files).count() == 0
    docs = odd.where("doc_id in (2, 6, 9)")
    packed = packing.pack_documents(docs, **files)
    assert sum(len(r.ids) for r in packing.sequence_tokens(docs, packed, **files).collect()) == sum(r.length for r in packed.collect())


def packing_length(text):
    return len(packing._encoder(**{"json_path": queries.tokenizer_files()["json_path"], "ranks_path": None})(text)) + 1


def test_ids_are_those_of_the_tokenizer():
    files = queries.tokenizer_files()
    fast, slow = packing._encoder(files["json_path"], files["ranks_path"]), packing._encoder(files["json_path"], None)
    for text in ("", " a  b\n\n c", "<|endoftext|>", "don't  stop\u00a0now", "été 12345 \U0001f600\u200d", "\t\r\n", "x" * 5_000, "日本語テキスト"):
        assert fast(text) == slow(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "end", "start" + " \n\t" * 400_000 + "end", "x " + "\u00a0" * 800_000, "!" * 1_000_000, "1" * 1_000_000, "a b " * 200_000], ids=["spaces", "newlines", "mixed", "wide", "signs", "digits", "words"])
def test_long_runs_are_tokenised(text):
    files = queries.tokenizer_files()
    assert packing._encoder(files["json_path"], files["ranks_path"])(text) == packing._encoder(files["json_path"], None)(text)


def test_mixed_documents_become_sequences(spark):
    """Repeated and null ids, as after mixing: the sequences hold each row's tokens once."""
    files = queries.tokenizer_files()
    docs = spark.createDataFrame([(1, "some words of one text")] * 3 + [(None, "no id here")] * 2 + [(2, "other " * 1_500), (2, "another text")], "doc_id bigint, text string")
    packed = packing.pack_documents(docs, **files)
    sequences = packing.sequence_tokens(docs, packed, **files).collect()
    assert sum(len(r.ids) for r in sequences) == sum(r.length for r in packed.collect()) and all(len(r.ids) <= 1024 for r in sequences)


def test_fingerprints(spark, odd, empty):
    rows = fingerprints.edited_pairs(odd).collect()
    assert len(rows) == 11 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    blank = {r.fingerprint for r in rows if r.n_chars == 0}
    assert len(blank) == 1
    assert fingerprints.edited_pairs(empty).count() == 0
    one = fingerprints.edited_pairs(odd.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprint(odd).count() == 10


def test_fingerprint_weights(spark):
    """Repeated shingles weigh more: estimates follow generalised Jaccard, not that of sets."""
    a, b = "a b c d e f " * 30 + "tail of one text", "a b c d e f " * 10 + "tail of one text"
    want = plain.generalised_jaccard(plain.five_shingles(a), plain.five_shingles(b))
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    x, y = (r.signature for r in fingerprints.fingerprint(df, samples=160).orderBy("doc_id").collect())
    assert abs(sum(p == q for p, q in zip(x, y)) / 160 - want) < 0.12


def test_simhash(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].fingerprint == "0" * 16 and {by[k].component_id for k in (1, 2, 7)} == {1}
    assert {r.component_id for r in rows if r.doc_id == 3} == {3}
    assert {r.component_id for r in rows if r.doc_id is None} == {1, None}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar_documents(empty).count() == 0
    assert len(simhash.similar_documents(odd).collect()) == 11


def test_one_of_each_group(spark):
    """Repeated rows, null ids, one id with several texts: one row of each group stays, with all its columns."""
    a, b, c, near = ("alpha " + " ".join(f"{x}{k}" for k in range(60)) for x in ("a", "b", "c", "a"))
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "y"), (None, a, "z"), (None, b, "u"), (None, b, "u"), (4, c, "v"), (4, near + " new", "w"), (5, c + " one two three four five six seven eight", "t"), (6, None, "n"), (7, " ", "n"), (8, c + " more", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    left = simhash.one_of_each(docs, simhash.similar_documents(docs)).collect()
    assert sorted((str(r.doc_id), r.mark) for r in left) == [("1", "x"), ("4", "v"), ("6", "n"), ("None", "u")]
    ids = {(r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect()}
    assert ids == {(1, 1), (2, 1), (None, 1), (None, None), (4, 4), (4, 1), (5, 4), (6, 6), (7, 6), (8, 4)}


def test_simhash_crowd(spark):
    """One crowded key, cut in chunks, gives the components of all pairs."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*words[: k % 40], f"new{k}", *words[k % 40 :]])) for k in range(120)] + [(1000 + k, f"other text {k} " * 9) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, want = plain.simhash_components(rows)
    assert len({want[k] for k in range(120)}) < 60
    for chunk in (16_384, 12):
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df, chunk=chunk).collect()} == want


def test_pivot_coordinates(spark):
    """The packed coordinates are those of Hamming distances to the references, computed plainly; linked fingerprints share
    a key, and distances bound the difference in bits."""
    import random

    pick = random.Random(9)
    values = [0, 2**64 - 1, 1 << 63, *(pick.getrandbits(64) for _ in range(200))]
    near = [v ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(4))) for v in values]
    F = simhash.F
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(a), signed(b)) for k, (a, b) in enumerate(zip(values, near, strict=True))], "k int, a bigint, b bigint")
    keys = lambda c: F.concat(*[simhash.coordinate_keys(simhash.pair_coordinates(F.col(c)), 3, a) for a in (3, 5)])
    rows = df.select("k", simhash.pair_coordinates(F.col("a")).alias("c"), F.size(F.array_intersect(keys("a"), keys("b"))).alias("shared"), simhash.pivot_table(F.col("a")).alias("pa"), simhash.pivot_table(F.col("b")).alias("pb")).collect()
    for r in rows:
        x = values[r.k]
        d = lambda y, x=x: (x ^ y).bit_count()
        want = [(2 - (d(3 << 2 * j) - d(0))) // 2 for j in range(32)]
        assert [r.c % 2**64 >> 2 * j & 3 for j in range(32)] == want and r.shared > 0
        table = lambda p: [v % 2**64 >> 8 * k & 255 for v in p for k in range(8)]
        assert max(abs(p - q) for p, q in zip(table(r.pa), table(r.pb), strict=True)) <= (x ^ near[r.k]).bit_count() and len(table(r.pa)) == 16


def test_simhash_links_planted_bits(spark):
    """Fingerprints planted at 0 to 5 bits from each other: exactly those at 3 or fewer are linked."""
    import itertools
    import random

    pick = random.Random(10)
    prints = [pick.getrandbits(64) for _ in range(150)]
    prints += [p ^ sum(1 << b for b in pick.sample(range(64), k % 6)) for k, p in enumerate(prints)]
    ids = list(range(len(prints)))
    pick.shuffle(ids)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in zip(ids, prints, strict=True)], "doc_id bigint, fp bigint")
    want = plain.components(ids, ((ids[a], ids[b]) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3))
    assert {r.doc_id: r.component_id for r in simhash._grouped(df, 3, 16_384).collect()} == want
    assert [simhash.planned_agreeing(n, 3) for n in (0, 10**6, 10**8, 10**11)] == [3, 3, 4, 6]


def test_similar_documents_finds_near_copies(spark):
    import random

    pick = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5_000)]
    base = [[pick.choice(vocabulary) for _ in range(300)] for _ in range(40)]
    rows = []
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        changed = list(words)
        for at in pick.sample(range(300), 4):
            changed[at] = "changed"
        rows.append((10 * k + 1, " ".join(changed)))
        rows.append((10 * k + 2, " ".join(words[:150] + [pick.choice(vocabulary) for _ in range(150)])))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[10 * k + 1] == 10 * k for k in range(40)) >= 39
    assert all(got[10 * k + 2] == 10 * k + 2 for k in range(40))


def test_similar_documents_finds_contiguous_edits(spark):
    """A passage of new words in place of another, at similarities just above 0.8, 0.85 and 0.9."""
    import random

    pick = random.Random(5)
    vocabulary, rows, new = [f"w{k}" for k in range(20_000)], [], iter(range(100_000))
    for k in range(300):
        words = [pick.choice(vocabulary) for _ in range(300)]
        cut = (28, 19, 11)[k % 3]
        at = pick.randrange(5, 290 - cut)
        other = [*words[:at], *[f"new{next(new)}" for _ in range(cut)], *words[at + cut :]]
        a, b = (set(plain.five_shingles(" ".join(w))) for w in (words, other))
        assert 0.8 <= len(a & b) / len(a | b) < 0.93
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[10 * k + 1] == got[10 * k] == 10 * k for k in range(300))


def test_tables_of_similar_documents():
    """The plan holds at 0.8 for any number of texts, millions too, and keys are shared as often as planned."""
    import numpy as np

    tables = simhash.planned_tables(0.8, 0.9999)
    assert tables <= 40 and (1 - 0.8**5) ** tables <= 1e-4
    random = np.random.default_rng(1)
    shared = []
    for _ in range(400):
        x = random.integers(0, 2**64, size=270, dtype=np.uint64)
        a, b = x[:240], np.concatenate([x[:210], x[240:]])  # 210 of 270
        shared.append(np.mean(simhash.least_hash_keys(a, tables) == simhash.least_hash_keys(b, tables)))
    assert abs(np.mean(shared) - (210 / 270) ** 5) < 0.03


def test_licenses(spark, odd, empty):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == 11
    r = next(r for r in rows if r.doc_id == 6)
    assert [(p.start, p.label) for p in r.base] == [(1, "mit"), (5, "apache")] and r.score >= 0.8
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_equal_a_plain_walk(spark):
    """Random matches of every rule, alone and in other words, get what walking all rules over them finds: no gate
    or keyword loses any."""
    import random

    pick, texts = random.Random(4), []
    for r in licenses.RULES:
        for _ in range(6):
            t = plain.sample_match(r.pattern, pick)
            assert r.keyword in f" {t} ", (r, t)
            texts += [t, f"Some words, {t.title()}; and {pick.choice(texts or ['mit license'])}."]
    texts += ["Released under MIT.", "Distributed under the BSD.", "published under the zlib", "provided under CC0 1.0", "Available under the ISC", "offered under the eclipse public 2.0", "unter der Lizenz", "Released under Creative Commons Attribution 4.0"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(8)).select("k", "detections").collect()
    got = {r.k: [(d.start, d.end, d.rule) for d in r.detections] for r in rows}
    assert [t for k, t in enumerate(texts) if got[k] != plain.license_detections(t, licenses.RULES)] == []
    assert all(got[len(texts) - k] for k in range(1, 9)) and len(licenses.RULES) > 400


def test_license_suppression(spark):
    texts = ["SPDX-License-Identifier: Apache-2.0", "released under the GNU General Public License version 3 or any later version", "Creative Commons Attribution-ShareAlike 4.0 International License", "no such words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = {r.doc_id: [d.label for d in r.detections] for r in licenses.scan_licenses(df).collect()}
    assert labels == {0: ["apache-2.0"], 1: ["gpl-3.0-or-later"], 2: ["cc-by-sa-4.0"], 3: []}
    assert len(licenses.RULES) > 300


def test_everyday_license_forms(spark):
    """Each form's example has its label; what only looks like one has none."""
    found = {
        "This software is MIT licensed.": "mit", "MIT OR Apache-2.0": "mit,apache-2.0", "an Apache 2.0 licensed tool": "apache-2.0", "Apache-licensed": "apache", "(Apache-2.0)": "apache-2.0",
        "BSD-licensed": "bsd", "BSD-3-Clause": "bsd-3-clause", "the two-clause BSD": "bsd-2-clause", "0BSD": "0bsd", "GNU GPLv3": "gpl-3.0", "GPLv2+": "gpl-2.0", "GPL-3.0-only": "gpl-3.0", "GPL 2": "gpl-2.0",
        "GPLv2 or later": "gpl-2.0-or-later", "GPLv3 or any later version": "gpl-3.0-or-later", "GPL-licensed code": "gpl", "LGPLv2.1": "lgpl-2.1", "LGPL-3.0-or-later": "lgpl-3.0", "AGPLv3": "agpl-3.0", "ISC licensed": "isc",
        "Boost-licensed": "bsl-1.0", "MPL-2.0": "mpl-2.0", "MPLv2": "mpl-2.0", "EPL-2.0": "epl-2.0", "EUPL v1.2": "eupl-1.2", "CC BY 4.0": "cc-by-4.0", "CC-BY-NC-SA-4.0": "cc-by-nc-sa-4.0", "CC0-licensed": "cc0-1.0", "The Unlicense": "unlicense", "dual-licensed": "other",
    }
    missed = ["licensed at MIT", "MIT professors, licensed", "Apache 20 helicopters", "BSD 3 clauses", "three clause contract", "GPLv4", "gplv22", "a sample 2.0", "dual license plates", "CC by 40 people", "an example 2.0", "unlicensed", "epl 2 00", "LGPL"]
    df = spark.createDataFrame(list(enumerate([*found, *missed])), "k int, text string")
    got = {r.k: list(dict.fromkeys(d.label for d in r.detections)) for r in licenses.scan_licenses(df).select("k", "detections").collect()}
    assert [",".join(got[k]) for k in range(len(found))] == list(found.values())
    assert [t for k, t in enumerate(missed, len(found)) if got[k]] == []


def test_pii(spark, odd, empty):
    rows = pii.find_pii(odd).collect()
    assert [(s.kind, s.start, s.end) for s in next(r for r in rows if r.doc_id == 9).spans] == [("email", 18, 27)]
    assert pii.find_pii(empty).count() == 0
    texts = ["a_@b.c_x@d.e", "1.2.3.4.5.6.7.8 999.1.1.1", "4111-1111-1111-1111 4111111111111112", "+49 (30) 123 456-7)) +1", "a@b", "x" * 50_000 + "@y.z", "card 4111 1111 1111 1111.", "IBAN DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "\U0001f600 +4930123456789", "a." * 3_000 + "@" + "b." * 3_000 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.find_pii(df).collect():
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        base = plain.base_pii(texts[r.doc_id])
        assert [s for s in spans if s[0] in plain.KINDS[:4]] == base
        assert {s[0] for s in spans} - {s[0] for s in base} == {7: {"iban"}, 8: {"ssn"}}.get(r.doc_id, set())
    card = next(r for r in pii.find_pii(df).collect() if r.doc_id == 6).spans[0]
    assert card.score > 0.8
    red = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert red[4] == "a@b" and red[6] == "card [CARD]." and red[8] == "ssn [SSN]" and red[9] == "\U0001f600 [PHONE]"
    assert {r.doc_id: r.text for r in pii.redact_pii(odd).collect() if r.doc_id == 1} == {1: None}


def test_mixing(spark, odd, empty):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == 11 and all(r.copies <= 3 for r in rows)
    assert next(r for r in rows if r.doc_id == 1).size == 0
    sizes, target = plain.mix_targets([(r.source, r.size) for r in rows])
    assert all(r.target == pytest.approx(target[r.source]) for r in rows)
    assert mixing.mix_plan(empty).count() == 0
    assert mixing.mix(odd).count() == sum(r.copies for r in rows)


def test_mixing_clashing_columns(spark):
    """Columns with the names of those that are added: the plan replaces them, the mix keeps them."""
    names = ["size", "source_size", "target", "rate", "copies", "copy", "weight", "limit", "level", "_row"]
    docs = spark.createDataFrame([(k, "a b c", "s" if k % 3 else "t", *[f"{n}{k}" for n in names]) for k in range(12)], "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    rows = mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "rate", "copies", "copy", "level").collect()
    assert all((r["size"], r["copy"], r["level"]) == (3, f"copy{r.doc_id}", f"level{r.doc_id}") and isinstance(r.target, float) for r in rows)
    out = mixing.mix(docs).collect()
    assert len(out) == sum(r.copies for r in rows) and all(r.rate == f"rate{r.doc_id}" and r["copies"] == f"copies{r.doc_id}" and r["_row"] == f"_row{r.doc_id}" for r in out)


def test_urls(spark):
    rows = ["http://NET/x", "https://a.net", "http://a.example.net/en/?q", "ftp://example.com/de/x#y", "http://u.org/fr/", "http://x.org/de/", None, "no url", "http://", "a://b://c.net/"]
    df = spark.createDataFrame([(k, u, "<p>fine words here</p>", "h", 1) for k, u in enumerate(rows)], "page_id bigint, url string, html string, host string, n int")
    for r in urls.judge_urls(df).collect():
        host, path, rule, verdict = plain.url_rule(rows[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert urls.judge_urls(df.where("page_id < 0")).count() == 0


def test_url_reputation(spark):
    """A host with many bad pages is blocked, one with few bad ones of few isn't."""
    bad, good = "<p>" + "cheap!!! $$$ " * 20 + "</p>", "<p>" + "plain words " * 20 + "</p>"
    rows = [("http://bad.example.org/a", bad)] * 60 + [("http://good.example.org/a", good)] * 300 + [("http://few.example.org/a", bad)] + [("http://new.example.org/a", None)]
    out = urls.judge_urls(spark.createDataFrame(rows, "url string, html string")).select("host", "verdict", "bad_mean").distinct().collect()
    assert {r.host: r.verdict for r in out} == {"bad.example.org": "block", "good.example.org": "allow", "few.example.org": "allow", "new.example.org": "allow"}
    mean = {r.host: r.bad_mean for r in out}
    assert mean["good.example.org"] < mean["new.example.org"] < mean["few.example.org"] < mean["bad.example.org"]


def test_url_posteriors_equal_plain_ones(spark, monkeypatch):
    """Many hosts of several domains, one with a third of all pages: posteriors and verdicts of a plain version, broadcast or not."""
    import random

    pick = random.Random(8)
    rows = []
    for h in range(60):
        domain, rate = ("bad.com", 0.9) if h % 6 == 0 else (f"d{h % 7}.{'org.uk' if h % 2 else 'com'}", pick.random() ** 3)
        rows += [(f"http://h{h}.{domain}/p/{k}", pick.choice([None, *[int(pick.random() < rate)] * 4])) for k in range(pick.randrange(1, 30))]
    rows += [("http://huge.d1.org.uk/x", int(k % 9 == 0)) for k in range(1_500)] + [("http://one.bad.com/", None), (None, 1)]
    F = urls.F
    df = spark.createDataFrame([(*r, "own") for r in rows], "url string, bad int, _pages string")
    where = lambda u: (u or "://").split("://")[1].split("/")[0]
    up = lambda h: tuple(".".join(h.split(".")[-k:]) for k in ((3, 2) if h.endswith(".org.uk") else (2, 1))) if "." in h else (h, h)
    want = plain.host_posteriors([(h := where(u), *up(h), bad) for u, bad in rows])
    for most in (20_000, 3):
        monkeypatch.setattr(urls, "BROADCAST_HOSTS", most)
        got = urls.judge_urls(df.drop("_pages"), F.col("bad")).collect()
        assert len(got) == len(rows)
        for r in got:
            mean, low = want[r.host]
            assert (r.bad_mean, r.bad_low) == pytest.approx((mean, low))
            assert r.rule is not None or r.verdict == ("block" if low > 0.5 else "allow")
    assert {want[h][1] > 0.5 for h in want} == {True, False}


def test_url_outcomes(spark):
    pages = [("http://m.casino-win.example.com/a", "<p>fine words</p>"), ("http://a.example.com/xxx/1", None), ("http://essex.example.com/alphabet", "<p>fine words</p>"), ("http://a.b/", "<script>" * 50_000 + "<" * 50_000), ("http://a.b/", None), ("http://a.b/", "<p>" + "$$$ !!! a " * 9 + "<script>if (a < b) {}")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "k int, url string, html string")
    host, path = urls.url_parts(urls.F.col("url"))
    got = df.select("k", urls.page_outcome(host, path, urls.F.col("html")).alias("bad")).orderBy("k").collect()
    assert [r.bad for r in got] == [1, 1, 0, None, None, 1]


def test_scores_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        rows = score(odd, labels).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert score(empty, labels).count() == 0


def test_embeddings(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    near = base[:100] + 0.05 * rng.standard_normal((100, 16))
    crowd = base[0] + 0.02 * rng.standard_normal((80, 16))
    x = np.vstack([base, near, crowd, base[:20]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 16)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    have = np.array([got[k].n_links for k in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    for k in (900, 901, 902, 903, 904, 907):
        assert got[k].n_links == 0 and got[k].kept and got[k].component_id == k
    assert (got[905].n_links, got[906].component_id, got[906].kept) == (1, 905, False)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_mixing_keeps_columns_named_like_its_own(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10**6 if few else 0)
    docs = spark.createDataFrame([(1, "a b", "s", "k1", 7, 3), (2, "c", None, "k2", 8, 4), (3, None, "t", None, 9, 5)], "doc_id bigint, text string, source string, _KEY string, _key_ int, documents int")
    plan = mixing.mix_plan(docs)
    assert {(r.doc_id, r["_KEY"], r["_key_"], r.documents) for r in plan.collect()} == {(1, "k1", 7, 3), (2, "k2", 8, 4), (3, None, 9, 5)}
    assert set(plan.columns) == set(docs.columns) | set(mixing.ADDED)
