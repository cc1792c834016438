"""Labels, evidence and minimality against a plain walk that takes each fact away and labels again."""

import random

import pytest

from factloom.operators import proofs

INVERSE = {"BEFORE": "AFTER", "AFTER": "BEFORE", "LEFT_OF": "RIGHT_OF", "RIGHT_OF": "LEFT_OF"}
RULE = {"BEFORE": "STRICT_ORDER_TRANSITIVITY", "AFTER": "STRICT_ORDER_TRANSITIVITY", "LEFT_OF": "AUTHORIZED_DIRECTION_TRANSITIVITY", "RIGHT_OF": "AUTHORIZED_DIRECTION_TRANSITIVITY"}
SCHEMA = "world string, predicate string, subject string, object string, value bigint, polarity string, context map<string,string>"


def label(claim, facts, rules):
    """(label, evidence, rules) of a claim (predicate, subject, object, value, polarity, context) from facts (id, ...)."""
    p, s, o, v, pol, ctx = claim
    facts = [f for f in facts if all(f[6].get(k) == x for k, x in (ctx or {}).items())]
    found = {"support": [], "refute": []}
    for i, fp, fs, fo, fv, fpol, _ in facts:
        straight, turned = (fs, fo) == (s, o), (fs, fo) == (o, s)
        for name, side, holds in (
            ("STATED", "support", fp == p and straight and fv == v and fpol == pol), ("OPPOSITE_POLARITY", "refute", fp == p and straight and fv == v and fpol != pol),
            ("OTHER_COUNT", "refute", p == fp == "COUNT" and straight and fv != v and fpol == pol == "positive"), ("INVERSE", "support", INVERSE.get(p) == fp and turned and fv == v and fpol == pol),
            ("ASYMMETRY", "refute", p in INVERSE and fp == p and turned and fpol == "positive"), ("EXCLUSION", "refute", INVERSE.get(p) == fp and straight and fpol == pol == "positive"),
        ):
            if holds and name in rules:
                found[side].append((name, [i]))
    if RULE.get(p) in rules and pol == "positive" and s != o:
        edges = [(fs, fo, i) if fp == p else (fo, fs, i) for i, fp, fs, fo, _, fpol, _ in facts if fpol == "positive" and fp in (p, INVERSE[p])]
        for side, a, b in (("support", s, o), ("refute", o, s)):
            chains = [[x[2], y[2]] for x in edges for y in edges if x[0] == a and x[1] == y[0] and y[1] == b]
            if len(chains) == 1:
                found[side].append((RULE[p], chains[0]))
    decided = bool(found["support"]) != bool(found["refute"])
    every = found["support"] + found["refute"]
    name = ("SUPPORTED" if found["support"] else "CONTRADICTORY") if decided else "UNKNOWN"
    return name, sorted({i for _, ids in every for i in ids}), sorted({n for n, _ in every}), bool(found["support"] and found["refute"])


def worlds(seed):
    """Few nodes, loops, repeated facts, both directions, competing chains."""
    rng = random.Random(seed)
    for w in range(60):
        facts = []
        for _ in range(rng.randrange(9)):
            p = rng.choice(["BEFORE", "BEFORE", "AFTER", "LEFT_OF", "RIGHT_OF", "COUNT"])
            s, o = rng.choice("abcd"), None if p == "COUNT" else rng.choice("abcd")
            facts.append((p, s, o, rng.randrange(2) if p == "COUNT" else None, "positive" if rng.random() < 0.85 else "negative", rng.choice([{"v": "1"}, {"v": "1", "u": "2"}, {}])))
        facts += rng.sample(facts, min(len(facts), rng.randrange(2)))
        facts = [(f"{w}-{k}", *f) for k, f in enumerate(facts)]
        claims = []
        for k in range(6):
            p = rng.choice(["BEFORE", "AFTER", "LEFT_OF", "COUNT"])
            claims.append((f"{w}/{k}", p, rng.choice("abcd"), None if p == "COUNT" else rng.choice("abcd"), rng.randrange(2) if p == "COUNT" else None, rng.choice(["positive"] * 4 + ["negative"]), rng.choice([None, {}, {"v": "1"}]), rng.choice(["SUPPORTED", "CONTRADICTORY", None])))
        yield str(w), facts, claims


@pytest.mark.parametrize("seed", [1, 2])
def test_verified_equals_removal_and_labelling_again(spark, seed):
    every = list(worlds(seed))
    rules = proofs.standard_rules(spark)
    names = {r.rule_id for r in rules.select("rule_id").distinct().collect()}
    held = {w: {n for k, n in enumerate(sorted(names)) if (int(w) + k) % 4} for w, _, _ in every}
    facts = spark.createDataFrame([(f[0], w, *f[1:]) for w, fs, _ in every for f in fs], "fact_id string, " + SCHEMA)
    claims = spark.createDataFrame([(c[0], w, *c[1:]) for w, _, cs in every for c in cs], "claim_id string, " + SCHEMA + ", expected string")
    authorised = spark.createDataFrame([(w, n) for w, ns in held.items() for n in ns], "world string, rule_id string")
    got = {r.claim_id: (r.label, r.evidence, r.rules, r.codes) for r in proofs.verified(claims, facts, rules, authorised).collect()}
    seen = set()
    for w, fs, cs in every:
        for c in cs:
            name, evidence, used, both = label(c[1:7], fs, held[w])
            loose = any(label(c[1:7], [f for f in fs if f[0] != i], held[w])[0] != "UNKNOWN" for i in evidence)
            codes = [x for x, on in (("CO_TRUTH_POSSIBLE", both), ("MINIMALITY_ABLATION_FAIL", loose), ("UNPROVIDED_PREMISE", not evidence), ("VERIFIER_DISAGREEMENT", c[7] is not None and name != c[7])) if on]
            assert got[c[0]] == (name, evidence, used, codes), (c, fs)
            seen |= set(codes)
    assert len(seen) == 4 and len(got) == sum(len(cs) for _, _, cs in every)


def test_a_competing_chain_becomes_unique(spark):
    row = lambda i, s, o: (i, "w", "BEFORE", s, o, None, "positive", {})
    facts = spark.createDataFrame([row("a", "s", "o"), row("b", "o", "o"), row("c", "s", "m"), row("d", "m", "o")], "fact_id string, " + SCHEMA)
    claims = spark.createDataFrame([("k", "w", "BEFORE", "s", "o", None, "positive", None, "SUPPORTED")], "claim_id string, " + SCHEMA + ", expected string")
    r = proofs.verified(claims, facts, proofs.standard_rules(spark)).first()
    assert (r.label, r.evidence, r.codes) == ("SUPPORTED", ["a"], ["MINIMALITY_ABLATION_FAIL"])
    with pytest.raises(ValueError, match="REPEATED_CLAIM_ID"):
        proofs.verified(claims.union(claims), facts, proofs.standard_rules(spark))
    assert proofs.verified(claims.limit(0), facts, proofs.standard_rules(spark)).count() == 0
