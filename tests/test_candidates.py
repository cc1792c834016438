"""Candidates of random scenes against plain Python, and claims on what holds after them."""

import random

from pyspark.sql import functions as F

from factloom.operators import candidates as cd
from factloom.operators import transitions as tr

BOX = ", ".join(f"{a}_{e} double" for a in "xyz" for e in ("low", "high"))
SHOWN = ["scene", "family", "target", "category", "new_category", "anchor", "pre_predicate", "post_predicate", "source_group"]
TURN = {"LEFT_OF": "RIGHT_OF", "RIGHT_OF": "LEFT_OF", "FRONT_OF": "BEHIND", "BEHIND": "FRONT_OF", "ABOVE": "BELOW", "BELOW": "ABOVE"}


def scene_data(rng, scene):
    kinds = ["lamp", "chair", "table", "cup", "door", "vase", "object", ""]
    objects = [(scene, f"o{i}", rng.choice([*kinds, None]), *sum(([x, x + rng.choice((0.5, 1.0))] if rng.random() < 0.97 else [x, None] for x in (rng.randrange(3) * 0.75 for _ in range(3))), [])) for i in range(rng.randrange(7))]
    counts = [(scene, k, rng.choice((0, 1, 1, 1, 1, 1, 2, None))) for k in rng.sample(kinds, rng.randrange(3, 9))]
    ids = [f"o{i}" for i in range(8)]
    relations = [(scene, rng.choice(ids), rng.choice([" Left", "right", "front", "above", "near", None]), rng.choice(ids)) for _ in range(rng.randrange(6))]
    return objects, counts, relations


def plain(scene, objects, counts, relations):
    of = lambda k: [o for o in objects if o[2] == k]
    exact = {k: n for _, k, n in counts if k and n and n >= 1}
    out = set()
    for k, n in exact.items():
        out.add((scene, "ADD_AND_RECOUNT", None, k, None, None, None, None, "COUNT"))
        if n == 1 and len(of(k)) == 1:
            target = of(k)[0][1]
            out.add((scene, "REMOVE_AND_RECOUNT", target, k, None, None, None, None, "OBJECT"))
            out |= {(scene, f, target, k, other, None, None, None, "COUNT_AND_OBJECT") for other in exact if other != k for f in ("REPLACE_AND_RECOUNT", "REPLACEMENT_IDENTITY")}
    alone = {o[1]: o for o in objects if o[2] not in (None, "", "object", "item") and len(of(o[2])) == 1}
    found = {}
    words = {"left": "LEFT_OF", "right": "RIGHT_OF", "front": "FRONT_OF", "above": "ABOVE"}
    for _, s, w, o in relations:
        p = words.get((w or "").strip().lower())
        if p and s in alone and o in alone:
            found[s, p, o] = "STATED"
    for s in sorted(alone):
        for o in sorted(alone):
            a, b = alone[s][3:], alone[o][3:]
            if s < o and None not in a + b and exact.get(alone[s][2]) == exact.get(alone[o][2]) == 1:
                less = lambda p, q, i: p[2 * i + 1] + 0.02 < q[2 * i]
                tries = [("LEFT_OF", less(a, b, 0)), ("RIGHT_OF", less(b, a, 0)), ("FRONT_OF", less(b, a, 1)), ("BEHIND", less(a, b, 1)), ("ABOVE", less(b, a, 2)), ("BELOW", less(a, b, 2))]
                p = next((p for p, on in tries if on), None)
                if p:
                    found.setdefault((s, p, o), "BOXES")
    for (s, p, o), source in found.items():
        out |= {(scene, f, s, alone[s][2], None, o, p, TURN[p], source) for f in ("MOVE_TO_OPPOSITE_SIDE", "SWAP_POSITIONS")}
    return out


def tables(spark, objects, counts, relations):
    return (
        spark.createDataFrame(objects, f"scene string, object_id string, category string, {BOX}"), spark.createDataFrame(counts, "scene string, category string, n bigint"),
        spark.createDataFrame(relations, "scene string, subject_id string, word string, object_id string"),
    )


def every(objects, counts, relations):
    return cd.with_ids(cd.count_candidates(counts, objects).unionByName(cd.relation_candidates(objects, relations, counts)))


def test_candidates_and_claims_of_random_scenes(spark):
    rng = random.Random(11)
    scenes = {f"s{i}": scene_data(rng, f"s{i}") for i in range(80)}
    want = set().union(*(plain(s, *d) for s, d in scenes.items()))
    o, c, r = tables(spark, *[sum((d[i] for d in scenes.values()), []) for i in range(3)])
    found = every(o, c, r)
    rows = [tuple(x) for x in found.select(*SHOWN).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len({x[1] for x in rows}) == 6 and {"STATED", "BOXES"} <= {x[-1] for x in rows}
    assert found.select("action_id").distinct().count() == len(rows)
    checked = tr.checked(found, cd.pre_facts(c, o, found))
    claims = cd.claim_pairs(found, checked)
    got = claims.join(found.select("action_id", "scene", "category", "new_category", "pre_predicate", "post_predicate"), "action_id").collect()
    assert len(got) == len(rows) and {x.code for x in got} == {None}
    before = {(s, k): n for s, d in scenes.items() for _, k, n in d[1]}
    for x in got:
        if x.predicate == "COUNT":
            newer = x.family == "REPLACE_AND_RECOUNT" and int(x.action_id[-1], 16) % 2 == 1
            k = x.new_category if newer else x.category
            n = before[x.scene, k]
            assert (x.subject, x.value, x.against_value, x.against_predicate) == (k, n + (1 if newer or x.family == "ADD_AND_RECOUNT" else -1), n, "COUNT")
        elif x.family == "REPLACEMENT_IDENTITY":
            assert (x.predicate, x.value, x.against_predicate, x.against_value, x.changed_slot) == ("SAME_INSTANCE", 0, "SAME_INSTANCE", 1, "value")
        else:
            assert (x.predicate, x.against_predicate, x.changed_slot) == (x.post_predicate, x.pre_predicate, "predicate") and TURN[x.predicate] == x.against_predicate


def test_empty_scenes_and_a_check_that_fails(spark):
    o, c, r = tables(spark, [], [], [])
    assert every(o, c, r).count() == 0
    o, c, r = tables(spark, [("s", "o1", "lamp", *[None] * 6)], [("s", "lamp", 1)], [])
    found = every(o, c, r)
    nothing = cd.pre_facts(c.limit(0), o.limit(0), found.limit(0))
    assert {tuple(x) for x in cd.claim_pairs(found, tr.checked(found, nothing)).select("code", "predicate").collect()} == {("REJECT_TRANSITION_PRECONDITION_FAIL", None)}
    texts = {x.family: x.text for x in found.collect()}
    assert texts == {"ADD_AND_RECOUNT": "Suppose one lamp is added to the scene.", "REMOVE_AND_RECOUNT": "Suppose the lamp is removed from the scene."}


def test_ids_do_not_depend_on_the_source(spark):
    o, c, r = tables(spark, [("s", "a", "lamp", 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), ("s", "b", "cup", 2.0, 3.0, 0.0, 1.0, 0.0, 1.0)], [("s", "lamp", 1), ("s", "cup", 1)], [("s", "a", "left", "b")])
    ids = lambda relations: sorted((x.action_id, x.family) for x in every(o, c, relations).where(F.col("anchor").isNotNull()).collect())
    assert ids(r) == ids(r.limit(0)) and len(ids(r)) == 2
