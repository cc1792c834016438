"""The engine's codes, the checker's families and the states after, against plain Python on random states."""

import random
from collections import Counter

from factloom.operators import transitions as tr

FACT = "predicate string, subject string, object string, scope string, value bigint"
TURN = {"LEFT_OF": "RIGHT_OF", "ABOVE": "BELOW"}
REJECT = "REJECT_TRANSITION_PRECONDITION_FAIL"


def slot(f):
    return tuple(x or "" for x in f[:4])


def engine(pre, deletes, adds, allowed):
    many = lambda xs: max(Counter(map(slot, xs)).values(), default=0) > 1
    codes = {"DUPLICATE_PRE_FACT_SLOT": many(pre), "DELETE_FACT_NOT_IN_PRESTATE": bool({slot(d) for d in deletes} - {slot(f) for f in pre}), "DUPLICATE_DELETE_FACT_SLOT": many(deletes)}
    codes |= {"INVALID_POST_COUNT": any(f[0] == "COUNT" and (f[4] is None or f[4] < 0) for f in adds), "DUPLICATE_POST_FACT_SLOT": many(adds), "UNLISTED_POST_FACT_UPDATE": bool({slot(f) for f in adds} - {slot(a) for a in allowed})}
    return sorted(c for c, on in codes.items() if on)


def rule(pre, a):
    def one(predicate, subject, other=""):
        found = [f for f in pre if (f[0], f[1], f[2] or "") == (predicate, subject, other)]
        return found[0] if len(found) == 1 and subject is not None else None

    local = "question_local"
    gone, come, other = ("EXISTS_IN_WORLD", a["target"], "", local, 0), ("EXISTS_IN_WORLD", a["new_entity"], "", local, 1), ("SAME_INSTANCE", a["new_entity"], a["target"], local, 0)
    n, m, there = one("COUNT", a["category"]), one("COUNT", a["new_category"]), one("EXISTS_IN_WORLD", a["target"])
    is_there, some = bool(there) and there[4] == 1, bool(n) and (n[4] or 0) >= 1
    count = lambda f, by: ("COUNT", f[1], "", f[3], f[4] + by)
    family = a["family"]
    if family == "REMOVE_AND_RECOUNT":
        return [count(n, -1), gone] if is_there and some else REJECT
    if family == "ADD_AND_RECOUNT":
        return [count(n, 1), come] if n and a["quantity"] == 1 and a["new_entity"] else REJECT
    if family == "REPLACE_AND_RECOUNT":
        return [count(n, -1), count(m, 1), gone, come, other] if a["new_entity"] and a["category"] != a["new_category"] and some and m and is_there else REJECT
    if family == "REPLACEMENT_IDENTITY":
        return [gone, come, other] if a["new_entity"] and is_there else REJECT
    if family in ("MOVE_TO_OPPOSITE_SIDE", "SWAP_POSITIONS"):
        return [(TURN[a["pre_predicate"]], a["target"], a["anchor"], local, None)] if a["pre_predicate"] in TURN and one(a["pre_predicate"], a["target"], a["anchor"]) else REJECT
    return "REJECT_UNAUTHORIZED_RULE"


def test_both_sides_equal_plain_ones(spark):
    rng = random.Random(6)
    pre, actions, lists, want = [], [], {"d": [], "a": [], "l": []}, {}
    families = ["REMOVE_AND_RECOUNT", "ADD_AND_RECOUNT", "REPLACE_AND_RECOUNT", "REPLACEMENT_IDENTITY", "MOVE_TO_OPPOSITE_SIDE", "SWAP_POSITIONS", "PAINT", None]
    for s in range(150):
        state = [("COUNT", k, None, rng.choice(["whole_scene", "scene"]), rng.randrange(3)) for k in "pq" if rng.random() < 0.9] + [("EXISTS_IN_WORLD", e, None, "question_local", int(rng.random() < 0.8)) for e in "xy"]
        state += [(rng.choice(["LEFT_OF", "ABOVE", "NEAR"]), "x", "y", "question_local", None)] + ([rng.choice(state)] if rng.random() < 0.15 else [])
        pre += [(s, *f) for f in state]
        for k in range(3):
            a = {"family": rng.choice(families), "target": rng.choice(["x", "y", "z", None]) if rng.random() < 0.2 else "x", "category": rng.choice("pqr"), "new_category": rng.choice("pq"), "new_entity": rng.choice(["n", "n", "n", None, ""]), "anchor": "y", "quantity": rng.choice([1, 1, 2, None]), "pre_predicate": rng.choice(["LEFT_OF", "ABOVE", "NEAR"])}
            i, post = f"{s}-{k}", rule(state, a)
            actions.append((i, s, *a.values()))
            adds = list(post) if isinstance(post, list) else [("COUNT", "p", None, "scene", 1)]
            if rng.random() < 0.3:
                j = rng.randrange(len(adds))
                adds[j] = (*adds[j][:4], rng.choice([None, -1, 7]))
            adds += rng.sample(adds, int(rng.random() < 0.1))
            deletes = [f[:4] for f in rng.sample(state, rng.randrange(3))] + [("COUNT", "nothing", None, "scene")] * (rng.random() < 0.1)
            deletes += deletes[:1] * (rng.random() < 0.1)
            allowed = [f[:4] for f in adds[: None if rng.random() < 0.8 else -1]]
            for name, rows in (("d", deletes), ("a", adds), ("l", allowed)):
                lists[name] += [(i, *f) for f in rows]
            errors = engine(state, deletes, adds, allowed)
            facts = lambda fs: sorted(str((*slot(f), f[4])) for f in fs)
            same = isinstance(post, list) and not errors and facts(post) == facts(adds)
            after = None
            if same:
                after = facts([f for f in state if slot(f) not in {slot(d) for d in deletes}] + adds)
            want[i] = (errors, post if isinstance(post, str) else None, same, after)
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    acts = make(actions, "action_id string, state int, family string, target string, category string, new_category string, new_entity string, anchor string, quantity int, pre_predicate string")
    before, deletes, adds, allowed = make(pre, "state int, " + FACT), make(lists["d"], "action_id string, predicate string, subject string, object string, scope string"), make(lists["a"], "action_id string, " + FACT), make(lists["l"], "action_id string, predicate string, subject string, object string, scope string")
    both = tr.compared(tr.executed(acts, before, deletes, adds, allowed), adds, tr.checked(acts, before))
    rows = both.collect()
    assert {r.action_id: (r.errors, r.error, r.agree) for r in rows} == {i: w[:3] for i, w in want.items()}
    got = {}
    for r in tr.successors(both.where("agree").join(acts.select("action_id", "state"), "action_id"), before, deletes, adds).collect():
        got.setdefault(r.action_id, []).append(str((r.predicate, r.subject, r.object, r.scope, r.value)))
    assert {i: sorted(x) for i, x in got.items()} == {i: w[3] for i, w in want.items() if w[2]}
    assert sum(w[2] for w in want.values()) > 20 and len({c for w in want.values() for c in w[0]}) == 6
