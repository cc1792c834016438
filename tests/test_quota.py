"""Selections in phases and in turns against plain sequential walks."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import quota


def walk(rows, phases, caps):
    """rows: dicts with 'key'; phases: (name, eligible, target, of_all); caps: (key function, most function)."""
    taken, used = {}, {}
    for name, eligible, target, of_all in phases:
        count = sum(eligible(r) for r in rows if r["key"] in taken) if of_all else 0
        for r in sorted(rows, key=lambda r: r["key"]):
            if count >= target:
                break
            if r["key"] in taken or not eligible(r):
                continue
            mine = [(i, key(r)) for i, (key, _) in enumerate(caps) if key(r) is not None]
            if any(used.get(m, 0) >= caps[m[0]][1](r) for m in mine):
                continue
            taken[r["key"]] = name
            count += 1
            for m in mine:
                used[m] = used.get(m, 0) + 1
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_phases_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [{"key": f"{rng.random():.12f}", "family": rng.choice("abc"), "scene": rng.randrange(12 if seed < 3 else 1), "split": rng.choice(["train", "test"]), "kind": rng.choice("xyyy"), "move": rng.choice("pq")} for _ in range(160)]
    quotas = {"a": 14, "b": 9, "c": 20}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "key string, family string, scene int, split string, kind string, move string").repartition(5)
    test = F.col("split") == "test"
    most = F.when(F.col("family") == "a", 14).when(F.col("family") == "b", 9).otherwise(20)
    caps = [quota.Cap("family", F.col("family"), most), quota.Cap("scene", F.concat_ws("/", "scene", "split"), F.when(test, 2).otherwise(5)), quota.Cap("move", F.when(test, F.concat_ws("/", "scene", "move")), 1)]
    phases = [quota.Phase("kind", F.col("kind") == "x", 6, True), quota.Phase("test", test, 9, True), quota.Phase("rest", F.lit(True), (30, 1000, 25, 8)[seed], True)]
    got, rounds = quota.phased(df, ["key"], caps, phases)
    plain_caps = [(lambda r: r["family"], lambda r: quotas[r["family"]]), (lambda r: (r["scene"], r["split"]), lambda r: 2 if r["split"] == "test" else 5), (lambda r: (r["scene"], r["move"]) if r["split"] == "test" else None, lambda r: 1)]
    want = walk(rows, [("kind", lambda r: r["kind"] == "x", 6, True), ("test", lambda r: r["split"] == "test", 9, True), ("rest", lambda r: True, (30, 1000, 25, 8)[seed], True)], plain_caps)
    assert {r.key: r.phase for r in got.collect()} == want
    assert rounds < 25


def test_reasons_take_each_row_and_each_test_world_once(spark):
    rng = random.Random(7)
    rows = [{"key": k * 7919 % 1009, "world": rng.randrange(25), "split": rng.choice(["train", "test"]), "n": rng.randrange(6)} for k in range(120)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "key int, world int, split string, n int")
    reasons = {"even": (F.col("n") % 2 == 0, lambda r: r["n"] % 2 == 0, 13), "three": (F.col("n") % 3 == 0, lambda r: r["n"] % 3 == 0, 30), "any": (F.lit(True), lambda r: True, 11)}
    got, _ = quota.phased(df, ["key"], [quota.Cap("world", F.when(F.col("split") == "test", F.col("world")), 1)], [quota.Phase(name, c, n) for name, (c, _, n) in reasons.items()])
    want = walk(rows, [(name, f, n, False) for name, (_, f, n) in reasons.items()], [(lambda r: r["world"] if r["split"] == "test" else None, lambda r: 1)])
    assert {r.key: r.phase for r in got.collect()} == want
    empty, rounds = quota.phased(df.limit(0), ["key"], [quota.Cap("world", F.col("world"), 1)], [quota.Phase("all", F.lit(True), 5)])
    assert empty.count() == 0 and rounds <= 1


def plain_turns(rows, limit):
    lists = {}
    for o, s, k in sorted(rows, key=lambda r: r[2]):
        if o is not None and s is not None:
            lists.setdefault(o, []).append((s, k))
    out, used, turn = [], set(), 0
    while len(out) < limit:
        turn += 1
        before = len(out)
        for o in sorted(lists):
            while lists[o] and lists[o][0][0] in used:
                lists[o].pop(0)
            if lists[o] and len(out) < limit:
                s, k = lists[o].pop(0)
                used.add(s)
                out.append((o, s, k, turn, len(out) + 1))
        if len(out) == before:
            break
    return out


@pytest.mark.parametrize("sources,limit,block", [(30, 1000, 3), (200, 60, 7), (5, 1000, 100), (90, 41, 1), (1, 10, 2)])
def test_turns_equal_the_walk(spark, sources, limit, block):
    rng = random.Random(sources)
    rows = [(rng.choice(["a", "b", "c", "c", "c", None]), rng.choice([*range(sources), None]), k * 7919 % 1009) for k in range(260)]
    df = spark.createDataFrame(rows, "op string, source int, key int").repartition(4)
    got = quota.turns(df, "op", "source", ["key"], limit, block).collect()
    assert sorted((r.op, r.source, r.key, r.turn, r.position) for r in got) == sorted(plain_turns(rows, limit))
    assert quota.turns(df.limit(0), "op", "source", ["key"], 5).count() == 0
