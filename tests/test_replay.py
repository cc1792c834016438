"""Replayed sequences against a plain replay."""

import random

import pytest

from factloom.operators import replay


def plain(steps, start):
    value = start
    for k, (kind, amount, want) in enumerate(steps, 1):
        if kind not in ("ADD", "REMOVE", "SET", "NOOP") or kind != "NOOP" and (amount is None or amount < 0):
            return len(steps), "INVALID_ACTION", k, None
        value = value + amount if kind == "ADD" else value - amount if kind == "REMOVE" else amount if kind == "SET" else value
        if value < 0:
            return len(steps), "UNDERFLOW", k, None
        if want is not None and want != value:
            return len(steps), "STATE_MISMATCH", k, None
    return len(steps), "VALID", None, value


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_equals_a_plain_replay(spark, parts):
    """Short sequences and one with most of the steps, which lies in several ranges."""
    rng = random.Random(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        sequences = {}
        for s in range(80):
            value, steps = 3, []
            for _ in range(1500 if s == 0 else rng.randrange(1, 14)):
                kind = rng.choice(["ADD", "ADD", "REMOVE", "NOOP"] + ["SET"] * (rng.random() < 0.15))
                amount = rng.randrange(3) if kind != "REMOVE" or rng.random() < 0.1 else rng.randrange(max(0, min(value, 2)) + 1)
                if rng.random() < (0.0 if s == 0 else 0.03):
                    kind, amount = rng.choice([("PAINT", 1), ("ADD", None), ("SET", -1), (None, 1), ("REMOVE", 99)])
                value = {"ADD": value + (amount or 0), "REMOVE": value - (amount or 0), "SET": amount or 0}.get(kind, value)
                steps.append((kind, amount, None if rng.random() < 0.6 else value + (rng.random() < 0.05 and s > 0)))
            sequences[s if s != 7 else None] = steps
        sequences[0][1200] = ("REMOVE", 10**6, None)
        rows = [(s, k, *x) for s, steps in sequences.items() for k, x in enumerate(steps)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "seq int, k int, kind string, amount int, want int").repartition(3)
        got = {r.seq: (r.steps, r.status, r.failed_step, r.final_count) for r in replay.replayed(df, "seq", ["k"], 3).collect()}
        assert got == {s: plain(steps, 3) for s, steps in sequences.items()}
        assert {x[1] for x in got.values()} == {"VALID", "UNDERFLOW", "STATE_MISMATCH", "INVALID_ACTION"}
        assert replay.replayed(df.limit(0), "seq", ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
