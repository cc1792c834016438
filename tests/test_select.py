from pyspark.sql import functions as F

from factloom.operators import select


def walk(rows, caps, target):
    used, out, taken = {}, {}, 0
    for r in sorted(rows):
        full = next((k for k, cap in enumerate(caps) if used.get((k, r[k + 1]), 0) >= cap), None)
        if taken >= target:
            out[r[0]] = "TARGET_REACHED"
        elif full is not None:
            out[r[0]] = "CAP_" + "abc"[full]
        else:
            taken += 1
            out[r[0]] = "TAKEN"
            for k in range(len(caps)):
                used[k, r[k + 1]] = used.get((k, r[k + 1]), 0) + 1
    return out


def test_greedy_caps_equals_the_walk(spark):
    rows = [(k * 7919 % 1009, k % 5, k % 7, k % 11) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int")
    for target in (10, 40, 1000):
        got = {r.id: r.outcome for r in select.greedy_caps(df, ["id"], {"a": 9, "b": 5, "c": 4}, target).collect()}
        assert got == walk(rows, (9, 5, 4), target)


def test_global_rank_counts_all_rows(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as k").repartition(7)
    got = sorted((r["rank"], r["k"], r["id"]) for r in select.globally_ranked(df, "k", "id").collect())
    assert [g[0] for g in got] == list(range(1, 1001))
    assert [g[1:] for g in got] == sorted((g[1], g[2]) for g in got)


def test_ratio_capped_equals_the_walk(spark):
    for seed, share in ((1, 3), (2, 2), (3, 7), (4, 1)):
        rows = [(k, None if k % 41 == 0 else (k * 7919 + seed) % 1009 % share == 0) for k in range(400)]
        plain = flagged = 0
        want = {}
        for k, flag in rows:
            if not flag:
                plain += 1
                want[k] = True
            else:
                want[k] = 100 * (flagged + 1) <= 15 * (flagged + 1 + plain)
                flagged += want[k]
        df = spark.createDataFrame(rows, "id int, flag boolean").repartition(5)
        assert {r.id: r.taken for r in select.ratio_capped(df, ["id"], "flag", 15, 100).collect()} == want


def test_ranks_of_more_rows_than_a_sample_holds(spark):
    """Counts and columns beyond the order don't make the rows' and the sizes' ranges differ."""
    rows = spark.range(60_000).groupBy((F.col("id") % 5).alias("level"), (F.col("id") % 20_000).alias("world")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    for parts in (3, 16):
        out = select.globally_ranked(rows, "level", "world", parts=parts)
        n, distinct, low, high = out.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
        assert (n, distinct, low, high) == (20_000, 20_000, 1, 20_000)
        assert out.where("rank <= 4000 and level <> 0 or rank > 16000 and level <> 4").count() == 0
