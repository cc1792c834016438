"""Components of random graphs and of a star, against a plain walk; the join that keeps great keys apart."""

import random

from pyspark.sql import functions as F

from factloom.operators.graph import components
from factloom.operators.joins import join_by_share


def plain(edges):
    least = {n: n for e in edges for n in e}

    def root(n):
        while least[n] != n:
            least[n] = least[least[n]]
            n = least[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in least}


def test_components_with_a_hub_and_chains(spark):
    rng = random.Random(5)
    star = [(7_000, i) for i in range(3_000)]
    chain = [(i, i + 1) for i in range(10_000, 10_040)]
    loose = [(rng.randrange(20_000, 26_000), rng.randrange(20_000, 26_000)) for _ in range(3_000)]
    edges = star + chain + loose + [(5, 5), (10_001, 10_000)] + star[:50]
    rows = spark.createDataFrame(edges + [(None, 3), (4, None)], "src bigint, dst bigint")
    assert {r.node: r.component for r in components(rows).collect()} == plain(edges)
    assert components(rows.limit(0)).count() == 0


def test_join_by_share_is_the_inner_join(spark):
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    small = spark.range(2_500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    order = lambda df: sorted(map(tuple, df.select("id", "k", "v").collect()))
    assert order(join_by_share(rows, small, "k")) == order(rows.join(small, "k"))
    assert join_by_share(rows.limit(0), small, "k").count() == 0 and join_by_share(rows, small.limit(0), "k").count() == 0
