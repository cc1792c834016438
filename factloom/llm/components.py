"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("bigint")).alias("n")), "least")
    far = join_counted(both.where("v > u"), least, ["u"], "n", total, "inner").where("v <> m")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` with u > v, a written table."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    moved = join_counted(edges, least, ["u"], "n", total, "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return (node, component): each node of an edge with the smallest node it reaches.

    Each round is a few joins and grouped minima over long keys; its edges are written
    to the shared folder, so nothing is gathered on the driver and no lineage grows. Nodes with a
    great share of all edges are joined by broadcast, so a hub is no single task. The
    number of rounds grows with the logarithm of the longest path. Null ends and loops
    are ignored; no edges give no rows.
    """
    now = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct(),
        "components",
    )
    before = _mark(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        stars = materialize(_large_star(now, before[0]).distinct(), "stars")
        now = materialize(_small_star(stars, before[0]).distinct(), "components")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return least.select(F.col("u").alias("node"), "component").union(roots)
