"""Joins and unions that say what didn't fit, chains, boxes and ratios."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join in which a key of ``left`` without a partner is an error, raised where the row is."""
    marked = right.withColumn("_there", F.lit(True))
    joined = left.join(marked, key, "left")
    fail = F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn("_there", F.when(F.col("_there"), True).otherwise(fail)).where("_there").drop("_there")


def union_unique(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of all parts, with copies (rows that have the key) and status (UNIQUE or DUPLICATE_ID), one row per key: the least by part and columns."""
    every = functools.reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(k)) for k, d in enumerate(parts)])
    rest = [c for c in every.columns if c not in (key, "part")]
    first = F.min(F.struct("part", *rest)).alias("first")
    return every.groupBy(key).agg(first, F.count("*").alias("copies")).select(key, "first.*", "copies", F.when(F.col("copies") == 1, "UNIQUE").otherwise("DUPLICATE_ID").alias("status"))


def merged_splits(parts: list[DataFrame], key: str, split: str) -> DataFrame:
    """One split per key over several maps; keys with two splits have none and status SPLIT_CONFLICT."""
    every = functools.reduce(DataFrame.unionByName, parts)
    out = every.groupBy(key).agg(F.min(split).alias("a"), F.max(split).alias("b"), F.count("*").alias("maps"))
    same = F.col("a") == F.col("b")
    return out.select(key, F.when(same, F.col("a")).alias(split), "maps", F.when(same, "MERGED").otherwise("SPLIT_CONFLICT").alias("status"))


def in_all(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Keys that every group has."""
    groups = rows.agg(F.count_distinct(group).alias("_all"))
    return rows.groupBy(key).agg(F.count_distinct(group).alias("_n")).join(F.broadcast(groups), F.col("_n") == F.col("_all")).select(key)  # one row


def unambiguous(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, status: the one value that a composite key has, else null and AMBIGUOUS."""
    out = rows.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    one = F.col("a").eqNullSafe(F.col("b"))
    return out.select(*keys, F.when(one, F.col("a")).alias(value), F.when(one, "MATCHED").otherwise("AMBIGUOUS").alias("status"))


def dependency_breaks(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and breaks: the columns (sorted, comma-joined) that aren't constant within a key; keys without any are left out."""
    out = rows.groupBy(*keys).agg(*[(F.count_distinct(c) > 1).alias(f"_{c}") for c in columns])
    breaks = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{c}"), c) for c in sorted(columns)])), ",")
    return out.select(*keys, breaks.alias("breaks")).where("breaks <> ''")


def all_chains(edges: DataFrame) -> DataFrame:
    """(world, low, high, conclusions): each unordered pair of different edges (edge_id) that follow one another, once."""
    first = edges.select("world", F.col("edge_id").alias("one"), "subject", F.col("object").alias("middle"))
    second = edges.select("world", F.col("edge_id").alias("two"), F.col("subject").alias("middle"), "object")
    pairs = first.join(second, ["world", "middle"]).where("one <> two and subject <> object")
    return pairs.groupBy("world", F.least("one", "two").alias("low"), F.greatest("one", "two").alias("high")).agg(F.count("*").alias("conclusions"))


def settled_chains(edges: DataFrame) -> DataFrame:
    """(world, subject, object, middle): chains over exactly one middle, without nodes that have an edge in both directions."""
    plain = edges.select("world", "subject", "object").distinct()
    back = plain.select("world", F.col("object").alias("subject"), F.col("subject").alias("object"))
    bad = plain.join(back, ["world", "subject", "object"], "left_semi").select("world", F.explode(F.array("subject", "object")).alias("node")).distinct()
    for side in ("subject", "object"):
        plain = plain.join(bad.withColumnRenamed("node", side), ["world", side], "left_anti")
    first = plain.select("world", "subject", F.col("object").alias("middle"))
    second = plain.select("world", F.col("subject").alias("middle"), "object")
    found = first.join(second, ["world", "middle"]).where("subject <> object").groupBy("world", "subject", "object")
    return found.agg(F.count_distinct("middle").alias("n"), F.min("middle").alias("middle")).where("n = 1").drop("n")


def box_interval(centre: list[Column], size: list[Column], angles: list[Column]) -> list[tuple[Column, Column]]:
    """(low, high) on each axis of a box turned by angles about z, x and y in that order; null where a size isn't above 0 or a number isn't finite."""
    (ca, cb, cg), (sa, sb, sg) = [[f(a) for a in angles] for f in (F.cos, F.sin)]
    matrix = [[ca * cg - sa * sb * sg, -sa * cb, ca * sg + sa * sb * cg], [sa * cg + ca * sb * sg, ca * cb, sa * sg - ca * sb * cg], [-cb * sg, sb, cb * cg]]
    numbers = [*centre, *size, *angles]
    fine = functools.reduce(Column.__and__, [s > 0 for s in size] + [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in numbers])
    reach = [functools.reduce(Column.__add__, [F.abs(m) * s / 2 for m, s in zip(row, size, strict=True)]) for row in matrix]
    return [(F.when(fine, c - r), F.when(fine, c + r)) for c, r in zip(centre, reach, strict=True)]


def ratio_by_cluster(rows: DataFrame, group: str, cluster: str, value: str) -> DataFrame:
    """Numerator, denominator, clusters, the mean of cluster means, and where nothing occurs the 95 % upper bound 1 - 0.05^(1/clusters).

    Rows with a null value don't count.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(group, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    out = each.groupBy(group).agg(F.sum("s").alias("numerator"), F.sum("n").alias("denominator"), F.count("*").alias("clusters"), F.avg(F.col("s") / F.col("n")).alias("macro"))
    return out.withColumn("zero_event_upper", F.when(F.col("numerator") == 0, 1 - F.pow(F.lit(0.05), 1 / F.col("clusters"))))


def all_components(pairs: DataFrame, key: str, components: list[str]) -> DataFrame:
    """key, the components that failed (comma-joined, in the order given) and passed: whether all of them hold; null counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), c) for c in components]))
    return pairs.select(key, F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


