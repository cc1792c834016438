"""Joins with the reference semantics: misses as codes, unique matches, donors, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_or_reject(left: DataFrame, right: DataFrame, on: Sequence[str], code: str) -> DataFrame:
    """All left rows with the right columns; ``reject_code`` is set where there is no match."""
    found = right.withColumn("_found", F.lit(True))
    return left.join(found, list(on), "left").withColumn("reject_code", F.when(F.col("_found").isNull(), code)).drop("_found")


def last_wins(rows: DataFrame, keys: Sequence[str], *ordinal: str) -> DataFrame:
    """The row of each key that was loaded last."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ordinal])
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def unique_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """The right value where a key has exactly one, else null."""
    one = right.groupBy(*on).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return left.join(one, list(on), "left")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key) of ids that only one of two tables has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").select(F.lit("left").alias("side"), key).union(right.join(left, key, "left_anti").select(F.lit("right").alias("side"), key))


def next_other(rows: DataFrame, order: Sequence[Column | str], differs: str, value: str) -> DataFrame:
    """For each row the first later one, in a group's order, whose ``differs`` is another.

    Runs of equal values share the next run's first row, so two windows over small columns do: no pair of
    rows is made. ``rows`` must have column ``grp``.
    """
    w = Window.partitionBy("grp").orderBy(*order)
    begins = rows.withColumn("_new", F.coalesce(F.lag(differs).over(w) != F.col(differs), F.lit(True)))
    run = begins.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    heads = run.where("_new").select("grp", (F.col("_run") - 1).alias("_run"), F.col(value).alias("donor"))
    return run.join(heads, ["grp", "_run"], "left").drop("_new", "_run")


def separated_within(boxes: DataFrame, group: str, low: str, high: str, margin: float) -> DataFrame:
    """Number of pairs (a, b) of a group with a.high + margin < b.low, per group, without making the pairs.

    Ends and beginnings of a group are merged in one order; each beginning counts the ends before it.
    """
    ends = boxes.select(group, (F.col(high) + margin).alias("_at"), F.lit(1).alias("_end"))
    begins = boxes.select(group, F.col(low).alias("_at"), F.lit(0).alias("_end"))
    # beginnings come first among equals, since an end at the same place isn't before it
    w = Window.partitionBy(group).orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = ends.union(begins).withColumn("_seen", F.sum("_end").over(w))
    return merged.where("_end = 0").groupBy(group).agg(F.sum("_seen").alias("pairs"))


def prefer(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Merge two tables by key: the first's value where it has one, else the second's."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "first").otherwise("second").alias("origin"))


def join_by_share(rows: DataFrame, small: DataFrame, key: str, share: int = 1_000) -> DataFrame:
    """Inner join of rows with a table that has each key once, where some keys may hold a great part of all rows.

    Keys with more than one in ``share`` of the rows, which are fewer than ``share``, go to the rows by broadcast; only the others are shuffled, however small their table's files are, so what passes through the driver
    doesn't grow with the tables. Rows with a null key have no match.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))
    great = sizes.join(F.broadcast(total), F.col("_n") * share > F.col("_all")).select(key, F.lit(True).alias("_great"))
    marked = rows.join(F.broadcast(great), key, "left")
    hot, rest = marked.where("_great").drop("_great"), marked.where("_great is null").drop("_great")
    return hot.join(F.broadcast(small.join(F.broadcast(great.select(key)), key, "left_semi")), key).unionByName(rest.join(small.hint("merge"), key))
