"""Facts, worlds and rule reasoning as joins and grouped aggregates.

A fact has world, predicate, subject, object and, where it matters, polarity, value and ordinal. Nothing is
derived from the absence of a fact: refutation always needs a fact that matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import content_id
from ..sources.tables import digest, materialize
from .joins import join_by_share

#: Predicates and their inverses, and those that chain.
INVERSE = {"BEFORE": "AFTER", "AFTER": "BEFORE", "LEFT_OF": "RIGHT_OF", "RIGHT_OF": "LEFT_OF", "ABOVE": "BELOW", "BELOW": "ABOVE", "FRONT_OF": "BEHIND", "BEHIND": "FRONT_OF"}
TRANSITIVE = ("BEFORE", "AFTER", "LEFT_OF", "RIGHT_OF", "ABOVE", "BELOW")


def inverse_of(predicate: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in INVERSE.items():
        out = F.when(predicate == a, b).otherwise(out)
    return out


def merge_duplicates(facts: DataFrame) -> DataFrame:
    """Facts that agree in world, predicate, subject and object become one: the survivor is the least
    fact_id, and the ordinals of all stay as its sources."""
    with_id = facts.withColumn("fact_id", content_id("fact", world=F.col("world"), predicate=F.col("predicate"), subject=F.col("subject"), object=F.col("object"), ordinal=F.col("ordinal")))
    return with_id.groupBy("world", "predicate", "subject", "object").agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("copies"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


def normalised(facts: DataFrame, predicate: str = "BEFORE") -> DataFrame:
    """Edges of one predicate, those of its inverse turned round."""
    turned = F.col("predicate") == INVERSE[predicate]
    edges = facts.where(F.col("predicate").isin(predicate, INVERSE[predicate]))
    return edges.select("world", F.lit(predicate).alias("predicate"), F.when(turned, F.col("object")).otherwise(F.col("subject")).alias("subject"), F.when(turned, F.col("subject")).otherwise(F.col("object")).alias("object"))


def two_hop(facts: DataFrame, irreducible: bool = True) -> DataFrame:
    """Conclusions subject -> object over exactly one path of two facts of a world and predicate.

    Paths are counted, so a premise that is stated twice makes two and none is concluded. With ``irreducible``, what is
    stated directly isn't concluded. Both sides of the join are dealt by world, predicate and the middle.
    """
    edges = facts.where(F.col("predicate").isin(*TRANSITIVE)).select("world", "predicate", "subject", "object")
    first = edges.select("world", "predicate", "subject", F.col("object").alias("middle"))
    second = edges.select("world", "predicate", F.col("subject").alias("middle"), "object")
    paths = first.join(second, ["world", "predicate", "middle"]).where("subject <> object")
    unique = paths.groupBy("world", "predicate", "subject", "object").agg(F.count("*").alias("paths"), F.min("middle").alias("middle")).where("paths = 1").drop("paths")
    return unique.join(edges, ["world", "predicate", "subject", "object"], "left_anti") if irreducible else unique


def conflicts(facts: DataFrame) -> DataFrame:
    """(world, code, n): polarity, exclusivity and count conflicts.

    facts: world, predicate, subject, object, polarity, value.
    """
    key = ["world", "predicate", "subject", "object"]
    # one aggregate of fixed width for each code: counts of distinct values and joins would hold several tables of a task's facts at once
    hashed = F.when(F.col("polarity").isNotNull(), F.xxhash64("polarity"))
    polarity = facts.groupBy(*key, "value").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).where("low <> high").groupBy("world").agg(F.lit("POLARITY_CONFLICT").alias("code"), F.count("*").alias("n"))
    inverse = inverse_of(F.col("predicate"))
    pairs = facts.where("polarity = 'positive' and world is not null and subject is not null and object is not null").where(inverse.isNotNull()).select("world", F.least("predicate", inverse).alias("pair"), "subject", "object", (F.col("predicate") < inverse).alias("first"))
    both = pairs.groupBy("world", "pair", "subject", "object").agg(F.bool_or("first").alias("a"), F.bool_or(~F.col("first")).alias("b")).where("a and b")
    exclusive = both.groupBy("world").agg(F.lit("EXCLUSIVITY_CONFLICT").alias("code"), (2 * F.count("*")).alias("n"))
    count = facts.where("predicate = 'COUNT'").groupBy("world", "subject").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high").groupBy("world").agg(F.lit("COUNT_CONFLICT").alias("code"), F.count("*").alias("n"))
    return polarity.unionByName(exclusive).unionByName(count)


def label_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """SUPPORTED, CONTRADICTORY or UNKNOWN for each claim (claim_id, world, predicate, subject, object).

    Support is a stated fact, its inverse or a unique path of two; refutation is the same for the reverse of an asymmetric claim. Both
    or neither is UNKNOWN; both is marked.
    """
    # a table, so that the facts aren't worked out again for each use and no task holds what makes them and what uses them at once
    edges = materialize(normalised(facts).distinct(), "edges")
    direct = edges.select("world", "subject", "object", F.lit(True).alias("stated"))
    hops = two_hop(edges, irreducible=False).select("world", "subject", "object", F.lit(False).alias("stated"))
    found = direct.unionByName(hops).groupBy("world", "subject", "object").agg(F.bool_or("stated").alias("stated"))
    known = found.select("world", "subject", "object", F.when(F.col("stated"), "direct").otherwise("two_hop").alias("how"))
    same = claims.join(known.withColumnRenamed("how", "support"), ["world", "subject", "object"], "left")
    turned = known.select("world", F.col("object").alias("subject"), F.col("subject").alias("object"), F.col("how").alias("refute"))
    both = same.join(turned, ["world", "subject", "object"], "left")
    s, r = F.col("support").isNotNull(), F.col("refute").isNotNull()
    label = F.when(s & ~r, "SUPPORTED").when(r & ~s, "CONTRADICTORY").otherwise("UNKNOWN")
    return both.select("claim_id", "world", "subject", "object", "support", "refute", label.alias("label"), (s & r).alias("co_truth"))


def separated(a_low: Column, a_high: Column, b_low: Column, b_high: Column, margin: float = 0.02) -> Column:
    """BEFORE where a ends more than the margin before b begins, AFTER for the reverse, else null."""
    return F.when(a_high + margin < b_low, "BEFORE").when(b_high + margin < a_low, "AFTER")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node that edges reach, by propagation with pointer jumping.

    Each round takes the least label among a node and its neighbours, then the label of that label; rounds are
    written to the shared folder and stop when no label changes. A node with a great part of all edges, and a label that
    most nodes share, reach their rows by broadcast (``joins.join_by_share``), so neither is one task. All else is shuffled: a
    table of labels has small files at sizes where a broadcast of it, in each round, is much for the driver.
    """
    both = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(F.col(dst), F.col(src))).where("a is not null and b is not null").distinct(), "edges")
    labels = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    mark = digest(labels)
    while True:
        near = join_by_share(both, labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = materialize(labels.join(near.hint("merge"), "node").select("node", F.least("component", "near").alias("component")), "labels")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = materialize(join_by_share(step, jump, "component").select("node", F.col("further").alias("component")), "labels")
        after = digest(labels)
        if after == mark:
            return labels
        mark = after
