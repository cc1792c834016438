"""Mixing sources to target weights: repetition rates and seeded copies, all in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, join_counted, materialize

#: A table of sources up to this many rows is broadcast (at most a few MB); a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, most: float = 3.0, cycle: int = 3) -> DataFrame:
    """One row per source: source, documents, source_size, target, rate.

    sizes: source (string, may be null), size (long). Sources in order of code points, null
    last, weigh 1, 2 .. ``cycle``, repeating. Targets share the sum of all sizes by weight
    but stop at ``most`` times the source's size; what is over goes to the others by weight
    until none is above. That is the level at which targets min(most * size, level * weight)
    add up: in order of most * size / weight, sources stop at their limit as long as the
    level of the rest is above it.

    Sums are made per source before anything is shuffled, so only as many rows as there
    are sources are ordered. A source of size 0 has target and rate 0.
    """
    # binary order is the order of code points
    per = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = per.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1.0)
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("stops_at", F.col("limit") / F.col("weight"))
    by_stop = W.orderBy("stops_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    everything = by_stop.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest_size = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", rest_size / rest_weight)
    # the first source that stays below its limit sets the level of all after it
    open_level = F.first(F.when(F.col("level") <= F.col("stops_at"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least("limit", F.coalesce(open_level, F.col("stops_at")) * F.col("weight"))
    return levels.withColumn("target", target).select("source", "documents", "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))


def unit_hash(*columns: Column | str) -> Column:
    """A number in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


#: Columns that ``mix_plan`` adds.
ADDED = ["size", "source_size", "target", "rate", "copies"]


def mix_plan(docs: DataFrame, seed: int = 42, most: float = 3.0) -> DataFrame:
    """Add size, source_size, target, rate and copies to documents.

    docs: doc_id, text, source and any other columns; all are kept but those with the names of the added
    ones, which are replaced. copies is floor(rate), plus
    1 with probability rate - floor(rate) by a hash of seed, doc_id, source and text, so
    equal rows get equal numbers and reruns agree. Null texts have size 0; a null source is
    a source of its own; no rows give none.
    """
    sized = docs.drop(*ADDED).withColumn("size", word_count(F.col("text")))
    targets = materialize(source_targets(sized.select("source", "size"), most), "targets")
    sources, total = targets.agg(F.count("*"), F.sum("documents")).first()
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source is a source as well
    name = "_key"
    while name in (c.lower() for c in docs.columns):  # a column of the input keeps its name and values
        name += "_"
    right = targets.select(key.alias(name), "documents", "source_size", "target", "rate")
    left = sized.withColumn(name, key)
    small = sources <= BROADCAST_SOURCES
    joined = (left.join(F.broadcast(right.drop("documents")), name) if small else join_counted(left, right, [name], "documents", total, "inner")).drop(name)
    chance = unit_hash(F.lit(seed), "doc_id", "source", "text")
    return joined.withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, seed: int = 42, most: float = 3.0) -> DataFrame:
    """The mixed documents: each row as often as its copies say, with all its columns and column _copy
    (from 0; one that is there is replaced)."""
    own = [c for c in docs.columns if c != "_copy"]
    row = docs.select("doc_id", "text", "source", F.struct(*own).alias("_row"))
    planned = mix_plan(row, seed, most).where("copies > 0")
    return planned.select("_row.*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_copy"))
