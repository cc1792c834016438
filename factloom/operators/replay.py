"""Sequences of actions on a count, replayed as a scan whose parts merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def replayed(steps: DataFrame, key: str, order: Sequence[str], start: int = 0) -> DataFrame:
    """(key, steps, status, failed_step, final_count) of each sequence: its actions in order on a count of ``start``.

    steps: key, the order columns (which tell a sequence's steps apart), kind (ADD, REMOVE, SET or NOOP), amount and want (the count that should be there
    afterwards, or null). ADD and REMOVE change the count by the amount, SET replaces it. The first step that can't be replayed decides:
    INVALID_ACTION (another kind, or an amount that is null or below 0), UNDERFLOW (more is removed than there is) or STATE_MISMATCH (not the count that was wanted); its number, from 1, is
    failed_step, and there is no final count. Else VALID. Rows with a null key are one sequence; no rows give none.

    What a stretch of steps does to a count is either to add a number or to replace it by one, and two stretches after one another do
    one of these again. So rows are dealt in ranges of key and order, each range sums up its stretch of a sequence, the few stretches of a sequence are
    merged in order, and each range replays its steps from the count that it then knows. A sequence with a great share of all steps is cut in
    ranges like any other.
    """
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known, amount = F.col("kind").isin("ADD", "REMOVE", "SET", "NOOP"), F.col("amount")
    valid = F.coalesce(known & ((F.col("kind") == "NOOP") | (amount >= 0)), F.lit(False))
    change = F.when(valid & (F.col("kind") == "ADD"), amount).when(valid & (F.col("kind") == "REMOVE"), -amount).otherwise(0).cast("bigint")
    rows = steps.select(key, *order, "want", valid.alias("_valid"), change.alias("_change"), F.when(valid & (F.col("kind") == "SET"), amount.cast("bigint")).alias("_set"))
    dealt = materialize(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "steps")

    inside = Window.partitionBy(key, "_part").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(key, "_part", "_sets").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumns({"_sets": F.count("_set").over(so_far), "_base": F.last("_set", ignorenulls=True).over(so_far), "_in": F.row_number().over(inside)})
    run = run.withColumn("_moved", F.sum("_change").over(since))
    last = F.max_by(F.struct("_base", "_moved"), F.struct("_in"))
    stretches = run.groupBy(key, "_part").agg(F.count("*").alias("_n"), last.alias("_last"))
    # merged: after the last stretch that replaces the count, only numbers are added
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = stretches.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"), F.count("_last._base").over(before).alias("_group"), F.last("_last._base", ignorenulls=True).over(before).alias("_from"), F.col("_last._base").alias("_own"), F.col("_last._moved").alias("_by"))
    # moves of the stretch that set the count, and of those after it
    moves = placed.withColumn("_own_group", F.col("_group") + F.col("_own").isNotNull().cast("int"))
    added = Window.partitionBy(key, "_own_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = moves.withColumn("_total", F.sum("_by").over(added))
    starts = ends.withColumn("_start", F.coalesce(F.col("_from"), F.lit(start)) + F.coalesce(F.lag("_total").over(Window.partitionBy(key).orderBy("_part")), F.lit(0)))
    here = run.withColumnRenamed(key, "_key").join(starts.select(F.col(key).alias("_k2"), F.col("_part").alias("_p2"), "_earlier", "_start"), F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_part") == F.col("_p2")))
    value = F.coalesce(F.col("_base"), F.col("_start")) + F.col("_moved")
    code = F.when(~F.col("_valid"), "INVALID_ACTION").when(value < 0, "UNDERFLOW").when(F.col("want").isNotNull() & (value != F.col("want")), "STATE_MISMATCH")
    seen = here.select("_key", (F.col("_earlier") + F.col("_in")).cast("bigint").alias("_step"), value.alias("_value"), code.alias("_code"))
    each = seen.groupBy("_key").agg(F.count("*").alias("steps"), F.min(F.when(F.col("_code").isNotNull(), F.struct("_step", "_code"))).alias("_first"), F.max_by("_value", "_step").alias("_end"))
    failed = F.col("_first").isNotNull()
    return each.select(F.col("_key").alias(key), "steps", F.coalesce("_first._code", F.lit("VALID")).alias("status"), F.col("_first._step").alias("failed_step"), F.when(~failed, F.col("_end")).alias("final_count"))
