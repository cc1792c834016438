"""Deterministic order, ranks, quotas and greedy selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import half_even, seeded_hash
from ..sources.tables import materialize


def ranked(rows: DataFrame, groups: Sequence[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """Place of each row in its group, from 1; with a filter on it Spark keeps a bounded heap a group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def globally_ranked(rows: DataFrame, *order: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Place of each row in one order over all rows, without a window over one partition.

    Rows are dealt into ranges of the order, numbered within each, and moved up by the sizes of the
    ranges before; only those sizes (one row a range) meet in one task. order: columns, of which the last
    should be unique. The dealt rows are written as a table: the bounds of ranges come from a sample, and
    two plans over the same rows may draw two.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = ranked(dealt, ["_part"], *order, name="_in")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return inside.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def ratio_split(ids: DataFrame, id_column: str, seed: int, train: float = 0.60, dev: float = 0.15) -> DataFrame:
    """train, dev and test by seeded order; the bounds are rounded half to even.

    Ids must be distinct. The number of ids is the only thing that the driver learns.
    """
    n = ids.count()
    keyed = ids.select(F.col(id_column), seeded_hash(seed, F.col(id_column)).alias("_key"))
    placed = globally_ranked(keyed, "_key", id_column)
    a, b = half_even(F.lit(n * train)).cast("bigint"), half_even(F.lit(n * dev)).cast("bigint")
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "dev").otherwise("test")
    return placed.select(id_column, "rank", split.alias("split"))


def top_by_hash(rows: DataFrame, groups: Sequence[str], id_column: str, k: int, seed: int) -> DataFrame:
    """The k rows of each group that come first in seeded order."""
    keyed = rows.withColumn("_key", seeded_hash(seed, F.col(id_column)))
    return ranked(keyed, groups, "_key", id_column).where(F.col("rank") <= k).drop("_key")


def interleave(rows: DataFrame, bucket: str, *order: str) -> DataFrame:
    """Round robin: first rows of all buckets in bucket order, then second rows, and so on."""
    return globally_ranked(ranked(rows, [bucket], *order, name="turn"), "turn", bucket, name="position")


def apportion(weights: DataFrame, key: str, weight: str, seats: int) -> DataFrame:
    """Largest remainders: integer shares of ``seats`` in proportion to weight, ties by key."""
    total = weights.agg(F.sum(weight).alias("_total"))
    each = weights.crossJoin(F.broadcast(total))  # one row
    # weight * seats is an integer, so the remainder is exact
    top = F.col(weight) * seats
    shares = each.select(key, F.floor(top / F.col("_total")).cast("bigint").alias("base"), F.pmod(top, F.col("_total")).alias("rest"))
    rank = ranked(shares, [], F.desc("rest"), key)
    spare = shares.agg((F.lit(seats) - F.sum("base")).alias("spare"))
    return rank.crossJoin(F.broadcast(spare)).select(key, (F.col("base") + F.when(F.col("rank") <= F.col("spare"), 1).otherwise(0)).alias("seats"))


def greedy_caps(candidates: DataFrame, order: Sequence[str], caps: dict[str, int], target: int) -> DataFrame:
    """Walk rows in order and take each unless a cap is reached or ``target`` rows are taken.

    caps: column -> the most taken rows that may share its value. A row that one cap rejects uses up none of the
    others. Adds ``outcome``: TAKEN, CAP_<column> of the first cap that rejects, or TARGET_REACHED. order: columns that
    tell all rows apart.

    The walk is exact but not sequential. In each round a row is taken for sure if its caps would hold even if
    all undecided rows before it were taken, and rejected for sure if those already taken before it fill a cap. In
    a hashed order that settles all but a shrinking rest in few rounds; a round is a running count per cap.
    Later rows never matter for earlier ones, so the target cuts the taken rows at the end.
    """
    columns = list(dict.fromkeys([*order, *caps]))
    now = materialize(candidates.select(*columns, F.lit(None).cast("boolean").alias("_in")), "greedy")
    before = {c: Window.partitionBy(c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for c in caps}
    counted = lambda c, what: F.coalesce(F.sum(what.cast("int")).over(before[c]), F.lit(0))
    taken, open_ = F.coalesce(F.col("_in"), F.lit(False)), F.col("_in").isNull()
    while now.where("_in is null").limit(1).count():
        sure, full = F.lit(True), F.lit(False)
        for c, cap in caps.items():
            sure = sure & (counted(c, taken | open_) < cap)
            full = full | (counted(c, taken) >= cap)
        now = materialize(now.select(*columns, F.when(open_, F.when(full, False).when(sure, True)).otherwise(F.col("_in")).alias("_in")), "greedy")
    why = F.lit(None).cast("string")
    for c, cap in reversed(caps.items()):
        why = F.when(counted(c, F.col("_kept")) >= cap, f"CAP_{c}").otherwise(why)
    kept = globally_ranked(now.where("_in"), *order, name="_rank").where(F.col("_rank") <= target).select(*order, F.col("_rank"))
    last = kept.where(F.col("_rank") == target).select(F.struct(*order).alias("_last"))
    marked = now.withColumn("_kept", taken).select(*columns, "_in", why.alias("_why")).join(last, how="left")  # one row at most
    after = F.coalesce(F.struct(*order) > F.col("_last"), F.lit(False))
    return marked.select(*columns, F.when(after, "TARGET_REACHED").when(F.col("_in"), "TAKEN").otherwise(F.col("_why")).alias("outcome"))


def ratio_capped(rows: DataFrame, order: Sequence[str], flag: str, part: int, whole: int) -> DataFrame:
    """Walk rows in order and take each unless it has the flag and flagged rows would be more than part / whole of all taken. Adds ``taken``.

    Rows without the flag are always taken, so before the n-th flagged row at most c = floor(part * plain / (whole - part)) may be in, a number that
    never falls. The walk then takes a flagged row where its slack c - n isn't below the least slack before it (and 0). That is a running
    least number, made per range of the order and moved on by the ranges before, so no task sees all rows. order: columns that tell rows apart; a null
    flag counts as none.
    """
    flagged = F.coalesce(F.col(flag), F.lit(False))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ratio")
    so_far = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier, parts_before = so_far.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count_if(flagged).alias("_a"), F.count_if(~flagged).alias("_b"))
    before = sizes.select("_part", *[F.coalesce(F.sum(c).over(parts_before), F.lit(0)).alias(n) for c, n in (("_a", "_flags"), ("_b", "_plain"))])
    n, plain = F.sum(flagged.cast("bigint")).over(so_far) + F.col("_flags"), F.sum((~flagged).cast("bigint")).over(so_far) + F.col("_plain")
    slack = F.when(flagged, F.floor(part * plain / (whole - part)).cast("bigint") - n)
    slacks = dealt.join(F.broadcast(before), "_part").withColumn("_slack", slack).drop("_flags", "_plain")
    least = slacks.groupBy("_part").agg(F.min("_slack").alias("_m"))
    low = least.select("_part", F.least(F.lit(0), F.min("_m").over(parts_before)).alias("_low"))  # least() skips nulls
    out = slacks.join(F.broadcast(low), "_part").withColumn("_low", F.least("_low", F.min("_slack").over(earlier)))
    return out.withColumn("taken", ~flagged | (F.col("_slack") >= F.col("_low"))).drop("_part", "_slack", "_low")


def balanced_slice(rows: DataFrame, flag: str, key: str, target: int, share: float = 0.4) -> DataFrame:
    """``share`` of the target from rows with the flag and the rest from those without; what one side lacks the
    other fills up. Rows are taken by key."""
    counts = rows.agg(F.count_if(flag).alias("a"), F.count_if(~F.col(flag)).alias("b")).first()
    want = round(target * share)
    a = min(counts["a"], max(want, target - counts["b"]))
    b = min(counts["b"], target - min(counts["a"], want) if counts["a"] < want else target - a)
    place = ranked(rows, [flag], key)
    return place.where(F.col("rank") <= F.when(F.col(flag), a).otherwise(b)).drop("rank")
