"""Statistics over groups and clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def entropy(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Shannon entropy in bits of a value's distribution in each group."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("_n"))
    # from sums of n and n log n, so the counts are grouped once: H = log2 N - sum(n log2 n) / N
    total, logs = F.sum("_n").cast("double"), F.sum(F.col("_n") * F.log2("_n"))
    return n.groupBy(group).agg((F.log2(total) - logs / total).alias("bits"), F.count("*").alias("kinds"))


def salience(rows: DataFrame, group: str, text: str, groups: int) -> DataFrame:
    """sqrt(count) times the square of 0.25 plus idf of each token in each group."""
    tokens = rows.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    c = tokens.groupBy(group, "token").agg(F.count("*").alias("n"))
    df = c.groupBy("token").agg(F.count("*").alias("_df"))
    idf = 0.25 + F.log((groups + 1) / (F.col("_df") + 0.5))
    return c.join(df, "token").select(group, "token", "n", (F.sqrt("n") * idf * idf).alias("salience"))


def poisson_bounds(most: int = 11) -> list[float]:
    """Chances of a Poisson(1) variable to be below 1, 2, ...: a uniform number is turned into a count by the bounds that it reaches."""
    out, term, below = [], math.exp(-1), 0.0
    for k in range(1, most + 1):
        below += term
        out.append(below)
        term /= k
    return out


def resampled(parts: DataFrame, cluster: str, repetitions: int) -> DataFrame:
    """Each row once per repetition that draws its cluster, with ``_rep`` and its count ``_w``, from an MD5 of repetition and cluster.

    Any engine can draw the same numbers, so that results can be compared; ``cluster_bootstrap`` takes a faster hash. A cluster is drawn
    once for all of its rows, which meet in one row for that, so rows should be sums. Digests are held against the bounds as hex digits.
    """
    bounds = [f"{math.ceil(b * 2**32):08x}" for b in poisson_bounds()]
    nested = parts.groupBy(cluster).agg(F.collect_list(F.struct(*[c for c in parts.columns if c != cluster])).alias("_parts"))
    # the generator yields a row per drawn repetition, so that the hash isn't worked out again for the filter
    drawn = F.transform(F.sequence(F.lit(1), F.lit(repetitions)), lambda r: F.struct(r.alias("_rep"), F.md5(F.concat_ws("|", r.cast("string"), F.col(cluster).cast("string"))).alias("_u")))
    each = nested.withColumn("_d", F.explode(F.filter(drawn, lambda d: d["_u"] >= bounds[0])))
    weight = sum((F.col("_d._u") >= b).cast("int") for b in bounds)
    return each.select(cluster, "_parts", F.col("_d._rep").alias("_rep"), weight.alias("_w")).select(cluster, "_rep", "_w", F.inline("_parts"))


def stratified_bootstrap(rows: DataFrame, groups: Sequence[str], stratum: str, cluster: str, value: str, repetitions: int = 2000) -> DataFrame:
    """Mean of a value with a 95 % percentile interval over clusters that are resampled within their stratum, per group.

    Each repetition scales a stratum's weighted sums to its number of clusters, so strata keep their share; a stratum of which a
    repetition draws nothing is left out of it. Rows with a null value don't count; a group without any isn't returned.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*groups, stratum, cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    sizes = sums.groupBy(*groups, stratum).agg(F.count("*").alias("_m"), F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    point = sizes.groupBy(*groups).agg((F.sum("_s") / F.sum("_n")).alias("effect"), F.sum("_m").alias("clusters"), F.count("*").alias("strata"))
    drawn = resampled(sums, cluster, repetitions).groupBy(*groups, stratum, "_rep").agg(F.sum(F.col("_w") * F.col("_s")).alias("_a"), F.sum(F.col("_w") * F.col("_n")).alias("_b"), F.sum("_w").alias("_k"))
    scaled = drawn.join(sizes.select(*groups, stratum, "_m"), [*groups, stratum]).withColumn("_f", F.col("_m") / F.col("_k"))
    draws = scaled.groupBy(*groups, "_rep").agg((F.sum(F.col("_f") * F.col("_a")) / F.sum(F.col("_f") * F.col("_b"))).alias("_e"))
    interval = draws.groupBy(*groups).agg(F.percentile("_e", 0.025).alias("low"), F.percentile("_e", 0.975).alias("high"))
    return point.join(interval, list(groups))


def conditional_macro(rows: DataFrame, groups: Sequence[str], cluster: str, value: str, eligible: Column, repetitions: int = 2000) -> DataFrame:
    """Mean over clusters of a value's mean over eligible rows, with an interval from resampling the whole cohort of clusters.

    A cluster without eligible rows is drawn but has no ratio. ``empty`` is the share of repetitions that draw clusters without ratios only; they
    have no value and don't count as 0. The estimate and interval are null where no cluster has a ratio.
    """
    use = F.coalesce(eligible, F.lit(False))
    parts = rows.where(F.col(value).isNotNull()).groupBy(*groups, cluster).agg(F.coalesce(F.sum(F.when(use, F.col(value))), F.lit(0)).alias("_s"), F.count_if(use).alias("_n"))
    ratio = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    point = parts.groupBy(*groups).agg(F.sum("_s").alias("numerator"), F.sum("_n").alias("denominator"), F.count_if(F.col("_n") > 0).alias("clusters"), F.count("*").alias("cohort"), F.avg(ratio).alias("estimate"))
    # a cluster without a ratio adds to neither sum, and a repetition without a value is empty whether or not it has a row
    draws = resampled(parts.where("_n > 0"), cluster, repetitions).groupBy(*groups, "_rep").agg((F.sum(F.col("_w") * ratio) / F.sum("_w")).alias("_e"))
    interval = draws.groupBy(*groups).agg(F.percentile("_e", 0.025).alias("low"), F.percentile("_e", 0.975).alias("high"), (1 - F.count("_e") / repetitions).alias("empty"))
    return point.join(interval, list(groups), "left").withColumn("empty", F.coalesce("empty", F.lit(1.0)))


def intervention_strata(rows: DataFrame, fields: Sequence[str], base: str, inter: str, cluster: str) -> DataFrame:
    """Over all rows and per value of each field: what an intervention rescues and harms, its net effect, and both given the base's outcome.

    base and inter: 0 or 1. Null values of a field are a group of their own. Each row is counted once per field, with partial sums before the shuffle.
    """
    keys = [F.struct(F.lit("ALL").alias("field"), F.lit("ALL").alias("group"))] + [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("group")) for f in fields]
    each = rows.select(cluster, base, inter, F.inline(F.array(*keys)))
    b, i = F.col(base) == 1, F.col(inter) == 1
    sums = each.groupBy("field", "group").agg(F.count("*").alias("n"), F.count_distinct(cluster).alias("clusters"), F.count_if(~b & i).alias("rescue"), F.count_if(b & ~i).alias("harm"), F.count_if(~b).alias("base_errors"), F.count_if(b).alias("base_successes"))
    share = lambda top, below: F.when(F.col(below) > 0, F.col(top) / F.col(below))
    return sums.withColumns({"net": (F.col("rescue") - F.col("harm")) / F.col("n"), "rescue_given_error": share("rescue", "base_errors"), "harm_given_success": share("harm", "base_successes")})


def cluster_bootstrap(rows: DataFrame, groups: Sequence[str], cluster: str, value: str, repetitions: int = 5000) -> DataFrame:
    """Mean of a value with a 95 % percentile interval over resampled clusters, per group.

    Rows with a null value don't count. Clusters are summed first. Each repetition then gives a cluster a
    Poisson(1) weight from a hash of repetition and cluster, so the resamples are plain grouped sums
    at any number of clusters, and reruns agree.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*groups, cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    point = sums.groupBy(*groups).agg((F.sum("_s") / F.sum("_n")).alias("effect"), F.count("*").alias("clusters"), F.sum("_n").alias("rows"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("boot"), F.col("_rep"), F.col(cluster)), 11).cast("double") / float(1 << 53)
    weight = F.lit(0)
    for bound in poisson_bounds():
        weight = weight + (u >= bound).cast("int")
    reps = sums.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("_w", weight).where("_w > 0")
    draws = reps.groupBy(*groups, "_rep").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_n"))).alias("_e"))
    interval = draws.groupBy(*groups).agg(F.percentile("_e", 0.025).alias("low"), F.percentile("_e", 0.975).alias("high"))
    return point.join(interval, list(groups))


def percentiles(rows: DataFrame, groups: Sequence[str], value: str, **at: float) -> DataFrame:
    """Exact interpolated percentiles of a value per group, in columns named by ``at``; Spark's own sends all values of a group to one task.

    Values are counted, and their counts dealt into ranges of the order, as ``select.globally_ranked`` does with rows: each range adds up its own, and
    only sizes of ranges meet. Null values don't count; a group without any isn't returned.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    dealt = materialize(counts.repartitionByRange(parts, *groups, "_v").withColumn("_part", F.spark_partition_id()), "percentiles")
    sizes = dealt.groupBy(*groups, "_part").agg(F.sum("_n").alias("_size"))
    of_group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_size").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.struct(*groups, F.col("_part")).alias("_k"), before.alias("_before"), F.sum("_size").over(of_group).alias("_all"))
    inside = dealt.withColumn("_in", F.sum("_n").over(Window.partitionBy(*groups, "_part").orderBy("_v"))).withColumn("_k", F.struct(*groups, F.col("_part")))
    placed = inside.join(F.broadcast(offsets), inside["_k"].eqNullSafe(offsets["_k"])).withColumn("_end", F.col("_in") + F.col("_before"))
    place = lambda q: (F.col("_all") - 1) * F.lit(q)
    holds = lambda k: F.max(F.when((F.col("_end") > k) & (F.col("_end") - F.col("_n") <= k), F.col("_v")).cast("double"))
    ends = [c for n, q in at.items() for c in (holds(F.floor(place(q))).alias(f"_low_{n}"), holds(F.ceil(place(q))).alias(f"_high_{n}"), F.max(place(q) - F.floor(place(q))).alias(f"_part_{n}"))]
    out = placed.groupBy(*groups).agg(*ends)
    return out.select(*groups, *[(F.col(f"_low_{n}") * (1 - F.col(f"_part_{n}")) + F.col(f"_high_{n}") * F.col(f"_part_{n}")).alias(n) for n in at])
