"""Evaluation metrics as grouped aggregates: everything is counts first and one division after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("SUPPORTED", "CONTRADICTORY", "UNKNOWN")


def ratio(top: Column, bottom: Column, undefined: str = "null") -> Column:
    """top / bottom as double; where bottom is 0, null or (``undefined='zero'``) 0."""
    out = F.when(bottom != 0, top.cast("double") / bottom.cast("double"))
    return F.coalesce(out, F.lit(0.0)) if undefined == "zero" else out


def label_counts(scored: DataFrame, keys: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """One row per key and label: support, tp, fp, fn. A null prediction is wrong for its gold label.

    The counts are one partial aggregate per key, so only keys x labels rows are shuffled.
    """
    gold, pred = F.col("gold"), F.col("pred")
    sums = []
    for k, label in enumerate(labels):
        g, p = gold == label, F.coalesce(pred == label, F.lit(False))
        sums += [F.count_if(g).alias(f"s{k}"), F.count_if(g & p).alias(f"t{k}"), F.count_if(~g & p).alias(f"f{k}")]
    wide = scored.groupBy(*keys).agg(*sums)
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"s{k}").alias("support"), F.col(f"t{k}").alias("tp"), F.col(f"f{k}").alias("fp")) for k, label in enumerate(labels)])
    return wide.select(*keys, F.inline(each)).withColumn("fn", F.col("support") - F.col("tp"))


def three_class(scored: DataFrame, keys: Sequence[str] = (), undefined: str = "zero") -> DataFrame:
    """Precision, recall and F1 of each label. F1 is null (or 0) for a label without gold support."""
    c = label_counts(scored, keys)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = ratio(2 * tp, 2 * tp + fp + fn, "zero")
    if undefined == "null":
        f1 = F.when(F.col("support") > 0, f1)
    return c.select(*keys, "label", "support", "tp", "fp", "fn", ratio(tp, tp + fp, undefined).alias("precision"), ratio(tp, F.col("support"), undefined).alias("recall"), f1.alias("f1"))


def summary(scored: DataFrame, keys: Sequence[str] = (), over: str = "supported") -> DataFrame:
    """n, correct, accuracy and macro F1, over labels with gold support or (``over='all'``) all."""
    each = three_class(scored, keys)
    used = F.col("support") > 0 if over == "supported" else F.lit(True)
    f1 = [F.max(F.when((F.col("label") == x) & used, F.col("f1"))) for x in LABELS]
    out = each.groupBy(*keys).agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"), *[c.alias(f"_{k}") for k, c in enumerate(f1)], F.count_if(used).alias("_k"))
    total = sum((F.coalesce(F.col(f"_{k}"), F.lit(0.0)) for k in range(len(LABELS))), F.lit(0.0))
    return out.select(*keys, "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy"), ratio(total, F.col("_k")).alias("macro_f1"))


def with_overall(scored: DataFrame, key: str, name: str = "OVERALL") -> DataFrame:
    """Each row once under its key and once under ``name``, for reports with a total."""
    return scored.withColumn(key, F.explode(F.array(F.coalesce(F.col(key).cast("string"), F.lit("NOT_ANNOTATED")), F.lit(name))))


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("gold", F.coalesce("pred", F.lit("MISSING")).alias("pred")).agg(F.count("*").alias("n"))


def group_accuracy(scored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """accuracy of each value of each field; null values are left out."""
    dims = F.array(*[F.struct(F.lit(f).alias("dimension"), F.col(f).cast("string").alias("group")) for f in fields])
    rows = scored.select("gold", "pred", F.inline(dims)).where(F.col("group").isNotNull())
    return rows.groupBy("dimension", "group").agg(F.count("*").alias("n"), F.count_if(F.col("gold").eqNullSafe(F.col("pred"))).alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def worst_group(scored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The group with the least (accuracy, dimension, group)."""
    least = group_accuracy(scored, fields).agg(F.min(F.struct("accuracy", "dimension", "group", "n")).alias("w"))
    return least.select("w.dimension", "w.group", "w.n", "w.accuracy")


def pair_accuracy(members: DataFrame) -> DataFrame:
    """members: pair_id, gold, pred. Complete pairs (one SUPPORTED and one CONTRADICTORY) and those
    with both right; other pairs don't count."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    pairs = members.groupBy("pair_id").agg(F.count("*").alias("k"), F.count_if(F.col("gold") == "SUPPORTED").alias("s"), F.count_if(F.col("gold") == "CONTRADICTORY").alias("c"), F.bool_and(right).alias("both"))
    whole = (F.col("k") == 2) & (F.col("s") == 1) & (F.col("c") == 1)
    out = pairs.agg(F.count_if(whole).alias("pairs"), F.count_if(whole & F.col("both")).alias("right"))
    return out.withColumn("pair_accuracy", ratio(F.col("right"), F.col("pairs")))


def strict_pairs(members: DataFrame, labels: int = 2) -> DataFrame:
    """members: pair_id, gold, pred. Whether all predictions of each pair are right; a pair without all of the labels raises. A null prediction is wrong."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    pairs = members.groupBy("pair_id").agg(F.count_distinct("gold").alias("_k"), F.bool_and(right).alias("_ok"))
    fail = F.raise_error(F.concat(F.lit("INCOMPLETE_GOLD_PAIR:"), F.coalesce(F.col("pair_id").cast("string"), F.lit("null"))))
    return pairs.select("pair_id", F.when(F.col("_k") == labels, F.col("_ok")).otherwise(fail).alias("correct"))


def set_scores(gold: Column, predicted: Column) -> Column:
    """struct(precision, recall, f1, exact) of two arrays as sets; both empty score 1, one empty 0."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    both, ng, np_ = F.size(F.array_intersect(g, p)), F.size(g), F.size(p)
    none, one = (ng == 0) & (np_ == 0), (ng == 0) | (np_ == 0)
    score = lambda top, bottom: F.when(none, 1.0).when(one, 0.0).otherwise(top.cast("double") / bottom)
    return F.struct(score(both, np_).alias("precision"), score(both, ng).alias("recall"), score(2 * both, ng + np_).alias("f1"), ((both == ng) & (ng == np_)).alias("exact"))


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """rows: confidence (0 to 1), correct (0 or 1). Bins [i/bins, (i+1)/bins), the last closed.

    The edges are compared as written; confidence times bins may round to the next bin.
    """
    edge = F.lit(bins - 1)
    for k in reversed(range(bins - 1)):
        edge = F.when(F.col("confidence") < F.lit((k + 1) / bins), k).otherwise(edge)
    return rows.where("confidence is not null").groupBy(edge.cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.sum("correct").cast("bigint").alias("correct"), F.avg("confidence").alias("confidence"))
