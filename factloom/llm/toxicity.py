"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, text_or_empty
from .features import featurize, few, toxic_features, training_labels

#: The most labelled rows that the model learns from, and the most words in its lexicon.
SAMPLE, LEXICON = 20_000, 5_000
LEAST_DOCS, LEAST_WEIGHT = 3, 1.0
#: How much of the score the trees' own probability is, within a step of the calibration.
TIE = 1e-6


def learn_lexicon(docs: DataFrame, labels: DataFrame, size: int = LEXICON) -> dict[str, tuple[float, ...]]:
    """Words that mark toxic documents: word -> its weight by fold of the reader.

    labels: (doc_id, label) training rows. A word's weight is the smoothed log ratio of its document
    rates among toxic and other rows. Weight 0 of the tuple counts all rows and is what scores use; weight f leaves out
    those of fold f, and is what a row of fold f is learned from, so no row's own label
    shapes the features that it is learned from. Words are counted in Spark; only the ``size`` words that mark most come here.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(labels, "doc_id")
    counts = labels.groupBy(fold.alias("fold")).agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("n")).collect()
    toxic, other = [0.0] * 5, [0.0] * 5
    for r in counts:
        toxic[r["fold"]], other[r["fold"]] = r["t"], r["n"]
    exploded = rows.select(fold.alias("fold"), "label", F.explode(words).alias("word"))
    per = [F.sum(F.when(F.col("fold") == f, F.col("label")).otherwise(0.0)).alias(f"t{f}") for f in range(1, 5)] + [F.sum(F.when(F.col("fold") == f, 1 - F.col("label")).otherwise(0.0)).alias(f"n{f}") for f in range(1, 5)]
    t, n = sum((F.col(f"t{f}") for f in range(1, 5)), F.lit(0.0)), sum((F.col(f"n{f}") for f in range(1, 5)), F.lit(0.0))
    weight = F.log((t + 0.5) / (sum(toxic) + 1)) - F.log((n + 0.5) / (sum(other) + 1))
    top = exploded.groupBy("word").agg(*per).where((t >= LEAST_DOCS) & (weight >= LEAST_WEIGHT)).orderBy((t * weight).desc(), "word").limit(size).collect()

    def weighed(r, f: int) -> float:
        own_t, own_n = (r[f"t{f}"], r[f"n{f}"]) if f else (0.0, 0.0)
        a, b = sum(r[f"t{k}"] for k in range(1, 5)) - own_t, sum(r[f"n{k}"] for k in range(1, 5)) - own_n
        all_a, all_b = sum(toxic) - (toxic[f] if f else 0), sum(other) - (other[f] if f else 0)
        w = math.log((a + 0.5) / (all_a + 1)) - math.log((b + 0.5) / (all_b + 1))
        return w if a >= LEAST_DOCS - (f > 0) and w >= LEAST_WEIGHT else 0.0

    return {r["word"]: tuple(weighed(r, f) for f in range(5)) for r in top}


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each row of docs.

    docs: doc_id (integer), text (null counts as empty); only the text is an input of the score, so equal
    texts get equal scores. labels: doc_id, toxic. The trees
    learn from at most about ``bound`` labelled rows, with crc32(doc_id as text) mod 5
    of 1 to 3; the calibration from those with 4; rows with 0 only get scores. A labelled row's features
    for learning come from a lexicon without its own fold, those for scores from the whole one. The score is the
    isotonic step of the trees' probability, which moves it by a millionth so that order within a step stays. Without rows
    of both labels every score is the share of toxic ones, 0 if there are none.
    """
    known = materialize(training_labels(labels, "toxic", bound), "toxic-labels")
    lexicon = learn_lexicon(docs, few(known, bound))
    by_fold = [{w: x[f] for w, x in lexicon.items() if x[f] > 0} for f in range(5)]

    table = materialize(featurize(docs, lambda text, _: toxic_features(text, by_fold[0])), "toxic-features")
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(few(known, bound), "doc_id")
    learning = featurize(labelled.repartition(max(1, bound // 1_000), F.xxhash64("doc_id", "text")), lambda text, fold: toxic_features(text, by_fold[fold]))
    rows = learning.join(few(known, bound), "doc_id").select("label", array_to_vector("features").alias("features"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4).alias("later"))
    rows = materialize(rows.repartition(max(1, bound // 5000)), "toxic-rows")  # a few parts: each tree takes several small jobs
    kinds = {(r["later"], r["label"]): r["count"] for r in rows.groupBy("later", "label").count().collect()}
    ready = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), array_to_vector("features").alias("features"))
    if not all(kinds.get((False, x)) for x in (0.0, 1.0)):
        ones = sum(v for (_, x), v in kinds.items() if x == 1.0)
        scored = ready.withColumn("score", F.lit(ones / max(1, sum(kinds.values()))))
    else:
        trees = GBTClassifier(maxIter=30, maxDepth=4, stepSize=0.2, minInstancesPerNode=2, subsamplingRate=1.0, seed=7).fit(rows.where("not later"))
        chance = vector_to_array("probability")[1]
        later = trees.transform(rows.where("later")).select("label", chance.alias("p"))
        scored = trees.transform(ready).withColumn("p", chance)
        if all(kinds.get((True, x), 0) >= 3 for x in (0.0, 1.0)):
            steps = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="step").fit(later)
            scored = steps.transform(scored).withColumn("score", (1 - TIE) * F.col("step") + TIE * F.col("p"))
        else:
            scored = scored.withColumn("score", F.col("p"))
    score = F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
