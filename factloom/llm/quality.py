"""A quality score learned from positive and unlabelled texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize
from .features import QUALITY_NAMES, featurize, few, quality_features, to_matrix, training_labels

#: The most trusted positives, and the most unlabelled rows, that the model learns from.
SAMPLE = 20_000


def _expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, with their squares and a constant."""
    z = np.clip((x - centre) / scale, -6, 6)
    return np.hstack([z, z * z / 6, np.ones((len(z), 1))])


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _descend(gradient, dims: int, steps: int = 1500, rate: float = 0.05) -> np.ndarray:
    """Adam on a full gradient."""
    w, m, v = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """The share of positives among the unlabelled, from scores that tell the two apart.

    Above any threshold lie at least that share of the unlabelled times the rate of positives, so
    the smallest ratio of the two rates, over thresholds that ``least`` of the positives pass, bounds it closely
    where some region holds positives only. Each rate is moved by a standard error towards
    a larger ratio.
    """
    cuts = np.unique(np.quantile(positive, np.linspace(0, 1 - least, 200)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    u_up = u + np.sqrt(u * (1 - u) / max(1, len(unlabelled)))
    p_down = p - np.sqrt(p * (1 - p) / max(1, len(positive)))
    return float(np.clip(np.min(u_up / np.maximum(p_down, 1e-9)), 0.05, 0.99))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, prior) of a logistic model that minimises the non-negative unbiased risk.

    risk = prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)); where the second part is negative, the step
    goes up its gradient instead.
    """
    p, u = positive, unlabelled
    told = _descend(lambda w: -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + 2 * ridge * w, p.shape[1], 600)
    prior = class_prior(p @ told, u @ told)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        up = -prior * p.T @ (1 - sp) / len(p)
        down = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        return (up + down if negative >= 0 else -down) + 2 * ridge * w

    return _descend(gradient, p.shape[1]), prior


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each row of docs.

    docs: doc_id (integer), text (null counts as empty); nothing else is looked at. labels: doc_id, quality. Trusted
    positives are at most about ``bound`` rows with label 1 whose crc32(doc_id as text) mod 5 isn't
    0; the unlabelled are as many rows of docs, whatever their labels, outside that fold. Labels of 0 aren't used. A text without words gets the score of a
    text that has none of the features. Without positives every score is 0.5.
    """
    table = materialize(featurize(docs, lambda text, _: quality_features(text)), "quality-features")
    trusted = training_labels(labels.where("quality = 1"), "quality", bound)
    dims = len(QUALITY_NAMES)
    positive = to_matrix(table.join(few(trusted, bound), "doc_id").select("features").limit(2 * bound).collect(), dims)
    seen = table.select("doc_id", F.lit(1).alias("seen"))
    chosen = training_labels(seen, "seen", bound).select("doc_id")
    unlabelled = to_matrix(table.join(few(chosen, bound), "doc_id").select("features").limit(2 * bound).collect(), dims)
    if not len(positive):
        score = F.lit(0.5)
        return table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    centre = positive.mean(axis=0)
    scale = np.maximum(positive.std(axis=0), 0.02)
    weights, _ = fit_nnpu(_expand(positive, centre, scale), _expand(unlabelled, centre, scale))

    z = [F.greatest(F.least((F.col("features")[k] - float(centre[k])) / float(scale[k]), F.lit(6.0)), F.lit(-6.0)) for k in range(dims)]
    linear = sum((float(weights[k]) * z[k] + float(weights[dims + k]) * z[k] * z[k] / 6 for k in range(dims)), F.lit(float(weights[-1])))
    score = 1 / (1 + F.exp(-F.greatest(F.least(linear, F.lit(30.0)), F.lit(-30.0))))
    return table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
