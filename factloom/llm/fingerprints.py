"""Document fingerprints by consistent weighted sampling, all in SQL functions.

A text is a weighted set: its five-word shingles, each weighing as often as it occurs. For each
of SAMPLES independent draws every term gets a value from two gamma variates and a uniform one that
depend on term and draw alone; the term with the least value, and the level of its weight, is the
sample. Two texts have the same sample with probability equal to their generalised Jaccard
similarity: the sum over terms of the smaller weight over that of the larger.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

SAMPLES = 48
WIDTH = 5
ID_BITS = 20
PRUNE = 16.0
#: Documents per bucket of neighbours, and the most buckets (the number of ids that the driver sees).
PER_BUCKET, MOST_BUCKETS = 256, 16_384


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of a text's shingles, with repeats; a text of fewer words is one, also without any."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return _shingles(words, width)


def _shingles(words: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def sample(term: str, weight: str, total: str, draw: int) -> str:
    """SQL for one term's value for a draw, packed over the sample's identity so that ``min`` keeps both.

    With r and c from Gamma(2, 1) and b uniform, all from one hash of term and draw:
    t = floor(ln(weight) / r + b), ln(value) = ln(c) - r (t - b + 1). The upper bits hold the value
    in order, the ID_BITS lower ones a hash of term and t.

    The least of a text's values is exponential with the text's total weight as rate, so it is above
    PRUNE / total once in 9 million draws (whose sample is then null, the same for equal texts).
    Values above that are left out before any logarithm is taken, by lower bounds:
    c = -ln(x) >= 1 - x, and for a weight of 1, exp(-r (1 - b)) >= v / (v + (1 - b)(1 - v)) with v = exp(-r).
    """
    uniform = lambda shift, bits: f"((shiftrightunsigned(xxhash64({term}, {draw}), {shift}) & {(1 << bits) - 1}) + 0.5D) * {1 / (1 << bits)!r}D"
    v, b, x = f"({uniform(53, 11)} * {uniform(42, 11)})", f"({uniform(32, 10)})", f"({uniform(16, 16)} * {uniform(0, 16)})"
    r, c, low = f"(-ln({v}))", f"(-ln({x}))", f"({term} & {(1 << ID_BITS) - 1})"
    t = f"floor(ln(cast({weight} as double)) / {r} + {b})"
    # values lie within -4096 and 4: r is at most 17, and t r at most ln(weight) + r
    order = lambda value: f"shiftleft(cast(({value} + 4096.0D) * {float(1 << 30)!r}D as bigint), {ID_BITS})"
    once = f"{order(f'ln({c}) - {r} * (1.0D - {b})')} | {low}"
    more = f"{order(f'ln({c}) - {r} * ({t} - {b} + 1.0D)')} | ({low} ^ (({t} * 40503) & {(1 << ID_BITS) - 1}))"
    spread = f"if({weight} = 1, {v} + (1.0D - {b}) * (1.0D - {v}), cast({weight} as double))"
    return f"if((1.0D - {x}) * {v} * {total} <= {PRUNE}D * {spread}, if({weight} = 1, {once}, {more}), null)"


def weighted_samples(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """One row per distinct value of ``keys`` with ``signature``, an array of sample identities.

    keys must tell texts apart; other columns are dropped. Each text's terms are made, sorted, counted and
    sampled in the task that has the text: only the least value of each draw is kept, so what a text needs is
    the same however long it is, and if the rows already lie together by some of the keys
    nothing is shuffled.
    """
    worded = texts.select(*keys, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)).alias("_words"))
    hashed = worded.select(*keys, F.sort_array(_shingles(F.col("_words"), width)).alias("_h"))
    begins = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", F.greatest(i - 1, F.lit(0)))))
    # _outer: else the optimizer asks first whether the array is empty, and makes the arrays anew for that
    runs = hashed.select("*", begins.alias("_b")).select(*keys, "_h", "_b", F.posexplode_outer("_b").alias("_j", "_a"))
    weight = F.coalesce(F.get("_b", F.col("_j") + 1), F.size("_h")) - F.col("_a")
    terms = runs.select(*keys, F.get("_h", F.col("_a")).alias("_term"), weight.alias("_weight"), F.size("_h").cast("double").alias("_total"))
    least = terms.groupBy(*keys).agg(*[F.expr(f"min({sample('_term', '_weight', '_total', k)}) as _{k}") for k in range(samples)])
    name = lambda k: F.coalesce(F.col(f"_{k}").bitwiseAND((1 << ID_BITS) - 1).cast("int"), F.lit(0))
    return least.select(*keys, F.array(*[name(k) for k in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The share of draws with the same sample: an estimate of generalised Jaccard similarity."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x).cast("double") / F.size(a)


def as_text(signature: Column) -> Column:
    """A signature as hex digits, five for each sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), ID_BITS // 4, "0"))), "")


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id, signature and fingerprint of each distinct id and text (null counts as empty text).

    Equal texts have equal fingerprints; rows that agree in id and text are one; no rows give none.
    """
    rows = docs.select(F.col(id_column), text_or_empty(text).alias("_text")).withColumn("_sha", F.sha2("_text", 256))
    return weighted_samples(rows, [id_column, "_sha"], "_text", samples).drop("_sha").withColumn("fingerprint", as_text(F.col("signature")))


def _buckets(docs: DataFrame) -> tuple[list[int], int]:
    """Ids that split the table into buckets of about PER_BUCKET rows, and the number of rows."""
    n = docs.count()
    count = min(MOST_BUCKETS, max(1, math.ceil(n / PER_BUCKET)))
    if count == 1:
        return [], n
    at = [k / count for k in range(1, count)]
    found = docs.agg(F.percentile_approx("doc_id", at, 10 * count).alias("q")).first()["q"] or []
    return sorted(set(found)), n


def _bucket_of(id_column: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the id (0 for null), by two steps of about sqrt(bounds)."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    whole, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[::step]))
    first = F.size(F.filter(coarse, lambda x: x <= id_column))
    within = F.size(F.filter(F.slice(whole, (first - 1) * step + 1, step), lambda x: x <= id_column))
    return F.when(id_column.isNull() | (first == 0), 0).otherwise((first - 1) * step + within)


def with_next(docs: DataFrame) -> DataFrame:
    """Documents with their bucket, place in it (``at``) and the next document's text (``next_text``).

    docs: doc_id (long), text (no nulls). The order is by doc_id (null first), then
    text; the first follows the last. Each bucket gets a copy of the next one's first row at its
    end (``extra`` is true), so that every row finds the next in its own bucket. Only the
    bounds and first ids of at most MOST_BUCKETS buckets pass through the driver.
    """
    bounds, _ = _buckets(docs)
    placed = docs.withColumn("bucket", _bucket_of(F.col("doc_id"), bounds))
    firsts = sorted((r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("id")))["id"].alias("first")).collect())
    if not firsts:
        return placed.select("doc_id", "text", "bucket", F.lit(0).alias("at"), F.lit(False).alias("extra"), F.lit("").alias("next_text"))
    to = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    table = F.array(*[F.struct(F.lit(first).cast("bigint").alias("first"), F.lit(bucket).alias("bucket")) for first, bucket in to])
    follow = docs.sparkSession.range(1).select(F.inline(table))
    extra = docs.join(F.broadcast(follow), docs["doc_id"].eqNullSafe(follow["first"])).groupBy("doc_id", "bucket").agg(F.min("text").alias("text"))
    rows = placed.select("doc_id", "text", "bucket", F.lit(False).alias("extra")).union(extra.select("doc_id", "text", "bucket", F.lit(True)))
    order = W.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return rows.select("doc_id", "text", "bucket", "extra", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next_text"))


def edited_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness.

    docs: doc_id (integer), text (null counts as empty); other columns are ignored. The edited text is the
    document with the last half of its code points replaced by the first as many (or all) of the next document by
    ascending doc_id; the first follows the last. Returns a row for each row: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).select("bucket", "at", "extra", "doc_id", n.cast("bigint").alias("n_chars"), "text", F.when(~F.col("extra"), edited).alias("edited"))
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("of")),
        F.struct(F.lit(1).alias("kind"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("of")),
    )
    keys = ["bucket", "at", "extra", "doc_id", "n_chars"]
    texts = rows.select(*keys, F.explode(both).alias("t")).select(*keys, "t.kind", "t.sha", "t.of").where("of is not null")
    signed = weighted_samples(texts, [*keys, "kind", "sha"], "of", samples)
    order = W.partitionBy("bucket").orderBy("at", "kind")
    ahead = signed.select("*", F.lead("sha", 1).over(order).alias("edited_sha256"), F.lead("signature", 1).over(order).alias("_edited"), F.lead("signature", 2).over(order).alias("_next"))
    return ahead.where("kind = 0 and not extra").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("_edited")).alias("near_edited"), likeness(F.col("signature"), F.col("_next")).alias("near_next"),
    )
