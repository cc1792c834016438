"""Dense text features for the trained scores, and the labelled rows that they learn from."""

from __future__ import annotations

import itertools
import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_or_empty

WORD = re.compile(r"[^\W_]+")
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = b"0123456789"
SYMBOL = b"#$%&*+<=>@^_|~{}[]/\\"
STOP = b".,;:"


def share(data: bytes, which: bytes) -> float:
    """The share of bytes that are among ``which``."""
    return (len(data) - len(data.translate(None, which))) / max(1, len(data))


QUALITY_NAMES = ["log_words", "upper", "digit", "symbol", "pipe", "shout", "stop", "mean_word", "distinct", "commonest", "twice_running", "line_repeats", "words_per_line", "spaces", "long_words", "symbol_words"]


def quality_features(text: str) -> list[float]:
    """Shares of kinds of characters, words and lines; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(QUALITY_NAMES)
    data = text.encode("utf-8", "replace")
    letters = share(data, UPPER + LOWER)
    upper = share(data, UPPER) / max(letters, 1e-9)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    running = sum(map(operator.eq, words, words[1:]))
    symbols = SYMBOL.decode()
    return [
        math.log1p(n), upper, share(data, DIGIT), share(data, SYMBOL), share(data, b"|"), share(data, b"!?"), share(data, STOP), len(text) / n / 10, len(counts) / n,
        counts.most_common(1)[0][1] / n, running / n, 1 - len(set(lines)) / max(1, len(lines)), min(math.log1p(n / max(1, len(lines))) / 5, 2.0), share(data, b" "),
        sum(len(w) > 25 for w in counts) / len(counts), sum(c for w, c in counts.items() if w[-1] in symbols or w[0] in symbols) / n,
    ]


#: Words of abuse in the languages of the corpus.
INSULTS = """
idiot idiots idiotic stupid moron morons moronic dumb dumbass fool loser losers trash garbage scum scumbag pathetic worthless
disgusting clown clowns jerk bastard bitch whore slut pig pigs vermin filth filthy retard retarded imbecile cretin degenerate
freak ugly useless coward liar parasite hate kill die shut asshole shit fuck fucking crap dickhead subhuman
idiota idiotas estúpido estúpida imbécil basura asqueroso asquerosa inútil payaso mierda puta cabrón gilipollas
dumm dummkopf trottel abschaum wertlos ekelhaft versager arschloch scheiße schlampe schwein hurensohn müll
idiote idiotes stupide débile ordure déchet dégoûtant minable connard connasse salaud salope merde crétin pourriture
""".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oleastasil")
#: A letter and a sign within 64 characters: the bound keeps the time proportional to the text.
DISGUISED = re.compile(r"(?<![\w@$*|])(?=[\w@$!*|.-]{0,63}[A-Za-z])(?=[\w@$!*|.-]{0,63}[0-9@$!*|])[A-Za-z0-9@$][A-Za-z0-9@$!*|]{2,}(?![\w@$*|])")
SPACED = re.compile(r"(?<!\w)(?:\w[ .*_-]){3,}\w(?!\w)")
SPACED_PART = re.compile(r"(?:^|[\W_])\w[.*_-]\w(?:[\W_]|$)")
SIGNS = frozenset("0123456789@$!*|")

TOXIC_NAMES = [
    "log_words", "insult_density", "insults", "learned_density", "learned_hits", "learned_peak", "learned_top3", "learned_distinct", "near_you", "near_you_density",
    "upper", "exclaim", "question", "symbol", "disguised", "disguised_insults", "spaced", "drawn_out", "digit", "cluster",
]


def drawn_out(text: str) -> int:
    """The runs of three or more of one letter."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    same = a[1:] == a[:-1]
    third = same[1:] & same[:-1]
    first = np.flatnonzero(third & np.concatenate([[True], ~third[:-1]])) if len(third) else []
    return sum((c := chr(a[k])).isalnum() and not c.isdecimal() for k in first)


def spaced_out(text: str, tokens: list[str], odd: list[str]) -> list[str]:
    """Words written with a separator after each letter, joined again.

    Either two tokens in a row are single characters, or one of the ``odd`` ones, which hold
    more than letters, has a separator between single characters: else the text isn't searched.
    """
    single = [k for k, t in enumerate(tokens) if len(t) == 1]
    if any(map(operator.eq, map(operator.sub, single[1:], single), itertools.repeat(1))) or any(map(SPACED_PART.search, odd)):
        return [re.sub(r"[ .*_-]", "", m[0]).lower() for m in SPACED.finditer(text)]
    return []


def toxic_features(text: str, weights: Mapping[str, float], insults: frozenset = frozenset(INSULTS)) -> list[float]:
    """Lexicon densities, second-person proximity, capitals, punctuation and disguises.

    weights: the learned words, each with its weight above 0. All 0 for a text without words.
    """
    words = list(itertools.chain.from_iterable((w,) if w.isalnum() else WORD.findall(w) for w in text.lower().split()))
    n = len(words)
    if not n:
        return [0.0] * len(TOXIC_NAMES)
    tokens = text.split()
    odd = [w for w in tokens if not w.isalpha()]
    data = text.encode("utf-8", "replace")
    at = [k for k, w in enumerate(words) if w in weights or w in insults]
    hits = [words[k] for k in at]
    plain = sum(w in insults for w in hits)
    own = [weights[w] for w in hits if w in weights]
    found = {w: weights.get(w, 0.0) for w in hits}
    near = sum(any(v in SECOND_PERSON for v in words[max(0, k - 3) : k + 4]) for k in at)
    disguised = [m for w in odd if not SIGNS.isdisjoint(w) for m in DISGUISED.findall(w)]
    undone = sum((u := w.lower().translate(LEET)) in insults or u in weights for w in disguised)
    joined = spaced_out(text, tokens, odd)
    undone += sum(w in insults or w in weights for w in joined)
    top = sorted(found.values(), reverse=True)[:3]
    letters = share(data, UPPER + LOWER)
    gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
    return [
        math.log1p(n), plain / n, math.log1p(plain), sum(own) / n, math.log1p(len(own)), top[0] if top else 0.0, sum(top), len(found) / n, near / max(1, len(at)), near / n,
        share(data, UPPER) / max(letters, 1e-9), text.count("!") / n, text.count("?") / n, share(data, SYMBOL), len(disguised) / n, float(undone), len(joined) / n,
        drawn_out(text) / n, share(data, DIGIT), 1 / (1 + min(gaps)) if gaps else 0.0,
    ]


def fold_of(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo 5; 0 is held out, as in ``common.held_out``."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def featurize(docs: DataFrame, row_features: Callable[[str, int], list[float]], ids: str = "doc_id") -> DataFrame:
    """doc_id and ``features`` (array of doubles) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            rows = [row_features(t.as_py(), fold_of(d)) for d, t in zip(doc.to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([doc, pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select(F.col(ids).cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, features array<double>")


def training_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, label) of at most about ``bound`` labelled rows outside the held-out fold.

    The rows are those with the smallest hashes of their ids, as a share of all, so the same rows are
    taken at every run. An id with several labels has the largest.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("double").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.count()
    scale = 1 << 30
    part = min(scale, int(scale * bound / max(1, n)))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(scale)) < part).groupBy("doc_id").agg(F.max("label").alias("label"))


def few(labels: DataFrame, bound: int) -> DataFrame:
    """Training labels for a join: broadcast where ``bound`` says that they are some MB at most."""
    return F.broadcast(labels) if bound <= 200_000 else labels


def to_matrix(rows: list, dims: int) -> np.ndarray:
    return np.array([r["features"] for r in rows], dtype=float).reshape(-1, dims)
