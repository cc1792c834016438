"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Words are cut into grams at each place: two code points, and one more for as long as the gram is still frequent among
all words, up to four. So frequent beginnings give way to longer, rarer grams, and a gram depends on no letter outside of
itself. An edit changes the grams that contain it and no others, which bounds what it can change of a word: of the lists of words of
each gram, only those of a word's rarest grams are merged, as many as it takes until no single edit could have changed all of
them. The longer lists stay unread. What meets in a list is verified.

Lists are kept by place, counted from the start and from the end. A list of many words is divided by the forms that its
words take when one letter beyond the gram is left out, which words one edit apart share; so work grows with the words
and not with the square of any list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_counted, materialize, text_or_empty

#: Maximal runs of letters.
LETTERS = r"[A-Za-zÀ-ÿ]+"
START, END = "\x01", "\x02"
SHORTEST, LONGEST = 2, 4
#: The dictionary of frequent grams has fewer entries than this, whatever the number of words.
DICTIONARY = 200_000
#: Lists of more words are divided (or of more than a millionth of all entries, so that less than a million lists are named to all tasks).
LONG_LIST, MOST_LONG = 200, 1_000_000
#: Parameters of the hash of a form: a prime below 2^61 and a base.
PRIME, BASE = (1 << 61) - 1, 1_000_003


def counted_words(docs: DataFrame, misspelt: int | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``least_length`` code points and ``least_count`` occurrences.

    docs: doc_id (any type; a null id reads as an empty text), text (null: no words); other columns are ignored. With ``misspelt`` a run
    loses one code point where the number divides the crc32 of id and run, that at the crc32 modulo its length.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), ascii_lower(text_or_empty()).alias("text"))
    word = F.explode(F.regexp_extract_all("text", F.lit(LETTERS), 0)).alias("word")
    if misspelt is None:
        words = rows.select(word)
    else:
        hashed = rows.select("id", word).select("word", F.crc32(F.concat_ws(":", "id", "word").cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        words = hashed.select(F.when(F.col("h") % misspelt == 0, shorter).otherwise(F.col("word")).alias("word"))
    counts = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """Frequent grams of the words and how often they stand in them: those with more than a ``size``-th of all occurrences, so fewer than ``size``."""
    padded = words.select(F.concat(F.lit(START), "word", F.lit(END)).alias("w"))
    places = padded.select("w", F.explode(F.sequence(F.lit(1), F.char_length("w") - (SHORTEST - 1))).alias("p"))
    grams = places.select(F.explode(F.array(*[F.substring("w", F.col("p"), F.lit(q)) for q in range(SHORTEST, LONGEST + 1)])).alias("gram"))
    counts = materialize(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r.gram: r.n for r in counts.where(F.col("n") > max(50, total // size)).collect()}


def grams_of(word: str, frequent: dict[str, int]) -> list[str]:
    """The gram at each place of the word between its ends."""
    padded = START + word + END
    n, out = len(padded), []
    for p in range(n - SHORTEST + 1):
        q = SHORTEST
        while q < LONGEST and p + q < n and padded[p : p + q] in frequent:
            q += 1
        out.append(padded[p : p + q])
    return out


def lists_to_merge(grams: list[str], frequent: dict[str, int]) -> set[str]:
    """The word's rarest grams, as many as it takes until no edit changes all of them.

    An edit changes the grams that contain one letter (or two neighbours, for an insertion), so grams are changed together as
    long as their places have a letter in common. Of two words one edit apart, take the rarest gram with a place that
    the edit leaves alone: what is rarer in either word is changed, so the gram is among those chosen for both.
    """
    first, last = {}, {}  # the letters that all places of a gram contain
    for p, g in enumerate(grams):
        first[g] = max(first.get(g, 1), p)
        last[g] = min(last.get(g, len(grams) - 1), p + len(g) - 1)
    low, high, chosen = 1, len(grams) - 1, set()
    for g in sorted(first, key=lambda g: (frequent.get(g, 0), g)):
        if low > high:
            break
        chosen.add(g)
        low, high = max(low, first[g]), min(high, last[g])
    return chosen


def entries_of(word: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """(key, cut) of the lists that are merged for the word: a gram with its distance from the start (even keys) and from the end (odd).

    An unchanged gram stands at the same distance from the start in both words if the edit comes after it, else from the end. The edit
    is then at or behind the cut, or before it.
    """
    grams = grams_of(word, frequent)
    chosen, out = lists_to_merge(grams, frequent), []
    for p, g in enumerate(grams):
        if g in chosen:
            code = zlib.crc32(g.encode()) << 31
            out += [(code | p << 1, min(p + len(g) - 1, len(word))), (code | (len(grams) - p) << 1 | 1, max(p - 1, 0))]
    return out


def forms_of(word: str, key: int, cut: int) -> list[int]:
    """Hashes of the word and of what it is without one letter on the side of the cut where the edit is."""
    n = len(word)
    ahead, behind, power = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
    for k, c in enumerate(word):
        ahead[k + 1] = (ahead[k] * BASE + ord(c)) % PRIME
        power[k + 1] = power[k] * BASE % PRIME
    for k in range(n - 1, -1, -1):
        behind[k] = (ord(word[k]) * power[n - 1 - k] + behind[k + 1]) % PRIME
    places = range(cut, n) if key % 2 == 0 else range(cut)
    return list({ahead[n], *((ahead[k] * power[n - 1 - k] + behind[k + 1]) % PRIME for k in places)})


def _expanded(rows: DataFrame, schema: str, made) -> DataFrame:
    """Rows that ``made`` gives for each row, a tuple of columns in and out."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in made(*row)]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = [{"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def gram_lists(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(key, id, word, n, cut): the entries of the lists that each word (id, word, n) is merged in."""
    shared = words.sparkSession.sparkContext.broadcast(frequent)
    return _expanded(words.select("id", "word", "n"), "key bigint, id bigint, word string, n bigint, cut int", lambda i, word, n: [(key, i, word, n, cut) for key, cut in entries_of(word, shared.value)])


def _one_edit(left: Column, right: Column) -> Column:
    """Exactly one code point inserted, deleted or replaced."""
    return (F.abs(F.char_length(left) - F.char_length(right)) <= 1) & (F.levenshtein(left, right, 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: each two words (word, n; distinct) that differ by one edit, once.

    No words give no pairs. All pairs are found, whatever the words and the dictionary.
    """
    words = materialize(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "numbered-words")
    entries = materialize(gram_lists(words, gram_dictionary(words)), "gram-lists")
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"))
    long = materialize(sizes.where(F.col("size") > max(LONG_LIST, entries.count() // MOST_LONG)).select("key"), "long-lists")

    short = entries.join(F.broadcast(long), "key", "left_anti")
    side = lambda rows, x: rows.select("key", F.col("word").alias(x), F.col("n").alias(f"{x}_n"))
    met = side(short, "a").join(side(short, "b"), "key").where((F.col("a") < F.col("b")) & _one_edit(F.col("a"), F.col("b"))).drop("key")

    forms = _expanded(entries.join(F.broadcast(long), "key", "left_semi").select("key", "id", "word", "cut"), "form bigint, id bigint", lambda key, i, word, cut: [(f, i) for f in forms_of(word, key, cut)]).distinct()
    ids = forms.withColumnRenamed("id", "x").join(forms.withColumnRenamed("id", "y"), "form").where("x < y").select("x", "y").distinct()
    named = lambda x, a: words.select(F.col("id").alias(x), F.col("word").alias(a), F.col("n").alias(f"{a}_n"))
    divided = ids.join(named("x", "a"), "x").join(named("y", "b"), "y").where(_one_edit(F.col("a"), F.col("b")))
    first = F.col("a") < F.col("b")
    ordered = [F.when(first, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("a", "b"), ("a_n", "b_n"), ("b", "a"), ("b_n", "a_n"))]
    return met.select("a", "a_n", "b", "b_n").unionByName(divided.select(*ordered)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form (word, form): the last one when forms are followed.

    A form occurs at least twice as often as its word, so no path is longer than 63 steps and six doublings follow it.
    """
    now = materialize(forms.select("word", F.col("form").alias("up")), "roots")
    for _ in range(6):
        children = now.groupBy("up").agg(F.count("*").alias("copies"))
        further = materialize(now.select(F.col("word").alias("up"), F.col("up").alias("next")).join(children, "up"), "further")
        if not further.limit(1).count():
            break
        now = materialize(join_counted(now, further, ["up"], "copies", now.count()).select("word", F.coalesce("next", "up").alias("up")), "roots")
    return now.select("word", F.col("up").alias("root"))


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word (word, n; distinct words, n at least 1).

    Near words differ by one code point. The form is the near word of greatest n (ties: the smallest in order of code points) if
    that is at least twice the word's n, else null; the root is where following forms ends, the word itself where it has none. An empty
    table gives no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words), "near-words")
    ways = pairs.select("a", F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n")).withColumnRenamed("a", "word")
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    known = words.join(best, "word", "left")
    enough = -F.col("best.m") >= 2 * F.col("n")
    out = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
