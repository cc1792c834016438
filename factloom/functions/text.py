"""Text functions: normal forms, templates and their inverse, n-grams, lints and plural forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_reference(value: Column) -> Column:
    """Case folded, other than a-z and 0-9 as one space; leading articles "the", "a", "an" go once each, in that order."""
    out = F.btrim(F.regexp_replace(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))
    return F.regexp_replace(out, "^(?:the )?(?:a )?(?:an )?", "")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens joined by a space."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def plural_forms(label: Column) -> Column:
    """A label, and its plural by y to ies, es or s."""
    plural = F.when(label.rlike("[^aeiou]y$"), F.concat(F.expr("''"), F.regexp_replace(label, "y$", "ies"))).when(label.rlike("(s|x|z|ch|sh)$"), F.concat(label, F.lit("es"))).otherwise(F.concat(label, F.lit("s")))
    return F.array(label, plural)


#: A phrase for each predicate, and six ways to say a fact.
PHRASES = {"BEFORE": "ships before", "AFTER": "ships after"}
TEMPLATES = ["In world {w}, supplier {s} {p} supplier {o}.", "Supplier {s} {p} supplier {o} in world {w}.", "World {w}: supplier {s} {p} supplier {o}."]


def render(template: Column, world: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """A sentence from one of TEMPLATES."""
    phrase = F.lit(None).cast("string")
    for k, v in PHRASES.items():
        phrase = F.when(predicate == k, v).otherwise(phrase)
    out = template
    for name, value in (("{w}", world), ("{s}", subject), ("{p}", phrase), ("{o}", obj)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def parse_sentence(text: Column) -> Column:
    """struct(world, subject, predicate, object) of a rendered sentence, nulls where it isn't one."""
    group = lambda pattern: F.regexp_extract(text, pattern, 1)
    number = lambda c: F.when(c != "", c).cast("bigint")
    predicate = F.lit(None).cast("string")
    for k, v in PHRASES.items():
        predicate = F.when(F.contains(text, F.lit(v)), k).otherwise(predicate)
    return F.struct(number(group("(?i)world ([0-9]+)")).alias("world"), number(group("(?i)supplier ([0-9]+) ships")).alias("subject"), predicate.alias("predicate"), number(group("ships [a-z]+ supplier ([0-9]+)")).alias("object"))
