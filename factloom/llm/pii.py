"""Personal data: regular expressions propose, checksums confirm, nearby words adjust a score.

All of it is SQL functions in the tasks that read the texts; nothing is shuffled. A kind's
pattern runs only over texts that hold a character it can't do without. Quantifiers are
possessive, and a match that could begin anywhere in a run of characters may only begin
where the run or the last match ends, so each pattern takes time in proportion to
the text and finds the same leftmost matches as its plain form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

LOCAL = "[A-Za-z0-9._%+-]"
NAME = "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    needs: a text without a match of this quick pattern (a substring if ``plain``) has none.
    pattern: proposes spans. valid: from a match to whether it is one. score: before
    context. base: kept whatever the score. words: near it, they raise the score.
    """

    name: str
    needs: str
    pattern: str
    valid: object
    score: float
    base: bool = False
    plain: bool = False
    words: list[str] = field(default_factory=list)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _between(low: int, high: int):
    return lambda m: F.length(_digits(m)).between(low, high)


def _octets(match: Column) -> Column:
    part = F.split(match, r"\.")
    # leading zeros don't count
    return F.forall(part, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def _luhn(match: Column) -> Column:
    return _between(13, 19)(match) & F.call_function("luhn_check", _digits(match))


def mod97(match: Column) -> Column:
    """ISO 13616: first four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.upper(F.regexp_replace(match, "[ -]", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), lambda r, c: (F.when(value(c) < 10, r * 10).otherwise(r * 100) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _social(match: Column) -> Column:
    area, group, serial = (F.substring(match, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    return ~area.isin(0, 666) & (area < 900) & (group > 0) & (serial > 0)


#: In the order in which spans are listed.
KINDS = [
    Kind("email", "@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{NAME}++(?:\.{NAME}++)++", lambda m: F.lit(True), 0.9, True, True, ["mail", "email", "contact", "write", "courriel", "correo", "kontakt"]),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.7, True, False, ["ip", "host", "server", "address", "login", "addr"]),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12}", r"[0-9](?:[ -]?[0-9])++", _luhn, 0.8, True, False, ["card", "visa", "mastercard", "credit", "carte", "tarjeta", "karte"]),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", _between(9, 15), 0.6, True, False, ["phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"]),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[ -]?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.8, False, False, ["iban", "bank", "account", "konto", "cuenta", "compte"]),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _social, 0.4, False, False, ["ssn", "social", "security"]),
]

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"
NEAR = 40


def spans_of(text: Column, kind: Kind, least_score: float) -> Column:
    """An array of SPAN in order of start; offsets are in code points, ends exclusive.

    The text between matches (from ``split``) and the matches themselves give the offsets.
    """
    none = F.lit(None).cast(f"array<{SPAN}>")
    gaps, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    pieces = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), m.alias("match")))
    placed = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<match:string,start:bigint,end:bigint>>)").alias("found")),
        lambda s, p: F.struct(
            (s["at"] + p["gap"] + F.coalesce(F.length(p["match"]), F.lit(0))).alias("at"),
            F.when(p["match"].isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(p["match"].alias("match"), (s["at"] + p["gap"]).alias("start"), (s["at"] + p["gap"] + F.length(p["match"])).alias("end"))))).alias("found"),
        ),
    )["found"]
    near = lambda s: F.lower(F.substring(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)).cast("int"), (F.least(s["start"], F.lit(NEAR)) + s["end"] - s["start"] + NEAR).cast("int")))
    context = lambda s: F.when(near(s).rlike(rf"(?<!\p{{L}})(?:{'|'.join(kind.words)})(?!\p{{L}})"), 0.15).otherwise(0.0)
    scored = F.transform(F.filter(placed, lambda s: kind.valid(s["match"])), lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(kind.score) + context(s), F.lit(1.0)).alias("score")))
    kept = scored if kind.base else F.filter(scored, lambda s: s["score"] >= least_score)
    has = F.contains(text, F.lit(kind.needs)) if kind.plain else text.rlike(kind.needs)
    return F.coalesce(F.when(has, kept.cast(f"array<{SPAN}>")).otherwise(none), F.expr(f"cast(array() as array<{SPAN}>)"))


def find_pii(docs: DataFrame, text: str = "text", least_score: float = 0.5, kinds: list[Kind] = KINDS) -> DataFrame:
    """Add ``spans``: array of struct(kind, start, end, score), by kind as listed, then start.

    Matches of a kind don't overlap; spans of different kinds may. Email, address,
    card and phone spans always stay; of the other kinds those with a score of
    ``least_score`` or more. Null counts as empty text; a column ``spans`` that is there is
    replaced; equal rows get equal spans.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("spans", F.concat(*[spans_of(whole, k, least_score) for k in kinds]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first
    names the whole stretch."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    piece = lambda s, x: F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(piece(s, x), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))).otherwise(s["out"]).alias("out"),
    )
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, whole)).otherwise(text)


def redact_pii(docs: DataFrame, **options) -> DataFrame:
    """The same columns with personal data in ``text`` replaced; null texts stay null.

    ``n_chars``, where there is one, counts the new text.
    """
    found = find_pii(docs, **options)
    out = found.withColumn("text", F.when(F.col("text").isNull(), None).otherwise(redact(text_or_empty(), F.col("spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
