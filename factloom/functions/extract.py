"""Question-and-answer rows to typed facts, as column expressions.

Each adapter returns struct(reject_code, facts): facts are struct(subject, predicate, object, value, polarity) and count only
where reject_code is null; a row is accepted only if the facts give back the answer they came from. ``adapted`` runs the adapter
of each row's task once and drops the facts of rejected rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = "struct<subject:string,predicate:string,object:string,value:bigint,polarity:string>"

#: How relations are worded.
RELATIONS = {"left of": "LEFT_OF", "right of": "RIGHT_OF", "above": "ABOVE", "below": "BELOW", "in front of": "FRONT_OF", "behind": "BEHIND"}
#: Small numbers in words.
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def _fact(subject: Column, predicate: Column, obj: Column, value: Column, polarity: Column) -> Column:
    return F.struct(subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"), value.alias("value"), polarity.alias("polarity")).cast(FACT)


def _result(code: Column, facts: Column) -> Column:
    return F.struct(code.alias("reject_code"), facts.alias("facts"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _yes_no(answer: Column) -> Column:
    return F.when(F.lower(F.btrim(answer)) == "yes", "positive").when(F.lower(F.btrim(answer)) == "no", "negative")


def relation(question: Column, answer: Column) -> Column:
    """``Is the X left of the Y?`` with yes or no."""
    pattern = rf"^Is the (.+?) ({'|'.join(RELATIONS)}) the (.+)\?$"
    subject, words, obj = (F.regexp_extract(question, pattern, k) for k in (1, 2, 3))
    predicate = F.lit(None).cast("string")
    for k, v in RELATIONS.items():
        predicate = F.when(words == k, v).otherwise(predicate)
    polarity = _yes_no(answer)
    code = F.when(subject == "", "QUESTION_NOT_RECOGNISED").when(polarity.isNull(), "ANSWER_NOT_YES_NO").when(subject == obj, "SELF_RELATION")
    return _result(code, F.array(_fact(subject, predicate, obj, _null("bigint"), polarity)))


def count(question: Column, answer: Column) -> Column:
    """``How many X are there?`` with a whole number of at most nine digits, written as it reads back."""
    subject = F.regexp_extract(question, r"^How many (.+?) are there\?$", 1)
    value = F.when(answer.rlike("^[0-9]{1,9}$"), answer.cast("bigint"))
    code = F.when(subject == "", "QUESTION_NOT_RECOGNISED").when(value.isNull(), "ANSWER_NOT_COUNT").when(value.cast("string") != answer, "RECONSTRUCTION_MISMATCH")
    return _result(code, F.array(_fact(subject, F.lit("COUNT"), _null("string"), value, F.lit("positive"))))


def option_map(options: Column) -> Column:
    """Letters to texts of ``A. text`` options; later letters must not repeat earlier ones."""
    return F.map_from_entries(F.transform(options, lambda o: F.struct(F.regexp_extract(o, r"^([A-Z])\. ", 1), F.btrim(F.regexp_extract(o, r"^[A-Z]\. (.*)$", 1)))))


def choice_count(question: Column, options: Column, letter: Column) -> Column:
    """A count whose answer is the letter of an option; its number must stand in one option only."""
    chosen = F.element_at(option_map(options), letter)
    same = F.size(F.filter(options, lambda o: F.btrim(F.regexp_extract(o, r"^[A-Z]\. (.*)$", 1)) == chosen))
    whole = count(question, chosen)
    code = F.when(chosen.isNull(), "LETTER_WITHOUT_OPTION").when(same != 1, "OPTION_NOT_UNIQUE").otherwise(whole["reject_code"])
    return _result(code, whole["facts"])


def appearance_order(question: Column, answer: Column) -> Column:
    """A list of distinct things, all named in the question, in order: n - 1 BEFORE facts."""
    items = F.transform(F.split(answer, ","), lambda x: F.btrim(x))
    facts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - 1, F.lit(1))), lambda k: _fact(F.get(items, k - 1), F.lit("BEFORE"), F.get(items, k), _null("bigint"), F.lit("positive")))
    code = F.when(F.size(items) < 2, "TOO_FEW_ITEMS").when(F.size(F.array_distinct(items)) < F.size(items), "ITEM_REPEATED").when(~F.forall(items, lambda x: F.contains(question, x)), "ITEM_NOT_IN_QUESTION")
    return _result(code, facts)


def visibility(question: Column, answer: Column) -> Column:
    """``Is there a X?`` with yes or no."""
    subject = F.regexp_extract(question, r"^Is there an? (.+)\?$", 1)
    polarity = _yes_no(answer)
    code = F.when(subject == "", "QUESTION_NOT_RECOGNISED").when(polarity.isNull(), "ANSWER_NOT_YES_NO")
    return _result(code, F.array(_fact(subject, F.lit("VISIBLE"), _null("string"), _null("bigint"), polarity)))


def dispatch(task: Column, question: Column, options: Column, answer: Column) -> Column:
    """The adapter of a task; other tasks are rejected as unsupported, rows without a question or answer as incomplete."""
    other = _result(F.lit("TASK_UNSUPPORTED"), F.expr(f"cast(array() as array<{FACT}>)"))
    out = F.when(task == "relation", relation(question, answer)).when(task == "count", count(question, answer)).when(task == "choice_count", choice_count(question, options, answer))
    out = out.when(task == "order", appearance_order(question, answer)).when(task == "visibility", visibility(question, answer)).otherwise(other)
    missing = _result(F.lit("FIELD_MISSING"), F.expr(f"cast(array() as array<{FACT}>)"))
    return F.when(task.isNull() | question.isNull() | answer.isNull(), missing).otherwise(out)


def adapted(rows: DataFrame, task: Column, question: Column, options: Column, answer: Column) -> DataFrame:
    """Add status (ACCEPTED or REJECTED), reject_code and facts.

    A generator over one element keeps the optimizer from working the adapters out again for each field.
    """
    once = rows.select("*", F.inline(F.array(dispatch(task, question, options, answer))))
    ok = F.col("reject_code").isNull()
    none = F.expr(f"cast(array() as array<{FACT}>)")
    return once.withColumn("facts", F.when(ok, F.col("facts")).otherwise(none)).withColumn("status", F.when(ok, "ACCEPTED").otherwise("REJECTED"))


def quantity(text: Column) -> Column:
    """The number that a phrase begins with, in digits or words; null if none."""
    first = F.lower(F.regexp_extract(F.btrim(text), r"^(\w+)", 1))
    word = F.element_at(F.create_map(*[x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]), first)
    return F.when(first.rlike("^[0-9]{1,9}$"), F.when(first.rlike("^[0-9]{1,9}$"), first).cast("bigint")).otherwise(word)


def change(sentence: Column) -> Column:
    """struct(kind, target, to) of a sentence that says what was added, removed, moved or replaced."""
    forms = [
        ("REMOVE", r"^(?:Remove the (.+)|The (.+) (?:has been|was) removed)\.$", None),
        ("REPLACE", r"^(?:Replace the (.+?) with .+|The (.+?) (?:has been|was) replaced (?:with|by) .+)\.$", r"(?:with|by) (?:an? |the )?(.+)\.$"),
        ("MOVE", r"^(?:Move the (.+?) to .+|The (.+?) (?:has been|was) moved to .+)\.$", r" to (?:the )?(.+)\.$"),
        ("ADD", r"^(?:Add an? (.+)|An? (.+) (?:has been|was) added)\.$", None),
    ]
    out = F.lit(None).cast("struct<kind:string,target:string,to:string>")
    for kind, pattern, to in reversed(forms):
        target = F.concat(F.regexp_extract(sentence, pattern, 1), F.regexp_extract(sentence, pattern, 2))
        out = F.when(sentence.rlike(pattern), F.struct(F.lit(kind).alias("kind"), target.alias("target"), (F.regexp_extract(sentence, to, 1) if to else _null("string")).alias("to"))).otherwise(out)
    return out
