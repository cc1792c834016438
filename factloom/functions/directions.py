"""Questions about directions to typed facts: a facing observer, perspectives, states after a change, and coloured boxes.

Each adapter returns struct(reject_code, frame, facts). Facts are struct(subject, predicate, object, value, polarity) and count only where reject_code is
null. As for the other adapters, the facts must give back the answer that they came from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canon import slug
from .extract import FACT
from .text import let

#: Words of answers and the relations that they mean, for perspectives and for states after a change.
PERSPECTIVE = {"left": "LEFT_OF", "right": "RIGHT_OF", "front": "FRONT_OF", "forward": "FRONT_OF", "rear": "BEHIND", "back": "BEHIND", "above": "ABOVE", "upper": "ABOVE", "below": "BELOW", "lower": "BELOW"}
AFTER_CHANGE = {"left": "LEFT_OF", "right": "RIGHT_OF", "front": "FRONT_OF", "back": "BEHIND", "above": "ABOVE", "below": "BELOW", "higher": "ABOVE", "lower": "BELOW"}
#: Words looked for in free answers; those of depth only where an observer is the reference.
FREE = {"left": "LEFT_OF", "right": "RIGHT_OF", "above": "ABOVE", "below": "BELOW"}
DEPTH = {"front": "FRONT_OF", "behind": "BEHIND"}
EXCLUSIVE = [("LEFT_OF", "RIGHT_OF"), ("ABOVE", "BELOW"), ("FRONT_OF", "BEHIND")]
#: Answers to accept after a change, and how questions ask for a count, a perspective or a relation.
ANSWERS = ["left", "right", "front", "back", "above", "below", "higher", "lower", "front left", "front right", "back left", "back right"]
COUNT_CUES = ["how many", "number of", "total number", "total count", "current count", "new count"]
PERSPECTIVE_CUES = ["perspective", "left or right", "left/right", "if you", "if you're", "if i "]
RELATION_CUES = [" relative to ", " in relation to ", " in comparison to ", " compared to ", " positioned in relation to ", " situated in relation to ", " with respect to "]
#: Why questions of a type that isn't taken are rejected.
REASONS = {"Scale": "METRIC_OR_COMMONSENSE_DEPENDENCY", "Scale Direction": "METRIC_OR_PATH_DEPENDENCY", "Semantic": "COMMONSENSE_OR_UNSUPPORTED_SEMANTIC", "Direction": "AMBIGUOUS_ENTITY_OR_UNSUPPORTED_RELATION"}

OPTION = r"(?s)^\s*([A-Z])\.\s*(.*?)\s*$"
COUNT = r"^[0-9]{1,9}$"


def _named(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def _one_of(text: Column, cues: list[str]) -> Column:
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(text, F.lit(cue))
    return found


def _fact(subject: Column, predicate: Column, other: Column, value: Column | None = None) -> Column:
    fields = {"subject": subject, "predicate": predicate, "object": other, "value": F.lit(None) if value is None else value, "polarity": F.lit("positive")}
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(FACT)


def _result(code: Column, frame: Column, facts: Column) -> Column:
    none = F.expr(f"cast(array() as array<{FACT}>)")
    return let(code, lambda c: F.struct(c.alias("reject_code"), F.when(c.isNull(), frame).alias("frame"), F.when(c.isNull(), facts).otherwise(none).alias("facts")))


def _relations(predicates: Column, subject: Column, other: Column) -> Column:
    return F.transform(predicates, lambda p: _fact(subject, p, other))


def facing(question: Column, options: Column, letter: Column) -> Column:
    """``If I am standing by the O and facing the F, is the S to the left or the right of the F?`` with options ``A. left``.

    The thing faced must be the reference; the letter must name the only option of its meaning. Two options of one letter: the last counts.
    """
    pattern = r"(?i)^If I am standing by the (.+?) and facing the (.+?), is the (.+?) to the left or the right of the (.+?)\?$"

    def judged(parts: Column, meaning: Column, said: Column) -> Column:
        origin, faced, subject, other = (F.btrim(F.get(parts, F.lit(k))) for k in range(4))
        predicate = _named({k: PERSPECTIVE[k] for k in ("left", "right")}, said)
        first = F.get(F.filter(meaning, lambda m: m["text"] == said), F.lit(0))["letter"]
        code = (
            F.when((origin == "") | (F.lower(faced) != F.lower(other)), "MISSING_REFERENCE_FRAME").when(~F.forall(meaning, lambda m: m["letter"] != ""), "SOURCE_RECONSTRUCTION_FAIL")
            .when(predicate.isNull(), "UNSUPPORTED_OPERATOR").when(first != letter, "SOURCE_RECONSTRUCTION_FAIL")
        )
        frame = F.concat(F.lit("agent_at:"), slug(origin), F.lit(":facing:"), slug(other))
        return _result(code, frame, F.array(_fact(F.concat(F.lit("mention:"), slug(subject)), predicate, F.concat(F.lit("mention:"), slug(other)))))

    # each value is worked out once a row: parts of a matched question hold no line break, and a question that doesn't match has empty parts
    cut = lambda q: let(F.regexp_replace(q, pattern, "$1\n$2\n$3\n$4"), lambda s: F.when(s != q, F.split(s, "\n")).when(s.isNotNull(), F.array_repeat(F.lit(""), 4)))
    meaning = F.transform(options, lambda o: F.struct(F.regexp_extract(o, OPTION, 1).alias("letter"), F.lower(F.regexp_extract(o, OPTION, 2)).alias("text")))
    said = lambda ms: F.try_element_at(F.filter(ms, lambda m: m["letter"] == F.upper(letter)), F.lit(-1))["text"]
    return let(let(F.btrim(question), cut), lambda parts: let(meaning, lambda ms: let(said(ms), lambda text: judged(parts, ms, text))))


def perspective(item: Column, task: Column, subtask: Column, question: Column, options: Column, answer: Column) -> Column:
    """An option by its place (from 0): a count where the question asks for one, or directions seen from a stated perspective."""
    asked, chosen = F.lower(question), F.btrim(F.when((answer >= 0) & (answer < F.size(options)), F.get(options, answer)))
    words = F.split(F.btrim(F.regexp_replace(F.lower(chosen), r"[-\s]+", " ")), " ")
    known = F.forall(words, lambda w: w.isin(*PERSPECTIVE))
    count = chosen.rlike(COUNT) & (F.contains(asked, F.lit("how many")) | F.startswith(asked, F.lit("count ")))
    direction = (task == "Perspective_Taking") & known & _one_of(asked, PERSPECTIVE_CUES)
    other = F.when(subtask.isin("Motion_Analysis", "Geospatial_Strategy"), "NUMERIC_DEPENDENCY").otherwise("UNSUPPORTED_OPERATOR")
    places = F.filter(F.sequence(F.lit(0), F.size(options) - 1), lambda k: F.btrim(F.get(options, k)) == chosen)
    code = F.when(chosen.isNull(), "MALFORMED_SOURCE_OPTIONS").when(~F.coalesce(count | direction, F.lit(False)), other).when((F.size(places) != 1) | (places[0] != answer), "SOURCE_RECONSTRUCTION_FAIL")
    named = lambda kind: F.concat(F.lit(kind + ":"), item)
    relations = _relations(F.array_distinct(F.transform(words, lambda w: _named(PERSPECTIVE, w))), named("query_target"), named("perspective_reference"))
    number = F.when(chosen.rlike(COUNT), chosen).cast("bigint")
    facts = F.when(count, F.array(_fact(named("query_set"), F.lit("COUNT"), F.lit(None), number))).otherwise(relations)
    return _result(code, F.when(count, "source_question_declared").otherwise("source_question_declared_perspective"), facts)


def after_change(item: Column, question_type: Column, question: Column, answer: Column) -> Column:
    """A count or a direction in the state after a change; a direction must read back from its relations word for word."""
    asked, said = F.btrim(F.regexp_replace(F.lower(question), r"\s+", " ")), F.lower(F.btrim(answer))
    count = said.rlike(COUNT) & _one_of(asked, COUNT_CUES)
    vertical = said.isin("higher", "lower") & F.contains(asked, F.lit("higher or lower"))
    direction = said.isin(ANSWERS) & (vertical | _one_of(asked, RELATION_CUES))
    other = F.coalesce(_named(REASONS, question_type), F.lit("UNSUPPORTED_OPERATOR"))
    empty = F.lit(False)
    for c in (item, question_type, question, answer):
        empty = empty | F.coalesce(F.btrim(c) == "", F.lit(True))
    code = F.when(empty, "MALFORMED_SOURCE_RECORD").when(~F.coalesce(count | direction, F.lit(False)), other)
    code = code.when(count & (F.when(said.rlike(COUNT), said).cast("bigint").cast("string") != F.btrim(answer)), "SOURCE_RECONSTRUCTION_FAIL")
    named = lambda kind: F.concat(F.lit(kind + ":"), item)
    relations = _relations(F.array_distinct(F.transform(F.split(said, " "), lambda w: _named(AFTER_CHANGE, w))), named("query_subject"), named("query_reference"))
    facts = F.when(count, F.array(_fact(named("query_set"), F.lit("COUNT"), F.lit(None), F.when(said.rlike(COUNT), said).cast("bigint")))).otherwise(relations)
    return _result(code, F.lit("source_declared_post_intervention"), facts)


def free_relations(text: Column, depth: Column) -> Column:
    """The relations whose words stand in a text, in a fixed order; those of depth only where ``depth``."""
    has = lambda low, words, use: [F.when(use & low.rlike(rf"\b{w}\b"), p) for w, p in words.items()]
    return let(F.lower(text), lambda low: F.array_compact(F.array(*has(low, FREE, F.lit(True)), *has(low, DEPTH, depth))))


def coloured_boxes(observer: Column, question: Column, answer: Column) -> Column:
    """Where the red box is, in prose or as the letter of an option line ``A. left, above`` in the question; metric words are ignored.

    observer: whether the viewpoint is the reference, else the blue box. Relations that exclude each other are rejected, and letters whose relations
    another option shares.
    """
    lines = F.filter(F.split(question, "\n"), lambda x: x.rlike(r"^[A-D]\.\s*"))
    letter = F.upper(F.btrim(answer))
    is_letter = letter.isin("A", "B", "C", "D")
    option = F.element_at(F.filter(lines, lambda x: F.substring(x, 1, 1) == letter), -1)
    meaning = F.when(is_letter, F.regexp_replace(option, r"^[A-D]\.\s*", "")).otherwise(answer)
    other = F.when(observer, "mention:observer_primary_view").otherwise("mention:blue_bbox_target")

    def judged(said: Column) -> Column:
        same = F.filter(lines, lambda x: free_relations(F.regexp_replace(x, r"^[A-D]\.\s*", ""), observer) == said)
        clash = F.lit(False)
        for a, b in EXCLUSIVE:
            clash = clash | (F.array_contains(said, a) & F.array_contains(said, b))
        bad = said.isNull() | (F.size(said) == 0) | clash | (is_letter & (F.size(same) != 1))
        code = F.when(F.coalesce(bad, F.lit(True)), "SOURCE_RECONSTRUCTION_FAIL")
        return _result(code, F.lit("source_question_declared_perspective"), _relations(said, F.lit("mention:red_bbox_target"), other))

    return let(free_relations(meaning, observer), judged)
