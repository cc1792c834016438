"""What a model's answer states: objects that may be cut off, typed values, actions and judged evidence."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import strict_object

MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[][{},]')
DECODE = json.JSONDecoder().raw_decode
NUMBER_AT_END = re.compile(r"[:\s,\[]-?[0-9][0-9.eE+-]*\Z")
#: Words for relations in values.
VALUES = {"left": "LEFT_OF", "right": "RIGHT_OF", "front": "FRONT_OF", "behind": "BEHIND", "above": "ABOVE", "below": "BELOW"}
OPERATIONS = ["REMOVE", "ADD", "REPLACE", "MOVE", "SWAP"]


def _broken(rest: str, found: dict) -> bool:
    """Whether what follows the last whole member is wrong by itself, rather than cut off: a key that repeats or isn't a string, no colon after it, or no comma after its value."""
    try:
        key, end = DECODE(rest)
    except ValueError:
        return False
    after = rest[end:].lstrip()
    if not isinstance(key, str) or key in found or after[:1] not in ("", ":"):
        return True
    try:
        end = DECODE(after[1:].lstrip())[1]
    except ValueError:
        return False
    after = after[1:].lstrip()[end:].lstrip()
    return after[:1] not in ("", ",", "}") or len(after) > 1 and after[0] == "}"


def whole_members(text: str) -> dict:
    """The members of an object that is cut off or malformed somewhere: those before that place, whose values are surely whole.

    The text is closed at its end, or else at the last comma on the outer level before which it reads as an object. A number at the very end may go on, so it doesn't
    count. Empty if a key repeats, the object was closed and more follows, or marks between keys and values are missing.
    """
    if not text.startswith("{"):
        return {}
    depth, ends = 0, [1]
    for m in MARKS.finditer(text):
        mark = m.group()
        depth += (mark in "{[") - (mark in "}]")
        if depth == 0:
            break
        if mark == "," and depth == 1:
            ends.append(m.start())
    if depth and not NUMBER_AT_END.search(text):
        ends.append(len(text))
    for end in reversed(ends):
        try:
            found = strict_object(text[:end] + "}")
        except ValueError as e:
            if str(e) == "REPEATED_KEY":
                return {}
            continue
        return {} if _broken(text[end + (end > 1) :].lstrip(), found) else found
    return {}


def observed_members(raw: Column, cut: Column) -> Column:
    """map from key to the JSON text of its value; members of inner objects also as ``key.inner``. Empty for what isn't a strict object.

    raw: an answer, in a fence or not; cut: whether it was cut off, so that whole members before the cut count. Null raw gives an empty map.
    """

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, is_cut in zip(texts, cuts, strict=True):
            text = re.sub(r"\A\s*```(?:json)?\s*\n", "", text or "").removesuffix("```").strip(" \n\t\r" if not is_cut else "")
            text = text.lstrip()
            try:
                found = strict_object(text)
            except ValueError as e:
                found = whole_members(text) if is_cut and str(e) == "NOT_JSON" else {}
            flat = {}
            for key, value in found.items():
                flat[key] = json.dumps(value)
                if isinstance(value, dict):
                    flat |= {f"{key}.{k}": json.dumps(v) for k, v in value.items()}
            out.append(flat)
        return pd.Series(out)

    return run(raw, F.coalesce(cut, F.lit(False)))


def _text(members: Column, key: str) -> Column:
    """A member that is a plain string, else null."""
    return F.nullif(F.regexp_extract(members[key], r'^"([^"\\]*)"$', 1), F.lit(""))


def typed_value(members: Column, allowed: Column, prefix: str = "") -> Column:
    """struct(status, value) of ``status`` and ``value`` members: VALUE, UNDETERMINED (value null or absent) or INVALID.

    allowed: names that a value may have (relations also in words, in any case), or null for whole numbers from 0, which must be numbers, not strings.
    """
    status, raw = members[prefix + "status"], members[prefix + "value"]
    word = F.lower(F.btrim(_text(members, prefix + "value")))
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in VALUES.items() for x in pair]), word), F.upper(word))
    value = F.when(allowed.isNull(), F.when(raw.rlike("^[0-9]{1,18}$"), raw)).when(F.array_contains(allowed, name), name)
    open_ = (status == '"UNDETERMINED"') & (F.coalesce(raw, F.lit("null")) == "null")
    out = F.when(open_, "UNDETERMINED").when((status == '"VALUE"') & value.isNotNull(), "VALUE").otherwise("INVALID")
    return F.struct(out.alias("status"), F.when(out == "VALUE", value).alias("value"))


def action_score(members: Column, operation: Column, terms: Column, scope: Column) -> Column:
    """struct(status, operation_correct, target_correct, scope_correct, correct) of a stated action.

    A target is right if all of the terms stand in it as whole words, in any case; that is lexical, not a judgement of meaning.
    """
    op, target, where = _text(members, "operation"), _text(members, "target"), _text(members, "scope")
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(target), r"[^\w]+", " "), F.lit(" "))
    words = F.size(terms) > 0
    right = F.coalesce(words & F.forall(terms, lambda w: F.contains(low, F.concat(F.lit(" "), F.lower(w), F.lit(" ")))), F.lit(False))
    valid = F.coalesce((members["status"] == '"RESOLVED"') & op.isin(OPERATIONS) & target.isNotNull() & where.isNotNull(), F.lit(False))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    status = F.when(F.coalesce(members["status"] == '"UNDETERMINED"', F.lit(False)), "UNDETERMINED").when(valid, "VALID").otherwise("INVALID")
    open_ = status == "UNDETERMINED"
    parts = [(~open_ & same(op, operation)).alias("operation_correct"), (~open_ & right).alias("target_correct"), (~open_ & same(where, scope)).alias("scope_correct")]
    return F.struct(status.alias("status"), *parts, ((status == "VALID") & same(op, operation) & right & same(where, scope)).alias("correct"))


def judgement_valid(met: Column, evidence: Column, reason: Column) -> Column:
    """A judgement that a criterion is met quotes 2 to 160 characters (white space aside) of the reason word for word; one that it isn't quotes nothing."""
    length = F.length(F.regexp_replace(evidence, r"\s+", ""))
    return F.coalesce(F.when(met, F.contains(reason, evidence) & length.between(2, 160)).otherwise(evidence == ""), F.lit(False))
