"""Readers of model answers: strict JSON and label recovery."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_KEY = r'(?<!\\)"label"\s*:\s*"(SUPPORTED|CONTRADICTORY|UNKNOWN)"'


def strict_object(text: str | None) -> dict:
    """A JSON object without repeated keys, NaN or infinities; else ValueError."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("REPEATED_KEY")
        return out

    def refuse(_):
        raise ValueError("NOT_FINITE")

    def finite(x):
        value = float(x)
        return value if math.isfinite(value) else refuse(x)

    try:
        value = json.loads(text or "", object_pairs_hook=once, parse_constant=refuse, parse_float=finite)
    except json.JSONDecodeError as e:
        raise ValueError("NOT_JSON") from e
    if not isinstance(value, dict):
        raise ValueError("NOT_AN_OBJECT")
    return value


def strict_json(text: Column) -> Column:
    """struct(status, keys): OK and sorted keys, or the reason why it isn't strict JSON.

    Spark's own reader takes the last of repeated keys, so this needs Python.
    """

    @F.pandas_udf("status string, keys array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append(("OK", sorted(strict_object(t))))
            except ValueError as e:
                out.append((str(e), []))
        return pd.DataFrame(out, columns=["status", "keys"])

    return run(text)


def without_fence(raw: Column) -> Column:
    """The inside of a fence around the whole answer, else the answer."""
    inside = F.regexp_extract(raw, r"(?s)^\s*```(?:json)?\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(raw.rlike(r"(?s)^\s*```(?:json)?\s*\n.*```\s*$"), inside).otherwise(raw)


def recovered_label(raw: Column) -> Column:
    """The one label that an answer states, also a truncated one; null if there is none or two keys disagree
    or repeat."""
    found = F.regexp_extract_all(raw, F.lit(LABEL_KEY), F.lit(1))
    return F.when(F.size(found) == 1, found[0])


def first_closed_label(raw: Column) -> Column:
    """The label of an answer that begins with an object whose first key is the label, once its string is closed, whatever follows.

    Null where another label key follows, quoted (escapes undone), or bare before a colon; a fence that opens the answer is skipped.
    """
    text = F.regexp_replace(raw, r"^\s*```(?:json)?\s*\n", "")
    label = F.regexp_extract(text, r'^\s*\{\s*"label"\s*:\s*"(SUPPORTED|CONTRADICTORY|UNKNOWN)"', 1)
    rest = F.regexp_replace(text, r'^\s*\{\s*"label"\s*:\s*"[A-Z]+"', "")
    letters = "".join(rf"(?:{c}|\\u00{ord(c):02x})" for c in "label")
    again = rest.rlike(rf'"{letters}"\s*:') | F.regexp_replace(rest, r'"(?:[^"\\]|\\.)*"', '""').rlike(r"[{,]\s*label\s*:")
    return F.when((label != "") & ~again, label)
