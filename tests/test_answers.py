"""Cut answers against a plain scanner, references against all pairs of references and aliases."""

import json
import random

from factloom.functions.answers import whole_members
from factloom.operators import references


def scanned(text):
    """Members read one by one: a step that can't be read ends the reading, a wrong mark spoils it."""
    decode, found, i = json.JSONDecoder().raw_decode, {}, 1
    skip = lambda k: k + len(text[k:]) - len(text[k:].lstrip())
    while (i := skip(i)) < len(text):
        try:
            key, i = decode(text, i)
        except ValueError:
            break
        if not isinstance(key, str) or key in found:
            return {}
        if (i := skip(i)) == len(text):
            break
        if text[i] != ":":
            return {}
        try:
            value, end = decode(text, skip(i + 1))
        except ValueError:
            break
        if end == len(text) and type(value) in (int, float):
            break
        found[key], i = value, skip(end)
        if i == len(text):
            break
        if text[i] == "}":
            return {} if text[i + 1 :].strip() else found
        if text[i] != ",":
            return {}
        i += 1
    return found


def test_cut_answers_keep_what_a_scanner_keeps():
    assert whole_members('{"status": "VALUE",}') == {"status": "VALUE"}
    rng = random.Random(2)
    for _ in range(6000):
        whole = json.dumps({rng.choice("abcd") * rng.randrange(1, 3): rng.choice([1, 23, 4.5, "x", 'q"}{', None, True, [1, {"z": 2}], {"k": [1, 2]}]) for _ in range(rng.randrange(5))}, indent=rng.choice([None, 1]))
        text = whole[: rng.randrange(1, len(whole) + 1)]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(1, len(text) + 1)
            text = text[:k] + rng.choice(["", ",", "}", ":", '"', " ", "x", '"a": 1']) + text[k + rng.randrange(2) :]
        try:
            json.loads(text)
        except ValueError:
            assert whole_members(text) == scanned(text), text


def test_aliases_of_any_number_of_words(spark):
    objects = spark.createDataFrame([("s", 1, "chair", ["old red wooden kitchen chair"]), ("s", 2, "chair", None), ("s", 3, "lamp", []), ("t", 4, "a b c d e f g", None)], "scene string, object_id int, class string, aliases array<string>")
    refs = spark.createDataFrame([(1, "s", "the big old red wooden kitchen chair next to the lamp"), (2, "s", "big lamp"), (3, "s", "chair"), (4, "s", "a b c d e f g"), (5, "t", "x a b c d e f g"), (6, "u", "lamp"), (7, None, None)], "ref_id int, scene string, text string")
    got = {r.ref_id: (r.object_ids, r.status) for r in references.resolved(refs, objects).collect()}
    assert got[1] == ([], "UNRESOLVED")  # two chairs fit: by alias and by class
    assert got[2] == ([3], "UNIQUE_CLASS_IN_SCENE") and got[3] == ([1, 2], "UNIQUE_REFERENTIAL") and got[5] == ([4], "UNIQUE_CLASS_IN_SCENE")
    assert all(got[k] == ([], "UNRESOLVED") for k in (4, 6, 7))
    one = objects.where("object_id <> 2")
    assert {r.ref_id: r.object_ids for r in references.resolved(refs, one).collect()}[1] == [1]
