"""Changes that a scene admits, and claims about what holds after them.

Scenes are rows: counts (scene, category, n), objects (scene, object_id, category, and low and high of a box on x, y and z, null without one) and stated
relations (scene, subject_id, word, object_id). A candidate is one row, in the columns that ``transitions.checked`` takes for an action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import content_id
from .graph import INVERSE

#: Words of stated relations; relations of boxes in the order in which they are tried, with axis and the sign of the subject's side; categories that name nothing.
STATED = {"left": "LEFT_OF", "right": "RIGHT_OF", "front": "FRONT_OF", "behind": "BEHIND", "above": "ABOVE", "below": "BELOW"}
SIDES = {"LEFT_OF": ("x", -1), "RIGHT_OF": ("x", 1), "FRONT_OF": ("y", 1), "BEHIND": ("y", -1), "ABOVE": ("z", 1), "BELOW": ("z", -1)}
AXES = {"x": "horizontal", "y": "depth", "z": "vertical"}
NAMELESS = ("", "object", "item")
MARGIN = 0.02

COLUMNS = ("scene", "family", "target", "category", "new_category", "new_entity", "anchor", "anchor_category", "pre_predicate", "post_predicate", "axis", "quantity", "source_group")


def _rows(df: DataFrame, **values: Column | str | int | None) -> DataFrame:
    """Candidates with every column; those that a family doesn't have are null."""
    kinds = {"quantity": "bigint"}
    cast = lambda k: (values[k] if isinstance(values.get(k), Column) else F.lit(values.get(k))).cast(kinds.get(k, "string")).alias(k)
    return df.select("scene", *[cast(k) for k in COLUMNS[1:]])


def unique_objects(objects: DataFrame) -> DataFrame:
    """Objects that are the only one of their category in their scene. Null categories and categories that name nothing have none."""
    alone = objects.groupBy("scene", "category").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return objects.join(alone, ["scene", "category"], "left_semi").where(~F.col("category").isin(*NAMELESS))


def count_candidates(counts: DataFrame, objects: DataFrame) -> DataFrame:
    """One addition for each category that is counted; where its count is 1 and it has just one object, its removal, and its replacement by each other counted category of the scene, as a change of counts and as one of identity.

    Counts that are null or below 1 don't count, nor do empty categories. (scene, category) must be distinct. A replacement is a row for each ordered pair of categories, of which the first has one object: the
    result itself, bounded by the vocabulary of categories and not by a scene's objects.
    """
    c = counts.where("n >= 1 and category <> ''").select("scene", "category")
    new = lambda kind, *parts: F.concat(F.lit("added::"), F.col("scene").cast("string"), F.lit("::"), F.substring(content_id(kind, **{f"p{i}": p for i, p in enumerate(parts)}), -24, 12))
    added = _rows(c, family="ADD_AND_RECOUNT", category=F.col("category"), new_entity=new("add", F.col("scene"), F.col("category")), quantity=1, source_group="COUNT")
    single = counts.where("n = 1 and category <> ''").select("scene", "category")
    own = objects.groupBy("scene", "category").agg(F.count("*").alias("_n"), F.min("object_id").alias("target")).where("_n = 1").drop("_n")
    alone = single.join(own, ["scene", "category"])
    removed = _rows(alone, family="REMOVE_AND_RECOUNT", target=F.col("target"), category=F.col("category"), source_group="OBJECT")
    swaps = alone.join(c.withColumnRenamed("category", "new_category"), "scene").where("category <> new_category")
    replaced = [
        _rows(swaps, family=family, target=F.col("target"), category=F.col("category"), new_category=F.col("new_category"), new_entity=new("replace", F.col("scene"), F.col("category"), F.col("new_category")), source_group="COUNT_AND_OBJECT")
        for family in ("REPLACE_AND_RECOUNT", "REPLACEMENT_IDENTITY")
    ]
    return added.unionByName(removed).unionByName(replaced[0]).unionByName(replaced[1])


def relation_candidates(objects: DataFrame, relations: DataFrame, counts: DataFrame) -> DataFrame:
    """A move to the other side and a swap for each relation between two objects that are alone in their categories.

    Stated relations come first; a relation that is also seen from boxes stays a stated one. Boxes give the first relation of SIDES on whose axis they are apart by more than
    MARGIN, with the object of the smaller id as subject, and only where both categories are counted as 1. Only objects alone in their category meet, so a scene has at most as
    many as there are categories; objects without a whole box give no relation of boxes.
    """
    alone = unique_objects(objects)
    word = F.create_map(*[F.lit(x) for pair in STATED.items() for x in pair])
    ends = lambda side: alone.select("scene", F.col("object_id").alias(side), F.col("category").alias(f"{side}_category"))
    named = relations.select("scene", F.col("subject_id").alias("target"), F.element_at(word, F.lower(F.btrim("word"))).alias("predicate"), F.col("object_id").alias("anchor")).where("predicate is not null")
    stated = named.join(ends("target"), ["scene", "target"]).join(ends("anchor"), ["scene", "anchor"]).withColumn("_source", F.lit(0))

    exact = counts.where("n = 1").select("scene", "category").distinct()
    boxes = alone.join(exact, ["scene", "category"], "left_semi").where(" and ".join(f"{a}_low is not null and {a}_high is not null" for a in AXES))
    side = lambda name: boxes.select("scene", F.col("object_id").alias(name), F.col("category").alias(f"{name}_category"), *[F.col(f"{a}_{e}").alias(f"_{name}_{a}_{e}") for a in AXES for e in ("low", "high")])
    pairs = side("target").join(side("anchor"), "scene").where("target < anchor")
    predicate = F.lit(None).cast("string")
    for p, (axis, sign) in reversed(SIDES.items()):
        first, second = ("target", "anchor") if sign < 0 else ("anchor", "target")
        predicate = F.when(F.col(f"_{first}_{axis}_high") + MARGIN < F.col(f"_{second}_{axis}_low"), p).otherwise(predicate)
    seen = pairs.select("scene", "target", "anchor", "target_category", "anchor_category", predicate.alias("predicate"), F.lit(1).alias("_source")).where("predicate is not null")

    keys = ["scene", "target", "predicate", "anchor"]
    # under a new name each side's key is the same to the planner, and the union stays dealt by it
    own = lambda df: df.withColumnRenamed("scene", "_scene")
    found = own(stated).unionByName(own(seen)).withColumnRenamed("_scene", "scene").groupBy(*keys).agg(F.min("_source").alias("_source"), F.min("target_category").alias("target_category"), F.min("anchor_category").alias("anchor_category"))
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("predicate"))
    both = found.select("*", F.explode(F.array(F.lit("MOVE_TO_OPPOSITE_SIDE"), F.lit("SWAP_POSITIONS"))).alias("family"))
    return _rows(
        both, family=F.col("family"), target=F.col("target"), category=F.col("target_category"), anchor=F.col("anchor"), anchor_category=F.col("anchor_category"), pre_predicate=F.col("predicate"),
        post_predicate=pick({p: INVERSE[p] for p in SIDES}), axis=pick({p: AXES[a] for p, (a, _) in SIDES.items()}), source_group=F.when(F.col("_source") == 0, "STATED").otherwise("BOXES"),
    )


def with_ids(candidates: DataFrame) -> DataFrame:
    """Adds action_id, a hash of what the candidate is (scene, family and parameters; not its source), and text, the change in words."""
    core = [c for c in COLUMNS if c != "source_group"]
    phrase = lambda *parts: F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
    text = (
        F.when(F.col("family") == "ADD_AND_RECOUNT", phrase("Suppose one ", "$category", " is added to the scene.")).when(F.col("family") == "REMOVE_AND_RECOUNT", phrase("Suppose the ", "$category", " is removed from the scene."))
        .when(F.col("family").isin("REPLACE_AND_RECOUNT", "REPLACEMENT_IDENTITY"), phrase("Suppose the ", "$category", " is replaced with a newly added ", "$new_category", "."))
        .when(F.col("family") == "MOVE_TO_OPPOSITE_SIDE", phrase("Suppose the ", "$category", " is moved to the opposite side of the ", "$anchor_category", " along the ", "$axis", " axis."))
        .otherwise(phrase("Suppose the ", "$category", " and the ", "$anchor_category", " swap positions along the ", "$axis", " axis."))
    )
    return candidates.select(content_id("action", **{c: F.col(c) for c in core}).alias("action_id"), F.col("scene").alias("state"), *candidates.columns, text.alias("text"))


def pre_facts(counts: DataFrame, objects: DataFrame, candidates: DataFrame) -> DataFrame:
    """(state, predicate, subject, object, scope, value): what is known before: counts over the whole scene, objects that exist, relations that candidates start from."""
    row = lambda df, predicate, subject, obj, scope, value: df.select(F.col("scene").alias("state"), predicate.alias("predicate"), subject.cast("string").alias("subject"), obj.cast("string").alias("object"), F.lit(scope).alias("scope"), value.cast("bigint").alias("value"))
    none = F.lit(None)
    known = row(counts.where("n >= 1"), F.lit("COUNT"), F.col("category"), none, "whole_scene", F.col("n"))
    there = row(objects.select("scene", "object_id").distinct(), F.lit("EXISTS_IN_WORLD"), F.col("object_id"), none, "question_local", F.lit(1))
    related = candidates.where("pre_predicate is not null").select("scene", "pre_predicate", "target", "anchor").distinct()
    return known.unionByName(there).unionByName(row(related, F.col("pre_predicate"), F.col("target"), F.col("anchor"), "question_local", none))


def claim_pairs(candidates: DataFrame, checked: DataFrame) -> DataFrame:
    """(action_id, family, subject, object, predicate, value, against_predicate, against_value, changed_slot, code) of each candidate (``with_ids``): a fact that holds after it, and one that it excludes.

    Counts are claimed after the change and against the one before it; a replacement claims the new category's if the last hex digit of its id is odd, else the old one's.
    Identities are claimed false against true, relations against their inverse. code: the checker's error, SUPPORTED_NOT_ENTAILED where the checker's facts lack the claimed one,
    else null; claims are null with a checker's error.
    """
    return claimed(candidates.join(checked.select("action_id", "error", "post"), "action_id"))


def claimed(rows: DataFrame, *more: str) -> DataFrame:
    """``claim_pairs`` of candidates that have error and post of the checker beside them, and the columns ``more`` of theirs."""
    c = F.col
    odd = F.conv(F.substring("action_id", -1, 1), 16, 10).cast("int") % 2 == 1
    counted = c("family").isin("ADD_AND_RECOUNT", "REMOVE_AND_RECOUNT", "REPLACE_AND_RECOUNT")
    newer = (c("family") == "REPLACE_AND_RECOUNT") & odd
    delta = F.when((c("family") == "ADD_AND_RECOUNT") | newer, 1).otherwise(-1)
    predicate = F.when(counted, "COUNT").when(c("family") == "REPLACEMENT_IDENTITY", "SAME_INSTANCE").otherwise(c("post_predicate"))
    subject = F.when(counted, F.when(newer, c("new_category")).otherwise(c("category"))).when(c("family") == "REPLACEMENT_IDENTITY", c("new_entity")).otherwise(c("target"))
    obj = F.when(counted, "").when(c("family") == "REPLACEMENT_IDENTITY", c("target")).otherwise(c("anchor"))
    rows = rows.withColumns({"_p": predicate, "_s": subject, "_o": obj, "_d": delta, "_counted": counted})
    fact = F.get(F.filter("post", lambda f: (f["predicate"] == c("_p")) & (f["subject"] == c("_s")) & (f["object"] == c("_o"))), F.lit(0))
    rows = rows.withColumn("_f", fact)
    own = c("_f").isNotNull() & c("error").isNull()
    against = F.when(c("_p") == c("post_predicate"), c("pre_predicate")).otherwise(c("_p"))
    value = F.when(c("_counted"), c("_f.value") - c("_d")).when(c("_p") == "SAME_INSTANCE", 1 - c("_f.value"))
    slot = F.when(c("_p") == c("post_predicate"), "predicate").otherwise("value")
    keep = lambda v, name: F.when(own, v).alias(name)
    return rows.select(
        "action_id", "family", keep(c("_s"), "subject"), keep(F.nullif(c("_o"), F.lit("")), "object"), keep(c("_p"), "predicate"), keep(c("_f.value"), "value"), keep(against, "against_predicate"), keep(value, "against_value"),
        keep(slot, "changed_slot"), F.coalesce("error", F.when(c("_f").isNull(), "SUPPORTED_NOT_ENTAILED")).alias("code"), *more,
    )
