"""References in words to objects, worlds under several names, and what the rules say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_reference, plural_forms

#: Words after which a reference names something else than its head.
TAIL = r"\b(?:beside|near|next to|left of|right of|in front of|behind|above|below|under|underneath|over|on|by|between|closest to|adjacent to|with|that|which)\b"


def resolved(references: DataFrame, objects: DataFrame) -> DataFrame:
    """(ref_id, object_ids, status): which objects of its scene each reference means.

    references: ref_id, scene, text. objects: scene, object_id, class, aliases (array). A reference that equals an alias means all objects with it:
    ANNOTATION_ALIGNED if it isn't the class of some of them, else UNIQUE_REFERENTIAL. Otherwise the words before the first relation may hold the alias of
    exactly one object: UNIQUE_CLASS_IN_SCENE. Else UNRESOLVED without objects. Both steps are equi-joins on scene and words: runs of
    words of a reference meet aliases, for each number of words that some alias of the scene has. An alias is one row of a scene and so is a
    text, however many objects and references have it, so no pairs of them are made. Null texts and scenes are UNRESOLVED.
    """
    refs = references.select("ref_id", "scene", normalise_reference(F.col("text")).alias("name"))
    named = objects.select("scene", "object_id", normalise_reference(F.col("class")).alias("kind"), F.explode(F.array_distinct(F.transform(F.concat(F.array("class"), F.coalesce("aliases", F.array().cast("array<string>"))), normalise_reference))).alias("name")).where("name <> ''")
    asked = refs.select("scene", "name").distinct()
    meant = named.join(asked, ["scene", "name"], "left_semi").groupBy("scene", "name").agg(F.sort_array(F.collect_set("object_id")).alias("exact"), F.bool_or(F.col("name") != F.coalesce("kind", F.lit(""))).alias("other"))
    words = F.split(F.btrim(F.get(F.split(F.col("name"), TAIL, 2), F.lit(0))), " ")
    lengths = named.groupBy("scene").agg(F.collect_set(F.size(F.split("name", " "))).alias("lengths"))
    runs = F.flatten(F.transform("lengths", lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))))
    bounds = named.groupBy("scene", "name").agg(F.min("object_id").alias("low"), F.max("object_id").alias("high"))
    heads = asked.join(lengths, "scene").withColumn("words", words).select("scene", F.col("name").alias("reference"), F.explode(F.array_distinct(runs)).alias("name"))
    head = heads.join(bounds, ["scene", "name"]).groupBy("scene", "reference").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high")
    out = refs.join(meant, ["scene", "name"], "left").join(head.select("scene", F.col("reference").alias("name"), F.array("low").alias("head")), ["scene", "name"], "left")
    none = F.array().cast(meant.schema["exact"].dataType)
    status = F.when(F.col("exact").isNotNull(), F.when(F.col("other"), "ANNOTATION_ALIGNED").otherwise("UNIQUE_REFERENTIAL")).when(F.col("head").isNotNull(), "UNIQUE_CLASS_IN_SCENE").otherwise("UNRESOLVED")
    return out.select("ref_id", F.coalesce("exact", "head", none).alias("object_ids"), status.alias("status"))


def class_counts(questions: DataFrame, stated: DataFrame, objects: DataFrame) -> DataFrame:
    """(question_id, kind, n): how many things of the class that a question names its scene has.

    questions: question_id, scene, subject. stated: scene, kind, n. objects: scene, kind. A class fits in the singular or plural. Stated counts above 0 come first:
    if several classes fit, there is no answer; if none fits, objects are counted, of which exactly one class must fit.
    """
    forms = lambda rows: rows.withColumn("kind", normalise_reference(F.col("kind"))).where("kind <> ''").withColumn("form", F.explode(F.array_distinct(plural_forms(F.col("kind")))))
    asked = questions.select("question_id", "scene", F.regexp_replace(normalise_reference(F.col("subject")), " present$", "").alias("form"))
    counted = objects.withColumn("kind", normalise_reference(F.col("kind"))).groupBy("scene", "kind").agg(F.count("*").alias("n"))
    tiers = forms(stated.where("n > 0").select("scene", "kind", "n")).withColumn("tier", F.lit(0)).unionByName(forms(counted).withColumn("tier", F.lit(1)))
    fits = asked.join(tiers, ["scene", "form"]).groupBy("question_id", "tier").agg(F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind"), F.min("n").alias("n"))
    first = fits.groupBy("question_id").agg(F.min_by(F.struct("kinds", "kind", "n"), "tier").alias("f"))
    one = F.col("f.kinds") == 1
    return asked.join(first, "question_id", "left").select("question_id", F.when(one, F.col("f.kind")).alias("kind"), F.when(one, F.col("f.n")).alias("n"))


def valid_world(world: Column) -> Column:
    """``prefix:rest`` without white space at the ends, neither part empty; null isn't valid."""
    return F.coalesce(world.rlike(r"(?s)\A(?!\s)[^:]+:.*\S\z"), F.lit(False))


def recovered_worlds(metadata: DataFrame, sources: DataFrame) -> DataFrame:
    """(sample_id, world, status) of samples from their own metadata or, by exact id, from released sources.

    metadata: sample_id, world, split, level. sources: sample_id, world, scene, split, level. A source's world must be its scene's and its split and level the
    sample's. Statuses: ORIGINAL_METADATA, UNRESOLVED, SOURCE_WORLD_SCENE_MISMATCH, SPLIT_OR_LEVEL_MISMATCH, CONFLICTING_WORLD, EXACT_SAMPLE_ID (the sample had none)
    and ORIGINAL_CROSSCHECKED. Only the first and the last two have a world.
    """
    s = sources.select("sample_id", *[F.col(c).alias(f"_{c}") for c in ("world", "scene", "split", "level")], F.lit(True).alias("_there"))
    both = metadata.join(s, "sample_id", "left")
    fits = valid_world(F.col("_world")) & (F.col("_world") == F.concat(F.lit("scene:"), F.col("_scene")))
    same = (F.col("split") == F.col("_split")) & (F.col("level") == F.col("_level"))
    status = (
        F.when(F.col("_there").isNull(), F.when(valid_world(F.col("world")), "ORIGINAL_METADATA").otherwise("UNRESOLVED")).when(~F.coalesce(fits, F.lit(False)), "SOURCE_WORLD_SCENE_MISMATCH").when(~F.coalesce(same, F.lit(False)), "SPLIT_OR_LEVEL_MISMATCH")
        .when(F.col("world") != F.col("_world"), "CONFLICTING_WORLD").when(F.col("world").isNull(), "EXACT_SAMPLE_ID").otherwise("ORIGINAL_CROSSCHECKED")
    )
    world = F.when(status.isin("EXACT_SAMPLE_ID", "ORIGINAL_CROSSCHECKED"), F.col("_world")).when(status == "ORIGINAL_METADATA", F.col("world"))
    return both.select("sample_id", world.alias("world"), status.alias("status"))


def existence_label(rule: Column, subject: Column, entity: Column, old: Column, new: Column, claimed: Column) -> Column:
    """Whether a thing exists after a change by its rule: additions make it, removals and replacements take it, and what replaces it is there.

    UNKNOWN without a rule, a claimed value, or where the rule is about another thing.
    """
    truth = F.when((rule == "ADDITION_CREATES_ENTITY") & (subject == entity), True).when((rule == "REMOVAL_DELETES_ENTITY") & (subject == entity), False)
    truth = truth.when((rule == "REPLACEMENT_SWAPS_ENTITIES") & (subject == old), False).when((rule == "REPLACEMENT_SWAPS_ENTITIES") & (subject == new), True)
    return F.when(truth.isNull() | claimed.isNull(), "UNKNOWN").when(truth == claimed, "SUPPORTED").otherwise("CONTRADICTORY")


def alias_candidates(world: Column) -> Column:
    """Other names under which a world may be known: its capture and room (``scene0001_00``), or the uuid that it ends in. Candidates, not accepted aliases."""
    capture = F.regexp_extract(world, r"(scene[0-9]{4}_[0-9]{2})", 1)
    last = F.element_at(F.split(world, ":"), -1)
    both = F.array(F.concat(F.lit("same_capture:"), capture), F.concat(F.lit("possible_room:"), F.substring(capture, 1, 9)))
    none = F.array().cast("array<string>")
    return F.when(capture != "", both).when(last.rlike(r"\A[a-f0-9]{8}-[a-f0-9-]{27}\z"), F.array(F.concat(F.lit("same_uuid:"), last))).otherwise(none)
