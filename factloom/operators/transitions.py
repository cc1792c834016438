"""State changes on tables of facts, executed by a general engine and checked by a rule per family.

States are keyed rows (state, predicate, subject, object, scope, value), not arrays: what is deleted, added, looked up and
compared meets by equi-joins on state and slot, so a state with many facts is never one row. A slot is what a fact is
about: predicate, subject, object and scope.

Lists of actions (to delete, to add, allowed) may hold their action's state too, where states aren't null: then they meet by state and
action, and what is dealt by state stays there (``tables.in_place``). Results then have the state as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import INVERSE

SLOT = ["predicate", "subject", "object", "scope"]
FACT = "array<struct<predicate:string,subject:string,object:string,scope:string,value:bigint>>"


def _slots(facts: DataFrame, *keys: str) -> DataFrame:
    """Absent parts of a slot as empty texts, so that slots join."""
    return facts.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in SLOT], *(["value"] if "value" in facts.columns else []))


def _keys(*lists: DataFrame) -> list[str]:
    """What actions meet by: by state first if all have it."""
    return ["state", "action_id"] if all("state" in x.columns for x in lists) else ["action_id"]


def _all(parts: list[DataFrame]) -> DataFrame:
    """A union that stays dealt by state: under a new name each side's key is the same to the planner."""
    own = [df.withColumnRenamed("state", "_state") for df in parts]
    out = own[0]
    for more in own[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("_state", "state")


def executed(actions: DataFrame, pre: DataFrame, deletes: DataFrame, adds: DataFrame, allowed: DataFrame) -> DataFrame:
    """(action_id, errors): what is wrong with each action's lists of slots to delete and facts to add; empty if nothing is.

    actions: action_id, state. pre: state and facts. deletes, allowed: action_id and slots; adds: action_id and facts. Codes, sorted:
    DUPLICATE_PRE_FACT_SLOT, DELETE_FACT_NOT_IN_PRESTATE, DUPLICATE_DELETE_FACT_SLOT, INVALID_POST_COUNT (null or below 0), DUPLICATE_POST_FACT_SLOT and
    UNLISTED_POST_FACT_UPDATE (a fact to add whose slot isn't allowed).
    """
    key = _keys(deletes, adds, allowed)
    own, there, gone, new, fine = actions.select("action_id", "state"), _slots(pre, "state"), _slots(deletes, *key), _slots(adds, *key), _slots(allowed, *key)
    marked = lambda rows, code: rows.select(*key, F.lit(code).alias("code")).distinct()
    twice = lambda rows, *key: rows.groupBy(*key, *SLOT).count().where("count > 1").select(*key).distinct()
    found = [
        marked(own.join(twice(there, "state"), "state"), "DUPLICATE_PRE_FACT_SLOT"), marked(gone.join(own, key).join(there.select("state", *SLOT).distinct(), ["state", *SLOT], "left_anti"), "DELETE_FACT_NOT_IN_PRESTATE"),
        marked(twice(gone, *key), "DUPLICATE_DELETE_FACT_SLOT"), marked(new.where("predicate = 'COUNT' and coalesce(value, -1) < 0"), "INVALID_POST_COUNT"), marked(twice(new, *key), "DUPLICATE_POST_FACT_SLOT"),
        marked(new.join(fine.select(*key, *SLOT).distinct(), [*key, *SLOT], "left_anti"), "UNLISTED_POST_FACT_UPDATE"),
    ]
    errors = _all(found).groupBy(*key).agg(F.array_sort(F.collect_set("code")).alias("errors"))
    return own.select(*key).join(errors, key, "left").select(*key, F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def checked(actions: DataFrame, pre: DataFrame, *more: str) -> DataFrame:
    """(action_id, error, post) and the columns ``more`` of the actions: what each family's rule makes of the facts that it looks up, without the action's own lists.

    actions: action_id, state, family, target, category, new_category, new_entity, anchor, quantity, pre_predicate; what a family doesn't need may be null. A
    lookup counts only if exactly one fact has the predicate, subject and object. error: REJECT_UNAUTHORIZED_RULE for other families,
    REJECT_TRANSITION_PRECONDITION_FAIL, or null; post is empty with an error. Facts meet actions by joins that begin with state, so where both are dealt
    by it nothing is shuffled, and actions are neither sorted nor grouped.
    """
    none, c = F.lit(""), F.col
    only = _slots(pre, "state").groupBy("state", "predicate", "subject", "object").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("scope").alias("scope")).where("n = 1")
    rows = actions
    for role, predicate, subject, other in (("count", "COUNT", "category", None), ("new", "COUNT", "new_category", None), ("there", "EXISTS_IN_WORLD", "target", None), ("relation", None, "target", "anchor")):
        found = only.where(c("predicate") == predicate) if predicate else only
        found = found.where(c("object") == none) if other is None else found
        keys = {"state": "state", "subject": subject} | ({"predicate": "pre_predicate"} if predicate is None else {}) | ({"object": other} if other else {})
        found = found.select(*[c(k).alias(f"_{role}_{k}") for k in keys], F.struct("value", "scope", F.lit(True).alias("found")).alias(f"_{role}"))
        met = [c(mine) == c(f"_{role}_{k}") for k, mine in keys.items()]
        rows = rows.join(found.hint("shuffle_hash"), met, "left").drop(*[f"_{role}_{k}" for k in keys])

    def fact(predicate: Column | str, subject: Column, value: Column | int | None = None, other: Column | None = None, scope: Column | None = None) -> Column:
        parts = {"predicate": F.lit(predicate), "subject": subject, "object": none if other is None else other, "scope": F.lit("question_local") if scope is None else scope, "value": F.lit(value)}
        return F.struct(*[v.cast("bigint" if k == "value" else "string").alias(k) for k, v in parts.items()])

    counted = lambda kind, role, by: fact("COUNT", c(kind), c(f"_{role}.value") + by, None, c(f"_{role}.scope"))
    exists_now, some = c("_there.value") == 1, c("_count.value") >= 1
    named = (F.coalesce("target", none) != "") & (F.coalesce("new_entity", none) != "")
    gone, come, other = fact("EXISTS_IN_WORLD", c("target"), 0), fact("EXISTS_IN_WORLD", c("new_entity"), 1), fact("SAME_INSTANCE", c("new_entity"), 0, c("target"))
    turned = F.lit(None).cast("string")
    for a, b in INVERSE.items():
        if a not in ("BEFORE", "AFTER"):
            turned = F.when(c("pre_predicate") == a, b).otherwise(turned)
    moved = c("family").isin("MOVE_TO_OPPOSITE_SIDE", "SWAP_POSITIONS")
    rules = {
        "REMOVE_AND_RECOUNT": (exists_now & some, [counted("category", "count", -1), gone]),
        "ADD_AND_RECOUNT": (c("_count.found") & (c("quantity") == 1) & (F.coalesce("new_entity", none) != ""), [counted("category", "count", 1), come]),
        "REPLACE_AND_RECOUNT": (named & (c("category") != c("new_category")) & some & c("_new.found") & exists_now, [counted("category", "count", -1), counted("new_category", "new", 1), gone, come, other]),
        "REPLACEMENT_IDENTITY": (named & exists_now, [gone, come, other]),
    }
    post, error = F.when(moved & c("_relation.found") & turned.isNotNull(), F.array(fact(turned, c("target"), None, c("anchor")))), F.when(~F.coalesce(c("family").isin(*rules) | moved, F.lit(False)), "REJECT_UNAUTHORIZED_RULE")
    for name, (holds, facts) in rules.items():
        post = post.when((c("family") == name) & F.coalesce(holds, F.lit(False)), F.array(*facts))
    kept = [k for k in actions.columns if k != "action_id"] if "*" in more else list(more)
    out = rows.select("action_id", *kept, error.alias("_wrong"), post.alias("_post"))
    return out.select("action_id", *kept, F.coalesce("_wrong", F.when(c("_post").isNull(), "REJECT_TRANSITION_PRECONDITION_FAIL")).alias("error"), F.coalesce("_post", F.array().cast(FACT)).alias("post"))


def compared(executed_: DataFrame, adds: DataFrame, checked_: DataFrame) -> DataFrame:
    """(action_id, errors, error, differing, agree): both sides of each action, and in how many slots their facts differ. They agree if both have no error and no slot differs."""
    key = _keys(executed_, adds, checked_)
    a = _slots(adds, *key).select(*key, *SLOT, F.col("value").alias("_a"), F.lit(True).alias("_in_a"))
    b = checked_.select(*key, F.explode("post").alias("f")).select(*key, "f.*").withColumnRenamed("value", "_b").withColumn("_in_b", F.lit(True))
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    # the parts of a full join, since none knows how its rows lie
    only = b.join(a.select(*key, *SLOT), [*key, *SLOT], "left_anti").select(*key, F.lit(True).alias("_differs"))
    differing = _all([a.join(b, [*key, *SLOT], "left").select(*key, (~same).alias("_differs")), only]).groupBy(*key).agg(F.count_if("_differs").alias("differing"))
    both = executed_.join(checked_.select(*key, "error"), key).join(differing, key, "left").withColumn("differing", F.coalesce("differing", F.lit(0)))
    return both.withColumn("agree", (F.size("errors") == 0) & F.col("error").isNull() & (F.col("differing") == 0))


def successors(passed: DataFrame, pre: DataFrame, deletes: DataFrame, adds: DataFrame) -> DataFrame:
    """(action_id, predicate, subject, object, scope, value): the facts after each passed action (action_id, state): those before without the deleted slots, and the added ones."""
    key = _keys(deletes, adds)
    before = passed.select("action_id", "state").join(_slots(pre, "state"), "state")
    gone = _slots(deletes, *key).select(*key, *SLOT)
    stay = before.join(gone.hint("shuffle_hash"), [*key, *SLOT], "left_anti").select(*key, *SLOT, "value")
    return _all([stay, _slots(adds, *key).select(*key, *SLOT, "value").join(passed.select(*key), key, "left_semi")])
