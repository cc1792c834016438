"""Proofs of claims from the facts of their worlds, and transitions on fact slots checked two ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import dealt, in_place
from .graph import INVERSE, TRANSITIVE, inverse_of

FACT = "struct<predicate:string,subject:string,object:string,scope:string,value:bigint>"
#: A relation and what holds after its subject goes to the other side.
OPPOSITE = {"LEFT_OF": "RIGHT_OF", "RIGHT_OF": "LEFT_OF", "ABOVE": "BELOW", "BELOW": "ABOVE", "FRONT_OF": "BEHIND", "BEHIND": "FRONT_OF"}


RULES = "rule_id string, claim_predicate string, side string, hops int, fact_predicate string, swapped boolean, polarity string, value string, claim_positive boolean"


def _standard() -> list[tuple]:
    rows = [("STATED", "*", "support", 1, "*", False, "SAME", "SAME", False), ("OPPOSITE_POLARITY", "*", "refute", 1, "*", False, "OPPOSITE", "SAME", False), ("OTHER_COUNT", "COUNT", "refute", 1, "COUNT", False, "POSITIVE", "OTHER", True)]
    for a, b in INVERSE.items():
        rows += [("INVERSE", a, "support", 1, b, True, "SAME", "SAME", False), ("ASYMMETRY", a, "refute", 1, a, True, "POSITIVE", "ANY", False), ("EXCLUSION", a, "refute", 1, b, False, "POSITIVE", "ANY", True)]
    for a in TRANSITIVE:
        name = "STRICT_ORDER_TRANSITIVITY" if a in ("BEFORE", "AFTER") else "AUTHORIZED_DIRECTION_TRANSITIVITY"
        rows += [(name, a, "support", 2, a, False, "POSITIVE", "ANY", True), (name, a, "refute", 2, a, True, "POSITIVE", "ANY", True)]
    return rows


#: The ids of the standard rules.
RULE_IDS = sorted({row[0] for row in _standard()})


def standard_rules(spark: SparkSession) -> DataFrame:
    """The table of rules: which facts support or refute a claim of a predicate (``*``: of any).

    side; hops: a fact that matches (1), or the only chain of two (2); fact_predicate (``*``: the claim's); swapped: the fact's
    ends are the claim's turned round; polarity of the fact: SAME as the claim's, OPPOSITE or POSITIVE; its value: SAME,
    OTHER or ANY; claim_positive: for positive claims only. Any table of this form will do.
    """
    return spark.createDataFrame(_standard(), RULES)


def _fits(fact_context: str, claim_context: str) -> Column:
    """Whether a fact's context says all that the claim's does; a null claim context asks for nothing."""
    asked = F.coalesce(F.map_entries(claim_context), F.array())
    return F.forall(asked, lambda e: F.coalesce(F.element_at(F.col(fact_context), e["key"]).eqNullSafe(e["value"]), F.lit(False)))


def matches(claims: DataFrame, facts: DataFrame, rules: DataFrame, authorised: DataFrame | None = None) -> DataFrame:
    """(world, claim_id, side, rule_id, hops, premises): each fact, and each chain of two, that some rule sets against a claim.

    claims: claim_id, world, predicate, subject, object, value, polarity, context (map or null). facts: fact_id and the same. ``authorised``
    (world, rule_id): the rules that hold in a world; None: all do. Chains of one rule that compete are all listed. A chain
    starts from the claim's subject, so a node between many others costs no more than the claims about it; facts of the inverse predicate are turned round.
    Everything meets by world first, so what is dealt by it stays there (``tables.in_place``); rules are few and go to all.
    """
    asked = claims.select("claim_id", "world", "predicate", "subject", "object", F.col("value").alias("_value"), F.col("polarity").alias("_polarity"), F.col("context").alias("_context"))
    ways = asked.withColumn("claim_predicate", F.explode(F.array("predicate", F.lit("*")))).join(F.broadcast(rules), "claim_predicate").where(~F.col("claim_positive") | (F.col("_polarity") == "positive"))
    if authorised is not None:
        ways = ways.join(authorised.select("world", "rule_id").distinct(), ["world", "rule_id"], "left_semi")
    turn = lambda a, b: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))
    wanted = F.when(F.col("fact_predicate") == "*", F.col("predicate")).otherwise(F.col("fact_predicate"))
    ways = ways.select("claim_id", "side", "rule_id", "hops", F.col("world").alias("w"), wanted.alias("p"), turn("subject", "object").alias("s"), turn("object", "subject").alias("o"), "_value", "_polarity", "_context", F.col("polarity"), F.col("value").alias("of_value"))
    own = facts.select("fact_id", "world", "predicate", "subject", "object", F.col("value").alias("f_value"), F.col("polarity").alias("f_polarity"), F.col("context").alias("f_context"))
    same_value = F.col("f_value").eqNullSafe(F.col("_value"))
    polarity = F.when(F.col("polarity") == "SAME", F.col("f_polarity") == F.col("_polarity")).when(F.col("polarity") == "OPPOSITE", F.col("f_polarity") != F.col("_polarity")).otherwise(F.col("f_polarity") == "positive")
    value = F.when(F.col("of_value") == "SAME", same_value).when(F.col("of_value") == "OTHER", ~same_value).otherwise(True)
    met = (F.col("w") == F.col("world")) & (F.col("p") == F.col("predicate")) & (F.col("s") == F.col("subject")) & F.col("o").eqNullSafe(F.col("object"))
    one = ways.where("hops = 1").join(own, met).where(polarity & value & _fits("f_context", "_context"))
    # under a new name each side's world is the same to the planner, and the union stays dealt by it
    singles = one.select(F.col("w").alias("_world"), "claim_id", "side", "rule_id", "hops", F.array("fact_id").alias("premises"))

    ends = F.array(F.struct("predicate", "subject", "object"), F.struct(inverse_of(F.col("predicate")).alias("predicate"), F.col("object").alias("subject"), F.col("subject").alias("object")))
    edges = own.where("f_polarity = 'positive' and subject is not null and object is not null").select("fact_id", F.col("world").alias("w"), "f_context", F.explode(ends).alias("e")).where("e.predicate is not null")
    first = edges.select("w", F.col("e.predicate").alias("p"), F.col("e.subject").alias("s"), F.col("e.object").alias("middle"), F.col("fact_id").alias("one"), F.col("f_context").alias("one_context"))
    second = edges.select("w", F.col("e.predicate").alias("p"), F.col("e.subject").alias("middle"), F.col("e.object").alias("o"), F.col("fact_id").alias("two"), F.col("f_context").alias("two_context"))
    two = ways.where("hops = 2 and s <> o").join(first, ["w", "p", "s"]).where(_fits("one_context", "_context")).join(second, ["w", "p", "middle", "o"]).where(_fits("two_context", "_context"))
    return singles.unionByName(two.select(F.col("w").alias("_world"), "claim_id", "side", "rule_id", "hops", F.array("one", "two").alias("premises"))).withColumnRenamed("_world", "world")


def verified(claims: DataFrame, facts: DataFrame, rules: DataFrame, authorised: DataFrame | None = None, expected: str = "expected") -> DataFrame:
    """claim_id, label, level, evidence (fact ids), rules (ids of those that prove it) and codes, all sorted, of each claim.

    The inputs are those of ``matches``; claims may have an expected label too. A fact that matches is a proof; chains of a rule and side are one if there is
    just one of them. SUPPORTED or CONTRADICTORY need proofs of that side alone. Level: L2 with a chain, else L3 for BEFORE, else L1; null where UNKNOWN.

    Codes: VERIFIER_DISAGREEMENT where the label isn't the expected one; CO_TRUTH_POSSIBLE where both sides have proofs; UNPROVIDED_PREMISE
    without evidence; MINIMALITY_ABLATION_FAIL where the claim is decided (either way) when one fact of its evidence is away.
    The last is counted, not tried: without a fact a side keeps the matching facts less that one, and a chain exactly where one chain
    is left of all that compete, be it that a single one doesn't need the fact or that the others did.

    Repeated claim ids raise ValueError, since evidence would mix. Claims without any match are UNKNOWN.
    """
    if claims.groupBy("claim_id").count().where("count > 1").limit(1).count():
        raise ValueError("REPEATED_CLAIM_ID")
    with in_place(claims.sparkSession):
        found = dealt(matches(claims, facts, rules, authorised), "world", "matches")
    single = found.where("hops = 1").select("world", "claim_id", "side", "rule_id", F.get("premises", F.lit(0)).alias("fact_id"))
    key = ["world", "claim_id"]
    chain_key = [*key, "side", "rule_id"]
    chains = found.where("hops = 2").groupBy(*chain_key).agg(F.count("*").alias("n"), F.first("premises").alias("premises"))
    own = lambda df: df.withColumnRenamed("world", "_world")
    proofs = own(single.withColumn("hops", F.lit(1))).unionByName(own(chains.where("n = 1").select(*chain_key, F.explode("premises").alias("fact_id"), F.lit(2).alias("hops")))).withColumnRenamed("_world", "world")
    each = proofs.groupBy(*key).agg(F.bool_or(F.col("side") == "support").alias("s"), F.bool_or(F.col("side") == "refute").alias("r"), F.max("hops").alias("hops"), F.sort_array(F.collect_set("fact_id")).alias("evidence"), F.sort_array(F.collect_set("rule_id")).alias("rules"))

    used = proofs.select(*key, "fact_id").distinct()
    facts_of_side = single.select(*key, "side", "fact_id").distinct()
    stay = facts_of_side.groupBy(*key).agg(*[F.count_if(F.col("side") == side).alias(side) for side in ("support", "refute")])
    gone = facts_of_side.groupBy(*key, "fact_id").agg(*[F.count_if(F.col("side") == side).alias(f"{side}_gone") for side in ("support", "refute")])
    through = found.where("hops = 2").select(*chain_key, F.explode(F.array_distinct("premises")).alias("fact_id")).groupBy(*chain_key, "fact_id").agg(F.count("*").alias("m"))
    left = used.join(chains.drop("premises"), key).join(through, [*chain_key, "fact_id"], "left").where(F.col("n") - F.coalesce("m", F.lit(0)) == 1)
    left = left.groupBy(*key, "fact_id").agg(*[F.count_if(F.col("side") == side).alias(f"{side}_chains") for side in ("support", "refute")])
    after = used.join(stay, key, "left").join(gone, [*key, "fact_id"], "left").join(left, [*key, "fact_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    still = {side: zero(side) - zero(f"{side}_gone") + zero(f"{side}_chains") > 0 for side in ("support", "refute")}
    loose = after.where(still["support"] != still["refute"]).select(*key).distinct().withColumn("loose", F.lit(True))

    out = claims.select(*key, "predicate", F.col(expected).alias("_expected") if expected in claims.columns else F.lit(None).alias("_expected")).join(each, key, "left").join(loose, key, "left")
    s, r = F.coalesce("s", F.lit(False)), F.coalesce("r", F.lit(False))
    label = F.when(s & ~r, "SUPPORTED").when(r & ~s, "CONTRADICTORY").otherwise("UNKNOWN")
    codes = F.array_compact(F.array(
        F.when(s & r, "CO_TRUTH_POSSIBLE"), F.when(F.col("loose"), "MINIMALITY_ABLATION_FAIL"), F.when(~s & ~r, "UNPROVIDED_PREMISE"), F.when(label != F.col("_expected"), "VERIFIER_DISAGREEMENT"),
    ))
    level = F.when(s != r, F.when(F.col("hops") == 2, "L2").when(F.col("predicate") == "BEFORE", "L3").otherwise("L1"))
    ids, none = facts.schema["fact_id"].dataType.simpleString(), F.array()
    return out.select("claim_id", label.alias("label"), level.alias("level"), F.coalesce("evidence", none.cast(f"array<{ids}>")).alias("evidence"), F.coalesce("rules", none.cast("array<string>")).alias("rules"), codes.alias("codes"))


def fact(predicate: str | Column, subject: Column, value: Column | None = None, other: Column | None = None, scope: str = "scene") -> Column:
    """A fact as a struct; what is left out is null."""
    parts = {"predicate": F.lit(predicate), "subject": subject, "object": F.lit(None) if other is None else other, "scope": F.lit(scope), "value": F.lit(None) if value is None else value}
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(FACT)


def slot(f: Column) -> Column:
    """What a fact is about: predicate, subject, object and scope, as one text."""
    return F.concat_ws("|", f["predicate"], f["subject"], F.coalesce(f["object"], F.lit("")), f["scope"])


def _slots(facts: Column) -> Column:
    return F.transform(facts, slot)


def _outcome(errors: Column, post: Column) -> Column:
    placed = F.sort_array(F.transform(post, lambda f, k: F.struct(slot(f).alias("slot"), k.alias("k"), f.alias("fact"))))
    return let(errors, lambda e: F.struct(F.when(F.size(e) == 0, "PASS").otherwise("FAIL").alias("status"), e.alias("errors"), F.transform(placed, lambda x: x["fact"]).alias("post")))


def apply_delta(pre: Column, delete: Column, add: Column, allowed: Column) -> Column:
    """The general engine: slots to delete must be there, added facts must be allowed and distinct, counts not negative.

    pre, add: arrays of facts; delete, allowed: arrays of slots. Returns struct(status, errors, post).
    """
    twice = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    negative = F.exists(add, lambda f: (f["predicate"] == "COUNT") & (F.coalesce(f["value"], F.lit(-1)) < 0))
    errors = lambda s: F.array_compact(F.array(
        F.when(twice(s["pre"]), "DUPLICATE_PRE_FACT_SLOT"), F.when(F.size(F.array_except(s["delete"], s["pre"])) > 0, "DELETE_FACT_NOT_IN_PRESTATE"), F.when(twice(s["delete"]), "DUPLICATE_DELETE_FACT_SLOT"),
        F.when(negative, "INVALID_POST_COUNT"), F.when(twice(s["add"]), "DUPLICATE_POST_FACT_SLOT"), F.when(F.size(F.array_except(s["add"], s["allowed"])) > 0, "UNLISTED_POST_FACT_UPDATE"),
    ))
    slots = F.struct(_slots(pre).alias("pre"), delete.alias("delete"), _slots(add).alias("add"), allowed.alias("allowed"))
    return _outcome(let(slots, errors), add)


def check_family(pre: Column, family: Column, target: Column, category: Column, anchor: Column, relation: Column) -> Column:
    """The checker with a rule per family, which looks at the state before and the parameters only: REMOVE and ADD recount, MOVE turns a relation."""

    def only(predicate: Column | str, subject: Column, other: Column | None = None) -> Column:
        found = F.filter(pre, lambda f: (f["predicate"] == predicate) & (f["subject"] == subject) & (F.coalesce(f["object"], F.lit("")) == (F.lit("") if other is None else other)))
        return let(found, lambda fs: F.when(F.size(fs) == 1, F.get(fs, F.lit(0))))

    opposite = F.lit(None).cast("string")
    for a, b in OPPOSITE.items():
        opposite = F.when(relation == a, b).otherwise(opposite)

    def counted(count: Column) -> Column:
        removed = F.when((count >= 1) & (only("EXISTS_IN_WORLD", target)["value"] == 1), F.array(fact("COUNT", category, count - 1), fact("EXISTS_IN_WORLD", target, F.lit(0))))
        added = F.when(count.isNotNull(), F.array(fact("COUNT", category, count + 1), fact("EXISTS_IN_WORLD", F.concat(F.lit("new-"), target), F.lit(1))))
        return F.when(family == "REMOVE", removed).when(family == "ADD", added)

    moved = F.when(only(relation, target, anchor).isNotNull() & opposite.isNotNull(), F.array(fact(opposite, target, None, anchor)))
    known = F.coalesce(family.isin("REMOVE", "ADD", "MOVE"), F.lit(False))
    post = F.when(family.isin("REMOVE", "ADD"), let(only("COUNT", category)["value"], counted)).when(family == "MOVE", moved)

    def judged(after: Column) -> Column:
        errors = F.when(~known, F.array(F.lit("REJECT_UNAUTHORIZED_RULE"))).when(after.isNull(), F.array(F.lit("REJECT_TRANSITION_PRECONDITION_FAIL"))).otherwise(F.array().cast("array<string>"))
        return _outcome(errors, F.coalesce(after, F.array().cast(f"array<{FACT}>")))

    return let(post, judged)


def folded(actions: DataFrame, key: str, order: list[str], bucket: Column, start: int) -> DataFrame:
    """(key, actions, final_count, status): signed steps of each key in order from a count of ``start``.

    actions: key, the order columns and step (+1, -1 or 0). A step below 0 makes the sequence fail (UNDERFLOW, no
    count), as it would one by one. Sums and least running sums are made per ``bucket``, a rising function of the order, and the buckets of
    a key are then joined in order, so a key with a great share of all rows is never one task's rows.
    """
    from pyspark.sql import Window

    rows = actions.withColumn("_bucket", bucket)
    running = F.sum("step").over(Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.select(key, "_bucket", "step", running.alias("run")).groupBy(key, "_bucket").agg(F.count("*").alias("n"), F.sum("step").alias("total"), F.min("run").alias("least"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.select(key, "n", "total", (before + F.col("least")).alias("least")).groupBy(key).agg(F.sum("n").alias("actions"), F.sum("total").alias("total"), F.min("least").alias("least"))
    fails = F.col("least") + start < 0
    return out.select(key, "actions", F.when(~fails, F.col("total") + start).alias("final_count"), F.when(fails, "UNDERFLOW").otherwise("VALID").alias("status"))
