"""Model answers of many shapes, worded from events: recovered members, typed values, actions, judged criteria, run states."""

from pyspark.sql import functions as F

from ..functions import answers as a
from ..operators import metrics as m
from ..operators.metrics import ratio
from .registry import query

#: (answer, whether it was cut off, the members that count as key=JSON joined by commas); %d is the event's id.
SHAPES = [
    ('{"status": "VALUE", "value": %d}', False, 'status="VALUE",value=%d'), ('{"status": "VALUE", "value": %d', True, 'status="VALUE"'), ('{"status": "VALUE", "value": %d ', True, 'status="VALUE",value=%d'),
    ('{"status": "VALUE", "value": "left"', True, 'status="VALUE",value="left"'), ('{"status": "VALUE", "value": "le', True, 'status="VALUE"'), ('{"status": "VALUE", "value": "Left"', False, ""), ('{"status": "UNDETERMINED", "value": null}', False, 'status="UNDETERMINED",value=null'),
    ('{"status": "VALUE", "status": "VALUE"}', False, ""), ('{"status": "VALUE", "value": 1, "stat', True, 'status="VALUE",value=1'), ('{"status": "VALUE", "status"', True, ""), ('{"status": "VALUE"} and %d', True, ""),
    ('```json\n{"status": "VALUE", "value": " Above "}\n```', False, 'status="VALUE",value=" Above "'), ('{"S0": {"status": "VALUE", "value": %d}, "S1": {"sta', True, 'S0.status="VALUE",S0.value=%d,S0={"status": "VALUE", "value": %d}'),
    ('{"status": "VALUE", "value": -3}', False, 'status="VALUE",value=-3'), ('{"status": "VALUE", "value": "%d"}', False, 'status="VALUE",value="%d"'), ('{"a": [1, {"b": "},"}], "c": tru', True, 'a=[1, {"b": "},"}]'), ('[%d]', False, ""), ("", True, ""), ('{"status": "VALUE" "value": 1', True, ""),
]


def _sql(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, key="event_id"):
    place = (1 + F.col(key) % len(values)).cast("int")
    return F.replace(F.element_at(F.array(*map(F.lit, values)), place), F.lit("%d"), F.col(key).cast("string"))


def _members(t):
    cut = F.element_at(F.array(*[F.lit(c) for _, c, _ in SHAPES]), (1 + F.col("event_id") % len(SHAPES)).cast("int"))
    return t("events").select("event_id", a.observed_members(_pick([x for x, _, _ in SHAPES]), cut).alias("m"))


@query(f"select event_id, replace(({_sql([w for _, _, w in SHAPES])})[1 + event_id % {len(SHAPES)}], '%d', event_id::varchar) as members from events")
def observed_members(t):
    """What is surely stated by whole, cut, fenced and malformed objects."""
    entries = F.array_sort(F.transform(F.map_keys("m"), lambda k: F.concat(k, F.lit("="), F.element_at(F.col("m"), k))))
    return _members(t).select("event_id", F.array_join(entries, ",").alias("members"))


COUNTS = {0: "%d", 2: "%d", 8: "1"}
NAMES = {3: "LEFT_OF", 11: "ABOVE"}


def _status(values: dict) -> list:
    return ["VALUE" if k in values else "UNDETERMINED" if k == 6 else "INVALID" for k in range(len(SHAPES))]


@query(f"""with k as (select event_id, 1 + event_id % {len(SHAPES)} as k from events)
select event_id, ({_sql(_status(COUNTS))})[k] as count_status, replace(({_sql([COUNTS.get(k) for k in range(len(SHAPES))])})[k], '%d', event_id::varchar) as count_value,
  ({_sql(_status(NAMES))})[k] as name_status, ({_sql([NAMES.get(k) for k in range(len(SHAPES))])})[k] as name_value, ({_sql(["VALUE" if k == 12 else "INVALID" for k in range(len(SHAPES))])})[k] as state_status from k""")
def typed_values(t):
    """Values in their domain: whole numbers, names of relations, and the number of an inner state."""
    number, names = F.lit(None).cast("array<string>"), F.array(*map(F.lit, ["LEFT_OF", "RIGHT_OF", "ABOVE"]))
    said = F.col("m")
    out = _members(t).select("event_id", a.typed_value(said, number).alias("c"), a.typed_value(said, names).alias("n"), a.typed_value(said, number, "S0.")["status"].alias("state_status"))
    return out.select("event_id", F.col("c.status").alias("count_status"), F.col("c.value").alias("count_value"), F.col("n.status").alias("name_status"), F.col("n.value").alias("name_value"), "state_status")


#: (answer, status, operation, target and scope right); the gold action removes a red chair in the kitchen.
ACTIONS = [
    ('{"status": "RESOLVED", "operation": "REMOVE", "target": "the Red  chair!", "scope": "kitchen"}', "VALID", True, True, True), ('{"status": "RESOLVED", "operation": "REMOVE", "target": "red armchair", "scope": "kitchen"}', "VALID", True, False, True),
    ('{"status": "UNDETERMINED", "operation": "REMOVE", "target": "red chair", "scope": "kitchen"}', "UNDETERMINED", False, False, False), ('{"status": "RESOLVED", "operation": "PAINT", "target": "red chair", "scope": "hall"}', "INVALID", False, True, False),
    ('{"operation": "REMOVE"}', "INVALID", True, False, False), ("none", "INVALID", False, False, False), ('{"status": "RESOLVED", "operation": "ADD", "target": "chair (red)", "scope": "kitchen"}', "VALID", False, True, True),
]


@query(f"""with k as (select event_id, 1 + event_id % {len(ACTIONS)} as k from events) select event_id, ({_sql([x[1] for x in ACTIONS])})[k] as status, ({[x[2] for x in ACTIONS]})[k] as operation_correct, ({[x[3] for x in ACTIONS]})[k] as target_correct,
  ({[x[4] for x in ACTIONS]})[k] as scope_correct, k = 1 as correct from k""")
def action_scores(t):
    members = a.observed_members(_pick([x[0] for x in ACTIONS]), F.lit(False))
    score = a.action_score(F.col("m"), F.lit("REMOVE"), F.array(F.lit("red"), F.lit("chair")), F.lit("kitchen"))
    return t("events").select("event_id", members.alias("m")).select("event_id", F.inline(F.array(score)))


@query("""with j as (select conv_id, turn, turn % 3 as k, text from conversations where role is not null), v as (select conv_id, case k when 0 then length(regexp_replace(substr(text, 3, 40), '\\s+', '', 'g')) between 2 and 160 when 1 then true else false end as ok, k = 0 as met from j)
select conv_id, count(*) as criteria, count(*) filter (where not coalesce(ok, false)) as invalid, case when bool_and(coalesce(ok, false)) then 100.0 * count(*) filter (where met) / count(*) end as points from v group by 1""")
def rubric_points(t):
    """Points of conversations: the share of met criteria; none where a judgement's evidence isn't a quotation."""
    k = F.col("turn") % 3
    evidence = F.when(k == 0, F.substring("text", 3, 40)).when(k == 1, "").otherwise(F.concat(F.lit("\u0001"), F.col("text")))
    met = k != 1
    j = t("conversations").where("role is not null").select("conv_id", (k == 0).alias("met"), a.judgement_valid(met, evidence, F.col("text")).alias("ok"))
    out = j.groupBy("conv_id").agg(F.count("*").alias("criteria"), F.count_if(~F.col("ok")).alias("invalid"), F.bool_and("ok").alias("_ok"), F.count_if("met").alias("_met"))
    return out.select("conv_id", "criteria", "invalid", F.when(F.col("_ok"), ratio(100 * F.col("_met"), F.col("criteria"))).alias("points"))


@query("""with r as (select user_id, case when event_id % 5 = 0 then 'NOT_APPLICABLE' when event_id % 7 = 0 then 'NOT_RUN' else 'RETURNED' end as state, case when event_id % 3 = 0 then null else value > 10 end as correct from events)
select user_id, count(*) filter (where state <> 'NOT_APPLICABLE') as applicable, count(*) filter (where state = 'NOT_RUN') as not_run, count(*) filter (where state = 'RETURNED' and correct is null) as unscored, count(*) filter (where state = 'RETURNED' and correct) as correct,
  case when count(correct) filter (where state = 'RETURNED') > 0 then count(*) filter (where state = 'RETURNED' and correct) / count(correct) filter (where state = 'RETURNED') end as accuracy from r group by 1""")
def state_scores(t):
    """Scores by run state: what wasn't run or has no score isn't wrong, what doesn't apply isn't counted."""
    k = F.col("event_id")
    state = F.when(k % 5 == 0, "NOT_APPLICABLE").when(k % 7 == 0, "NOT_RUN").otherwise("RETURNED")
    r = t("events").select("user_id", state.alias("state"), F.when(k % 3 != 0, F.col("value") > 10).alias("correct"))
    back = F.col("state") == "RETURNED"
    scored, right = F.count(F.when(back, F.col("correct"))), F.count_if(back & F.col("correct"))
    return r.groupBy("user_id").agg(
        F.count_if(F.col("state") != "NOT_APPLICABLE").alias("applicable"), F.count_if(F.col("state") == "NOT_RUN").alias("not_run"), F.count_if(back & F.col("correct").isNull()).alias("unscored"), right.alias("correct"), ratio(right, scored).alias("accuracy")
    )


@query("""select o_custkey as pair_id, bool_and(o_orderstatus = case when o_totalprice > 200000 then 'F' else 'O' end) as correct from orders where o_orderstatus in ('F', 'O') group by 1 having count(distinct o_orderstatus) = 2""")
def pair_accuracy_strict(t):
    """Pairs must have both labels: one with a single label raises. Here those are taken out before."""
    rows = t("orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_custkey").alias("pair_id"), F.col("o_orderstatus").alias("gold"), F.when(F.col("o_totalprice") > 200000, "F").otherwise("O").alias("pred"))
    whole = rows.groupBy("pair_id").agg(F.min("gold").alias("a"), F.max("gold").alias("b")).where("a <> b")
    return m.strict_pairs(rows.join(whole, "pair_id", "left_semi"), 2)
