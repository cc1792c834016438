"""Questions about directions, worded from line items; some of each kind are malformed."""

from pyspark.sql import functions as F

from ..functions import directions as d
from .registry import query


def _item(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity").cast("int").alias("q"))


def _said(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _flat(rows, *keys):
    """One row per fact, or the reject code of a row without any; the adapter runs once a row."""
    once = rows.select(*keys, F.inline(F.array("found")))
    return once.select(*keys, "reject_code", "frame", F.inline_outer("facts"))


KEYS = "l_orderkey, l_linenumber, l_suppkey, l_partkey"
EMPTY = "null as frame, null as subject, null as predicate, null as object, null::bigint as value, null as polarity"


@query(f"""with i as (select {KEYS}, l_quantity::int as q from lineitem), c as (select *, case when q % 11 = 0 then 'MISSING_REFERENCE_FRAME' when q % 7 = 0 then 'SOURCE_RECONSTRUCTION_FAIL' when q % 5 = 0 then 'UNSUPPORTED_OPERATOR' when q % 3 = 0 then 'SOURCE_RECONSTRUCTION_FAIL' end as code from i)
select {KEYS}, code as reject_code, case when code is null then 'agent_at:sofa_' || l_linenumber || ':facing:shelf_' || l_partkey end as frame, case when code is null then 'mention:box_' || l_suppkey end as subject,
  case when code is null then case when q % 2 = 0 then 'LEFT_OF' else 'RIGHT_OF' end end as predicate, case when code is null then 'mention:shelf_' || l_partkey end as object, null::bigint as value, case when code is null then 'positive' end as polarity from c""")
def facing_directions(t):
    """Left or right as seen by someone who faces the reference."""
    q = F.col("q")
    faced = F.when(q % 11 == 0, "door").otherwise(_said("Shelf ", F.col("l_partkey")))
    question = _said("If I am standing by the Sofa ", F.col("l_linenumber"), " and facing the ", faced, ", is the Box ", F.col("l_suppkey"), " to the left or the right of the shelf ", F.col("l_partkey"), "?")
    third = F.when(q % 7 == 0, "C) behind").when(q % 5 == 0, "C. behind").when(q % 3 == 0, "C. LEFT ").otherwise("C. back")
    letter = F.when((q % 5 == 0) | (q % 3 == 0), "C").when(q % 2 == 0, "A").otherwise("B")
    rows = _item(t).withColumn("found", d.facing(question, F.array(F.lit("A. left"), F.lit(" B.  Right "), third), letter))
    return _flat(rows, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query(f"""with i as (select {KEYS}, l_quantity::int as q, l_quantity::int % 6 as k from lineitem), named as (select *, l_orderkey || '_' || l_linenumber as item from i)
select {KEYS}, case k when 2 then 'NUMERIC_DEPENDENCY' when 3 then 'UNSUPPORTED_OPERATOR' when 4 then 'MALFORMED_SOURCE_OPTIONS' when 5 then 'SOURCE_RECONSTRUCTION_FAIL' end as reject_code,
  case k when 0 then 'source_question_declared_perspective' when 1 then 'source_question_declared' end as frame, case k when 0 then 'query_target:' || item when 1 then 'query_set:' || item end as subject,
  case k when 0 then unnest(case when k = 0 then ['FRONT_OF', 'LEFT_OF'] else [null] end) when 1 then 'COUNT' end as predicate, case k when 0 then 'perspective_reference:' || item end as object, case k when 1 then q end::bigint as value, case when k < 2 then 'positive' end as polarity from named""")
def perspective_directions(t):
    """Options by place: directions from a perspective, counts, and rows of unfit tasks, places and options."""
    k, q = F.col("q") % 6, F.col("q").cast("string")
    options = F.when(k == 0, F.array(F.lit("right"), F.lit("front-left forward"))).when(k == 1, F.array(F.lit("none"), q)).when(k == 5, F.array(q, q)).otherwise(F.array(F.lit("red"), F.lit("a few")))
    question = F.when(k == 0, "From the driver's perspective, where is it?").when(k.isin(1, 5), "How many of them are there?").otherwise("What is it?")
    task, subtask = F.when(k == 0, "Perspective_Taking").otherwise("Dynamic_Reasoning"), F.when(k == 2, "Motion_Analysis").otherwise("Other")
    item = F.concat_ws("_", "l_orderkey", "l_linenumber")
    rows = _item(t).withColumn("found", d.perspective(item, task, subtask, question, options, F.when(k == 4, 2).otherwise(1)))
    return _flat(rows, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query(f"""with i as (select {KEYS}, l_quantity::int as q, l_quantity::int % 7 as k from lineitem), named as (select *, l_orderkey || '_' || l_linenumber as item from i),
f as (select *, case k when 0 then ['COUNT'] when 1 then ['BEHIND', 'RIGHT_OF'] when 2 then ['ABOVE'] else [null] end as p from named)
select {KEYS}, case k when 3 then 'METRIC_OR_COMMONSENSE_DEPENDENCY' when 4 then 'AMBIGUOUS_ENTITY_OR_UNSUPPORTED_RELATION' when 5 then 'MALFORMED_SOURCE_RECORD' when 6 then 'SOURCE_RECONSTRUCTION_FAIL' end as reject_code,
  case when k < 3 then 'source_declared_post_intervention' end as frame, case when k = 0 then 'query_set:' || item when k < 3 then 'query_subject:' || item end as subject, unnest(p) as predicate,
  case when k in (1, 2) then 'query_reference:' || item end as object, case when k = 0 then q end::bigint as value, case when k < 3 then 'positive' end as polarity from f""")
def after_change_answers(t):
    """Counts and directions in the state after a change."""
    k, q = F.col("q") % 7, F.col("q").cast("string")
    answer = F.when(k == 0, q).when(k == 1, "Back right").when(k == 2, "higher").when(k == 3, "2 metres").when(k == 4, "left").when(k == 6, F.concat(F.lit("0"), q)).otherwise(" ")
    question = F.when(k.isin(0, 6), "What is the  Total number of chairs?").when(k == 1, "Where is the lamp relative to the bed?").when(k == 2, "Is it higher or lower now?").otherwise("Where is it?")
    kind = F.when(k == 3, "Scale").otherwise("Direction")
    rows = _item(t).withColumn("found", d.after_change(F.concat_ws("_", "l_orderkey", "l_linenumber"), kind, question, answer))
    return _flat(rows, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query(f"""with i as (select {KEYS}, l_quantity::int as q, l_quantity::int % 6 as k, l_suppkey % 2 = 0 as observer from lineitem),
f as (select *, case when k = 0 then ['LEFT_OF', 'ABOVE'] when k = 1 and observer then ['RIGHT_OF', 'BEHIND'] when k = 1 then ['RIGHT_OF'] when k = 2 then ['BELOW'] else [null] end as p from i)
select {KEYS}, case when k > 2 then 'SOURCE_RECONSTRUCTION_FAIL' end as reject_code, case when k < 3 then 'source_question_declared_perspective' end as frame, case when k < 3 then 'mention:red_bbox_target' end as subject, unnest(p) as predicate,
  case when k < 3 then case when observer then 'mention:observer_primary_view' else 'mention:blue_bbox_target' end end as object, null::bigint as value, case when k < 3 then 'positive' end as polarity from f""")
def coloured_box_relations(t):
    """Relations of marked boxes in prose or as options; relations that exclude each other and shared options are rejected."""
    k = F.col("q") % 6
    answer = F.when(k == 0, "The red one is above and to the LEFT, 2.3 m away.").when(k == 1, "right, behind it").when(k == 2, " b ").when(k == 3, "left or right").when(k == 4, "A").otherwise("leftmost")
    question = F.lit("<image> Where is it?\nA. above, 2 m\nB. below, far\nC. above, 3 m\nD. left")
    rows = _item(t).withColumn("found", d.coloured_boxes(F.col("l_suppkey") % 2 == 0, question, answer))
    return _flat(rows, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
