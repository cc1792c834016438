"""Fact and reasoning queries over orders as worlds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.canon import canonical_json, content_id
from ..operators import graph as g
from ..operators import proofs as p
from ..operators import replay
from ..operators import transitions as tr
from ..operators.joins import join_by_share
from ..sources.tables import dealt, in_place, materialize, spread_by
from .frames import FACTS_SQL, facts
from .registry import query

ID_SQL = """'fact:' || substr(sha256('{"object":' || object || ',"ordinal":' || ordinal || ',"predicate":"' || predicate || '","subject":' || subject || ',"world":' || world || '}'), 1, 24)"""


@query("with " + FACTS_SQL + " select * from facts")
def facts_from_lineitem(t):
    return facts(t)


@query("with " + FACTS_SQL + f" select world, ordinal, {ID_SQL} as fact_id from facts")
def fact_ids(t):
    """Content addresses: a prefix and 24 digits of the SHA-256 of canonical JSON."""
    f = facts(t)
    return f.select("world", "ordinal", content_id("fact", **{c: F.col(c) for c in f.columns}).alias("fact_id"))


@query("""select r_regionkey, '{"a":null,"b":true,"name":' || to_json(r_name)::varchar || '}' as json from region""")
def canonical_nulls(t):
    """Canonical JSON keeps nulls and sorts keys whatever the order they come in."""
    return t("region").select("r_regionkey", canonical_json(name=F.col("r_name"), b=F.lit(True), a=F.lit(None).cast("string")).alias("json"))


@query("with " + FACTS_SQL + f" select world, predicate, subject, object, min({ID_SQL}) as fact_id, count(*) as copies, min(ordinal) as first_ordinal, max(ordinal) as last_ordinal from facts group by world, predicate, subject, object")
def fact_dedup_merge(t):
    return g.merge_duplicates(facts(t))


@query("""select o_custkey as world, count(*) as record_count, list_sort(list(distinct o_orderstatus)) as statuses, min(o_orderkey) as first_record, max(o_orderkey) as last_record, count(distinct o_orderpriority) as priorities from orders group by 1""")
def world_index(t):
    """Records of a world: sorted distinct values and counts."""
    return t("orders").groupBy(F.col("o_custkey").alias("world")).agg(
        F.count("*").alias("record_count"), F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"), F.min("o_orderkey").alias("first_record"), F.max("o_orderkey").alias("last_record"), F.count_distinct("o_orderpriority").alias("priorities")
    )


@query("with " + FACTS_SQL + ", n as (select world, unnest([subject, object]) as node from facts) select distinct world, node, case when node % 3 = 0 then 'CLASS' when node % 3 = 1 then 'EVENT' else 'ENTITY' end as node_type from n")
def graph_nodes(t):
    kind = F.when(F.col("node") % 3 == 0, "CLASS").when(F.col("node") % 3 == 1, "EVENT").otherwise("ENTITY")
    return facts(t).select("world", F.explode(F.array("subject", "object")).alias("node")).distinct().withColumn("node_type", kind)


SIGNED_SQL = """signed as (
  select l_orderkey as world, case when l_linenumber % 2 = 0 then 'BEFORE' else 'AFTER' end as predicate, l_suppkey % 4 as subject, l_partkey % 4 as object,
    case when l_quantity > 10 then 'positive' else 'negative' end as polarity, null::bigint as value from lineitem
  union all
  select l_orderkey, 'COUNT', l_suppkey % 10, null, 'positive', count(*) from lineitem group by l_orderkey, l_suppkey
)"""


def _signed(t):
    rows = t("lineitem")
    before = rows.select(
        F.col("l_orderkey").alias("world"), F.when(F.col("l_linenumber") % 2 == 0, "BEFORE").otherwise("AFTER").alias("predicate"), (F.col("l_suppkey") % 4).alias("subject"), (F.col("l_partkey") % 4).alias("object"),
        F.when(F.col("l_quantity") > 10, "positive").otherwise("negative").alias("polarity"), F.lit(None).cast("bigint").alias("value"),
    )
    counts = rows.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("value"))
    return before.unionByName(counts.select(F.col("l_orderkey").alias("world"), F.lit("COUNT").alias("predicate"), (F.col("l_suppkey") % 10).alias("subject"), F.lit(None).cast("bigint").alias("object"), F.lit("positive").alias("polarity"), "value"))


@query("with " + SIGNED_SQL + """, p as (select world, predicate, subject, object, value from signed group by all having count(distinct polarity) > 1),
pos as (select distinct world, predicate, subject, object from signed where polarity = 'positive'),
x as (select a.* from pos a where a.predicate in ('BEFORE', 'AFTER') and exists (select 1 from pos b where b.world = a.world and b.subject = a.subject and b.object = a.object and b.predicate = case a.predicate when 'BEFORE' then 'AFTER' else 'BEFORE' end)),
c as (select world, subject from signed where predicate = 'COUNT' group by all having count(distinct value) > 1)
select world, 'POLARITY_CONFLICT' as code, count(*) as n from p group by world union all select world, 'EXCLUSIVITY_CONFLICT', count(*) from x group by world union all select world, 'COUNT_CONFLICT', count(*) from c group by world""")
def graph_consistency(t):
    return g.conflicts(_signed(t))


HOP_SQL = """paths as (select a.world, a.predicate, a.subject, b.object, a.object as middle from {e} a join {e} b on a.world = b.world and a.predicate = b.predicate and a.object = b.subject where a.subject <> b.object),
hops as (select world, predicate, subject, object, min(middle) as middle from paths group by world, predicate, subject, object having count(*) = 1)"""


@query("with " + FACTS_SQL + ", " + HOP_SQL.format(e="facts") + " select world, predicate, subject, object, middle from hops h where not exists (select 1 from facts f where f.world = h.world and f.subject = h.subject and f.object = h.object)")
def two_hop_unique_path(t):
    """Transitive conclusions that one path of two facts makes and nothing states."""
    return g.two_hop(facts(t))


MIXED_SQL = FACTS_SQL + ", mixed as (select world, case when ordinal % 2 = 0 then 'AFTER' else 'BEFORE' end as predicate, case when ordinal % 2 = 0 then object else subject end as subject, case when ordinal % 2 = 0 then subject else object end as object from facts), norm as (select world, 'BEFORE' as predicate, case when predicate = 'AFTER' then object else subject end as subject, case when predicate = 'AFTER' then subject else object end as object from mixed)"


def _mixed(t):
    even = F.col("ordinal") % 2 == 0
    return facts(t).select("world", F.when(even, "AFTER").otherwise("BEFORE").alias("predicate"), F.when(even, F.col("object")).otherwise(F.col("subject")).alias("subject"), F.when(even, F.col("subject")).otherwise(F.col("object")).alias("object"))


@query("with " + MIXED_SQL + ", " + HOP_SQL.format(e="norm") + " select world, predicate, subject, object, middle from hops")
def inverse_normalised_path(t):
    """Paths over facts of both directions, the inverse ones turned round."""
    return g.two_hop(g.normalised(_mixed(t)), irreducible=False)


LINE_SQL = "partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_shipdate"
CLAIM_SQL = f"""claims as (select l_orderkey * 100000 + row_number() over ({LINE_SQL}) as claim_id, l_orderkey as world, l_suppkey as subject, lead(l_suppkey, 2) over ({LINE_SQL}) as object from lineitem),
asked as (select * from claims where object is not null and object <> subject)"""
LABEL_SQL = """edges as materialized (select distinct world, subject, object from norm),
pairs as materialized (select distinct world, subject, object from (select world, subject, object from asked union all select world, object, subject from asked)),
two as materialized (select p.world, p.subject, p.object from pairs p join edges a on a.world = p.world and a.subject = p.subject join edges b on b.world = p.world and b.subject = a.object and b.object = p.object group by all having count(*) = 1),
known as materialized (select world, subject, object, min(how) as how from (select world, subject, object, 'direct' as how from edges union all select world, subject, object, 'two_hop' from two) group by all),
labelled as (select c.claim_id, c.world, c.subject, c.object, s.how as support, r.how as refute,
  case when s.how is not null and r.how is null then 'SUPPORTED' when r.how is not null and s.how is null then 'CONTRADICTORY' else 'UNKNOWN' end as label, s.how is not null and r.how is not null as co_truth
  from asked c left join known s on s.world = c.world and s.subject = c.subject and s.object = c.object left join known r on r.world = c.world and r.subject = c.object and r.object = c.subject)"""


def _line_order():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")


def _claims(t):
    order = _line_order()
    rows = t("lineitem").select((F.col("l_orderkey") * 100000 + F.row_number().over(order)).alias("claim_id"), F.col("l_orderkey").alias("world"), F.col("l_suppkey").alias("subject"), F.lead("l_suppkey", 2).over(order).alias("object"))
    return rows.where("object is not null and object <> subject")


@query("with " + MIXED_SQL + ", " + CLAIM_SQL + ", " + LABEL_SQL + " select * from labelled")
def independent_label(t):
    """Each claim against the facts of its world: direct, inverse and two-hop, both ways."""
    return g.label_claims(_claims(t), _mixed(t))


@query("with " + MIXED_SQL + ", " + CLAIM_SQL + ", kept as (select * from norm n where not exists (select 1 from asked c where c.world = n.world and c.claim_id % 2 = 0 and c.subject = n.subject)), " + LABEL_SQL.replace("from norm)", "from kept)") + " select label, co_truth, count(*) as n from labelled group by all")
def ablation_unknown(t):
    """Labels after the facts about half of the claims' subjects are taken away."""
    claims, f = _claims(t), g.normalised(_mixed(t))
    gone = claims.where("claim_id % 2 = 0").select("world", "subject").distinct()
    return g.label_claims(claims, f.join(gone, ["world", "subject"], "left_anti")).groupBy("label", "co_truth").agg(F.count("*").alias("n"))


@query("with " + MIXED_SQL + ", " + CLAIM_SQL + ", " + LABEL_SQL + """, open as (select * from labelled where label = 'UNKNOWN' and not co_truth)
select claim_id, 'positive' as witness, 'SUPPORTED' as label from open union all select claim_id, 'negative', 'CONTRADICTORY' from open""")
def witness_replay(t):
    """Two witnesses for each undecided claim: the fact itself and its reverse, each added to the world.

    They settle it differently, so the claim was open. Each witness is a world of its own.
    """
    f, claims = _mixed(t), _claims(t)
    open_ = g.label_claims(claims, f).where("label = 'UNKNOWN' and not co_truth").select("claim_id", "world", "subject", "object")
    kinds = open_.withColumn("witness", F.explode(F.array(F.lit("positive"), F.lit("negative"))))
    known = F.col("witness") == "positive"
    own = F.concat_ws(":", "claim_id", "witness", "subject", "object")
    added = kinds.select(own.alias("world"), F.lit("BEFORE").alias("predicate"), F.when(known, F.col("subject")).otherwise(F.col("object")).alias("subject"), F.when(known, F.col("object")).otherwise(F.col("subject")).alias("object"))
    asked = kinds.select("claim_id", own.alias("world"), "subject", "object")
    return g.label_claims(asked, added).select("claim_id", F.split("world", ":")[1].alias("witness"), "label")


@query("""with a as (select user_id, case event_type when 'purchase' then 1 when 'error' then -1 else 0 end as step, row_number() over (partition by user_id order by ts, event_id) as k from events),
s as (select user_id, k, 5 + sum(step) over (partition by user_id order by k) as run from a)
select user_id, count(*) as actions, case when min(run) >= 0 then last(run order by k)::bigint end as final_count, case when min(run) < 0 then 'UNDERFLOW' else 'VALID' end as status from s group by user_id""")
def transition_fold(t):
    """A user's events in order as actions on a count that starts at 5; taking from none makes the sequence invalid."""
    step = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return p.folded(t("events").select("user_id", "ts", "event_id", step.alias("step")), "user_id", ["ts", "event_id"], F.date_trunc("day", "ts"), 5)


@query("""with s as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, case event_type when 'purchase' then 'ADD' when 'error' then 'REMOVE' when 'signup' then 'SET' else 'NOOP' end as kind,
  event_id % 3 as amount, case when event_id % 50 = 0 then 1 end as want from events),
m as (select *, max(case when kind = 'SET' then k end) over (partition by user_id order by k) as last_set, case kind when 'ADD' then amount when 'REMOVE' then -amount else 0 end as change from s),
v as (select a.*, coalesce(b.amount, 4) + sum(a.change) over (partition by a.user_id, a.last_set order by a.k) as value from m a left join s b on b.user_id is not distinct from a.user_id and b.k = a.last_set),
f as (select *, case when value < 0 then 'UNDERFLOW' when want <> value then 'STATE_MISMATCH' end as code from v),
e as (select user_id, count(*) as steps, min(case when code is not null then k end) as failed_step, arg_max(value, k) as final_count from f group by user_id)
select e.user_id, steps, coalesce(f.code, 'VALID') as status, failed_step, case when failed_step is null then final_count end::bigint as final_count from e left join f on f.user_id is not distinct from e.user_id and f.k = e.failed_step""")
def sequence_replay(t):
    """A user's events as actions that add to, take from or set a count, some with the count that should be there: the first that can't be replayed decides."""
    kind = F.when(F.col("event_type") == "purchase", "ADD").when(F.col("event_type") == "error", "REMOVE").when(F.col("event_type") == "signup", "SET").otherwise("NOOP")
    steps = t("events").select("user_id", "ts", "event_id", kind.alias("kind"), (F.col("event_id") % 3).alias("amount"), F.when(F.col("event_id") % 50 == 0, 1).alias("want"))
    return replay.replayed(steps, "user_id", ["ts", "event_id"], 4)


FAMILIES = ["REMOVE_AND_RECOUNT", "ADD_AND_RECOUNT", "REPLACE_AND_RECOUNT", "REPLACEMENT_IDENTITY", "MOVE_TO_OPPOSITE_SIDE", "SWAP_POSITIONS", "PAINT"]


def _transitions(t):
    """Orders as states: counts of kinds, things (lines) that are there, and which is left of which; an action per line, and its lists for the engine. Some are wrong on purpose."""
    w, c = Window.partitionBy("l_orderkey"), F.col
    kinds = t("lineitem").withColumns({"k": F.row_number().over(_line_order()), "kind": F.concat(F.lit("c"), (c("l_suppkey") % 3).cast("string")), "other": F.concat(F.lit("c"), (c("l_partkey") % 3).cast("string"))})
    kinds = kinds.select("l_orderkey", "l_suppkey", "l_partkey", "k", "kind", "other")
    sizes = [F.count_if(c("kind") == f"c{j}").over(w) for j in range(3)]
    pick = lambda on: F.element_at(F.array(*sizes), (F.substring(on, 2, 1).cast("int") + 1))
    rows = kinds.withColumns({"lines": F.count("*").over(w), "n": pick(c("kind")), "m": pick(c("other"))}).withColumns({"thing": F.concat(F.lit("e"), c("k").cast("string")), "next": F.concat(F.lit("e"), (c("k") + 1).cast("string"))})
    rows = dealt(rows, "l_orderkey", "lines")
    text = lambda x: F.lit(x).cast("string")
    fact = lambda predicate, subject, value=None, other=None, scope="question_local": F.struct(F.lit(predicate).alias("predicate") if isinstance(predicate, str) else predicate.alias("predicate"), subject.alias("subject"), (text("") if other is None else other).alias("object"), text(scope).alias("scope"), F.lit(value).cast("bigint").alias("value"))
    key = c("l_orderkey")
    counts = rows.groupBy("l_orderkey", "kind").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(key % 19 == 0, 2).otherwise(1))))
    there = rows.select("l_orderkey", F.explode(F.array_compact(F.array(fact("EXISTS_IN_WORLD", c("thing"), F.when((key % 7 == 0) & (c("k") == 1), 0).otherwise(1)), F.when(c("k") < c("lines"), fact("LEFT_OF", c("thing"), None, c("next")))))).alias("f"))
    pre = counts.select("l_orderkey", fact("COUNT", c("kind"), c("n"), None, "whole_scene").alias("f")).unionByName(there).select(key.alias("state"), "f.*")
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (1 + (c("k") + key) % 7).cast("int"))
    actions = rows.select(
        (key * 100000 + c("k")).alias("action_id"), key.alias("state"), family.alias("family"), c("thing").alias("target"), c("kind").alias("category"), c("other").alias("new_category"), F.when(c("l_partkey") % 11 != 0, F.concat(F.lit("new"), c("k").cast("string"))).alias("new_entity"),
        c("next").alias("anchor"), F.when(c("l_partkey") % 13 == 0, 2).otherwise(1).alias("quantity"), F.when(c("l_partkey") % 5 == 0, "NEAR").otherwise("LEFT_OF").alias("pre_predicate"), "n", "m",
    )
    new, off = F.coalesce("new_entity", text("")), F.when(c("state") % 23 == 0, 1).otherwise(0)
    old_count, new_count, gone, come = fact("COUNT", c("category"), c("n") - 1 + off, None, "whole_scene"), fact("COUNT", c("new_category"), c("m") + 1, None, "whole_scene"), fact("EXISTS_IN_WORLD", c("target"), 0), fact("EXISTS_IN_WORLD", new, 1)
    more, same, turned = fact("COUNT", c("category"), c("n") + c("quantity"), None, "whole_scene"), fact("SAME_INSTANCE", new, 0, c("target")), fact("RIGHT_OF", c("target"), None, c("anchor"))
    relation = fact(c("pre_predicate"), c("target"), None, c("anchor"))
    lists = {"REMOVE_AND_RECOUNT": ([old_count, gone], [old_count, gone]), "ADD_AND_RECOUNT": ([more], [more, come]), "REPLACE_AND_RECOUNT": ([old_count, new_count, gone], [old_count, new_count, gone, come, same]), "REPLACEMENT_IDENTITY": ([gone], [gone, come, same])}
    moved = c("family").isin("MOVE_TO_OPPOSITE_SIDE", "SWAP_POSITIONS")

    def listed(which: int):
        out = F.when(moved, F.array((relation, turned)[which]))
        for name, both in lists.items():
            out = out.when(c("family") == name, F.array(*both[which]))
        return actions.select("action_id", "state", F.explode(out).alias("f")).select("action_id", "state", "f.*")

    adds = listed(1)
    return actions, pre, listed(0).drop("value"), adds, adds.where("state % 29 <> 0 or predicate <> 'SAME_INSTANCE'").drop("value")


def _compared(actions, pre, deletes, adds, allowed):
    """Both sides are written before they are compared: so few joins lie in one task."""
    with in_place(actions.sparkSession):
        a, b = dealt(tr.executed(actions, pre, deletes, adds, allowed), "state", "executed"), dealt(tr.checked(actions, pre, "state"), "state", "checked")
    return tr.compared(a, adds, b)


TRANSITION_SQL = f"""lines as (select *, row_number() over ({LINE_SQL}) as k, l_suppkey % 3 as kind, l_partkey % 3 as other from lineitem),
a as (select l_orderkey * 100000 + k as action_id, l_orderkey as o, {FAMILIES}[1 + (k + l_orderkey) % 7] as family, count(*) over (partition by l_orderkey, kind) as n, (select count(*) from lineitem x where x.l_orderkey = lines.l_orderkey and x.l_suppkey % 3 = lines.other) as m, kind = other as same_kind,
  not (l_orderkey % 7 = 0 and k = 1) as there, k < count(*) over (partition by l_orderkey) and l_partkey % 5 <> 0 as related, l_partkey % 11 <> 0 as named, case when l_partkey % 13 = 0 then 2 else 1 end as quantity, l_orderkey % 19 = 0 as doubled, count(*) over (partition by l_orderkey) as things, k from lines),
e as (select *, list_sort(list_filter([case when doubled then 'DUPLICATE_PRE_FACT_SLOT' end, case when family in ('MOVE_TO_OPPOSITE_SIDE', 'SWAP_POSITIONS') and not related or family = 'REPLACE_AND_RECOUNT' and m = 0 then 'DELETE_FACT_NOT_IN_PRESTATE' end,
    case when family = 'REPLACE_AND_RECOUNT' and same_kind then 'DUPLICATE_DELETE_FACT_SLOT' end, case when family = 'REPLACE_AND_RECOUNT' and same_kind then 'DUPLICATE_POST_FACT_SLOT' end, case when family in ('REPLACE_AND_RECOUNT', 'REPLACEMENT_IDENTITY') and o % 29 = 0 then 'UNLISTED_POST_FACT_UPDATE' end], lambda x: x is not null)) as errors,
  case when family = 'PAINT' then 'REJECT_UNAUTHORIZED_RULE' when not case family when 'REMOVE_AND_RECOUNT' then there and not doubled when 'ADD_AND_RECOUNT' then not doubled and quantity = 1 and named when 'REPLACE_AND_RECOUNT' then named and not same_kind and not doubled and m > 0 and there
    when 'REPLACEMENT_IDENTITY' then named and there else related end then 'REJECT_TRANSITION_PRECONDITION_FAIL' end as error from a),
agreed as (select *, len(errors) = 0 and error is null and not (o % 23 = 0 and family in ('REMOVE_AND_RECOUNT', 'REPLACE_AND_RECOUNT')) as agree from e)"""


@query("with " + TRANSITION_SQL + " select action_id, family, array_to_string(errors, ',') as errors, error, agree from agreed")
@spread_by("lineitem")
def transition_agreement(t):
    """Actions of six families on tables of facts: the engine's errors, the checker's, and whether they come to the same facts."""
    actions, *lists = _transitions(t)
    both = _compared(actions, *lists).join(actions.select("state", "action_id", "family"), ["state", "action_id"])
    with in_place(both.sparkSession):
        return materialize(both.select("action_id", "family", F.array_join("errors", ",").alias("errors"), "error", "agree"), "agreement")


@query("with " + TRANSITION_SQL + """, kinds as (select l_orderkey as o, count(distinct l_suppkey % 3) as kinds from lineitem group by 1)
select action_id, kinds + things + things - 1 + case family when 'ADD_AND_RECOUNT' then 1 when 'REPLACE_AND_RECOUNT' then 2 when 'REPLACEMENT_IDENTITY' then 2 else 0 end as facts, things + case family when 'REMOVE_AND_RECOUNT' then -1 when 'ADD_AND_RECOUNT' then 1 else 0 end as counted,
  things - case when o % 7 = 0 then 1 else 0 end + case family when 'REMOVE_AND_RECOUNT' then -1 when 'ADD_AND_RECOUNT' then 1 else 0 end as there
from agreed join kinds using (o) where agree""")
@spread_by("lineitem")
def transition_successors(t):
    """The states that agreed actions lead to: how many facts, what the counts add up to, and how many things are there."""
    actions, pre, deletes, adds, allowed = _transitions(t)
    both = _compared(actions, pre, deletes, adds, allowed)
    with in_place(both.sparkSession):
        passed = dealt(both.where("agree").select("action_id", "state"), "state", "passed")
        after = tr.successors(passed, pre, deletes, adds)
        out = after.groupBy("state", "action_id").agg(F.count("*").alias("facts"), F.sum(F.when(F.col("predicate") == "COUNT", F.col("value")).otherwise(0)).alias("counted"), F.count_if((F.col("predicate") == "EXISTS_IN_WORLD") & (F.col("value") == 1)).alias("there"))
        return materialize(out.drop("state"), "successors")


RULED_SQL = f"""lines as (select *, row_number() over ({LINE_SQL}) as k from lineitem),
facts as materialized (select l_orderkey || ':' || k as fact_id, l_orderkey as world, case k % 4 when 0 then 'AFTER' when 1 then 'BEFORE' when 2 then 'LEFT_OF' else 'RIGHT_OF' end as predicate, 'n' || l_suppkey % 4 as subject, 'n' || l_partkey % 4 as object,
  null::bigint as value, case when l_quantity > 8 then 'positive' else 'negative' end as polarity, l_linestatus as status from lines
  union all select l_orderkey || ':' || l_suppkey % 10 || ':' || count(*), l_orderkey, 'COUNT', 'class' || l_suppkey % 10, null, count(*), 'positive', 'O' from lineitem group by l_orderkey, l_suppkey % 10),
claims as materialized (select l_orderkey * 100000 + k as claim_id, l_orderkey as world, case when k % 5 = 0 then 'COUNT' when l_partkey % 4 = 0 then 'AFTER' when l_partkey % 4 = 1 then 'BEFORE' when l_partkey % 4 = 2 then 'LEFT_OF' else 'RIGHT_OF' end as predicate,
  case when k % 5 = 0 then 'class' || l_suppkey % 10 else 'n' || l_partkey % 3 end as subject, case when k % 5 <> 0 then 'n' || l_suppkey % 4 end as object, case when k % 5 = 0 then 1 + l_partkey % 2 end as value,
  case when l_discount > 0.08 then 'negative' else 'positive' end as polarity, case when l_tax > 0.05 then l_linestatus end as status, case when k % 2 = 0 then 'SUPPORTED' else 'CONTRADICTORY' end as expected from lines),
inverse as (select unnest(['BEFORE', 'AFTER', 'LEFT_OF', 'RIGHT_OF']) as p, unnest(['AFTER', 'BEFORE', 'RIGHT_OF', 'LEFT_OF']) as q),
edges as materialized (select f.fact_id, f.world, f.predicate as p, f.subject, f.object, f.status from facts f where f.polarity = 'positive' and object is not null
  union all select f.fact_id, f.world, q, f.object, f.subject, f.status from facts f join inverse on p = f.predicate where f.polarity = 'positive'),
matched as materialized (
  select c.claim_id, case when f.polarity = c.polarity then 'support' else 'refute' end as side, case when f.polarity = c.polarity then 'STATED' else 'OPPOSITE_POLARITY' end as rule, f.fact_id as one, null as two
    from claims c join facts f on f.world = c.world and f.predicate = c.predicate and f.subject = c.subject where f.object is not distinct from c.object and f.value is not distinct from c.value and (c.status is null or c.status = f.status)
  union all select c.claim_id, 'refute', 'OTHER_COUNT', f.fact_id, null from claims c join facts f on f.world = c.world and f.predicate = c.predicate and f.subject = c.subject where c.predicate = 'COUNT' and c.polarity = 'positive' and f.value <> c.value and (c.status is null or c.status = f.status)
  union all select c.claim_id, 'support', 'INVERSE', f.fact_id, null from claims c join inverse on p = c.predicate join facts f on f.world = c.world and f.predicate = q and f.subject = c.object and f.object = c.subject where f.polarity = c.polarity and (c.status is null or c.status = f.status)
  union all select c.claim_id, 'refute', 'ASYMMETRY', f.fact_id, null from claims c join facts f on f.world = c.world and f.predicate = c.predicate and f.subject = c.object and f.object = c.subject where f.polarity = 'positive' and (c.status is null or c.status = f.status)
  union all select c.claim_id, 'refute', 'EXCLUSION', f.fact_id, null from claims c join inverse on p = c.predicate join facts f on f.world = c.world and f.predicate = q and f.subject = c.subject and f.object = c.object where f.polarity = 'positive' and c.polarity = 'positive' and (c.status is null or c.status = f.status)
  union all select w.claim_id, side, rule, a.fact_id, b.fact_id from (select claim_id, world, predicate as p, status, 'support' as side, subject as s, object as o, case when predicate in ('BEFORE', 'AFTER') then 'STRICT_ORDER_TRANSITIVITY' else 'AUTHORIZED_DIRECTION_TRANSITIVITY' end as rule from claims where polarity = 'positive' and subject <> object
      union all select claim_id, world, predicate, status, 'refute', object, subject, case when predicate in ('BEFORE', 'AFTER') then 'STRICT_ORDER_TRANSITIVITY' else 'AUTHORIZED_DIRECTION_TRANSITIVITY' end from claims where polarity = 'positive' and subject <> object) w
    join edges a on a.world = w.world and a.p = w.p and a.subject = w.s join edges b on b.world = w.world and b.p = w.p and b.subject = a.object and b.object = w.o
    where (w.status is null or (a.status = w.status and b.status = w.status)) and (w.world % 5 <> 0 or rule <> 'STRICT_ORDER_TRANSITIVITY')),
unique_chain as (select claim_id, side, rule, min(one) as one, min(two) as two from matched where two is not null group by all having count(*) = 1),
proofs as materialized (select claim_id, side, rule, one as fact_id, 1 as hops from matched where two is null union all select claim_id, side, rule, unnest([one, two]), 2 from unique_chain),
labelled as (select claim_id, bool_or(side = 'support') as s, bool_or(side = 'refute') as r, max(hops) as hops, list_sort(list(distinct fact_id)) as evidence, list_sort(list(distinct rule)) as rules from proofs group by claim_id)"""


def _ruled(t):
    """Facts and claims of orders: relations of four kinds over few nodes, so that chains compete, some facts negative, counts, contexts; strict orders don't chain in every fifth world."""
    lines = t("lineitem").withColumn("k", F.row_number().over(_line_order()))
    rows = dealt(lines.select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_linestatus", "k"), "l_orderkey", "lines")
    pick = lambda on: F.when(on == 0, "AFTER").when(on == 1, "BEFORE").when(on == 2, "LEFT_OF").otherwise("RIGHT_OF")
    node = lambda kind, c, n: F.concat(F.lit(kind), (F.col(c) % n).cast("string"))
    none = F.lit(None)
    relations = rows.select(
        F.concat_ws(":", "l_orderkey", "k").alias("fact_id"), F.col("l_orderkey").alias("world"), pick(F.col("k") % 4).alias("predicate"), node("n", "l_suppkey", 4).alias("subject"), node("n", "l_partkey", 4).alias("object"),
        none.cast("bigint").alias("value"), F.when(F.col("l_quantity") > 8, "positive").otherwise("negative").alias("polarity"), F.create_map(F.lit("status"), "l_linestatus").alias("context"),
    )
    counted = rows.groupBy("l_orderkey", (F.col("l_suppkey") % 10).alias("c")).agg(F.count("*").alias("n"))
    counts = counted.select(
        F.concat_ws(":", "l_orderkey", "c", "n").alias("fact_id"), F.col("l_orderkey").alias("world"), F.lit("COUNT").alias("predicate"), F.concat(F.lit("class"), "c").alias("subject"), none.cast("string").alias("object"),
        F.col("n").alias("value"), F.lit("positive").alias("polarity"), F.create_map(F.lit("status"), F.lit("O")).alias("context"),
    )
    count = F.col("k") % 5 == 0
    claims = rows.select(
        (F.col("l_orderkey") * 100000 + F.col("k")).alias("claim_id"), F.col("l_orderkey").alias("world"), F.when(count, "COUNT").otherwise(pick(F.col("l_partkey") % 4)).alias("predicate"),
        F.when(count, node("class", "l_suppkey", 10)).otherwise(node("n", "l_partkey", 3)).alias("subject"), F.when(~count, node("n", "l_suppkey", 4)).alias("object"), F.when(count, 1 + F.col("l_partkey") % 2).alias("value"),
        F.when(F.col("l_discount") > 0.08, "negative").otherwise("positive").alias("polarity"), F.when(F.col("l_tax") > 0.05, F.create_map(F.lit("status"), "l_linestatus")).alias("context"), F.when(F.col("k") % 2 == 0, "SUPPORTED").otherwise("CONTRADICTORY").alias("expected"),
    )
    ids = F.explode(F.array(*[F.lit(r) for r in p.RULE_IDS])).alias("rule_id")
    authorised = rows.select(F.col("l_orderkey").alias("world")).distinct().select("world", ids).where("world % 5 <> 0 or rule_id <> 'STRICT_ORDER_TRANSITIVITY'")
    return claims, relations.unionByName(counts), p.standard_rules(rows.sparkSession), authorised


@query("with " + RULED_SQL + """ select claim_id, side, rule as rule_id, count(*) as n, min(one) as least_first, max(two) as greatest_second from matched group by all""")
@spread_by("lineitem")
def rule_matches(t):
    """What each rule of a table sets against each claim: facts, and chains that may compete; some rules are switched off in some worlds."""
    claims, facts_, rules, authorised = _ruled(t)
    found = p.matches(claims, facts_, rules, authorised)
    out = found.groupBy("world", "claim_id", "side", "rule_id").agg(F.count("*").alias("n"), F.min(F.get("premises", F.lit(0))).alias("least_first"), F.max(F.get("premises", F.lit(1))).alias("greatest_second"))
    with in_place(out.sparkSession):
        return materialize(out.drop("world"), "rules")


@query("with " + RULED_SQL + """,
used as (select distinct claim_id, fact_id as gone from proofs),
left_single as (select distinct u.claim_id, gone, side from used u join matched m on m.claim_id = u.claim_id and m.two is null and m.one <> gone),
left_chain as (select u.claim_id, gone, side from used u join matched m on m.claim_id = u.claim_id and m.two is not null and m.one <> gone and m.two <> gone group by u.claim_id, gone, side, rule having count(*) = 1),
relabelled as (select claim_id, gone, count(distinct side) as sides from (select * from left_single union all select * from left_chain) group by all),
loose as (select distinct claim_id from relabelled where sides = 1),
out as (select c.claim_id, c.predicate, c.expected, coalesce(s, false) as s, coalesce(r, false) as r, hops, evidence, rules, o.claim_id is not null as loose, case when s and not r then 'SUPPORTED' when r and not s then 'CONTRADICTORY' else 'UNKNOWN' end as label
  from claims c left join labelled l on l.claim_id = c.claim_id left join loose o on o.claim_id = c.claim_id)
select claim_id, label, case when s <> r then case when hops = 2 then 'L2' when predicate = 'BEFORE' then 'L3' else 'L1' end end as level, array_to_string(coalesce(evidence, []), ',') as evidence, array_to_string(coalesce(rules, []), ',') as rules,
  array_to_string(list_filter([case when s and r then 'CO_TRUTH_POSSIBLE' end, case when loose then 'MINIMALITY_ABLATION_FAIL' end, case when not s and not r then 'UNPROVIDED_PREMISE' end, case when label <> expected then 'VERIFIER_DISAGREEMENT' end], lambda x: x is not null), ',') as codes from out""")
@spread_by("lineitem")
def proof_verification(t):
    """Labels, levels, evidence, rules and reject codes of claims against an expected label; SQL takes each piece of evidence away and labels again."""
    out = p.verified(*_ruled(t))
    with in_place(out.sparkSession):
        return materialize(out.select("claim_id", "label", "level", *[F.array_join(c, ",").alias(c) for c in ("evidence", "rules", "codes")]), "verified")


@query("""with g as (select l_orderkey, l_suppkey, count(*) - case when l_orderkey % 3 = 0 then 1 else 0 end as pre, min(l_linenumber) as line from lineitem group by l_orderkey, l_suppkey),
f as (select *, case (l_orderkey + l_suppkey) % 4 when 0 then 'REMOVE' when 1 then 'ADD' when 2 then 'MOVE' else 'PAINT' end as family, l_orderkey % 7 <> 0 as there, l_orderkey % 11 = 0 as unlisted, l_orderkey % 13 = 0 as elsewhere from g),
a as (select *, case when family = 'PAINT' then [] else list_filter([case when elsewhere then 'DELETE_FACT_NOT_IN_PRESTATE' end, case when family = 'REMOVE' and pre < 1 then 'INVALID_POST_COUNT' end, case when unlisted then 'UNLISTED_POST_FACT_UPDATE' end], lambda x: x is not null) end as errors,
  case when family = 'PAINT' then 'REJECT_UNAUTHORIZED_RULE' when family = 'REMOVE' and (pre < 1 or not there) then 'REJECT_TRANSITION_PRECONDITION_FAIL' else '' end as b_errors from f)
select l_orderkey, l_suppkey, family, array_to_string(errors, ',') as a_errors, b_errors, len(errors) = 0 and b_errors = '' as agree,
  case when len(errors) = 0 and family in ('REMOVE', 'ADD') then pre + case family when 'ADD' then 1 else -1 end end as post_count from a""")
def engine_on_fact_slots(t):
    """Actions as deltas of facts by a general engine, and by a checker with a rule per family, on the same states."""
    k, line = F.col("l_orderkey"), F.concat(F.lit("e"), F.col("line"))
    g1 = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg((F.count("*") - F.when(k % 3 == 0, 1).otherwise(0)).alias("n"), F.min("l_linenumber").alias("line"))
    kind = (k + F.col("l_suppkey")) % 4
    rows = g1.withColumns({"family": F.when(kind == 0, "REMOVE").when(kind == 1, "ADD").when(kind == 2, "MOVE").otherwise("PAINT"), "target": line, "category": F.concat(F.lit("s"), "l_suppkey")})
    c, target, family = F.col("category"), F.col("target"), F.col("family")
    pre = F.array(p.fact("COUNT", c, F.col("n")), p.fact("EXISTS_IN_WORLD", target, F.when(k % 7 == 0, 0).otherwise(1)), p.fact("LEFT_OF", target, None, F.lit("door")))
    count = lambda by: p.fact("COUNT", c, F.col("n") + by)
    none = F.array().cast(f"array<{p.FACT}>")
    add = F.when(family == "REMOVE", F.array(count(-1), p.fact("EXISTS_IN_WORLD", target, F.lit(0)))).when(family == "ADD", F.array(count(1), p.fact("EXISTS_IN_WORLD", F.concat(F.lit("new-"), target), F.lit(1))))
    add = add.when(family == "MOVE", F.array(p.fact("RIGHT_OF", target, None, F.lit("door")))).otherwise(none)
    rows = rows.withColumns({"pre": pre, "add": add})
    known, every = family != "PAINT", F.transform("add", p.slot)
    gone = F.when(~known, F.array().cast("array<string>")).when(k % 13 == 0, F.array(F.lit("COUNT|nothing||scene"))).otherwise(F.transform(F.slice("pre", 1, 1), p.slot))
    allowed = F.when(k % 11 == 0, F.slice(every, 2, 9)).otherwise(every)
    both = rows.withColumns({"a": p.apply_delta(F.col("pre"), gone, F.col("add"), allowed), "b": p.check_family(F.col("pre"), family, target, c, F.lit("door"), F.lit("LEFT_OF"))})
    agree = (F.col("a.status") == "PASS") & (F.col("b.status") == "PASS") & (F.col("a.post") == F.col("b.post"))
    counted = F.filter("a.post", lambda f: f["predicate"] == "COUNT")
    return both.select("l_orderkey", "l_suppkey", "family", F.array_join("a.errors", ",").alias("a_errors"), F.array_join("b.errors", ",").alias("b_errors"), agree.alias("agree"), F.when(F.col("a.status") == "PASS", F.get(counted, F.lit(0))["value"]).alias("post_count"))


@query("""with c as (select l_orderkey, l_suppkey, count(*) as pre, max(l_linenumber) % 3 as delta, min(l_partkey) % 4 as claimed, bool_or(l_returnflag = 'R') as missing from lineitem group by all)
select l_orderkey, l_suppkey, case when missing then 'UNKNOWN' when claimed = pre + delta then 'SUPPORTED' else 'CONTRADICTORY' end as label from c""")
def count_rule_replay(t):
    c = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("pre"), (F.max("l_linenumber") % 3).alias("delta"), (F.min("l_partkey") % 4).alias("claimed"), F.bool_or(F.col("l_returnflag") == "R").alias("missing"))
    return c.select("l_orderkey", "l_suppkey", F.when(F.col("missing"), "UNKNOWN").when(F.col("claimed") == F.col("pre") + F.col("delta"), "SUPPORTED").otherwise("CONTRADICTORY").alias("label"))


@query("""with s as (select o_orderkey, case when o_orderkey % 5 = 0 then 'UNKNOWN' else 'SUPPORTED' end as full_label, case when o_orderkey % 2 = 0 then 'UNKNOWN' else 'SUPPORTED' end as scene_only, case when o_orderkey % 3 = 0 then 'UNKNOWN' else 'SUPPORTED' end as change_only from orders)
select case when full_label = 'UNKNOWN' then 'REJECT' when scene_only = 'UNKNOWN' and change_only = 'UNKNOWN' then 'CORE' when scene_only = 'UNKNOWN' then 'CALIBRATION' else 'REJECT' end as strength, count(*) as n from s group by 1""")
def strength_class(t):
    k = F.col("o_orderkey")
    full, scene, change = (k % 5 == 0), (k % 2 == 0), (k % 3 == 0)  # each: is UNKNOWN
    strength = F.when(full, "REJECT").when(scene & change, "CORE").when(scene, "CALIBRATION").otherwise("REJECT")
    return t("orders").groupBy(strength.alias("strength")).agg(F.count("*").alias("n"))


@query("""select l_orderkey, l_suppkey, case when bool_and(l_linestatus = 'O') then 'SUPPORTED' when not bool_or(l_linestatus = 'O') then 'CONTRADICTORY' else 'UNKNOWN' end as label from lineitem group by all""")
def exact_claim_label(t):
    """A claim against all values that remain possible: all, none or some of them."""
    ok = F.col("l_linestatus") == "O"
    return t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.when(F.bool_and(ok), "SUPPORTED").when(~F.bool_or(ok), "CONTRADICTORY").otherwise("UNKNOWN").alias("label"))


@query("with " + FACTS_SQL + " select world, ordinal, 'AFTER' as predicate, object as subject, subject as object, 'SUPPORTED' as label from facts union all select world, ordinal, 'BEFORE', object, subject, 'CONTRADICTORY' from facts")
def contradiction_swap(t):
    """The inverse of a fact keeps its label; its reverse contradicts it."""
    f = facts(t)
    turned = f.select("world", "ordinal", g.inverse_of(F.col("predicate")).alias("predicate"), F.col("object").alias("subject"), F.col("subject").alias("object"), F.lit("SUPPORTED").alias("label"))
    return turned.unionByName(f.select("world", "ordinal", "predicate", F.col("object").alias("subject"), F.col("subject").alias("object"), F.lit("CONTRADICTORY").alias("label")))


@query("""with b as (select label, min(embedding[1]) as lo, max(embedding[1]) as hi from embeddings group by label)
select a.label as a, b.label as b, case when a.hi::double + 0.02 < b.lo::double then 'BEFORE' when b.hi::double + 0.02 < a.lo::double then 'AFTER' end as relation from b a join b on a.label < b.label""")
def box_separation(t):
    """Which of two intervals lies wholly before the other, by a margin; all pairs of a few labels."""
    x = F.get("embedding", 0).cast("double")
    b = t("embeddings").groupBy("label").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    left, right = b.select(F.col("label").alias("a"), F.col("lo").alias("al"), F.col("hi").alias("ah")), b.select(F.col("label").alias("b"), F.col("lo").alias("bl"), F.col("hi").alias("bh"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", g.separated(F.col("al"), F.col("ah"), F.col("bl"), F.col("bh")).alias("relation"))


COMPONENT_SQL = """with recursive doc as (select doc_id, sha256(text) as h from documents), e as (select distinct a.doc_id as a, b.doc_id as b from doc a join doc b using (h) union select doc_id, greatest(0, doc_id - 1) from documents where doc_id % 5 = 0 union select greatest(0, doc_id - 1), doc_id from documents where doc_id % 5 = 0),
r as (select a as node, b as reach from e union select r.node, e.b from r join e on r.reach = e.a), c as (select node, least(node, min(reach)) as component from r group by node)
"""


def _clusters(t):
    d = materialize(t("documents").select("doc_id", F.sha2("text", 256).alias("h")), "digests")  # texts are read once
    least = d.groupBy("h").agg(F.min("doc_id").alias("dst"))  # a star per text, not all its pairs
    same = join_by_share(d, least, "h").select(F.col("doc_id").alias("src"), "dst")
    chained = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("src"), F.greatest(F.lit(0), F.col("doc_id") - 1).alias("dst"))
    return g.components(same.unionByName(chained))


@query(COMPONENT_SQL + "select node as doc_id, component from c")
def world_alias_components(t):
    """Worlds that share a media digest, or are aliases by id, are one cluster."""
    return _clusters(t).select(F.col("node").alias("doc_id"), "component")


@query(COMPONENT_SQL + """, s as (select c.node, component, case when node % 10 < 6 then 'train' when node % 10 < 8 then 'dev' else 'test' end as split from c),
w as (select component, max(case split when 'test' then 2 when 'dev' then 1 else 0 end) as top from s group by component)
select node as doc_id, split, case when (case split when 'test' then 2 when 'dev' then 1 else 0 end) < top then 'EXCLUDED' else 'KEPT' end as outcome from s join w using (component)""")
def split_precedence(t):
    """In a cluster with test worlds train and dev go; with dev worlds, train goes."""
    d = F.col("node") % 10
    s = _clusters(t).withColumn("split", F.when(d < 6, "train").when(d < 8, "dev").otherwise("test"))
    level = F.when(F.col("split") == "test", 2).when(F.col("split") == "dev", 1).otherwise(0)
    top = s.groupBy("component").agg(F.max(level).alias("top"))
    return join_by_share(s, top, "component").select(F.col("node").alias("doc_id"), "split", F.when(level < F.col("top"), "EXCLUDED").otherwise("KEPT").alias("outcome"))
