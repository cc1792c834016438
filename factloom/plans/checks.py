"""Queries that hold joins, unions, chains, boxes and answers to their conditions."""

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import audits as a
from .frames import FACTS_SQL, facts
from .registry import query


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def strict_inner(t):
    """Every order must have a customer: an order without one raises."""
    right = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return a.strict_join(t("orders").select("o_orderkey", "o_custkey"), right, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, 0) as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def left_with_default(t):
    labels = t("labels").select("doc_id", "quality", "toxic")
    return t("documents").select("doc_id").join(labels, "doc_id", "left").fillna({"quality": -1, "toxic": 0})


@query("""with gold as (select doc_id, case quality when 1 then 'SUPPORTED' else 'CONTRADICTORY' end as gold, 0 as tier from labels where quality is not null union all select doc_id, 'UNKNOWN', 1 from documents where doc_id % 3 = 0)
select d.doc_id, arg_min(g.gold, g.tier) as gold from documents d join gold g on g.doc_id = d.doc_id group by d.doc_id""")
def coalescing_gold(t):
    """Labels of two sources in one lookup; the first source comes first."""
    labels = t("labels").where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "SUPPORTED").otherwise("CONTRADICTORY").alias("gold"), F.lit(0).alias("tier"))
    other = t("documents").where("doc_id % 3 = 0").select("doc_id", F.lit("UNKNOWN").alias("gold"), F.lit(1).alias("tier"))
    gold = labels.unionByName(other).groupBy("doc_id").agg(F.min_by("gold", "tier").alias("gold"))
    return t("documents").select("doc_id").distinct().join(gold, "doc_id")


@query("select o_custkey, o_orderpriority, o_orderstatus, case when count(distinct o_orderkey) = 1 then min(o_orderkey) end as o_orderkey, case when count(distinct o_orderkey) = 1 then 'MATCHED' else 'AMBIGUOUS' end as status from orders group by 1, 2, 3")
def composite_key(t):
    return a.unambiguous(t("orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("""with b as (select l_orderkey, l_suppkey, count(distinct l_linestatus) as s, count(distinct l_returnflag) as f from lineitem group by 1, 2)
select l_orderkey, l_suppkey, array_to_string(list_filter([case when s > 1 then 'l_linestatus' end, case when f > 1 then 'l_returnflag' end], lambda x: x is not null), ',') as breaks from b where s > 1 or f > 1""")
def functional_dependency(t):
    return a.dependency_breaks(t("lineitem"), ["l_orderkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])


EDGES_SQL = FACTS_SQL + ", e as (select distinct world, ordinal || ':' || subject || ':' || object as edge_id, subject, object from facts)"


def _edges(t):
    return facts(t).select("world", F.concat_ws(":", "ordinal", "subject", "object").alias("edge_id"), "subject", "object").distinct()


@query("with " + EDGES_SQL + " select x.world, least(x.edge_id, y.edge_id) as low, greatest(x.edge_id, y.edge_id) as high, count(*) as conclusions from e x join e y on x.world = y.world and x.object = y.subject where x.edge_id <> y.edge_id and x.subject <> y.object group by 1, 2, 3")
def unordered_chains(t):
    return a.all_chains(_edges(t))


@query("with " + EDGES_SQL + """, p as (select distinct world, subject, object from e), bad as (select distinct x.world, x.subject as node from p x join p y on x.world = y.world and x.subject = y.object and x.object = y.subject),
ok as (select * from p where not exists (select 1 from bad where bad.world = p.world and bad.node in (p.subject, p.object)))
select x.world, x.subject, y.object, min(x.object) as middle from ok x join ok y on x.world = y.world and x.object = y.subject where x.subject <> y.object group by 1, 2, 3 having count(distinct x.object) = 1""")
def settled_chains(t):
    return a.settled_chains(_edges(t))


@query("""with every as (select 0 as part, o_custkey as id, o_orderpriority as note from orders where o_orderkey % 2 = 0 union all select 1, c_custkey, c_mktsegment from customer)
select id, arg_min(part, part || note) as part, arg_min(note, part || note) as note, count(*) as copies, case when count(*) = 1 then 'UNIQUE' else 'DUPLICATE_ID' end as status from every group by id""")
def union_unique_ids(t):
    """Rows of two sources by id; ids that come twice are marked."""
    orders = t("orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("note"))
    return a.union_unique([orders, t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("note"))], "id")


@query("""with m as (select c_custkey as id, case when c_custkey % 10 < 7 then 'train' else 'test' end as split from customer union all select distinct o_custkey, case when o_custkey % 15 < 10 then 'train' else 'test' end from orders)
select id, case when min(split) = max(split) then min(split) end as split, count(*) as maps, case when min(split) = max(split) then 'MERGED' else 'SPLIT_CONFLICT' end as status from m group by id""")
def split_map_merge(t):
    of = lambda c, n, k: F.when(F.col(c) % n < k, "train").otherwise("test").alias("split")
    one = t("customer").select(F.col("c_custkey").alias("id"), of("c_custkey", 10, 7))
    two = t("orders").select(F.col("o_custkey").alias("id"), of("o_custkey", 15, 10)).distinct()
    return a.merged_splits([one, two], "id", "split")


@query("select user_id from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)")
def in_all_types(t):
    """Users with events of every type."""
    return a.in_all(t("events"), "event_type", "user_id")


@query("""with b as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity as cx, l_discount * 10 as dx, 1.0 + l_tax as dy, 2.0 as dz, l_linenumber / 3.0 as al, l_tax * 9 as be, l_discount * 7 as ga from lineitem),
r as (select *, cos(al) * cos(ga) - sin(al) * sin(be) * sin(ga) as xx, -sin(al) * cos(be) as xy, cos(al) * sin(ga) + sin(al) * sin(be) * cos(ga) as xz from b)
select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when dx > 0 then round(cx - (abs(xx) * dx + abs(xy) * dy + abs(xz) * dz) / 2, 6) end as low, case when dx > 0 then round(cx + (abs(xx) * dx + abs(xy) * dy + abs(xz) * dz) / 2, 6) end as high from r""")
def rotated_box_interval(t):
    """The first axis of turned boxes; a box without extent has none."""
    q = lambda c, by: F.col(c) * by
    size = [q("l_discount", 10), q("l_tax", 1) + 1.0, F.lit(2.0)]
    low, high = a.box_interval([F.col("l_quantity")] * 3, size, [F.col("l_linenumber") / 3.0, q("l_tax", 9), q("l_discount", 7)])[0]
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""with r as (select o_orderpriority as grp, o_custkey as cluster, case when o_orderstatus <> 'P' then case when o_orderpriority like '1%' then 0 when o_totalprice > 200000 then 1 else 0 end end as v from orders),
e as (select grp, cluster, sum(v) as s, count(*) as n from r where v is not null group by 1, 2)
select grp, sum(s)::bigint as numerator, sum(n)::bigint as denominator, count(*) as clusters, round(avg(s / n), 9) as macro, case when sum(s) = 0 then round(1 - pow(0.05, 1.0 / count(*)), 9) end as zero_event_upper from e group by 1""")
def cluster_macro(t):
    """Means of cluster means over eligible rows, with an upper bound where nothing occurs."""
    v = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_totalprice") > 200000, 1).otherwise(0))
    rows = t("orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("cluster"), v.alias("v"))
    return a.ratio_by_cluster(rows, "grp", "cluster", "v").withColumns({c: F.round(c, 9) for c in ("macro", "zero_event_upper")})


@query("""with s as (select l_orderkey, list_sort(list(distinct l_suppkey)) as used, bool_and(l_quantity > 3) as labels, bool_or(l_returnflag = 'R') as slots, count(*) > 1 as evidence from lineitem group by 1),
c as (select *, list_sort(list_filter(used, lambda x: x % 4 = 0)) as extra from s)
select l_orderkey, array_to_string(extra, ',') as unsupported, array_to_string(list_filter([case when not labels then 'labels' end, case when not slots then 'slots' end, case when not evidence then 'evidence' end, case when len(extra) > 0 then 'premises' end], lambda x: x is not null), ',') as failed,
  labels and slots and evidence and len(extra) = 0 as passed from c""")
def proof_carrying(t):
    """A pair counts only if labels, slots and evidence hold and no premise lies outside the allowed ones."""
    g = t("lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set("l_suppkey")).alias("used"), F.sort_array(F.collect_set(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")))).alias("allowed"), F.bool_and(F.col("l_quantity") > 3).alias("labels"), F.bool_or(F.col("l_returnflag") == "R").alias("slots"), (F.count("*") > 1).alias("evidence")
    )
    g = g.withColumn("extra", F.array_except("used", "allowed")).withColumn("premises", F.size("extra") == 0)
    return a.all_components(g, "l_orderkey", ["labels", "slots", "evidence", "premises"]).join(g.select("l_orderkey", F.array_join("extra", ",").alias("unsupported")), "l_orderkey")


#: Answers: whole, cut after the label's quote, without a comma after it, cut within the label, a second key, an escaped second key, an
#: unquoted second key, a label within the reason only, another label, lower case.
ANSWERS = [
    '{"label": "SUPPORTED", "reason": "a%d"}', '  {"label":"UNKNOWN"', '{"label": "CONTRADICTORY" "reason": "a%d"', '{"label": "SUPPOR', '{"label": "SUPPORTED", "label": "SUPPORTED"}', '{"label": "UNKNOWN", "l\\u0061bel": "UNKNOWN"}',
    '{"label": "SUPPORTED", label: "UNKNOWN"}', '{"reason": "label is SUPPORTED %d"}', '{"label": "MAYBE"}', '{"label": "supported"}', 'text before {"label": "SUPPORTED"}', '```json\n{"label": "UNKNOWN", "reason": "cut %d',
]
LABELS = ["SUPPORTED", "UNKNOWN", "CONTRADICTORY", None, None, None, None, None, None, None, None, "UNKNOWN"]


@query("select event_id, ([" + ", ".join("null" if x is None else f"'{x}'" for x in LABELS) + f"])[1 + event_id % {len(LABELS)}] as label from events")
def label_recovery_delimiters(t):
    """A first label that is closed counts whatever follows it, unless another label key follows; reasons aren't searched."""
    raw = F.replace(F.element_at(F.array(*map(F.lit, ANSWERS)), (1 + F.col("event_id") % len(ANSWERS)).cast("int")), F.lit("%d"), F.col("event_id").cast("string"))
    return t("events").select("event_id", parse.first_closed_label(raw).alias("label"))
