"""Scoring queries: gold labels against predictions."""

from pyspark.sql import functions as F

from ..operators import metrics as m
from .frames import SCORED_SQL, scored
from .registry import query

CLASS_SQL = (
    "with "
    + SCORED_SQL
    + """,
keyed as ({keyed}),
names as (select unnest(['SUPPORTED', 'CONTRADICTORY', 'UNKNOWN']) as label),
c as (
  select k.grp, n.label, count(*) filter (where gold = n.label) as support,
    count(*) filter (where gold = n.label and pred = n.label) as tp,
    count(*) filter (where gold <> n.label and pred = n.label) as fp
  from keyed k cross join names n group by k.grp, n.label
),
e as (
  select *, support - tp as fn,
    case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as precision,
    case when support > 0 then tp::double / support else 0.0 end as recall,
    case when 2 * tp + fp + support - tp > 0 then (2 * tp)::double / (2 * tp + fp + support - tp) else 0.0 end as f1
  from c
),
s as (
  select grp, sum(support)::bigint as n, sum(tp)::bigint as correct,
    sum(tp)::double / sum(support) as accuracy,
    (coalesce(max(case when label = 'SUPPORTED' and support > 0 then f1 end), 0.0) + coalesce(max(case when label = 'CONTRADICTORY' and support > 0 then f1 end), 0.0)
      + coalesce(max(case when label = 'UNKNOWN' and support > 0 then f1 end), 0.0)) / count(*) filter (where support > 0) as macro_f1
  from e group by grp
)
"""
)
BY_LANG = "select lang as grp, gold, pred from scored union all select 'OVERALL', gold, pred from scored"


@query(CLASS_SQL.format(keyed=BY_LANG) + "select grp as lang, label, support::bigint as support, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, precision, recall, f1 from e")
def score_three_class(t):
    return m.three_class(m.with_overall(scored(t), "lang"), ["lang"])


@query(CLASS_SQL.format(keyed=BY_LANG) + "select grp as lang, n, correct, accuracy, macro_f1 from s")
def score_by_group(t):
    return m.summary(m.with_overall(scored(t), "lang"), ["lang"])


@query(
    CLASS_SQL.format(keyed="select 'x' as grp, gold, pred from scored")
    + """select label, support::bigint as support, case when tp + fp > 0 then tp::double / (tp + fp) end as precision,
  case when support > 0 then tp::double / support end as recall, case when support > 0 then f1 end as f1 from e"""
)
def score_strict_null(t):
    return m.three_class(scored(t), [], "null").select("label", "support", "precision", "recall", "f1")


@query("with " + SCORED_SQL + " select gold, coalesce(pred, 'MISSING') as pred, count(*) as n from scored group by all")
def confusion_matrix(t):
    return m.confusion(scored(t))


GROUPS_SQL = (
    "with "
    + SCORED_SQL
    + """,
dims as (select 'lang' as dimension, lang as "group", gold, pred from scored where lang is not null
  union all select 'source', source, gold, pred from scored where source is not null),
g as (select dimension, "group", count(*) as n, count(*) filter (where gold = pred) as correct, count(*) filter (where gold = pred)::double / count(*) as accuracy from dims group by all)
"""
)


@query(GROUPS_SQL + "select * from g")
def group_accuracy(t):
    return m.group_accuracy(scored(t), ["lang", "source"])


@query(GROUPS_SQL + 'select dimension, "group", n, accuracy from g order by accuracy, dimension, "group" limit 1')
def worst_group(t):
    return m.worst_group(scored(t), ["lang", "source"])


@query("with " + SCORED_SQL + " select count(*) as n, count(pred) as answered, count(*) filter (where gold = pred) as correct, count(*) filter (where gold = pred)::double / count(*) as accuracy_all, count(*) filter (where gold = pred)::double / count(pred) as accuracy_answered from scored")
def missing_kept_wrong(t):
    """Missing predictions stay in one denominator and leave the other."""
    right = F.count_if(F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)))
    return scored(t).agg(F.count("*").alias("n"), F.count("pred").alias("answered"), right.alias("correct"), m.ratio(right, F.count("*")).alias("accuracy_all"), m.ratio(right, F.count("pred")).alias("accuracy_answered"))


PAIRS_SQL = """with turns as (
  select conv_id as pair_id, case when role = 'user' then 'SUPPORTED' when role = 'assistant' then 'CONTRADICTORY' else 'UNKNOWN' end as gold,
    case when length(text) % 4 = 0 then null when length(text) % 2 = 0 then 'SUPPORTED' else 'CONTRADICTORY' end as pred
  from conversations where turn < 2),
p as (select pair_id, count(*) as k, count(*) filter (where gold = 'SUPPORTED') as s, count(*) filter (where gold = 'CONTRADICTORY') as c, bool_and(coalesce(gold = pred, false)) as both_right from turns group by pair_id)
select count(*) filter (where k = 2 and s = 1 and c = 1) as pairs, count(*) filter (where k = 2 and s = 1 and c = 1 and both_right) as "right",
  case when count(*) filter (where k = 2 and s = 1 and c = 1) > 0 then count(*) filter (where k = 2 and s = 1 and c = 1 and both_right)::double / count(*) filter (where k = 2 and s = 1 and c = 1) end as pair_accuracy from p"""


@query(PAIRS_SQL)
def pair_accuracy(t):
    n = F.length("text")
    gold = F.when(F.col("role") == "user", "SUPPORTED").when(F.col("role") == "assistant", "CONTRADICTORY").otherwise("UNKNOWN")
    pred = F.when(n % 4 == 0, None).when(n % 2 == 0, "SUPPORTED").otherwise("CONTRADICTORY")
    return m.pair_accuracy(t("conversations").where("turn < 2").select(F.col("conv_id").alias("pair_id"), gold.alias("gold"), pred.alias("pred")))


SETS_SQL = """with g as (select l_orderkey, list(distinct l_suppkey % 10) as gold, list(distinct l_partkey % 10) as pred from lineitem group by l_orderkey),
e as (select l_orderkey, len(list_intersect(gold, pred)) as b, len(gold) as ng, len(pred) as np from g)
select l_orderkey as sample_id, b::double / np as precision, b::double / ng as recall, (2 * b)::double / (ng + np) as f1, b = ng and ng = np as exact from e"""


@query(SETS_SQL)
def set_f1(t):
    """Evidence sets of each order: suppliers' last digits against parts' last digits."""
    sets = t("lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("g"), F.collect_set(F.col("l_partkey") % 10).alias("p"))
    return sets.select("sample_id", m.set_scores(F.col("g"), F.col("p")).alias("s")).select("sample_id", "s.*")


CAL_SQL = """with r as (select l_discount * 10 as confidence, case when l_quantity > 25 then 1 else 0 end as correct from lineitem),
b as (select case when confidence < 0.1 then 0 when confidence < 0.2 then 1 when confidence < 0.3 then 2 when confidence < 0.4 then 3 when confidence < 0.5 then 4
  when confidence < 0.6 then 5 when confidence < 0.7 then 6 when confidence < 0.8 then 7 when confidence < 0.9 then 8 else 9 end as bin, confidence, correct from r)
"""


def _confidence(t):
    return t("lineitem").select((F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("correct"))


@query(CAL_SQL + "select bin::bigint as bin, count(*) as n, sum(correct)::bigint as correct, round(avg(confidence), 9) as confidence from b group by bin")
def calibration_bins(t):
    return m.calibration_bins(_confidence(t)).withColumn("confidence", F.round("confidence", 9))


@query(CAL_SQL + ", g as (select bin, count(*) as n, sum(correct) as c, avg(confidence) as a from b group by bin) select round(sum(n * abs(c::double / n - a)) / sum(n), 9) as ece, (select round(avg((confidence - correct) * (confidence - correct)), 9) from b) as brier from g")
def calibration_summary(t):
    rows = _confidence(t)
    bins = m.calibration_bins(rows)
    ece = F.round(F.sum(F.col("n") * F.abs(F.col("correct") / F.col("n") - F.col("confidence"))) / F.sum("n"), 9)
    brier = rows.agg(F.round(F.avg((F.col("confidence") - F.col("correct")) * (F.col("confidence") - F.col("correct"))), 9).alias("brier"))
    return bins.agg(ece.alias("ece")).crossJoin(brier)  # two single rows


@query("with " + SCORED_SQL + """ select lang, count(*) filter (where gold <> 'UNKNOWN') as known, count(*) filter (where gold = 'UNKNOWN') as unknown,
  case when count(*) filter (where gold <> 'UNKNOWN') > 0 then count(*) filter (where gold <> 'UNKNOWN' and gold = pred)::double / count(*) filter (where gold <> 'UNKNOWN') end as known_accuracy,
  case when count(*) filter (where gold = 'UNKNOWN') > 0 then count(*) filter (where gold = 'UNKNOWN' and gold = pred)::double / count(*) filter (where gold = 'UNKNOWN') end as unknown_recall from scored group by lang""")
def known_accuracy_unknown_recall(t):
    known, right = F.col("gold") != "UNKNOWN", F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    return scored(t).groupBy("lang").agg(
        F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"), m.ratio(F.count_if(known & right), F.count_if(known)).alias("known_accuracy"), m.ratio(F.count_if(~known & right), F.count_if(~known)).alias("unknown_recall")
    )


@query("with " + SCORED_SQL + """, p as (select source, n_chars % 20 as slot, bool_and(lang = 'en') as eligible, count(*) as k, count(distinct gold) as golds, bool_and(coalesce(gold = pred, false)) as ok from scored group by all)
select source, count(*) filter (where eligible) as eligible, count(*) filter (where not eligible) as excluded, count(*) filter (where golds > 1) as inconsistent, count(*) filter (where eligible and ok) as detected from p group by source""")
def conditional_detection(t):
    """Groups count only if their condition holds for all members; the others are counted apart."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    p = scored(t).groupBy("source", (F.col("n_chars") % 20).alias("slot")).agg(F.bool_and(F.col("lang") == "en").alias("eligible"), F.count_distinct("gold").alias("golds"), F.bool_and(right).alias("ok"))
    return p.groupBy("source").agg(F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("excluded"), F.count_if(F.col("golds") > 1).alias("inconsistent"), F.count_if(F.col("eligible") & F.col("ok")).alias("detected"))


@query("with " + SCORED_SQL + ", g as (select source, n_chars % 50 as grp, count(*) as k, count(distinct coalesce(pred, 'MISSING')) as labels from scored group by all having count(*) > 1) select source, count(*) as groups, count(*) filter (where labels = 1) as consistent, count(*) filter (where labels = 1)::double / count(*) as consistency from g group by source")
def paraphrase_consistency(t):
    g = scored(t).groupBy("source", (F.col("n_chars") % 50).alias("grp")).agg(F.count("*").alias("k"), F.count_distinct(F.coalesce("pred", F.lit("MISSING"))).alias("labels")).where("k > 1")
    return g.groupBy("source").agg(F.count("*").alias("groups"), F.count_if(F.col("labels") == 1).alias("consistent")).withColumn("consistency", m.ratio(F.col("consistent"), F.col("groups")))


@query("with " + SCORED_SQL + """, r as (select case when gold = 'UNKNOWN' then case when lang = 'en' then 'MISSING_FACT' else 'AMBIGUOUS' end else 'NOT_UNKNOWN' end as gold_reason,
  case when pred = 'UNKNOWN' then case when n_chars % 2 = 0 then 'MISSING_FACT' else 'AMBIGUOUS' end else 'NOT_UNKNOWN' end as pred_reason from scored where gold = 'UNKNOWN')
select n.reason, count(*) filter (where gold_reason = reason) as support, count(*) filter (where gold_reason = reason and pred_reason = reason) as tp, count(*) filter (where gold_reason <> reason and pred_reason = reason) as fp
from r cross join (select unnest(['MISSING_FACT', 'AMBIGUOUS']) as reason) n group by n.reason""")
def unknown_reason_counts(t):
    """Reasons of rows whose gold label is UNKNOWN; any other predicted label has a sentinel reason."""
    u = scored(t).where("gold = 'UNKNOWN'")
    g = F.when(F.col("lang") == "en", "MISSING_FACT").otherwise("AMBIGUOUS")
    p = F.when(F.coalesce(F.col("pred") == "UNKNOWN", F.lit(False)), F.when(F.col("n_chars") % 2 == 0, "MISSING_FACT").otherwise("AMBIGUOUS")).otherwise("NOT_UNKNOWN")
    out = m.label_counts(u.select(g.alias("gold"), p.alias("pred")), [], ("MISSING_FACT", "AMBIGUOUS"))
    return out.select(F.col("label").alias("reason"), "support", "tp", "fp")


@query("with " + SCORED_SQL + """, parts as (select doc_id % 4 as report, label, count(*) filter (where gold = label and pred = label) as tp, count(*) filter (where gold <> label and pred = label) as fp, count(*) filter (where gold = label and pred is distinct from label) as fn
  from scored cross join (select unnest(['SUPPORTED', 'CONTRADICTORY', 'UNKNOWN']) as label) group by all)
select label, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, case when 2 * sum(tp) + sum(fp) + sum(fn) > 0 then (2 * sum(tp))::double / (2 * sum(tp) + sum(fp) + sum(fn)) else 0.0 end as f1 from parts group by label""")
def merged_metrics(t):
    """Counts of partial reports add up; scores are made from the sums."""
    parts = m.label_counts(scored(t).withColumn("report", F.col("doc_id") % 4), ["report"])
    s = parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.withColumn("f1", m.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), "zero"))


@query("with " + SCORED_SQL + ", v as (select *, case when pred is null then case when lang = 'de' then 'UNKNOWN' end else pred end as v3 from scored) select lang, count(*) filter (where pred is null and v3 is not null) as recovered, count(*) filter (where pred is null and v3 = gold) as recovered_right, count(*) filter (where pred is null and v3 is not null and v3 <> gold) as recovered_wrong, count(*) filter (where pred is distinct from v3) as changed from v group by lang")
def rescore_diff(t):
    """What a later reading of the same answers recovers."""
    v3 = F.when(F.col("pred").isNull(), F.when(F.col("lang") == "de", "UNKNOWN")).otherwise(F.col("pred"))
    fresh = F.col("pred").isNull() & F.col("v3").isNotNull()
    return scored(t).withColumn("v3", v3).groupBy("lang").agg(
        F.count_if(fresh).alias("recovered"), F.count_if(fresh & (F.col("v3") == F.col("gold"))).alias("recovered_right"), F.count_if(fresh & (F.col("v3") != F.col("gold"))).alias("recovered_wrong"), F.count_if(~F.col("pred").eqNullSafe(F.col("v3"))).alias("changed")
    )


@query("with " + SCORED_SQL + ", p as (select case when doc_id % 11 = 0 then -doc_id - 1 else doc_id end as doc_id, pred from scored where pred is not null) select 'missing' as code, count(*) as n from scored where doc_id not in (select doc_id from p) union all select 'extra', count(*) from p where doc_id not in (select doc_id from scored)")
def prediction_validation(t):
    """Ids that lack a prediction and predictions that lack an id, by anti joins both ways."""
    gold = scored(t)
    p = gold.where("pred is not null").select(F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"))
    missing, extra = gold.join(p, "doc_id", "left_anti"), p.join(gold, "doc_id", "left_anti")
    return missing.agg(F.lit("missing").alias("code"), F.count("*").alias("n")).union(extra.agg(F.lit("extra").alias("code"), F.count("*").alias("n")))
