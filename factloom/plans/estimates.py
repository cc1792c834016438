"""Resampled intervals, interventions, tolerances and ratio caps."""

from pyspark.sql import functions as F

from ..operators import select as s
from ..operators import stats as st
from .frames import SCORED_SQL, scored
from .registry import query

WEIGHT_SQL = " + ".join(f"(u >= {-int(-b * 2**32 // 1)})::int" for b in st.poisson_bounds())


def _drawn_sql(parts: str, cluster: str, repetitions: int) -> str:
    return f"""u as (select *, ('0x' || substr(md5(rep || '|' || {cluster}), 1, 8))::bigint as u from {parts}, range(1, {repetitions + 1}) as t(rep)), w as (select *, {WEIGHT_SQL} as w from u), drawn as (select * from w where w > 0)"""


@query("""with v as (select o_orderstatus as status, o_orderpriority as stratum, o_custkey, case when o_orderkey % 13 > 0 then (o_totalprice > 150000)::int end as value from orders),
sums as (select status, stratum, o_custkey, sum(value) as s, count(*) as n from v where value is not null group by 1, 2, 3), sizes as (select status, stratum, count(*) as m, sum(s) as s, sum(n) as n from sums group by 1, 2),
""" + _drawn_sql("sums", "o_custkey", 200) + """,
a as (select status, stratum, rep, sum(w * s) as a, sum(w * n) as b, sum(w) as k from drawn group by 1, 2, 3), e as (select status, rep, sum(m / k * a) / sum(m / k * b) as e from a join sizes using (status, stratum) group by 1, 2)
select status, round(effect, 9) as effect, clusters, strata, round(low, 9) as low, round(high, 9) as high
from (select status, sum(s) / sum(n) as effect, sum(m)::bigint as clusters, count(*) as strata from sizes group by 1) join (select status, quantile_cont(e, 0.025) as low, quantile_cont(e, 0.975) as high from e group by 1) using (status)""")
def stratified_bootstrap(t):
    """Share of large orders by status, over customers resampled within priorities."""
    v = F.when(F.col("o_orderkey") % 13 > 0, (F.col("o_totalprice") > 150000).cast("int"))
    rows = t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stratum"), "o_custkey", v.alias("value"))
    out = st.stratified_bootstrap(rows, ["status"], "stratum", "o_custkey", "value", 200)
    return out.withColumns({c: F.round(c, 9) for c in ("effect", "low", "high")})


@query("""with v as (select o_orderstatus as status, o_custkey, (o_totalprice > 150000)::int as value, o_orderkey % 997 = 0 as ok from orders),
parts as (select status, o_custkey, coalesce(sum(value) filter (where ok), 0) as s, count(*) filter (where ok) as n from v group by 1, 2), ratios as (select *, case when n > 0 then s / n end as r from parts),
""" + _drawn_sql("ratios", "o_custkey", 200) + """,
e as (select status, rep, sum(w * r) / sum(case when n > 0 then w end) as e from drawn group by 1, 2),
i as (select status, quantile_cont(e, 0.025) as low, quantile_cont(e, 0.975) as high, 1 - count(e) / 200 as empty from e group by 1)
select status, numerator, denominator, clusters, cohort, round(estimate, 9) as estimate, round(low, 9) as low, round(high, 9) as high, round(coalesce(empty, 1), 9) as empty
from (select status, sum(s)::bigint as numerator, sum(n)::bigint as denominator, count(*) filter (where n > 0) as clusters, count(*) as cohort, avg(r) as estimate from ratios group by 1) left join i using (status)""")
def conditional_macro(t):
    """Means of customers' shares over rare eligible orders; draws without any are counted as empty."""
    v = (F.col("o_totalprice") > 150000).cast("int")
    rows = t("orders").select(F.col("o_orderstatus").alias("status"), "o_custkey", v.alias("value"), (F.col("o_orderkey") % 997 == 0).alias("ok"))
    out = st.conditional_macro(rows, ["status"], "o_custkey", "value", F.col("ok"), 200)
    return out.withColumns({c: F.round(c, 9) for c in ("estimate", "low", "high", "empty")})


@query("with " + SCORED_SQL + """, b as (select source, lang, gold, coalesce(gold = pred, false)::int as base, coalesce(gold = case when n_chars % 5 = 0 then gold else pred end, false)::int as inter from scored),
e as (select 'ALL' as field, 'ALL' as grp, * from b union all select 'lang', coalesce(lang, 'null'), * from b union all select 'source', coalesce(source, 'null'), * from b union all select 'gold', gold, * from b),
g as (select field, grp as "group", count(*) as n, count(distinct source) as clusters, count(*) filter (where base = 0 and inter = 1) as rescue, count(*) filter (where base = 1 and inter = 0) as harm, count(*) filter (where base = 0) as base_errors, count(*) filter (where base = 1) as base_successes from e group by 1, 2)
select *, (rescue - harm) / n as net, case when base_errors > 0 then rescue / base_errors end as rescue_given_error, case when base_successes > 0 then harm / base_successes end as harm_given_success from g""")
def intervention_strata(t):
    rows = scored(t)
    base = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    rows = rows.withColumns({"base": base.cast("int"), "inter": (base | (F.col("n_chars") % 5 == 0)).cast("int")})
    return st.intervention_strata(rows, ["lang", "source", "gold"], "base", "inter", "source")


@query("""with a as (select o_orderpriority as metric, round(avg(o_totalprice), 6) as stated from orders where o_orderpriority <> '5-LOW' group by 1), b as (select o_orderpriority as metric, case when o_orderpriority like '2%' then null else avg(o_totalprice) end as found from orders where o_orderpriority <> '1-URGENT' group by 1)
select coalesce(a.metric, b.metric) as metric, case when a.metric is null then 'NOT_STATED' when b.metric is null then 'NOT_FOUND' when stated is null and found is null or abs(stated - found) <= 1e-5 then 'REPRODUCED' else 'DIFFERENT' end as status from a full join b on a.metric = b.metric""")
def reproduced_metrics(t):
    """Stated metrics held against recomputed ones: equal within a tolerance, or both null."""
    mean = t("orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("v"))
    stated = mean.where("metric <> '5-LOW'").select("metric", F.round("v", 6).alias("stated"), F.lit(True).alias("s"))
    found = mean.where("metric <> '1-URGENT'").select("metric", F.when(~F.startswith("metric", F.lit("2")), F.col("v")).alias("found"), F.lit(True).alias("f"))
    same = (F.col("stated").isNull() & F.col("found").isNull()) | (F.abs(F.col("stated") - F.col("found")) <= 1e-5)
    status = F.when(F.col("s").isNull(), "NOT_STATED").when(F.col("f").isNull(), "NOT_FOUND").when(same, "REPRODUCED").otherwise("DIFFERENT")
    return stated.join(found, "metric", "full").select("metric", status.alias("status"))


@query("""with o as (select o_orderkey, o_orderstatus <> 'P' and o_orderpriority = '5-LOW' as flag, row_number() over (order by o_orderkey) as rn from orders),
c as (select *, sum(flag::int) over (order by rn) as n, sum((not flag)::int) over (order by rn) as plain from o), d as (select *, case when flag then 15 * plain::bigint // 85 - n end as slack from c),
m as (select *, min(slack) over (order by rn rows between unbounded preceding and 1 preceding) as low from d) select o_orderkey, flag, not flag or slack >= least(0, coalesce(low, 0)) as taken from m""")
def ratio_capped(t):
    """Orders in key order; urgent rows of a kind stay at most 15 % of all taken so far."""
    rows = t("orders").select("o_orderkey", ((F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") == "5-LOW")).alias("flag"))
    return s.ratio_capped(rows, ["o_orderkey"], "flag", 15, 100)


@query("""with j as (select o_orderpriority as model, avg(o_totalprice) / 5000 as seconds, count(*) as n from orders group by 1), d as (select *, greatest(4, ceil(seconds * n * 1.75 / (2 * 3600 - 1800))) as desired, least(n, 50) as most from j),
s as (select *, least(desired, most)::bigint as shards from d) select model, n, shards, round((seconds * n / shards * 1.75 + 1800) / 3600, 6) as hours, (seconds * n / shards * 1.75 + 1800) / 3600 > 2 as continued from s""")
def shard_budget(t):
    """Shards of a run from measured seconds a request, a margin of 1.75, start-up of half an hour and the limits of a site."""
    j = t("orders").groupBy(F.col("o_orderpriority").alias("model")).agg((F.avg("o_totalprice") / 5000).alias("seconds"), F.count("*").alias("n"))
    work = F.col("seconds") * F.col("n")
    shards = F.least(F.greatest(F.lit(4), F.ceil(work * 1.75 / (2 * 3600 - 1800))), F.least("n", F.lit(50))).cast("bigint")
    hours = (work / F.col("shards") * 1.75 + 1800) / 3600
    return j.withColumn("shards", shards).select("model", "n", "shards", F.round(hours, 6).alias("hours"), (hours > 2).alias("continued"))
