"""Driver tables as the engine's inputs: gold and predicted labels, pairs, facts and worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORED_SQL = """
scored as (
  select d.doc_id, d.lang, d.source, d.n_chars,
    case when l.quality = 1 then 'SUPPORTED' when l.quality = 0 then 'CONTRADICTORY' else 'UNKNOWN' end as gold,
    case when d.doc_id % 7 = 0 then null when d.n_chars % 3 = 0 then 'CONTRADICTORY' when d.lang = 'en' then 'SUPPORTED'
         when d.n_chars % 3 = 1 then 'UNKNOWN' else 'SUPPORTED' end as pred
  from documents d left join labels l on d.doc_id = l.doc_id
)"""


def scored(t) -> DataFrame:
    """Documents with a gold label from ``labels`` and a rule for a prediction, absent for some."""
    d, quality = t("documents").drop("text"), F.col("quality")
    gold = F.when(quality == 1, "SUPPORTED").when(quality == 0, "CONTRADICTORY").otherwise("UNKNOWN")
    third = F.col("n_chars") % 3
    pred = F.when(F.col("doc_id") % 7 == 0, None).when(third == 0, "CONTRADICTORY").when(F.col("lang") == "en", "SUPPORTED").when(third == 1, "UNKNOWN").otherwise("SUPPORTED")
    return d.join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", gold.alias("gold"), pred.alias("pred"))


FACTS_SQL = """
ordered as (
  select l_orderkey, l_suppkey, l_linenumber,
    lead(l_suppkey) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_suppkey, l_partkey, l_extendedprice) as nxt
  from lineitem
),
facts as (
  select l_orderkey as world, 'BEFORE' as predicate, l_suppkey as subject, nxt as object, l_linenumber as ordinal
  from ordered where nxt is not null and nxt <> l_suppkey
)"""


def facts(t) -> DataFrame:
    """BEFORE facts of a world (an order): its suppliers in order of shipping."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    rows = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.lead("l_suppkey").over(order).alias("object"))
    rows = rows.where("object is not null and object <> l_suppkey")
    return rows.select(F.col("l_orderkey").alias("world"), F.lit("BEFORE").alias("predicate"), F.col("l_suppkey").alias("subject"), "object", F.col("l_linenumber").alias("ordinal"))
