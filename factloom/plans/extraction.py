"""Queries that make facts from question-and-answer rows, which are worded from the driver's tables."""

from pyspark.sql import functions as F

from ..functions import extract as x
from .registry import query

QA_SQL = """qa as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity::bigint as q, l_orderkey % 6 as kind from lineitem)"""


def _qa(t):
    """Rows of six tasks; some of each are malformed."""
    k, s, p, q = F.col("l_orderkey") % 6, F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("bigint")
    task = F.element_at(F.array(*map(F.lit, ["relation", "count", "choice_count", "order", "visibility", "caption"])), (k + 1).cast("int"))
    yes = F.when(q % 5 == 0, "maybe").when(q % 2 == 0, "Yes").otherwise("no")
    question = (
        F.when(k == 0, F.concat(F.lit("Is the box "), s, F.lit(" left of the box "), p, F.lit("?"))).when(k == 1, F.concat(F.lit("How many box "), s, F.lit(" are there?"))).when(k == 2, F.concat(F.lit("How many bin "), s, F.lit(" are there?")))
        .when(k == 3, F.concat(F.lit("In what order do s"), s, F.lit(" p"), p, F.lit(" end appear?"))).when(k == 4, F.concat(F.lit("Is there a box "), s, F.lit("?"))).otherwise("Describe it.")
    )
    answer = (
        F.when(k == 0, yes).when(k == 1, F.when(q % 7 == 0, F.concat(F.lit("0"), q.cast("string"))).otherwise(q.cast("string"))).when(k == 2, F.when(q % 7 == 0, "Z").otherwise("B"))
        .when(k == 3, F.concat(F.lit("s"), s, F.lit(", p"), p, F.when(q % 5 == 0, ", start").otherwise(", end"))).when(k == 4, yes).otherwise("text")
    )
    options = F.array(F.concat(F.lit("A. "), (q + 1).cast("string")), F.concat(F.lit("B. "), q.cast("string")), F.when(q % 11 == 0, F.concat(F.lit("C. "), q.cast("string"))).otherwise("C. none"))
    worded = t("lineitem").select("l_orderkey", "l_linenumber", task.alias("task"), F.explode(F.array(F.struct(question.alias("question"), options.alias("options"), answer.alias("answer")))).alias("w"))
    return x.adapted(worded, F.col("task"), F.col("w.question"), F.col("w.options"), F.col("w.answer"))


CODE_SQL = QA_SQL + """, coded as (select *, case kind when 0 then case when q % 5 = 0 then 'ANSWER_NOT_YES_NO' when l_suppkey = l_partkey then 'SELF_RELATION' end
  when 1 then case when q % 7 = 0 then 'RECONSTRUCTION_MISMATCH' end
  when 2 then case when q % 7 = 0 then 'LETTER_WITHOUT_OPTION' when q % 11 = 0 then 'OPTION_NOT_UNIQUE' end
  when 3 then case when q % 5 = 0 then 'ITEM_NOT_IN_QUESTION' end
  when 4 then case when q % 5 = 0 then 'ANSWER_NOT_YES_NO' end else 'TASK_UNSUPPORTED' end as code from qa)"""


@query("with " + CODE_SQL + " select list_extract(['relation', 'count', 'choice_count', 'order', 'visibility', 'caption'], kind + 1) as task, coalesce(code, 'ACCEPTED') as outcome, count(*) as n from coded group by all")
def adapter_outcomes(t):
    """Accepted rows and first reject codes by task."""
    return _qa(t).groupBy("task", F.coalesce("reject_code", "status").alias("outcome")).agg(F.count("*").alias("n"))


@query("with " + CODE_SQL + """ select l_orderkey, l_linenumber, 'box ' || l_suppkey as subject, 'LEFT_OF' as predicate, 'box ' || l_partkey as object, null::bigint as value, case when q % 2 = 0 then 'positive' else 'negative' end as polarity from coded where kind = 0 and code is null
union all select l_orderkey, l_linenumber, case kind when 1 then 'box ' else 'bin ' end || l_suppkey, 'COUNT', null, q, 'positive' from coded where kind in (1, 2) and code is null
union all select l_orderkey, l_linenumber, unnest(['s' || l_suppkey, 'p' || l_partkey]), 'BEFORE', unnest(['p' || l_partkey, 'end']), null, 'positive' from coded where kind = 3 and code is null
union all select l_orderkey, l_linenumber, 'box ' || l_suppkey, 'VISIBLE', null, null, case when q % 2 = 0 then 'positive' else 'negative' end from coded where kind = 4 and code is null""")
def adapter_facts(t):
    """The facts of accepted rows."""
    return _qa(t).select("l_orderkey", "l_linenumber", F.inline("facts"))


@query("with " + CODE_SQL + " select list_extract(['relation', 'count', 'choice_count', 'order', 'visibility', 'caption'], kind + 1) as task, count(*) filter (where code is null)::double / count(*) as rate from coded group by all")
def reconstruction_rate(t):
    return _qa(t).groupBy("task").agg((F.count_if(F.col("status") == "ACCEPTED").cast("double") / F.count("*")).alias("rate"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'REMOVE' when 1 then 'REPLACE' when 2 then 'MOVE' else 'ADD' end as kind, 'part ' || p_partkey as target, case p_partkey % 4 when 1 then 'part 7' when 2 then 'left side' end as "to", case p_size % 3 when 0 then 1 when 1 then 3 when 2 then p_size end::bigint as quantity from part""")
def change_sentences(t):
    """Sentences about changes and the quantities that phrases begin with."""
    name = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("The "), name, F.lit(" has been removed."))).when(k == 1, F.concat(F.lit("Replace the "), name, F.lit(" with a part 7."))).when(k == 2, F.concat(F.lit("The "), name, F.lit(" was moved to the left side."))).otherwise(F.concat(F.lit("Add a "), name, F.lit(".")))
    phrase = F.when(F.col("p_size") % 3 == 0, "an item").when(F.col("p_size") % 3 == 1, "Three items").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" items")))
    return t("part").select("p_partkey", x.change(said).alias("c"), x.quantity(phrase).alias("quantity")).select("p_partkey", "c.*", "quantity")


TRACKS = [("source", "COUNT", "NUMERIC"), ("source", "BEFORE", "TEMPORAL"), ("derived", "BEFORE", "TEMPORAL_DERIVED")]


@query("""select l_orderkey, l_linenumber, case when l_returnflag = 'R' then case when l_linestatus = 'O' then 'TEMPORAL_DERIVED' else 'NO_RULE' end when l_linestatus = 'O' then 'TEMPORAL' else 'NUMERIC' end as track from lineitem""")
def track_rules(t):
    """A table of rules (origin, predicate) to tracks; rows that no rule fits are marked."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "derived").otherwise("source").alias("origin"), F.when(F.col("l_linestatus") == "O", "BEFORE").otherwise("COUNT").alias("predicate"))
    rules = rows.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("origin"), F.lit(b).alias("predicate"), F.lit(c).alias("track")) for a, b, c in TRACKS])))
    return rows.join(F.broadcast(rules), ["origin", "predicate"], "left").select("l_orderkey", "l_linenumber", F.coalesce("track", F.lit("NO_RULE")).alias("track"))
