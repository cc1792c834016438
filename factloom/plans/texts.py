"""Text and parsing queries."""

from pyspark.sql import functions as F

from ..functions import parse as p
from ..functions import text as x
from ..functions.canon import slug
from .frames import FACTS_SQL, facts
from .registry import query


@query("select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from part")
def slugify(t):
    return t("part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


@query("""with v as (select p_partkey, ['The ', 'an a ', 'A  the ', 'THE A AN ', 'Straße ', '']::varchar[] as front, p_name from part),
w as (select p_partkey, trim(regexp_replace(replace(lower(front[1 + p_partkey % 6] || p_name || '!'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) as a from v),
x as (select p_partkey, case when starts_with(a, 'the ') then substr(a, 5) else a end as a from w), y as (select p_partkey, case when starts_with(a, 'a ') then substr(a, 3) else a end as a from x)
select p_partkey, case when starts_with(a, 'an ') then substr(a, 4) else a end as reference from y""")
def normalise_reference(t):
    front = F.element_at(F.array(*map(F.lit, ("The ", "an a ", "A  the ", "THE A AN ", "Straße ", ""))), (1 + F.col("p_partkey") % 6).cast("int"))
    return t("part").select("p_partkey", x.normalise_reference(F.concat(front, "p_name", F.lit("!"))).alias("reference"))


@query("select p_partkey, upper(substr('ABCD', 1 + p_partkey % 4, 1)) as letter, p_type as answer from part")
def option_parse(t):
    """``A. text`` options as a map from letter to text, and a look-up in it."""
    letter = F.substring(F.lit("ABCD"), (1 + F.col("p_partkey") % 4).cast("int"), F.lit(1))
    option = F.concat(letter, F.lit(". "), F.col("p_type"))
    options = F.map_from_entries(F.transform(F.array(option), lambda o: F.struct(F.regexp_extract(o, r"^([A-Z])\. ", 1), F.regexp_extract(o, r"^[A-Z]\. (.*)$", 1))))
    return t("part").select("p_partkey", letter.alias("letter"), F.element_at(options, letter).alias("answer"))


TEXT_SQL = "with " + FACTS_SQL + """, said as (select world, ordinal, subject, object, predicate, replace(replace(replace(replace(case ordinal % 3 when 0 then 'In world {w}, supplier {s} {p} supplier {o}.' when 1 then 'Supplier {s} {p} supplier {o} in world {w}.' else 'World {w}: supplier {s} {p} supplier {o}.' end,
  '{w}', world::varchar), '{s}', subject::varchar), '{p}', 'ships before'), '{o}', object::varchar) as text from facts)
"""


def _said(t):
    f = facts(t)
    template = F.element_at(F.array(*map(F.lit, x.TEMPLATES)), (F.col("ordinal") % 3 + 1).cast("int"))
    return f.select("world", "ordinal", "subject", "object", "predicate", x.render(template, F.col("world"), F.col("subject"), F.col("predicate"), F.col("object")).alias("text"))


@query(TEXT_SQL + "select world, ordinal, text from said")
def template_realise(t):
    return _said(t).select("world", "ordinal", "text")


@query(TEXT_SQL + "select world, ordinal, subject, predicate, object from said")
def inverse_parse(t):
    """Sentences read back; the SQL has the facts that they were made from."""
    return _said(t).select("ordinal", x.parse_sentence(F.col("text")).alias("a")).select("ordinal", "a.world", "a.subject", "a.predicate", "a.object")


@query(TEXT_SQL + "select count(*) as n, count(*) as same, (max(length(text)) - min(length(text)))::bigint as spread from said")
def text_round_trip(t):
    said = _said(t).withColumn("a", x.parse_sentence(F.col("text")))
    same = F.struct("world", "subject", "predicate", "object") == F.struct("a.world", "a.subject", "a.predicate", "a.object")
    return said.agg(F.count("*").alias("n"), F.count_if(same).alias("same"), (F.max(F.length("text")) - F.min(F.length("text"))).cast("bigint").alias("spread"))


@query(TEXT_SQL + "select world, ordinal, (strpos(text, 'supplier ' || object) - 1)::bigint as object_start, (length(text) - strpos(reverse(text), '.'))::bigint as last_dot from said")
def alignment_spans(t):
    """First place of the object and last place of the full stop, from 0."""
    last = F.length("text") - F.locate(".", F.reverse("text"))
    return _said(t).select("world", "ordinal", (F.position(F.concat(F.lit("supplier "), F.col("object").cast("string")), F.col("text")) - 1).cast("bigint").alias("object_start"), last.cast("bigint").alias("last_dot"))


@query("""with w as (select conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from conversations where turn < 2),
g as (select conv_id, turn, case when len(ws) >= 2 then list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) else []::varchar[] end as grams from w),
p as (select conv_id, any_value(grams) filter (where turn = 0) as a, any_value(grams) filter (where turn = 1) as b, count(*) as k from g group by conv_id)
select conv_id, case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end as jaccard from p where k = 2""")
def bigram_jaccard(t):
    """Shared bigrams of the first two turns of each conversation."""
    grams = t("conversations").where("turn < 2").select("conv_id", "turn", x.ngrams(x.words(F.col("text")), 2).alias("g"))
    pick = lambda k: F.max(F.when(F.col("turn") == k, F.col("g")))
    pairs = grams.groupBy("conv_id").agg(pick(0).alias("a"), pick(1).alias("b"), F.count("*").alias("k")).where("k = 2")
    return pairs.select("conv_id", x.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query(r"""select lang, count(*) filter (where regexp_matches(text, '(^|[^a-z])(the the|a a|an an|la la|le le|die die)([^a-z]|$)')) as double_article, count(*) filter (where regexp_matches(text, 'fact:[0-9a-f]{24}')) as leaked_id, count(*) filter (where regexp_matches(text, '(^|[^a-z])(not|no|nicht|pas)([^a-z]|$)')) as negation from documents group by lang""")
def text_lints(t):
    has = lambda pattern: F.count_if(F.col("text").rlike(pattern))
    return t("documents").groupBy("lang").agg(has(r"(^|[^a-z])(the the|a a|an an|la la|le le|die die)([^a-z]|$)").alias("double_article"), has("fact:[0-9a-f]{24}").alias("leaked_id"), has(r"(^|[^a-z])(not|no|nicht|pas)([^a-z]|$)").alias("negation"))


RAW_SQL = """case event_id % 5 when 0 then '{"label": "SUPPORTED", "why": 1}' when 1 then '```json' || chr(10) || '{"label": "UNKNOWN"}' || chr(10) || '```' when 2 then '{"label": "SUPPORTED", "label": "UNKNOWN"}' when 3 then '{"label": "CONTRADICTORY", "why": "cut o' else '{"why": "no label"}' end"""


def _raw():
    k = F.col("event_id") % 5
    return (
        F.when(k == 0, '{"label": "SUPPORTED", "why": 1}').when(k == 1, '```json\n{"label": "UNKNOWN"}\n```').when(k == 2, '{"label": "SUPPORTED", "label": "UNKNOWN"}').when(k == 3, '{"label": "CONTRADICTORY", "why": "cut o').otherwise('{"why": "no label"}')
    )


@query("select event_id, case event_id % 5 when 0 then 'SUPPORTED' when 1 then 'UNKNOWN' when 3 then 'CONTRADICTORY' end as label from events")
def label_recover(t):
    """Labels of whole, fenced, truncated and repeated answers."""
    return t("events").select("event_id", p.recovered_label(p.without_fence(_raw())).alias("label"))


@query("select event_id, case when event_id % 5 = 1 then '{\"label\": \"UNKNOWN\"}' else " + RAW_SQL + " end as answer from events")
def fence_removal(t):
    return t("events").select("event_id", p.without_fence(_raw()).alias("answer"))


@query("select event_id, case event_id % 5 when 1 then 'NOT_JSON' when 2 then 'REPEATED_KEY' when 3 then 'NOT_JSON' else 'OK' end as status, json_keys(props) as props_keys from events")
def strict_json(t):
    """Answers and event properties read strictly."""
    out = t("events").select("event_id", p.strict_json(_raw()).alias("raw"), p.strict_json(F.col("props")).alias("props"))
    return out.select("event_id", F.col("raw.status").alias("status"), F.col("props.keys").alias("props_keys"))


@query("select o_orderkey, list_filter(['status', 'priority', 'customer'], lambda s: case s when 'status' then o_orderstatus <> 'O' when 'priority' then left(o_orderpriority, 1) <> '1' else o_custkey % 2 <> 0 end) as changed from orders")
def changed_slots(t):
    """Slots whose values differ between two versions."""
    slot = lambda name, differs: F.when(differs, F.lit(name))
    return t("orders").select("o_orderkey", F.array_compact(F.array(slot("status", F.col("o_orderstatus") != "O"), slot("priority", F.substring("o_orderpriority", 1, 1) != "1"), slot("customer", F.col("o_custkey") % 2 != 0))).alias("changed"))


@query("select n_nationkey, [lower(n_name), case when regexp_matches(lower(n_name), '[^aeiou]y$') then regexp_replace(lower(n_name), 'y$', 'ies') when regexp_matches(lower(n_name), '(s|x|z|ch|sh)$') then lower(n_name) || 'es' else lower(n_name) || 's' end] as forms from nation")
def plural_forms(t):
    return t("nation").select("n_nationkey", x.plural_forms(F.lower("n_name")).alias("forms"))


@query("select o_orderkey, 'status=' || o_orderstatus || chr(10) || 'customer=' || o_custkey as state, o_custkey::varchar as customer from orders")
def state_round_trip(t):
    """State lines written and read back through a map; repeated fields make the sizes differ."""
    state = F.concat(F.lit("status="), "o_orderstatus", F.lit("\n"), F.lit("customer="), F.col("o_custkey").cast("string"))
    fields = F.map_from_entries(F.transform(F.split(state, "\n"), lambda line: F.struct(F.substring_index(line, "=", 1), F.substring_index(line, "=", -1))))
    return t("orders").select("o_orderkey", state.alias("state"), F.element_at(fields, F.lit("customer")).alias("customer"))
