"""Join, profiling, audit and statistics queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import stats as st
from ..operators.metrics import ratio
from .frames import SCORED_SQL, scored
from .registry import query


@query("select c_custkey, n_name, case when n_nationkey is null then 'MISSING_MAPPING' end as reject_code from customer left join (select * from nation where n_nationkey % 4 <> 0) on c_nationkey = n_nationkey")
def join_with_reject(t):
    n = t("nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return j.join_or_reject(t("customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"], "MISSING_MAPPING").select("c_custkey", "n_name", "reject_code")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def last_wins(t):
    return j.last_wins(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("with one as (select s_nationkey, min(s_name) as s_name from supplier group by 1 having count(*) = 1) select n_nationkey, s_name from nation left join one on s_nationkey = n_nationkey")
def unique_lookup(t):
    s = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return j.unique_lookup(t("nation").select("n_nationkey"), s, ["n_nationkey"], "s_name")


@query("select 'left' as side, doc_id from documents where doc_id not in (select doc_id from labels) union all select 'right', doc_id from labels where doc_id not in (select doc_id from documents)")
def id_set_equality(t):
    return j.key_differences(t("documents"), t("labels"), "doc_id")


@query("select l_orderkey, l_suppkey, count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000) and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by all")
def semi_and_anti(t):
    """An allow list by semi join and an exclusion by anti join."""
    allowed, closed = t("supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")), t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").select("l_orderkey", "l_suppkey").join(allowed, "l_suppkey", "left_semi").join(closed, "l_orderkey", "left_anti").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("""with r as (select c_mktsegment as grp, c_custkey, c_nationkey, row_number() over (partition by c_mktsegment order by sha256('13' || chr(0) || c_custkey), c_custkey) as k from customer)
select a.c_custkey, (select b.c_custkey from r b where b.grp = a.grp and b.k > a.k and b.c_nationkey <> a.c_nationkey order by b.k limit 1) as donor from r a""")
def next_donor(t):
    """The next row in seeded order from another world."""
    from ..functions.canon import seeded_hash

    rows = t("customer").select(F.col("c_mktsegment").alias("grp"), "c_custkey", "c_nationkey", seeded_hash(13, F.col("c_custkey")).alias("key"))
    return j.next_other(rows, ["key", "c_custkey"], "c_nationkey", "c_custkey").select("c_custkey", "donor")


@query("with b as (select l_suppkey as grp, l_linenumber as lo, l_linenumber + l_quantity / 50 as hi from lineitem) select a.grp, count(*) as pairs from b a join b c on a.grp = c.grp and a.hi + 0.02 < c.lo group by a.grp")
def range_separation(t):
    """Pairs of intervals of a supplier where one ends before the other begins, counted by one ordered pass."""
    b = t("lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").cast("double").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity") / 50).alias("hi"))
    return j.separated_within(b, "grp", "lo", "hi", 0.02).where("pairs > 0")


@query("select coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v, case when a.v is not null then 'first' else 'second' end as origin from (select s_suppkey as k, s_name as v from supplier where s_suppkey % 2 = 0) a full join (select s_suppkey as k, 'x' || s_suppkey as v from supplier where s_suppkey % 3 = 0) b on a.k = b.k")
def tiered_merge(t):
    s = t("supplier")
    return j.prefer(s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("v")), "k", "v")


@query("""with m as (select o_orderkey, o_custkey, o_orderpriority as claim, o_orderstatus as gold from orders), a as (select o_custkey, claim, min(gold) as gold, count(*) as k from m where o_orderkey % 2 = 0 group by all having count(*) = 1), b as (select o_custkey, claim, min(gold) as gold, count(*) as k from m where o_orderkey % 2 = 1 group by all having count(*) = 1)
select a.o_custkey, a.claim, a.gold as base, b.gold as intervention from a join b on a.o_custkey = b.o_custkey and a.claim = b.claim""")
def matched_pairs(t):
    """Rows of two conditions with the same key, where each side has just one."""
    m = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("claim"), F.col("o_orderstatus").alias("gold"))
    side = lambda k, name: m.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey", "claim").agg(F.count("*").alias("k"), F.min("gold").alias(name)).where("k = 1").drop("k")
    return side(0, "base").join(side(1, "intervention"), ["o_custkey", "claim"])


@query("""with b as (select page_id, url, regexp_replace(url, '^.*/', '') as base from pages), r as (select benchmark.item_id, item_id::varchar as base from benchmark), u as (select base from b group by base having count(*) = 1)
select r.item_id, b.page_id from r join u using (base) join b using (base)""")
def path_suffix_match(t):
    """Items that the last part of exactly one path names."""
    b = t("pages").select("page_id", F.regexp_replace("url", "^.*/", "").alias("base"))
    one = b.groupBy("base").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")).where("n = 1")
    return t("benchmark").select("item_id", F.col("item_id").cast("string").alias("base")).join(one, "base").select("item_id", "page_id")


@query("""with n as (select n_nationkey, lower(n_name) as label, regexp_extract_all(lower(n_name), '[a-z0-9]+') as ws from nation), q as (select r_regionkey, lower(string_agg(n_name, ' and ' order by n_name)) as text from region join nation on r_regionkey = n_regionkey group by 1),
m as (select r_regionkey, label, len(ws) as k from q join n on regexp_matches(' ' || text || ' ', '[^a-z0-9]' || label || '[^a-z0-9]')), x as (select r_regionkey, max(k) as k from m group by 1)
select r_regionkey, case when count(*) = 1 then min(label) end as label, count(*) as ties from m join x using (r_regionkey, k) group by 1""")
def longest_label(t):
    """The label with most words that stands in a text as whole words; ties give none. Labels are a small table."""
    n = t("nation").select(F.lower("n_name").alias("label"), F.size(F.regexp_extract_all(F.lower("n_name"), F.lit("[a-z0-9]+"), F.lit(0))).alias("k"))
    q = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey").agg(F.concat(F.lit(" "), F.lower(F.array_join(F.array_sort(F.collect_list("n_name")), " and ")), F.lit(" ")).alias("text"))
    hits = q.join(F.broadcast(n), F.rlike("text", F.concat(F.lit("[^a-z0-9]"), F.col("label"), F.lit("[^a-z0-9]"))))
    ranked = hits.withColumn("top", F.max("k").over(Window.partitionBy("r_regionkey"))).where("k = top")
    return ranked.groupBy("r_regionkey").agg(F.when(F.count("*") == 1, F.min("label")).alias("label"), F.count("*").alias("ties"))


# profiling

@query("select event_type as value, count(*) as n from events group by 1 union all select '<NULL>', count(*) from events where props is null having count(*) > 0")
def profile_distribution(t):
    return t("events").groupBy(F.coalesce("event_type", F.lit("<NULL>")).alias("value")).agg(F.count("*").alias("n"))


@query("select user_id, n from (select user_id, count(*) as n, min(event_id) as f from events group by 1) order by n desc, f limit 10")
def top_n_counts(t):
    """The commonest values; ties go to the one seen first."""
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("f")).orderBy(F.desc("n"), "f").limit(10).drop("f")


@query("select lang, count(*) as n, count(*) filter (where quality is null)::double / count(*) as quality_missing, count(*) filter (where text is null or text = '')::double / count(*) as text_missing from documents left join labels using (doc_id) group by lang")
def missing_rate(t):
    d = t("documents").select("doc_id", "lang", (F.coalesce("text", F.lit("")) == "").alias("empty")).join(t("labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), ratio(F.count_if(F.col("quality").isNull()), F.count("*")).alias("quality_missing"), ratio(F.count_if("empty"), F.count("*")).alias("text_missing"))


@query("select source, count(*) as n, 1 - count(distinct sha256(text))::double / count(*) as duplicate_rate from documents group by source")
def duplicate_rate(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), (1 - ratio(F.count_distinct(F.sha2("text", 256)), F.count("*"))).alias("duplicate_rate"))


@query("with w as (select l_orderkey, count(*) as n, count(distinct l_suppkey) as s from lineitem group by 1) select count(*) as worlds, max(n) as max_facts, sum(n)::double / count(*) as mean_facts, max(s) as max_subjects from w")
def density_per_world(t):
    w = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("s"))
    return w.agg(F.count("*").alias("worlds"), F.max("n").alias("max_facts"), ratio(F.sum("n"), F.count("*")).alias("mean_facts"), F.max("s").alias("max_subjects"))


@query("select lang, count(*) as n, min(n_chars) as low, median(n_chars)::double as middle, max(n_chars) as high, sum(n_chars)::double / count(*) as mean from documents group by lang")
def duration_summary(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.median("n_chars").alias("middle"), F.max("n_chars").alias("high"), ratio(F.sum("n_chars"), F.count("*")).alias("mean"))


@query("select n_nationkey, c_mktsegment from nation cross join (select distinct c_mktsegment from customer) where (n_nationkey, c_mktsegment) not in (select c_nationkey, c_mktsegment from customer where c_acctbal > 8000)")
def expected_links(t):
    """Links that a small product of two key sets expects and the data lack."""
    wanted = t("nation").select("n_nationkey").crossJoin(F.broadcast(t("customer").select("c_mktsegment").distinct()))
    return wanted.join(t("customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"), ["n_nationkey", "c_mktsegment"], "left_anti")


@query("""select case when regexp_full_match(v, '[0-9]+') then 'integer' when lower(v) in ('yes', 'no') then 'yes_no' else 'open' end as bucket, count(*) as n from (select unnest([p_size::varchar, p_brand, case when p_size % 2 = 0 then 'Yes' else 'no' end]) as v from part) group by 1""")
def answer_type_buckets(t):
    v = t("part").select(F.explode(F.array(F.col("p_size").cast("string"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no"))).alias("v"))
    return v.groupBy(F.when(F.col("v").rlike("^[0-9]+$"), "integer").when(F.lower("v").isin("yes", "no"), "yes_no").otherwise("open").alias("bucket")).agg(F.count("*").alias("n"))


@query("select coalesce(lang, 'ALL') as lang, coalesce(source, 'ALL') as source, count(*) as n from documents group by grouping sets ((lang, source), (lang), ())")
def grouping_cells(t):
    from pyspark.sql.functions import col

    d = t("documents").select("lang", "source")
    return d.groupingSets([[col("lang"), col("source")], [col("lang")], []], "lang", "source").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "n")


@query("with " + SCORED_SQL + ", p as (select lang, (coalesce(gold = pred, false))::int::varchar || (n_chars % 2)::varchar || (doc_id % 3 = 0)::int::varchar as pattern from scored) select lang, pattern, count(*) as n from p group by all")
def pattern_histogram(t):
    """Which of several models are right together."""
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("string")
    return scored(t).groupBy("lang", F.concat(bit(F.col("gold") == F.col("pred")), (F.col("n_chars") % 2).cast("string"), bit(F.col("doc_id") % 3 == 0)).alias("pattern")).agg(F.count("*").alias("n"))


@query("with " + SCORED_SQL + ", s as (select lang, doc_id % 3 as seed, count(*) filter (where gold = pred)::double / count(*) as a from scored group by all) select lang, round(avg(a), 9) as mean, round(stddev_samp(a), 9) as sd, count(*) as seeds from s group by lang having count(*) = 3")
def mean_and_sd(t):
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    s = scored(t).groupBy("lang", (F.col("doc_id") % 3).alias("seed")).agg(ratio(F.count_if(right), F.count("*")).alias("a"))
    return s.groupBy("lang").agg(F.round(F.avg("a"), 9).alias("mean"), F.round(F.stddev_samp("a"), 9).alias("sd"), F.count("*").alias("seeds")).where("seeds = 3")


# audits

@query("with s as (select doc_id, sha256(text) as h, case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'dev' else 'test' end as split from documents) select h as digest, count(*) as n, list_sort(list(distinct split)) as splits from s group by h having count(distinct split) > 1")
def split_leakage(t):
    """Texts whose digest stands in more than one split."""
    d = F.col("doc_id") % 10
    s = t("documents").select(F.sha2("text", 256).alias("digest"), F.when(d < 6, "train").when(d < 8, "dev").otherwise("test").alias("split"))
    return s.groupBy("digest").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


@query("with s as (select lang || ':' || sha256(lower(trim(text))) as surface, doc_id % 3 as split from documents) select surface, count(*) as n, count(distinct split) as splits from s group by 1 having count(distinct split) > 1")
def duplicate_surfaces(t):
    """Whole texts, but for case and outer spaces, that stand in several splits."""
    s = t("documents").select(F.concat("lang", F.lit(":"), F.sha2(F.lower(F.trim("text")), 256)).alias("surface"), (F.col("doc_id") % 3).alias("split"))
    return s.groupBy("surface").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits")).where("splits > 1")


@query("with " + SCORED_SQL + ", c as (select source, lang, gold, count(*) as n from scored group by all), m as (select source, lang, max(n) as top, sum(n) as n from c group by all) select sum(n)::bigint as n, sum(top)::bigint as majority, sum(top)::double / sum(n)::double as bound from m")
def conditional_majority(t):
    """The accuracy of the best guess from source and language alone."""
    m = scored(t).groupBy("source", "lang", "gold").agg(F.count("*").alias("n")).groupBy("source", "lang").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return m.agg(F.sum("n").alias("n"), F.sum("top").alias("majority"), ratio(F.sum("top"), F.sum("n")).alias("bound"))


@query("""select 'DUPLICATE_ID' as gate, (count(*) - count(distinct doc_id))::bigint as failures from documents union all select 'EMPTY_TEXT', count(*) from documents where coalesce(text, '') = '' union all select 'BAD_LENGTH', count(*) from documents where n_chars <> length(text) union all select 'LABEL_WITHOUT_TEXT', count(*) from labels where doc_id not in (select doc_id from documents)""")
def gate_codes(t):
    d = t("documents")
    counts = d.agg((F.count("*") - F.count_distinct("doc_id")).alias("DUPLICATE_ID"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("EMPTY_TEXT"), F.count_if(F.col("n_chars") != F.length("text")).alias("BAD_LENGTH"))
    orphans = t("labels").join(d.select("doc_id"), "doc_id", "left_anti").agg(F.lit("LABEL_WITHOUT_TEXT").alias("gate"), F.count("*").alias("failures"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).alias("failures")) for c in counts.columns]))).unionByName(orphans)


@query("""with c as (select o_orderkey, unnest(list_filter([case when o_totalprice > 300000 then 'PRICE' end, case when o_orderkey % 9 = 0 then 'KEY' end], lambda x: x is not null)) as code from orders),
r as (select *, row_number() over (partition by code order by o_orderkey) as k, count(*) over (partition by code) as n from c) select code, any_value(n) as n, list(o_orderkey order by o_orderkey) as examples from r where k <= 10 group by code""")
def failure_examples(t):
    """How often each code fails, with the first ten ids, by a bounded rank in each code."""
    codes = F.array_compact(F.array(F.when(F.col("o_totalprice") > 300000, "PRICE"), F.when(F.col("o_orderkey") % 9 == 0, "KEY")))
    c = t("orders").select("o_orderkey", F.explode(codes).alias("code"))
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("o_orderkey"))).where("k <= 10")
    return c.groupBy("code").agg(F.count("*").alias("n")).join(first.groupBy("code").agg(F.sort_array(F.collect_list("o_orderkey")).alias("examples")), "code")


@query("with r as (select p_partkey - 1 as idx, (p_partkey - 1) % 8 as shard from part), got as (select p_partkey - 1 as idx, (p_partkey - 1) % 8 as shard from part where p_partkey % 50 <> 0) select r.shard, count(*) as expected, count(got.idx) as present, count(*) - count(got.idx) as missing from r left join got on r.idx = got.idx and r.shard = got.shard group by 1")
def shard_completeness(t):
    """Rows of each stride against those that came back."""
    r = t("part").select((F.col("p_partkey") - 1).alias("idx")).withColumn("shard", F.col("idx") % 8)
    got = r.where("(idx + 1) % 50 <> 0").withColumn("here", F.lit(1))
    return r.join(got, ["idx", "shard"], "left").groupBy("shard").agg(F.count("*").alias("expected"), F.count("here").alias("present")).withColumn("missing", F.col("expected") - F.col("present"))


# statistics

@query("with c as (select source, lang, count(*) as n from documents group by all), s as (select source, sum(n) as total from c group by 1) select source, round(-sum(n / total * log2(n / total)), 9) as bits, count(*) as kinds from c join s using (source) group by source")
def entropy_by_source(t):
    return st.entropy(t("documents"), "source", "lang").select("source", F.round("bits", 9).alias("bits"), "kinds")


@query("with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars) as k, count(*) over (partition by lang) as n from documents) select lang, max(case when k = ceil(0.5 * n) then n_chars end) as p50, max(case when k = ceil(0.9 * n) then n_chars end) as p90 from r group by lang")
def quantile_nearest_rank(t):
    """Values at rank ceil(q n): no interpolation."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by n_chars)").cast("bigint")
    return t("documents").groupBy("lang").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) as low, round(quantile_cont(l_extendedprice, 0.975), 6) as high from lineitem group by 1")
def percentile_interpolated(t):
    p = st.percentiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", low=0.025, high=0.975)
    return p.select("l_returnflag", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""with k as (select lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents), c as (select lang, token, count(*) as n from k group by all), d as (select token, count(*) as df from c group by 1)
select lang, token, n, round(sqrt(n) * (0.25 + ln(5 / (df + 0.5))) * (0.25 + ln(5 / (df + 0.5))), 6) as salience from c join d using (token)""")
def token_salience(t):
    """Tokens that mark a group against the others."""
    return st.salience(t("documents"), "lang", "text", 4).select("lang", "token", "n", F.round("salience", 6).alias("salience"))


@query("with " + SCORED_SQL + ", b as (select source, coalesce(gold = pred, false) as base, coalesce(gold = case when n_chars % 5 = 0 then gold else pred end, false) as inter from scored) select source, count(*) as n, count(*) filter (where not base and inter) as rescue, count(*) filter (where base and not inter) as harm, (count(*) filter (where not base and inter) - count(*) filter (where base and not inter))::double / count(*) as net from b group by source")
def rescue_harm(t):
    """Rows that an intervention sets right or wrong."""
    s = scored(t)
    base = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    inter = base | (F.col("n_chars") % 5 == 0)
    r, h = F.count_if(~base & inter), F.count_if(base & ~inter)
    return s.groupBy("source").agg(F.count("*").alias("n"), r.alias("rescue"), h.alias("harm"), ratio(r - h, F.count("*")).alias("net"))


@query()
def cluster_bootstrap(t):
    """Accuracy by language with a percentile interval over resampled sources."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("double")
    return st.cluster_bootstrap(scored(t).withColumn("value", right), ["lang"], "source", "value", repetitions=1000)


@query()
def conditional_endpoint_bootstrap(t):
    """The same where only some rows count: others leave numerator and denominator."""
    right = F.when(F.col("gold") != "UNKNOWN", F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("double"))
    return st.cluster_bootstrap(scored(t).withColumn("value", right), ["lang"], "source", "value", repetitions=1000)
