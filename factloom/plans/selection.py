"""Ordering, sampling and quota queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.canon import digest_byte, seeded_hash
from ..operators import quota as q
from ..operators import select as s
from .registry import query


@query("""with k as (select c_custkey, sha256('7' || chr(0) || c_custkey::varchar) as h from customer), n as (select count(*) as n from customer),
r as (select c_custkey, row_number() over (order by h, c_custkey) as rank from k)
select c_custkey, rank, case when rank <= round_even(n * 0.6, 0) then 'train' when rank <= round_even(n * 0.6, 0) + round_even(n * 0.15, 0) then 'dev' else 'test' end as split from r, n""")
def seeded_split(t):
    """Worlds in seeded order, split 60 / 15 / 25."""
    return s.ratio_split(t("customer").select("c_custkey"), "c_custkey", 7)


@query("""select c_mktsegment, c_nationkey, c_custkey, rank from (select *, row_number() over (partition by c_mktsegment, c_nationkey order by sha256('11' || chr(0) || c_custkey::varchar), c_custkey) as rank from customer) where rank <= 2""")
def topk_per_group_hash(t):
    return s.top_by_hash(t("customer").select("c_mktsegment", "c_nationkey", "c_custkey"), ["c_mktsegment", "c_nationkey"], "c_custkey", 2, 11)


@query("""with r as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as turn from supplier) select s_nationkey, s_suppkey, turn, row_number() over (order by turn, s_nationkey) as position from r""")
def round_robin_interleave(t):
    return s.interleave(t("supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")


@query("""with w as (select c_mktsegment as k, count(*) as w from customer group by 1), x as (select k, w * 97 as top, (select sum(w) from w)::bigint as total from w),
b as (select k, top // total as base, top % total as rest from x), r as (select *, row_number() over (order by rest desc, k) as rank, (97 - (select sum(base) from b))::bigint as spare from b)
select k as segment, (base + case when rank <= spare then 1 else 0 end)::bigint as seats from r""")
def apportion_largest_remainder(t):
    weights = t("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("w"))
    return s.apportion(weights, "segment", "w", 97)


@query("""select l_orderkey, l_linenumber, l_suppkey, rank from (select l_orderkey, l_linenumber, l_suppkey, row_number() over (partition by l_suppkey order by sha256('3' || chr(0) || l_orderkey || '-' || l_linenumber), l_orderkey, l_linenumber) as rank from lineitem) where rank <= 5""")
def single_cap_quota(t):
    """One cap is a rank: at most five line items of a supplier."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", seeded_hash(3, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("key"))
    return s.ranked(rows, ["l_suppkey"], "key", "l_orderkey", "l_linenumber").where("rank <= 5").drop("key")


@query("""with recursive c as (select c_custkey, c_nationkey, c_mktsegment, c_custkey % 40 as world, row_number() over (order by sha256('5' || chr(0) || c_custkey), c_custkey) as step from customer),
w as (select 0::bigint as step, null::bigint as c_custkey, null::bigint as c_nationkey, null::varchar as c_mktsegment, null::bigint as world, null::varchar as outcome, []::struct(n bigint, s varchar, w bigint)[] as taken
  union all select step, c_custkey, c_nationkey, c_mktsegment, world, outcome, case when outcome = 'TAKEN' then list_append(taken, {'n': c_nationkey::bigint, 's': c_mktsegment, 'w': world::bigint}) else taken end
  from (select c.*, w.taken, case when len(w.taken) >= 80 then 'TARGET_REACHED' when len(list_filter(w.taken, lambda x: x.n = c.c_nationkey)) >= 4 then 'CAP_c_nationkey' when len(list_filter(w.taken, lambda x: x.s = c.c_mktsegment)) >= 20 then 'CAP_c_mktsegment'
    when len(list_filter(w.taken, lambda x: x.w = c.world)) >= 2 then 'CAP_world' else 'TAKEN' end as outcome from w join c on c.step = w.step + 1))
select c_custkey, c_nationkey, c_mktsegment, world, outcome from w where step > 0""")
def greedy_multi_cap(t):
    """Several caps at once: of a nation, a segment and a world, until a target is reached; SQL walks row by row."""
    rows = t("customer").select(seeded_hash(5, F.col("c_custkey")).alias("key"), "c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_custkey") % 40).alias("world"))
    return s.greedy_caps(rows, ["key", "c_custkey"], {"c_nationkey": 4, "c_mktsegment": 20, "world": 2}, 80).drop("key")


@query("""with recursive c as (select c_custkey, c_mktsegment as family, c_custkey % 40 as scene, c_nationkey % 3 = 0 as test, c_acctbal < 0 as kind, c_nationkey % 2 as move, row_number() over (order by sha256('9' || chr(0) || c_custkey), c_custkey) as k from customer),
steps as (select *, row_number() over (order by phase, k) as step from (select 1 as phase, 15 as target, * from c where kind union all select 2, 20, * from c where test union all select 3, 60, * from c)),
w as (select 0::bigint as step, []::struct(id bigint, family varchar, scene bigint, test boolean, kind boolean, move bigint, phase integer)[] as taken
  union all select s.step, case when list_contains(list_transform(w.taken, lambda x: x.id), s.c_custkey) or len(list_filter(w.taken, lambda x: s.phase = 3 or s.phase = 1 and x.kind or s.phase = 2 and x.test)) >= s.target
      or len(list_filter(w.taken, lambda x: x.family = s.family)) >= case s.family when 'BUILDING' then 9 else 15 end or len(list_filter(w.taken, lambda x: x.scene = s.scene and x.test = s.test)) >= case when s.test then 2 else 3 end
      or s.test and len(list_filter(w.taken, lambda x: x.test and x.scene = s.scene and x.move = s.move)) >= 1 then w.taken
    else list_append(w.taken, {'id': s.c_custkey::bigint, 'family': s.family, 'scene': s.scene::bigint, 'test': s.test, 'kind': s.kind, 'move': s.move::bigint, 'phase': s.phase}) end from w join steps s on s.step = w.step + 1)
select x.id as c_custkey, ['kind', 'test', 'rest'][x.phase] as phase from (select unnest(taken) as x from w where step = (select max(step) from steps))""")
def greedy_phases(t):
    """Minimums before what fills up: of a kind, then of the test split, then until the target, under quotas of families, scenes and moves."""
    c = t("customer")
    test = F.col("c_nationkey") % 3 == 0
    scene, move = F.col("c_custkey") % 40, F.col("c_nationkey") % 2
    caps = [
        q.Cap("family", F.col("c_mktsegment"), F.when(F.col("c_mktsegment") == "BUILDING", 9).otherwise(15)), q.Cap("scene", F.concat_ws("/", scene, test.cast("string")), F.when(test, 2).otherwise(3)),
        q.Cap("move", F.when(test, F.concat_ws("/", scene, move)), 1),
    ]
    phases = [q.Phase("kind", F.col("c_acctbal") < 0, 15, True), q.Phase("test", test, 20, True), q.Phase("rest", F.lit(True), 60, True)]
    return q.phased(c.withColumn("key", seeded_hash(9, F.col("c_custkey"))), ["key", "c_custkey"], caps, phases)[0].drop("key")


@query("""with recursive p as (select p_partkey, p_size, p_partkey % 4 = 0 as test, p_retailprice > 1000 as dear, row_number() over (order by sha256('13' || chr(0) || p_partkey), p_partkey) as k from part),
steps as (select *, row_number() over (order by phase, k) as step from (select 1 as phase, 12 as target, * from p where p_size % 2 = 0 union all select 2, 20, * from p where dear union all select 3, 10, * from p)),
w as (select 0::bigint as step, []::struct(id bigint, world bigint, test boolean, phase integer)[] as taken
  union all select s.step, case when list_contains(list_transform(w.taken, lambda x: x.id), s.p_partkey) or len(list_filter(w.taken, lambda x: x.phase = s.phase)) >= s.target or s.test and len(list_filter(w.taken, lambda x: x.test and x.world = s.p_size)) >= 1 then w.taken
    else list_append(w.taken, {'id': s.p_partkey::bigint, 'world': s.p_size::bigint, 'test': s.test, 'phase': s.phase}) end from w join steps s on s.step = w.step + 1)
select x.id as p_partkey, ['even', 'dear', 'any'][x.phase] as phase from (select unnest(taken) as x from w where step = (select max(step) from steps))""")
def greedy_by_reason(t):
    """Reasons one after another take rows that are eligible for them, each row once and each world of the test split once."""
    p = t("part").withColumn("key", seeded_hash(13, F.col("p_partkey")))
    world = q.Cap("world", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")), 1)
    reasons = [q.Phase("even", F.col("p_size") % 2 == 0, 12), q.Phase("dear", F.col("p_retailprice") > 1000, 20), q.Phase("any", F.lit(True), 10)]
    return q.phased(p, ["key", "p_partkey"], [world], reasons)[0].drop("key")


@query("""with recursive e as (select event_type as op, user_id as source, min(struct_pack(ts := ts, id := event_id)) as first from events where event_type is not null and user_id is not null group by all),
ops as (select op, row_number() over (order by op) - 1 as i, count(*) over () as k from (select distinct op from e)),
w as (select 0::bigint as n, 0::bigint as idle, []::bigint[] as used, null::varchar as op, null::bigint as source, null::bigint as event_id, 0::bigint as turn
  union all select n + 1, case when pick is null then idle + 1 else 0 end, case when pick is null then used else list_append(used, pick.source::bigint) end, op, pick.source::bigint, pick.id::bigint, n // k + 1
  from (select w.n, w.idle, w.used, o.op, o.k, (select arg_min(struct_pack(source := e.source, id := e.first.id), e.first) from e where e.op = o.op and not list_contains(w.used, e.source::bigint)) as pick from w join ops o on o.i = w.n % o.k where len(w.used) < 60 and w.idle < o.k))
select op, source, event_id, turn, row_number() over (order by n) as position from w where source is not null""")
def round_robin_sources(t):
    """Kinds of events in turn take their next event of a user whom no kind has used, 60 in all."""
    e = t("events").select(F.col("event_type").alias("op"), F.col("user_id").alias("source"), "ts", "event_id")
    return q.turns(e, "op", "source", ["ts", "event_id"], 60, block=10).drop("ts")


@query("""with a as (select c_custkey, c_acctbal < 0 as flag from customer), n as (select count(*) filter (where flag) as a, count(*) filter (where not flag) as b from a),
m as (select least(a, greatest(40, 100 - b)) as ka, a, b from n), l as (select ka, least(b, 100 - ka) as kb from m)
select c_custkey, flag from (select *, row_number() over (partition by flag order by c_custkey) as rank from a), l where rank <= case when flag then ka else kb end""")
def balanced_slice(t):
    rows = t("customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("flag"))
    return s.balanced_slice(rows, "flag", "c_custkey", 100)


@query("select p_partkey % 16 as shard, count(*) as n, min(p_partkey) as first_id, max(p_partkey) as last_id from part group by 1")
def shard_modulo(t):
    return t("part").groupBy((F.col("p_partkey") % 16).alias("shard")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"), F.max("p_partkey").alias("last_id"))


@query("""with d as (select o_orderkey, sha256(o_orderkey::varchar) as h from orders) select o_orderkey, ('0x' || substr(h, 1, 2))::bigint as first_byte,
case when ('0x' || substr(h, 1, 2))::bigint % 2 = 0 then 'SUPPORTED' else 'CONTRADICTORY' end as first_label, case when ('0x' || right(h, 2))::bigint % 2 = 0 then 'forward' else 'reversed' end as orientation from d""")
def hash_bit_order(t):
    """Bits of an id's digest decide which answer comes first and which way round a pair stands."""
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    a, b = digest_byte(h), digest_byte(h, first=False)
    return t("orders").select("o_orderkey", a.alias("first_byte"), F.when(a % 2 == 0, "SUPPORTED").otherwise("CONTRADICTORY").alias("first_label"), F.when(b % 2 == 0, "forward").otherwise("reversed").alias("orientation"))


@query("""select * from (select user_id, event_id, event_type as first_type, lead(event_type) over (partition by user_id order by ts, event_id) as next_type from events) where next_type is not null""")
def consecutive_pairs(t):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("user_id", "event_id", F.col("event_type").alias("first_type"), F.lead("event_type").over(order).alias("next_type")).where("next_type is not null")


@query("""with c as (select event_type as code, count(*) as n from events group by 1) select code, n, (sum(n) over (order by n desc, code rows unbounded preceding))::bigint as running, sum(n) over (order by n desc, code rows unbounded preceding)::double / (select sum(n) from c)::double as share from c""")
def cumulative_share(t):
    """Pareto of codes: their running share in order of count."""
    c = t("events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), "code")  # a few codes
    run = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return c.select("code", "n", run.alias("running"), (run.cast("double") / F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")).alias("share"))


@query("select source, doc_id, place from (select source, doc_id, row_number() over (partition by source order by doc_id) as place from documents) where place <= 2")
def first_k_examples(t):
    return s.ranked(t("documents").select("source", "doc_id"), ["source"], "doc_id", name="place").where("place <= 2")


@query("""with f as (select user_id, list(event_id order by ts, event_id) as frames from events group by user_id), i as (select user_id, frames, len(frames) as n, unnest(range(16)) as i from f)
select user_id, i::bigint as slot, frames[1 + round_even(i * (n - 1) / 15.0, 0)::bigint] as event_id from i where n > 0""")
def frame_selection(t):
    """Sixteen evenly spaced frames of each sequence; places are rounded half to even."""
    each = Window.partitionBy("user_id")
    rows = t("events").select("user_id", "event_id", F.row_number().over(each.orderBy("ts", "event_id")).alias("place"), F.count("*").over(each).alias("n"))
    wanted = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.bround(i * (F.col("n") - 1) / 15.0, 0) == F.col("place") - 1)
    return rows.select("user_id", "event_id", F.explode(wanted).alias("slot")).select("user_id", F.col("slot").cast("bigint").alias("slot"), "event_id")


@query("""with o as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as index from orders) select index // 16 as step, (index % 4)::int as rank, index, o_orderkey from o""")
def rank_partition(t):
    """The orders of each rank in global batches of 16, strided by four ranks."""
    placed = s.globally_ranked(t("orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey", name="place")
    index = (F.col("place") - 1).alias("index")
    return placed.select("o_orderkey", index).select(F.floor(F.col("index") / 16).alias("step"), (F.col("index") % 4).cast("int").alias("rank"), "index", "o_orderkey")


@query("""with d as (select c_nationkey, list(c_custkey order by c_custkey) as donors from customer group by 1) select c_custkey, donors[1 + ((c_custkey * 7) % len(donors))] as donor from customer join d using (c_nationkey)""")
def positional_donor(t):
    """The donor at place id modulo count of the ordered list of a context."""
    c = t("customer").select("c_custkey", "c_nationkey")
    d = s.ranked(c.withColumnRenamed("c_custkey", "donor"), ["c_nationkey"], "donor", name="place")
    sizes = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    wanted = c.join(sizes, "c_nationkey").withColumn("place", (F.col("c_custkey") * 7) % F.col("n") + 1)
    return wanted.join(d, ["c_nationkey", "place"]).select("c_custkey", "donor")


@query("""with r as (select c_mktsegment, c_nationkey, c_custkey, row_number() over (partition by c_mktsegment, c_nationkey order by sha256('9' || chr(0) || c_custkey::varchar), c_custkey) as k from customer),
o as (select *, row_number() over (partition by c_mktsegment order by k, c_nationkey) as turn from r) select c_mktsegment, c_nationkey, c_custkey, turn from o where turn <= 12""")
def stratified_smoke_set(t):
    """Twelve rows of each segment, cycling through the nations in order."""
    keyed = t("customer").select("c_mktsegment", "c_nationkey", "c_custkey", seeded_hash(9, F.col("c_custkey")).alias("key"))
    r = s.ranked(keyed, ["c_mktsegment", "c_nationkey"], "key", "c_custkey", name="k")
    return s.ranked(r, ["c_mktsegment"], "k", "c_nationkey", name="turn").where("turn <= 12").select("c_mktsegment", "c_nationkey", "c_custkey", "turn")


@query("""with c as (select c_custkey, unnest(range(3)) as cycle from customer) select cycle::bigint as cycle, c_custkey, row_number() over (partition by cycle order by sha256(cycle || ':' || c_custkey), c_custkey) as position from c""")
def shuffled_cycles(t):
    """A permutation of all ids for each of three cycles."""
    rows = t("customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("cycle"))
    keyed = rows.withColumn("key", F.sha2(F.concat_ws(":", "cycle", "c_custkey"), 256))
    placed = s.globally_ranked(keyed, "cycle", "key", "c_custkey", name="place")
    n = t("customer").agg(F.count("*").alias("n"))
    return placed.crossJoin(F.broadcast(n)).select("cycle", "c_custkey", (F.col("place") - F.col("cycle") * F.col("n")).alias("position"))


@query("""with u as (select o_orderkey, ('0x' || substr(sha256('aux:' || o_orderkey), 1, 2))::bigint % 2 = 0 as aux from orders) select o_orderkey, 'answer' as unit, case when aux then 0.5 else 1.0 end::double as weight from u union all select o_orderkey, 'auxiliary', 0.5::double from u where aux""")
def unit_expansion(t):
    """An answer unit of weight 1, or halves for answer and auxiliary, by a bit of the digest."""
    aux = digest_byte(F.sha2(F.concat(F.lit("aux:"), F.col("o_orderkey").cast("string")), 256)) % 2 == 0
    unit = lambda name, w: F.struct(F.lit(name).alias("unit"), F.lit(w).alias("weight"))
    return t("orders").select("o_orderkey", F.inline(F.when(aux, F.array(unit("answer", 0.5), unit("auxiliary", 0.5))).otherwise(F.array(unit("answer", 1.0)))))
