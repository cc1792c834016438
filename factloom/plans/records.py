"""Records, references, worlds and rules on the driver's tables."""

from pyspark.sql import functions as F

from ..functions import records as r
from ..operators import references as o
from .registry import query


@query("""select p_partkey, case when p_partkey % 3 = 0 then false else true end as nonempty, p_partkey % 5 < 2 as world, p_partkey % 4 = 0 as box from part""")
def predicate_checks(t):
    """Strings that aren't blank, worlds with prefix and rest, boxes of nine finite numbers."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.when(k % 2 == 0, " \t ")).otherwise(F.col("p_name"))
    world = F.get(F.array(F.lit("scene:1"), F.lit("a:b:c"), F.lit("scene:"), F.lit(" scene:1"), F.lit("scene")), (k % 5).cast("int"))
    size = F.get(F.array(F.lit(2.5), F.lit(0.0), F.lit(float("nan")), F.lit(float("inf"))), (k % 4).cast("int"))
    box = F.array(F.col("p_retailprice"), F.lit(0.0), F.lit(-1.0), F.lit(1.0), size, F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return t("part").select("p_partkey", F.coalesce(F.length(F.btrim(text, F.lit(" \t\r\n"))) > 0, F.lit(False)).alias("nonempty"), o.valid_world(world).alias("world"), r.finite_box(box).alias("box"))


@query("""select o_orderkey, o_orderstatus as status, case when o_orderkey % 2 = 0 then 'priority=' || o_orderpriority || ',status=' || o_orderstatus else 'status=' || o_orderstatus end as kept, case when o_orderkey % 3 = 0 then '{"customer":"' || o_custkey || '","key":"' || o_orderkey || '"}' end as extras from orders""")
def allowed_keys(t):
    """Records cut to the keys that may stand; a key that a record lacks isn't added, the others go to one JSON text."""
    k, c = F.col("o_orderkey"), lambda n: F.col(n).cast("string")
    entries = F.array_compact(F.array(F.struct(F.lit("status").alias("k"), c("o_orderstatus").alias("v")), F.when(k % 2 == 0, F.struct(F.lit("priority").alias("k"), c("o_orderpriority").alias("v"))), F.when(k % 3 == 0, F.struct(F.lit("key").alias("k"), c("o_orderkey").alias("v"))), F.when(k % 3 == 0, F.struct(F.lit("customer").alias("k"), c("o_custkey").alias("v")))))
    rows = t("orders").select("o_orderkey", F.inline(F.array(r.with_extras(F.map_from_entries(entries), ["status", "priority"]))))
    kept = F.array_join(F.array_sort(F.transform(F.map_entries("kept"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return rows.select("o_orderkey", F.element_at("kept", "status").alias("status"), kept.alias("kept"), "extras")


@query("""select event_id, array_to_string(list_filter(['answer', 'gold', 'label'], lambda k: (k = 'gold' and event_id % 2 = 0) or (k = 'label' and event_id % 3 = 0)), ',') as forbidden, case when event_id % 3 = 0 then 2 else 1 end::bigint as passed from events""")
def forbidden_keys(t):
    """Keys that an answer's record may not have at any depth, and how often it states PASS."""
    k = F.col("event_id")
    text = F.concat(F.lit('{"a\\"b": "gold\\": x, \\"answer\\": 1", "in": [{'), F.when(k % 2 == 0, '"gold" : 1, ').otherwise(""), F.lit('"status": "PASS"}], "of": {"note": "\\"status\\": \\"PASS\\""'), F.when(k % 3 == 0, ', "label": {"status" :"PASS"}').otherwise(', "status": 1'), F.lit("}}"))
    rows = t("events").select("event_id", F.explode(F.array(text)).alias("text"))
    banned = F.array_sort(F.array_intersect(r.json_keys(F.col("text")), F.array(*map(F.lit, ["label", "gold", "answer"]))))
    return rows.select("event_id", F.array_join(banned, ",").alias("forbidden"), F.size(F.filter(r.statuses(F.col("text")), lambda s: s == "PASS")).cast("bigint").alias("passed"))


@query("""select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linenumber % 2 = 0 or l_returnflag = 'N' as fits, not (l_linenumber % 2 = 0 or l_returnflag = 'N') or (l_suppkey % 2 = 0) as null_fits from lineitem""")
def context_subset(t):
    """A claim fits a fact if the keys that it states agree; keys that it doesn't state don't matter, a stated null needs a null."""
    flag, other = F.col("l_returnflag") == "N", F.col("l_linenumber") % 2 == 0
    fact = F.create_map(F.lit("scope"), F.when(flag, "whole").otherwise("part"), F.lit("frame"), F.col("l_linestatus"), F.lit("time"), F.when(F.col("l_suppkey") % 2 == 1, "t"))
    claim = F.when(other, F.create_map(F.lit("frame"), F.col("l_linestatus"))).otherwise(F.create_map(F.lit("scope"), F.lit("whole"), F.lit("frame"), F.col("l_linestatus")))
    fits = r.same_context(claim, fact)
    timed = r.same_context(F.create_map(F.lit("time"), F.lit(None).cast("string")), fact)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", fits.alias("fits"), (~fits | timed).alias("null_fits"))


@query("""select c_custkey, case when c_nationkey > 0 then 100.0 * c_custkey / c_nationkey end as percent, round_even(c_acctbal / 7, 6) as rounded, case c_custkey % 4 when 0 then 5 when 1 then 4 when 2 then 1 else 2 end::bigint as views,
  case when c_nationkey = 3 then '3,7' when c_nationkey = 7 then '7,3' else c_nationkey || ',3,7' end as firsts, c_nationkey + 10::bigint as total from customer""")
def scalar_helpers(t):
    """Percentages without division by 0, roundings half to even, views of media, lists without repeats in their order, sums of nested lists."""
    n, k = F.col("c_nationkey"), F.col("c_custkey") % 4
    kind = "array<struct<roles:map<string,string>,support:array<string>>>"
    roles, support = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")), F.array(F.lit("p"), F.lit("q"))
    ref = lambda a, b: F.struct((a if a is not None else F.lit(None)).alias("roles"), (b if b is not None else F.lit(None)).alias("support"))
    refs = F.when(k == 0, F.array(ref(roles, None), ref(None, support)).cast(kind)).when(k == 1, F.array(ref(None, support), ref(None, None)).cast(kind)).when(k == 2, F.array(ref(None, None)).cast(kind))
    nested = F.array(F.array(n), F.array(F.lit(3), F.lit(7)))
    firsts = F.array_distinct(F.concat(F.array(n), F.array(F.lit(3), F.lit(7), F.lit(3))))
    return t("customer").select(
        "c_custkey", F.when(n > 0, 100.0 * F.col("c_custkey") / n).alias("percent"), F.bround(F.col("c_acctbal") / 7, 6).alias("rounded"), r.view_count(refs, support).cast("bigint").alias("views"),
        F.array_join(firsts, ",").alias("firsts"), F.aggregate(F.flatten(nested), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"),
    )


@query("""select p_partkey, case p_partkey % 5 when 0 then 'object marked by bounding box [' || p_size || ', 7]' when 1 then 'queried target' when 2 then 'bounding-box target' when 3 then p_name else p_name || ' ' || p_size end as surface from part""")
def entity_surfaces(t):
    k, name, size = F.col("p_partkey") % 5, F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_size").cast("string")
    ids = F.when(k == 0, F.concat(F.lit("bbox_anchor:q:"), size, F.lit("_7"))).when(k == 1, F.concat(F.lit("query_target:"), size)).when(k == 2, "item:1:bbox_target").when(k == 3, F.concat(F.lit("first_appear:mention:the_"), name)).otherwise(F.concat(F.lit("class:"), name, F.lit("_"), size, F.lit("@source_item:a_b")))
    return t("part").select("p_partkey", r.entity_surface(ids).alias("surface"))


@query("""select event_id, case event_id % 4 when 0 then 'whole_video' when 1 then 'point' end as time_scope, case event_id % 4 when 0 then 'video_timeline' when 1 then 'observer' when 2 then 'observer_view_1' end as reference_frame, case event_id % 4 when 0 then 'whole_video' when 1 then 'time_interval' when 2 then 'world_shared_across_views' end as scope, case when event_id % 4 = 1 then value end as seconds from events""")
def context_parse(t):
    k, v = F.col("event_id") % 4, F.col("value").cast("decimal(18,2)").cast("string")
    said = F.when(k == 0, "Across the observed timeline of the actual video").when(k == 1, F.concat(F.lit("at "), v, F.lit(" seconds in the actual video, viewed from the observer frame"))).when(k == 2, "in the actual scene observed from viewpoint 1").otherwise("In the actual scene observed from viewpoint 2")
    return t("events").select("event_id", F.explode(F.array(r.parsed_context(said))).alias("c")).select("event_id", "c.*")


@query("""with n as (select o_orderkey, o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ordinal from orders)
select o_orderkey, ordinal, replace(replace((['After this hypothetical change, the scene contains {v} {s}.', 'Once the stated intervention is complete, there are {v} {s} in the scene.', 'Following the hypothetical intervention, the number of {s} in the scene is {v}.'])[1 + ordinal % 3], '{v}', ordinal::varchar), '{s}', 'box ' || o_custkey) as count_claim,
  case when o_orderstatus = 'F' then case when ordinal % 2 = 0 then 'After this hypothetical change, box ' || o_custkey || ' exists in the scene.' else 'Once the stated intervention is complete, box ' || o_custkey || ' remains present.' end
    else case when ordinal % 2 = 0 then 'After this hypothetical change, box ' || o_custkey || ' does not exist in the scene.' else 'Once the stated intervention is complete, box ' || o_custkey || ' is absent.' end end as existence_claim from n""")
def claim_texts(t):
    """Claims in forms that go round by the ordinal of a row in its world."""
    from ..operators.select import ranked

    n = ranked(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderkey").withColumn("ordinal", (F.col("rank") - 1).cast("bigint"))
    subject, ordinal = F.concat(F.lit("box "), F.col("o_custkey").cast("string")), F.col("ordinal")
    there = F.when(F.col("o_orderstatus") == "F", r.claim_text(ordinal, r.PRESENT_CLAIMS, subject=subject)).otherwise(r.claim_text(ordinal, r.ABSENT_CLAIMS, subject=subject))
    return n.select("o_orderkey", "ordinal", r.claim_text(ordinal, r.COUNT_CLAIMS, value=ordinal, subject=subject).alias("count_claim"), there.alias("existence_claim"))


@query("""select p_partkey as ref_id, case p_partkey % 4 when 3 then '' when 2 then p_partkey::varchar else p_partkey::varchar end as object_ids, case p_partkey % 4 when 0 then 'UNIQUE_REFERENTIAL' when 1 then 'ANNOTATION_ALIGNED' when 2 then 'UNIQUE_CLASS_IN_SCENE' else 'UNRESOLVED' end as status from part""")
def resolved_references(t):
    """References by class, by alias, by the head before a relation, and those that mean nothing or too much."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    objects = t("part").select(F.col("p_brand").alias("scene"), k.alias("object_id"), F.concat(F.lit("box "), key).alias("class"), F.array(F.concat(F.lit("The Bin "), key), F.lit("thing")).alias("aliases"))
    objects = objects.unionByName(objects.withColumns({"object_id": -F.col("object_id") - 1, "class": F.lit("thing"), "aliases": F.lit(None).cast("array<string>")}))
    text = F.when(k % 4 == 0, F.concat(F.lit("the Box  "), key)).when(k % 4 == 1, F.concat(F.lit("a bin "), key, F.lit("!"))).when(k % 4 == 2, F.concat(F.lit("the big red bin "), key, F.lit(" next to the thing"))).otherwise("small thing left of the box 1")
    refs = t("part").select(k.alias("ref_id"), F.col("p_brand").alias("scene"), text.alias("text"))
    out = o.resolved(refs, objects)
    return out.select("ref_id", F.array_join("object_ids", ",").alias("object_ids"), "status")


@query("""with c as (select p_brand, p_type, count(*) as n from part group by 1, 2), b as (select distinct p_brand from part)
select p_partkey as question_id, case when p_size % 2 = 0 then lower(p_type) when p_size % 3 = 0 then 'shelf' end as kind, case when p_size % 2 = 0 then n when p_size % 3 = 0 then 9 end as n from part join c using (p_brand, p_type)""")
def class_counts(t):
    """Counts of classes per scene, stated or from objects, for questions in the singular or plural."""
    p = t("part")
    subject = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("the "), F.when(F.endswith("p_type", F.lit("Y")), F.regexp_replace("p_type", "Y$", "IES")).otherwise(F.concat("p_type", F.lit("S"))), F.lit(" present"))).when(F.col("p_size") % 3 == 0, "shelfs").otherwise("lamp")
    stated = p.select(F.col("p_brand").alias("scene"), F.lit("Shelf").alias("kind"), F.lit(9).cast("bigint").alias("n")).distinct().unionByName(p.select(F.col("p_brand").alias("scene"), F.lit("lamp").alias("kind"), F.lit(0).cast("bigint").alias("n")).distinct())
    return o.class_counts(p.select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("scene"), subject.alias("subject")), stated, p.select(F.col("p_brand").alias("scene"), F.col("p_type").alias("kind")))


@query("""select o_orderkey as sample_id, case o_orderkey % 8 when 0 then 'mine:' || o_orderkey when 6 then 'scene:' || o_orderkey when 7 then 'scene:' || o_orderkey end as world,
  case o_orderkey % 8 when 0 then 'ORIGINAL_METADATA' when 1 then 'UNRESOLVED' when 2 then 'SOURCE_WORLD_SCENE_MISMATCH' when 3 then 'SPLIT_OR_LEVEL_MISMATCH' when 4 then 'CONFLICTING_WORLD' when 5 then 'SPLIT_OR_LEVEL_MISMATCH' when 6 then 'EXACT_SAMPLE_ID' else 'ORIGINAL_CROSSCHECKED' end as status from orders""")
def recovered_worlds(t):
    k, key = F.col("o_orderkey") % 8, F.col("o_orderkey").cast("string")
    scene = F.concat(F.lit("scene:"), key)
    meta = t("orders").select(F.col("o_orderkey").alias("sample_id"), F.when(k == 0, F.concat(F.lit("mine:"), key)).when(k == 1, F.concat(F.lit("mine"), key)).when(k == 4, "scene:other").when(k == 7, scene).alias("world"), F.lit("test").alias("split"), F.lit("L4").alias("level"))
    sources = t("orders").where("o_orderkey % 8 > 1").select(F.col("o_orderkey").alias("sample_id"), F.when(k == 2, F.concat(scene, F.lit("x"))).otherwise(scene).alias("world"), key.alias("scene"), F.when(k == 3, "train").when(k != 5, "test").alias("split"), F.lit("L4").alias("level"))
    return o.recovered_worlds(meta, sources)


@query("""select event_id, case when event_id % 6 in (1, 2) or (event_id % 6 = 5 and user_id % 2 = 0) then 'SUPPORTED' when event_id % 6 in (0, 3) then 'CONTRADICTORY' else 'UNKNOWN' end as label,
  case event_id % 3 when 0 then 'same_capture:scene0042_01;possible_room:scene0042' when 1 then 'same_uuid:0cac7578-8d6f-2d13-8c2d-bfa7a04f8af3' else '' end as aliases from events""")
def existence_replay(t):
    """Claims that a thing exists after a change by a rule, and candidate names of worlds."""
    k = F.col("event_id") % 6
    rule = F.when(k == 1, "ADDITION_CREATES_ENTITY").when(k == 3, "REMOVAL_DELETES_ENTITY").when(k == 4, "MOVE").otherwise("REPLACEMENT_SWAPS_ENTITIES")
    subject, claimed = F.when(k.isin(0, 2), "old").when(k == 5, "new").otherwise("e"), F.when(k == 2, False).when((k == 5) & (F.col("user_id") % 2 == 1), None).otherwise(True)
    world = F.get(F.array(F.lit("scan:scene0042_01:x"), F.lit("r:0cac7578-8d6f-2d13-8c2d-bfa7a04f8af3"), F.lit("other:17")), (F.col("event_id") % 3).cast("int"))
    label = o.existence_label(rule, subject, F.lit("e"), F.lit("old"), F.lit("new"), claimed)
    return t("events").select("event_id", label.alias("label"), F.array_join(o.alias_candidates(world), ";").alias("aliases"))


@query("""with m(model, price) as (values ('large', 3), ('small', 1)) select p_partkey, model, p_partkey % 3 as shard, price * p_size as cost from part, m""")
def model_requests(t):
    """Every request for every model; the models are a literal of two rows."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("price")) for m, c in (("large", 3), ("small", 1))])
    return t("part").select("p_partkey", "p_size", F.inline(models)).select("p_partkey", "model", (F.col("p_partkey") % 3).alias("shard"), (F.col("price") * F.col("p_size")).alias("cost"))


@query("""select l_orderkey, case when o_orderkey is null then 'NO_SOURCE' when c_custkey is null then 'NO_WORLD' when h1 = h2 then 'PASS' else 'HASH_MISMATCH' end as status, n from (select l_orderkey, count(*) as n, sha256(l_orderkey || '|' || case when l_orderkey % 9 = 0 then -1 else l_orderkey % 7 end) as h1 from lineitem group by 1)
left join (select o_orderkey, o_custkey, sha256(o_orderkey || '|' || o_orderkey % 7) as h2 from orders where o_orderkey % 10 > 0) on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey""")
def lineage_chain(t):
    """Records held against the records that they were made from, by content hash, and the first link that doesn't hold."""
    hashed = lambda key, rest: F.sha2(F.concat_ws("|", F.col(key).cast("string"), rest.cast("string")), 256)
    made = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("h1", hashed("l_orderkey", F.when(F.col("l_orderkey") % 9 == 0, -1).otherwise(F.col("l_orderkey") % 7)))
    source = t("orders").where("o_orderkey % 10 > 0").select("o_orderkey", "o_custkey", hashed("o_orderkey", F.col("o_orderkey") % 7).alias("h2"))
    chain = made.join(source, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    status = F.when(F.col("o_orderkey").isNull(), "NO_SOURCE").when(F.col("c_custkey").isNull(), "NO_WORLD").when(F.col("h1") == F.col("h2"), "PASS").otherwise("HASH_MISMATCH")
    return chain.select("l_orderkey", status.alias("status"), "n")


@query("""select l_returnflag as kind, count(*) as rows, count(distinct l_suppkey) as suppliers, count(distinct (l_suppkey, l_linestatus)) as combos, sum(l_quantity)::bigint as units, round(sum(l_quantity * (1 - l_discount)), 4) as weight, count(distinct l_linestatus) = 1 as uniform from lineitem group by 1""")
def weighted_exposure(t):
    """Counts, distinct combinations and weights by kind, and whether a value is the same throughout."""
    return t("lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(
        F.count("*").alias("rows"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct(F.struct("l_suppkey", "l_linestatus")).alias("combos"), F.sum("l_quantity").cast("bigint").alias("units"),
        F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))), 4).alias("weight"), (F.min("l_linestatus") == F.max("l_linestatus")).alias("uniform"),
    )
