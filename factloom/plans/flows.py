"""Streaming, source and sink queries."""

import uuid

from pyspark.sql import functions as F

from ..sources import readers, tables
from ..streaming import cursor, ingest
from .frames import SCORED_SQL, scored
from .registry import query


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(t):
    return ingest.windowed_counts(t("events"))


@query("with " + SCORED_SQL + " select lang, count(*) as expected, count(pred) as present, count(*) filter (where gold = pred) as correct from scored group by lang")
def prediction_coverage(t):
    s = scored(t).withColumnRenamed("doc_id", "sample_id")
    return ingest.coverage(s.select("sample_id", "lang", "gold"), s.where("pred is not null"), "lang")


@query("with " + SCORED_SQL + " select doc_id as sample_id from scored where pred is null")
def unfinished_requests(t):
    s = scored(t).withColumnRenamed("doc_id", "sample_id")
    return ingest.unfinished(s.select("sample_id"), s.where("pred is not null"))


@query("select event_type, count(*) as n, min(event_id) as first_id from events group by 1")
def stream_dedup_first(t):
    """Events written twice as JSON files and streamed once: repeats fall out in the stream."""
    e = t("events").select(F.col("event_id").alias("sample_id"), "event_type", F.col("ts").alias("arrived"))
    spark = e.sparkSession
    place = f"{tables.shared_dir(spark)}/factloom/stream-{uuid.uuid4().hex}"
    e.union(e).repartition(4).write.json(f"{place}/in")
    stream = ingest.first_predictions(spark, f"{place}/in", "sample_id bigint, event_type string, arrived timestamp", "3650 days")
    ingest.write_available(stream, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id"))


PERMUTED_SQL = "([2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497][1 + ('0x' || substr(sha256({label}), 1, 8))::bigint % 8] * ({place}) + ('0x' || substr(sha256({label}), 9, 8))::bigint) % {n}"


@query(f"""with s as (select o_orderpriority as level, o_custkey as world, o_orderkey as sample, row_number() over (partition by o_orderpriority, o_custkey order by o_orderkey) - 1 as s_place from orders),
w as (select *, row_number() over (partition by level order by world) - 1 as w_place from (select level, world, count(*) as n_samples from s group by 1, 2)),
l as (select *, row_number() over (order by level) - 1 as turn, count(*) over () as n from (select level, count(*) as n_worlds from w group by 1)),
i as (select unnest(range((ceil(count(*) / 32) * 32)::bigint)) as index from orders),
a as (select index, level, n_worlds, index // n // n_worlds as cycle, index // n % n_worlds as place from i join l on index % n = turn),
b as (select a.*, world, n_samples from a join w using (level) where w_place = {PERMUTED_SQL.format(label="concat('17:', a.level, ':', cycle)", place="place", n="n_worlds")})
select index // 32 as step, (index % 4)::int as rank, index, b.level, b.world, sample from b join s on s.level = b.level and s.world = b.world and s_place = {PERMUTED_SQL.format(label="concat('17:', b.level, ':', b.world, ':', cycle // n_samples)", place="cycle % n_samples", n="n_samples")}""")
def step_cursor(t):
    """A schedule of steps over all orders, levels by priority and worlds by customer, streamed in two runs from one checkpoint."""
    orders = t("orders")
    spark = orders.sparkSession
    spark.dataSource.register(cursor.StepCursorSource)
    place, steps = f"{tables.shared_dir(spark)}/factloom/cursor-{uuid.uuid4().hex}", -(-orders.count() // 32)
    for upto in (steps // 2, steps):
        stream = spark.readStream.format("step_cursor").options(steps=upto, batch=32, ranks=4, steps_per_task=max(steps // 64, 500)).load()
        out = cursor.scheduled(stream, orders, "o_orderpriority", "o_custkey", "o_orderkey", 17)
        ingest.write_available(out, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out")


@query("select event_id, ('0' || (props->>'k'))::bigint as k from events")
def json_object_entries(t):
    """The entries of a JSON object column as rows."""
    e = t("events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("select (dense_rank() over (partition by o_custkey order by o_orderstatus) - 1)::bigint as branch_ordinal, o_custkey as scene, (row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) - 1)::bigint as question_ordinal, o_orderstatus as change, o_orderkey as id from orders")
def annotation_flattening(t):
    """Scenes with branches of questions flattened with both ordinals."""
    branches = t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.struct(k.alias("id"))).alias("questions"))
    scenes = branches.groupBy(F.col("o_custkey").alias("scene")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderstatus").alias("change"), "questions"))).alias("branches"))
    rows = readers.annotation_rows(scenes)
    return rows.select(F.col("branch_ordinal").cast("bigint").alias("branch_ordinal"), "scene", F.col("question_ordinal").cast("bigint").alias("question_ordinal"), "change", "id")


@query("select n_regionkey, count(*) as n_rows from nation group by 1")
def table_manifest(t):
    return tables.manifest(t("nation"), ["n_regionkey"]).drop("content")
