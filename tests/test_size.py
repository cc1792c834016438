"""Work that must not grow faster than the input, counted in rows of plans and in expressions rather than in seconds."""

import hashlib
import re

import pytest
from compare import compare, views
from pyspark.sql import functions as F
from test_components import plain

from factloom.functions import directions
from factloom.operators import graph, proofs, readings, references, stats
from factloom.plans import catalog, reasoning, relations, scenes, wording
from factloom.sources import tables


def made(df):
    """The most rows that a step of the plan made, once the plan has run."""

    def walk(plan):
        kind, rows = plan.nodeName(), 0
        if kind == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in kind:
            return walk(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        if metric.isDefined():
            rows = metric.get().value()
        children = plan.children()
        return max([rows] + [walk(children.apply(k)) for k in range(children.size())])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_shared_aliases_and_texts_make_no_pairs(spark):
    n = 400
    objects = spark.range(n).select(F.lit("s").alias("scene"), F.col("id").alias("object_id"), F.concat(F.lit("box "), "id").alias("class"), F.array(F.lit("thing")).alias("aliases"))
    refs = spark.range(n).select(F.col("id").alias("ref_id"), F.lit("s").alias("scene"), F.when(F.col("id") % 2 == 0, "small thing left of the box 1").otherwise(F.concat(F.lit("red box "), "id")).alias("text"))
    out = references.resolved(refs, objects)
    assert {(r.ref_id, tuple(r.object_ids), r.status) for r in out.collect()} == {(i, (i,), "UNIQUE_CLASS_IN_SCENE") if i % 2 else (i, (), "UNRESOLVED") for i in range(n)}
    assert made(out) <= 8 * n


def made_by(df, name):
    """Rows that each step of a kind made, in the order of the plan."""

    def walk(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        children = plan.children()
        below = [n for k in range(children.size()) for n in walk(children.apply(k))]
        return [plan.metrics().get("numOutputRows").get().value(), *below] if plan.nodeName() == name else below

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_clusters_are_drawn_once_for_all_their_strata(spark):
    rows = spark.range(200).select(F.lit("g").alias("g"), (F.col("id") % 10).alias("stratum"), (F.col("id") / 10).cast("bigint").alias("c"), (F.col("id") % 3).alias("v"))
    parts = rows.groupBy("g", "stratum", "c").agg(F.sum("v").alias("s"))
    drawn = stats.resampled(parts, "c", 50)
    pairs = {(r.c, r._rep): r._w for r in drawn.collect()}
    want = {(c, k): sum(int(hashlib.md5(f"{k}|{c}".encode()).hexdigest()[:8], 16) >= b * 2**32 for b in stats.poisson_bounds()) for c in range(20) for k in range(1, 51)}
    assert pairs == {k: w for k, w in want.items() if w} and drawn.count() == 10 * len(pairs)
    assert min(made_by(stats.stratified_bootstrap(rows, ["g"], "stratum", "c", "v", 50), "Generate")) == len(pairs)


def test_clusters_without_a_ratio_are_not_drawn(spark):
    rows = spark.range(2_000).select(F.when(F.col("id") < 1_000, "a").otherwise("b").alias("g"), F.col("id").alias("c"), F.lit(1).alias("v"), (F.col("id") % 500 == 0).alias("ok"))
    out = stats.conditional_macro(rows.where("g = 'a' or not ok"), ["g"], "c", "v", F.col("ok"), 50)
    got = {r.g: r for r in out.collect()}
    drawn = {k for k in range(1, 51) for c in (0, 500) if int(hashlib.md5(f"{k}|{c}".encode()).hexdigest()[:8], 16) >= stats.poisson_bounds()[0] * 2**32}
    assert (got["a"].cohort, got["a"].clusters, got["a"].estimate, got["a"].low, got["a"].high) == (1_000, 2, 1.0, 1.0, 1.0) and abs(got["a"].empty - (1 - len(drawn) / 50)) < 1e-12
    assert (got["b"].cohort, got["b"].clusters, got["b"].estimate, got["b"].low, got["b"].empty) == (998, 0, None, None, 1.0)
    assert made(out) <= 2_000


def test_a_question_is_matched_once(spark):
    q = "If I am standing by the Sofa 1 and facing the Shelf 2, is the Box 3 to the left or the right of the shelf 2?"
    rows = [(q, ["A. left", " B.  Right "], "B"), (f" {q} ", ["A. left", "A. RIGHT"], "A"), (q, ["A. left"], "D"), (q, ["left"], "A"), (q.replace("shelf 2?", "door?"), ["A. left"], "A"), (q + "\n", ["A. left"], "A"), (q.replace("Sofa", "So\nfa"), ["A. left"], "A"), ("1\n2\n3\n2", ["A. left"], "A"), (q.replace("the left or", "left or"), [], "A"), (None, ["A. left"], "A")]
    df = spark.createDataFrame(rows, "q string, options array<string>, letter string").select(directions.facing(F.col("q"), F.col("options"), F.col("letter")).alias("f"))
    got = [(r.f.reject_code, r.f.frame, [f.predicate for f in r.f.facts]) for r in df.collect()]
    frame, missing = "agent_at:sofa_1:facing:shelf_2", ("MISSING_REFERENCE_FRAME", None, [])
    # Spark's $ takes a line break at the end
    assert got[:6] == [(None, frame, ["RIGHT_OF"]), (None, frame, ["RIGHT_OF"]), ("UNSUPPORTED_OPERATOR", None, []), ("SOURCE_RECONSTRUCTION_FAIL", None, []), missing, (None, frame, ["LEFT_OF"])]
    assert got[6:9] == [missing] * 3 and got[9][0] is None and got[9][2] == ["LEFT_OF"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("If I am standing") == 1 and plan.count("regexp_extract(") == 2


def test_slots_and_errors_are_worked_out_once(spark):
    pre = F.array(proofs.fact("COUNT", F.lit("s"), F.col("n")), proofs.fact("EXISTS_IN_WORLD", F.lit("e"), F.lit(1)), proofs.fact("LEFT_OF", F.lit("e"), None, F.lit("door")))
    add = F.array(proofs.fact("EXISTS_IN_WORLD", F.lit("e"), F.lit(0)), proofs.fact("COUNT", F.lit("s"), F.col("n") - 1))
    delete = F.array(F.lit("COUNT|s||scene"), F.lit("COUNT|s||scene"))
    rows = spark.createDataFrame([(2, "REMOVE"), (0, "REMOVE"), (2, "ADD"), (2, "MOVE"), (2, "PAINT"), (None, "ADD")], "n bigint, family string").select("n", "family", pre.alias("pre"), add.alias("add"))
    a = proofs.apply_delta(F.col("pre"), delete, F.col("add"), F.transform("add", proofs.slot))
    b = proofs.check_family(F.col("pre"), F.col("family"), F.lit("e"), F.lit("s"), F.lit("door"), F.lit("LEFT_OF"))
    df = rows.withColumns({"a": a, "b": b}).select("n", "family", "a.errors", F.col("a.status").alias("x"), "b.status", F.col("b.errors").alias("codes"), F.transform("a.post", lambda f: f["predicate"]).alias("post"), F.transform("b.post", lambda f: F.concat_ws(":", f["predicate"], f["subject"], f["value"])).alias("after"))
    got = {(r.n, r.family): r for r in df.collect()}
    assert {r.x for r in got.values()} == {"FAIL"} and {tuple(r.post) for r in got.values()} == {("COUNT", "EXISTS_IN_WORLD")}
    assert got[2, "ADD"].errors == ["DUPLICATE_DELETE_FACT_SLOT"] and got[0, "REMOVE"].errors == got[None, "ADD"].errors == ["DUPLICATE_DELETE_FACT_SLOT", "INVALID_POST_COUNT"]
    assert {k: (r.status, r.codes, r.after) for k, r in got.items()} == {
        (2, "REMOVE"): ("PASS", [], ["COUNT:s:1", "EXISTS_IN_WORLD:e:0"]), (0, "REMOVE"): ("FAIL", ["REJECT_TRANSITION_PRECONDITION_FAIL"], []), (2, "ADD"): ("PASS", [], ["COUNT:s:3", "EXISTS_IN_WORLD:new-e:1"]),
        (2, "MOVE"): ("PASS", [], ["RIGHT_OF:e"]), (2, "PAINT"): ("FAIL", ["REJECT_UNAUTHORIZED_RULE"], []), (None, "ADD"): ("FAIL", ["REJECT_TRANSITION_PRECONDITION_FAIL"], []),
    }
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("DUPLICATE_PRE_FACT_SLOT") == plan.count("REJECT_UNAUTHORIZED_RULE") == 1


def test_conflicts_take_one_aggregate_each(spark):
    rows = [(1, "BEFORE", 1, 2, "positive", None), (1, "AFTER", 1, 2, "positive", None), (1, "AFTER", 1, 2, "positive", None), (1, "BEFORE", 1, 2, "negative", None), (1, "ABOVE", 1, 2, "positive", 7), (1, "BELOW", 1, 2, "positive", 8), (1, "BEFORE", 1, None, "positive", None), (1, "AFTER", 1, None, "positive", None)]
    rows += [(2, "BEFORE", 1, 2, "positive", None), (2, "AFTER", 1, 2, "negative", None), (2, "COUNT", 1, None, "positive", 3), (2, "COUNT", 1, None, "positive", 4), (2, "COUNT", 2, None, "positive", None), (2, "COUNT", 2, None, "positive", 5), (3, "NEAR", 1, 2, "a", None), (3, "NEAR", 1, 2, "b", None), (3, "NEAR", 1, 3, None, None), (3, "NEAR", 1, 3, "b", None)]
    out = graph.conflicts(spark.createDataFrame(rows, "world int, predicate string, subject int, object int, polarity string, value bigint"))
    assert {(r.world, r.code): r.n for r in out.collect()} == {(1, "POLARITY_CONFLICT"): 1, (1, "EXCLUSIVITY_CONFLICT"): 4, (2, "COUNT_CONFLICT"): 1, (3, "POLARITY_CONFLICT"): 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "count(distinct" not in plan and "SortAggregate" not in plan


def test_labels_read_their_facts_once(spark):
    claims = spark.createDataFrame([(1, 1, 1, 3), (2, 1, 3, 1), (3, 1, 1, 2), (4, 2, 1, 2)], "claim_id int, world int, subject int, object int")
    facts = spark.createDataFrame([(1, "BEFORE", 1, 2), (1, "AFTER", 3, 2), (1, "BEFORE", 1, 2)], "world int, predicate string, subject int, object int").withColumn("mark", F.lit("facts"))
    out = graph.label_claims(claims, facts)
    assert {r.claim_id: (r.support, r.refute, r.label) for r in out.collect()} == {1: ("two_hop", None, "SUPPORTED"), 2: (None, "two_hop", "CONTRADICTORY"), 3: ("direct", None, "SUPPORTED"), 4: (None, None, "UNKNOWN")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 1
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_percentiles_are_spread_over_tasks(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") * F.col("id") % 1_009 / 8).alias("v")).unionByName(spark.createDataFrame([(8, 2.5), (9, None)], "g bigint, v double"))
    out = stats.percentiles(rows, ["g"], "v", low=0.025, mid=0.5, high=0.975, least=0.0, most=1.0)
    want = rows.where("v is not null").groupBy("g").agg(*[F.percentile("v", q) for q in (0.025, 0.5, 0.975, 0.0, 1.0)])
    near = lambda df: sorted(tuple(-1 if x is None else round(x, 9) for x in r) for r in df.collect())
    assert near(out) == near(want) and len(near(out)) == 4
    plan = relations.percentile_interpolated(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def kept_broadcasts(monkeypatch):
    """Rows of each broadcast that makes a table of ``graph.components``, as they come."""
    sizes, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: sizes.extend(made_by(df, "BroadcastExchange")) or write(df, name))
    return sizes


def test_split_precedence_broadcasts_great_keys_only(spark, monkeypatch):
    # pairs of equal texts, ids that name the one before them, and one text that a fifth of all share
    text = F.when(F.col("id") % 5 == 3, "same").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 2)))
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    sizes = kept_broadcasts(monkeypatch)
    out = reasoning.split_precedence(lambda name: docs)
    rounds = len(sizes)
    got = {r.doc_id: (r.split, r.outcome) for r in out.collect()}
    sizes += made_by(out, "BroadcastExchange")
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text, []).append(r.doc_id)
    root = plain([(d, ids[0]) for ids in groups.values() for d in ids] + [(d, max(0, d - 1)) for d in range(0, 4_000, 5)])
    level, top = [0] * 6 + [1] * 2 + [2] * 2, {}
    for d, c in root.items():
        top[c] = max(top.get(c, 0), level[d % 10])
    assert got == {d: (("train", "dev", "test")[level[d % 10]], "EXCLUDED" if level[d % 10] < top[c] else "KEPT") for d, c in root.items()}
    assert 0 < rounds < len(sizes) and max(sizes[1:]) < 1_000


def test_world_alias_components_broadcasts_great_keys_only(spark, monkeypatch):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.floor(F.col("id") / 3))).alias("text"))
    sizes = kept_broadcasts(monkeypatch)
    got = {r.doc_id: r.component for r in reasoning.world_alias_components(lambda name: docs).collect()}
    groups = {}
    for r in docs.where("text is not null").collect():
        groups.setdefault(r.text, []).append(r.doc_id)
    assert got == plain([(d, ids[0]) for ids in groups.values() for d in ids] + [(d, max(0, d - 1)) for d in range(0, 3_000, 5)])
    assert sizes and max(sizes) < 1_000


def test_a_text_of_many_worlds_is_no_single_task(spark, monkeypatch):
    edges = []
    monkeypatch.setattr(graph, "components", lambda rows: edges.append(rows) or rows)
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2_000, "same").otherwise(F.col("id").cast("string")).alias("text"))
    reasoning._clusters(lambda name: docs)
    assert sum(made_by(edges[0], "SortMergeJoin")) <= 2_000 and edges[0].count() == 4_800


SPREAD = ["sentence_pairs", "scene_claims", "sentences_read", "transition_successors", "transition_agreement", "sentence_drift", "proof_verification"]


@pytest.mark.parametrize("name", SPREAD)
def test_buckets_become_more_as_lines_do(spark, monkeypatch, name):
    sf, files, write = "/root/testdata/sf0.001", [], tables.dealt
    monkeypatch.setattr(tables, "BUCKET_ROWS", 700)
    for module in (proofs, readings, reasoning, scenes, wording):
        monkeypatch.setattr(module, "dealt", lambda *a: (files.append((out := write(*a)).inputFiles()), out)[1])
    out = catalog.QUERIES[name](spark, sf)
    assert compare(out, views(sf), catalog.ORACLE_SQL[name]) is None
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    buckets = [{re.search(r"_(\d+)\.c", path)[1] for path in f} for f in files]
    assert files and {len(b) for b in buckets} == {-(-lines // 700)} and spark.conf.get("spark.sql.shuffle.partitions") == "4"
