"""Work by order is shuffled once: what is made of dealt lines stays where they lie."""

import contextlib

from factloom.operators import proofs, readings
from factloom.operators import transitions as tr
from factloom.plans import lineage, reasoning, scenes, wording
from factloom.sources.tables import dealt, in_place

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def without_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        with in_place(spark):
            yield lambda df: df._jdf.queryExecution().executedPlan().toString().count("- Exchange ")
    finally:
        spark.conf.set(name, before)


def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def test_claims_of_scenes_shuffle_their_counts_only(spark):
    with without_broadcast(spark) as shuffles:
        parts = scenes._scenes(tables(spark))
        assert shuffles(scenes._candidates(*parts)) == 0
        assert shuffles(scenes._claims(*parts)) == 2


def test_sentences_are_read_where_their_facts_lie(spark):
    with without_broadcast(spark) as shuffles:
        f = wording._facts(tables(spark))
        read = readings.read(wording._none(f.withColumn("text", wording._told(f))), wording._entities(f), "n")
        assert shuffles(read) == 0
        assert read.where("code is null and given.n is not null").count() == f.count()


def test_transitions_are_compared_where_their_states_lie(spark):
    with without_broadcast(spark) as shuffles:
        parts = reasoning._transitions(tables(spark))
        assert shuffles(tr.executed(*parts)) == shuffles(tr.checked(*parts[:2], "state")) == 0
        assert shuffles(reasoning._compared(*parts)) == 0


def test_claims_are_proved_where_their_worlds_lie(spark):
    with without_broadcast(spark) as shuffles:
        parts = reasoning._ruled(tables(spark))
        assert shuffles(proofs.matches(*parts)) == 0
        assert shuffles(proofs.verified(*parts)) == 0


def test_chains_stay_with_their_pairs(spark):
    """Only ids and worlds are shuffled: distinct worlds, one of each id, ids to them and back."""
    with without_broadcast(spark) as shuffles:
        chain, *_ = lineage.chain_tables(dealt(tables(spark)("orders"), "o_orderkey", "orders"))
        assert shuffles(chain) <= 5
