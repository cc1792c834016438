import pytest

from factloom.functions.answers import whole_members
from factloom.operators import metrics


def test_an_incomplete_pair_raises(spark):
    rows = [(1, "a", "a"), (1, "b", "b"), (2, "a", "a"), (2, "b", None)]
    df = spark.createDataFrame(rows, "pair_id int, gold string, pred string")
    assert {r.pair_id: r.correct for r in metrics.strict_pairs(df).collect()} == {1: True, 2: False}
    with pytest.raises(Exception, match="INCOMPLETE_GOLD_PAIR:3"):
        metrics.strict_pairs(df.union(spark.createDataFrame([(3, "a", "a")], df.schema))).collect()


def test_members_of_cut_objects():
    assert whole_members('{"a": 1, "b": "x, y", "c": [1, {"d": "}"') == {"a": 1, "b": "x, y"}
    assert whole_members('{"a": 1') == {} and whole_members('{"a": 1 ') == {"a": 1} and whole_members('{"a": true') == {"a": True}
    assert whole_members('{"a": 1, "a": 2, "b') == {} and whole_members('{"a": 1, "a"') == {} and whole_members('{"a": 1} x') == {}
    assert whole_members('{"a": "b\\"') == {} and whole_members("") == {} and whole_members("{") == {} and whole_members("[1") == {}
