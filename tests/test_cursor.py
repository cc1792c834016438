import pytest
from pyspark.sql import functions as F

from factloom.streaming import cursor, ingest


@pytest.fixture
def source(spark):
    spark.dataSource.register(cursor.StepCursorSource)
    return lambda reader, **options: reader.format("step_cursor").options(**options).load()


def test_a_restart_repeats_and_loses_nothing(spark, source, tmp_path):
    samples = spark.range(60).select((F.col("id") % 4).alias("level"), (F.col("id") % 12).alias("world"), "id")
    seen = 0
    for steps in (3, 3, 7, 12):
        stream = cursor.scheduled(source(spark.readStream, steps=steps, batch=8, ranks=2, steps_per_task=2), samples, "level", "world", "id", 5)
        ingest.write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(r["index"] for r in rows) == list(range(8 * steps)) and all((r.step, r.rank) == (r["index"] // 8, r["index"] % 2) for r in rows)
        seen = max(seen, len(rows))
    whole = cursor.scheduled(source(spark.read, steps=12, batch=8, ranks=2), samples, "level", "world", "id", 5).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, rows)) and seen == 96


def test_levels_worlds_and_samples_take_turns(spark, source):
    """Worlds of one to four samples: within a cycle of a level each world comes once, within a world's cycle each sample."""
    table = [(level, f"w{level}{w}", 100 * level + 10 * w + k) for level in range(3) for w in range(2 + level) for k in range(1 + w)]
    extra = [*table, table[0], (None, "x", 1), (1, None, 2), (1, "y", None)]
    samples = spark.createDataFrame(extra, "level int, world string, id int")
    rows = sorted(cursor.scheduled(source(spark.read, steps=30, batch=12, ranks=3), samples, "level", "world", "id", 1).collect(), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == list(range(360)) and [r.level for r in rows] == [k % 3 for k in range(360)]
    assert {(r.level, r.world, r.sample) for r in rows} == set(table)
    orders = set()
    for level in range(3):
        own, n = [r for r in rows if r.level == level], 2 + level
        for at in range(0, len(own) - n + 1, n):
            assert len({r.world for r in own[at : at + n]}) == n
            orders.add((level, *[r.world for r in own[at : at + n]]))
        for w in range(n):
            ids = [r.sample for r in own if r.world == f"w{level}{w}"]
            assert all(len(set(ids[at : at + 1 + w])) == 1 + w for at in range(0, len(ids) - w, 1 + w))
    assert len(orders) > 6


def test_permutations(spark):
    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).select(cursor.permuted(F.col("id"), F.lit(n), F.lit(f"a:{n}")).alias("to")).collect()
        assert sorted(r.to for r in rows) == list(range(n))


def test_wrong_options_and_no_samples(spark, source):
    with pytest.raises(Exception, match="multiple of ranks"):
        source(spark.read, steps=1, batch=3, ranks=2).collect()
    empty = spark.createDataFrame([], "level int, world int, id int")
    assert cursor.scheduled(source(spark.read, steps=2, batch=4, ranks=2), empty, "level", "world", "id", 1).count() == 0
    assert source(spark.read, steps=0, batch=4, ranks=2).count() == 0
