"""A schedule of training steps as a stream: what a step holds depends on its number alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.select import globally_ranked
from ..sources.tables import materialize

#: The largest primes below 2^31.
PRIMES = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497]


class StepCursorSource(DataSource):
    """``spark.read`` or ``spark.readStream``, format ``step_cursor``: (step, rank, index) of the first ``steps`` global batches.

    Step s of ``batch`` rows holds the indices from s * batch on, of which rank r of ``ranks`` has every ``ranks``-th. A stream's offset is the
    number of steps that were given out, so a restart from a checkpoint goes on with the next step, with a larger ``steps`` too; steps given out twice after a
    failure are the same rows. A task makes at most ``steps_per_task`` (10,000) steps.
    """

    @classmethod
    def name(cls) -> str:
        return "step_cursor"

    def schema(self) -> str:
        return "step bigint, rank int, index bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return StepReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StepStreamReader(self.options)


class _Steps:
    def __init__(self, options: dict):
        numbers = {k: int(options[k]) for k in ("steps", "batch", "ranks")}
        self.steps, self.batch, self.ranks = numbers.values()
        self.per_task = int(options.get("steps_per_task", 10_000))
        if self.steps < 0 or min(self.batch, self.ranks, self.per_task) < 1 or self.batch % self.ranks:
            raise ValueError(f"steps must not be negative, batch must be a multiple of ranks, here {numbers}")

    def ranges(self, first: int, end: int) -> list[InputPartition]:
        return [InputPartition((at, min(at + self.per_task, end))) for at in range(first, end, self.per_task)]

    def read(self, partition: InputPartition | None):
        for step in range(*partition.value) if partition else ():  # a table without steps is read as one partition, None
            index = np.arange(step * self.batch, (step + 1) * self.batch, dtype=np.int64)
            columns = [np.full(self.batch, step, dtype=np.int64), (index % self.ranks).astype(np.int32), index]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["step", "rank", "index"])


class StepReader(_Steps, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.ranges(0, self.steps)


class StepStreamReader(_Steps, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        return {"step": self.steps}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["step"] < start["step"]:
            raise ValueError(f"the checkpoint has {start['step']} steps, more than the {end['step']} asked for")
        return self.ranges(start["step"], end["step"])

    def commit(self, end: dict) -> None:
        """Nothing is kept: a step can be made again at any time."""


def permuted(place: Column, n: Column, label: Column) -> Column:
    """Where ``place`` of 0 to n - 1 goes in the permutation of that label: a prime's multiples, moved, modulo n (below 2^31 - 200)."""
    digest = F.sha2(label, 256)
    a, b = (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return (F.element_at(F.array(*[F.lit(p).cast("bigint") for p in PRIMES]), (a % len(PRIMES) + 1).cast("int")) * place + b) % n


def scheduled(cursor: DataFrame, samples: DataFrame, level: str, world: str, sample: str, seed: int) -> DataFrame:
    """The cursor's columns, level, world and sample: levels take turns, each goes through all of its worlds before one comes again, and
    a world through all of its samples.

    cursor: a table or stream with index. Orders of worlds differ by cycle, those of samples by the world's own cycle; all are functions of the index, so
    any step can be had without those before. Distinct samples with a level and world that aren't null take part; without any, no row comes.
    """
    rows = samples.select(F.col(level).alias("level"), F.col(world).alias("world"), F.col(sample).alias("sample")).where("level is not null and world is not null and sample is not null").distinct()
    placed = materialize(globally_ranked(rows, "level", "world", "sample", name="at"), "samples")
    worlds = placed.groupBy("level", "world").agg(F.min("at").alias("first"), F.count("*").alias("n_samples"))
    worlds = materialize(globally_ranked(worlds, "level", "world", name="at"), "worlds")
    levels = worlds.groupBy("level").agg(F.min("at").alias("first_world"), F.count("*").alias("n_worlds"))
    levels = materialize(globally_ranked(levels, "level", name="at").withColumn("turn", F.col("at") - 1).drop("at"), "levels")
    n = max(levels.count(), 1)

    names = cursor.columns
    out = cursor.withColumns({"turn": F.col("index") % n, "_k": F.floor(F.col("index") / n)}).join(levels, "turn")
    out = out.withColumns({"_cycle": F.floor(F.col("_k") / F.col("n_worlds")), "_offset": F.col("_k") % F.col("n_worlds")})
    label = F.concat_ws(":", F.lit(seed), "level", "_cycle")
    out = out.withColumn("_world", F.col("first_world") + permuted(F.col("_offset"), F.col("n_worlds"), label))
    out = out.join(worlds.select(F.col("at").alias("_world"), "world", "first", "n_samples"), "_world")
    label = F.concat_ws(":", F.lit(seed), "level", "world", F.floor(F.col("_cycle") / F.col("n_samples")))
    out = out.withColumn("_sample", F.col("first") + permuted(F.col("_cycle") % F.col("n_samples"), F.col("n_samples"), label))
    return out.join(placed.select(F.col("at").alias("_sample"), "sample"), "_sample").select(*names, "level", "world", "sample")
