"""Selections whose choices depend on earlier ones: caps in phases, and turns over shared sources."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .select import globally_ranked


@dataclass(frozen=True)
class Cap:
    """At most ``most`` (the same for all rows of a value) taken rows may share a value of ``key``; a null key isn't capped."""

    name: str
    key: Column
    most: Column | int


@dataclass(frozen=True)
class Phase:
    """A walk over the rows where ``eligible`` holds, until ``target`` rows are taken: by this phase, or with ``of_all`` counting eligible rows that earlier phases took too."""

    name: str
    eligible: Column
    target: int
    of_all: bool = False


def phased(candidates: DataFrame, order: Sequence[str], caps: Sequence[Cap], phases: Sequence[Phase]) -> tuple[DataFrame, int]:
    """(order columns, phase) of the rows that walks in ``order``, one per phase, take; and the number of rounds.

    What a phase takes counts against the caps of the later ones, so minimums of some kind of row come first and what fills up comes last. A row is
    taken once. order: columns without nulls that tell rows apart.

    The walks are exact but not sequential. In a round a row is taken if, among the open rows, it is one of the first as many
    as each of its caps has left; rows before it can't use up any of them then. Rows with a full cap drop out. The first open row
    is always taken, so a phase ends. The state is the taken rows, and what they use up per value; candidates are read, not
    rewritten. A value's first rows are found with a bounded heap in each task, so a value that all rows share is no task's
    burden. Once the target is reached, only rows before the last one needed remain open. An ordering that makes each choice hang on the one before it takes as many rounds as choices;
    hashed orders take few.
    """
    keys = [f"_k{i}" for i in range(len(caps))]
    columns = [*order, *[c.key.alias(k) for c, k in zip(caps, keys, strict=True)], *[(c.most if isinstance(c.most, Column) else F.lit(c.most)).alias(f"_c{i}") for i, c in enumerate(caps)], *[F.coalesce(p.eligible, F.lit(False)).alias(f"_p{j}") for j, p in enumerate(phases)]]
    rows = materialize(candidates.select(*columns), "candidates")
    most = rows.agg(*[F.max(f"_c{i}").alias(f"m{i}") for i in range(len(caps))]).first()
    place, rounds = F.struct(*order), 0
    at = lambda row: F.struct(*[F.lit(row[c]).cast(rows.schema[c].dataType).alias(c) for c in order])
    taken = materialize(rows.limit(0).withColumn("_phase", F.lit(0)), "taken")
    for j, phase in enumerate(phases):
        need = phase.target - (taken.where(f"_p{j}").count() if phase.of_all else 0)
        mine, cut, parts = 0, None, []
        while need > 0:
            open_ = rows.where(f"_p{j}").join(taken.select(*order), list(order), "left_anti")
            if cut is not None:
                open_ = open_.where(place < at(cut))
            for i, k in enumerate(keys):
                used = taken.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(f"_u{i}"))
                open_ = open_.join(used, k, "left").withColumn(f"_left{i}", F.col(f"_c{i}") - F.coalesce(f"_u{i}", F.lit(0))).drop(f"_u{i}")
            open_ = open_.where(functools.reduce(Column.__and__, [F.col(k).isNull() | (F.col(f"_left{i}") > 0) for i, k in enumerate(keys)], F.lit(True)))
            sure = open_
            for i, k in enumerate(keys):
                first = open_.where(F.col(k).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(k).orderBy(*order))).where(F.col("_n") <= int(most[i] or 0)).where(F.col("_n") <= F.col(f"_left{i}")).drop("_n")
                sure = first if i == 0 and not rows.where(F.col(k).isNull()).limit(1).count() else sure.join(first.select(*order, F.lit(True).alias("_in")), list(order), "left").where(F.col("_in") | F.col(k).isNull()).drop("_in")
            now = materialize(sure.select(*rows.columns, F.lit(j + 1).alias("_phase")), "sure")
            n, rounds = now.count(), rounds + 1
            if not n:
                break
            parts.append(now)
            mine += n
            taken = taken.unionByName(now)
            if mine >= need:
                chosen = globally_ranked(functools.reduce(DataFrame.unionByName, parts), *order, name="_rank")
                cut = chosen.where(F.col("_rank") == need).first()
        if cut is not None:
            taken = taken.where((F.col("_phase") <= j) | (place <= at(cut)))
        taken = materialize(taken, "taken")
    names = F.element_at(F.array(*[F.lit(p.name) for p in phases]), F.col("_phase"))
    return taken.select(*order, names.alias("phase")), rounds


def turns(candidates: DataFrame, operator: str, source: str, order: Sequence[str], limit: int, block: int = 1_000) -> DataFrame:
    """(operator, source, order columns, turn, position): operators in turn take their next candidate whose source nobody has used, ``limit`` in all.

    Each turn goes round the operators in order; one without candidates left is passed over. order: columns that order the candidates of an operator and tell
    them apart; rows with a null operator or source don't take part.

    Turns are settled in blocks. In ``block`` turns of k operators at most k * block sources are used up, so each operator's next k * block
    sources that were free before are all that can matter; so many rows, whatever the candidates, are walked in one task. The next block starts without
    the sources used so far. There should be few operators.
    """
    whole = candidates.where(F.col(operator).isNotNull() & F.col(source).isNotNull())
    once = Window.partitionBy(operator, source).orderBy(*order)
    rows = materialize(whole.select(operator, source, *order).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n"), "turns")
    k = rows.select(operator).distinct().count()
    schema = rows.withColumns({"turn": F.lit(0).cast("bigint"), "position": F.lit(0).cast("bigint")}).schema
    done: list[DataFrame] = []
    taken = 0
    while taken < limit and k:
        free = rows
        if done:
            free = free.join(functools.reduce(DataFrame.unionByName, done).select(source), source, "left_anti")
        wide = min(k * block, limit - taken)
        near = free.withColumn("_n", F.row_number().over(Window.partitionBy(operator).orderBy(*order))).where(F.col("_n") <= wide)
        walked = materialize(near.select(*rows.columns).groupBy().applyInPandas(_walk(operator, source, list(order), min(limit - taken, k * block), block, len(done) * block, taken), schema), "walked")
        n = walked.count()
        if not n:
            break
        done.append(walked)
        taken += n
    return functools.reduce(DataFrame.unionByName, done) if done else rows.sparkSession.createDataFrame([], schema)


def _walk(operator: str, source: str, order: list[str], limit: int, block: int, turns_before: int, taken_before: int):
    """A function that walks the next candidates of all operators for ``block`` turns."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([operator, *order], ignore_index=True)
        sources = rows[source].tolist()
        ahead = [iter(places.tolist()) for _, places in rows.groupby(operator, sort=True).indices.items()]
        used, picked, at = set(), [], []
        for turn in range(block):
            before = len(picked)
            for places in ahead:
                found = next((k for k in places if sources[k] not in used), None)
                if found is not None and len(picked) < limit:
                    used.add(sources[found])
                    picked.append(found)
                    at.append(turn)
            if len(picked) == before or len(picked) >= limit:
                break
        out = rows.iloc[picked].reset_index(drop=True)
        out["turn"] = [turns_before + t + 1 for t in at]
        out["position"] = [taken_before + k + 1 for k in range(len(picked))]
        return out

    return run
