"""Near-duplicate embeddings through an inverted multi-index.

Unit vectors are cut in halves, and each half has a codebook of its own; the pairs of codes
are the cells of a product grid. A vector lies in the cell of its nearest codes. It visits cells in
the order of the sum of its two distances (multi-sequence traversal) up to the number that a sample
with perturbed copies needs to reach the target recall (beyond MOST_VISITS, all blocks of vectors are compared instead), and all that it meets there is verified by
cosine in double precision. The number of codes grows with the table, so a cell holds about as many
vectors at any size.

Equal vectors are one vector of the index. A cell's visitors and members are dealt into blocks of
bounded size; a block gives counts per vector, and links each vector to the least one that it reaches
within the block. So all that a block joins stays joined, and a crowd of near copies never becomes all
its pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize
from .components import connected_components

#: The most vectors that codebooks and the number of visits are fitted on.
SAMPLE = 20_000
PER_CELL = 64
VISITORS, MEMBERS = 4_096, 2_048
#: With more cells to visit than this, the index is left for a comparison of all blocks of vectors.
MOST_VISITS = 1_024
#: Places (rows times cells that could be next) that a task orders at once.
SLAB = 8_000_000
LINKS = "node bigint, links bigint, to bigint"


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. A power of two comes out first, which is exact, so no square overflows or vanishes."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codebook(points: np.ndarray, count: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means of at most ``count`` centres."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.choice(len(distinct), min(count, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        size = np.bincount(near, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1), 0)


class MultiIndex:
    """Two codebooks and the order in which a vector visits their grid."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = first, second
        self.half = first.shape[1]

    def tables(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(units[:, : self.half], self.books[0]), distances(units[:, self.half :], self.books[1])

    def visits(self, units: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each vector, nearest first; the first is its own.

        Cell (i-th nearest, j-th nearest) comes after at least (i + 1)(j + 1) - 1 others, so only
        those with (i + 1)(j + 1) <= count can be among them.
        """
        height, width = (len(b) for b in self.books)
        count = min(count, height * width)
        pairs = [(i, j) for i in range(min(count, height)) for j in range(min(count // (i + 1), width))]
        i, j = np.array(pairs).T
        out = np.empty((len(units), count), dtype=np.int64)
        step = max(1, SLAB // max(len(pairs), height + width))
        for at in range(0, len(units), step):
            a, b = self.tables(units[at : at + step])
            order_a, order_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
            near_a, near_b = np.take_along_axis(a, order_a, axis=1), np.take_along_axis(b, order_b, axis=1)
            best = np.argsort(near_a[:, i] + near_b[:, j], axis=1, kind="stable")[:, :count]
            out[at : at + step] = np.take_along_axis(order_a, i[best], axis=1) * width + np.take_along_axis(order_b, j[best], axis=1)
        return out

    def rank(self, units: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Of how many cells the sum of distances is at most that of one cell, for each vector: no less than the place in which it visits the cell."""
        out, width = np.empty(len(units), dtype=np.int64), len(self.books[1])
        for at in range(0, len(units), 256):
            a, b = self.tables(units[at : at + 256])
            b_sorted = np.sort(b, axis=1)
            for k, cell in enumerate(cells[at : at + 256].tolist()):
                limit = (a[k, cell // width] + b[k, cell % width]) * (1 + 1e-12) + 1e-15
                out[at + k] = np.searchsorted(b_sorted[k], limit - a[k], side="right").sum()
        return out


def fit(sample: np.ndarray, total: int, threshold: float, recall: float, seed: int = 11) -> tuple[MultiIndex, int]:
    """An index for ``total`` vectors, and how many cells to visit.

    The visits are those that find ``recall`` of copies turned to exactly the threshold, the
    hardest pairs that count, each from either side. A copy's place in the order is counted from the sorted
    distances to the codes, so no order is written down; it may be the whole grid.
    """
    codes = max(1, min(4_096, math.isqrt(max(1, total // PER_CELL)), len(sample)))
    half = (sample.shape[1] + 1) // 2
    index = MultiIndex(codebook(sample[:, :half], codes, seed), codebook(sample[:, half:], codes, seed + 1))
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(2_000, len(sample)), replace=False)]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    angle = math.acos(min(threshold + 0.005, 1.0))
    y = math.cos(angle) * x + math.sin(angle) * noise / np.where(length > 0, length, 1)
    needed = np.minimum(index.rank(x, index.visits(y, 1)[:, 0]), index.rank(y, index.visits(x, 1)[:, 0]))
    return index, int(np.quantile(needed, recall, method="higher"))


def _assign(index: MultiIndex, count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 2_000):
                part = b.iloc[a : a + 2_000]
                if len(part):
                    cells = index.visits(_unit(np.vstack(part["vector"].to_numpy()).astype(float)), count)
                    yield pd.DataFrame({"node": part["node"], "copies": part["copies"], "vector": part["vector"], "visits": list(cells.astype(np.int32))})

    return run


def joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each row and of each column, where true entries join a row with a column.

    Breadth first, and each row and column is met once, so it takes time in proportion to the matrix.
    """
    rows, columns = np.where(near.any(axis=1), -1, np.arange(near.shape[0])), np.full(near.shape[1], -1)
    for first in range(near.shape[0]):
        if rows[first] >= 0:
            continue
        rows[first], at = first, np.array([first])
        while len(at):
            free = np.flatnonzero(columns < 0)
            across = free[near[np.ix_(at, free)].any(axis=0)]
            columns[across] = first
            left = np.flatnonzero(rows < 0)
            at = left[near[np.ix_(left, across)].any(axis=1)]
            rows[at] = first
    return rows, columns


def _block(threshold: float):
    """For applyInPandas: the links between one block's visitors and its cell's members."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["member", "node"], kind="stable")
        q, m = rows[~rows["member"]], rows[rows["member"]]
        if not len(q) or not len(m):
            return pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")
        ids_q, ids_m = q["node"].to_numpy(), m["node"].to_numpy()
        copies_q, copies_m = q["copies"].to_numpy(), m["copies"].to_numpy()
        unit_q, unit_m = (_unit(np.vstack(x["vector"].to_numpy()).astype(float)) for x in (q, m))
        visits_m = np.vstack(m["visits"].to_numpy())
        home_q = np.array([v[0] for v in q["visits"]])
        links_q, links_m = np.zeros(len(q), dtype=np.int64), np.zeros(len(m), dtype=np.int64)
        near = np.empty((len(q), len(m)), dtype=bool)
        for a in range(0, len(q), 512):
            part = slice(a, a + 512)
            same = ids_q[part][:, None] == ids_m
            near[part] = (unit_q[part] @ unit_m.T >= threshold) | same
            i, j = np.nonzero(near[part] & ~same)
            np.add.at(links_q, i + a, copies_m[j])
            # what a member finds itself, when it visits, isn't counted for it again
            unseen = ~(visits_m[j] == home_q[part][i][:, None]).any(axis=1)
            np.add.at(links_m, j[unseen], copies_q[part][i[unseen]])
        # the least id of each part, for all its rows and columns
        part_q, part_m = joined(near)
        part_m = np.where(part_m < 0, len(q) + np.arange(len(m)), part_m)
        parts, ids = np.concatenate([part_q, part_m]), np.concatenate([ids_q, ids_m])
        least = np.full(len(q) + len(m), np.iinfo(np.int64).max)
        np.minimum.at(least, parts, ids)
        out = pd.DataFrame({"node": ids, "links": np.concatenate([links_q, links_m]), "to": least[parts]})
        return out[(out["links"] > 0) | (out["to"] < out["node"])]

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors: vec_id (distinct integers), embedding (array of numbers); other columns are ignored. n_links counts the other
    vectors found with a cosine of ``threshold`` or more (none below it counts), equal ones included; component_id is the
    smallest vec_id that links reach; kept is whether that is the row's own. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without an id, link with nothing; vectors are compared with those of their own length
    only. The index is fitted on at most SAMPLE vectors, those with
    the smallest hashes; all vectors are indexed and all are queries. Lengths other than the commonest that have at most MEMBERS
    vectors need no index: each is one block, all of them in one job. No vectors give no rows.
    """
    v = F.transform(F.col(column), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("vector"))
    fine = F.size("vector") > 0
    fine = fine & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(fine & F.when(fine, F.exists("vector", lambda x: x != 0)).otherwise(False), F.lit(False)) & F.col("vec_id").isNotNull()
    known = rows.select("vec_id", F.when(usable, F.col("vector")).alias("vector"), F.when(usable, F.size("vector")).alias("dims"))
    # 128 bits tell vectors apart where only ids matter
    known = materialize(known.withColumns({"k1": F.when(usable, F.xxhash64("vector")), "k2": F.when(usable, F.xxhash64(F.lit("second"), "vector"))}), "vectors")
    distinct = materialize(known.where("vector is not null").groupBy("dims", "vector", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "distinct-vectors")
    lengths = {r["dims"]: r["count"] for r in distinct.groupBy("dims").count().collect()}
    alone = known.where("vector is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return alone
    most = max(lengths, key=lambda d: (lengths[d], d))
    indexed = [d for d in sorted(lengths) if d == most or lengths[d] > MEMBERS]
    found = [_links(distinct.where(F.col("dims") == d), lengths[d], threshold, recall) for d in indexed]
    if len(indexed) < len(lengths):
        few = distinct.where(~F.col("dims").isin(indexed)).select(F.col("dims").alias("cell"), "node", "copies", "vector", F.array(F.lit(0)).alias("visits"))
        both = few.withColumn("member", F.explode(F.array(F.lit(True), F.lit(False))))
        found.append(both.groupBy("cell").applyInPandas(_block(threshold), LINKS))
    links = materialize(functools.reduce(DataFrame.unionByName, found), "vector-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(links.where("to < node").select(F.col("node").alias("src"), F.col("to").alias("dst")))
    nodes = distinct.join(counts, "node", "left").join(parts, "node", "left")
    labelled = materialize(nodes.select("k1", "k2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "node").alias("component_id")), "labelled")
    every = join_counted(known.where("vector is not null").select("vec_id", "k1", "k2"), labelled, ["k1", "k2"], "copies", sum(lengths.values()), "inner")
    return every.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def _links(distinct: DataFrame, total: int, threshold: float, recall: float) -> DataFrame:
    """(node, links, to) by block: links found for a node and the least id among them."""
    part = min(1.0, 1.2 * SAMPLE / max(1, total))
    picked = distinct.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))).select("vector").limit(SAMPLE).collect()
    if not picked:  # a handful of vectors, none of which the hash took
        picked = distinct.select("vector").limit(SAMPLE).collect()
    index, count = fit(_unit(np.array([r["vector"] for r in picked], dtype=float)), total, threshold, recall)
    if count > MOST_VISITS:
        return _all_blocks(distinct, total, threshold)
    placed = materialize(distinct.select("node", "copies", "vector").mapInPandas(_assign(index, count), "node bigint, copies bigint, vector array<double>, visits array<int>"), "placed")
    cells = placed.groupBy(F.col("visits")[0].alias("cell")).agg(F.count("*").alias("members"))
    visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    cells = materialize(cells.join(visitors, "cell").select("cell", F.ceil(F.col("members") / MEMBERS).cast("int").alias("m"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("q")), "cells")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    members = placed.withColumn("cell", F.col("visits")[0]).join(cells, "cell").select("cell", own(F.col("m")).alias("m"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("q"), F.lit(True).alias("member"), "node", "copies", "vector", "visits")
    guests = placed.select("node", "copies", "vector", "visits", F.explode("visits").alias("cell")).join(cells, "cell")
    guests = guests.select("cell", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("m"), own(F.col("q")).alias("q"), F.lit(False).alias("member"), "node", "copies", "vector", F.slice("visits", 1, 1).alias("visits"))
    return members.unionByName(guests).groupBy("cell", "m", "q").applyInPandas(_block(threshold), LINKS)


def _all_blocks(distinct: DataFrame, total: int, threshold: float) -> DataFrame:
    """(node, links, to) from comparing each two blocks of about MEMBERS vectors once.

    For vectors so clustered that near cells don't tell copies from others. Each block is sent to as many tasks as there are blocks, so the work is
    the square of the vectors, but no task holds more than two blocks and nothing is missed.
    """
    count = max(1, -(-total // MEMBERS))
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.lit(count)).cast("int")
    rows = distinct.select("node", "copies", "vector", own.alias("own"), F.array(own).alias("visits"))
    members = rows.select(F.col("own").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("q"), F.lit(True).alias("member"), "node", "copies", "vector", "visits")
    guests = rows.select(F.explode(F.sequence(F.col("own"), F.lit(count - 1))).alias("cell"), F.col("own").alias("q"), F.lit(False).alias("member"), "node", "copies", "vector", "visits")
    return members.unionByName(guests).groupBy("cell", "q").applyInPandas(_block(threshold), LINKS)
