"""Near vectors against all pairs: links, components and recall on planted pairs."""

import math

import numpy as np
import plain
import pytest

from factloom.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<double>"


def all_pairs(ids, x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = []
    for a in range(0, len(x), 2_000):
        i, j = np.nonzero(unit[a : a + 2_000] @ unit.T >= threshold)
        pairs += [(ids[p], ids[q]) for p, q in zip(i + a, j, strict=True) if p < q]
    return pairs


def check(spark, ids, x):
    """Links and components of a small table are exactly those of all pairs."""
    pairs = all_pairs(ids, x)
    want, n = plain.components(ids, pairs), dict.fromkeys(ids, 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    rows = embeddings.near_vectors(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {i: (n[i], want[i], want[i] == i) for i in ids}


def turned(*degrees):
    return np.array([[math.cos(math.radians(d)), math.sin(math.radians(d))] for d in degrees])


def test_chain_through_the_largest_id(spark):
    check(spark, [1, 5, 3], turned(0, 20, 40))


@pytest.mark.parametrize("seed", [0, 1])
def test_long_chains(spark, seed):
    """Under 256 vectors are one cell, where nothing can be missed."""
    ids = np.random.default_rng(seed).permutation(240).tolist()
    check(spark, ids, turned(*(25 * k for k in range(7)), *np.linspace(200, 330, 233)))


def test_stars_with_the_largest_id_as_centre(spark):
    rng = np.random.default_rng(2)
    rows, ids = [], []
    for star in range(25):
        centre = rng.standard_normal(24)
        centre /= np.linalg.norm(centre)
        for _ in range(8):
            d = rng.standard_normal(24)
            d -= d @ centre * centre
            rows.append(math.cos(0.44) * centre + math.sin(0.44) * d / np.linalg.norm(d))
            ids.append(len(ids))
        rows.append(centre)
        ids.append(10_000 - star)
    check(spark, ids, np.array(rows))


def test_sparse_graphs_and_crowds(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 12))
    x = np.vstack([centres[rng.integers(0, 40, 180)] + 0.25 * rng.standard_normal((180, 12)), centres[0] + 0.02 * rng.standard_normal((60, 12)), np.repeat(centres[:2], 50, axis=0)])
    check(spark, rng.permutation(len(x)).tolist(), x)


def test_blocks_and_parts(monkeypatch):
    """A matrix's parts are those of its graph, found by plain union."""
    rng = np.random.default_rng(4)
    for density in (0.002, 0.02, 0.2):
        near = rng.random((60, 80)) < density
        rows, columns = embeddings.joined(near)
        want = plain.components(range(140), [(i, 60 + j) for i, j in zip(*np.nonzero(near), strict=True)])
        for i in range(60):
            for j in range(80):
                assert (rows[i] == columns[j]) == (want[i] == want[60 + j])


def test_crowds_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MEMBERS", 64)
    monkeypatch.setattr(embeddings, "VISITORS", 90)
    rng = np.random.default_rng(5)
    x = np.vstack([np.ones(8) + 0.3 * rng.standard_normal((500, 8)), rng.standard_normal((300, 8))])
    ids = rng.permutation(len(x)).tolist()
    pairs = all_pairs(ids, x)
    rows = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)).collect()}
    assert 0.97 * 2 * len(pairs) <= sum(r.n_links for r in rows.values()) <= 2 * len(pairs)
    assert np.mean([rows[i].component_id == c for i, c in plain.components(ids, pairs).items()]) > 0.97


def test_recall_of_planted_pairs(spark):
    """60,000 vectors; pairs planted at cosines of 0.90 to 0.95: over 0.95 of links and nothing else is found."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((50_000, 32)) * np.linspace(2, 0.3, 32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    d = rng.standard_normal((10_000, 32))
    d -= (d * base[:10_000]).sum(axis=1, keepdims=True) * base[:10_000]
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.95, 10_000)[:, None]
    x = np.vstack([base, cos * base[:10_000] + np.sqrt(1 - cos**2) * d])
    pairs = all_pairs(range(len(x)), x)
    assert len(pairs) >= 10_000
    schema = "vec_id bigint, embedding array<float>"
    rows = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], schema)).collect()}
    found = sum(r.n_links for r in rows.values())
    print("recall", found / (2 * len(pairs)))
    assert 0.95 * 2 * len(pairs) <= found <= 2 * len(pairs) + 20  # floats move a few cosines over the limit
    want = plain.components(range(len(x)), pairs)
    assert np.mean([rows[k].component_id == want[k] for k in range(len(x))]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id >= want[r.vec_id] for r in rows.values() if r.component_id != r.vec_id or want[r.vec_id] == r.vec_id)


def test_ragged_lengths(spark):
    """Hundreds of lengths: each is compared with its own only, without a set of jobs for each."""
    rng = np.random.default_rng(7)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(50)]
    rows += [(1_000 + 2 * n + k, [1.0 + 0.01 * k] * (n + 9)) for n in range(200) for k in range(2)]
    rows += [(None, [1.0] * 8), (5_000, None), (5_001, [1.0] * 9 + [float("nan")])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA + "")).collect()}
    assert len(got) == len(rows)
    assert all((got[1_000 + 2 * n + k].n_links, got[1_000 + 2 * n + k].component_id) == (1, 1_000 + 2 * n) for n in range(200) for k in range(2))
    assert got[None].n_links == got[5_000].n_links == got[5_001].n_links == 0


def test_any_magnitude_links(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [2.0, 2.1]), (4, [5e-324, 0.0]), (5, [1.7e308, 0.0]), (6, [0.0, -0.0]), (7, [1e200, float("inf")]), (8, [-1e300, -1e300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7), 8: (0, 8)}


def test_rank_is_the_place_in_the_order():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 10))
    index = embeddings.MultiIndex(embeddings.codebook(x[:, :5], 12, 1), embeddings.codebook(x[:, 5:], 9, 2))
    seen = index.visits(x, 108)
    for k in (0, 5, 60, 107):
        assert (np.abs(index.rank(x, seen[:, k]) - (k + 1)) <= 0).mean() > 0.99


@pytest.mark.parametrize("members", [64, 2_048])
def test_vectors_that_need_too_many_cells_are_compared_in_blocks(spark, monkeypatch, members):
    """Clusters so tight that a copy at the threshold lies beyond all codes: the whole grid would be visited."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 16))
    x = np.vstack([centres[rng.integers(0, 6, 500)] + 1e-3 * rng.standard_normal((500, 16)), rng.standard_normal((150, 16)), np.repeat(centres[:1], 30, axis=0)])
    monkeypatch.setattr(embeddings, "MOST_VISITS", 1)
    monkeypatch.setattr(embeddings, "MEMBERS", members)
    monkeypatch.setattr(embeddings, "PER_CELL", 4)
    check(spark, rng.permutation(len(x)).tolist(), x)
