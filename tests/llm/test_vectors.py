"""Whitening and nearest neighbours against numpy, exact fractions and all pairs."""

from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F
from tarnwork.llm import neighbours, whitening
from tarnwork.llm.common import table
from tarnwork.llm.queries import QUERIES
from tests.llm import tables

VECTORS = "vec_id long, embedding array<float>, label int"


def scatter_like(seed, rows, d, rank=None):
    z = np.random.default_rng(seed).integers(-9, 10, (rows, rank or d))
    if rank:
        z = z @ np.random.default_rng(seed + 1).integers(-3, 4, (rank, d))
    z = z.astype(object)
    s = z.sum(axis=0)
    return rows * (z.T @ z) - np.outer(s, s)


def leverrier(matrix):
    """Coefficients of det(x - matrix) by exact fractions."""
    d = len(matrix)
    a = [[Fraction(int(x)) for x in row] for row in matrix]
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][l] * m[l][j] for l in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        product = sum(a[i][l] * m[l][i] for i in range(d) for l in range(d))
        out.append(-product / k)
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("seed,rows,d,rank", [(0, 20, 1, None), (1, 30, 5, None), (2, 40, 8, 3), (3, 6, 9, None)])
def test_polynomial_is_exact(spark, seed, rows, d, rank):
    matrix = scatter_like(seed, rows, d, rank)
    assert whitening.characteristic_polynomial(spark, matrix) == leverrier(matrix)


def test_polynomial_with_zero_subdiagonals_and_primes():
    matrix = np.diag([3, 5, 5, 9, 0]).astype(object)
    for p in (2147483647, 101):
        assert whitening.polynomial_modulo(matrix, p).tolist() == [c % p for c in leverrier(matrix)]
    assert whitening.primes_below(20, 8) == [19, 17]
    assert [n for n in range(200) if whitening._is_prime(n)] == [n for n in range(2, 200) if all(n % k for k in range(2, n))]


def test_roots_with_multiplicity():
    poly = leverrier(np.diag([7, 7, 7, 4, 2, 0, 0]))
    assert [(r >> whitening.PLACES, m) for r, m in whitening.largest_roots(poly, 10)] == [(7, 3), (4, 1), (2, 1)]
    assert [m for _, m in whitening.largest_roots(poly, 3)] == [3]
    assert whitening.roots_above(poly, 4) == 3 and whitening.roots_above(poly, 3) == 4


@pytest.mark.parametrize("seed", range(3))
def test_components_solve_the_matrix(seed):
    matrix = scatter_like(seed, 50, 10)
    for root, size in whitening.largest_roots(leverrier(matrix), 10):
        v = whitening.null_space(matrix, root, size)
        value = root / 2**whitening.PLACES
        assert np.abs(matrix.astype(float) @ v - value * v).max() < 1e-11 * value + 1e-9
        assert np.abs(v.T @ v - np.eye(size)).max() < 1e-15


def test_shared_roots_give_an_orthonormal_basis():
    turn = np.array([[2, -1, 2], [2, 2, -1], [-1, 2, 2]], object)  # three times a rotation
    matrix = turn @ np.diag([50, 50, 3]).astype(object) @ turn.T
    (root, size), (_, one) = whitening.largest_roots(leverrier(matrix), 3)
    v = whitening.null_space(matrix, root, size)
    assert (size, one) == (2, 1) and np.abs(v.T @ v - np.eye(2)).max() < 1e-15
    assert np.abs(matrix.astype(float) @ v - 450 * v).max() < 1e-10


def test_whitening_equals_numpy(spark, sf):
    got = QUERIES["op12_whitening"](spark, sf).toPandas()
    source = table(spark, sf, "embeddings").toPandas()
    x = np.floor(64 * np.array(source.embedding.tolist(), np.float64)) + 1_000_000
    n = len(x)
    values, vectors = np.linalg.eigh(np.cov((x - 1_000_000).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = ((x - x.mean(axis=0)) @ vectors / np.sqrt(values))[:, :32]
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[source.vec_id].to_numpy()
    sign = np.sign((wide * want).sum(axis=0))
    assert np.abs(wide * sign - want).max() < 1e-8
    first = got.drop_duplicates("component").sort_values("component")
    assert np.allclose(first.explained, (values / values.sum())[:32], rtol=1e-12)
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    whole = x.astype(np.int64).astype(object)
    exact = {i: int(d) for i, d in zip(source.vec_id, ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1), strict=True)}
    assert all(exact[i] == d for i, d in zip(got.vec_id, got.deviation, strict=True))


def test_whitening_drops_what_is_not_finite_and_keeps_repeats(spark):
    rows = tables.odd_vectors()
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 6 and None not in r[1] and np.isfinite(r[1]).all()]
    out = whitening.components(spark.createDataFrame(rows, VECTORS))
    assert out.count() == 6 * len(kept) and out.where("vec_id IS NULL").count() == 6
    assert {r.n for r in out.select("n").distinct().collect()} == {len(kept)}
    assert "label" in out.columns and "embedding" in out.columns


def test_whitening_of_few_constant_and_large_values(spark):
    frame = lambda vectors: spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], VECTORS.replace("float", "double"))
    assert whitening.components(frame([[1.0, 2.0]])).count() == 0
    assert whitening.components(frame([[1.0, 2.0]] * 5)).count() == 0
    two = whitening.components(frame([[1.0, 0.0, 3.0], [2.0, 0.0, 3.0]])).collect()
    assert [(r.component, abs(round(r.whitened, 12)), r.explained, r.deviation) for r in two] == [(1, 1.0, 1.0, 64 * 64)] * 2
    huge = whitening.components(frame([[1e300, 1.0], [-1e300, 2.0], [5e7, 1e9]]))
    assert huge.count() == 6 and huge.first().identity_error < 1e-6


def nearest_by_all_pairs(rows, k=5, step=50):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 6 and None not in r[1]]
    rows = [(i, tuple(np.float32(x) for x in v)) for i, v, _ in rows if np.isfinite(v).all() and any(np.float32(x) != 0 for x in v)]
    rows = sorted(set(rows))
    out = {}
    for q in rows:
        if q[0] % step == 0:
            a = np.array(q[1], float)
            scored = []
            for r in rows:
                if r != q:
                    b = np.array(r[1], float)
                    a1, b1 = a / abs(a).max(), b / abs(b).max()
                    scored.append((-min(1.0, a1 @ b1 / np.sqrt((a1 @ a1) * (b1 @ b1))), r[0]))
            out.setdefault(q[0], []).append([(i, -s) for s, i in sorted(scored)[:k]])
    return out


@pytest.mark.parametrize("shard", [4000, 40])
def test_neighbours_of_odd_rows_equal_all_pairs(spark, shard):
    rows = tables.odd_vectors()
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, shard=shard).collect()
    want = nearest_by_all_pairs(rows)
    assert {r.query_id for r in got} == set(want)
    assert len(got) == 5 * sum(map(len, want.values()))
    for query, lists in want.items():
        scores = sorted(r.score for r in got if r.query_id == query)
        assert np.allclose(scores, sorted(s for one in lists for _, s in one), rtol=0, atol=1e-12), query
    copies = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 250)
    assert copies == [(1, 200), (2, 201), (3, 202), (4, 203), (5, 204)]
    assert sorted((r["rank"], r.vec_id) for r in got if r.query_id == 200)[0] == (1, 201)


def test_neighbours_recall(spark, sf):
    got = QUERIES["op11_neighbours"](spark, sf).collect()
    source = table(spark, sf, "embeddings").toPandas()
    x = np.array(source.embedding.tolist(), np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    ids = source.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[q]
        cosine[q] = -2
        best = set(ids[np.argsort(-cosine)[:5]])
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == ids[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        assert all(abs(s - cosine[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in mine)
        hits, total = hits + len(best & {m[1] for m in mine}), total + 5
    assert hits >= 0.9 * total


def test_fewer_rows_than_asked_for(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], VECTORS)
    got = neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 2), (2, 1)]
    assert neighbours.nearest(frame.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("kind", ["spread", "copies", "line"])
def test_every_node_of_a_graph_is_reachable(kind):
    order = np.random.default_rng(1)
    x = order.normal(size=(1500, 16))
    if kind == "copies":
        x[:900] = x[0] + 1e-5 * order.normal(size=(900, 16))
    if kind == "line":
        x = np.stack([np.cos(np.arange(1500) / 900), np.sin(np.arange(1500) / 900)], axis=1)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    edges, entry = neighbours.build(unit)
    assert neighbours._reached(edges, entry).all() and edges.shape == (1501, neighbours.DEGREE)
    assert (edges[:-1] != np.arange(1500)[:, None]).all()
    found = neighbours.search(unit, (edges, entry), unit)
    assert np.mean(found[:, 0] == np.arange(1500)) > 0.99


def test_relaxed_pruning_by_its_rule():
    order = np.random.default_rng(2)
    unit = order.normal(size=(60, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    got = neighbours.robust_prune(unit, np.arange(60), np.tile(np.arange(60), (60, 1)))
    away = np.sqrt(np.maximum(2 - 2 * unit @ unit.T, 0))
    for own in range(60):
        left, kept = [j for j in np.argsort(away[own], kind="stable") if j != own], []
        while left and len(kept) < neighbours.DEGREE:
            kept.append(left[0])
            left = [j for j in left[1:] if neighbours.RELAXATION * away[kept[-1], j] > away[own, j]]
        assert [j for j in got[own] if j >= 0] == kept
