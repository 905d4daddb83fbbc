import math
from fractions import Fraction

import numpy as np
import pytest

from touchline.llm import whitening
from touchline.llm.queries import QUERIES
from touchline.llm.whitening import inertia, leading

SCHEMA = "vec_id long, embedding array<float>"


def matrices():
    r = np.random.default_rng(3)
    a = r.standard_normal((48, 200))
    q, _ = np.linalg.qr(r.standard_normal((30, 30)))
    close = q @ np.diag(np.r_[7, 7, 7 - 1e-9, 7 - 2e-9, 3, 3 + 1e-12, 2, 1, np.zeros(22)]) @ q.T
    v = r.standard_normal((20, 1))
    return [a @ a.T / 200, np.diag(np.repeat([9.0, 5, 5, 5, 2, 2, 1, 1], 3)), np.eye(9) * 3, (close + close.T) / 2, np.diag([5.0, 3, 1e-3, 0, 0]), v @ v.T * 1e6 + np.eye(20) * 1e-3, np.array([[2.5]])]


@pytest.mark.parametrize("matrix", matrices())
def test_leading_eigenvectors(matrix):
    values, vectors = leading(matrix)
    want = np.linalg.eigvalsh(matrix)[::-1][:8]
    want = want[want > max(matrix.trace() * 1e-12, 1e-13 * np.abs(matrix).sum(axis=1).max())]
    assert len(values) == len(want) and np.abs(values - want).max() <= want[0] * 1e-13
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(vectors @ matrix - values[:, None] * vectors).max() <= want[0] * 1e-13


def test_inertia_of_indefinite_matrices():
    r = np.random.default_rng(5)
    for n in (2, 3, 10, 33):
        for _ in range(5):
            a = r.standard_normal((n, n))
            a = a + a.T
            np.fill_diagonal(a, a.diagonal() * r.integers(0, 2, n))
            w = np.linalg.eigvalsh(a)
            assert inertia(a) == ((w < 0).sum(), 0, (w > 0).sum())
    assert inertia(np.array([[0.0, 1], [1, 0]])) == (1, 0, 1) and inertia(np.zeros((3, 3))) == (0, 3, 0) and inertia(np.zeros((0, 0))) == (0, 0, 0)


def check(rows, got, most=8):
    """Against exact whole-number sums and numpy's eigenvalues."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept], dtype=object)
    n, d = x.shape
    total = x.sum(axis=0)
    y = np.array([[float(Fraction(n * int(c) - int(s), n)) for c, s in zip(row, total)] for row in x])
    cov = y.T @ y / n
    w, u = np.linalg.eigh(cov)
    k = min(most, d)
    values, vectors = w[::-1][:k], u[:, ::-1][:, :k].T
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    exact = sorted((i, int(((n * row - total) ** 2).sum())) for (i, _), row in zip(kept, x))
    for c, part in by.items():
        assert sorted((r.vec_id, r.deviation) for r in part) == exact and all(r.n == n and int(r.deviation_exact) == r.deviation for r in part)
        assert all(abs(r.explained / (values[c - 1] / cov.trace()) - 1) < 1e-10 and 0 <= r.identity_error < 1e-9 for r in part)
        want = dict(zip([i for i, _ in kept], y @ vectors[c - 1] / math.sqrt(values[c - 1])))
        sign = max(((r.whitened, want[r.vec_id]) for r in part), key=lambda p: abs(p[1]))
        sign = 1 if sign[0] * sign[1] > 0 else -1
        assert max(abs(r.whitened - sign * want[r.vec_id]) for r in part) < 1e-8
    return by


def test_table_with_bad_rows(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(900, None), (901, []), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    rows += [rows[5]] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("1 as Embedding", "*", "'x' as n", "2 as whitened")
    check(rows, whitening.whiten(df).collect())


def test_small_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert make([]) == [] and make([(1, [1.0, 2.0])]) == [] and make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = make([(1, [1.0, 2.0]), (None, [2.0, 2.0]), (3, [9.0])])
    assert [(r.component, r.n, r.deviation) for r in two] == [(1, 2, 1024 ** 2)] * 2 and sorted(r.whitened for r in two) == [-1.0, 1.0] and {r.explained for r in two} == {1.0}


def test_huge_entries_are_exact_or_marked(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 3.0])], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and all(r.deviation is None for r in got if r.vec_id < 3) and all(int(r.deviation_exact) >= 0 for r in got)
    x = {1: (2**40 + 100000, 100000), 2: (-2**40 + 100000, 101024), 3: (105120, 103072)}
    s = [sum(v[i] for v in x.values()) for i in range(2)]
    assert {r.vec_id: int(r.deviation_exact) for r in got} == {i: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for i, v in x.items()}


def test_query_over_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(rows, QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.01").collect())
