import numpy as np
import pytest

from maskwright.llm import queries, whitening

AT = "/root/testdata/sf0.001"


def fitted(rows):
    """(x, exact sums, centred, eigenvalues falling, vectors as rows) by the library's solver."""
    x = np.floor(64 * np.array(rows, np.float64)).astype(np.int64) + 1_000_000
    c = x - 1_000_000 - (x - 1_000_000).mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(c))
    return x, x.sum(0).tolist(), c, e[::-1], v[:, ::-1].T


def check(found, ids, rows, components=32):
    """``ids`` name ``rows``, in order; None stands for a row that is fitted but not looked at."""
    x, sums, c, e, v = fitted(rows)
    n, k = len(x), min(components, x.shape[1])
    by = {r.vec_id: r for r in found}
    shown = [k for k, i in enumerate(ids) if i is not None]
    ids, x, c = [ids[k] for k in shown], x[shown], c[shown]
    for i, row in zip(ids, x.tolist()):
        assert by[i].n == n and by[i].deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums))
    got = np.array([by[i].whitened for i in ids])
    want = c @ v[:k].T / np.sqrt(e[:k])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < 1e-6 and np.abs(np.array(by[ids[0]].explained) - e[:k] / e.sum()).max() < 1e-12
    assert len(shown) < n or np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9
    assert all(r.identity_error < 1e-9 for r in found)


def cloud(spark, n=700, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * np.logspace(0, -1, dim) + rng.normal(size=dim) * 3).astype(np.float32)
    return rows, [(i, r.tolist()) for i, r in enumerate(rows)]


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_rotations_give_eigenvalues_and_vectors(d):
    rng = np.random.default_rng(d)
    half = rng.normal(size=(d, d))
    for matrix in (half @ half.T, np.diag(rng.normal(size=d)), np.zeros((d, d)), np.ones((d, d)), 1e-200 * (half + half.T), 1e150 * (half @ half.T)):
        values, vectors = whitening.jacobi(matrix)
        top = max(np.abs(matrix).max(), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() <= 1e-13 * d * top
        assert np.abs(vectors @ vectors.T - np.eye(d)).max() < 1e-13 * d and np.abs(vectors @ matrix - values[:, None] * vectors).max() <= 1e-13 * d * top


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix: its small eigenvalues are far below rounding of the largest."""
    from fractions import Fraction

    scale = [1.0, 2.0**-30, 2.0**-60]
    kernel = np.array([[1, 0.25, 0.125], [0.25, 1, 0.5], [0.125, 0.5, 1]])
    values, _ = whitening.jacobi(kernel * np.outer(scale, scale))
    exact = [[Fraction(kernel[i, j]) * Fraction(scale[i]) * Fraction(scale[j]) for j in range(3)] for i in range(3)]
    det2 = exact[0][0] * exact[1][1] - exact[0][1] * exact[1][0]
    det3 = sum(exact[0][i] * (exact[1][(i + 1) % 3] * exact[2][(i + 2) % 3] - exact[1][(i + 2) % 3] * exact[2][(i + 1) % 3]) for i in range(3))
    assert abs(values[1] / float(det2) - 1) < 1e-9 and abs(values[2] / float(det3 / det2) - 1) < 1e-9


def test_whitened_coordinates(spark):
    rows, data = cloud(spark)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(7)
    check(whitening.whiten(df).collect(), range(len(rows)), rows)
    check(whitening.whiten(df, components=5).collect(), range(len(rows)), rows, 5)


def test_a_mean_far_from_the_spread_loses_nothing(spark):
    rows, _ = cloud(spark, 300, 6)
    rows = rows.astype(np.float64) + np.array([1e6, -1e6, 0, 3e5, 1e3, 0])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), range(300), rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows, data = cloud(spark, 50, 3)
    odd = [(100, None), (101, [nan, 0.0, 1.0]), (102, [inf, 0.0, 1.0]), (103, [None, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1.0, 2.0]), (107, [5.0]), (None, [1.0] * 3), (3, data[3][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in data + odd], "vec_id long, embedding array<float>, n int, v string")
    found = whitening.whiten(df).collect()
    three = [r for r in found if len(r.whitened) == 3]
    check([r for r in three if r.vec_id is not None], [*range(50), None, None], [*rows, [1.0] * 3, rows[3]])
    assert len(three) == 52 and {r.n for r in three} == {52} and sum(r.vec_id is None for r in three) == 1
    assert len([r for r in three if r.vec_id == 3]) == 2 and len({tuple(r.whitened) for r in three if r.vec_id == 3}) == 1
    flat = [r for r in found if len(r.whitened) < 3]
    assert sorted((r.vec_id, r.n, r.deviation, r.whitened[0], r.explained[0], r.identity_error) for r in flat) == [(105, 2, 0, None, None, None), (106, 2, 0, None, None, None), (107, 1, 0, None, None, None)]
    assert whitening.whiten(df.limit(0)).count() == 0


def test_fewer_vectors_than_entries_and_large_values(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(4)], "vec_id long, embedding array<double>")
    found = whitening.whiten(df).collect()
    got = np.array([[np.nan if v is None else v for v in r.whitened] for r in found])
    assert np.isnan(got[:, 3:]).all() and np.abs(got[:, :3].T @ got[:, :3] / 4 - np.eye(3)).max() < 1e-12 and found[0].identity_error < 1e-12
    large = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(large).collect() if r.vec_id != 3} == {None}


def test_query_over_the_whole_table(spark):
    vectors = spark.read.parquet(f"{AT}/embeddings.parquet").collect()
    rows = queries.op11_embedding_whitening(spark, AT).collect()
    assert len(rows) == 32 * len(vectors) and {r.component for r in rows} == set(range(1, 33))
    by = {}
    for r in sorted(rows, key=lambda r: r.component):
        by.setdefault(r.vec_id, []).append(r)

    class Row:
        def __init__(self, rows):
            self.vec_id, self.n, self.deviation, self.identity_error = rows[0].vec_id, rows[0].n, rows[0].deviation, rows[0].identity_error
            self.whitened, self.explained = [r.whitened for r in rows], [r.explained for r in rows]

    check([Row(r) for r in by.values()], [v.vec_id for v in vectors], [v.embedding for v in vectors])
