import numpy as np
import pytest

from proofgrid.llm import whitening
from proofgrid.llm.common import table
from proofgrid.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id bigint, embedding array<float>, _x string, n int, component string"


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, "y") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors, k):
    """Exact sums, covariance in extended precision, eigenvectors by a dense solver."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    centred = x.astype(np.longdouble) - s.astype(np.longdouble) / n
    cov = np.array(centred.T @ centred / n, dtype=float)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, deviation, np.array(centred, dtype=float) @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(got, n, deviation, white, explained, ids=None):
    rows = sorted(got.collect(), key=lambda r: (r["vec_id"], r["component"]))
    k = white.shape[1]
    assert len(rows) == len(white) * k
    assert {r["n"] for r in rows} == {n}
    assert [int(r["deviation"]) for r in rows[::k]] == deviation
    y = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    assert np.abs(y - white * np.sign((y * white).sum(axis=0))).max() < 1e-9
    assert np.allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    if ids is not None:
        assert [r["vec_id"] for r in rows[::k]] == ids


def test_whole_table(spark, sf):
    rows = sorted((r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect())
    got = op13_embedding_whitening(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(got, *brute([v for _, v in rows], 32), ids=[i for i, _ in rows])


@pytest.mark.parametrize("dim", [2, 7, 80])
def test_dimensions_and_layouts(spark, dim):
    r = np.random.default_rng(dim)
    vectors = r.standard_normal((300, dim)) * (1 + np.arange(dim)) + 5
    for parts in (1, 9):
        compare(whitening.whiten(frame(spark, vectors, parts), rows_per_block=64), *brute(vectors, min(dim, 32)))


def test_refused_rows(spark):
    r = np.random.default_rng(1)
    good = [list(v) for v in r.standard_normal((40, 5))]
    bad = [None, [], [1.0] * 4, [1.0, None, 1, 1, 1], [1, 2, float("nan"), 4, 5], [1, float("inf"), 3, 4, 5], [1, -float("inf"), 3, 4, 5], [3e38, 1, 1, 1, 1]]
    compare(whitening.whiten(frame(spark, [*bad, *good])), *brute(good, 5), ids=list(range(len(bad), len(bad) + 40)))


def test_empty_and_flat(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 9):
        assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_rank_and_repeats(spark):
    """Three directions in eight dimensions, every row twice: three components, the identity among them."""
    r = np.random.default_rng(3)
    base = r.integers(-40, 40, (60, 3)) @ r.integers(-3, 3, (3, 8))
    got = whitening.whiten(frame(spark, np.vstack([base, base])))
    assert {x["component"] for x in got.collect()} == {1, 2, 3}
    assert got.first()["identity_error"] < 1e-9


def test_large_deviations_are_exact():
    m = np.array([[2**40, -(2**40), 5], [1, 2, 3]], dtype=np.int64)
    base, rest, n = np.array([1, 2, 3]), np.array([5, 0, 7]), 10**7
    want = [sum((n * (int(v) - int(b)) - int(t)) ** 2 for v, b, t in zip(row, base, rest)) for row in m]
    assert [int(v) for v in whitening.deviations(m, n, base, rest)] == want


@pytest.mark.parametrize("spectrum", ["spread", "close", "repeated", "tiny"])
def test_jacobi_davidson(spectrum):
    r = np.random.default_rng(11)
    dim, k = 240, 20
    values = {
        "spread": np.sort(r.exponential(size=dim) ** 3)[::-1], "close": 1 + 1e-6 * np.arange(dim)[::-1] / dim, "repeated": np.repeat([9.0, 5.0, 2.0, 1.0], dim // 4),
        "tiny": np.r_[np.logspace(3, -4, 30), np.full(dim - 30, 1e-9)],
    }[spectrum]
    q = np.linalg.qr(r.standard_normal((dim, dim)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors, residuals = whitening.jacobi_davidson(lambda b: a @ b, dim, k)
    assert np.abs(got - values[:k]).max() < 1e-12 * values[0]
    assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-12 * values[0]
    assert residuals.max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_minres_against_a_dense_solve():
    r = np.random.default_rng(5)
    a = r.standard_normal((30, 30))
    a = a @ a.T
    found = np.linalg.qr(r.standard_normal((30, 4)))[0]
    project = lambda b: b - found @ (found.T @ b)
    rhs, shifts = project(r.standard_normal((30, 3))), np.array([0.5, 20.0, 70.0])
    t = whitening.minres(lambda b: a @ b, rhs, project, shifts, 200, 1e-13)
    for i in range(3):
        assert np.abs(project((a - shifts[i] * np.eye(30)) @ t[:, [i]])[:, 0] - rhs[:, i]).max() < 1e-6
    assert np.abs(found.T @ t).max() < 1e-9
