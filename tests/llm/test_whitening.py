"""Whitening against numpy's eigenvectors; spectrum slicing; edge cases."""

import numpy as np
import pytest

from faultline.llm import whitening
from faultline.llm.common import prepare


def _matrix(kind: str, d: int, rng) -> np.ndarray:
    if kind == "equal":
        return np.eye(d) * 3
    if kind == "two":
        return np.diag([5.0] * (d // 2) + [1.0] * (d - d // 2))
    if kind == "flat":
        v = rng.standard_normal((d, min(2, d)))
        return v @ v.T
    if kind == "close":
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        return q @ np.diag(1 + 1e-9 * np.arange(d)) @ q.T
    a = rng.standard_normal((d, d + 3))
    return a @ a.T


@pytest.mark.parametrize("kind", ["plain", "equal", "two", "flat", "close"])
@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
def test_leading_pairs(kind, d):
    rng = np.random.default_rng(d)
    m = _matrix(kind, d, rng)
    m = (m + m.T) / 2
    values, vectors = whitening.leading(m, 4)
    want = np.linalg.eigvalsh(m)[::-1]
    want = want[want > whitening.FLAT * np.trace(m)][:4]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.abs(m @ vectors - vectors * values).max() < 1e-11 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_counts_of_eigenvalues_above_a_shift():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a = rng.standard_normal((7, 7))
        a = a + a.T  # indefinite: blocks of two occur
        shift = float(rng.standard_normal()) * 3
        assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    zero = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert [whitening.above(zero, s) for s in (-2, 0, 0.5, 2)] == [2, 1, 1, 0]


def test_rows_against_numpy(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((120, 6)).astype(np.float32) * [5, 3, 2, 1, 1, 1]
    rows = [(i, v[i % 100].tolist(), "x") for i in range(120)]
    rows += [(200, None, "x"), (201, [None] * 6, "x"), (202, [float("nan")] * 6, "x"), (203, [float("inf")] + [0.0] * 5, "x"),
             (204, [1.0] * 5, "x"), (None, v[3].tolist(), "x"), (3, v[3].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").repartition(7)
    got = whitening.whiten(df).collect()
    x = np.floor(256 * np.array([r[1] for r in rows[:120]])).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    y = u - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    want = (x - s / n) @ q / np.sqrt(e)
    by_id = {r["id"]: r for r in got}
    assert len(got) == 120 + 3 and not {200, 201, 202, 203} & set(by_id)
    assert by_id[204]["whitened"] is None
    own = np.array([by_id[i]["whitened"] for i in range(120)])
    sign = np.sign((own * want).sum(axis=0))
    assert np.abs(own - want * sign).max() < 1e-10
    assert [by_id[i]["deviation"] for i in range(120)] == ((n * x - s) ** 2).sum(axis=1).tolist()
    assert by_id[0]["n"] == n and by_id[None]["whitened"] == by_id[3]["whitened"]
    assert np.allclose(by_id[0]["explained"], e / np.linalg.eigvalsh(y.T @ y / n).sum())
    assert 0 <= by_id[0]["identity_error"] < 1e-10


def test_few_dimensions_equal_vectors_large_entries_and_no_rows(spark):
    prepare(spark)
    ddl = "vec_id long, embedding array<float>"
    two = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(9)], ddl)).collect()
    assert {len(r["whitened"]) for r in two} == {2}
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], ddl)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in same] == [(1, 0, [], None)] * 9
    large = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3e8, 2.0])], ddl)).collect()
    assert len(large) == 3 and all(r["n"] == 3 and np.isfinite(r["whitened"]).all() for r in large)
    assert {r["id"]: r["deviation"] for r in large}[1] is None
    assert whitening.whiten(spark.createDataFrame([], ddl)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], ddl)).count() == 2
