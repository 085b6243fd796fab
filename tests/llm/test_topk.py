"""Exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import topk


def brute(rows, k, every):
    vec = {}
    for i, x in rows:
        if i is not None and x is not None and all(e is not None and np.isfinite(e) for e in x):
            vec[i] = [int(np.floor(256 * float(e))) for e in x]
    out = []
    for q in vec:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(vec[q], vec[c], strict=True)), c) for c in vec if c != q and len(vec[c]) == len(vec[q]))
            out += [(q, r + 1, c, -m) for r, (m, c) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread,threshold", [(0.0, 0.6), (1.0, 0.6), (0.05, 0.2), (1.0, 0.0)])
def test_against_brute_force(spark, monkeypatch, spread, threshold):
    monkeypatch.setattr(topk, "COORDINATE_COSINE", threshold)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(8, 12))
    x = centers[rng.integers(0, 8, 700)] + 0.15 * rng.normal(size=(700, 12))
    x *= np.exp(spread * rng.normal(size=(700, 1)))
    x[100:140] = x[100]  # ties
    rows = [(i, [float(e) for e in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(900, None), (950, [None] + [1.0] * 11), (1000, [float("nan")] * 12), (1050, [float("inf")] * 12),
             (1100, [0.0] * 12), (1150, [1.0, 2.0]), (1151, [3.0, 1.0]), (None, [1.0] * 12), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.search(df, F.col("id") % 50 == 0, 5, bucket=90, group=2, query_block=7).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 50)


def test_empty_and_small_tables(spark):
    df = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("id") % 50 == 0, 5).collect()] == [(50, 1, 51, 256 * 512)]
    assert topk.search(df.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_large_components_stay_exact():
    a = np.array([[2.0**25 + 1, 2.0**25 - 3, 1.0]])
    assert topk.products(a, a)[0, 0] == sum(int(x) ** 2 for x in a[0])


def test_finite_components_of_any_size(spark):
    """Large finite components are multiplied exactly; a score beyond a long is the largest or smallest long."""
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**40, -1.0]), (3, [-(2.0**40), 0.0]), (4, [0.0, 2.0**30]),
            (5, [3e38, 1.0]), (6, [0.0, 0.0]), (50, [3e38, 3e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.search(df, F.col("id") % 50 == 0, 5, bucket=3, group=1).collect()]
    ints = {i: [int(x) * 256 for x in np.float32(v).astype(float)] for i, v in rows}
    want = []
    for q in (0, 50):
        top = 2**63 - 1
        s = sorted((-max(min(sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), top), -top), c) for c in ints if c != q)
        want += [(q, r + 1, c, -m) for r, (m, c) in enumerate(s[:5])]
    assert sorted(got) == want
