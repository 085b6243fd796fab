"""Vector moments against Spark's own aggregates and numpy."""

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import moments as M
from faultline.operators.ranking import cluster_centers
from faultline.operators.scaling import feature_stats


def close(a, b):
    return (a is None) == (b is None) and (a is None or bool(np.isclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)))


def test_against_spark_aggregates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 4)) if i % 11 else None, float(1e8 + rng.normal()) if i % 3 else None, int(rng.integers(0, 9)),
             None, 7.0, float("nan") if i == 5 else 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, `a.b` double, b int, empty double, same double, `not` double").repartition(7)
    feats = df.columns[1:]
    for by in (None, "g"):
        for held in (M.HELD_CELLS, 1):
            monkeypatch.setattr(M, "HELD_CELLS", held)
            got = {(r["group"] if by else None, r["feature"]): r for r in M.moments(df, feats, by).collect()}
            grouped = df.groupBy(by) if by else df.groupBy()
            aggs = [f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(feats)
                    for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]
            want = grouped.agg(*aggs).collect()
            assert len(got) == len(want) * len(feats)
            for r in want:
                for i, c in enumerate(feats):
                    mine = got[r[by] if by else None, c]
                    assert mine["feature_idx"] == i and mine["n"] == r[f"n{i}"], (r, c)
                    assert close(mine["mean"], r[f"m{i}"]) and close(mine["std"], r[f"s{i}"]), (r, c)


def test_large_means_and_merges():
    rng = np.random.default_rng(8)
    x = 1e9 + rng.normal(size=(500, 3))
    cut = [x[:1], x[1:200], x[200:]]
    parts = [tuple(v[0] for v in M.batch_moments(p, np.ones(p.shape, bool), np.zeros(len(p), np.int64), 1)) for p in cut]
    n, mean, m2 = M.merge_moments(M.merge_moments(parts[0], parts[1]), parts[2])
    assert (n == 500).all() and np.allclose(mean, x.mean(axis=0), rtol=1e-14)
    assert np.allclose(m2 / 500, x.var(axis=0), rtol=1e-6)


def test_wide_table_makes_no_row_for_a_cell(spark):
    width = 1500
    df = spark.range(40).select("id", *[(F.col("id") * i).cast("double").alias(f"f{i}") for i in range(width)], (F.col("id") % 2).alias("cluster"))
    feats = [f"f{i}" for i in range(width)]
    got = {r["feature"]: r for r in feature_stats(df, feats).collect()}
    assert len(got) == width and all(abs(got[f"f{i}"]["mean"] - 19.5 * i) < 1e-6 for i in range(width))
    for frame in (feature_stats(df, feats[:5]), cluster_centers(df, feats[:5], id_col="id")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan


def test_empty_table(spark):
    df = spark.createDataFrame([], "g int, a double")
    assert M.moments(df, ["a"]).count() == 0 and M.moments(df, ["a"], "g").count() == 0
