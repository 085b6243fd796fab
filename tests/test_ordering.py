import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators.ordering import row_index, running_sum
from faultline.session import ensure_checkpoint_dir, materialize


def test_running_sum_matches_cumsum_per_key(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(o), int(v)) for k, o, v in zip(rng.integers(0, 3, 400), rng.permutation(400), rng.integers(0, 9, 400))]
    df = spark.createDataFrame(rows, "k int, o double, v int")
    got = {(r.k, r.o): r.run for r in running_sum(df, ["k"], ["o"], "v", "run", partitions=7).collect()}
    for k in range(3):
        sel = sorted((o, v) for kk, o, v in rows if kk == k)
        acc = 0
        for o, v in sel:
            assert got[(k, o)] == acc
            acc += v


def test_row_index_is_a_permutation_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    idx = row_index(df, ["x"], "i", partitions=5).collect()
    assert sorted(r.i for r in idx) == list(range(1000))
    assert all(r.i == r.x for r in idx)


@pytest.mark.parametrize("partitions", [8, 200])
def test_positions_of_large_inputs(spark, partitions):
    """Large enough that range bounds are sampled."""
    n = 300_000
    df = spark.range(n).select(((F.col("id") * 7919 + 13) % n).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    wrong = row_index(df, ["x"], "i", partitions=partitions).filter("i != x").count()
    assert wrong == 0


@pytest.mark.parametrize("partitions", [8, 200])
def test_auc_of_nearly_unique_scores(spark, partitions):
    from faultline.operators.classify import roc_auc
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300_000)
    score = rng.normal(size=len(y)) + 0.6 * y
    df = spark.createDataFrame(pd.DataFrame({"fold": 0, "y": y, "score": score}))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = roc_auc(df).first()["roc_auc"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rank = np.empty(len(y))
    rank[np.argsort(score)] = np.arange(1, len(y) + 1)
    pos = y.sum()
    assert abs(got - (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))) < 1e-9


def test_materialize_cuts_lineage_and_keeps_values(spark):
    ensure_checkpoint_dir(spark)
    df = spark.range(50).withColumn("sq", F.col("id") * F.col("id"))
    m = materialize(df)
    assert "faultline-" in m.inputFiles()[0]
    assert sorted((r.id, r.sq) for r in m.collect()) == [(i, i * i) for i in range(50)]


def test_cleanup_removes_what_was_written(spark):
    from faultline.session import cleanup
    folder = materialize(spark.range(5)).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    assert cleanup(spark) >= 1
    assert not os.path.exists(folder)
