"""Pipelines (X7-X10) and report tables on small generated tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.plans import experiments as EX


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    centers = [(0.0, 0.0, 0.0), (4.0, 4.0, 0.0), (0.0, 4.0, 4.0)]
    rows = []
    i = 0
    for ci, c in enumerate(centers):
        for _ in range(60):
            x = rng.normal(c, 0.3)
            bug = int(rng.random() < (0.5 if ci == 2 else 0.05))
            rows.append((i, "v1", float(x[0]), float(x[1]), float(x[2]), bug))
            i += 1
    return spark.createDataFrame(rows, "row_id long, version string, SM_a double, SM_b double, PMD_c double, Bug int")


def test_cluster_experiment_dbscan(blobs):
    res = EX.cluster_experiment(blobs, "Bug", "blobs", "dbscan")
    assert res.params["auto_eps"] and res.params["min_samples"] == 5
    stats = res.stats.collect()
    assert sum(r.total for r in stats) == 180
    info = res.info.first()
    assert info.n_clusters == 3
    high = [r.cluster_name for r in stats if r.risk == "HIGH" and r.cluster >= 0]
    assert len(high) == 1
    summary = EX.metrics_summary(res)
    assert summary.filter(F.col("value").isNull()).count() == 0
    assert summary.filter(F.col("metric") == "silhouette_score").first().value > 0.8
    assert res.ranking.count() == 3


def test_cluster_experiment_kmeans(blobs):
    res = EX.cluster_experiment(blobs, "Bug", "blobs", "kmeans", n_clusters=3)
    assert res.params == {"n_clusters": 3}
    assert res.labels.select("cluster").distinct().count() == 3
    r = res.ranking.collect()
    assert [x.rank for x in r] == [1, 2, 3] and all(x.relevance > 0.5 for x in r)


def test_classify_and_compare(blobs):
    a = EX.classify_experiment(blobs, "Bug", "a", "lr")
    b = EX.classify_experiment(blobs.withColumn("SM_a", F.lit(0.0)), "Bug", "b", "lr")
    s = {r.metric: r for r in a.summary.collect()}
    assert set(s) == {"precision", "recall", "f1", "roc_auc", "avg_precision"}
    assert len(s["recall"]["values"]) == 5 and s["roc_auc"].mean > 0.7
    mat, top = EX.compare_all([a, b], top_n=2)
    best = mat.filter("is_best").groupBy("metric").count().collect()
    assert len(best) == 5 and all(r["count"] == 1 for r in best)
    assert top.count() == 4


def test_group_comparison_and_side_by_side(spark):
    ranking = spark.createDataFrame([(1, "PMD_a", 3.0, 0), (2, "SM_b", 2.0, 1)],
                                    "rank long, feature string, relevance double, feature_idx int")
    groups = spark.createDataFrame([("g", "PMD_a"), ("g", "x")], "group string, feature string")
    out = EX.group_comparison(ranking, groups)
    assert out["stats"].first().found == 1 and out["top"].count() == 1
    a = spark.createDataFrame([("silhouette", 0.5), ("davies_bouldin", 0.4)], "metric string, value double")
    b = spark.createDataFrame([("silhouette", 0.6), ("davies_bouldin", 0.3)], "metric string, value double")
    w = {r.metric: r.winner for r in EX.side_by_side(a, b, "a", "b").collect()}
    assert w == {"silhouette": "b", "davies_bouldin": "b"}


def test_k_distance_curve_flags_eps(spark):
    rows = [(i, [float(i)]) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    curve = EX.k_distance_curve(df, eps=4.0, k=5).orderBy("idx").collect()
    assert [r.idx for r in curve] == list(range(10))
    assert [r.k_distance for r in curve] == sorted(r.k_distance for r in curve)
    assert any(r.is_eps for r in curve)


def test_group_report_long_table(spark):
    ranking = spark.createDataFrame([(1, "PMD_a", 3.0, 0), (2, "SM_b", 2.0, 1)],
                                    "rank long, feature string, relevance double, feature_idx int")
    groups = spark.createDataFrame([("g", "PMD_a"), ("g", "SM_b"), ("g", "x")], "group string, feature string")
    rep = EX.group_report(EX.group_comparison(ranking, groups))
    rows = {(r.section, r.stat): r.value for r in rep.collect()}
    assert rows[("stats", "found")] == 2.0 and rows[("stats", "median_rank")] == 2.0
    assert rows[("category", "PMD:min_rank")] == 1.0
    assert rows[("top", "1. PMD_a [PMD]")] == 1.0


def test_cluster_document(blobs, tmp_dir):
    import json
    import os

    from faultline.sources import sinks
    from faultline.sources.files import read_results_json
    res = EX.cluster_experiment(blobs, "Bug", "blobs", "dbscan")
    doc = EX.cluster_document(res)
    r = doc.first()
    assert r.dataset == "blobs" and r.algorithm_params.auto_eps and r.algorithm_params.n_clusters == 3
    assert r.n_samples == 180 and r.n_features == 3 and len(r.feature_relevance) == 3
    assert set(r.cluster_stats) >= {"cluster_0", "cluster_1", "cluster_2"}
    assert r.prediction_metrics.total_clusters == 3
    out = os.path.join(tmp_dir, "doc")
    sinks.write_json(doc, out)
    part = [f for f in os.listdir(out) if f.endswith(".json")][0]
    text = open(os.path.join(out, part)).read()
    assert json.loads(text)["dataset"] == "blobs"
    meta, ranks = read_results_json(doc.sparkSession, os.path.join(out, part))
    assert ranks.count() == 3 and meta.first().n_features == 3


def test_top_per_dataset(spark):
    imp = spark.createDataFrame([("a", 1, "f1", 0.5), ("a", 2, "f2", 0.3), ("b", 1, "f3", 0.9)],
                                "dataset string, rank int, feature string, importance double")
    got = sorted((r.dataset, r.feature) for r in EX.top_per_dataset(imp, 1).collect())
    assert got == [("a", "f1"), ("b", "f3")]


def test_cluster_experiment_takes_string_ids(spark):
    """X7 on a table keyed by strings: the same clusters as with row numbers."""
    import numpy as np
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(3, 0.1, (40, 2))])
    rows = [(f"v{i:03d}", i, float(a), float(b), int(a > 1.5 and i % 2 == 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "version_id string, row_id long, SM_a double, SM_b double, Bug int")
    for algorithm in ("dbscan", "kmeans"):
        by_name = EX.cluster_experiment(df.drop("row_id"), "Bug", algorithm=algorithm, id_col="version_id")
        by_row = EX.cluster_experiment(df.drop("version_id"), "Bug", algorithm=algorithm, id_col="row_id")
        names = {r["version_id"]: r["cluster"] for r in by_name.labels.collect()}
        numbers = {f"v{r['row_id']:03d}": r["cluster"] for r in by_row.labels.collect()}
        assert names == numbers and len(set(names.values()) - {-1}) == 2
        assert by_name.external.collect() == by_row.external.collect()
