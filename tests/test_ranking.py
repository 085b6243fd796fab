import pytest
from pyspark.sql import functions as F

from faultline.operators import ranking as RK
from faultline.operators import scaling as SC


def test_standardize_population_std_and_constant_columns(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 2.0, 5.0), (2, 4.0, 5.0)], "row_id long, a double, c double")
    out, means, stds = SC.standardize(df, ["a", "c"], keep=["row_id"])
    assert stds["a"] == pytest.approx(1.247219128924647)  # population, not sample (1.5275)
    assert stds["c"] == 1.0
    vals = {r.row_id: (r.a, r.c) for r in out.collect()}
    assert vals[0][1] == 0.0 and vals[2][0] == pytest.approx((4 - 7 / 3) / 1.247219128924647)


def test_preprocess_outliers_inclusive_after_scaling(spark):
    rows = [(i, 0.0, 0) for i in range(9)] + [(9, 10.0, 1)]
    df = spark.createDataFrame(rows, "row_id long, x double, Bug int")
    prep = SC.preprocess(df, "Bug", remove_outliers=True, z=3.0)
    assert prep.df.count() == 10  # z of the extreme row is exactly 3.0 -> kept
    prep = SC.preprocess(df, "Bug", remove_outliers=True, z=2.99)
    assert prep.df.count() == 9


def test_relevance_is_std_of_centers_and_ranks_ties_by_position(spark):
    rows = [(0, 0, 0.0, 1.0, 5.0), (1, 0, 2.0, 1.0, 5.0), (2, 1, 4.0, 3.0, 5.0), (3, -1, 100.0, 100.0, 100.0)]
    df = spark.createDataFrame(rows, "row_id long, cluster int, a double, b double, c double")
    r = RK.feature_relevance(df, ["a", "b", "c"]).collect()
    assert [(x.rank, x.feature) for x in r] == [(1, "a"), (2, "b"), (3, "c")]
    assert r[0].relevance == pytest.approx(1.5) and r[1].relevance == pytest.approx(1.0) and r[2].relevance == 0.0


def test_relevance_needs_two_centers(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 2.0), (1, 0, 3.0, 4.0)], "row_id long, cluster int, a double, b double")
    r = RK.feature_relevance(df, ["a", "b"]).collect()
    assert [(x.feature, x.relevance) for x in r] == [("a", 0.0), ("b", 0.0)]


def ranking(spark, names):
    return spark.createDataFrame([(i + 1, n, float(len(names) - i), i) for i, n in enumerate(names)],
                                 "rank int, feature string, relevance double, feature_idx int")


def test_feature_ranks_last_duplicate_wins_and_groups_collapse(spark):
    rk = ranking(spark, ["PMD_a", "SM_b", "PMD_a", "HASSAN_c"])
    groups = spark.createDataFrame([("g", "PMD_a"), ("g", "PMD_a"), ("g", "missing"), ("h", "none")],
                                   "group string, feature string")
    got = sorted((r.group, r.feature, r.rank) for r in RK.feature_ranks(rk, groups).collect())
    assert got == [("g", "PMD_a", 3), ("g", "missing", None), ("h", "none", None)]


def test_rank_stats_upper_median_and_none_found(spark):
    ranks = spark.createDataFrame(
        [("g", "a", 10), ("g", "b", 60), ("g", "c", 700), ("g", "d", 2000), ("g", "e", None), ("h", "x", None)],
        "group string, feature string, rank int")
    s = {r.group: r for r in RK.rank_stats(ranks).collect()}
    g = s["g"]
    assert (g.total, g.found, g.not_found, g.min_rank, g.max_rank) == (5, 4, 1, 10, 2000)
    assert g.median_rank == 700  # sorted[4 // 2]
    assert (g.in_top_50, g.in_top_100, g.in_top_500, g.in_top_1000) == (1, 2, 2, 3)
    assert g.in_top_100_pct == pytest.approx(40.0) and g.found_pct == pytest.approx(80.0)
    h = s["h"]
    assert h.min_rank is None and h.median_rank is None and h.in_top_50 == 0 and h.in_top_50_pct == 0.0


def test_category_breakdown_and_top_found(spark):
    ranks = spark.createDataFrame([("g", "PMD_a", 5), ("g", "PMD_b", 150), ("g", "COV_x", 2), ("g", "SM_q", None)],
                                  "group string, feature string, rank int")
    b = {r.category: r for r in RK.category_breakdown(ranks).collect()}
    assert b["PMD"]["count"] == 2 and b["PMD"].in_top_100 == 1 and b["OTHER"].min_rank == 2
    t = [r.feature for r in RK.top_found(ranks, 2).orderBy("pos").collect()]
    assert t == ["COV_x", "PMD_a"]


def test_top_family_and_overlap(spark):
    rk = ranking(spark, ["SM_a", "PMD_b", "SM_c", "SM_d"])
    assert [r.feature for r in RK.top_family(rk, "SM_", 2).orderBy("family_rank").collect()] == ["SM_a", "SM_c"]
    other = ranking(spark, ["SM_c", "SM_a", "PMD_b", "SM_d"])
    ov = sorted((r.top_n, r.feature) for r in RK.ranking_overlap(rk, other, [2, 3]).collect())
    assert ov == [(2, "SM_a"), (3, "PMD_b"), (3, "SM_a"), (3, "SM_c")]


def test_category_rollup(spark):
    rk = ranking(spark, ["SM_a", "COV_b", "SM_c"])
    r = {x.category: x for x in RK.category_rollup(rk).collect()}
    assert r["SM"].n == 2 and r["SM"].top_feature == "SM_a" and r["COV"].max_rank == 2


def test_kmeans_batched_separates_blobs(spark):
    import numpy as np
    from faultline.operators.centroid import kmeans_batched
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(c, 0.1, size=(40, 2)) for c in ([0, 0], [5, 5], [0, 5])])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "row_id long, x double, y double")
    info, labels, centers = kmeans_batched(df, ["x", "y"], k=3, seed=42, n_init=4)
    lab = {r.row_id: r.cluster for r in labels.collect()}
    groups = [{lab[i] for i in range(g * 40, g * 40 + 40)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert info["inertia"] < 120 * 0.05
    assert centers.count() == 6


def test_ranking_overlap_aggregates_lineitem_once(spark, monkeypatch):
    from faultline.plans import queries as Q
    calls, part_year = [], Q.td.part_year
    monkeypatch.setattr(Q.td, "part_year", lambda *a, **k: calls.append(1) or part_year(*a, **k))
    assert Q.REGISTRY["ranking_overlap"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
