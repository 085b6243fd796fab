"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query builds its input from the test tables (``sources.testdata``) and
runs a library operator over the whole input. Floats are rounded at the end
(4-6 dp) so the DuckDB oracle (``plans.oracle``) can compare value hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import quality
from faultline.session import materialize
from faultline.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c):
    """Round to 6 dp; ``+ 0.0`` turns a -0.0 into 0.0 (the oracle does the same)."""
    return F.round(c, 6) + F.lit(0.0)


# --- fixture views -----------------------------------------------------------

def unit_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, cluster, y): brand number as the cluster, brands 24-25 as noise."""
    u = td.unit(spark, sf)
    brand_no = F.split(F.col("grp"), "#").getItem(1).cast("int")
    return u.select(
        "row_id",
        F.when(brand_no >= 24, F.lit(-1)).otherwise(brand_no - 1).alias("cluster"),
        (F.col("Bug") > 0).cast("int").alias("y"),
    )


# --- group risk (minimum slice) ---------------------------------------------

@register("cluster_stats")
def q_cluster_stats(spark, sf):
    return quality.cluster_stats(unit_clusters(spark, sf))


@register("risk_metrics")
def q_risk_metrics(spark, sf):
    return quality.risk_metrics(unit_clusters(spark, sf))


@register("external_metrics")
def q_external_metrics(spark, sf):
    m = quality.external_metrics(unit_clusters(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@register("high_rate_groups")
def q_high_rate_groups(spark, sf):
    """Groups whose defect rate is above a fixed cut (10 %)."""
    s = quality.cluster_stats(unit_clusters(spark, sf))
    return s.filter(F.col("defect_rate") > 10).select("cluster_name", "total", "defective", "defect_rate")


# --- sources, projections, filters, prepare ---------------------------------

from faultline.functions import columns as C  # noqa: E402
from faultline.operators import prepare as P  # noqa: E402
from faultline.operators import ranking as RK  # noqa: E402
from faultline.operators import scaling as SC  # noqa: E402
from faultline.plans import prepare as X  # noqa: E402
from faultline.sources.registry import testdata_registry  # noqa: E402


def year_cluster(version_id: str = "version_id"):
    """Cluster id = ship-year index parsed from the version id (never NULL)."""
    return F.substring(F.col(version_id), 1, 4).cast("int") - int(td.FIRST_VERSION)


def sm_ranking(spark, sf, sm_df=None):
    """A4 ranking of the ``sm`` SM_* features, clusters = ship year."""
    s = sm_df if sm_df is not None else td.sm(spark, sf)
    prep = SC.preprocess(s, "Bug", id_col="version_id")
    df = prep.df.withColumn("cluster", year_cluster())
    return RK.feature_relevance(df, prep.features, "cluster", id_col="version_id")


def combined_df(spark, sf, top_n: int = 30):
    # one lineitem aggregate feeds all three inputs and the SM ranking;
    # materialised once (it is parts x years rows, far smaller than lineitem)
    # so the projections and the later passes read it instead of re-aggregating
    py = td.part_year(spark, sf).transform(materialize)
    sm_df = td.sm(spark, sf, py)
    top = [r["feature"] for r in RK.top_family(sm_ranking(spark, sf, sm_df), "SM_", top_n).collect()]  # <= top_n
    return X.combined(sm_df, td.coverage(spark, sf, py), td.effort(spark, sf, py), top, td.SM_METADATA)


@register("load_clean")
def q_load_clean(spark, sf):
    df, label, _ = testdata_registry().load(spark, "sm", sf)
    return P.drop_missing(df, ["version"])


@register("family_project")
def q_family_project(spark, sf):
    # "ID" is not a column of the table: tolerated (non-strict), like the extract action
    return C.project_family(combined_df(spark, sf), td.SM_METADATA + ["ID"], "COV_", strict=False)


@register("effort_cov_only")
def q_effort_cov_only(spark, sf):
    return X.effort_cov_only(combined_df(spark, sf), td.SM_METADATA)


@register("label_rate")
def q_label_rate(spark, sf):
    u = td.unit(spark, sf)
    y = C.binarize("Bug")
    return u.agg(F.count(F.lit(1)).alias("n_samples"), F.sum(y).cast("bigint").alias("n_defective"),
                 r6(F.avg(y)).alias("defect_rate"))


@register("impute_nonfinite")
def q_impute_nonfinite(spark, sf):
    s = td.sm(spark, sf)
    # single-line groups report an infinite price, two-line groups a -inf discount
    price = F.when(F.col("SM_lines") == 1, F.lit(float("inf"))).otherwise(F.col("SM_price_avg"))
    disc = F.when(F.col("SM_lines") == 2, F.lit(float("-inf"))).otherwise(F.col("SM_disc_avg"))
    return s.select("version_id", C.impute(F.col("SM_tax_avg")).alias("tax"),
                    C.impute(price).alias("price"), C.impute(disc).alias("disc"))


@register("version_exclude")
def q_version_exclude(spark, sf):
    s = td.sm(spark, sf).select("version_id", "version", "Bug")
    return P.exclude_value(s, "version", td.FIRST_VERSION)


def merged_df(spark, sf):
    py = td.part_year(spark, sf, ("sm", "coverage")).transform(materialize)  # one lineitem aggregate, both inputs
    return X.merge_coverage(td.sm(spark, sf, py), td.coverage(spark, sf, py), first_version=td.FIRST_VERSION)


@register("merge_left")
def q_merge_left(spark, sf):
    return merged_df(spark, sf)


@register("merge_unmatched")
def q_merge_unmatched(spark, sf):
    return P.unmatched_count(merged_df(spark, sf), C.COVERAGE_FEATURES[0])


@register("combine_inner")
def q_combine_inner(spark, sf):
    return combined_df(spark, sf)


@register("union_versions")
def q_union_versions(spark, sf):
    cov = td.coverage(spark, sf)
    # older versions were collected without the METHOD counter
    old = cov.filter(F.col("version") < "1998").drop("COV_METHOD")
    new = cov.filter(F.col("version") >= "1998")
    return P.union_by_name([old, new])


@register("top_family_features")
def q_top_family_features(spark, sf):
    t = RK.top_family(sm_ranking(spark, sf), "SM_", 3)
    return t.select("family_rank", "feature", r6(F.col("relevance")).alias("relevance"), "rank")


@register("top30_dataset")
def q_top30_dataset(spark, sf):
    top = [r["feature"] for r in RK.top_family(sm_ranking(spark, sf), "SM_", 30).collect()]
    return X.top_n_dataset(td.sm(spark, sf), top, td.SM_METADATA, drop_version=td.FIRST_VERSION)


@register("family_counts")
def q_family_counts(spark, sf):
    comb = combined_df(spark, sf)
    feats = C.feature_columns(comb, "Bug")
    columns = P.family_counts(P.schema_table(comb.select(*[F.col(f"`{c}`") for c in feats])))
    values = SC.long_form(comb, "version_id", feats).groupBy(C.family_of(F.col("feature")).alias("family")) \
        .agg(F.count("value").alias("n_values"))
    return columns.join(values, "family").select("family", "n_features", "n_values")


# --- scaling -----------------------------------------------------------------

def unit_prepared(spark, sf, remove_outliers=False):
    return SC.preprocess(td.unit(spark, sf), "Bug", id_col="row_id", remove_outliers=remove_outliers)


def _rounded(prep: SC.Prepared):
    return prep.df.select("row_id", "label", *[r6(C.col(f)).alias(f) for f in prep.features])


@register("standardize")
def q_standardize(spark, sf):
    return _rounded(unit_prepared(spark, sf))


@register("zscore_outliers")
def q_zscore_outliers(spark, sf):
    return _rounded(unit_prepared(spark, sf, remove_outliers=True))


# --- centers, relevance, rankings, group comparison ------------------------

def unit_scaled_clusters(spark, sf):
    prep = unit_prepared(spark, sf)
    cl = unit_clusters(spark, sf).select("row_id", "cluster")
    return prep, prep.df.join(cl, "row_id")


@register("cluster_centers")
def q_cluster_centers(spark, sf):
    prep, df = unit_scaled_clusters(spark, sf)
    c = RK.cluster_centers(df, prep.features, "cluster")
    return c.select("cluster", "feature", r6(F.col("center")).alias("center"))


@register("feature_relevance")
def q_feature_relevance(spark, sf):
    prep, df = unit_scaled_clusters(spark, sf)
    r = RK.feature_relevance(df, prep.features, "cluster")
    return r.select("rank", "feature", r6(F.col("relevance")).alias("relevance"))


def combined_ranking(spark, sf, by: str = "year", comb=None):
    comb = combined_df(spark, sf) if comb is None else comb
    prep = SC.preprocess(comb, "Bug", id_col="version_id")
    cl = year_cluster() if by == "year" else F.col("label")
    df = prep.df.withColumn("cluster", cl)
    return RK.feature_relevance(df, prep.features, "cluster", id_col="version_id")


def effort_groups(spark, sf):
    """Feature groups: the 26 common effort names (fixed list) and every
    column of the effort table except its key (S10 column listing)."""
    common = spark.createDataFrame([("26_common", f) for f in C.EFFORT_FEATURES_26], "group string, feature string")
    listed = P.schema_table(td.effort(spark, sf), exclude=["version_id"])  # S10, minus Unnamed* columns
    return common.unionByName(listed.select(F.lit("effort_all").alias("group"), "feature"))


def group_ranks(spark, sf):
    return RK.feature_ranks(combined_ranking(spark, sf), effort_groups(spark, sf))


@register("feature_ranks")
def q_feature_ranks(spark, sf):
    return group_ranks(spark, sf)


@register("rank_stats")
def q_rank_stats(spark, sf):
    s = RK.rank_stats(group_ranks(spark, sf))
    return s.select(*[r6(F.col(c)).alias(c) if c.endswith(("pct", "avg_rank")) else F.col(c) for c in s.columns])


@register("category_breakdown")
def q_category_breakdown(spark, sf):
    b = RK.category_breakdown(group_ranks(spark, sf))
    return b.select("group", "category", "count", r6(F.col("avg_rank")).alias("avg_rank"), "min_rank", "in_top_100")


@register("top20_by_group")
def q_top20_by_group(spark, sf):
    return RK.top_found(group_ranks(spark, sf), 20)


@register("ranking_overlap")
def q_ranking_overlap(spark, sf):
    comb = combined_df(spark, sf).transform(materialize)  # one combined table, ranked by both groupings
    return RK.ranking_overlap(combined_ranking(spark, sf, "year", comb), combined_ranking(spark, sf, "label", comb), [5, 10])


@register("category_rollup")
def q_category_rollup(spark, sf):
    r = RK.category_rollup(combined_ranking(spark, sf))
    return r.select("category", "n", "min_rank", "max_rank", r6(F.col("avg_relevance")).alias("avg_relevance"),
                    "top_feature")


@register("category_shares")
def q_category_shares(spark, sf):
    return RK.category_shares(combined_ranking(spark, sf), 10)


# --- classification: folds, weights, metrics --------------------------------

from faultline.operators import classify as CL  # noqa: E402


def scored_folds(spark, sf):
    return CL.stratified_folds(td.scores(spark, sf), "y", "row_id", k=5, seed=42)


@register("stratified_folds")
def q_stratified_folds(spark, sf):
    return scored_folds(spark, sf).select("row_id", "y", "fold")


@register("class_weights")
def q_class_weights(spark, sf):
    w = CL.class_weights(scored_folds(spark, sf), "y")
    return w.select("fold", "y", r6(F.col("weight")).alias("weight"))


def _r6_all(df, keep=("fold",)):
    return df.select(*[F.col(c) if c in keep else r6(F.col(c)).alias(c) for c in df.columns])


@register("fold_metrics")
def q_fold_metrics(spark, sf):
    return _r6_all(CL.fold_metrics(scored_folds(spark, sf)).drop("avg_precision"))


@register("hard_ap")
def q_hard_ap(spark, sf):
    return _r6_all(CL.fold_metrics(scored_folds(spark, sf)).select("fold", "avg_precision"))


@register("roc_auc")
def q_roc_auc(spark, sf):
    return _r6_all(CL.roc_auc(scored_folds(spark, sf)))


@register("roc_auc_unique")
def q_roc_auc_unique(spark, sf):
    """A12 on nearly unique scores: running sums over as many rows as orders."""
    o = td.table(spark, sf, "orders")
    scored = o.select(F.pmod("o_custkey", F.lit(5)).cast("int").alias("fold"), F.col("o_totalprice").alias("score"),
                      (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return _r6_all(CL.roc_auc(scored))


def _summary_for(folded):
    per = CL.fold_metrics(folded).join(CL.roc_auc(folded), "fold")
    return CL.cv_summary(CL.long_metrics(per, list(CL.METRICS)))


@register("cv_summary")
def q_cv_summary(spark, sf):
    s = _summary_for(scored_folds(spark, sf))
    return s.select("metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"),
                    F.transform("values", lambda v: F.round(v, 6) + F.lit(0.0)).alias("values"))


# three "models": hard predictions at three score cuts
CUTS = (("cut_030", 0.3), ("cut_050", 0.5), ("cut_070", 0.7))


@register("best_by_metric")
def q_best_by_metric(spark, sf):
    base = scored_folds(spark, sf).transform(materialize)  # folds computed once for the three variants
    parts = []
    for i, (name, cut) in enumerate(CUTS):
        f = base.withColumn("pred", (F.col("score") > cut).cast("int"))
        parts.append(_summary_for(f).select(F.lit(name).alias("dataset"), F.lit(i).alias("dataset_idx"),
                                            "metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std")))
    allp = P.union_by_name(parts)
    return CL.best_by_metric(allp).drop("dataset_idx")


# --- distances: k-distance, eps knee, epsilon neighbours, DBSCAN, silhouette, DB --

from faultline.operators import dbscan as DB  # noqa: E402
from faultline.operators import pairwise as PW  # noqa: E402

FIXED_EPS = 0.12
MIN_SAMPLES = 5


def part_points(spark, sf):
    """(row_id, features[2]) from ``part2``."""
    return td.part2(spark, sf).select("row_id", F.array("x0", "x1").alias("features"))


def part_points_clustered(spark, sf):
    """part points with the brand cluster (brands 24-25 as noise)."""
    p = td.table(spark, sf, "part").select("p_partkey", "p_brand")
    brand_no = F.split(F.col("p_brand"), "#").getItem(1).cast("int")
    cl = p.select(F.col("p_partkey").alias("row_id"),
                  F.when(brand_no >= 24, F.lit(-1)).otherwise(brand_no - 1).alias("cluster"))
    return part_points(spark, sf).join(cl, "row_id")


@register("k_distance")
def q_k_distance(spark, sf):
    k = PW.kth_neighbour(part_points(spark, sf), MIN_SAMPLES)
    return k.select("row_id", r6(F.col("k_distance")).alias("k_distance"))


@register("eps_knee")
def q_eps_knee(spark, sf):
    e = PW.find_eps(part_points(spark, sf), MIN_SAMPLES)
    return e.select(r6(F.col("eps")).alias("eps"), r6(F.col("eps_raw")).alias("eps_raw"), "n_points")


@register("eps_neighbours")
def q_eps_neighbours(spark, sf):
    return PW.neighbour_counts(part_points(spark, sf), FIXED_EPS)


def part_dbscan(spark, sf):
    return DB.dbscan(part_points(spark, sf), FIXED_EPS, MIN_SAMPLES)


@register("dbscan")
def q_dbscan(spark, sf):
    return part_dbscan(spark, sf).select("row_id", "cluster")


@register("dbscan_info")
def q_dbscan_info(spark, sf):
    i = quality.cluster_info(part_dbscan(spark, sf))
    return i.select("n_clusters", "n_noise", r6(F.col("noise_ratio")).alias("noise_ratio"))


@register("silhouette")
def q_silhouette(spark, sf):
    s = PW.silhouette(part_points_clustered(spark, sf))
    return s.select(r6(F.col("silhouette")).alias("silhouette"))


@register("davies_bouldin")
def q_davies_bouldin(spark, sf):
    d = PW.davies_bouldin(part_points_clustered(spark, sf))
    return d.select(r6(F.col("davies_bouldin")).alias("davies_bouldin"))


# --- models (rows-only checks for those with random draws) -----------------------

from faultline.operators import centroid as CT  # noqa: E402
from faultline.operators import components as CM  # noqa: E402


@register("kmeans")
def q_kmeans(spark, sf):
    prep = unit_prepared(spark, sf)
    _, labels, _ = CT.kmeans_batched(prep.df, prep.features, k=2, seed=42, n_init=10, max_iter=300)
    return labels


@register("pca2d")
def q_pca2d(spark, sf):
    prep = unit_prepared(spark, sf)
    df = prep.df.join(unit_clusters(spark, sf).select("row_id", "cluster"), "row_id")
    out, ratios = CT.pca2d(df, prep.features, extra=["cluster", "label"])
    return out.withColumn("var_ratio_1", F.lit(ratios[0])).withColumn("var_ratio_2", F.lit(ratios[1]))


def _cv(spark, sf, kind):
    prep = unit_prepared(spark, sf)
    preds = CL.cross_validate(prep.df.withColumnRenamed("label", "y"), prep.features, kind, "y", "row_id", 5, 42)
    return _r6_all(CL.cv_metrics(preds))


@register("logreg_cv")
def q_logreg_cv(spark, sf):
    return _cv(spark, sf, "lr")


@register("logreg_coefficients")
def q_logreg_coefficients(spark, sf):
    """M7: coefficients of the five models of the cross-validation and of the refit (fold -1)."""
    data = unit_prepared(spark, sf).df.withColumnRenamed("label", "y").transform(materialize)
    folded = data.join(CL.stratified_folds(data.select("row_id", "y"), "y", "row_id", 5, 42).select("row_id", "fold"), "row_id")
    found = CL.coefficients(folded, td.UNIT_FEATURES, (-1, 0, 1, 2, 3, 4), fold="fold")  # models x features
    return spark.createDataFrame(found, "fold int, feature_idx int, feature string, coefficient double") \
        .select("fold", "feature", r6(F.col("coefficient")).alias("coefficient"))


@register("logreg_importances")
def q_logreg_importances(spark, sf):
    """M10 for the logistic regression: features by absolute coefficient."""
    prep = unit_prepared(spark, sf)
    return CL.importances(prep.df.withColumnRenamed("label", "y"), prep.features, "lr", "y", 42)


@register("forest_cv")
def q_forest_cv(spark, sf):
    return _cv(spark, sf, "rf")


@register("importances")
def q_importances(spark, sf):
    prep = unit_prepared(spark, sf)
    return CL.importances(prep.df.withColumnRenamed("label", "y"), prep.features, "rf", "y", 42)


# --- pipelines and report tables ---------------------------------------------

from faultline.plans import experiments as EX  # noqa: E402


@register("cluster_experiment")
def q_cluster_experiment(spark, sf):
    """X7 + R1: DBSCAN with automatic eps on ``unit``, full metrics summary."""
    res = EX.cluster_experiment(td.unit(spark, sf), "Bug", dataset="unit", algorithm="dbscan")
    return EX.metrics_summary(res)


@register("kdist_curve")
def q_kdist_curve(spark, sf):
    """Sorted k-distance curve of all part points, knee eps flagged."""
    pts = part_points(spark, sf)
    kd = PW.kth_neighbour(pts, MIN_SAMPLES).transform(materialize)  # read by the knee and the curve
    c = EX.k_distance_curve(pts, float(PW.knee_eps(kd).first()["eps"]), MIN_SAMPLES, kdist=kd)
    return c.select("idx", r6(F.col("k_distance")).alias("k_distance"), "is_eps")


def part_labelled(spark, sf):
    y = td.unit(spark, sf).select("row_id", (F.col("Bug") > 0).cast("int").alias("y"))
    return part_points_clustered(spark, sf).join(y, "row_id")


def _metric_table(df):
    parts = [quality.external_metrics(df), quality.risk_metrics(df).drop(
        "high_risk_clusters", "total_clusters", "files_in_high_risk", "defects_captured", "total_defects"),
        PW.silhouette(df), PW.davies_bouldin(df)]
    out = None
    for d in parts:
        st = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                          for c in d.columns])).alias("m")).select("m.metric", "m.value")
        out = st if out is None else out.unionByName(st)
    return out


@register("experiment_compare")
def q_experiment_compare(spark, sf):
    """Brand groups vs DBSCAN clusters of the part points, side by side."""
    lab = part_labelled(spark, sf).transform(materialize)
    db = part_dbscan(spark, sf).select("row_id", F.col("cluster").alias("db_cluster"))
    # each grouping feeds four metrics: written once, read four times
    by_db = lab.join(db, "row_id").drop("cluster").withColumnRenamed("db_cluster", "cluster").transform(materialize)
    t = EX.side_by_side(_metric_table(lab), _metric_table(by_db), "brand", "dbscan")
    return t.select("metric", r6(F.col("brand")).alias("brand"), r6(F.col("dbscan")).alias("dbscan"),
                    r6(F.col("delta")).alias("delta"), "winner")


@register("high_risk_members")
def q_high_risk_members(spark, sf):
    return quality.high_risk_members(unit_clusters(spark, sf))


@register("ranking_head")
def q_ranking_head(spark, sf):
    """The first 5 rows of the combined-table ranking."""
    h = RK.head(combined_ranking(spark, sf), 5)
    return h.select("rank", "feature", r6(F.col("relevance")).alias("relevance"))


def emb_points(spark, sf):
    return td.emb(spark, sf).select("row_id", "features", F.col("label").alias("cluster"))


@register("silhouette_emb")
def q_silhouette_emb(spark, sf):
    """A8 on 64-d embedding vectors grouped by their label."""
    return PW.silhouette(emb_points(spark, sf)).select(r6(F.col("silhouette")).alias("silhouette"))


@register("davies_bouldin_emb")
def q_davies_bouldin_emb(spark, sf):
    return PW.davies_bouldin(emb_points(spark, sf)).select(r6(F.col("davies_bouldin")).alias("davies_bouldin"))


@register("model_comparison")
def q_model_comparison(spark, sf):
    """Logistic regression CV on two datasets, metric x dataset
    matrix with the best dataset marked."""
    unit_res = EX.classify_experiment(td.unit(spark, sf).drop("grp"), "Bug", "unit", "lr")
    sm_res = EX.classify_experiment(td.sm(spark, sf).drop("id"), "Bug", "sm", "lr", id_col="version_id")
    mat, _ = EX.compare_all([unit_res, sm_res])
    return mat.select("dataset", "metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "is_best")


# --- joins on null keys, sources read back from files -------------------------------

def _keyed_parts(spark, sf):
    """Parts by a key with missing values, and a row for each key that comes more than once."""
    part = td.table(spark, sf, "part")
    keyed = part.select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("file"),
                        F.when(F.col("p_size") % 9 != 0, (F.col("p_size") % 5).cast("int")).alias("version"))
    right = keyed.groupBy("file", "version").agg(F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("n"))
    return keyed, right.filter("n > 1")


@register("join_null_keys")
def q_join_null_keys(spark, sf):
    """J1-J3 with missing keys on both sides: they match, as in pandas."""
    keyed, right = _keyed_parts(spark, sf)
    return P.join_on(keyed.filter("p_partkey % 3 = 0"), right, ["file", "version"], how="left", null_keys=True)


@register("join_null_keys_all")
def q_join_null_keys_all(spark, sf):
    """J1-J3 as ``join_null_keys``, over every part row."""
    keyed, right = _keyed_parts(spark, sf)
    return P.join_on(keyed, right, ["file", "version"], how="left", null_keys=True)


@register("versioned_files")
def q_versioned_files(spark, sf):
    """S2 + S7 + P6 + U1 + S11: two versions written as CSV with swapped, missing
    and additional columns and NA tokens, read back by name."""
    from faultline.session import ensure_checkpoint_dir
    from faultline.sources import files as FS
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultline-csv-{uuid.uuid4().hex}"
    c = td.table(spark, sf, "customer")
    b = F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_nationkey").cast("string")).alias("COV_B")
    name, a = F.col("c_name").alias("filename"), F.col("c_custkey").alias("COV_A")
    old, new = c.filter("c_nationkey < 12"), c.filter("c_nationkey >= 12")
    old.select(name, a, b).write.option("header", True).csv(f"{root}/Coverage-P-1.1.0-filename")
    new.select(b, name, (F.col("c_custkey") % 7).alias("COV_C"), a).write.option("header", True).csv(f"{root}/Coverage-P-1.10.0-filename")
    df = FS.read_versioned(spark, f"{root}/Coverage-*-filename")
    return df.select("filename", "version", *[F.col(x).cast("bigint").alias(x) for x in ("COV_A", "COV_B", "COV_C")])


@register("extract_sheet")
def q_extract_sheet(spark, sf):
    """Sheets of a title, a note, display names and a header row over all units,
    written as text by brand, extracted from file to file by the named action."""
    from faultline.session import ensure_checkpoint_dir
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultline-sheet-{uuid.uuid4().hex}"
    unit = td.unit(spark, sf)
    metrics = ["SM_size", "SM_price", "SM_qty_avg", "SM_qty_std", "PMD_lines"]
    cells = [F.col("row_id"), F.concat("grp", F.lit(", all")).alias("grp"), "Bug", *metrics]
    lines = unit.select("grp", F.lit(9).alias("at"), F.to_csv(F.struct(*cells)).alias("value"))
    tops = ["Units,,,,,,,", '"sizes, prices",,,,,,,', "ID,Group,Bug," + ",".join(metrics), "row_id,grp,B,M1,M2,M3,M4,M5"]
    top = unit.select("grp").distinct().select("grp", F.posexplode(F.array(*[F.lit(t) for t in tops])).alias("at", "value"))
    # a file a brand: one task writes a brand, its first lines first
    lines.unionByName(top).withColumn("brand", F.translate("grp", "#", "")).repartition("brand").sortWithinPartitions("brand", "at") \
        .select("value", "brand").write.partitionBy("brand").text(f"{root}/sheets")
    return X.run_action("extract-sm", spark=spark, path=f"{root}/sheets/*/part-*", target=f"{root}/out", header_row=3, name_row=2,
                        n_keep=2, metadata=["row_id", "grp", "absent"]) \
        .select("row_id", "grp", *[F.col(c).cast("double").alias(c) for c in metrics[:4]])


@register("cell_values")
def q_cell_values(spark, sf):
    """S9 + F7: the cells of a sheet, without those that hold a phrase."""
    from faultline.sources import files as FS
    sheet = td.table(spark, sf, "nation").select("n_nationkey", "n_name")
    cells = FS.flatten_cells(sheet, exclude_substring="7")
    return cells.groupBy("col_idx", "value").agg(F.count(F.lit(1)).alias("n"))


@register("cell_values_customer")
def q_cell_values_customer(spark, sf):
    """S9 + F7 as ``cell_values``, over a sheet that grows with the input."""
    from faultline.sources import files as FS
    sheet = td.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    cells = FS.flatten_cells(sheet, exclude_substring="7")
    return cells.groupBy("col_idx", "value").agg(F.count(F.lit(1)).alias("n"))


@register("join_suffixes")
def q_join_suffixes(spark, sf):
    """Columns that both sides have come back twice, with suffixes."""
    orders = td.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount"),
                                                  F.col("o_orderkey").alias("id"))
    customers = td.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"),
                                                       F.col("c_nationkey").alias("id"))
    return P.join_on(orders, customers, ["key"], how="left")


@register("pca_centers")
def q_pca_centers(spark, sf):
    """M5 / R5 with two features: rows and cluster centers by one model, the sign left out."""
    pts = td.part2(spark, sf).select("row_id", "x0", "x1").join(
        part_points_clustered(spark, sf).select("row_id", "cluster"), "row_id").transform(materialize)
    centers = PW.center_vectors(pts.select(F.array("x0", "x1").alias("features"), "cluster"))
    rows, _, at = CT.pca2d(pts, ["x0", "x1"], extra=["cluster"], centers=centers)
    both = rows.select(F.lit("row").alias("kind"), F.col("row_id").cast("long").alias("id"), "pc1", "pc2").unionByName(
        at.select(F.lit("center").alias("kind"), F.col("cluster").cast("long").alias("id"), "pc1", "pc2"))
    return both.select("kind", "id", r6(F.abs("pc1")).alias("pc1"), r6(F.abs("pc2")).alias("pc2"))


@register("pca_wide")
def q_pca_wide(spark, sf):
    """M5 on all embeddings (64 features), no covariance matrix: variance of both components, their shares
    and the covariance of the two, over all projected rows."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    data = td.table(spark, sf, "embeddings").select("vec_id", vec.alias("vec")).transform(materialize)
    width = data.agg(F.max(F.size("vec"))).first()[0] or 0
    model = CM.principal_components(data, width, 2)
    at = CM.project(data, model)
    return at.agg(*[r6(F.var_pop(c)).alias(f"var_{c}") for c in ("pc1", "pc2")], r6(F.covar_pop("pc1", "pc2")).alias("covar"),
                  *[r6(F.var_pop(c) / F.lit(v / s if s else None)).alias(f"share_{c}")
                    for c, v, s in zip(("pc1", "pc2"), model.values.tolist(), model.shares)])


@register("results_documents")
def q_results_documents(spark, sf):
    """Both kinds of results document written as JSON and read back."""
    from faultline.session import ensure_checkpoint_dir
    from faultline.sources import files, sinks
    unit = td.unit(spark, sf).drop("grp")
    names = {"SM_size": "Size"}
    res = EX.classify_experiment(unit, "Bug", "unit", "lr", feature_name_map=names)
    clusters = EX.cluster_experiment(unit, "Bug", "unit", "kmeans", feature_name_map=names)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultline-{uuid.uuid4().hex}"
    sinks.write_json(EX.classification_document(res, "stand-in units"), f"{folder}/classification")
    sinks.write_json(EX.cluster_document(clusters), f"{folder}/clustering")
    doc = spark.read.json(f"{folder}/classification")
    own = doc.select(
        F.lit("classification").alias("kind"), "dataset", F.col("classifier").alias("method"), "n_samples", "n_features", "n_defective",
        "defect_rate", F.size("feature_importances").cast("long").alias("n_ranked"),
        F.exists("feature_importances", lambda f: f["feature"] == "Size").alias("named"))
    other = spark.read.json(f"{folder}/clustering")
    _, ranks = files.read_results_json(spark, f"{folder}/clustering")
    found = ranks.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("feature") == "Size").alias("named"))
    return own.unionByName(other.select(
        F.lit("clustering").alias("kind"), "dataset", F.col("algorithm").alias("method"), "n_samples", "n_features", "n_defective",
        "defect_rate", found.select("n").scalar().alias("n_ranked"), found.select("named").scalar().alias("named")))
