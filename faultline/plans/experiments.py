"""User-level pipelines (X7-X10) and their report tables.

Each pipeline returns DataFrames (plus a few driver-side scalars such as the
chosen eps); writing them is the caller's choice (``sources.sinks``). The
scaled matrix is materialised once and shared by every downstream job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import classify as CL
from faultline.operators import dbscan as DB
from faultline.operators import pairwise as PW
from faultline.operators import quality as QL
from faultline.operators import ranking as RK
from faultline.operators.centroid import kmeans_batched, pca2d
from faultline.operators.metric_tree import LEAF_ROWS, build
from faultline.operators.ordering import row_index
from faultline.operators.scaling import Prepared, preprocess
from faultline.session import materialize

# --- fixed values: defaults of the reference's experiments --------------------
KMEANS_DEFAULTS = {"n_clusters": 2, "random_state": 42, "n_init": 10, "max_iter": 300}
DBSCAN_DEFAULTS = {"eps": None, "min_samples": 5, "metric": "euclidean"}
PREPROCESSING_DEFAULTS = {"remove_outliers": False, "outlier_z_threshold": 3.0}
# ----------------------------------------------------------------------------


@dataclass
class ClusterResult:
    dataset: str
    algorithm: str
    prepared: Prepared
    labels: DataFrame                  # row_id, cluster
    params: dict                       # eps, auto_eps, min_samples / n_clusters
    info: DataFrame | None             # A10 (DBSCAN)
    stats: DataFrame                   # A5
    prediction: DataFrame              # A6
    external: DataFrame                # A7
    internal: DataFrame                # A8 + A9
    ranking: DataFrame                 # A4 + T1
    extra: dict = field(default_factory=dict)


def cluster_experiment(df: DataFrame, label: str, dataset: str = "dataset", algorithm: str = "dbscan",
                       id_col: str = "row_id", eps: float | None = None, min_samples: int | None = None,
                       n_clusters: int | None = None, seed: int | None = None, remove_outliers: bool = False,
                       z: float | None = None, feature_name_map: Mapping[str, str] | None = None,
                       max_eps_samples: int | None = None) -> ClusterResult:
    """Preprocess -> K-Means or DBSCAN (auto eps by default) -> metrics -> ranking.

    As in the reference, ``0`` for ``min_samples`` / ``n_clusters`` / ``z``
    falls back to the default (``x or default``) while ``eps`` uses ``is None``.
    ``id_col`` may be of any ordered type: the distance work runs on row
    positions in its order, and the labels come back under the ids. Automatic
    eps looks at all rows unless ``max_eps_samples`` is given.
    """
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        ids = materialize(row_index(df.select(id_col).distinct(), [id_col], "__row"))
        res = cluster_experiment(df.join(ids, id_col).drop(id_col), label, dataset, algorithm, "__row", eps, min_samples,
                                 n_clusters, seed, remove_outliers, z, feature_name_map, max_eps_samples)

        def named(t: DataFrame) -> DataFrame:
            return t.join(ids, "__row").select(id_col, *[c for c in t.columns if c != "__row"])
        return replace(res, labels=named(res.labels), extra={k: named(v) for k, v in res.extra.items()})
    min_samples = min_samples or DBSCAN_DEFAULTS["min_samples"]
    n_clusters = n_clusters or KMEANS_DEFAULTS["n_clusters"]
    seed = KMEANS_DEFAULTS["random_state"] if seed is None else seed
    z = z or PREPROCESSING_DEFAULTS["outlier_z_threshold"]
    prep = preprocess(df, label, id_col=id_col, feature_name_map=feature_name_map, remove_outliers=remove_outliers, z=z)
    vec = prep.vectors().transform(materialize)  # shared by every pass below
    params: dict = {}
    centers = None
    info = None
    if algorithm == "dbscan":
        auto = eps is None
        tree = build(vec, id_col, block_rows=max(LEAF_ROWS, min_samples))  # read by the k-distances and by DBSCAN
        if auto:
            eps = float(PW.find_eps(vec, min_samples, max_eps_samples, id_col, tree=tree).first()["eps"])
        labels = DB.dbscan(vec, eps, min_samples, id_col, tree=tree).select(id_col, "cluster")
        info = QL.cluster_info(labels)
        params = {"eps": eps, "auto_eps": auto, "min_samples": min_samples}
    elif algorithm == "kmeans":
        _, labels, centers = kmeans_batched(prep.df, prep.features, k=n_clusters, seed=seed,
                                    n_init=KMEANS_DEFAULTS["n_init"], max_iter=KMEANS_DEFAULTS["max_iter"],
                                    id_col=id_col)
        params = {"n_clusters": n_clusters}
    else:
        raise ValueError(f"Unknown algorithm: {algorithm}")
    labelled = vec.join(labels, id_col).withColumnRenamed("label", "y").transform(materialize)
    stats = QL.cluster_stats(labelled, "cluster", "y")
    prediction = QL.risk_metrics(labelled, "cluster", "y")
    external = QL.external_metrics(labelled, "cluster", "y")
    sil = PW.silhouette(labelled, id_col, "features", "cluster")
    dbi = PW.davies_bouldin(labelled, id_col, "features", "cluster")
    internal = sil.select(F.col("silhouette").alias("silhouette_score"),
                          dbi.select("davies_bouldin").scalar().alias("davies_bouldin_index"))
    if centers is not None:  # K-Means: relevance from the model's centroids
        rel = RK.relevance_from_centers(centers, prep.features)
        if prep.names != prep.features:
            names = df.sparkSession.createDataFrame(list(enumerate(prep.names)), "feature_idx int, display string")
            rel = rel.join(names, "feature_idx").select("feature_idx", F.col("display").alias("feature"), "relevance")
        ranking = RK.rank_features(rel)
    else:
        scaled = prep.df.join(labels, id_col)
        ranking = RK.feature_relevance(scaled, prep.features, "cluster", id_col, prep.names)
    return ClusterResult(dataset, algorithm, prep, labels, params, info, stats, prediction, external, internal,
                         ranking, {"labelled": labelled})


def metrics_summary(res: ClusterResult, drop_null: bool = True) -> DataFrame:
    """(section, metric, value) rows of one clustering run, then one
    row per cluster with its rate and risk marker. F10: metrics that are
    undefined for the run (NULL, e.g. silhouette with one cluster) are left
    out unless ``drop_null=False``."""
    lab = res.extra["labelled"]
    head = lab.agg(F.count(F.lit(1)).cast("double").alias("n_samples"),
                   F.sum("y").cast("double").alias("n_defective"),
                   F.round(F.avg("y") * 100, 2).alias("defect_rate"))
    parts = [("dataset", head)]
    spark = lab.sparkSession
    p = spark.createDataFrame([tuple(float(v) for v in res.params.values())],
                              ", ".join(f"{k} double" for k in res.params)) if res.params else None
    if p is not None:
        parts.append(("parameters", p))
    if res.info is not None:
        parts.append(("parameters", res.info))
    parts += [("internal", res.internal), ("external", res.external), ("prediction", res.prediction)]
    out = None
    for section, d in parts:
        cols = [c for c, t in d.dtypes if t in ("double", "int", "bigint", "float", "boolean")]
        st = d.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")) \
            .select(F.lit(section).alias("section"), "m.metric", "m.value")
        out = st if out is None else out.unionByName(st)
    if drop_null:
        out = out.filter(F.col("value").isNotNull())
    clusters = res.stats.select(F.lit("clusters").alias("section"),
                                F.concat("cluster_name", F.lit(" ["), "risk", F.lit("]")).alias("metric"),
                                F.col("defect_rate").alias("value"))
    return out.unionByName(clusters)


def k_distance_curve(vec: DataFrame, eps: float | None = None, k: int = 5, id_col: str = "row_id",
                     kdist: DataFrame | None = None) -> DataFrame:
    """Sorted k-distance curve of all rows: (idx, k_distance, is_eps);
    ``kdist`` are the distances if they are known already."""
    kd = PW.kth_neighbour(vec, k, id_col) if kdist is None else kdist
    idx = row_index(kd, ["k_distance", id_col], "idx")
    flag = (F.round(F.col("k_distance"), 9) == F.lit(round(eps, 9))) if eps is not None else F.lit(False)
    return idx.select("idx", "k_distance", flag.alias("is_eps"))


def pca_scatter(res: ClusterResult) -> tuple[DataFrame, list[float], DataFrame]:
    """(row_id, pc1, pc2, cluster, label), the explained-variance ratios, and
    the clusters' centers projected by the same model: (cluster, pc1, pc2)."""
    df = res.prepared.df.join(res.labels, res.prepared.id_col)
    vec = F.array(*[F.col(f) for f in res.prepared.features])
    centers = PW.center_vectors(df.select(vec.alias("features"), "cluster"))
    return pca2d(df, res.prepared.features, res.prepared.id_col, extra=["cluster", "label"], centers=centers)


@dataclass
class ClassifyResult:
    dataset: str
    classifier: str
    predictions: DataFrame     # out-of-fold predictions
    per_fold: DataFrame        # fold x metrics
    summary: DataFrame         # A14
    importances: DataFrame     # M10
    folds: int = 5
    seed: int = 42
    n_features: int = 0


def classify_experiment(df: DataFrame, label: str, dataset: str = "dataset", classifier: str = "rf",
                        id_col: str = "row_id", folds: int = 5, seed: int = 42,
                        feature_name_map: Mapping[str, str] | None = None) -> ClassifyResult:
    """Preprocess (no outlier removal) -> stratified CV -> metrics -> full refit
    importances, under the names of ``feature_name_map`` where it has one."""
    prep = preprocess(df, label, id_col=id_col, feature_name_map=feature_name_map)
    data = prep.df.withColumnRenamed("label", "y")
    preds = CL.cross_validate(data, prep.features, classifier, "y", id_col, folds, seed)
    per = CL.cv_metrics(preds)
    summary = CL.cv_summary(CL.long_metrics(per, list(CL.METRICS)))
    imp = CL.importances(data, prep.features, classifier, "y", seed, id_col)
    if prep.names != prep.features:
        m = df.sparkSession.createDataFrame(list(zip(prep.features, prep.names)), "feature string, display string")
        imp = imp.join(m, "feature").select("rank", F.col("display").alias("feature"), "importance")
    return ClassifyResult(dataset, classifier, preds, per, summary, imp, folds, seed, len(prep.features))


def compare_all(results: Sequence[ClassifyResult], top_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """R4 matrix (metric x dataset, mean/std, best marked; first dataset
    wins ties) and T5 top-N importances per dataset."""
    parts, imps = [], []
    for i, r in enumerate(results):
        parts.append(r.summary.select(F.lit(r.dataset).alias("dataset"), F.lit(i).alias("dataset_idx"),
                                      "metric", "mean", "std"))
        imps.append(r.importances.filter(F.col("rank") <= top_n).select(F.lit(r.dataset).alias("dataset"), "rank",
                                                                       "feature", "importance"))
    mat = parts[0]
    for p in parts[1:]:
        mat = mat.unionByName(p)
    top = imps[0]
    for p in imps[1:]:
        top = top.unionByName(p)
    return CL.best_by_metric(mat), top


def group_comparison(ranking: DataFrame, groups: DataFrame, top_n: int = 20) -> dict[str, DataFrame]:
    """Ranks of every group feature, rank statistics, category
    breakdown and the best-ranked found features of each group."""
    ranks = RK.feature_ranks(ranking, groups)
    return {"ranks": ranks, "stats": RK.rank_stats(ranks), "categories": RK.category_breakdown(ranks),
            "top": RK.top_found(ranks, top_n)}


def side_by_side(a: DataFrame, b: DataFrame, name_a: str, name_b: str,
                 lower_is_better: Sequence[str] = ("davies_bouldin_index", "davies_bouldin")) -> DataFrame:
    """Two runs' (metric, value) tables side by side with the winner and the delta."""
    j = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    low = F.col("metric").isin(list(lower_is_better))
    winner = (F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(None))
              .when(F.col("a") == F.col("b"), F.lit("tie"))
              .when(low & (F.col("a") < F.col("b")), F.lit(name_a))
              .when(low, F.lit(name_b))
              .when(F.col("a") > F.col("b"), F.lit(name_a)).otherwise(F.lit(name_b)))
    return j.select("metric", F.col("a").alias(name_a), F.col("b").alias(name_b),
                    (F.col("b") - F.col("a")).alias("delta"), winner.alias("winner"))


def top_per_dataset(imp: DataFrame, n: int = 10) -> DataFrame:
    """T5: top-N rows of each dataset's importance table."""
    w = Window.partitionBy("dataset").orderBy(F.col("importance").desc(), F.col("rank").asc())
    return imp.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def group_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One long table ``(group, section, stat, value)`` from
    :func:`group_comparison`: the rank statistics, one row per category
    (count / avg rank / best rank / in top 100) and the best-ranked found
    features (stat = position, value = rank)."""
    st = parts["stats"]
    num = [c for c, t in st.dtypes if c != "group" and t in ("int", "bigint", "double")]
    stats = st.select("group", F.explode(F.array(*[
        F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in num])).alias("s")) \
        .select("group", F.lit("stats").alias("section"), "s.stat", "s.value")
    cats = parts["categories"].select("group", "category", F.explode(F.array(*[
        F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("value"))
        for c in ("count", "avg_rank", "min_rank", "in_top_100")])).alias("s")) \
        .select("group", F.lit("category").alias("section"),
                F.concat("category", F.lit(":"), F.col("s.m")).alias("stat"), "s.value")
    top = parts["top"].select("group", F.lit("top").alias("section"),
                              F.concat(F.col("pos").cast("string"), F.lit(". "), "feature", F.lit(" ["),
                                       "category", F.lit("]")).alias("stat"),
                              F.col("rank").cast("double").alias("value"))
    return stats.unionByName(cats).unionByName(top)


def cluster_document(res: ClusterResult, remove_outliers: bool = False, z: float | None = None) -> DataFrame:
    """The one-row nested results document of a clustering run:
    dataset, algorithm, algorithm_params, preprocessing, n_samples,
    n_features, n_defective, defect_rate, internal / external / prediction
    metric structs, ``cluster_stats`` map and ``feature_relevance`` array.
    Write it with ``sources.sinks.write_json``."""
    from faultline.sources.sinks import results_document
    lab = res.extra["labelled"]
    head = lab.agg(F.count(F.lit(1)).cast("int").alias("n_samples"),
                   F.sum("y").cast("int").alias("n_defective"),
                   F.round(F.avg("y") * 100, 2).alias("defect_rate"))
    params = res.params.copy()
    if res.info is not None:
        info = res.info.first()
        params.update(n_clusters=int(info["n_clusters"]), n_noise=int(info["n_noise"]),
                      noise_ratio=float(info["noise_ratio"]))
    p = F.struct(*[F.lit(v).alias(k) for k, v in params.items()])
    pre = F.struct(F.lit(remove_outliers).alias("remove_outliers"),
                   F.lit(z if remove_outliers else None).cast("double").alias("z_threshold"))
    metrics = head.select(
        F.lit(res.dataset).alias("dataset"), F.lit(res.algorithm).alias("algorithm"),
        p.alias("algorithm_params"), pre.alias("preprocessing"), "n_samples",
        F.lit(len(res.prepared.features)).alias("n_features"), "n_defective", "defect_rate",
        res.internal.select(F.struct("*")).scalar().alias("internal_metrics"),
        res.external.select(F.struct("*")).scalar().alias("external_metrics"),
        res.prediction.select(F.struct("*")).scalar().alias("prediction_metrics"))
    return results_document(metrics, res.ranking, res.stats)


def classification_document(res: ClassifyResult, description: str = "") -> DataFrame:
    """The one-row nested results document of a classification run:
    dataset, description, classifier, cv_folds, random_state, n_samples, n_features,
    n_defective, defect_rate, metrics (mean, std and the folds' values by metric) and
    feature_importances in order. Write it with ``sources.sinks.write_json``."""
    head = res.predictions.agg(F.count(F.lit(1)).alias("n_samples"), F.sum("y").cast("long").alias("n_defective"),
                               F.round(F.avg("y") * 100, 2).alias("defect_rate"))
    metrics = res.summary.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("metric", F.struct("mean", "std", "values"))))).alias("m"))  # five metrics
    ranked = res.importances.agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "importance"))).alias("f"))  # one entry a feature
    ranked = ranked.select(F.transform("f", lambda s: F.struct(s["feature"].alias("feature"), s["importance"].alias("importance"))).alias("f"))
    return head.select(
        F.lit(res.dataset).alias("dataset"), F.lit(description).alias("description"), F.lit(res.classifier).alias("classifier"),
        F.lit(res.folds).alias("cv_folds"), F.lit(res.seed).alias("random_state"), "n_samples",
        F.lit(res.n_features).alias("n_features"), "n_defective", "defect_rate",
        metrics.select("m").scalar().alias("metrics"), ranked.select("f").scalar().alias("feature_importances"))
