"""Cluster centers, feature relevance, rankings and group comparisons.

Feature-grain tables (rankings, groups) have one row per feature, so their
size is bounded by the schema width, not by the data; ordering windows over
them (rank = position) are safe. The data-grain work -- centers -- is one pass
of vector moments, combined in the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.columns import feature_category
from faultline.operators.moments import moments

TOP_NS = (50, 100, 500, 1000)


def cluster_centers(df: DataFrame, features: Sequence[str], cluster: str = "cluster",
                    id_col: str = "row_id") -> DataFrame:
    """A3: mean of every feature per non-noise cluster, long form
    ``(cluster, feature_idx, feature, center)``."""
    return moments(df.filter(F.col(cluster) >= 0), features, cluster) \
        .select(F.col("group").alias("cluster"), "feature_idx", "feature", F.col("mean").alias("center"))


def relevance_from_centers(centers: DataFrame, features: Sequence[str]) -> DataFrame:
    """A4 from a center table: population std of each feature over the
    centers (each center weight 1); fewer than two centers -> all 0.0."""
    per = centers.groupBy("feature_idx", "feature").agg(
        F.stddev_pop("center").alias("std"), F.count(F.lit(1)).alias("k"))
    spark = centers.sparkSession
    allf = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "feature_idx int, feature string")
    n_centers = centers.agg(F.count_distinct("cluster")).scalar()
    j = allf.join(per.drop("feature"), "feature_idx", "left")
    return j.select(
        "feature_idx", "feature",
        F.when(n_centers >= 2, F.coalesce(F.col("std"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("relevance"),
    )


def feature_relevance(df: DataFrame, features: Sequence[str], cluster: str = "cluster",
                      id_col: str = "row_id", names: Sequence[str] | None = None) -> DataFrame:
    """A4 + T1: ranking ``(rank, feature, relevance, feature_idx)``, relevance
    descending, ties by source position."""
    rel = relevance_from_centers(cluster_centers(df, features, cluster, id_col), features)
    if names is not None and list(names) != list(features):
        m = df.sparkSession.createDataFrame(list(enumerate(names)), "feature_idx int, display string")
        rel = rel.join(m, "feature_idx").select("feature_idx", F.col("display").alias("feature"), "relevance")
    return rank_features(rel)


def rank_features(rel: DataFrame) -> DataFrame:
    """rank = position after a relevance-descending sort, ties by feature_idx."""
    w = Window.orderBy(F.col("relevance").desc(), F.col("feature_idx").asc())  # feature grain
    return rel.select(F.row_number().over(w).cast("long").alias("rank"), "feature", "relevance", "feature_idx")


def top_family(ranking: DataFrame, prefix: str = "SM_", n: int = 30) -> DataFrame:
    """Top-N features of a family by relevance (stable: ties keep rank order)."""
    fam = ranking.filter(F.col("feature").startswith(prefix))
    w = Window.orderBy(F.col("relevance").desc(), F.col("rank").asc())
    return fam.select(F.row_number().over(w).cast("long").alias("family_rank"), "feature", "relevance", "rank") \
        .filter(F.col("family_rank") <= n)


def head(ranking: DataFrame, n: int = 20) -> DataFrame:
    """First N rows of a ranking."""
    return ranking.filter(F.col("rank") <= n)


def feature_ranks(ranking: DataFrame, groups: DataFrame) -> DataFrame:
    """Rank of each group feature in the ranking, NULL if absent.

    Duplicate names in the ranking: the last one wins (largest rank);
    duplicate names inside a group collapse.
    """
    last = ranking.groupBy("feature").agg(F.max("rank").alias("rank"))
    return groups.select("group", "feature").distinct().join(last, "feature", "left") \
        .select("group", "feature", "rank")


def rank_stats(ranks: DataFrame, top_ns: Sequence[int] = TOP_NS) -> DataFrame:
    """Per group total, found, not_found, found %, min/max/avg rank, upper
    median ``sorted[n // 2]`` and in-top-N counts and % of all group features."""
    w = Window.partitionBy("group").orderBy(F.col("rank").asc())  # group grain: bounded by feature count
    found = ranks.filter(F.col("rank").isNotNull())
    med = found.select("group", "rank", F.row_number().over(w).alias("pos"),
                       F.count(F.lit(1)).over(Window.partitionBy("group")).alias("nf")) \
        .filter(F.col("pos") == F.floor(F.col("nf") / 2) + 1).select("group", F.col("rank").alias("median_rank"))
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count("rank").alias("found"),
        F.min("rank").alias("min_rank"),
        F.max("rank").alias("max_rank"),
        F.avg("rank").alias("avg_rank"),
    ] + [F.sum(F.when(F.col("rank") <= n, 1).otherwise(0)).alias(f"in_top_{n}") for n in top_ns]
    g = ranks.groupBy("group").agg(*aggs)
    out = g.join(med, "group", "left").select(
        "group", "total", "found",
        (F.col("total") - F.col("found")).alias("not_found"),
        F.when(F.col("total") > 0, F.col("found") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("found_pct"),
        "min_rank", "max_rank", "median_rank", "avg_rank",
        *[F.col(f"in_top_{n}") for n in top_ns],
        *[F.when(F.col("total") > 0, F.col(f"in_top_{n}") / F.col("total") * 100).otherwise(F.lit(0.0))
          .alias(f"in_top_{n}_pct") for n in top_ns],
    )
    return out


def category_breakdown(ranks: DataFrame) -> DataFrame:
    """Per (group, category) of found features: count, avg/min rank, in top 100."""
    found = ranks.filter(F.col("rank").isNotNull()).withColumn("category", feature_category(F.col("feature")))
    return found.groupBy("group", "category").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("rank").alias("avg_rank"),
        F.min("rank").alias("min_rank"),
        F.sum(F.when(F.col("rank") <= 100, 1).otherwise(0)).alias("in_top_100"),
    )


def top_found(ranks: DataFrame, n: int = 20) -> DataFrame:
    """T4: the N best-ranked found features of each group, with category."""
    w = Window.partitionBy("group").orderBy(F.col("rank").asc(), F.col("feature").asc())
    found = ranks.filter(F.col("rank").isNotNull())
    return found.select("group", F.row_number().over(w).cast("long").alias("pos"), "feature", "rank",
                        feature_category(F.col("feature")).alias("category")).filter(F.col("pos") <= n)


def ranking_overlap(a: DataFrame, b: DataFrame, top_ns: Sequence[int]) -> DataFrame:
    """U4: features in the top N of both rankings, with both ranks, per N."""
    ns = a.sparkSession.createDataFrame([(n,) for n in top_ns], "top_n int")
    j = a.select("feature", F.col("rank").alias("rank_a")).join(
        b.select("feature", F.col("rank").alias("rank_b")), "feature")
    # |top_ns| is a handful of constants: a broadcast range join on rank <= N
    return j.join(F.broadcast(ns), (F.col("rank_a") <= F.col("top_n")) & (F.col("rank_b") <= F.col("top_n"))) \
        .select("top_n", "feature", "rank_a", "rank_b")


ROLLUP_PREFIXES = ["PMD_", "HASSAN_", "MOSER_", "ISSUE_", "CHANGE_TYPE_", "SM_", "AST_", "COV_"]


def category_rollup(ranking: DataFrame) -> DataFrame:
    """Per category (COV counted as its own): n, rank range, average
    relevance and the best-ranked feature."""
    r = ranking.withColumn("category", feature_category(F.col("feature"), ROLLUP_PREFIXES))
    return r.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("rank").alias("min_rank"),
        F.max("rank").alias("max_rank"),
        F.avg("relevance").alias("avg_relevance"),
        F.min_by("feature", "rank").alias("top_feature"),
    )


def category_shares(ranking: DataFrame, top_n: int = 100) -> DataFrame:
    """Category counts among the top N of a ranking."""
    r = ranking.filter(F.col("rank") <= top_n).withColumn(
        "category", feature_category(F.col("feature"), ROLLUP_PREFIXES))
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
