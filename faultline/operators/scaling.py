"""Feature matrix preparation: impute, standardise, drop outliers (M1).

Layout: a wide DataFrame ``(row_id, label, f_1 .. f_d)``. Per-feature
statistics are vector moments over Arrow batches (``operators/moments.py``), so
any width works: a task keeps one vector and the shuffle moves ``d x tasks``
rows, never the data. The ``d``
statistics rows (bounded by the schema width, not the data) come back to the
driver to build the scaling expressions, as MLlib's scalers do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.columns import binarize, col, feature_columns, impute
from faultline.operators.moments import moments
from faultline.session import materialize


@dataclass
class Prepared:
    """Output of :func:`preprocess`: the scaled matrix and its metadata."""

    df: DataFrame                # row_id, label, *features (scaled doubles)
    features: list[str]          # column names in ``df``
    names: list[str]             # display names (feature name map applied)
    means: dict[str, float]
    stds: dict[str, float]       # population std, 0 replaced by 1
    id_col: str = "row_id"
    label_col: str = "label"

    def vectors(self, out: str = "features") -> DataFrame:
        """(row_id, label, features array<double>) for the distance operators."""
        return self.df.select(self.id_col, self.label_col,
                              F.array(*[col(c) for c in self.features]).alias(out))


def long_form(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """(id, feature_idx, feature, value) rows, one per cell."""
    stacked = df.select(
        col(id_col),
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("feature_idx"), F.lit(f).alias("feature"), col(f).cast("double").alias("value"))
            for i, f in enumerate(features)
        ])).alias("c"),
    )
    return stacked.select(col(id_col), "c.feature_idx", "c.feature", "c.value")


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A2: per-feature count, mean and population std."""
    return moments(df, features)


def _collect_stats(df: DataFrame, features: Sequence[str]) -> tuple[dict, dict]:
    rows = feature_stats(df, features).collect()  # d rows: bounded by the schema width
    means, stds = dict.fromkeys(features, 0.0), dict.fromkeys(features, 1.0)
    for r in rows:
        means[r["feature"]] = float(r["mean"]) if r["mean"] is not None else 0.0
        s = r["std"]
        # population std; constant (or empty) columns scale by 1, like the reference
        stds[r["feature"]] = 1.0 if s is None or s == 0.0 else float(s)
    return means, stds


def scale_expr(c: Column, mean: float, std: float) -> Column:
    return (c - F.lit(mean)) / F.lit(std)


def standardize(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, dict, dict]:
    """A2: (x - mean) / std_pop per feature; returns (df, means, stds)."""
    means, stds = _collect_stats(df, features)
    out = df.select(*[col(k) for k in keep],
                    *[scale_expr(col(f), means[f], stds[f]).alias(f) for f in features])
    return out, means, stds


def max_abs(features: Sequence[str]) -> Column:
    cols = [F.abs(col(f)) for f in features]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def drop_outliers(df: DataFrame, features: Sequence[str], z: float = 3.0) -> DataFrame:
    """keep rows whose largest |z| over all features is <= z (inclusive)."""
    return df.filter(max_abs(features) <= F.lit(z))


def preprocess(
    df: DataFrame,
    label: str,
    id_col: str = "row_id",
    feature_name_map: Mapping[str, str] | None = None,
    remove_outliers: bool = False,
    z: float = 3.0,
    features: Sequence[str] | None = None,
    persist_input: bool = True,
) -> Prepared:
    """M1: select numeric features, binarise the label, impute, standardise,
    optionally drop outliers (after scaling; the scaler is not refit).

    Statistics are fit on all rows, as in the reference. With
    ``persist_input`` the imputed matrix is written once as Parquet under
    ``spark.checkpoint.dir`` (``session.materialize``): the statistics pass
    and every later use read it instead of re-running the upstream plan.
    """
    feats = list(features) if features is not None else [c for c in feature_columns(df, label) if c != id_col]
    names = [str((feature_name_map or {}).get(f, f)) for f in feats]
    base = df.select(
        col(id_col).alias(id_col),
        binarize(label).alias("label"),
        *[impute(col(f)).alias(f) for f in feats],
    )
    if persist_input:
        base = materialize(base)
    scaled, means, stds = standardize(base, feats, keep=[id_col, "label"])
    if remove_outliers:
        scaled = drop_outliers(scaled, feats, z)
    return Prepared(scaled, feats, names, means, stds, id_col, "label")
