"""Dataset preparation actions (X1-X6) as DataFrame plans.

Each action takes its inputs as DataFrames (read by ``faultline.sources``)
and returns the prepared DataFrame; writing it is the caller's choice
(``faultline.sources.sinks``). ``extract_table`` goes from file to file. Joins are left to Catalyst/AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.columns import (COVERAGE_FEATURES, EFFORT_FEATURES_26, EFFORT_PREFIXES, available, col,
                                         family_columns, project_family)
from faultline.operators import prepare as P
from faultline.sources import files, sinks


def extract_family(df: DataFrame, metadata: Sequence[str], prefix: str = "SM_") -> DataFrame:
    """Metadata + one column family (missing metadata tolerated)."""
    return project_family(df, metadata, prefix, strict=False)


def extract_table(spark: SparkSession, path: str | Sequence[str], target: str, header_row: int, metadata: Sequence[str],
                  name_row: int | None = None, n_keep: int = 5, prefix: str = "SM_", fmt: str = "csv",
                  keep_string: Sequence[str] = ("version",)) -> DataFrame:
    """X1 from file to file: a table whose header stands at row ``header_row`` is read (S3);
    with ``name_row`` its features take their names from that row, all but the first ``n_keep``
    (S6, when both rows are of one length); the metadata at hand and one family are kept (P2)
    and written to ``target`` (S11). The written table is returned."""
    rows = files.preamble(spark, path, max(header_row, name_row or 0) + 1)
    df = files.read_with_header_row(spark, path, header_row, names=rows[header_row] if len(rows) > header_row else [], infer=False)
    if name_row is not None:
        df = files.splice_header(df, files.column_names(rows[name_row]), n_keep)
    out = files.infer_numeric(extract_family(df, metadata, prefix), keep_string)
    sinks.write_table(out, target, fmt)
    return files.read_csv(spark, target, keep_string) if fmt == "csv" else spark.read.format(fmt).load(target)


def merge_coverage(metrics: DataFrame, coverage: DataFrame, version_col: str = "version",
                   first_version: str = "1.0.0", null_keys: bool = True) -> DataFrame:
    """Drop rows without a version, drop the first version (no coverage
    exists for it), then LEFT join coverage on (version, file).

    ``coverage`` carries ``version`` and ``filename`` (the reference renames
    ``filename`` to ``file``); the right-side version column is dropped.
    """
    m = P.drop_missing(metrics, [version_col])
    m = P.exclude_value(m, version_col, first_version)
    cov = coverage.select(F.col("version").alias("__cov_version"), F.col("filename").alias("file"),
                          *[col(c) for c in COVERAGE_FEATURES if c in coverage.columns])
    return P.join_on(m, cov, [version_col, "file"], ["__cov_version", "file"], how="left", null_keys=null_keys)


def combined(metrics: DataFrame, coverage: DataFrame, effort: DataFrame, top_sm: Sequence[str],
             metadata: Sequence[str], version_col: str = "version", version_id_col: str = "version_id",
             null_keys: bool = True) -> DataFrame:
    """Top-N SM features + coverage (inner on file, version) + the 26
    effort features that exist (inner on version id)."""
    sm_subset = metrics.select(*[col(c) for c in list(metadata) + available(metrics, top_sm)])
    cov = coverage.select(F.col("filename").alias("file"), F.col("version").alias(version_col),
                          *[col(c) for c in COVERAGE_FEATURES if c in coverage.columns])
    eff = effort.select(col(version_id_col), *[col(c) for c in available(effort, EFFORT_FEATURES_26)])
    j = P.join_on(sm_subset, cov, ["file", version_col], how="inner", null_keys=null_keys)
    return P.join_on(j, eff, [version_id_col], how="inner", null_keys=null_keys)


def top_n_dataset(metrics: DataFrame, top_sm: Sequence[str], metadata: Sequence[str],
                  version_col: str = "version", drop_version: str | None = None) -> DataFrame:
    """Metadata + top-N SM features; optionally drop one version (NULLs kept)."""
    out = metrics.select(*[col(c) for c in list(metadata) + available(metrics, top_sm)])
    if drop_version is not None:
        out = P.exclude_value(out, version_col, drop_version)
    return out


def effort_cov_only(combined_df: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """Metadata + effort families + coverage columns of the combined table."""
    cols = list(metadata) + family_columns(combined_df, EFFORT_PREFIXES) + family_columns(combined_df, "COV_")
    return combined_df.select(*[col(c) for c in cols])


ACTIONS = ("extract-sm", "merge-coverage", "create-combined", "create-top30-sm", "create-effort-only")


def run_action(action: str, **kwargs) -> DataFrame:
    """Dispatch by action name; an unknown action is an error listing the choices."""
    table = {
        "extract-sm": extract_table if "path" in kwargs else extract_family,
        "merge-coverage": merge_coverage,
        "create-combined": combined,
        "create-top30-sm": top_n_dataset,
        "create-effort-only": effort_cov_only,
    }
    if action not in table:
        raise ValueError(f"Unknown action: {action}. Use: {', '.join(ACTIONS)}")
    return table[action](**kwargs)
