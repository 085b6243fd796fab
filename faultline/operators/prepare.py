"""Row filters, joins and unions used to prepare feature tables.

pandas semantics the reference relies on, kept here on purpose:
  * ``merge`` matches NULL keys to NULL keys -> ``null_keys=True`` uses <=>.
  * ``x != v`` is True for a missing x -> ``exclude_value`` keeps NULLs.
  * ``dropna(how="all")`` / ``dropna(subset=...)`` treat NaN like NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.columns import col, family_of, q


def _missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    dt = df.schema[name].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def drop_all_missing(df: DataFrame) -> DataFrame:
    """drop rows where every column is missing (NULL or NaN)."""
    if not df.columns:
        return df
    cond = reduce(lambda a, b: a & b, [_missing(df, c) for c in df.columns])
    return df.filter(~cond)


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """drop rows with a missing value in any of ``subset`` (absent names ignored)."""
    names = [c for c in subset if c in df.columns]
    if not names:
        return df
    cond = reduce(lambda a, b: a | b, [_missing(df, c) for c in names])
    return df.filter(~cond)


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """keep rows whose ``column`` is not ``value``; NULLs are kept (pandas ``!=``)."""
    return df.filter(~col(column).eqNullSafe(F.lit(value)))


def join_on(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str] | None = None,
    how: str = "inner",
    null_keys: bool = False,
    drop_right_keys: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join on (possibly differently named) key columns.

    With ``null_keys=True`` NULL keys match each other, like pandas ``merge``.
    Right key columns that share a name with a left key are coalesced into the
    left one (as pandas does for ``on=``); differently named right keys are
    dropped when ``drop_right_keys`` (the reference drops them after the merge).
    Other columns that both sides have are kept, with ``suffixes`` to their names.
    The join strategy is left to Catalyst/AQE: small dimension sides are
    broadcast by the size threshold, large ones sort-merge, skew is split.
    """
    right_on = list(right_on or left_on)
    left_on = list(left_on)
    if len(left_on) != len(right_on):
        raise ValueError("left_on and right_on differ in length")
    r_alias = {c: f"__r{i}" for i, c in enumerate(right_on)}
    clash = {c for c in right.columns if c in left.columns and c not in r_alias and c not in left_on}
    renamed = [c + suffixes[0] if c in clash else c for c in left.columns]
    if clash:
        left = left.toDF(*renamed)
    r = right.select(
        *[col(c).alias(r_alias[c]) for c in right_on],
        *[col(c).alias(c + suffixes[1] if c in left_on or c in clash else c) for c in right.columns if c not in r_alias],
    )
    conds = []
    for lk, rk in zip(left_on, right_on):
        lc, rc = left[q(lk)], r[r_alias[rk]]
        conds.append(lc.eqNullSafe(rc) if null_keys else lc == rc)
    cond = reduce(lambda a, b: a & b, conds)
    j = left.join(r, cond, how)
    keep = [left[q(c)] for c in left.columns]
    if how in ("right", "right_outer", "full", "full_outer", "outer"):
        keep = []
        for c in left.columns:
            if c in left_on:
                rk = right_on[left_on.index(c)]
                keep.append(F.coalesce(left[q(c)], r[r_alias[rk]]).alias(c))
            else:
                keep.append(left[q(c)])
    extra = [r[q(c)] for c in r.columns if not c.startswith("__r")]
    if not drop_right_keys:
        extra = [r[r_alias[rk]].alias(rk) for rk in right_on if rk not in left.columns] + extra
    return j.select(*keep, *extra)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; columns missing in a part become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unmatched_count(df: DataFrame, column: str) -> DataFrame:
    """Rows whose (first right-side) column is missing after a left join."""
    return df.agg(F.sum(F.when(_missing(df, column), 1).otherwise(0)).cast("bigint").alias("unmatched"),
                  F.count(F.lit(1)).alias("rows"))


def family_counts(columns_df: DataFrame, name_col: str = "feature") -> DataFrame:
    """Number of SM / COV / EFFORT features in a column-name table."""
    return columns_df.groupBy(family_of(F.col(name_col)).alias("family")).agg(
        F.count(F.lit(1)).alias("n_features"))


def schema_table(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The column names of ``df`` (minus ``exclude`` and ``Unnamed*``) as a table.

    A schema has a bounded number of fields, so this small table is built on
    the driver from metadata, not from data.
    """
    ex = set(exclude)
    rows = [(i, c) for i, c in enumerate(df.columns) if c not in ex and "Unnamed" not in c]
    return df.sparkSession.createDataFrame(rows, "feature_idx int, feature string")
