"""Column-level helpers: families, feature selection, label and value rules.

All helpers return Column expressions or column-name lists; the work stays
inside Catalyst (no Python per row).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values that must equal the reference's -------------------------
# Coverage feature family (five columns, in this order).
COVERAGE_FEATURES = ["COV_INSTRUCTION", "COV_BRANCH", "COV_LINE", "COV_COMPLEXITY", "COV_METHOD"]
# The 26 effort features used by the combined dataset, in this order.
EFFORT_FEATURES_26 = [
    "CHANGE_TYPE_computation",
    "CHANGE_TYPE_data",
    "CHANGE_TYPE_other",
    "HASSAN_edhcm",
    "HASSAN_hcm",
    "HASSAN_ldhcm",
    "HASSAN_lgdhcm",
    "HASSAN_whcm",
    "ISSUE_major_bug",
    "ISSUE_major_improvement",
    "MOSER_authors",
    "MOSER_bugfix",
    "MOSER_revisions",
    "MOSER_sum_lines_deleted",
    "MOSER_weighted_age",
    "PMD_arp",
    "PMD_cis",
    "PMD_odpl",
    "PMD_rule_type_basic rules",
    "PMD_rule_type_controversial rules",
    "PMD_rule_type_design rules",
    "PMD_rule_type_string and stringbuffer rules",
    "PMD_rule_type_unnecessary and unused code rules",
    "PMD_severity_critical",
    "PMD_severity_major",
    "PMD_severity_minor",
]
# Effort families (prefix match, any of them).
EFFORT_PREFIXES = ("CHANGE_TYPE_", "HASSAN_", "ISSUE_", "MOSER_", "PMD_")
# Category of a feature: first matching prefix in this order, else OTHER.
CATEGORY_PREFIXES = ["PMD_", "HASSAN_", "MOSER_", "ISSUE_", "CHANGE_TYPE_", "SM_", "AST_"]
# Names never used as features (compared case-insensitively), besides the label.
NON_FEATURE_NAMES = {"id", "version", "version-id"}
# Largest finite double: +/-inf are clipped to it by the imputer.
MAX_DOUBLE = 1.7976931348623157e308
# --------------------------------------------------------------------------


def q(name: str) -> str:
    """Backtick-quote a column name (names may hold spaces, dots and '-')."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def family_columns(df: DataFrame, prefixes: str | Sequence[str]) -> list[str]:
    """Columns whose name starts with any of the prefixes, in source order."""
    if isinstance(prefixes, str):
        prefixes = (prefixes,)
    prefixes = tuple(prefixes)
    return [c for c in df.columns if c.startswith(prefixes)]


def available(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted names that exist, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def missing(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Set difference of names, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c not in have]


def project_family(
    df: DataFrame,
    metadata: Sequence[str],
    prefixes: str | Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Metadata columns then a family, in source order.

    ``strict=False`` tolerates absent metadata (the extract action warns and
    goes on); ``strict=True`` raises like the other actions do.
    """
    absent = missing(df, metadata)
    if absent and strict:
        raise KeyError(f"missing metadata columns: {absent}")
    keep = available(df, metadata) + [c for c in family_columns(df, prefixes) if c not in metadata]
    return df.select(*[col(c) for c in keep])


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def feature_columns(df: DataFrame, label: str) -> list[str]:
    """Numeric columns except the label, id, version and version-id."""
    exclude = {label.lower()} | NON_FEATURE_NAMES
    return [
        f.name
        for f in df.schema.fields
        if is_numeric(f.dataType) and f.name.lower() not in exclude and f.name != label
    ]


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Make NaN a NULL in floating columns, so comparisons behave as in pandas."""
    cols = set(columns) if columns is not None else None
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name)
        out.append(c)
    return df.select(*out)


def binarize(label: str) -> Column:
    """Label > 0 -> 1 else 0 (NULL and NaN count as 0 after F2 removed them)."""
    c = col(label)
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & (c > 0), 1).otherwise(0).cast("int")


def impute(c: Column) -> Column:
    """NULL/NaN -> 0.0, +inf -> largest double, -inf -> most negative double."""
    d = c.cast("double")
    return (
        F.when(d.isNull() | F.isnan(d), F.lit(0.0))
        .when(d == F.lit(float("inf")), F.lit(MAX_DOUBLE))
        .when(d == F.lit(float("-inf")), F.lit(-MAX_DOUBLE))
        .otherwise(d)
    )


def cluster_name(c: Column) -> Column:
    """P10: -1 -> 'noise', n -> 'cluster_n'."""
    return F.when(c == -1, F.lit("noise")).otherwise(F.concat(F.lit("cluster_"), c.cast("string")))


def feature_category(c: Column, prefixes: Sequence[str] = CATEGORY_PREFIXES) -> Column:
    """category = first matching prefix without its trailing '_', else OTHER."""
    expr = None
    for p in prefixes:
        name = p.rstrip("_")
        expr = (F.when(c.startswith(p), F.lit(name)) if expr is None
                else expr.when(c.startswith(p), F.lit(name)))
    return expr.otherwise(F.lit("OTHER"))


def family_of(c: Column) -> Column:
    """SM / COV / effort (everything else) family of a feature name."""
    return (
        F.when(c.startswith("SM_"), F.lit("SM"))
        .when(c.startswith("COV_"), F.lit("COV"))
        .otherwise(F.lit("EFFORT"))
    )
