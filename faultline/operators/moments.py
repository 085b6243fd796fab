"""Count, mean and population deviation of many columns (A2, A3).

Every task adds its Arrow batches column by column into one vector of moments
(count, mean, sum of squared deviations) for each group it meets, and gives one
row for a group and column. The rows of one column meet by one exchange, where
deviations are added about the common mean, so large means cost no digits. No
row is generated for a cell, and a plan's size does not grow with the width.

Nulls do not count; NaN makes its column's moments NaN, as Spark's own aggregates
do; a column without a value has n 0 and null moments; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from faultline.functions.columns import col

#: Columns that are worked on at once, and cells that a task holds before it gives its groups away.
SLICE, HELD_CELLS = 64, 1 << 20


def batch_moments(x: np.ndarray, valid: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, m2), each groups x columns, of the rows ``x`` (every group has a row)."""
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups))
    x, valid = np.where(valid, x, 0.0)[order], valid[order]
    n = np.add.reduceat(valid.astype(np.int64), starts, axis=0)
    mean = np.add.reduceat(x, starts, axis=0) / np.maximum(n, 1)
    away = np.where(valid, x - mean[group[order]], 0.0)
    return n, mean, np.add.reduceat(away * away, starts, axis=0)


def merge_moments(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments of two sets of rows taken together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    delta = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + delta * share, b[1])
    return n, mean, a[2] + b[2] + delta * delta * a[0] * share


def _groups_of(column: pa.Array) -> tuple[list, np.ndarray]:
    """The different values of a key column and each row's place among them."""
    coded = column.dictionary_encode()
    keys = coded.dictionary.to_pylist()
    at = coded.indices.fill_null(len(keys)).to_numpy(zero_copy_only=False).astype(np.int64)
    return ([*keys, None] if column.null_count else keys), at


def moments(df: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """(group, feature_idx, feature, n, mean, std), ``group`` only with ``by``:
    the moments of each feature among the rows of each value of ``by``."""
    features = list(features)
    key = [] if by is None else [StructField("group", df.select(col(by)).schema[0].dataType)]
    schema = StructType([*key, StructField("feature_idx", IntegerType()), StructField("feature", StringType()),
                         StructField("n", LongType()), StructField("mean", DoubleType()), StructField("m2", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        held: dict = {}

        def rows(k, at: int, m: tuple) -> pa.RecordBatch:
            width = len(m[0])
            out = [pa.array([k] * width, types.field(0).type)] if key else []
            out += [pa.array(np.arange(at, at + width, dtype=np.int32)), pa.array(features[at:at + width], types.field("feature").type),
                    *map(pa.array, m)]
            return pa.RecordBatch.from_arrays(out, names=types.names)

        for b in batches:
            if not b.num_rows:
                continue
            keys, group = _groups_of(b.column(0)) if key else ([None], np.zeros(b.num_rows, np.int64))
            columns = b.columns[len(key):]
            for at in range(0, len(columns), SLICE):
                part = columns[at:at + SLICE]
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part])
                valid = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part])
                m = batch_moments(x, valid, group, len(keys))
                for i, k in enumerate(keys):
                    mine = tuple(v[i] for v in m)
                    held[k, at] = merge_moments(held[k, at], mine) if (k, at) in held else mine
            if len(held) * SLICE > max(HELD_CELLS, 2 * len(columns)):
                yield from (rows(k, at, m) for (k, at), m in held.items())
                held = {}
        yield from (rows(k, at, m) for (k, at), m in held.items())

    cells = df.select(*[col(by).alias("group")] if key else [], *[col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    partial = cells.mapInArrow(run, schema)
    same = [*[f.name for f in key], "feature_idx", "feature"]
    w = Window.partitionBy(*same)  # one row a task and column
    total = F.nullif(F.sum("n").over(w), F.lit(0))
    about = partial.withColumn("center", F.sum(F.col("n") * F.col("mean")).over(w) / total)
    away = F.col("mean") - F.col("center")
    out = about.groupBy(*same).agg(F.sum("n").alias("n"), F.first("center").alias("mean"),
                                   F.sum(F.col("m2") + F.col("n") * away * away).alias("m2"))
    return out.select(*same, "n", "mean", F.sqrt(F.col("m2") / F.nullif(F.col("n"), F.lit(0))).alias("std"))
