"""Order-dependent results without a single-task window.

A window with ``orderBy`` but no (or a coarse) ``partitionBy`` runs in one
task. These helpers compute the same values from a range-partitioned
layout: each range partition is ordered locally, a per-partition total
table (partitions x keys rows) supplies the offsets.

The layout is written once and read back. Range bounds come from a sample of
the rows, so two evaluations of the same plan can place a row in different
partitions; totals and rows must see one and the same placement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize


def _range_layout(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None) -> DataFrame:
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *[F.col(c) for c in list(keys) + list(order)])
                       .withColumn("__pid", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                inclusive: bool = False, partitions: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before each row (within ``keys``, by
    ``order``; ``inclusive`` adds the row itself). Rows must be unique on
    (keys, order) for a well-defined order."""
    r = _range_layout(df, keys, order, partitions)
    upto = 0 if inclusive else -1
    wl = Window.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    r = r.withColumn("__local", F.coalesce(F.sum(value).over(wl), F.lit(0)))
    tot = r.groupBy("__pid", *keys).agg(F.sum(value).alias("__t"))
    wo = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("__pid", *keys, F.coalesce(F.sum("__t").over(wo), F.lit(0)).alias("__off"))
    return r.join(off, ["__pid", *keys]) \
        .withColumn(out, F.col("__off") + F.col("__local")).drop("__pid", "__local", "__off")


def row_index(df: DataFrame, order: Sequence[str], out: str = "idx", keys: Sequence[str] = (),
              partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (within ``keys``)."""
    return running_sum(df.withColumn("__one", F.lit(1)), keys, order, "__one", out, False, partitions).drop("__one")
