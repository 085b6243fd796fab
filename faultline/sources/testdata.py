"""Stand-in feature tables derived from the TPC-H-like test tables.

The reference ships no input data, so every registered query builds its
input from ``sf_dir`` with these functions. They are plain DataFrame plans
(scan -> aggregate -> join) whose work grows with the tables; the DuckDB
oracle rebuilds the same tables as CTEs (``faultline.plans.oracle``).

Float features are rounded to 6 decimals at creation, so Spark and DuckDB
start every downstream computation from identical numbers.

Fixtures (grain -> meaning):
  unit      one row per part: six metrics + a bug count, group = brand
  sm        one row per (version=ship year, file=part): SM_* metrics + Bug
  coverage  one row per (version, filename) with >= 2 lines: five COV_* ratios
  effort    one row per version_id with >= 20 units shipped: six effort metrics
  part2     one row per part: z-scored size and price (2-D points)
  scores    one row per order: label, score with many ties, hard prediction
  emb       one row per embedding vector: 64-d array + label
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _r6(c):
    return F.round(c, 6)


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part (part LEFT JOIN lineitem aggregates)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("qty_avg"),
        F.stddev_pop("l_quantity").alias("qty_std"),
        F.count(F.lit(1)).alias("n_lines"),
        F.avg("l_discount").alias("disc_avg"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_r"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    j = part.join(li, part.p_partkey == li.l_partkey, "left")
    return j.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_brand").alias("grp"),
        F.col("p_size").cast("double").alias("SM_size"),
        F.col("p_retailprice").alias("SM_price"),
        _r6(F.col("qty_avg")).alias("SM_qty_avg"),
        _r6(F.col("qty_std")).alias("SM_qty_std"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("double").alias("PMD_lines"),
        _r6(F.col("disc_avg") * 100).alias("MOSER_disc_avg"),
        F.when(F.col("n_r") / F.col("n_lines") > 0.45, F.col("n_r")).otherwise(F.lit(0)).cast("bigint").alias("Bug"),
    )


UNIT_FEATURES = ["SM_size", "SM_price", "SM_qty_avg", "SM_qty_std", "PMD_lines", "MOSER_disc_avg"]
SM_METADATA = ["version", "id", "file", "version_id", "Bug"]
SM_FEATURES = ["SM_qty_sum", "SM_price_avg", "SM_disc_avg", "SM_tax_avg", "SM_lines", "SM_size"]
EFFORT_FIXTURE = [
    "HASSAN_hcm", "MOSER_revisions", "PMD_severity_major", "CHANGE_TYPE_data",
    "ISSUE_major_bug", "PMD_rule_type_basic rules",
]
# The oldest version plays the reference's "1.0.0" (no coverage collected).
FIRST_VERSION = "1995"


_MEASURES = {
    "n_lines": lambda: F.count(F.lit(1)),
    "qty_sum": lambda: F.sum("l_quantity"),
    "price_avg": lambda: F.avg("l_extendedprice"),
    "disc_avg": lambda: F.avg("l_discount"),
    "tax_avg": lambda: F.avg("l_tax"),
    "bug": lambda: F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.095), 1).otherwise(0)),
    "ci": lambda: F.avg(F.sqrt("l_quantity")),
    "cb": lambda: F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)),
    "cc": lambda: F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)),
    "cm": lambda: F.avg("l_quantity"),
    "hcm": lambda: F.count_distinct("l_suppkey"),
    # months as bits: a second distinct count would expand lineitem threefold
    "rev": lambda: F.coalesce(F.bit_count(F.bit_or(F.expr("shiftleft(1, month(l_shipdate))"))), F.lit(0)),
    "major": lambda: F.sum(F.when(F.col("l_quantity") > 40, 1).otherwise(0)),
    "price_sqrt": lambda: F.avg(F.sqrt("l_extendedprice")),
    "abug": lambda: F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)),
    "maxdisc": lambda: F.max("l_discount"),
}
_NEEDS = {
    "sm": ["n_lines", "qty_sum", "price_avg", "disc_avg", "tax_avg", "bug"],
    "coverage": ["n_lines", "ci", "cb", "tax_avg", "cc", "cm"],
    "effort": ["qty_sum", "hcm", "rev", "major", "price_sqrt", "abug", "maxdisc"],
}


def part_year(spark: SparkSession, sf_dir: str, parts=("sm", "coverage", "effort")) -> DataFrame:
    """The (part, ship year) measures the requested stand-ins need, from ONE
    scan and ONE shuffle of lineitem. sm / coverage / effort are projections
    of this aggregate; a caller that needs several of them materialises it
    once instead of aggregating lineitem several times. Only the measures of
    the requested ``parts`` are computed (the distinct counts only for effort)."""
    names = list(dict.fromkeys(m for p in parts for m in _NEEDS[p]))
    li = table(spark, sf_dir, "lineitem").withColumn("yr", F.year("l_shipdate"))
    return li.groupBy("l_partkey", "yr").agg(*[_MEASURES[m]().alias(m) for m in names])


def sm(spark: SparkSession, sf_dir: str, py: DataFrame | None = None) -> DataFrame:
    """One row per (ship year, part). Version is missing for size-50 parts,
    SM_tax_avg is missing for PROMO parts (null rules need real nulls)."""
    g = py if py is not None else part_year(spark, sf_dir, ("sm",))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    j = g.join(part, g.l_partkey == part.p_partkey, "inner")
    yr = F.col("yr").cast("string")
    return j.select(
        F.when(F.col("p_size") == 50, F.lit(None).cast("string")).otherwise(yr).alias("version"),
        F.col("l_partkey").alias("id"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("file"),
        F.concat(yr, F.lit("-"), F.col("l_partkey").cast("string")).alias("version_id"),
        F.col("bug").cast("bigint").alias("Bug"),
        F.col("qty_sum").alias("SM_qty_sum"),
        _r6(F.col("price_avg")).alias("SM_price_avg"),
        _r6(F.col("disc_avg")).alias("SM_disc_avg"),
        F.when(F.col("p_type") == "PROMO", F.lit(None).cast("double")).otherwise(_r6(F.col("tax_avg"))).alias("SM_tax_avg"),
        F.col("n_lines").cast("double").alias("SM_lines"),
        F.col("p_size").cast("double").alias("SM_size"),
    )


def coverage(spark: SparkSession, sf_dir: str, py: DataFrame | None = None) -> DataFrame:
    """One row per (version, filename); coverage exists only for >= 2 lines."""
    g = py if py is not None else part_year(spark, sf_dir, ("coverage",))
    return g.filter(F.col("n_lines") >= 2).select(
        F.col("yr").cast("string").alias("version"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("filename"),
        _r6(F.col("ci") / 10).alias("COV_INSTRUCTION"),
        _r6(F.col("cb")).alias("COV_BRANCH"),
        _r6(F.col("tax_avg") * 10).alias("COV_LINE"),
        _r6(F.col("cc")).alias("COV_COMPLEXITY"),
        _r6(F.col("cm") / 50).alias("COV_METHOD"),
    )


def effort(spark: SparkSession, sf_dir: str, py: DataFrame | None = None) -> DataFrame:
    """One row per version_id; effort exists only when >= 20 units shipped."""
    g = py if py is not None else part_year(spark, sf_dir, ("effort",))
    return g.filter(F.col("qty_sum") >= 20).select(
        F.concat(F.col("yr").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("version_id"),
        F.col("hcm").cast("double").alias("HASSAN_hcm"),
        F.col("rev").cast("double").alias("MOSER_revisions"),
        F.col("major").cast("double").alias("PMD_severity_major"),
        _r6(F.col("price_sqrt")).alias("CHANGE_TYPE_data"),
        F.col("abug").cast("double").alias("ISSUE_major_bug"),
        _r6(F.col("maxdisc") * 100).alias("PMD_rule_type_basic rules"),
    )


def part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: population-z-scored size and price, rounded to 6 dp."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    st = p.agg(
        F.avg("p_size").alias("ms"), F.stddev_pop("p_size").alias("ss"),
        F.avg("p_retailprice").alias("mp"), F.stddev_pop("p_retailprice").alias("sp"),
    )
    # one-row statistics enter as scalar subqueries (no join at all)
    ms, ss, mp, sp = (st.select(c).scalar() for c in ("ms", "ss", "mp", "sp"))
    return p.select(
        F.col("p_partkey").alias("row_id"),
        _r6((F.col("p_size") - ms) / ss).alias("x0"),
        _r6((F.col("p_retailprice") - mp) / sp).alias("x1"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: y = urgent and finished, score with many ties."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).cast("int").alias("y"),
        F.round(F.col("o_totalprice") / 500000.0, 2).alias("score"),
    ).withColumn("pred", (F.col("score") > 0.5).cast("int"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        F.col("label").cast("int").alias("label"),
    )
