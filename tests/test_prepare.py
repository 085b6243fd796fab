import math

from pyspark.sql import functions as F
from pyspark.sql.functions import col, lit

from faultline.functions import columns as C
from faultline.operators import prepare as P
from faultline.plans import prepare as X


def test_exclude_value_keeps_nulls(spark):
    df = spark.createDataFrame([("1.0.0", 1), ("1.1.0", 2), (None, 3)], "v string, x int")
    out = sorted(r.x for r in P.exclude_value(df, "v", "1.0.0").collect())
    assert out == [2, 3]


def test_drop_missing_and_all_missing_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, None), (float("nan"), "b")],
                               "x double, s string")
    assert P.drop_all_missing(df).count() == 2
    assert P.drop_missing(df, ["x"]).count() == 1
    assert P.drop_missing(df, ["absent"]).count() == 4


def test_join_null_keys_match_like_pandas(spark):
    l = spark.createDataFrame([(None, "f", 1), ("1", "f", 2)], "v string, file string, a int")
    r = spark.createDataFrame([(None, "f", 10), ("1", "f", 20)], "v string, file string, b int")
    strict = P.join_on(l, r, ["v", "file"], how="inner").collect()
    nullsafe = P.join_on(l, r, ["v", "file"], how="inner", null_keys=True).collect()
    assert len(strict) == 1 and len(nullsafe) == 2


def test_join_keeps_both_columns_of_a_name(spark):
    l = spark.createDataFrame([("1", "a", 1.0)], "k string, x string, `odd.name` double")
    r = spark.createDataFrame([("1", "b", 2.0, 3)], "k string, x string, `odd.name` double, z int")
    out = P.join_on(l, r, ["k"])
    assert out.columns == ["k", "x_x", "odd.name_x", "x_y", "odd.name_y", "z"]
    assert tuple(out.first()) == ("1", "a", 1.0, "b", 2.0, 3)
    own = P.join_on(l, r.withColumnRenamed("k", "key"), ["k"], ["key"], how="left", suffixes=("", "_right"))
    assert own.columns == ["k", "x", "odd.name", "x_right", "odd.name_right", "z"]
    key = P.join_on(l, r.select(col("k").alias("key"), col("x").alias("k")), ["k"], ["key"])
    assert key.columns == ["k", "x", "odd.name", "k_y"]  # the left key keeps its name
    outer = P.join_on(l, r.withColumn("k", lit("2")), ["k"], how="full").orderBy("k")
    assert [tuple(x) for x in outer.collect()] == [("1", "a", 1.0, None, None, None), ("2", None, None, "b", 2.0, 3)]


def test_join_left_renamed_keys_and_duplicates_multiply(spark):
    l = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "ver string, file string, x int")
    r = spark.createDataFrame([("1", "a", 5), ("1", "a", 6)], "version string, file string, y int")
    out = P.join_on(l, r, ["ver", "file"], ["version", "file"], how="left")
    assert out.columns == ["ver", "file", "x", "y"]
    rows = sorted((r.ver, r.y) for r in out.collect())
    assert rows == [("1", 5), ("1", 6), ("2", None)]


def test_union_by_name_fills_missing(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, p double")
    b = spark.createDataFrame([(2, 3.0)], "id int, q double")
    rows = sorted(P.union_by_name([a, b]).collect(), key=lambda r: r.id)
    assert rows[0].q is None and rows[1].p is None


def test_unmatched_count(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan"))], "id int, c double")
    r = P.unmatched_count(df, "c").first()
    assert (r.unmatched, r.rows) == (2, 3)


def test_feature_columns_rules(spark):
    df = spark.createDataFrame([(1, "1.1", 2, 3.0, 4, 5, True)],
                               "ID int, version string, `Version-ID` int, SM_a double, Bug int, x long, flag boolean")
    assert C.feature_columns(df, "Bug") == ["SM_a", "x"]


def test_binarize_and_impute(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    r = df.select(C.binarize("v").alias("b"), C.impute(F.col("v")).alias("i")).collect()
    assert [x.b for x in r] == [0, 1, 0, 0, 1, 0]
    assert [x.i for x in r] == [0.0, 2.0, 0.0, 0.0, C.MAX_DOUBLE, -C.MAX_DOUBLE]


def test_category_and_cluster_name(spark):
    df = spark.createDataFrame([("PMD_x",), ("COV_LINE",), ("SM_a",), ("CHANGE_TYPE_data",), ("foo",)], "f string")
    cats = [r.c for r in df.select(C.feature_category(F.col("f")).alias("c")).collect()]
    assert cats == ["PMD", "OTHER", "SM", "CHANGE_TYPE", "OTHER"]
    n = spark.createDataFrame([(-1,), (3,)], "c int").select(C.cluster_name(F.col("c")).alias("n")).collect()
    assert [r.n for r in n] == ["noise", "cluster_3"]


def test_project_family_strict_and_tolerant(spark):
    df = spark.createDataFrame([(1, "f", 2.0, 3.0)], "id int, file string, SM_a double, COV_b double")
    assert X.extract_family(df, ["id", "file", "Bug"], "SM_").columns == ["id", "file", "SM_a"]
    try:
        C.project_family(df, ["Bug"], "SM_", strict=True)
        raise AssertionError("expected KeyError")
    except KeyError:
        pass


def test_run_action_unknown(spark):
    try:
        X.run_action("nope")
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "create-combined" in str(e)


def test_merge_coverage_drops_first_and_null_versions(spark):
    m = spark.createDataFrame([("1.0.0", "a", 1), ("1.1.0", "a", 0), (None, "a", 1), ("1.1.0", "b", 1)],
                              "version string, file string, Bug int")
    cov = spark.createDataFrame([("1.1.0", "a", 0.5, 0.1, 0.2, 0.3, 0.4)],
                                "version string, filename string, COV_INSTRUCTION double, COV_BRANCH double, "
                                "COV_LINE double, COV_COMPLEXITY double, COV_METHOD double")
    out = X.merge_coverage(m, cov, first_version="1.0.0")
    rows = sorted((r.file, r.COV_INSTRUCTION) for r in out.collect())
    assert rows == [("a", 0.5), ("b", None)]
    assert not math.isnan(P.unmatched_count(out, "COV_INSTRUCTION").first().unmatched)


def test_null_key_join_takes_every_part(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    out = E.queries()["join_null_keys_all"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/part.parquet").count()
    assert out.filter("file is null and n > 1").count() > 0
