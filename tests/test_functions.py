import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalar as S

NAN = float("nan")


def values(df, column):
    return [list(r) if isinstance(r := x[0], list) else r for x in df.select(column).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate([None, NAN, -1.0, 0.0, 0.5])], "i int, x double").orderBy("i")


def test_binarize_rules(numbers):
    assert values(numbers, S.positive(F.col("x"))) == [0, 0, 0, 0, 1]
    assert values(numbers, S.nonzero(F.col("x"))) == [0, 0, 1, 0, 1]
    assert values(numbers, S.on_off(F.col("x"))) == ["off", "off", "off", "off", "on"]
    assert values(numbers, S.on_off_zero(F.col("x"))) == ["on", "on", "on", "off", "on"]


def test_labels_differ_on_negative_values(spark):
    df = spark.createDataFrame([(-1.0, 0.0, None), (0.0, 0.0, NAN), (0.0, 2.0, 0.0)], "a double, b double, c double")
    stages = ["a", "b", "c"]
    assert values(df, S.any_nonzero(stages)) == [1, 0, 1]
    assert values(df, S.any_positive(stages)) == [0, 0, 1]
    assert values(df, S.none_nonzero(stages)) == [0, 1, 0]


def test_binarize_guards_types(spark):
    df = spark.createDataFrame([(1, "x", 3.0), (2, None, NAN)], "id int, `odd.name` string, v double")
    assert [tuple(r) for r in S.binarize(df, ["id"]).orderBy("id").collect()] == [(1, 0, 1), (2, 0, 0)]


def test_text_features(spark):
    df = spark.createDataFrame([(1, "a.bb.com/x?y"), (2, ""), (3, None)], "i int, t string").orderBy("i")
    assert values(df, S.text_length(F.col("t"))) == [12, 0, 3]
    assert values(df, S.distinct_characters(F.col("t"))) == [len(set("a.bb.com/x?y")), 0, 2]
    assert values(df, S.last_token(F.col("t"))) == ["com/x?y", "", None]
    assert values(df.limit(1), S.uri_tokens(F.col("t"))) == [["a.bb.com", "x", "y"]]
    assert values(df.limit(1), S.character_codes(F.lit("bax"), "ab")) == [[1, 0, -1]]
    assert values(df.limit(1), S.pad_text(F.lit("ab"), 4)) == ["ab  "]
    assert values(df.limit(1), S.pad_array(F.array(F.lit(1.0)), 3)) == [[1.0, 0.0, 0.0]]


def test_array_features(spark):
    df = spark.createDataFrame([(1, "[1, 2, 6]"), (2, "[]"), (3, "no"), (4, None)], "i int, t string").orderBy("i")
    assert values(df, S.array_length(F.col("t"))) == [3, 0, 0, 0]
    assert values(df, S.array_mean(F.col("t"))) == [3.0, 0.0, 0.0, 0.0]


def test_remap_and_labels(spark):
    df = spark.createDataFrame([(0, "BENIGN"), (1, "DoS"), (2, None)], "c int, l string").orderBy("c")
    assert values(df, S.remap(F.col("c"), {0: 1, 1: 0})) == [1, 0, None]
    assert values(df, S.equals_label(F.col("l"), "BENIGN", 0)) == [0, 1, 1]
    assert values(df, S.ratio(F.col("c"), F.col("c") - 1)) == [0.0, 0.0, 2.0]


def test_columns_and_reports(spark):
    df = spark.createDataFrame([(1, "1", "x", 1.0), (2, "b", "y", NAN), (3, "3", "z", math.inf)], "id int, mixed string, plain string, v double")
    assert S.drop_mixed(df, ["mixed", "plain"]).columns == ["id", "plain", "v"]
    assert S.other_columns(df, ["id"]) == ["mixed", "plain", "v"]
    assert S.sliced_columns(df, 1, -1).columns == ["mixed", "plain"]
    assert S.numeric_columns(df) == ["id", "v"]
    assert [tuple(r) for r in S.missing_report(df, ["v"]).collect()] == [("v", 0, 1, 1)]
    codes = S.first_seen_codes(df.unionByName(df), "plain", "id")
    assert {r.plain: r.code for r in codes.collect()} == {"x": 0, "y": 1, "z": 2}
    assert values(df.withColumn("d", S.last_column_label(df)).orderBy("id"), "d") == [1, 1, 1]
