import math

import pytest
from pyspark.sql import functions as F

from tracewing.operators import metrics, scaling, stats


def scored(spark, rows):
    rows = [(g, float(y), float(said), p) for g, y, said, p in rows]
    return spark.createDataFrame(rows, "split string, label double, prediction double, p double")


def test_classification_by_hand(spark):
    df = scored(spark, [("a", 1, 1, 0.9), ("a", 1, 0, 0.4), ("a", 0, 1, 0.6), ("a", 0, 0, 0.2), ("b", 0, 0, 0.0)])
    by = {r.split: r for r in metrics.classification_metrics(df, ["split"], probability="p").collect()}
    a, b = by["a"], by["b"]
    assert (a.true_positives, a.false_positives, a.false_negatives, a.true_negatives) == (1, 1, 1, 1)
    assert (a.accuracy_score, a.precision_score, a.recall_score, a.f1_score) == (0.5, 0.5, 0.5, 0.5)
    assert a.log_loss == pytest.approx(-sum(map(math.log, (0.9, 0.4, 0.4, 0.8))) / 4)
    assert (b.precision_score, b.recall_score, b.f1_score, b.accuracy_score) == (0, 0, 0, 1)


def test_areas_with_ties_and_one_class(spark):
    rows = [("a", y, 0, s) for y, s in [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.3), (1, 0.3), (0, 0.1)]]
    rows += [("b", 1, 0, 0.5), ("b", 1, 0, 0.6)]
    by = {r.split: r for r in metrics.ranking_metrics(scored(spark, rows), ["split"], probability="p").collect()}
    pairs = [(p, n) for y, p in [(1, 0.9), (1, 0.7), (1, 0.3)] for n in (0.9, 0.3, 0.1)]
    assert by["a"].roc_auc == pytest.approx(sum((p > n) + (p == n) / 2 for p, n in pairs) / 9)
    # precision at thresholds .9, .7, .3: 1/2, 2/3, 3/5
    assert by["a"].precision_recall_auc == pytest.approx(((1 + 1 / 2) / 2 + (1 / 2 + 2 / 3) / 2 + (2 / 3 + 3 / 5) / 2) / 3)
    assert by["b"].roc_auc is None and by["b"].precision_recall_auc == 1.0


def test_regression_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", 5.0, 2.0), ("a", None, 2.0)], "split string, label double, prediction double")
    r = metrics.regression_metrics(df, ["split"]).first()
    assert (r.example_count, r.max_error, r.sum_on_target, r.mean_on_target) == (3, 3.0, 9.0, 3.0)
    assert r.mean_absolute_error == pytest.approx(4 / 3)
    assert r.root_mean_squared_error == pytest.approx(math.sqrt(10 / 3))
    assert r.r2_score == pytest.approx(1 - 10 / 8)


def test_scales(spark):
    df = spark.createDataFrame([("1", "5", None), ("2", "5", None), ("x", "5", None), ("4.5", "5", None)], "a string, b string, c string")
    a, b, c = scaling.learn_scales(df, ["a", "b", "c"])
    values = [1, 2, 2.5, 4.5]  # the unreadable one becomes the mean
    assert a.mean == pytest.approx(2.5)
    assert a.deviation == pytest.approx(math.sqrt(sum((v - 2.5) ** 2 for v in values) / 4))
    assert (b.mean, b.deviation, c.mean, c.deviation) == (5.0, 1.0, 0.0, 1.0)
    assert [r.a for r in scaling.standardize(df, [a]).collect()][2] == 0.0
    assert df.select(F.expr(a.scaled_sql()).alias("s")).collect()[2].s == 0.0


def test_split_is_stable_and_near_its_shares(spark):
    df = spark.range(10_000)
    a = stats.hash_split(df, ["id"])
    b = stats.hash_split(df.repartition(7), ["id"])
    assert a.exceptAll(b).isEmpty()
    n = {r.train_test_split: r["count"] for r in a.groupBy("train_test_split").count().collect()}
    assert abs(n["train"] - 7000) < 200 and abs(n["test"] - 2000) < 200 and abs(n["val"] - 1000) < 200


def test_mode_prefers_the_smaller_of_equals(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 2), (None, 3)], "x string, y int")
    assert {r["column"]: (r["mode"], r.n) for r in stats.column_mode(df, ["x", "y"]).collect()} == {"x": ("a", 1), "y": ("1", 2)}


def test_sample_is_repeatable(spark):
    a = stats.seeded_sample(spark.range(500), ["id"], 20, 1)
    b = stats.seeded_sample(spark.range(500).repartition(5), ["id"], 20, 1)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 20
    assert sorted(a.collect()) != sorted(stats.seeded_sample(spark.range(500), ["id"], 20, 2).collect())


def test_common_category(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "common").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("c"))
    known = rows.where("id < 200")
    got = scaling.one_hot_rows(rows, known, ["c"], "id").collect()
    assert len(got) == rows.count()
    assert sum(r.known for r in got) == sum(1 for r in got if r.value == "common" or (r.value and r.id < 200))
