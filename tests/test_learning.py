import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from checks.views import milestone_events
from tracewing.operators import importance, learning
from tracewing.plans import flows

SF = "/root/testdata/sf0.001"
KEYS, TIES = ["event_id"], ("event_id",)


@pytest.fixture(scope="module")
def events(spark):
    return milestone_events(spark, SF)


@pytest.fixture(scope="module")
def fitted(events):
    return flows.train_irregularity(events, KEYS, learning.boosted_classifier(), TIES)


def test_metrics_per_split(fitted, events):
    rows = {r.train_test_split: r for r in fitted.metrics.collect()}
    assert set(rows) == {"train", "test", "val"}
    assert sum(r.example_count for r in rows.values()) == events.count()
    assert all(0 <= r.accuracy_score <= 1 and r.roc_auc is not None for r in rows.values())


def test_scores_stay_with_their_rows(fitted, events, tmp_path):
    path = str(tmp_path / "model")
    learning.save_model(fitted.model, path)
    scored = flows.score_irregularity(events, learning.load_model(path), TIES)
    assert scored.columns == [*events.columns, "irregProbability"]
    assert scored.drop("irregProbability").exceptAll(events).isEmpty() and scored.count() == events.count()
    low, high = scored.agg(F.min("irregProbability"), F.max("irregProbability")).first()
    assert 0 <= low < high <= 1


def test_unseen_categories_and_missing_numbers_are_scored(fitted, events):
    odd = events.limit(20).withColumns({"commodity": F.lit("never seen"), "product_code": F.lit(None).cast("string"), "wgt_chargeable": F.lit(None).cast("double")})
    scores = flows.score_irregularity(odd, fitted.model, TIES).select("irregProbability").collect()
    assert len(scores) == 20 and all(s[0] is not None for s in scores)


def test_feature_vector(events):
    rows = flows.irregularity_training_rows(events, KEYS, TIES)
    train = rows.where("train_test_split = 'train'")
    out = PipelineModel(learning.fit_features(train, learning.IRREGULARITY)).transform(rows)
    assert out.columns == [*rows.columns, "features"]
    width = len(out.first().features)
    seen = train.agg(*[F.count_distinct(c).alias(c) for c in learning.IRREGULARITY.categories]).first()
    assert width == 1 + 3 + sum(n + 1 for n in seen)


def test_regressor_and_forest_of_one(events):
    delivery = flows.train_delivery(events, KEYS, learning.boosted_regressor(5), TIES)
    assert "r2_score" in delivery.metrics.columns and delivery.metrics.count() == 3
    tree = flows.train_irregularity(events, KEYS, learning.decision_tree(), TIES)
    assert tree.model.stages[-1].getNumTrees == 1
    logistic = flows.train_irregularity(events, KEYS, learning.logistic_regression, TIES)
    assert logistic.metrics.count() == 3


def test_tuning_keeps_the_largest_metric(events):
    rows = flows.irregularity_training_rows(events, KEYS, TIES).persist()
    best, table = learning.tune(rows, learning.IRREGULARITY, [learning.decision_tree(), learning.boosted_classifier()], "roc_auc")
    val = {r.candidate: r.roc_auc for r in table.where("train_test_split = 'val'").collect()}
    assert best.metrics.where("train_test_split = 'val'").first().roc_auc == max(val.values())


def test_permuted_column_is_a_permutation(events):
    rows = events.select("event_id", "wgt_chargeable", "awbNo")
    got = importance.permute_column(rows, "wgt_chargeable", KEYS, 1)
    assert got.columns == rows.columns and got.drop("wgt_chargeable").exceptAll(rows.drop("wgt_chargeable")).isEmpty()
    assert got.select("wgt_chargeable").exceptAll(rows.select("wgt_chargeable")).isEmpty()
    assert got.exceptAll(rows).count() > rows.count() / 2


def test_importances(fitted, events):
    rows = flows.irregularity_training_rows(events, KEYS, TIES)
    table = learning.feature_importance(fitted.model, rows)
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert table.where("name = '_flag_statusBinary'").count() == 1


def test_permutation_importance_is_one_scoring_job(spark, fitted, events):
    rows = flows.irregularity_training_rows(events, KEYS, TIES).where("train_test_split = 'test'")
    rows = rows.withColumn("label", F.col("statusTarget").cast("double"))
    inputs = learning.IRREGULARITY
    columns = [*inputs.numeric, *inputs.categories, *inputs.flags]
    accuracy = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    tracker, group = spark.sparkContext.statusTracker(), "importance-jobs"
    spark.sparkContext.setJobGroup(group, "importance")
    try:
        few = importance.permutation_importance(fitted.model, rows, columns[:2], KEYS, accuracy)
        jobs_of_two = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup(group + "-all", "importance")
        table = importance.permutation_importance(fitted.model, rows, columns, KEYS, accuracy)
        jobs_of_all = len(tracker.getJobIdsForGroup(group + "-all"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the number of jobs does not depend on the number of columns
    assert jobs_of_all <= jobs_of_two + 2
    found = {r.column: r for r in table.collect()}
    assert set(found) == set(columns) and few.count() == 2
    want = accuracy_of(fitted.model.transform(rows))
    assert all(r.baseline == pytest.approx(want) and r.drop == pytest.approx(r.baseline - r.value) for r in found.values())
    # the same permutation as for a single column
    one = fitted.model.transform(importance.permute_column(rows, "eventCode", KEYS, 42))
    assert found["eventCode"].value == pytest.approx(accuracy_of(one))


def accuracy_of(scored):
    return scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


def test_a_wrong_coefficient_is_told(spark, events):
    rows = flows.irregularity_training_rows(events, KEYS, TIES)
    model = learning.train(rows, learning.IRREGULARITY, learning.logistic_regression).model
    train = learning.prepared_rows(model, rows.where("train_test_split = 'train'"), learning.IRREGULARITY)
    assert learning.gradient_bounds(model, train).where("not within").isEmpty()
    # the bounds do not hold on other rows than those of the fit
    other = train.where("label = 0").limit(50).unionByName(train.where("label = 1").limit(50))
    assert not learning.gradient_bounds(model, other).where("not within").isEmpty()


def test_leaves_of_other_rows_do_not_match(events):
    rows = flows.irregularity_training_rows(events, KEYS, TIES)
    model = learning.train(rows, learning.IRREGULARITY, learning.decision_tree()).model
    for split, same in (("train", True), ("test", False)):
        prepared = learning.prepared_rows(model, rows.where(F.col("train_test_split") == split), learning.IRREGULARITY)
        leaves = learning.leaf_shares(model, prepared).collect()
        assert all(abs(r.share - r.low) < 1e-9 for r in leaves) == same


def test_features_without_looking_ahead(events):
    ahead = flows.irregularity_training_rows(events, KEYS, TIES)
    behind = flows.irregularity_training_rows(events, KEYS, TIES, look_ahead=False)
    assert ahead.columns == behind.columns
    a = {r.event_id: r.eventDate_diff_hours for r in ahead.collect()}
    b = {r.event_id: r.eventDate_diff_hours for r in behind.collect()}
    assert a.keys() == b.keys() and a != b
    assert sum(a.values()) == pytest.approx(sum(b.values()))  # every step is seen from both ends
    model = flows.train_irregularity(events, KEYS, learning.decision_tree(), TIES, look_ahead=False).model
    assert flows.score_irregularity(events, model, TIES, look_ahead=False).count() == events.count()


def test_leaf_shares_are_met_without_a_row_for_each_tree(spark, events, tmp_path):
    rows = flows.irregularity_training_rows(events, ["event_id"], ["event_id"])
    model = learning.train(rows, learning.IRREGULARITY, learning.random_forest(3)).model
    learning.save_model(model, str(tmp_path / "forest"))
    prepared = learning.prepared_rows(model, rows.limit(50), learning.IRREGULARITY, ["event_id"])
    found = learning.regrouped_probabilities(model, prepared, learning.saved_leaves(spark, str(tmp_path / "forest")), ["event_id"])
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert len(got) == 50 and all(r.trees == 3 and abs(r.probability - r.mean_share) < 1e-9 for r in got)


def test_a_forest_is_fitted_on_what_it_can_split(spark, tmp_path):
    """Positions rarer than the smallest leaf are left out of the fit; the model still scores all rows and loads as saved."""
    n = F.col("id")
    rows = spark.range(4_000).select(
        (n % 7 == 0).cast("int").alias("statusBinary"), (n % 5).cast("double").alias("total_no_of_pieces"),
        (n % 11).cast("double").alias("eventDate_diff_hours"), (n % 13).cast("double").alias("wgt_chargeable"),
        *[F.concat(F.lit("P"), (n % 50).cast("string")).alias(c) for c in ("arrivalLocation", "departureLocation")],
        *[F.concat(F.lit("C"), (n % 3).cast("string")).alias(c) for c in learning.IRREGULARITY.categories if "Location" not in c],
        F.when((n % 3 == 1) | (n % 5 == 0), 1).otherwise(0).alias("statusTarget"),
        F.when(n % 10 < 7, "train").when(n % 10 < 9, "test").otherwise("val").alias("train_test_split"),
    )
    fitted = learning.train(rows, learning.IRREGULARITY, learning.random_forest(5))
    full = PipelineModel(learning.fit_features(rows.where("train_test_split = 'train'"), learning.IRREGULARITY)).transform(rows)
    names = learning.slot_names(fitted.model, rows).values()
    assert not [x for x in names if "Location_P" in x or "unknown" in x]
    assert sorted(names) == sorted([
        "statusBinary", *learning.IRREGULARITY.numeric,
        *[f"{c}_C{i}" for c in learning.IRREGULARITY.categories if "Location" not in c for i in range(3)],
    ])
    assert fitted.model.stages[-1].numFeatures == len(names) < len(full.first().features)
    assert sum(r.example_count for r in fitted.metrics.collect()) == 4_000
    # no tree of a forest on all positions splits on one that was left out
    whole = learning.random_forest(20).fit(learning._labelled(full, learning.IRREGULARITY, "train_test_split").where("train_test_split = 'train'"))
    attrs = full.schema["features"].metadata["ml_attr"]["attrs"]
    out = [a["idx"] for a in attrs["binary"] if "Location_P" in a["name"] or "unknown" in a["name"]]
    assert out and all(whole.featureImportances[i] == 0 for i in out)
    learning.save_model(fitted.model, str(tmp_path / "forest"))
    again = learning.load_model(str(tmp_path / "forest"))
    want, got = ([r.probability[1] for r in m.transform(rows).select("probability").collect()] for m in (fitted.model, again))
    assert want == got and len(got) == 4_000
    # one tree without resampling keeps its positions
    tree = learning.train(rows, learning.IRREGULARITY, learning.decision_tree()).model
    assert tree.stages[-1].numFeatures == len(full.first().features)
