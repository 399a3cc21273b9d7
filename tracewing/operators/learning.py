"""Feature assembly and estimators of Spark ML, with the settings of both flows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from . import features as feat
from .metrics import classification_metrics, ranking_metrics, regression_metrics
from .scaling import learn_scales

FEATURES, LABEL = "features", "label"
TRAIN, TEST, VAL = "train", "test", "val"
INTERNAL = (FEATURES, LABEL, "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Inputs:
    """Which columns a model reads and what it predicts."""

    numeric: Sequence[str]
    categories: Sequence[str]
    target: str
    flags: Sequence[str] = ()


IRREGULARITY = Inputs(
    feat.IRREGULARITY_NUMERIC, feat.IRREGULARITY_CATEGORIES, feat.IRREGULARITY_TARGET, (feat.IRREGULARITY_FLAG,)
)
DELIVERY = Inputs(feat.DELIVERY_NUMERIC, feat.DELIVERY_CATEGORIES, feat.DELIVERY_TARGET)


def fit_features(train: DataFrame, inputs: Inputs) -> list[Transformer]:
    """Stages that add the ``features`` vector, learned from the training rows alone.

    Numbers: mean where missing, then standardised with the population
    deviation.  Categories: one-hot, with one more position for values not seen
    in training.  Flags pass as 0/1.  The working columns go once assembled.
    """
    scaled = {f"_num_{s.name}": s.scaled_sql() for s in learn_scales(train, inputs.numeric)}
    flags = {f"_flag_{c}": f"coalesce(try_cast(`{c}` as double), 0D)" for c in inputs.flags}
    texts = {f"_cat_{c}": f"cast(`{c}` as string)" for c in inputs.categories}
    made = {**scaled, **flags, **texts}
    project = SQLTransformer(
        statement="SELECT *, " + ", ".join(f"{sql} AS `{name}`" for name, sql in made.items()) + " FROM __THIS__"
    )
    indexed, hot = [f"_idx_{c}" for c in inputs.categories], [f"_hot_{c}" for c in inputs.categories]
    prepared = project.transform(train)
    indexer = StringIndexer(
        inputCols=list(texts), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
    ).fit(prepared)
    encoder = OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False).fit(indexer.transform(prepared))
    assembler = VectorAssembler(inputCols=[*flags, *scaled, *hot], outputCol=FEATURES)
    working = ", ".join(f"`{c}`" for c in [*made, *indexed, *hot])
    tidy = SQLTransformer(statement=f"SELECT * EXCEPT ({working}) FROM __THIS__")
    return [project, indexer, encoder, assembler, tidy]


# The settings that the flows fit with.  ``max_features`` becomes
# featureSubsetStrategy, ``min_samples_leaf`` minWeightFractionPerNode and
# ``min_child_weight`` minInstancesPerNode.
TREE_SEED = 143861876
DELIVERY_SEED = 839458751


def decision_tree() -> Estimator:
    """One tree with a feature subset per split, which Spark offers as a forest of one without resampling."""
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=1, bootstrap=False, impurity="entropy", maxDepth=8,
        featureSubsetStrategy="0.7962628514833345", minWeightFractionPerNode=0.14658322735586096, seed=TREE_SEED,
    )


def random_forest(trees: int = 252) -> Estimator:
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, bootstrap=True, impurity="gini", maxDepth=9,
        featureSubsetStrategy="0.5077602759357688", minWeightFractionPerNode=0.12336498657198877, seed=TREE_SEED,
    )


def logistic_regression(train_rows: int) -> Estimator:
    """Elastic net; the inverse strength 0.0227 refers to a summed loss, Spark's penalty to a mean one."""
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, regParam=1.0 / (0.02266778809311503 * max(train_rows, 1)),
        elasticNetParam=0.9941203224190954, standardization=False, maxIter=100,
    )


def boosted_classifier() -> Estimator:
    """The setting's learning rate of 2.41 is outside Spark's range, so the largest allowed one is used."""
    return GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxDepth=3, maxIter=9, stepSize=1.0,
        subsamplingRate=0.6088823721160945, featureSubsetStrategy="0.5835502613551707", minInstancesPerNode=4,
        validationIndicatorCol="_validation", seed=TREE_SEED,
    )


def boosted_regressor(rounds: int = 223) -> Estimator:
    return GBTRegressor(
        featuresCol=FEATURES, labelCol=LABEL, maxDepth=5, maxIter=rounds, stepSize=0.14655365095604356,
        subsamplingRate=0.7452397368089964, featureSubsetStrategy="0.5869411822240327", minInstancesPerNode=1,
        validationIndicatorCol="_validation", seed=DELIVERY_SEED,
    )


@dataclass
class Fitted:
    """A model with its metrics, one row per split."""

    model: PipelineModel
    metrics: DataFrame


def _labelled(rows: DataFrame, inputs: Inputs, split: str) -> DataFrame:
    return rows.withColumns({LABEL: F.col(inputs.target).cast("double"), "_validation": F.col(split) == VAL})


def train(
    rows: DataFrame,
    inputs: Inputs,
    estimator: Estimator | Callable[[int], Estimator],
    split: str = "train_test_split",
) -> Fitted:
    """Fit on the training rows and measure on all splits.

    Boosted trees also see the validation rows, to stop when these no longer
    improve.  An estimator given as a function is called with the number of
    training rows.
    """
    return _fit_all(rows, inputs, [estimator], split)[0]


def _fit_all(
    rows: DataFrame, inputs: Inputs, estimators: Sequence[Estimator | Callable[[int], Estimator]], split: str
) -> list[Fitted]:
    """Every estimator on the same feature stages, which are learned, and the features made, once."""
    shared_folder(rows.sparkSession)  # boosted trees cut their lineage there
    used = [*inputs.flags, *inputs.numeric, *inputs.categories, inputs.target, split]
    labelled = _labelled(rows.select(*dict.fromkeys(used)), inputs, split).where(F.col(LABEL).isNotNull())
    kept = labelled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        prepare = PipelineModel(fit_features(kept.where(F.col(split) == TRAIN), inputs))
        made = prepare.transform(kept).select(FEATURES, LABEL, "_validation", split).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            training = made.where(F.col(split) == TRAIN)
            fits = []
            for estimator in estimators:
                if not isinstance(estimator, Estimator):
                    estimator = estimator(training.count())
                validated = estimator.hasParam("validationIndicatorCol") and estimator.isDefined("validationIndicatorCol")
                seen = made.where(F.col(split).isin(TRAIN, VAL)) if validated else training
                slices = splittable_stages(seen, estimator)
                fitted = estimator.fit(PipelineModel(slices).transform(seen.select(FEATURES, LABEL, "_validation")))
                own = [*slices, fitted]
                fits.append(Fitted(PipelineModel([*prepare.stages, *own]), evaluate(PipelineModel(own), made, split)))
            return fits
        finally:
            made.unpersist()
    finally:
        kept.unpersist()


def splittable_stages(training: DataFrame, estimator: Estimator) -> list[Transformer]:
    """Stages that leave in ``features`` what a bootstrapped forest can split on; none for other estimators, or if that is all.

    No split of a forest leaves less than ``minWeightFractionPerNode`` of the
    training rows on either side, so a one-hot position that is rarer, or
    missing in fewer rows, is in no split of any tree; yet each tree would count
    it in every node that draws it.  Samples are drawn anew for each tree, so a
    position only goes if its count is eight deviations short of that bound.
    """
    if not isinstance(estimator, RandomForestClassifier) or not estimator.getBootstrap():
        return []
    attrs = training.schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    counted = training.agg(F.count(F.lit(1)).alias("n"), Summarizer.metrics("numNonZeros").summary(F.col(FEATURES)).alias("s"))
    n, held = counted.select("n", vector_to_array("s.numNonZeros").alias("held")).first()  # one row
    least = estimator.getMinWeightFractionPerNode() * n
    rare = set()
    for at in (a["idx"] for a in attrs.get("binary", [])):
        side = min(held[at], n - held[at])
        if side + 8 * side**0.5 + 8 < least:
            rare.add(at)
    kept = [at for at in range(len(held or [])) if at not in rare]
    if not rare or not kept:
        return []
    swap = f"SELECT * EXCEPT (`{FEATURES}`, `_splittable`), `_splittable` AS `{FEATURES}` FROM __THIS__"
    return [VectorSlicer(inputCol=FEATURES, outputCol="_splittable", indices=kept), SQLTransformer(statement=swap)]


def evaluate(model: Transformer, labelled: DataFrame, split: str = "train_test_split") -> DataFrame:
    """Metrics per split; few rows, brought back so the rows they come from can be released."""
    scored = model.transform(labelled)
    if "probability" not in scored.columns:
        metrics = regression_metrics(scored.select(split, LABEL, "prediction"), [split])
    else:
        slim = scored.select(split, LABEL, "prediction", vector_to_array("probability")[1].alias("_p"))
        counted = classification_metrics(slim, [split], LABEL, "prediction", "_p")
        metrics = counted.join(ranking_metrics(slim, [split], LABEL, "_p"), split)
    spark = labelled.sparkSession
    return spark.createDataFrame(metrics.collect(), metrics.schema)  # one row per split


def tune(
    rows: DataFrame,
    inputs: Inputs,
    candidates: Sequence[Estimator],
    metric: str,
    split: str = "train_test_split",
) -> tuple[Fitted, DataFrame]:
    """Fit every candidate and keep the one with the largest validation metric.

    Also returns the metrics of all, with the number of the candidate.
    """
    best, best_value, all_metrics = None, None, None
    for number, fitted in enumerate(_fit_all(rows, inputs, candidates, split)):
        row = fitted.metrics.where(F.col(split) == VAL).first()
        value = float("-inf") if row is None or row[metric] is None else row[metric]
        if best is None or value > best_value:
            best, best_value = fitted, value
        numbered = fitted.metrics.withColumn("candidate", F.lit(number))
        all_metrics = numbered if all_metrics is None else all_metrics.unionByName(numbered)
    return best, all_metrics


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- what must hold of fitted models --------------------------------------------------------------------------------


def prepared_rows(model: PipelineModel, rows: DataFrame, inputs: Inputs, keep: Sequence[str] = ()) -> DataFrame:
    """``features``, ``label`` and the kept columns of the rows that have a label, by the model's own feature stages."""
    labelled = rows.withColumn(LABEL, F.col(inputs.target).cast("double")).where(F.col(LABEL).isNotNull())
    return PipelineModel(model.stages[:-1]).transform(labelled).select(*keep, FEATURES, LABEL)


def leaf_shares(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """``leaf, n, positives, share, low, high``: the training rows of each leaf, and the probabilities the model gives them.

    For one tree fitted without resampling, a leaf's probability is its share
    of positive rows.  For more trees a leaf is the combination of all.
    """
    fitted = model.stages[-1].copy()
    fitted.setLeafCol("_leaf")
    scored = fitted.transform(prepared.select(FEATURES, LABEL))
    probability = vector_to_array("probability")[1]
    rows = scored.select(F.md5(F.col("_leaf").cast("string")).alias("leaf"), LABEL, probability.alias("_p"))
    return rows.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), F.sum(LABEL).cast("bigint").alias("positives"), F.avg(LABEL).alias("share"),
        F.min("_p").alias("low"), F.max("_p").alias("high"),
    )


def saved_leaves(spark: SparkSession, path: str) -> DataFrame:
    """``tree, leaf, share, n`` of a saved classifier of trees: each leaf's share of positive rows in its own sample.

    Leaves are numbered from the left, as the model numbers them.  One row per
    leaf, which the model's size bounds.
    """
    nodes = spark.read.parquet(f"{path}/stages/*RandomForest*/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    leaves = nodes.where("leftChild < 0")
    number = F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1
    stats = F.col("impurityStats")
    return leaves.select("tree", number.alias("leaf"), (stats[1] / (stats[0] + stats[1])).alias("share"), F.col("rawCount").alias("n"))


def _shares_by_place(leaves: DataFrame) -> Column:
    """The shares as a constant array of trees, each an array of its leaves; NULL where there is none."""

    def placed(at: str, value: str) -> Column:
        found = F.map_from_entries(F.collect_list(F.struct(F.col(at).cast("int"), value)))
        return F.transform(F.sequence(F.lit(0), F.max(at).cast("int")), lambda i: F.try_element_at(found, i))

    trees = leaves.groupBy("tree").agg(placed("leaf", "share").alias("shares"))
    # one row, which the model's size bounds
    return F.from_json(F.lit(trees.agg(F.to_json(placed("tree", "shares"))).first()[0] or "[]"), "array<array<double>>")


def regrouped_probabilities(model: PipelineModel, prepared: DataFrame, leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys.., probability, mean_share, trees``: a row's probability beside the mean share of the leaves that it falls in.

    A row meets its leaves in its place, through a constant that holds the
    shares of the model's leaves; a row for each of its trees would be hundreds
    of times the input, and a search among all leaves as many steps.
    """
    fitted = model.stages[-1].copy()
    fitted.setLeafCol("_leaf")
    scored = fitted.transform(prepared).select(*keys, vector_to_array("probability")[1].alias("probability"), vector_to_array("_leaf").alias("_leaf"))
    held = _shares_by_place(leaves)
    met = F.transform("_leaf", lambda at, tree: F.get(F.get(held, tree), at.cast("int")))
    fallen = scored.select(*keys, "probability", F.filter(met, lambda x: x.isNotNull()).alias("_met"))
    sums = fallen.select(*keys, "probability", F.aggregate("_met", F.lit(0.0), lambda a, x: a + x).alias("_sum"), F.size("_met").cast("bigint").alias("_trees"))
    # rows with equal keys and probability are one, with the trees of all of them
    grouped = sums.groupBy(*keys, "probability").agg(F.sum("_sum").alias("_sum"), F.sum("_trees").alias("trees"))
    return grouped.where("trees > 0").select(*keys, "probability", (F.col("_sum") / F.col("trees")).alias("mean_share"), "trees")


def losses_by_round(model: PipelineModel, prepared: DataFrame) -> list[float]:
    """The loss of a boosted model on the rows after each of its rounds."""
    fitted = model.stages[-1]
    rows = prepared.select(FEATURES, LABEL)
    return fitted.evaluateEachIteration(rows, "squared") if isinstance(fitted, GBTRegressionModel) else fitted.evaluateEachIteration(rows)


def loss_beside_constant(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """One row ``n, loss, constant_loss``: the mean loss on the rows, and that of the best constant.

    Log loss for classifiers, squared error for regressors, in one aggregate.
    """
    scored = model.stages[-1].transform(prepared)
    y = F.col(LABEL)
    if "probability" in scored.columns:
        tiny = 1e-15
        p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - tiny)), F.lit(tiny))
        loss = F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))
        share = F.greatest(F.least(F.avg(y), F.lit(1 - tiny)), F.lit(tiny))
        constant = -(F.avg(y) * F.log(share) + (1 - F.avg(y)) * F.log(1 - share))
    else:
        loss = F.avg((F.col("prediction") - y) * (F.col("prediction") - y))
        constant = F.var_pop(y)
    return scored.agg(F.count(F.lit(1)).alias("n"), loss.alias("loss"), constant.alias("constant_loss"))


def slot_names(model: PipelineModel, rows: DataFrame) -> dict[int, str]:
    """The name of each position of the feature vector: input, and category where it is one of several."""
    meta = PipelineModel(model.stages[:-1]).transform(rows.limit(0)).schema[FEATURES].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    return {i: re.sub(r"^_(num|flag|hot)_", "", n) for i, n in names.items()}


def vector_long(prepared: DataFrame, names: dict[int, str], keys: Sequence[str]) -> DataFrame:
    """``keys.., slot, value``: the positions of the feature vector that are not 0, by name.

    The names are a table with one row for each position, which the vector's
    own length bounds.
    """
    spark = prepared.sparkSession
    table = spark.createDataFrame(sorted(names.items()), "_at int, slot string")
    entries = prepared.select(*keys, F.posexplode(vector_to_array(FEATURES)).alias("_at", "value")).where("value <> 0")
    return entries.join(F.broadcast(table), "_at").select(*keys, "slot", "value")


def gradient_bounds(model: PipelineModel, prepared: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """``position, coefficient, gradient, within`` of a logistic model at its coefficients, the intercept as position -1.

    The gradient of the mean loss comes from one pass over the training rows.
    At the optimum of an elastic net it balances the penalty: exactly where a
    coefficient is not 0, and within the L1 part where it is.
    """
    fitted = model.stages[-1]
    strength, mix = fitted.getRegParam(), fitted.getElasticNetParam()
    p = vector_to_array("probability")[1]
    rows = fitted.transform(prepared).select(FEATURES, LABEL, p.alias("_p"))
    # sums with weights that are not negative: predicted shares of negative rows, missing shares of positive ones
    weight = F.abs(F.col("_p") - F.col(LABEL))
    sums = rows.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"),
        Summarizer.metrics("sum").summary(F.col(FEATURES), weight).alias("s"),
    ).select(LABEL, "n", "w", vector_to_array("s.sum").alias("sum")).collect()  # one row per class
    n = sum(r["n"] for r in sums)
    total, intercept = [0.0] * len(fitted.coefficients), 0.0
    for r in sums:
        sign = -1.0 if r[LABEL] == 1 else 1.0
        intercept += sign * r["w"] / n
        total = [t + sign * x / n for t, x in zip(total, r["sum"])]
    rows_out = [(-1, float(fitted.intercept), intercept, abs(intercept) <= tolerance)]
    for i, (w, g) in enumerate(zip(fitted.coefficients.toArray().tolist(), total)):
        if w:
            balance = g + strength * ((1 - mix) * w + mix * (1 if w > 0 else -1))
            within = abs(balance) <= tolerance
        else:
            within = abs(g) <= strength * mix + tolerance
        rows_out.append((i, w, g, within))
    return prepared.sparkSession.createDataFrame(rows_out, "position int, coefficient double, gradient double, within boolean")


def feature_importance(model: PipelineModel, sample: DataFrame) -> DataFrame:
    """Importance of each input position of a tree model, with the position's name."""
    spark = sample.sparkSession
    meta = model.transform(sample.limit(0)).schema[FEATURES].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    values = model.stages[-1].featureImportances.toArray()
    rows = [(int(i), names.get(i, str(i)), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "position int, name string, importance double")
