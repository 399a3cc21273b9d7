"""Registered queries over fitted models: what must hold of them, spelt out in SQL from the rows they were fitted on."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.queries import _CALENDAR, _NEXT, _SPLIT, _W, _hours, KEYS, ORACLES, TIES, query
from checks.views import milestone_events, with_views
from tracewing.operators import features as feat
from tracewing.operators import importance, learning, stats
from tracewing.plans import flows
from tracewing.session import scratch_path

#: A target that the inputs tell, but for every seventh row: trees have several leaves to find.
_SIGNAL = """case when event_id % 7 = 0 then 1 - base else base end label from (select *,
  (eventCode in ('DLV', 'POD') or commodity = 'C1')::int base from milestone_events)"""
_TRAIN = f"select event_id, {_SPLIT} train_test_split, {_SIGNAL}"
SIGNAL = replace(learning.IRREGULARITY, target="signal")


def _signalled(spark, sf_dir) -> DataFrame:
    rows = flows.irregularity_training_rows(milestone_events(spark, sf_dir), KEYS, TIES)
    base = (F.col("eventCode").isin("DLV", "POD") | (F.col("commodity") == "C1")).cast("int")
    return rows.withColumn("signal", F.when(F.col("event_id") % 7 == 0, 1 - base).otherwise(base))


def _fitted(spark, sf_dir, estimator) -> tuple[PipelineModel, DataFrame]:
    """A classifier, and the rows it was fitted on with their feature vectors."""
    rows = _signalled(spark, sf_dir)
    model = learning.train(rows, SIGNAL, estimator).model
    return model, learning.prepared_rows(model, rows.where("train_test_split = 'train'"), SIGNAL, KEYS)


@query(
    with_views(
        """select count(*) n, sum(label)::bigint positives, true share_is_probability, true one_probability_a_leaf, true several_leaves
           from train where train_test_split = 'train'""",
        "milestone_events", train=_TRAIN,
    )
)
def tree_leaf_shares(spark, sf_dir):
    """The training rows, regrouped by the leaf they fall in: a leaf's probability is its share of positive rows."""
    leaves = learning.leaf_shares(*_fitted(spark, sf_dir, learning.decision_tree()))
    return leaves.agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"),
        F.bool_and(F.abs(F.col("share") - F.col("low")) < 1e-9).alias("share_is_probability"),
        F.bool_and(F.col("low") == F.col("high")).alias("one_probability_a_leaf"), (F.count(F.lit(1)) > 1).alias("several_leaves"),
    )


@query(
    with_views(
        """select count(*) n, true mean_of_trees, true every_tree, true not_above_constant from train where train_test_split = 'train'""",
        "milestone_events", train=_TRAIN,
    )
)
def forest_leaf_probabilities(spark, sf_dir):
    """A row's probability is the mean share of the leaves it falls in, tree by tree; the loss beats the best constant's."""
    model, rows = _fitted(spark, sf_dir, learning.random_forest())
    path = scratch_path(spark, "forest")
    learning.save_model(model, path)
    loss = learning.loss_beside_constant(model, rows).first()
    found = learning.regrouped_probabilities(model, rows, learning.saved_leaves(spark, path), KEYS)
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(F.col("probability") - F.col("mean_share")) < 1e-9).alias("mean_of_trees"),
        F.bool_and(F.col("trees") == model.stages[-1].getNumTrees).alias("every_tree"),
    ).withColumn("not_above_constant", F.lit(loss["loss"] <= loss["constant_loss"]))


_DELIVERED = f"""select {_SPLIT} train_test_split from ({ORACLES['pod_features']})"""


@query(
    with_views(
        f"""select 'classifier' model, count(*) n, true not_above_constant, true falls from train where train_test_split = 'train'
            union all select 'regressor', count(*), true, true from ({_DELIVERED}) where train_test_split = 'train'""",
        "milestone_events", train=_TRAIN,
    )
)
def boosted_losses(spark, sf_dir):
    """Boosted trees fit their training rows at least as well as the best constant, and better than after their first round."""
    events = milestone_events(spark, sf_dir)
    model, rows = _fitted(spark, sf_dir, learning.boosted_classifier())
    delivery = flows.delivery_training_rows(events, KEYS, TIES)
    regressor = learning.train(delivery, learning.DELIVERY, learning.boosted_regressor()).model
    delivered = learning.prepared_rows(regressor, delivery.where("train_test_split = 'train'"), learning.DELIVERY)
    result = None
    for name, fitted, on in (("classifier", model, rows), ("regressor", regressor, delivered)):
        rounds = learning.losses_by_round(fitted, on)
        one = learning.loss_beside_constant(fitted, on).select(
            F.lit(name).alias("model"), "n", (F.col("loss") <= F.col("constant_loss")).alias("not_above_constant"),
            F.lit(rounds[-1] <= rounds[0]).alias("falls"),
        )
        result = one if result is None else result.unionByName(one)
    return result


# ---- feature vectors ------------------------------------------------------------------------------------------------

#: Input with a category that training has not seen, missing categories and text that is no number.
_ODD = f"""select * replace (
    case when {_SPLIT} = 'test' and event_id % 5 = 0 then 'new' else commodity end as commodity,
    case when event_id % 9 <> 0 then arrivalLocation end as arrivalLocation,
    case event_id % 13 when 0 then 'NaN' when 1 then 'n/a' else total_no_of_pieces end as total_no_of_pieces)
  from milestone_events"""


def _odd(spark, sf_dir) -> DataFrame:
    events = stats.hash_split(milestone_events(spark, sf_dir), KEYS, name="_split")
    n = F.col("event_id")
    return events.withColumns(
        {
            "commodity": F.when((F.col("_split") == "test") & (n % 5 == 0), "new").otherwise(F.col("commodity")),
            "arrivalLocation": F.when(n % 9 != 0, F.col("arrivalLocation")),
            "total_no_of_pieces": F.when(n % 13 == 0, "NaN").when(n % 13 == 1, "n/a").otherwise(F.col("total_no_of_pieces")),
        }
    ).drop("_split")


def _number(c: str) -> str:
    return f"case when isfinite(try_cast({c} as double)) then try_cast({c} as double) end"


def _vector_sql(source: str, inputs: learning.Inputs, view: str, **more: str) -> str:
    """Slots that are not 0 by name: scaled numbers, flags, and one position for each category or for unknown ones."""
    parts = ["select event_id, '' slot, 0.0::double \"value\" from feat where false"]
    parts += [f"select event_id, '{c}', {c}::double from feat" for c in inputs.flags]
    for c in inputs.numeric:
        known = f"coalesce({_number(c)}, (select avg({_number(c)}) from feat where train_test_split = 'train'))"
        scale = f"(select coalesce(nullif(stddev_pop({known}), 0), 1) from feat where train_test_split = 'train')"
        mean = f"(select avg({_number(c)}) from feat where train_test_split = 'train')"
        parts.append(f"select event_id, '{c}', round(({known} - {mean}) / {scale}, 6) from feat")
    for c in inputs.categories:
        seen = f"(select distinct {c}::varchar from feat where train_test_split = 'train' and {c} is not null)"
        parts.append(
            f"select event_id, '{c}_' || case when {c}::varchar in {seen} then {c}::varchar else '__unknown' end, 1.0::double from feat"
        )
    return with_views(
        f"select * from ({' union all '.join(parts)}) where \"value\" <> 0",
        "milestone_events", odd=_ODD, **more, feat=f"select *, {_SPLIT} train_test_split from ({source})",
    )


def _vector(rows: DataFrame, inputs: learning.Inputs) -> DataFrame:
    stages = learning.fit_features(rows.where("train_test_split = 'train'"), inputs)
    model = PipelineModel([*stages, stages[-1]])  # the names come from all stages but the last, which a model would be
    names = learning.slot_names(model, rows)
    made = PipelineModel(stages).transform(rows)
    found = learning.vector_long(made, names, KEYS)
    return found.withColumn("value", F.round("value", 6)).where("value <> 0")


_IRREGULARITY_ROWS = f"""select event_id, departureLocation, arrivalLocation, commodity, nature_of_goods, product_code, eventCode,
  case when eventCode = 'DIS' then 1 else 0 end statusBinary, {_NEXT} eventDate_diff_hours, wgt_chargeable, total_no_of_pieces,
  {_CALENDAR.format('eventDate', 'eventDate')} from odd"""


@query(_vector_sql(_IRREGULARITY_ROWS, learning.IRREGULARITY, "irregularity"))
def feature_vector_long(spark, sf_dir):
    """The classifiers' feature vector by slot name, learned on training rows and applied to all."""
    return _vector(flows.irregularity_training_rows(_odd(spark, sf_dir), KEYS, TIES), learning.IRREGULARITY)


_POD_ROWS = f"""select event_id, departureLocation, arrivalLocation, total_no_of_pieces, wgt_chargeable, eventCode,
  {_hours(f"lead(case when eventCode = 'POD' then eventDate end) {_W}", 'eventDate')} duration_dlv_pod,
  coalesce({_hours('eventDate', f'lag(eventDate) {_W}')}, 0) eventDate_diff_hours,
  {_CALENDAR.format('eventDate', 'eventDate')} from planned"""


@query(
    _vector_sql(
        "select * from pod_rows where eventCode = 'DLV' and duration_dlv_pod is not null", learning.DELIVERY, "delivery",
        planned="select * replace (coalesce(eventDate, planEventDate) as eventDate) from odd", pod_rows=_POD_ROWS,
    )
)
def delivery_vector_long(spark, sf_dir):
    return _vector(flows.delivery_training_rows(_odd(spark, sf_dir), KEYS, TIES), learning.DELIVERY)


def _slots_sql() -> str:
    inputs = learning.IRREGULARITY
    parts = ["select 'intercept' slot"] + [f"select '{c}'" for c in (*inputs.flags, *inputs.numeric)]
    for c in inputs.categories:
        parts.append(f"select distinct '{c}_' || {c} from feat where train_test_split = 'train' and {c} is not null")
        parts.append(f"select '{c}___unknown'")
    source = _IRREGULARITY_ROWS.replace("from odd", "from milestone_events")
    return with_views(
        f"select slot, true \"within\" from ({' union all '.join(parts)})", "milestone_events",
        feat=f"select *, {_SPLIT} train_test_split from ({source})",
    )


@query(_slots_sql())
def logistic_gradient(spark, sf_dir):
    """At the fitted coefficients the loss's gradient balances the penalty, position by position."""
    rows = flows.irregularity_training_rows(milestone_events(spark, sf_dir), KEYS, TIES)
    model = learning.train(rows, learning.IRREGULARITY, learning.logistic_regression).model
    train = learning.prepared_rows(model, rows.where("train_test_split = 'train'"), learning.IRREGULARITY)
    names = spark.createDataFrame(sorted(({-1: "intercept"} | learning.slot_names(model, rows)).items()), "position int, slot string")
    return learning.gradient_bounds(model, train).join(names, "position").select("slot", "within")


@query("select true chosen_is_largest, 3::bigint candidates")
def tuned_choice(spark, sf_dir):
    """Of all candidates the one with the largest validation metric is chosen."""
    rows = flows.irregularity_training_rows(milestone_events(spark, sf_dir), KEYS, TIES)
    candidates = [learning.random_forest(20), learning.decision_tree(), learning.boosted_classifier()]
    best, measured = learning.tune(rows, learning.IRREGULARITY, candidates, "roc_auc")
    chosen = best.metrics.where("train_test_split = 'val'").first()["roc_auc"]
    val = measured.where("train_test_split = 'val'")
    return val.agg((F.max("roc_auc") == F.lit(chosen)).alias("chosen_is_largest"), F.count(F.lit(1)).alias("candidates"))


# ---- permutation ----------------------------------------------------------------------------------------------------

_INPUTS = [*feat.IRREGULARITY_NUMERIC, *feat.IRREGULARITY_CATEGORIES, feat.IRREGULARITY_FLAG]


@query(" union all ".join(f"select '{c}' \"column\", true same_values, true others_untouched, true moved" for c in _INPUTS))
def permuted_columns(spark, sf_dir):
    """In each variant one column has the same values in other rows, and every other column is as it was."""
    rows = flows.irregularity_training_rows(milestone_events(spark, sf_dir), KEYS, TIES)
    rows = rows.where("train_test_split = 'test'").select(*KEYS, *_INPUTS)

    def counted(df: DataFrame) -> DataFrame:
        own, others, pair = F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
        for c in _INPUTS:
            here = F.col("column") == c
            rest = [x for x in (*KEYS, *_INPUTS) if x != c]
            own = F.when(here, F.xxhash64(F.lit(c), F.col(c))).otherwise(own)
            others = F.when(here, F.xxhash64(*rest)).otherwise(others)
            pair = F.when(here, F.xxhash64(*KEYS, F.col(c))).otherwise(pair)
        sums = {"own": own, "others": others, "pair": pair}
        return df.where(F.col("column") != importance.BASELINE).groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(e.cast("decimal(30,0)")).alias(n) for n, e in sums.items()]
        )

    plain = counted(importance.variants(rows.withColumn("_other", F.struct(*_INPUTS)), _INPUTS))
    moved = counted(importance.variants(importance.with_permuted(rows, _INPUTS, KEYS, 42), _INPUTS))
    a, b = plain.alias("a"), moved.alias("b")
    return a.join(b, "column").select(
        "column", ((F.col("a.own") == F.col("b.own")) & (F.col("a.n") == F.col("b.n"))).alias("same_values"),
        (F.col("a.others") == F.col("b.others")).alias("others_untouched"), (F.col("a.pair") != F.col("b.pair")).alias("moved"),
    )
