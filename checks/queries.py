"""Every registered query beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqltext as st
from checks.views import (
    BASE, HOT_KEY, RULES, lines, milestone_events, milestones_raw, scored_events, table, waybills, with_views,
)
from tracewing.functions import columns as cols
from tracewing.operators import documents as docs
from tracewing.operators import features, importance, jsonld, learning, metrics, milestones, ranking, scaling, sequence, stats
from tracewing.operators.skew import with_neighbours
from tracewing.plans import flows
from tracewing.schema import RAW_MILESTONE_COLUMNS
from tracewing.session import accept_repeated_members, scratch_path
from tracewing.sources import readers, writers
from tracewing.streaming.append import append_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDER = ["eventDate", "event_id"]
TIES = ("event_id",)
KEYS = ["event_id"]
NAMES = docs.Names()


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = " ".join(sql.split())
        return run

    return register


# ---- columns -------------------------------------------------------------------------------------------------------


def _parsed(c: str) -> str:
    return f"try_strptime({c}, '%d-%m-%y %H:%M')"


@query(
    with_views(
        f"select event_id, {_parsed('Baselined')} baseline_date, {_parsed('Dynamic')} dynamic_date, "
        f"{_parsed('Actual')} actual_date, length(Baselined)::int text_length from milestones_raw",
        "milestones_raw",
    )
)
def parse_milestone_ts(spark, sf_dir):
    return milestones_raw(spark, sf_dir).select(
        "event_id",
        cols.parse_milestone_ts("Baselined").alias("baseline_date"),
        cols.parse_milestone_ts("Dynamic").alias("dynamic_date"),
        cols.parse_milestone_ts("Actual").alias("actual_date"),
        F.length("Baselined").alias("text_length"),
    )


@query(
    with_views(
        """select event_id, greatest(try_cast(Baseline_Weight as double), try_cast(Baseline_Volume as double) * 1000 / 6)
           wgt_chargeable from milestones_raw""",
        "milestones_raw",
    )
)
def chargeable_weight(spark, sf_dir):
    return milestones_raw(spark, sf_dir).select(
        "event_id", cols.chargeable_weight("Baseline_Weight", "Baseline_Volume").alias("wgt_chargeable")
    )


_CALENDAR = """(dayofweek({0}) + 1)::int {1}_weekday, hour({0})::int {1}_hour, month({0})::int {1}_month,
  weekofyear({0})::int {1}_weekofyear"""


@query(f"select event_id, {_CALENDAR.format('ts', 'ts')} from events")
def calendar_features(spark, sf_dir):
    return cols.calendar_features(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@query(
    with_views(
        """select event_id, try_cast(replace(replace(delay, ':', '.'), '-', '') as double) delay_h,
           try_cast(replace(delay, '-', '') as double) delay_colons from milestone_events""",
        "milestone_events",
    )
)
def clean_delay(spark, sf_dir):
    return milestone_events(spark, sf_dir).select(
        "event_id", cols.clean_delay("delay").alias("delay_h"),
        cols.clean_delay("delay", keep_colons=True).alias("delay_colons"),
    )


@query(
    with_views(
        """select event_id, eventCode, case eventCode when 'DIS' then 'Irregularity' end event_name
           from milestone_events""",
        "milestone_events",
    )
)
def event_name_lookup(spark, sf_dir):
    return milestone_events(spark, sf_dir).select(
        "event_id", "eventCode", cols.event_name("eventCode").alias("event_name")
    )


@query(
    with_views(
        """select waybill_id, split_part(waybill_id, '-', 2) prefix, split_part(waybill_id, '-', 3) number,
           waybill_id rebuilt from waybills""",
        "waybills",
    )
)
def waybill_key_split(spark, sf_dir):
    parts = cols.waybill_parts("waybill_id")
    return waybills(spark, sf_dir).select(
        "waybill_id", parts["prefix"].alias("prefix"), parts["number"].alias("number"),
        cols.waybill_key(parts["prefix"], parts["number"]).alias("rebuilt"),
    )


@query(with_views(f"select waybill_id, {st.uuid_of(st.lit('waybill'), 'waybill_id')} object_id from waybills", "waybills"))
def name_based_ids(spark, sf_dir):
    return waybills(spark, sf_dir).select(
        "waybill_id", cols.name_based_id(F.lit("waybill"), "waybill_id").alias("object_id")
    )


@query(
    """select event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type
       || '"}' json from events"""
)
def row_to_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return jsonld.json_rows(rows, keep=["event_id"])


@query("select event_id, unnest(json_keys(props)) \"key\", props->>'k' \"value\" from events")
def json_key_values(spark, sf_dir):
    return jsonld.json_key_values(table(spark, sf_dir, "events"), "props", keep=["event_id"])


# ---- keys and milestones -------------------------------------------------------------------------------------------

_IDS = "select HAWB_No, row_number() over (order by HAWB_No) row_num from (select distinct HAWB_No from milestones_raw)"


@query(with_views(_IDS, "milestones_raw"))
def dense_key_id(spark, sf_dir):
    return ranking.dense_key_id(milestones_raw(spark, sf_dir), "HAWB_No")


@query(with_views("select event_id, HAWB_No, row_num from milestones_raw join ids using (HAWB_No)", "milestones_raw", ids=_IDS))
def attach_key_id(spark, sf_dir):
    return ranking.attach_key_id(milestones_raw(spark, sf_dir).select("event_id", "HAWB_No"), "HAWB_No")


def _delivery_case() -> str:
    branches = []
    for rule in RULES:
        span = f"row_num between {rule.first} and {rule.last}"
        branches.append(f"when actual_date is null and {span} then dynamic_date + interval {rule.after_dynamic} minute")
        branches.append(f"when actual_date is not null and {span} then actual_date + interval {rule.after_actual} minute")
    return f"case {' '.join(branches)} else actual_date end"


_EVENT_COLUMNS = """HAWB_No awbNo, HAWB_Origin departureLocation, HAWB_Destination arrivalLocation,
  Baseline_Pieces total_no_of_pieces, Baseline_Weight total_weight, Baseline_Volume total_net_volume"""
_PARSED = f"""select m.*, row_num, {_parsed('Baselined')} baseline_date, {_parsed('Dynamic')} dynamic_date,
  {_parsed('Actual')} actual_date from milestones_raw m join ids using (HAWB_No)"""
_DELIVERED = f"""select {_EVENT_COLUMNS}, 'DLV' eventCode, baseline_date planEventDate, {_delivery_case()} eventDate
  from parsed where Milestone = 'RIH'"""
_HAPPENED = f"""select {_EVENT_COLUMNS}, Milestone eventCode, baseline_date planEventDate, actual_date eventDate
  from parsed where Actual is not null"""


def _prepared(codes: tuple[str, ...]) -> str:
    wanted = ", ".join(st.lit(c) for c in codes)
    return with_views(
        f"""select awbNo, departureLocation, arrivalLocation, total_no_of_pieces, total_weight, total_net_volume,
            greatest(try_cast(total_weight as double), try_cast(total_net_volume as double) * 1000 / 6) wgt_chargeable,
            eventCode, planEventDate, eventDate
            from (select * from happened union all select * from delivered) where eventCode in ({wanted})""",
        "milestones_raw", ids=_IDS, parsed=_PARSED, happened=_HAPPENED, delivered=_DELIVERED,
    )


@query(with_views("select * from delivered", "milestones_raw", ids=_IDS, parsed=_PARSED, delivered=_DELIVERED))
def impute_delivery(spark, sf_dir):
    return milestones.impute_delivery(milestones_raw(spark, sf_dir), RULES)


@query(with_views("select * from happened", "milestones_raw", ids=_IDS, parsed=_PARSED, happened=_HAPPENED))
def actual_events(spark, sf_dir):
    return milestones.actual_events(milestones_raw(spark, sf_dir))


@query(_prepared(milestones.EVENT_CODES))
def prepare_events(spark, sf_dir):
    return milestones.prepare_events(milestones_raw(spark, sf_dir), rules=RULES)


@query(_prepared(milestones.EVENT_CODES_JOINED))
def prepare_events_literal_codes(spark, sf_dir):
    return milestones.prepare_events(milestones_raw(spark, sf_dir), milestones.EVENT_CODES_JOINED, RULES)


# ---- projections, filters, counts ----------------------------------------------------------------------------------


@query(with_views("select eventCode, count(*) \"count\" from milestone_events group by eventCode", "milestone_events"))
def event_code_counts(spark, sf_dir):
    return stats.event_code_counts(milestone_events(spark, sf_dir))


@query(with_views("select count(*) row_count, 15::int column_count from milestone_events", "milestone_events"))
def table_shape(spark, sf_dir):
    return stats.shape(milestone_events(spark, sf_dir))


@query(
    with_views(
        "select event_id, case when eventCode = 'DIS' then 1 else 0 end statusBinary from milestone_events",
        "milestone_events",
    )
)
def status_binary(spark, sf_dir):
    return sequence.status_flag(milestone_events(spark, sf_dir)).select("event_id", "statusBinary")


@query(
    with_views(
        "select event_id, coalesce(eventDate, planEventDate) eventDate from milestone_events", "milestone_events"
    )
)
def fill_plan_date(spark, sf_dir):
    return milestone_events(spark, sf_dir).select("event_id", F.coalesce("eventDate", "planEventDate").alias("eventDate"))


@query(with_views("select event_id, eventDate from milestone_events where eventDate is not null", "milestone_events"))
def drop_null_target(spark, sf_dir):
    return milestone_events(spark, sf_dir).na.drop(subset=["eventDate"]).select("event_id", "eventDate")


@query(
    with_views(
        "select event_id, coalesce(case when event_id % 6 <> 0 then wgt_chargeable end, 0) wgt from milestone_events",
        "milestone_events",
    )
)
def fill_constants(spark, sf_dir):
    known = F.when(F.col("event_id") % 6 != 0, F.col("wgt_chargeable"))
    return milestone_events(spark, sf_dir).select("event_id", known.alias("wgt")).fillna({"wgt": 0})


_GAPS = "case when event_id % 9 = 0 then 'n/a' else total_weight end"


def _with_gaps(spark, sf_dir) -> DataFrame:
    gaps = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("total_weight"))
    return milestone_events(spark, sf_dir).select("event_id", gaps.alias("total_weight"), "total_net_volume")


@query(
    with_views(
        f"""select event_id, try_cast({_GAPS} as double) total_weight,
            try_cast(total_net_volume as double) total_net_volume from milestone_events""",
        "milestone_events",
    )
)
def coerce_numeric(spark, sf_dir):
    return stats.coerce_numeric(_with_gaps(spark, sf_dir), ["total_weight", "total_net_volume"])


@query(
    with_views(
        "select event_id, awbNo, eventDate, eventCode from milestone_events order by awbNo, eventDate nulls first, event_id limit 1",
        "milestone_events",
    )
)
def first_event(spark, sf_dir):
    rows = milestone_events(spark, sf_dir).select("event_id", "awbNo", "eventDate", "eventCode")
    return stats.first_row(rows, ["awbNo", "eventDate", "event_id"])


@query(
    with_views(
        """select awbNo, sum(total_weight::decimal(18, 4))::double total_weight, count(total_no_of_pieces) no_of_pieces
           from milestone_events group by awbNo""",
        "milestone_events",
    )
)
def shipment_rollup(spark, sf_dir):
    rolled = stats.shipment_rollup(milestone_events(spark, sf_dir))
    return rolled.withColumn("total_weight", F.round("total_weight", 4))


# ---- sequences -----------------------------------------------------------------------------------------------------

_W = "over (partition by awbNo order by eventDate nulls first, event_id)"


def _hours(later: str, earlier: str) -> str:
    return f"(floor(epoch({later})) - floor(epoch({earlier}))) / 3600.0"


@query(
    with_views(
        f"""select event_id, coalesce(lead(case when eventCode = 'DIS' then 1 else 0 end) {_W}, 0) statusTarget
            from milestone_events""",
        "milestone_events",
    )
)
def next_irregularity_label(spark, sf_dir):
    flagged = sequence.status_flag(milestone_events(spark, sf_dir)).select("event_id", "awbNo", "eventDate", "statusBinary")
    return sequence.next_flag_label(flagged, ORDER).select("event_id", "statusTarget")


def _dated(spark, sf_dir, key: str | None = None) -> DataFrame:
    rows = milestone_events(spark, sf_dir, key) if key else milestone_events(spark, sf_dir)
    return rows.select("event_id", "awbNo", "eventDate", "eventCode")


_NEXT = f"coalesce({_hours(f'lead(eventDate) {_W}', 'eventDate')}, 0)"


@query(with_views(f"select event_id, {_NEXT} eventDate_diff_hours from milestone_events", "milestone_events"))
def hours_to_next(spark, sf_dir):
    return sequence.hours_to_next(_dated(spark, sf_dir), ORDER).select("event_id", "eventDate_diff_hours")


@query(
    with_views(
        f"""select event_id, coalesce({_hours('eventDate', f'lag(eventDate) {_W}')}, 0) eventDate_diff_hours
            from milestone_events""",
        "milestone_events",
    )
)
def hours_since_prev(spark, sf_dir):
    return sequence.hours_since_previous(_dated(spark, sf_dir), ORDER).select("event_id", "eventDate_diff_hours")


_REACHED = f"lead(case when eventCode = 'POD' then eventDate end) {_W}"


@query(
    with_views(
        f"""select event_id, case when eventCode = 'DLV' then {_hours(_REACHED, 'eventDate')} end duration_dlv_pod
            from milestone_events""",
        "milestone_events",
    )
)
def dlv_pod_duration(spark, sf_dir):
    return sequence.duration_to_next_event(_dated(spark, sf_dir), ORDER).select("event_id", "duration_dlv_pod")


@query(
    with_views(
        f"""select event_id, awbNo, {_NEXT} eventDate_diff_hours,
            case when eventCode = 'DLV' then {_hours(_REACHED, 'eventDate')} end duration_dlv_pod from hot_events""",
        "hot_events",
    )
)
def hot_waybill_durations(spark, sf_dir):
    """A third of all rows in one waybill, which several ranges share."""
    rows = with_neighbours(
        _dated(spark, sf_dir, HOT_KEY), ["awbNo"], ORDER,
        ahead={"next": F.col("eventDate"), "reached": F.when(F.col("eventCode") == "POD", F.col("eventDate"))},
    )
    return rows.select(
        "event_id", "awbNo",
        F.coalesce(cols.hours_between("eventDate", "next"), F.lit(0.0)).alias("eventDate_diff_hours"),
        F.when(F.col("eventCode") == "DLV", cols.hours_between("eventDate", "reached")).alias("duration_dlv_pod"),
    )


# ---- feature tables ------------------------------------------------------------------------------------------------


@query(
    with_views(
        f"""select event_id, awbNo, wgt_chargeable, departureLocation, arrivalLocation,
            total_no_of_pieces::double total_no_of_pieces, product_code, nature_of_goods, commodity, eventCode,
            case when eventCode = 'DIS' then 1 else 0 end statusBinary,
            try_cast(replace(replace(delay, ':', '.'), '-', '') as double) delay_h,
            coalesce(lead(case when eventCode = 'DIS' then 1 else 0 end) {_W}, 0) statusTarget,
            {_NEXT} eventDate_diff_hours, {_CALENDAR.format('eventDate', 'eventDate')} from milestone_events""",
        "milestone_events",
    )
)
def irregularity_features(spark, sf_dir):
    return features.irregularity_features(milestone_events(spark, sf_dir), TIES, keep=KEYS)


_PLANNED = "select * replace (coalesce(eventDate, planEventDate) as eventDate) from milestone_events"
_POD_ROWS = f"""select event_id, departureLocation, arrivalLocation, total_no_of_pieces, wgt_chargeable, eventCode,
  {_hours(_REACHED, 'eventDate')} duration_dlv_pod,
  coalesce({_hours('eventDate', f'lag(eventDate) {_W}')}, 0) eventDate_diff_hours,
  {_CALENDAR.format('eventDate', 'eventDate')} from planned"""


@query(
    with_views(
        "select * from pod_rows where eventCode = 'DLV' and duration_dlv_pod is not null",
        "milestone_events", planned=_PLANNED, pod_rows=_POD_ROWS,
    )
)
def pod_features(spark, sf_dir):
    return features.delivery_features(milestone_events(spark, sf_dir), TIES, keep=KEYS)


# ---- splits, imputation, scaling -----------------------------------------------------------------------------------

_BUCKET = "('0x' || substr(md5('2:42|' || length(event_id::varchar) || ':' || event_id::varchar), 1, 8))::ubigint % 100"
_SPLIT = f"case when {_BUCKET} < 70 then 'train' when {_BUCKET} < 90 then 'test' else 'val' end"


@query(f"select event_id, {_SPLIT} train_test_split from events")
def hash_split(spark, sf_dir):
    return stats.hash_split(table(spark, sf_dir, "events").select("event_id"), KEYS)


@query(f"select {_SPLIT} train_test_split, count(*) n from events group by 1")
def split_counts(spark, sf_dir):
    split = stats.hash_split(table(spark, sf_dir, "events").select("event_id"), KEYS)
    return split.groupBy("train_test_split").agg(F.count(F.lit(1)).alias("n"))


_NUMERIC = ["total_weight", "total_net_volume"]
_GAPPED = f"select event_id, try_cast({_GAPS} as double) w, try_cast(total_net_volume as double) v from milestone_events"


@query(
    with_views(
        """select event_id, round(coalesce(w, (select avg(w) from gapped)), 6) total_weight,
           round(coalesce(v, (select avg(v) from gapped)), 6) total_net_volume from gapped""",
        "milestone_events", gapped=_GAPPED,
    )
)
def mean_impute(spark, sf_dir):
    rows = _with_gaps(spark, sf_dir)
    filled = scaling.mean_impute(rows, scaling.learn_scales(rows, _NUMERIC))
    return filled.withColumns({c: F.round(c, 6) for c in _NUMERIC})


_FILLED = """select event_id, coalesce(w, (select avg(w) from gapped)) w, coalesce(v, (select avg(v) from gapped)) v
  from gapped"""


@query(
    with_views(
        """select event_id, round((w - (select avg(w) from filled)) / (select stddev_pop(w) from filled), 6) + 0.0 total_weight,
           round((v - (select avg(v) from filled)) / (select stddev_pop(v) from filled), 6) + 0.0 total_net_volume
           from filled""",
        "milestone_events", gapped=_GAPPED, filled=_FILLED,
    )
)
def standardize(spark, sf_dir):
    rows = _with_gaps(spark, sf_dir)
    scaled = scaling.standardize(rows, scaling.learn_scales(rows, _NUMERIC))
    return scaled.withColumns({c: F.round(c, 6) + 0.0 for c in _NUMERIC})  # no negative zero


@query(
    with_views(
        """select event_id, "column", "value", (exists (select 1 from long t where t.train and t."column" = l."column"
           and t."value" = l."value"))::int known from long l""",
        "milestone_events",
        coded="""select event_id, event_id % 4 <> 0 train, commodity,
                 case when event_id % 4 = 0 then 'new' when event_id % 10 <> 1 then nature_of_goods end nature_of_goods
                 from milestone_events""",
        long="""select event_id, train, 'commodity' "column", commodity "value" from coded union all
                select event_id, train, 'nature_of_goods', nature_of_goods from coded""",
    )
)
def onehot_long(spark, sf_dir):
    new = F.when(F.col("event_id") % 4 == 0, "new").when(F.col("event_id") % 10 != 1, F.col("nature_of_goods"))
    rows = milestone_events(spark, sf_dir).select("event_id", "commodity", new.alias("nature_of_goods"))
    known = rows.where(F.col("event_id") % 4 != 0)
    return scaling.one_hot_rows(rows, known, ["commodity", "nature_of_goods"], "event_id")


_MODE_COLUMNS = ["eventCode", "commodity", "departureLocation", "awbNo"]


@query(
    with_views(
        """select "column", "value" "mode", n from (select *, row_number() over
           (partition by "column" order by n desc, "value") r from counts) where r = 1""",
        "milestone_events",
        counts=" union all ".join(
            f"select '{c}' \"column\", {c} \"value\", count(*) n from milestone_events group by {c}"
            for c in _MODE_COLUMNS
        ),
    )
)
def column_mode(spark, sf_dir):
    return stats.column_mode(milestone_events(spark, sf_dir), _MODE_COLUMNS)


@query("select event_id, event_type from events order by md5('9:143861876|' || length(event_id::varchar) || ':' || event_id::varchar), event_id limit 100")
def seeded_sample(spark, sf_dir):
    return stats.seeded_sample(table(spark, sf_dir, "events").select("event_id", "event_type"), KEYS, 100, 143861876)


# ---- metrics -------------------------------------------------------------------------------------------------------

_COUNTS = """count(*) filter (where y = 1 and p = 1) true_positives, count(*) filter (where y <> 1 and p = 1) false_positives,
  count(*) filter (where y = 1 and p <> 1) false_negatives, count(*) filter (where y <> 1 and p <> 1) true_negatives,
  count(*) example_count"""


@query(f"select {_COUNTS} from (select quality y, toxic p from labels)")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(table(spark, sf_dir, "labels"), [], "quality", "toxic")


_JUDGED = f"""select {_SPLIT} split, case when eventCode = 'DIS' then 1 else 0 end y,
  case when irregProbability >= 0.5 then 1 else 0 end p, irregProbability s, wgt_chargeable w,
  try_cast(total_weight as double) guess from scored_events"""


def _judged(spark, sf_dir) -> DataFrame:
    rows = stats.hash_split(scored_events(spark, sf_dir), KEYS, name="split")
    return rows.select(
        "split", cols.is_code("eventCode", "DIS").alias("label"), F.col("irregProbability").alias("probability"),
        F.when(F.col("irregProbability") >= 0.5, 1).otherwise(0).alias("prediction"),
        F.col("wgt_chargeable").alias("target"), cols.to_double("total_weight").alias("guess"),
    )


def _rounded(df: DataFrame, *kept: str) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double" and f.name not in kept]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


@query(
    with_views(
        """select split, true_positives, false_positives, false_negatives, true_negatives, example_count,
           round(log_loss, 6) log_loss, round((true_positives + true_negatives)::double / example_count, 6) accuracy_score,
           round(true_positives::double / (true_positives + false_positives), 6) precision_score,
           round(true_positives::double / (true_positives + false_negatives), 6) recall_score,
           round(2.0::double * true_positives / (2 * true_positives + false_positives + false_negatives), 6) f1_score
           from counted""",
        "scored_events", judged=_JUDGED,
        counted=f"""select split, {_COUNTS}, -avg(case when y = 1 then ln(least(greatest(s, 2.220446049250313e-16),
          1 - 2.220446049250313e-16)) else ln(1 - least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
          end) log_loss from judged group by split""",
    )
)
def classification_metrics(spark, sf_dir):
    return _rounded(metrics.classification_metrics(_judged(spark, sf_dir), ["split"], probability="probability"))


@query(
    with_views(
        """select split, round(sum(neg * (tp - pos + pos / 2.0)) / (sum(pos) * sum(neg)), 6) roc_auc,
           round(sum(pos * (case when tp + fp = pos + neg then 1.0 else (tp - pos) / (tp - pos + fp - neg) end
             + tp / (tp + fp)) / 2) / sum(pos), 6) precision_recall_auc from along group by split""",
        "scored_events", judged=_JUDGED,
        scores="""select split, s, count(*) filter (where y = 1)::double pos, count(*) filter (where y <> 1)::double neg
                  from judged group by split, s""",
        along="""select *, sum(pos) over (partition by split order by s desc) tp,
                 sum(neg) over (partition by split order by s desc) fp from scores""",
    )
)
def ranking_metrics(spark, sf_dir):
    return _rounded(metrics.ranking_metrics(_judged(spark, sf_dir), ["split"]))


@query(
    with_views(
        """select split, count(*) example_count, round(avg(abs(guess - w)), 6) mean_absolute_error,
           round(avg((guess - w) * (guess - w)), 6) mean_squared_error, round(max(abs(guess - w)), 6) max_error,
           round(sum(w), 6) sum_on_target, round(avg(w), 6) mean_on_target,
           round(sqrt(avg((guess - w) * (guess - w))), 6) root_mean_squared_error,
           round(1 - avg((guess - w) * (guess - w)) / var_pop(w), 6) r2_score from judged group by split""",
        "scored_events", judged=_JUDGED,
    )
)
def regression_metrics(spark, sf_dir):
    return _rounded(metrics.regression_metrics(_judged(spark, sf_dir), ["split"], "target", "guess"))


# ---- models: SQL states what must hold of them ----------------------------------------------------------------------


def _irregularity(spark, sf_dir, estimator) -> DataFrame:
    return flows.train_irregularity(milestone_events(spark, sf_dir), KEYS, estimator, TIES).metrics


@query()
def train_tree(spark, sf_dir):
    return _irregularity(spark, sf_dir, learning.decision_tree())


_TARGETS = f"""select event_id, awbNo, eventCode, {_SPLIT} train_test_split,
  coalesce(lead(case when eventCode = 'DIS' then 1 else 0 end) {_W}, 0) status_target from milestone_events"""
_LABEL_COUNTS = f"""select train_test_split, count(*) example_count, sum(status_target)::bigint positives
  from ({_TARGETS}) group by 1"""


def _label_counts(measured: DataFrame) -> DataFrame:
    positives = (F.col("true_positives") + F.col("false_negatives")).cast("bigint").alias("positives")
    return measured.select("train_test_split", F.col("example_count").cast("bigint").alias("example_count"), positives)


@query(with_views(_LABEL_COUNTS, "milestone_events"))
def train_tree_label_counts(spark, sf_dir):
    return _label_counts(_irregularity(spark, sf_dir, learning.decision_tree()))


@query(with_views(_LABEL_COUNTS, "milestone_events"))
def train_logistic_label_counts(spark, sf_dir):
    return _label_counts(_irregularity(spark, sf_dir, learning.logistic_regression))


@query(with_views(_LABEL_COUNTS, "milestone_events"))
def train_gbt_label_counts(spark, sf_dir):
    return _label_counts(_irregularity(spark, sf_dir, learning.boosted_classifier()))


@query()
def train_forest(spark, sf_dir):
    return _irregularity(spark, sf_dir, learning.random_forest())


@query()
def train_logistic(spark, sf_dir):
    return _irregularity(spark, sf_dir, learning.logistic_regression)


@query()
def train_gbt(spark, sf_dir):
    return _irregularity(spark, sf_dir, learning.boosted_classifier())


@query()
def train_gbt_regressor(spark, sf_dir):
    return flows.train_delivery(milestone_events(spark, sf_dir), KEYS, tie_breakers=TIES).metrics


@query()
def tune_forest(spark, sf_dir):
    rows = flows.irregularity_training_rows(milestone_events(spark, sf_dir), KEYS, TIES)
    return learning.tune(
        rows, learning.IRREGULARITY,
        [learning.random_forest(20), learning.decision_tree(), learning.boosted_classifier()], "recall_score",
    )[1]


@query()
def score_irregularity(spark, sf_dir):
    events = milestone_events(spark, sf_dir)
    model = flows.train_irregularity(events, KEYS, learning.boosted_classifier(), TIES).model
    path = scratch_path(spark, "model")
    learning.save_model(model, path)
    return flows.score_irregularity(events, learning.load_model(path), TIES)


@query(with_views("select event_id, awbNo, eventCode, true in_range, true same_when_loaded from milestone_events", "milestone_events"))
def score_irregularity_facts(spark, sf_dir):
    """Scores are probabilities, a saved model scores as before, and input columns stay as they were."""
    events = milestone_events(spark, sf_dir)
    model = flows.train_irregularity(events, KEYS, learning.boosted_classifier(), TIES).model
    path = scratch_path(spark, "model")
    learning.save_model(model, path)
    before, after = (
        flows.score_irregularity(events, m, TIES).select("event_id", "awbNo", "eventCode", F.col("irregProbability").alias(n))
        for m, n in ((model, "before"), (learning.load_model(path), "after"))
    )
    joined = before.join(after.select("event_id", "after"), "event_id")
    return joined.select(
        "event_id", "awbNo", "eventCode", F.col("after").between(0, 1).alias("in_range"),
        (F.col("before") == F.col("after")).alias("same_when_loaded"),
    )


@query("select 1.0::double total, true every_input")
def feature_importance_total(spark, sf_dir):
    """Importances add up to one, and every input has its positions in the vector."""
    rows = flows.irregularity_training_rows(milestone_events(spark, sf_dir), KEYS, TIES)
    model = learning.train(rows, learning.IRREGULARITY, learning.boosted_classifier()).model
    inputs = learning.IRREGULARITY
    found = learning.feature_importance(model, rows)
    present = F.lit(True)
    for name in [*inputs.numeric, *inputs.categories, *inputs.flags]:
        present = present & (F.count_if(F.col("name").contains(name)) > 0)
    return found.agg(F.round(F.sum("importance"), 6).alias("total"), present.alias("every_input"))


@query()
def feature_importance(spark, sf_dir):
    rows = flows.irregularity_training_rows(milestone_events(spark, sf_dir), KEYS, TIES)
    return learning.feature_importance(learning.train(rows, learning.IRREGULARITY, learning.boosted_classifier()).model, rows)


@query()
def permutation_importance(spark, sf_dir):
    rows = flows.irregularity_training_rows(milestone_events(spark, sf_dir), KEYS, TIES)
    model = learning.train(rows, learning.IRREGULARITY, learning.boosted_classifier()).model
    held_out = rows.where(F.col("train_test_split") == "test").withColumn("label", F.col("statusTarget").cast("double"))
    accuracy = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    inputs = learning.IRREGULARITY
    columns = [*inputs.numeric, *inputs.categories, *inputs.flags]
    return importance.permutation_importance(model, held_out, columns, KEYS, accuracy)


# ---- documents -----------------------------------------------------------------------------------------------------


@query(with_views(f"select {st.url('waybill_id')} doc_url, 'waybill' kind, {st.waybill_body()} body from waybills", "waybills"))
def waybill_jsonld(spark, sf_dir):
    return docs.waybill_documents(waybills(spark, sf_dir), NAMES)


@query(with_views(st.booking_documents(), "lines"))
def booking_jsonld(spark, sf_dir):
    return docs.booking_documents(lines(spark, sf_dir), NAMES)


@query(with_views(st.shipment_documents(), "lines"))
def shipment_jsonld(spark, sf_dir):
    return docs.shipment_documents(lines(spark, sf_dir), NAMES)


@query(with_views(st.piece_documents(), "lines"))
def piece_jsonld(spark, sf_dir):
    return docs.piece_documents(lines(spark, sf_dir), NAMES)


_EVENT_ROWS = """select eventCode event_code, eventDate event_ts, 'ship-' || awbNo linked_id,
  lower(departureLocation) location_id, 'carrier' recorder_id, irregProbability probability from scored_events"""


def _event_rows(spark, sf_dir) -> DataFrame:
    return scored_events(spark, sf_dir).select(
        F.col("eventCode").alias("event_code"), F.col("eventDate").alias("event_ts"),
        F.concat(F.lit("ship-"), "awbNo").alias("linked_id"), F.lower("departureLocation").alias("location_id"),
        F.lit("carrier").alias("recorder_id"), F.col("irregProbability").alias("probability"),
    )


@query(with_views(st.event_documents("Actual"), "scored_events", event_rows=_EVENT_ROWS))
def event_jsonld_actual(spark, sf_dir):
    return docs.event_documents(_event_rows(spark, sf_dir), "Actual", NAMES)


@query(with_views(st.event_documents("Predicted"), "scored_events", event_rows=_EVENT_ROWS))
def event_jsonld_predicted(spark, sf_dir):
    return docs.event_documents(_event_rows(spark, sf_dir), "Predicted", NAMES)


#: Documents whose nodes one task gathers, about.
GATHERED = 100_000


def _spread(rows: DataFrame, *keys: str, parts: int = 1) -> DataFrame:
    """The given tables are files of one row group, so one task would flatten them; files of documents need no such step.

    Rows that become a document each are spread before they do, so no texts are shuffled.
    """
    accept_repeated_members(rows.sparkSession)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *(keys or ("doc_url",)))


def _spread_pieces(spark, sf_dir, parts: int = 1) -> DataFrame:
    return docs.piece_documents(_spread(lines(spark, sf_dir).select("piece_id", "weight"), "piece_id", parts=parts), NAMES)


def _spread_events(spark, sf_dir, time_type: str) -> DataFrame:
    return docs.event_documents(_spread(_event_rows(spark, sf_dir), "linked_id", "event_ts"), time_type, NAMES)


def _all_documents(spark, sf_dir) -> DataFrame:
    # what is gathered by booking or shipment is spread already
    rows = lines(spark, sf_dir)
    return (
        docs.waybill_documents(_spread(waybills(spark, sf_dir), "waybill_id"), NAMES)
        .unionByName(docs.booking_documents(rows, NAMES))
        .unionByName(docs.shipment_documents(rows, NAMES))
        .unionByName(_spread_pieces(spark, sf_dir))
    )


_ALL_TRIPLES = " union all ".join(
    f"select * from ({q})"
    for q in (st.waybill_triples(), st.booking_triples(), st.shipment_triples(), st.piece_triples())
)


@query(with_views(_ALL_TRIPLES, "lines"))
def jsonld_triples(spark, sf_dir):
    return jsonld.flatten_documents(_all_documents(spark, sf_dir))


@query(with_views(st.event_triples("Predicted"), "scored_events", event_rows=_EVENT_ROWS))
def jsonld_event_triples(spark, sf_dir):
    return jsonld.flatten_documents(_spread_events(spark, sf_dir, "Predicted"))


@query(
    with_views(
        f"""select {st.url('piece_id')} doc_url, {st.WEIGHT_ID} subject, weight::double::varchar amount, 'KGM' unit
            from lines""",
        "lines",
    )
)
def jsonld_nodes(spark, sf_dir):
    # a row becomes a document, and a task gathers its nodes in memory before they are shuffled
    parts = -(-table(spark, sf_dir, "lineitem").count() // GATHERED)
    triples = jsonld.flatten_documents(_spread_pieces(spark, sf_dir, parts))
    nodes = jsonld.triples_to_nodes(
        triples, {"amount": NAMES.term("numericalValue"), "unit": NAMES.term("unit")}, [NAMES.term("Value")]
    )
    return nodes.withColumns({c: F.array_join(c, " ") for c in ("amount", "unit")})


@query(
    with_views(
        f"""select l.doc_url, l.subject, l.predicate, l."value" target, t."value" target_type
            from (select * from triples where kind = 'ref') l
            join (select distinct subject, "value" from triples where kind = 'type') t on t.subject = l."value" """,
        "lines", triples=_ALL_TRIPLES,
    )
)
def jsonld_ref_join(spark, sf_dir):
    path = scratch_path(spark, "triples")
    flows.ingest(_all_documents(spark, sf_dir), path)
    return jsonld.resolve_refs(spark.read.parquet(path))


_PIECES = """select awbNo, 'piece-' || event_id piece_id, wgt_chargeable weight,
  'awb-' || awbNo waybill_id, {} shipment_id from scored_events""".format(st.uuid_of(st.lit("shipment"), "awbNo"))
_PUBLISHED_EVENTS = _EVENT_ROWS.replace("'ship-' || awbNo", st.uuid_of(st.lit("shipment"), "awbNo"))


@query(
    with_views(
        f"""select case when kind = 'event' then split_part(doc_url, '#', 1) else '{BASE}' end endpoint, kind, body from (
            {st.shipment_documents('pieces')} union all {st.piece_documents('pieces')} union all
            {st.event_documents('Predicted')})""",
        "scored_events", pieces=_PIECES, event_rows=_PUBLISHED_EVENTS,
    )
)
def publish_outbox(spark, sf_dir):
    scored = scored_events(spark, sf_dir)
    pieces = scored.select(
        "awbNo", F.concat(F.lit("piece-"), F.col("event_id").cast("string")).alias("piece_id"),
        F.col("wgt_chargeable").alias("weight"),
    )
    path = scratch_path(spark, "outbox")
    writers.write_outbox(flows.publish(scored, pieces, NAMES), path)
    return spark.read.schema("endpoint string, body string, kind string").json(path).select("endpoint", "kind", "body")


@query(
    with_views(
        """select count(distinct awbNo) filter (event_id % 11 <> 0) shipments, count(*) events,
          count(*) filter (event_id % 11 = 0) unlinked, 0::bigint dangling from scored_events""",
        "scored_events",
    )
)
def publish_dangling_links(spark, sf_dir):
    """Waybills without pieces and events without a waybill: no event links to a shipment that is not published."""
    scored = scored_events(spark, sf_dir).withColumn("awbNo", F.when(F.col("event_id") % 11 != 0, F.col("awbNo")))
    # whole waybills are without pieces, whatever number of events they have
    pieces = scored.where("coalesce(crc32(cast(awbNo as binary)) % 3, 1) > 0").select(
        "awbNo", F.concat(F.lit("piece-"), F.col("event_id").cast("string")).alias("piece_id"),
        F.col("wgt_chargeable").alias("weight"),
    )
    out = flows.publish(scored, pieces, NAMES)
    shipments = out.where("kind = 'shipment'").select(F.get_json_object("body", "$['@id']").alias("url")).distinct()
    events = out.where("kind = 'event'").select(F.nullif(F.replace("endpoint", F.lit("/logistics-events"), F.lit("")), F.lit(BASE)).alias("linked"))
    joined = events.join(shipments.withColumn("published", F.lit(True)), F.col("linked") == F.col("url"), "left")
    counted = joined.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("linked").isNull()).alias("unlinked"),
        F.count_if(F.col("linked").isNotNull() & F.col("published").isNull()).alias("dangling"),
    )
    return counted.withColumn("shipments", F.lit(shipments.count()).cast("bigint"))


@query(
    """select 'u' || event_id doc_url, case event_id % 5 when 0 then 'no JSON, or larger than a value of 128 MiB or a string of 16 MiB'
      when 1 then 'empty text' else 'no text' end reason from events where event_id % 5 < 3"""
)
def flatten_rejects(spark, sf_dir):
    """Documents that can't be read are told, one by one; repeated members are read."""
    accept_repeated_members(spark)
    n = F.col("event_id") % 5
    body = (
        F.when(n == 0, F.concat(F.lit("{broken "), "props")).when(n == 1, " ").when(n == 3, '{"@id":"z","a":1,"a":2}')
        .when(n == 4, F.col("props"))
    )
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("doc_url"), body.alias("body"))
    return jsonld.rejected_documents(events).select("doc_url", "reason")


# ---- sources and sinks ---------------------------------------------------------------------------------------------


@query(with_views(_prepared(milestones.EVENT_CODES)))
def events_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "events")
    writers.write_events(milestones.prepare_events(milestones_raw(spark, sf_dir), rules=RULES), path)
    return readers.read_events(spark, path)


@query(_prepared(milestones.EVENT_CODES))
def prepare_from_csv(spark, sf_dir):
    """The whole flow: milestone files with all 22 columns to the stored event table."""
    raw = milestones_raw(spark, sf_dir)
    files, events = scratch_path(spark, "milestone-csv"), scratch_path(spark, "prepared")
    filled = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in RAW_MILESTONE_COLUMNS]
    raw.select(*filled).write.option("header", True).csv(files)
    return flows.prepare(spark, files, events, rules=RULES)


@query(with_views("select event_id, awbNo, eventCode from milestone_events", "milestone_events"))
def events_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "events-csv")
    writers.write_events_csv(milestone_events(spark, sf_dir).select("event_id", "awbNo", "eventCode"), path)
    return spark.read.schema("event_id bigint, awbNo string, eventCode string").csv(path)


@query("select event_id, event_type from events union all select event_id, event_type from events")
def append_twice(spark, sf_dir):
    path = scratch_path(spark, "appended")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    for _ in range(2):
        writers.append_parquet(rows, path, ["event_type"])
    return spark.read.parquet(path)


@query(with_views("select event_id, irregProbability from scored_events", "scored_events"))
def scored_table_roundtrip(spark, sf_dir):
    name = "tracewing_scored_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    writers.save_scored(scored_events(spark, sf_dir).select("event_id", "irregProbability"), name)
    return readers.read_table(spark, name)


@query(
    """select 'https://v.example/' || event_id doc_url, 'https://g.example/' || user_id graph, 'https://e.example/' || event_id subject,
      p.predicate, case p.predicate when '@type' then 'type' else 'value' end kind,
      case p.predicate when '@type' then 'https://v.example/ns#Event' else event_type end "value", null::varchar datatype
      from events, (values ('@type'), ('https://v.example/ns#name')) p(predicate)
    union all
    select 'https://v.example/' || event_id, null, 'https://g.example/' || user_id, 'https://v.example/ns#keep', 'value',
      event_id::varchar, 'http://www.w3.org/2001/XMLSchema#integer' from events"""
)
def jsonld_graphs(spark, sf_dir):
    """A named graph in each document: its nodes are in it, its own members beside it."""
    v = "https://v.example/ns#"
    event = F.struct(
        F.concat(F.lit("https://e.example/"), F.col("event_id").cast("string")).alias("@id"), F.lit(v + "Event").alias("@type"),
        F.col("event_type").alias(v + "name"),
    )
    body = F.struct(
        F.concat(F.lit("https://g.example/"), F.col("user_id").cast("string")).alias("@id"), F.col("event_id").alias(v + "keep"),
        F.array(event).alias("@graph"),
    )
    url = F.concat(F.lit("https://v.example/"), F.col("event_id").cast("string"))
    return jsonld.flatten_quads(_spread(table(spark, sf_dir, "events").select(url.alias("doc_url"), F.to_json(body).alias("body"))))


@query(
    """select 'https://v.example/' || event_id doc_url, 'https://o.example/e-' || event_id subject, p.predicate, p.kind,
      case p.name when 'type' then 'https://v.example/ns#Event' when 'user' then 'https://o.example/users/' || user_id
        when 'value' then "value"::varchar when 'name' then event_type else event_id::varchar end "value",
      case p.name when 'value' then 'http://www.w3.org/2001/XMLSchema#double' when 'name' then '@en'
        when 'number' then 'http://www.w3.org/2001/XMLSchema#integer' end datatype
    from events, (values ('type', '@type', 'type'), ('user', 'https://v.example/ns#user', 'ref'),
      ('value', 'https://v.example/amount#value', 'value'), ('name', 'https://v.example/ns#name', 'value'),
      ('number', 'https://v.example/ns#number', 'value')) p(name, predicate, kind)"""
)
def jsonld_contexts(spark, sf_dir):
    """Compact documents with a context: names of a vocabulary, prefixes, links, datatypes, a language, names for keywords."""
    context = (
        '{"@vocab":"https://v.example/ns#","@base":"https://o.example/","@language":"en","v":"https://v.example/","a":"v:amount#",'
        '"users":"https://o.example/users/","key":"@id","kind":"@type","user":{"@id":"v:ns#user","@type":"@id"},'
        '"value":{"@id":"a:value","@type":"http://www.w3.org/2001/XMLSchema#double"},"dropped":null}'
    )
    body = F.to_json(
        F.struct(
            F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("key"), F.lit("Event").alias("kind"),
            F.concat(F.lit("users:"), F.col("user_id").cast("string")).alias("user"), F.col("value").cast("string").alias("value"),
            F.col("event_type").alias("name"), F.col("event_id").alias("number"), F.lit("x").alias("dropped"),
        )
    )
    whole = F.concat(F.lit('{"@context":' + context + ","), F.substr(body, F.lit(2)))
    url = F.concat(F.lit("https://v.example/"), F.col("event_id").cast("string"))
    rows = _spread(table(spark, sf_dir, "events"), "event_id").select(url.alias("doc_url"), whole.alias("body"))
    return jsonld.flatten_documents(rows, contexts=jsonld.known_contexts(rows))


@query(
    """select 'u' || event_id doc_url, 'x' subject, p.predicate, 'value' kind,
      case p.predicate when 'half' then (event_id + 0.5)::double::varchar when 'flag' then (event_id % 2 = 0)::varchar else event_id::varchar end "value",
      case p.predicate when 'text' then null when 'half' then 'http://www.w3.org/2001/XMLSchema#double'
        when 'flag' then 'http://www.w3.org/2001/XMLSchema#boolean' else 'http://www.w3.org/2001/XMLSchema#integer' end datatype
    from events, (values ('number'), ('text'), ('half'), ('flag')) p(predicate)"""
)
def jsonld_scalars(spark, sf_dir):
    """One value is one triple, however it is written: plain, with a fraction of zero, with an exponent, as @value."""
    n = F.col("event_id").cast("string")
    flag = (F.col("event_id") % 2 == 0).cast("string")
    body = F.concat(
        F.lit('{"@id":"x","number":['), n, F.lit(","), n, F.lit(".0,"), n, F.lit('e0,{"@value":'), n, F.lit('}],"text":["'), n,
        F.lit('",{"@value":"'), n, F.lit('"}],"half":['), n, F.lit(".5,"), n, F.lit('.50,{"@value":'), n, F.lit('.5e0,"@type":"skip"}'),
        F.lit('],"flag":['), flag, F.lit(',{"@value":'), flag, F.lit("}]}"),
    )
    docs_ = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), n).alias("doc_url"), body.alias("body"))
    return jsonld.flatten_documents(_spread(docs_)).where("datatype is null or datatype <> 'skip'")


@query(with_views(f"select *, 'any' object_kind from ({st.piece_triples()})", "lines"))
def ingest_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "ingested")
    flows.ingest(_spread_pieces(spark, sf_dir).withColumn("kind", F.lit("any")), path)
    return spark.read.parquet(path)


@query("select event_id, ts, event_type from events")
def append_stream_available_now(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = scratch_path(spark, "streamed")
    append_available(stream.select("event_id", "ts", "event_type"), path, scratch_path(spark, "stream-checkpoint"))
    return spark.read.parquet(path)


from checks import linked, modelled  # noqa: E402, F401  they register their queries
