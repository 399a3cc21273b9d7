"""The given tables in the shape of air-cargo data, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewing.operators.milestones import DeliveryRule

BASE = "https://objects.example.org/logistics-objects"
VOCABULARY = "https://vocabulary.example.org/cargo#"

# The delivery rules for tables with fewer waybills; the last range ends early so that some have no rule.
RULES = (
    DeliveryRule(1, 25, 60, 30),
    DeliveryRule(26, 50, 120, 50),
    DeliveryRule(51, 75, 20, 45),
    DeliveryRule(76, 100, 40, 30),
    DeliveryRule(101, 125, 90, 180),
    DeliveryRule(126, 140, 65, 80),
)

_MILESTONES = """
select event_id, cast(user_id as string) HAWB_No, o.n_name HAWB_Origin, d.n_name HAWB_Destination,
  cast(1 + event_id % 5 as string) Baseline_Pieces, cast(value as string) Baseline_Weight,
  cast(cast((event_id % 50) / 10.0 as double) as string) Baseline_Volume,
  case event_type when 'view' then 'RIH' when 'click' then 'OFD' when 'purchase' then 'POD'
                  when 'signup' then 'TPN' else 'DIS' end Milestone,
  {written} Baselined, {later15} Dynamic, case when event_id % 7 <> 0 then {later40} end Actual
from {events} e join {nation} o on o.n_nationkey = user_id % 25
  join {nation} d on d.n_nationkey = (user_id + 7) % 25"""

_EVENTS = """
select e.event_id, {key} awbNo, o.n_name departureLocation, d.n_name arrivalLocation,
  cast(1 + e.event_id % 5 as string) total_no_of_pieces, cast(e.value as string) total_weight,
  cast(cast((e.event_id % 50) / 10.0 as double) as string) total_net_volume,
  greatest(e.value, cast((e.event_id % 50) / 10.0 as double) * 1000 / 6) wgt_chargeable,
  concat('P', cast(e.event_id % 4 as string)) product_code,
  concat('G', cast(e.event_id % 6 as string)) nature_of_goods,
  concat('C', cast(e.event_id % 3 as string)) commodity,
  concat(case when e.event_id % 2 = 0 then '-' else '' end, cast(e.event_id % 24 as string), ':',
         lpad(cast(e.event_id % 60 as string), 2, '0')) delay,
  case e.event_type when 'view' then 'RIH' when 'click' then 'DLV' when 'purchase' then 'POD'
                    when 'signup' then 'TPN' else 'DIS' end eventCode,
  e.ts - interval 30 minutes planEventDate,
  case when e.event_id % 11 = 0 then null else e.ts end eventDate
from {events} e join {nation} o on o.n_nationkey = e.user_id % 25
  join {nation} d on d.n_nationkey = (e.user_id + 7) % 25"""

_SCORED = """
select m.*, total_net_volume vol_gross, eventDate event_occurence_date_time_utc,
  concat('D', cast(event_id % 7 as string)) delay_code, concat('X', cast(event_id % 5 as string)) discrepancy_code,
  concat('R', cast(event_id % 4 as string)) irreg_reason_code, 'checked on arrival' irreg_desc,
  cast((event_id * 37) % 100 as double) / 100 irregProbability
from {milestone_events} m"""

_WAYBILLS = """
select o_orderkey, concat('awb-N', cast(c_nationkey as string), '-', cast(o_orderkey as string)) waybill_id,
  concat('loc-', cast(c_nationkey as string)) departure, concat('loc-', cast((c_nationkey + 7) % 25 as string)) arrival,
  concat('party-', cast(o_custkey as string)) shipper, 'party-consignee' consignee, 'party-forwarder' forwarder,
  concat('booking-', cast(o_orderkey as string)) booking_id, concat('ship-', cast(o_orderkey as string)) shipment_id
from {orders} join {customer} on o_custkey = c_custkey"""

_LINES = """
select w.waybill_id, w.booking_id, w.shipment_id, l_linenumber sequence,
  concat('leg-', cast(l_suppkey as string)) activity_id,
  concat('piece-', w.shipment_id, '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
         cast(l_suppkey as string), '-', cast(cast(l_quantity as bigint) as string)) piece_id, l_quantity weight
from {lineitem} join {waybills} w on l_orderkey = w.o_orderkey"""

# a third of all rows in one waybill
HOT_KEY = "case when e.event_id % 3 = 0 then 'hot' else cast(e.user_id as string) end"
PLAIN_KEY = "cast(e.user_id as string)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark_time(shift: str = "") -> str:
    return f"date_format(ts{shift}, 'dd-MM-yy H:mm')"


def milestones_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _MILESTONES.format(
        written=_spark_time(), later15=_spark_time(" + interval 15 minutes"),
        later40=_spark_time(" + interval 40 minutes"), events="{events}", nation="{nation}",
    )
    return spark.sql(sql, events=table(spark, sf_dir, "events"), nation=table(spark, sf_dir, "nation"))


def milestone_events(spark: SparkSession, sf_dir: str, key: str = PLAIN_KEY) -> DataFrame:
    sql = _EVENTS.format(key=key, events="{events}", nation="{nation}")
    return spark.sql(sql, events=table(spark, sf_dir, "events"), nation=table(spark, sf_dir, "nation"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SCORED, milestone_events=milestone_events(spark, sf_dir))


def waybills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_WAYBILLS, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LINES, lineitem=table(spark, sf_dir, "lineitem"), waybills=waybills(spark, sf_dir))


def _sql_time(shift: str = "") -> str:
    return f"strftime(ts{shift}, '%d-%m-%y %-H:%M')"


SQL_VIEWS = {
    "milestones_raw": _MILESTONES.format(
        written=_sql_time(), later15=_sql_time(" + interval 15 minutes"),
        later40=_sql_time(" + interval 40 minutes"), events="events", nation="nation",
    ),
    "milestone_events": _EVENTS.format(key=PLAIN_KEY, events="events", nation="nation"),
    "hot_events": _EVENTS.format(key=HOT_KEY, events="events", nation="nation"),
    "scored_events": _SCORED.format(milestone_events="milestone_events"),
    "waybills": _WAYBILLS.format(orders="orders", customer="customer"),
    "lines": _LINES.format(lineitem="lineitem", waybills="waybills"),
}
SQL_NEEDS = {"scored_events": ["milestone_events"], "lines": ["waybills"]}


def with_views(sql: str, *names: str, **more: str) -> str:
    """SQL text with the named views, those they need, and further ones in order, as common tables."""
    ordered: list[str] = []
    for name in names:
        for needed in [*SQL_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{n} as ({SQL_VIEWS[n].strip()})" for n in ordered] + [f"{n} as ({q.strip()})" for n, q in more.items()]
    return f"with {', '.join(parts)} {sql.strip()}" if parts else sql.strip()
