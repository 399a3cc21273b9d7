"""Milestone rows to events, with delivery events derived from lookup rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chargeable_weight, parse_milestone_ts
from .ranking import dense_key_id

KEY = "HAWB_No"
HANDED_OVER = "RIH"
DELIVERED = "DLV"

# The event codes that the event table keeps.
EVENT_CODES = ("DLV", "RIH", "DIH", "RIW", "OFD", "TPN", "POD")
# The same list as it reads when a comma falls inside the quotes.
EVENT_CODES_JOINED = ("DLV", "RIH", "DIH", "RIW", "OFD,TPN", "POD")


@dataclass(frozen=True)
class DeliveryRule:
    """Minutes from hand-over to delivery for waybill numbers ``first``..``last``."""

    first: int
    last: int
    after_dynamic: int
    after_actual: int


# Waybill numbers from, to, minutes after the dynamic and after the actual time.
DELIVERY_RULES = (
    DeliveryRule(1, 1000, 60, 30),
    DeliveryRule(1001, 2000, 120, 50),
    DeliveryRule(2001, 3000, 20, 45),
    DeliveryRule(3001, 4000, 40, 30),
    DeliveryRule(4001, 5000, 90, 180),
    DeliveryRule(5001, 6000, 65, 80),
)


def parse_milestones(raw: DataFrame) -> DataFrame:
    """The columns that events need, with the three milestone times parsed."""
    return raw.select(
        F.col(KEY),
        F.col("HAWB_Origin"),
        F.col("HAWB_Destination"),
        F.col("Baseline_Pieces"),
        F.col("Baseline_Weight"),
        F.col("Baseline_Volume"),
        F.col("Milestone"),
        F.col("Actual"),
        parse_milestone_ts("Baselined").alias("baseline_date"),
        parse_milestone_ts("Dynamic").alias("dynamic_date"),
        parse_milestone_ts("Actual").alias("actual_date"),
    )


def _minutes(number: Column, rules: Sequence[DeliveryRule], field: str) -> Column:
    chosen = F.lit(None).cast("int")
    for rule in reversed(rules):  # the first rule that fits wins
        chosen = F.when(number.between(rule.first, rule.last), getattr(rule, field)).otherwise(chosen)
    return chosen


def key_minutes(raw: DataFrame, rules: Sequence[DeliveryRule] = DELIVERY_RULES) -> DataFrame:
    """``(HAWB_No, after_dynamic, after_actual)`` for the waybills that a rule covers, numbered in key order."""
    number = F.col("row_num")
    return dense_key_id(raw, KEY).where(number <= max(rule.last for rule in rules)).select(
        KEY,
        _minutes(number, rules, "after_dynamic").alias("after_dynamic"),
        _minutes(number, rules, "after_actual").alias("after_actual"),
    ).where(F.col("after_actual").isNotNull())


def delivery_time() -> Column:
    """Actual time, or dynamic time where it is missing, plus the rule's minutes; without a rule the actual time."""
    return (
        F.when(F.col("after_actual").isNull(), F.col("actual_date"))
        .when(F.col("actual_date").isNull(), F.timestamp_add("MINUTE", F.col("after_dynamic"), F.col("dynamic_date")))
        .otherwise(F.timestamp_add("MINUTE", F.col("after_actual"), F.col("actual_date")))
    )


def _event_columns(code: Column, when: Column) -> list[Column]:
    return [
        F.col(KEY).alias("awbNo"),
        F.col("HAWB_Origin").alias("departureLocation"),
        F.col("HAWB_Destination").alias("arrivalLocation"),
        F.col("Baseline_Pieces").alias("total_no_of_pieces"),
        F.col("Baseline_Weight").alias("total_weight"),
        F.col("Baseline_Volume").alias("total_net_volume"),
        code.alias("eventCode"),
        F.col("baseline_date").alias("planEventDate"),
        when.alias("eventDate"),
    ]


def impute_delivery(
    raw: DataFrame,
    rules: Sequence[DeliveryRule] = DELIVERY_RULES,
) -> DataFrame:
    """One delivery event per hand-over row."""
    keyed = raw.where(F.col(KEY).isNotNull())
    handed = parse_milestones(keyed.where(F.col("Milestone") == HANDED_OVER))
    return handed.join(key_minutes(keyed, rules), KEY, "left").select(
        *_event_columns(F.lit(DELIVERED), delivery_time())
    )


def actual_events(raw: DataFrame) -> DataFrame:
    """The milestones that have happened, as events."""
    rows = parse_milestones(raw.where(F.col(KEY).isNotNull() & F.col("Actual").isNotNull()))
    return rows.select(*_event_columns(F.col("Milestone"), F.col("actual_date")))


def prepare_events(
    raw: DataFrame,
    codes: Sequence[str] = EVENT_CODES,
    rules: Sequence[DeliveryRule] = DELIVERY_RULES,
) -> DataFrame:
    """Event table: the happened milestones and the derived deliveries, in one pass over the rows.

    A hand-over row gives up to two events, other rows one.  Rows that give
    none are filtered before anything else, so the filter reaches the scan.
    """
    keyed = raw.where(F.col(KEY).isNotNull())
    happened = F.col("Actual").isNotNull() & F.col("Milestone").isin(*codes)
    delivers = F.col("Milestone") == HANDED_OVER if DELIVERED in codes else F.lit(False)
    timed = parse_milestones(keyed.where(happened | delivers)).join(key_minutes(keyed, rules), KEY, "left")
    event = lambda code, when: F.struct(code.alias("code"), when.alias("at"))
    both = F.array(
        F.when(happened, event(F.col("Milestone"), F.col("actual_date"))),
        F.when(delivers, event(F.lit(DELIVERED), delivery_time())),
    )
    exploded = timed.withColumn("_event", F.explode(both)).where(F.col("_event").isNotNull())
    events = exploded.select(*_event_columns(F.col("_event.code"), F.col("_event.at")))
    weight = chargeable_weight("total_weight", "total_net_volume").alias("wgt_chargeable")
    return events.select(
        "awbNo", "departureLocation", "arrivalLocation", "total_no_of_pieces", "total_weight",
        "total_net_volume", weight, "eventCode", "planEventDate", "eventDate",
    )
