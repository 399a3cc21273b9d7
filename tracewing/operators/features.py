"""Feature tables for the two models; the same functions serve training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CALENDAR_PARTS, calendar_features, clean_delay, hours_between, is_code, to_double
from ..schema import DELIVERY_INPUT, IRREGULARITY_INPUT, require_columns
from .skew import with_neighbours

# Columns after the event time that settle the order of a waybill's events.
TIE_BREAKERS = ("eventCode", "total_no_of_pieces", "wgt_chargeable")

# Inputs of the irregularity classifiers.
IRREGULARITY_NUMERIC = ("total_no_of_pieces", "eventDate_diff_hours", "wgt_chargeable")
IRREGULARITY_FLAG = "statusBinary"
IRREGULARITY_CATEGORIES = (
    "arrivalLocation", "commodity", "departureLocation", "eventCode", "eventDate_hour",
    "eventDate_weekday", "eventDate_weekofyear", "nature_of_goods", "product_code",
)
IRREGULARITY_TARGET = "statusTarget"

# Inputs of the delivery-time regressor.
DELIVERY_NUMERIC = (
    "eventDate_diff_hours", "eventDate_weekday", "eventDate_weekofyear", "eventDate_hour", "wgt_chargeable",
)
DELIVERY_CATEGORIES = (
    "arrivalLocation", "departureLocation", "eventDate_weekday", "eventDate_weekofyear", "total_no_of_pieces",
)
DELIVERY_TARGET = "duration_dlv_pod"


def irregularity_features(
    events: DataFrame,
    tie_breakers: Sequence[str] = TIE_BREAKERS,
    keep: Sequence[str] = (),
    typed: bool = True,
    look_ahead: bool = True,
) -> DataFrame:
    """Flag, next-step label, cleaned delay, calendar parts and hours to the next event.

    ``keep`` names further input columns to carry along (identifiers, or all
    columns when scoring).  ``typed=False`` leaves the numeric text columns as
    they came; the model's own first stage casts them again.  Hours to the next
    event look ahead of the row they describe: for a waybill's latest event
    they are 0.  Without ``look_ahead`` the hours since the previous event take
    their place, which are known when a row is scored.
    """
    require_columns(events, IRREGULARITY_INPUT, "irregularity features")
    carried = list(dict.fromkeys([*IRREGULARITY_INPUT, *tie_breakers, *keep]))
    rows = events.select(*carried).withColumns(
        {"_ts": F.col("eventDate").cast("timestamp_ntz"), "statusBinary": is_code("eventCode", "DIS")}
    )
    rows = with_neighbours(
        rows,
        ["awbNo"],
        ["_ts", *tie_breakers],
        ahead={"statusTarget": F.col("statusBinary")} | ({"_next": F.col("_ts")} if look_ahead else {}),
        behind={} if look_ahead else {"_next": F.col("_ts")},
    )
    hours = hours_between("_ts", "_next") if look_ahead else hours_between("_next", "_ts")
    rows = rows.withColumns(
        {f"eventDate_{part}": read(F.col("_ts")) for part, read in CALENDAR_PARTS.items()}
        | {
            "delay_h": clean_delay("delay"),
            "statusTarget": F.coalesce("statusTarget", F.lit(0)),
            "eventDate_diff_hours": F.coalesce(hours, F.lit(0.0)),
        }
    )
    if typed:
        rows = rows.withColumns({c: to_double(c) for c in ("wgt_chargeable", "total_no_of_pieces")})
    extra = {*tie_breakers} - {*IRREGULARITY_INPUT}
    return rows.drop("_ts", "_next", *(({"delay", "eventDate"} | extra) - {*keep}))


def delivery_features(
    events: DataFrame,
    tie_breakers: Sequence[str] = TIE_BREAKERS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Delivery rows whose next event is the proof of delivery, with the hours until it as target."""
    require_columns(events, DELIVERY_INPUT, "delivery features")
    carried = list(dict.fromkeys([*DELIVERY_INPUT, *tie_breakers, *keep]))
    rows = events.select(*carried).withColumn(
        "eventDate", F.coalesce("eventDate", "planEventDate").cast("timestamp_ntz")
    )
    proof = F.when(F.col("eventCode") == "POD", F.col("eventDate"))
    rows = with_neighbours(
        rows,
        ["awbNo"],
        ["eventDate", *tie_breakers],
        ahead={"_proof": proof},
        behind={"_prev": F.col("eventDate")},
    )
    rows = rows.where((F.col("eventCode") == "DLV") & F.col("_proof").isNotNull())
    rows = rows.withColumns(
        {
            "duration_dlv_pod": hours_between("eventDate", "_proof"),
            "eventDate_diff_hours": F.coalesce(hours_between("_prev", "eventDate"), F.lit(0.0)),
        }
    )
    rows = calendar_features(rows, "eventDate").where(F.col("duration_dlv_pod").isNotNull())
    dropped = {"awbNo", "eventDate", "planEventDate", "total_weight", "total_net_volume", "_proof", "_prev"}
    extra = {*tie_breakers} - {*DELIVERY_INPUT}
    return rows.drop(*((dropped | extra) - {*keep}))
