"""Table layouts that the flows hand to each other, and the check at each hand-over."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the milestone files, in file order.
RAW_MILESTONE_COLUMNS = (
    "Month", "Forwarder", "CDMPF", "HAWB_No", "HAWB_Origin", "HAWB_Destination",
    "Pickup_condition", "Delivery_Condition", "Milestone_Location", "Partial_Indicator",
    "Baseline_Pieces", "Actual_Pieces", "Baseline_Weight", "Actual_Weight", "Weight_Indicator",
    "Baseline_Volume", "Actual_Volume", "Volume_Indicator", "Milestone", "Baselined", "Dynamic",
    "Actual",
)
RAW_MILESTONES = T.StructType([T.StructField(c, T.StringType()) for c in RAW_MILESTONE_COLUMNS])

# Columns of the event table.
EVENTS = T.StructType(
    [
        T.StructField("awbNo", T.StringType()),
        T.StructField("departureLocation", T.StringType()),
        T.StructField("arrivalLocation", T.StringType()),
        T.StructField("total_no_of_pieces", T.StringType()),
        T.StructField("total_weight", T.StringType()),
        T.StructField("total_net_volume", T.StringType()),
        T.StructField("wgt_chargeable", T.DoubleType()),
        T.StructField("eventCode", T.StringType()),
        T.StructField("planEventDate", T.TimestampNTZType()),
        T.StructField("eventDate", T.TimestampNTZType()),
    ]
)

# Input columns of the two models.
IRREGULARITY_INPUT = (
    "awbNo", "wgt_chargeable", "departureLocation", "arrivalLocation", "total_no_of_pieces",
    "product_code", "nature_of_goods", "commodity", "delay", "eventDate", "eventCode",
)

DELIVERY_INPUT = tuple(EVENTS.fieldNames())

# Columns that publishing needs.
PUBLISH_INPUT = (
    "awbNo", "vol_gross", "departureLocation", "arrivalLocation", "total_no_of_pieces",
    "total_weight", "total_net_volume", "delay", "delay_code", "eventDate",
    "event_occurence_date_time_utc", "discrepancy_code", "irreg_reason_code", "irreg_desc",
    "eventCode", "irregProbability",
)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_url", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)


def require_columns(df: DataFrame, names: Iterable[str], where: str) -> DataFrame:
    """Raise early, on the driver, when a hand-over lacks a column."""
    present = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in present]
    if missing:
        raise ValueError(f"{where}: missing columns {missing}")
    return df
