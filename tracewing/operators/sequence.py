"""Next- and previous-event operators over the event sequence of a waybill.

``order`` names the columns that sort a waybill's events: the event time
first, then tie-breakers, since milestone times only have minutes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hours_between, is_code
from .skew import with_neighbours

KEY = "awbNo"


def next_flag_label(
    df: DataFrame,
    order: Sequence[str],
    flag: str = "statusBinary",
    name: str = "statusTarget",
    key: str = KEY,
) -> DataFrame:
    """Flag of the following event; 0 for the last event of a waybill."""
    out = with_neighbours(df, [key], order, ahead={name: F.col(flag)})
    return out.fillna({name: 0})


def hours_to_next(
    df: DataFrame,
    order: Sequence[str],
    ts: str = "eventDate",
    name: str = "eventDate_diff_hours",
    key: str = KEY,
) -> DataFrame:
    """Hours until the following event; 0 where there is none or a time is missing."""
    out = with_neighbours(df, [key], order, ahead={"_next": F.col(ts)})
    return out.withColumn(name, F.coalesce(hours_between(ts, "_next"), F.lit(0.0))).drop("_next")


def hours_since_previous(
    df: DataFrame,
    order: Sequence[str],
    ts: str = "eventDate",
    name: str = "eventDate_diff_hours",
    key: str = KEY,
) -> DataFrame:
    """Hours since the preceding event; 0 where there is none or a time is missing."""
    out = with_neighbours(df, [key], order, behind={"_prev": F.col(ts)})
    return out.withColumn(name, F.coalesce(hours_between("_prev", ts), F.lit(0.0))).drop("_prev")


def duration_to_next_event(
    df: DataFrame,
    order: Sequence[str],
    from_code: str = "DLV",
    to_code: str = "POD",
    ts: str = "eventDate",
    name: str = "duration_dlv_pod",
    key: str = KEY,
) -> DataFrame:
    """On ``from_code`` rows, hours to the next event if that one is ``to_code``; else NULL."""
    reached = F.when(F.col("eventCode") == to_code, F.col(ts))
    out = with_neighbours(df, [key], order, ahead={"_reached": reached})
    hours = F.when(F.col("eventCode") == from_code, hours_between(ts, "_reached"))
    return out.withColumn(name, hours).drop("_reached")


def status_flag(df: DataFrame, code: str = "DIS", name: str = "statusBinary") -> DataFrame:
    return df.withColumn(name, is_code("eventCode", code))
