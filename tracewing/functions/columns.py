"""Scalar expressions over milestone columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILESTONE_TIME_FORMAT = "dd-MM-yy H:mm"

# Event codes and their names in published event documents.
EVENT_NAMES = {
    "FOH": "Freight On Hand",
    "DIS": "Irregularity",
    "DEP": "Departed",
    "FOW": "Freight out Warehouse",
    "ARR": "Arrived",
    "RCF": "Received Cargo from Flight",
    "RCS": "Ready for Carriage",
}


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_milestone_ts(c: str | Column) -> Column:
    """Milestone text to a zone-free timestamp; text that does not fit gives NULL.

    One pattern covers both text lengths: ``H`` reads one or two hour digits.
    """
    return F.try_to_timestamp(_column(c), F.lit(MILESTONE_TIME_FORMAT)).cast("timestamp_ntz")


def to_double(c: str | Column) -> Column:
    """Text to double, NULL where it is no finite number (ANSI casts would raise)."""
    number = _column(c).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)  # NaN compares as the largest


def chargeable_weight(weight: str | Column, volume: str | Column) -> Column:
    """The larger of the weight and the volume weight (cubic metres x 1000 / 6)."""
    return F.greatest(to_double(weight), to_double(volume) * 1000 / 6)


def epoch_seconds(ts: str | Column) -> Column:
    return F.unix_timestamp(_column(ts))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (epoch_seconds(end) - epoch_seconds(start)) / F.lit(3600.0)


def clean_delay(c: str | Column, *, keep_colons: bool = False) -> Column:
    """Delay text such as ``-1:30`` to a number: sign dropped, colon read as a decimal point.

    ``keep_colons`` leaves colons in, so only delays without one become a number.
    """
    text = F.translate(_column(c), "-", "") if keep_colons else F.translate(_column(c), ":-", ".")
    return text.try_cast("double")


CALENDAR_PARTS = {
    "weekday": F.dayofweek,  # 1 = Sunday
    "hour": F.hour,
    "month": F.month,
    "weekofyear": F.weekofyear,  # ISO week
}


def calendar_features(df: DataFrame, ts: str = "eventDate", parts: Sequence[str] | None = None) -> DataFrame:
    """Add ``<ts>_weekday``, ``<ts>_hour``, ``<ts>_month`` and ``<ts>_weekofyear``."""
    return df.withColumns({f"{ts}_{p}": CALENDAR_PARTS[p](F.col(ts)) for p in parts or CALENDAR_PARTS})


def is_code(c: str | Column, code: str) -> Column:
    """1 where the column holds the code, else 0 (also for NULL)."""
    return F.when(_column(c) == code, 1).otherwise(0)


def event_name(code: str | Column) -> Column:
    """Name of an event code, NULL for a code without one."""
    code = _column(code)
    named = None
    for key, name in EVENT_NAMES.items():
        named = F.when(code == key, name) if named is None else named.when(code == key, name)
    return named


def waybill_parts(key: str | Column) -> Column:
    """``awb-KLM-70318844`` or ``KLM-70318844`` to a struct of prefix and number."""
    key = _column(key)
    return F.struct(
        F.split_part(key, F.lit("-"), F.lit(-2)).alias("prefix"),
        F.split_part(key, F.lit("-"), F.lit(-1)).alias("number"),
    )


def waybill_key(prefix: str | Column, number: str | Column) -> Column:
    return F.concat_ws("-", F.lit("awb"), _column(prefix), _column(number))


def key_text(*parts: str | Column) -> Column:
    """The parts as one text, each with its length and NULL as a dash, so that different parts give different texts."""
    texts = [_column(p).cast("string") for p in parts]
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.concat_ws("|", *marked)


def name_based_id(*parts: str | Column) -> Column:
    """Identifier in UUID form made from its parts, so a re-run gives the same one."""
    digest = F.md5(key_text(*parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def random_id() -> Column:
    """A new random identifier on every evaluation; prefer ``name_based_id``."""
    return F.uuid()


def hash_bucket(seed: int, *keys: str | Column, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from the seed and the keys alone, whatever the partitioning."""
    text = key_text(F.lit(str(seed)), *keys)
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets))
