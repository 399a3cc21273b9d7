"""Global numbering and running totals without a single-task window.

Both need rows that are unique in the sort columns, so a range shuffle
spreads them evenly whatever the data looks like.  The shuffled rows are
checkpointed with their range number; the offsets of the ranges are a table
with one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

_LOCAL_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: position in its partition


def dense_key_id(df: DataFrame, key: str, name: str = "row_num") -> DataFrame:
    """Every distinct non-NULL key with its number, 1 upwards in key order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranged = settle(
        keys.repartitionByRange(F.col(key))
        .sortWithinPartitions(key)
        .select(
            key,
            F.spark_partition_id().alias("_range"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)).alias("_at"),
        )
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_range").select(
        key, (F.col("_offset") + F.col("_at") + 1).cast("bigint").alias(name)
    )


def attach_key_id(
    df: DataFrame, key: str, name: str = "row_num"
) -> DataFrame:
    """Inner join of the rows with their key's number; rows with a NULL key drop out."""
    return df.where(F.col(key).isNotNull()).join(dense_key_id(df, key, name), key)


def running_totals(
    df: DataFrame, group: Sequence[str], order: str, totals: dict[str, str], descending: bool = False
) -> DataFrame:
    """Add sums over the rows of the group strictly before each row in ``order``.

    ``(group, order)`` must be unique; aggregate to that first.  ``totals`` maps
    new column names to the summed columns.  There are at most ranges + groups
    pairs of range and group, so the offset table stays small.
    """
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    ranged = settle(
        df.repartitionByRange(*[F.col(g) for g in group], by).withColumn("_range", F.spark_partition_id())
    )
    sums = {f"_sum_{n}": F.sum(c) for n, c in totals.items()}
    sizes = ranged.groupBy(*group, "_range").agg(*[e.alias(n) for n, e in sums.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in sums],
    )
    inside = Window.partitionBy("_range", *group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()})
    match = local["_range"] == offsets["_r"]
    for i, g in enumerate(group):
        match = match & local[g].eqNullSafe(offsets[f"_g{i}"])
    joined = local.join(offsets, match)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_sum_{n}")).alias(n) for n in totals])
