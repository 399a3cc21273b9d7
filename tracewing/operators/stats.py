"""Counts, rollups, samples and column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket, key_text, to_double


def event_code_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("eventCode").agg(F.count(F.lit(1)).alias("count"))


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


def shipment_rollup(df: DataFrame) -> DataFrame:
    """Per waybill the summed weight and the number of rows with a piece count.

    Weight is summed over event rows, and ``no_of_pieces`` counts rows: both are
    what the posting step publishes today, not totals of distinct pieces.
    """
    return df.groupBy("awbNo").agg(
        F.sum(to_double("total_weight")).alias("total_weight"),
        F.count("total_no_of_pieces").alias("no_of_pieces"),
    )


def first_row(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def column_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-NULL value per column as ``(column, mode, n)``; the smallest text wins ties.

    Values are counted as ``(column, value)`` rows, so a column with many
    distinct values spreads over tasks.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = (
        df.select(pairs.alias("_"))
        .select("_.*")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # per column: the largest count, then the smallest value among its ties (both map-side combined)
    top = counts.groupBy("column").agg(F.max("n").alias("n"))
    return (
        counts.join(F.broadcast(top), ["column", "n"])  # one row per column
        .groupBy("column", "n")
        .agg(F.min("value").alias("mode"))
        .select("column", "mode", "n")
    )


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, the same ones for the same seed whatever the partitioning."""
    ranked = df.withColumn("_pick", F.md5(key_text(F.lit(str(seed)), *keys)))
    return ranked.orderBy("_pick", *keys).limit(n).drop("_pick")


# Shares of the train, test and validation rows in per cent.
SPLIT_SHARES = (("train", 70), ("test", 20), ("val", 10))


def hash_split(
    df: DataFrame,
    keys: Sequence[str],
    seed: int = 42,
    name: str = "train_test_split",
    shares: Sequence[tuple[str, int]] = SPLIT_SHARES,
) -> DataFrame:
    """Label each row by a hash of its key, so the split survives any repartitioning."""
    total = sum(share for _, share in shares)
    bucket = hash_bucket(seed, *keys, buckets=total)
    label, limit = None, 0
    for split, share in shares:
        limit += share
        label = F.when(bucket < limit, split) if label is None else label.when(bucket < limit, split)
    return df.withColumn(name, label)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_double(c) for c in columns})
