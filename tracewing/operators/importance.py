"""Permutation importance: how much worse a model gets when one input is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key_text
from .skew import with_neighbours

#: The variant of the rows in which no column is permuted.
BASELINE = ""


def with_permuted(df: DataFrame, columns: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """Add ``_other``, a struct with the columns' values of the next row in a seeded hash order.

    The last row takes the first one's.  One order over all rows, spread over
    tasks by ranges of the hash, serves all columns; the permutation depends on
    keys and seed alone.
    """
    placed = df.withColumn("_place", F.md5(key_text(F.lit(str(seed)), *keys)))
    held = F.struct(*columns)
    moved = with_neighbours(placed, [], ["_place", *keys], ahead={"_other": held})
    start = placed.agg(F.min_by(held, F.struct("_place", *keys)).alias("held")).first()["held"]
    types = {f.name: f.dataType for f in df.schema}
    first = F.struct(*[F.lit(None if start is None else start[c]).cast(types[c]).alias(c) for c in columns])
    return moved.select(*df.columns, F.coalesce("_other", first).alias("_other"))


def variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``_other`` once as they are and once for each column, named in ``column``, with that one exchanged."""
    named = F.explode(F.array(F.lit(BASELINE), *[F.lit(c) for c in columns])).alias("column")
    repeated = df.select("*", named)
    return repeated.select(
        "column",
        *[
            F.when(F.col("column") == c, F.col(f"_other.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in df.columns
            if c != "_other"
        ],
    )


def permute_column(df: DataFrame, column: str, keys: Sequence[str], seed: int) -> DataFrame:
    """Hand each row the value of the next row in a seeded hash order; the last row takes the first one's."""
    moved = with_permuted(df, [column], keys, seed)
    return moved.select(*[F.col(f"_other.{column}").alias(c) if c == column else F.col(c) for c in df.columns])


def permutation_importance(
    model: PipelineModel,
    rows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    measure: Column,
    seed: int = 42,
) -> DataFrame:
    """``(column, value, baseline, drop)`` per input; ``measure`` is an aggregate over scored rows.

    All variants of the rows are scored and measured in one job.
    """
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read for the order, its first row and the variants
    try:
        scored = model.transform(variants(with_permuted(kept, columns, keys, seed), columns))
        found = {r["column"]: r["value"] for r in scored.groupBy("column").agg(measure.alias("value")).collect()}  # a row per input
    finally:
        kept.unpersist()
    baseline = found.get(BASELINE)
    listed = [(c, found[c], baseline, baseline - found[c]) for c in columns if c in found]
    return rows.sparkSession.createDataFrame(listed, "column string, value double, baseline double, drop double")
