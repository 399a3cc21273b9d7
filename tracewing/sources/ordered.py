"""Tables written in a global order, with the bounds of every file, and tables rewritten by partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the bounds below a sorted table; readers of the table itself skip names that begin so.
BOUNDS = "_bounds"


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def write_sorted(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """Replace a table by its rows in order, NULL first: file after file in the order of their names.

    Rows are split into ranges and sorted inside, so no task has them all.
    Equal keys stay in one file.  The first and last key and the number of rows
    of each file are kept beside the files.
    """
    ranged = df.repartitionByRange(files, *_order(order)) if files else df.repartitionByRange(*_order(order))
    ranged.sortWithinPartitions(*_order(order)).write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    key = F.struct(*order)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = spark.read.schema(df.schema).parquet(path).select(name.alias("file"), key.alias("key"))
    bounds = rows.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
    bounds.write.mode("overwrite").parquet(f"{path}/{BOUNDS}")


def file_bounds(spark: SparkSession, path: str) -> DataFrame:
    """``file, first, last, n`` of a sorted table, one row per file."""
    return spark.read.parquet(f"{path}/{BOUNDS}")


def read_sorted(spark: SparkSession, path: str, column: str, low: object = None, high: object = None) -> DataFrame:
    """Rows of a sorted table whose leading ``column`` is between ``low`` and ``high``; other files are not opened.

    Only names of files that may hold such rows come to the driver.
    """
    bounds, wanted = file_bounds(spark, path), F.lit(True)
    fits = F.lit(True)
    if low is not None:
        fits, wanted = fits & (F.col(f"last.{column}") >= F.lit(low)), wanted & (F.col(column) >= F.lit(low))
    if high is not None:
        # files that begin with NULL may hold more than that
        first = F.col(f"first.{column}")
        fits, wanted = fits & (first.isNull() | (first <= F.lit(high))), wanted & (F.col(column) <= F.lit(high))
    names = [r["file"] for r in bounds.where(fits).select("file").collect()]
    table = spark.read.parquet(path) if not names else spark.read.parquet(*[f"{path}/{n}" for n in names])
    return table.where(wanted) if names else table.limit(0)


def with_month(df: DataFrame, ts: str, name: str = "month") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("none")))


def write_months(df: DataFrame, path: str, ts: str) -> None:
    """Write rows below one folder per month of ``ts``; only the months that occur in the rows are replaced."""
    rows = with_month(df, ts)
    # rows of a month are dealt over tasks, which adaptive execution splits where a month is large
    spread = rows.hint("rebalance", "month")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_months(spark: SparkSession, path: str, months: Sequence[str] = ()) -> DataFrame:
    """Rows of the given months, all if none is given; other folders are not listed."""
    table = spark.read.option("mergeSchema", False).parquet(path)
    return table.where(F.col("month").isin(*months)) if months else table
