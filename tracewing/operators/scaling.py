"""Mean imputation and scaling: one aggregate to learn, one projection to apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_double


@dataclass(frozen=True)
class ColumnScale:
    """Mean of the known values, and population deviation after missing ones are set to it."""

    name: str
    mean: float
    deviation: float

    def imputed(self) -> Column:
        return F.coalesce(to_double(self.name), F.lit(self.mean))

    def scaled(self) -> Column:
        return (self.imputed() - F.lit(self.mean)) / F.lit(self.deviation)

    def scaled_sql(self) -> str:
        number = f"try_cast(`{self.name}` as double)"
        value = f"coalesce(case when abs({number}) < double('Infinity') then {number} end, {self.mean!r}D)"
        return f"({value} - {self.mean!r}D) / {self.deviation!r}D"


def learn_scales(df: DataFrame, columns: Sequence[str]) -> list[ColumnScale]:
    """One pass, one row back.  A constant column gets deviation 1, an empty one mean 0."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        value = to_double(c)
        aggregates += [
            F.avg(value).alias(f"mean{i}"),
            F.var_pop(value).alias(f"var{i}"),
            F.count(value).alias(f"known{i}"),
        ]
    row = df.agg(*aggregates).first()
    scales = []
    for i, c in enumerate(columns):
        known = row[f"known{i}"]
        variance = row[f"var{i}"] * known / row["n"] if known else 0.0
        scales.append(ColumnScale(c, row[f"mean{i}"] if known else 0.0, variance**0.5 or 1.0))
    return scales


def mean_impute(df: DataFrame, scales: Sequence[ColumnScale]) -> DataFrame:
    return df.withColumns({s.name: s.imputed() for s in scales})


def standardize(df: DataFrame, scales: Sequence[ColumnScale]) -> DataFrame:
    return df.withColumns({s.name: s.scaled() for s in scales})


def one_hot_rows(
    df: DataFrame, known: DataFrame, columns: Sequence[str], key: str
) -> DataFrame:
    """One-hot coding in long form: ``(key, column, value, known)`` with 1 where training saw the value.

    An unseen or NULL value gives ``known = 0``, the indicator for unknown
    categories.  The categories are one row per value and stay a joined table.
    """
    def long(frame: DataFrame, *extra: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        return frame.select(*extra, F.inline(pairs))

    pair = F.struct("column", "value").alias("_pair")
    seen = long(known).where(F.col("value").isNotNull()).distinct().select(pair, F.lit(1).alias("known"))
    # a common value may hold a large share of the rows
    joined = long(df, key).select("*", pair).join(seen, "_pair", "left")
    return joined.select(key, "column", "value", F.coalesce("known", F.lit(0)).alias("known"))
